"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a sequence of turns; each prefix has a hash, chained turn by turn. The trie is kept
compacted: its nodes are the root, the prefixes where conversations part, and those where one ends. A
node's edge spans the depths (p, e], from its parent's depth to its own. The node is hashed at its
handle, the depth in (p, e] that is divisible by the largest power of two (the two-fattest).

Conversations are inserted in batches. Each is located first, by fat binary search: the two-fattest
depth f of what is left of its length is looked up among the handles; a hit moves on below the hit's
node, a miss stays above f. After at most log2(length) + 1 look-ups the deepest node on its path is
known; one more look-up, by the prefix one turn longer, finds the edge that it leaves (or that there is none). A
batch then cuts all edges that are left in the middle at all the depths where they are left, and hangs
one new leaf on each free branch. Conversations that wanted the same branch are located again
for the next batch; every batch takes them at least one node deeper.

Sums over subtrees (members, leaves, code points) are made by pointer doubling: after k rounds a
node has the sums of all nodes fewer than 2**k below it. At last each edge is expanded to its
depths: all the prefixes on one edge have the same members.

Equal conversations are one entry with a count, so a common conversation costs no more than another.
Searches are joins of the conversations with the table of nodes, by hash; nothing is gathered
per branch. A conversation itself is one row of 16 bytes per turn; its turns are
sorted and hashed as a stream, so that its texts need not fit in memory.

Turns with equal numbers are taken by role, then text; null numbers come first; a null role or text is empty.
Rows with a null conv_id take no part. Repeated rows are turns each. No rows give no trie: an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import cut, table

#: Hash of the empty sequence.
ROOT = bytes(16)
#: Conversations that share a beginning: those with ids of one hundred.
FAMILY = 100
#: A shared beginning has fewer turns than this.
SHARED = 6
#: Decimal ids that are hashed as one piece, about, in characters.
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: A node: its edge (p, e], the hashes of the parent, of itself, of the edge's first prefix and of the handle,
#: and the hashes and running code points of all prefixes on the edge (``q`` before it).
NODE = "p int, e int, parent binary, id binary, first binary, handle binary, hs array<binary>, q long, qs array<long>"


def turn_hash(before: bytes, role: str, text: str) -> bytes:
    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(b"%s%d:%s%s" % (before, len(r), r, t), digest_size=16).digest()


def digested(rows: DataFrame) -> DataFrame:
    """(conv_id, ts, ls): per conversation the digests and the lengths in code points of its turns, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, ts, ls = None, [], []
        for b in batches:
            out = []
            for c, role, text in zip(b["conv_id"].tolist(), b["role"].tolist(), b["text"].tolist()):
                if c != conv:
                    if conv is not None:
                        out.append((conv, ts, ls))
                    conv, ts, ls = c, [], []
                ts.append(turn_hash(b"", role, text))
                ls.append(len(text))
            if out:
                yield pd.DataFrame(out, columns=["conv_id", "ts", "ls"])
        if conv is not None:
            yield pd.DataFrame([(conv, ts, ls)], columns=["conv_id", "ts", "ls"])

    turns = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # text goes last and is compared only where number and role tie
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text").mapInPandas(run, "conv_id long, ts array<binary>, ls array<int>")


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, ts, ls): the first h turns of the family's first conversation, then the own turns after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    heads = convs.filter(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("family"), F.slice("ts", 1, SHARED - 1).alias("hts"), F.slice("ls", 1, SHARED - 1).alias("hls"))
    own = convs.withColumns({"family": F.expr(f"conv_id - conv_id % {FAMILY}"), "h": h}).join(heads, "family", "left")

    def joined(head: str, mine: str, kind: str) -> Column:
        start = F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(start, F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine), F.lit(0))))

    return own.select("conv_id", joined("hts", "ts", "array<binary>").alias("ts"), joined("hls", "ls", "array<int>").alias("ls"))


def sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, key, hs, qs): the hashes of all prefixes, the last one as key, and the running code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs = [list(accumulate((bytes(t) for t in ts), lambda x, t: hashlib.blake2b(x + t, digest_size=16).digest(), initial=ROOT))[1:] for ts in b["ts"]]
            qs = [np.cumsum(ls, dtype=np.int64).tolist() for ls in b["ls"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "key": [x[-1] if x else ROOT for x in hs], "hs": hs, "qs": qs})

    return convs.mapInPandas(run, "conv_id long, key binary, hs array<binary>, qs array<long>")


def two_fattest(a: str, b: str) -> str:
    """SQL for the number in (a, b] that is divisible by the largest power of two (a < b)."""
    return f"CAST({b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1) AS INT)"


def nodes_of(edges: DataFrame) -> DataFrame:
    """Nodes from (p, e, parent, q, hs, qs) with the edge's arrays."""
    e = edges.withColumn("f", F.expr(two_fattest("CAST(p AS BIGINT)", "CAST(e AS BIGINT)")))
    return e.select("p", "e", "parent", F.expr("hs[size(hs) - 1]").alias("id"), F.expr("hs[0]").alias("first"), F.expr("hs[f - p - 1]").alias("handle"), "hs", "q", "qs")


def located(seqs: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``seqs`` (key, n, a, hs, qs; a: depth of a node known to be on the path) with ``a`` as the
    depth of the deepest node on the path, and the edge left below it: v_first (null: none), and l, the depth at
    which it is left (a where there is no edge)."""
    at = seqs.withColumn("b", F.col("n"))
    handles = nodes.select(F.col("handle").alias("v_handle"), F.col("id").alias("v_id"), F.col("p").alias("v_p"), F.col("e").alias("v_e"))
    for _ in range(longest.bit_length()):
        at = at.withColumn("f", F.expr(f"CASE WHEN a < b THEN {two_fattest('CAST(a AS BIGINT)', 'CAST(b AS BIGINT)')} END"))
        at = at.withColumn("probe", F.expr("CASE WHEN f IS NOT NULL THEN hs[f - 1] END")).join(handles, F.col("probe") == F.col("v_handle"), "left")
        whole = "(v_e <= n AND hs[v_e - 1] = v_id)"
        at = at.withColumns({
            "a2": F.expr(f"CASE WHEN f IS NULL OR v_id IS NULL THEN a WHEN {whole} THEN v_e ELSE v_p END"),
            "b2": F.expr(f"CASE WHEN f IS NULL THEN b WHEN v_id IS NULL THEN f - 1 WHEN {whole} THEN b ELSE v_p END"),
        }).select("key", "n", F.col("a2").alias("a"), F.col("b2").alias("b"), "hs", "qs")
    edges = nodes.select(F.col("first").alias("v_first"), F.col("hs").alias("v_hs"))
    at = at.withColumn("probe", F.expr("CASE WHEN a < n THEN hs[a] END")).join(edges, F.col("probe") == F.col("v_first"), "left")
    same = "size(filter(sequence(0, least(size(v_hs), n - a) - 1), i -> v_hs[i] = hs[a + i]))"
    return at.select("key", "n", "a", "hs", "qs", "v_first", F.expr(f"CASE WHEN v_first IS NULL THEN a ELSE a + {same} END").alias("l"))


def cut_edges(nodes: DataFrame, left: DataFrame) -> DataFrame:
    """``nodes`` with the edges cut at the depths where they are left: ``left`` (v_first, l)."""
    cuts = left.groupBy("v_first").agg(F.sort_array(F.collect_set("l")).alias("cuts"))
    met = nodes.join(cuts, F.col("first") == F.col("v_first"), "left")
    ends = met.filter("cuts IS NOT NULL").withColumn("ends", F.expr("concat(cuts, array(e))"))
    parts = ends.select("*", F.posexplode("ends").alias("k", "to")).withColumn("from", F.expr("CASE WHEN k = 0 THEN p ELSE ends[k - 1] END"))
    parts = parts.select(
        F.col("from").alias("p"), F.col("to").alias("e"), F.expr("CASE WHEN k = 0 THEN parent ELSE hs[from - p - 1] END").alias("parent"),
        F.expr("CASE WHEN k = 0 THEN q ELSE qs[from - p - 1] END").alias("q"),
        F.expr("slice(hs, from - p + 1, to - from)").alias("hs"), F.expr("slice(qs, from - p + 1, to - from)").alias("qs"))
    return met.filter("cuts IS NULL").select(*nodes.columns).unionByName(nodes_of(parts))


def build(seqs: DataFrame) -> DataFrame:
    """The compacted nodes (but for the root) of the trie of ``seqs``: (key, hs, qs), distinct by key."""
    spark = seqs.sparkSession
    nodes = spark.createDataFrame([], NODE)
    rest = cut(seqs.filter("size(hs) > 0").select("key", F.size("hs").alias("n"), F.lit(0).alias("a"), "hs", "qs"), "trie-rest")
    longest = rest.agg(F.max("n")).first()[0] or 0
    while not rest.isEmpty():
        at = cut(located(rest, nodes, longest), "trie-located")
        nodes = cut_edges(nodes, at.filter("v_first IS NOT NULL").select("v_first", "l"))
        wants = at.filter("l < n").withColumn("branch", F.expr("hs[l]"))
        first = wants.groupBy("branch").agg(F.min("key").alias("key"))
        leaf = wants.join(first.select("key"), "key").select(
            F.col("l").alias("p"), F.col("n").alias("e"), F.expr(f"CASE WHEN l = 0 THEN unhex('{ROOT.hex()}') ELSE hs[l - 1] END").alias("parent"),
            F.expr("CASE WHEN l = 0 THEN 0L ELSE qs[l - 1] END").alias("q"), F.expr("slice(hs, l + 1, n - l)").alias("hs"), F.expr("slice(qs, l + 1, n - l)").alias("qs"))
        nodes = cut(nodes.unionByName(nodes_of(leaf)), "trie-nodes")
        rest = cut(wants.join(first.select("key"), "key", "left_anti").select("key", "n", F.col("l").alias("a"), "hs", "qs"), "trie-rest")
    return nodes


SUMS = ("members", "points", "letters", "leaves")


def summed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, parent, least and SUMS of their own) with the sums over their subtrees and the
    least of them, by pointer doubling."""
    at = nodes.withColumn("up", F.col("parent"))
    while True:
        sums = at.filter("up IS NOT NULL").groupBy("up").agg(F.min("least").alias("least_"), *[F.sum(c).alias(f"{c}_") for c in SUMS])
        # the root has no node above it: whoever points there is done and needs no look-up
        above = at.filter(F.col("up").isNotNull() & (F.col("up") != F.lit(ROOT))).select("id", "up")
        above = above.join(at.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", "further")
        step = at.drop("up").join(sums.withColumnRenamed("up", "id"), "id", "left").join(above, "id", "left")
        at = cut(step.select("id", "parent", F.least("least", "least_").alias("least"),
                             *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in SUMS], F.col("further").alias("up")), "trie-sums")
        if at.filter("up IS NOT NULL").isEmpty():
            return at.drop("up")


def end_digests(members: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of the members (key, conv_id), ids ascending, joined by commas. The ids are
    sorted over all tasks and joined to pieces there; a digest has to take its pieces one after another, so one
    task reads those of one key, as a stream."""
    width = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, size = None, [], 0
        for b in batches:
            out = []
            for k, c in zip(b["key"].tolist(), b["conv_id"].tolist()):
                if k != key or size > PIECE:
                    if ids:
                        out.append((key, int(ids[0]), ",".join(ids)))
                    key, ids, size = k, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pd.DataFrame(out, columns=["key", "least", "ids"])
        if ids:
            yield pd.DataFrame([(key, int(ids[0]), ",".join(ids))], columns=["key", "least", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for b in batches:
            out = []
            for k, ids in zip(b["key"].tolist(), b["ids"].tolist()):
                if k == key:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["key", "ends"])
        if sha is not None:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "ends"])

    some = members.select("key", "conv_id").repartitionByRange(width, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(pieces, "key binary, least long, ids string")
    return some.repartition("key").sortWithinPartitions("key", "least").select("key", "ids").mapInPandas(digests, "key binary, ends string")


def expanded(members: DataFrame) -> DataFrame:
    """One row per prefix of ``members`` (conv_id, key, hs, qs): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    entries = cut(members.groupBy("key").agg(F.min("conv_id").alias("least"), F.count("*").alias("members"), F.first("hs").alias("hs"), F.first("qs").alias("qs")), "trie-entries")
    nodes = build(entries.select("key", "hs", "qs"))
    empty = "cast(array() as array<{}>)"
    root = entries.agg(F.count("*").alias("any")).filter("any > 0").select(
        F.lit(-1).alias("p"), F.lit(0).alias("e"), F.lit(None).cast("binary").alias("parent"), F.lit(ROOT).alias("id"), F.lit(0).cast("long").alias("q"),
        F.expr(empty.format("bigint")).alias("qs"))
    every = cut(nodes.select("p", "e", "parent", "id", "q", "qs").unionByName(root), "trie-nodes")

    children = every.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    own = every.join(children, "id", "left").join(entries.select(F.col("key").alias("id"), "least", "members"), "id", "left")
    last = "CASE WHEN size(qs) = 0 THEN 0L ELSE qs[size(qs) - 1] END"
    own = cut(own.select(
        "p", "e", "parent", "id", "q", "qs", F.coalesce("children", F.lit(0)).cast("long").alias("children"), "least", F.coalesce("members", F.lit(0)).cast("long").alias("members"),
        F.expr(f"coalesce(members, 0) * ({last})").alias("points"), F.expr(f"({last}) - q").alias("letters"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "trie-own")
    sums = summed(own.select("id", "parent", "least", *SUMS))

    upper = sums.select(F.col("id").alias("parent"), F.col("least").alias("above"))
    whole = own.select("p", "e", "id", "q", "qs", "children").join(sums, "id").join(upper, "parent", "left").join(end_digests(members).withColumnRenamed("key", "id"), "id", "left")
    # saved at depth d: words of all members from there on, less one copy of the prefixes there and below
    deep = whole.select("*", F.explode(F.expr("CASE WHEN e = 0 THEN array(0) ELSE sequence(p + 1, e) END")).alias("d"))
    before = "CASE WHEN d <= p + 1 THEN q ELSE qs[d - p - 2] END"
    return deep.select(
        F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == 0, None).when(F.col("d") == F.col("p") + 1, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(F.col("d") == F.col("e"), F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.expr(f"points - members * ({before}) - (letters + q - ({before}))").alias("saved_tokens"),
        F.when(F.col("d") == F.col("e"), F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The expanded trie of the conversations of ``rows`` (conv_id, turn, role, text) as they are."""
    return expanded(cut(sequences(digested(rows)), "trie-members"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = cut(digested(table(spark, sf_dir, "conversations")), "trie-turns")
    return expanded(cut(sequences(rebuilt(convs)), "trie-members"))


_OCTETS = "list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda o: ('0x' || o)::BIGINT)"

ORACLE = f"""
WITH crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) AS v FROM range(256) AS x(i))
), turns AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), numbered AS (
  SELECT c, own, (xor(list_reduce({_OCTETS}, lambda v, o: xor(v >> 8, t[1 + (xor(v, o) & 255)]), 4294967295), 4294967295) % {SHARED})::INT AS h FROM turns, crc
), built AS (
  SELECT n.c, CASE WHEN b.own IS NULL THEN [] ELSE b.own[1:n.h] END || n.own[n.h + 1:] AS s
  FROM numbered n LEFT JOIN turns b ON b.c = n.c - n.c % {FAMILY}
), prefixes AS (
  SELECT c, len(s) AS n, d, s[1:d] AS node FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)
), nodes AS (
  SELECT node, d, min(c) AS c, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS ends FROM prefixes GROUP BY node, d
), kids AS (SELECT node[1:d - 1] AS node, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL
), facts AS (
  SELECT n.*, coalesce(k, 0) AS k, (n.n - 1) * CASE WHEN d = 0 THEN 0 ELSE length(n.node[d].t) END AS saved FROM nodes n LEFT JOIN kids USING (node)
), below AS (
  SELECT node[1:up] AS node, sum(k = 0)::BIGINT AS leaves, sum(saved)::BIGINT AS saved
  FROM (SELECT node, k, saved, unnest(range(d + 1)) AS up FROM facts) GROUP BY ALL
)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, b.leaves AS n_leaves,
       b.saved AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM facts f JOIN below b USING (node) LEFT JOIN nodes p ON f.d > 0 AND p.d = f.d - 1 AND p.node = f.node[1:f.d - 1]
"""
