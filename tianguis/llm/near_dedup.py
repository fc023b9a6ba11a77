"""Near-duplicate documents with an LSH forest over MinHash signatures.

A document's set holds its distinct word shingles. Documents with equal sets
form one node, whatever their number. ``TREES`` rotations of the signature give as many sorted
orders of the nodes by their signature values, so that the neighbours of a node in the order
are those with the longest common prefix. The order is cut to regions, each a common prefix as short as its
crowd allows: ``SHALLOW`` values where no more than ``SPARSE`` nodes share them, one more where these do not
suffice, at most ``DEPTH``. Where few documents are alike, pairs thus meet that share few values; where many are,
a region stays at ``DEPTH`` values and is compared whole, however crowded.

1. Orders are dealt to tasks by range, so a crowded region is spread. Nodes
   alone in all their regions are done.
2. Each node proposes the neighbours whose bit sketches differ least. Proposed
   pairs are confirmed on the full sets and joined to components.
3. What the neighbours leave open is settled within the regions: where a region
   still holds several components, each of its nodes outside the largest one is
   compared with all nodes of the region in other components, in blocks if the region
   is crowded. Pairs pass a bound on set sizes and on the sketches' distance (five
   standard deviations beyond what the threshold expects), then the full sets decide.

A pair that shares ``DEPTH`` values in some tree always meets. A pair at the threshold itself (0.85) shares
them in no tree with probability (1 - 0.85**6) ** 32 = 3e-7, and fails the sketch bound with about the same; where
its regions are sparse, the first is (1 - 0.85**4) ** 32 = 7e-11.

A text with fewer words than a shingle has one shingle, all its words; one without
words, or null, has an empty set and is linked with nothing. A row with a null doc_id is
returned with its set size, a null component and kept null. Repeated rows are
returned each; rows that repeat a doc_id belong to the component of their own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tianguis.llm.common import BROADCAST_ROWS, cut, table, worker_cache

TREES = 32
DEPTH = 6
#: Least depth of a region, and the most nodes that one of less than the full depth may hold.
SHALLOW = 4
SPARSE = 8
#: Signature values that make up an order.
ORDERED = 8
#: Rows of one region that a task gathers before it cuts the region there.
GATHERED = 50_000
#: Neighbours that each node proposes.
PROPOSALS = 8
#: Standard deviations that the sketch bound leaves.
SIGMAS = 5
#: A region of more nodes is compared in blocks of LOT by LOT nodes, a smaller one by a join.
CROWD = 48
LOT = 384
WORDS_KEPT = 300_000
SIZE = TREES * DEPTH


def odd_constants(n: int, seed: int, bits: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return (rng.integers(0, 1 << (bits - 1), n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(f"uint{bits}")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of hashed word shingles and their signatures."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = WordHashes()
        self.factors = odd_constants(words, 11, 64)
        self.a, self.b = odd_constants(SIZE, 12, 32)[:, None], odd_constants(SIZE, 13, 32)[:, None]

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes. Words are split at ASCII white space,
        A-Z lower-cased."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        n, k = len(words), self.words
        if not n:
            return np.empty(0, np.uint64)
        if len(self.hashes) > WORDS_KEPT:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        if n < k:
            return mix(np.sum(h * self.factors[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
        s = h[: n - k + 1] * self.factors[0]
        for j in range(1, k):
            s += h[j : n - k + 1 + j] * self.factors[j]
        return np.unique(mix(s))

    def signature(self, s: np.ndarray) -> np.ndarray:
        x, out = (s >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(x), 1024):
            low = ((x[i : i + 1024] ^ self.b) * self.a).min(axis=1)
            out = low if out is None else np.minimum(out, low)
        return out


def shingler(words: int) -> Shingler:
    return worker_cache(f"shingler:{words}", lambda: Shingler(words))


def describe(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tree, the hash of the first DEPTH values and the order (16 bits of a hash of each of the
    first eight values, four to a word), and the sketch (two bits of each value), of signatures (rows)."""
    n = len(sig)
    wide = np.concatenate([sig, sig[:, :ORDERED]], axis=1).astype(np.uint64)
    f, keys = odd_constants(DEPTH + 1, 14, 64), np.zeros((n, TREES), np.uint64)
    for j in range(DEPTH):
        keys += wide[:, j : j + SIZE : DEPTH] * f[j]
    keys = mix(mix(keys) + np.arange(TREES, dtype=np.uint64) * f[DEPTH])
    order = np.zeros((2, n, TREES), np.uint64)
    short = (wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    for j in range(ORDERED):
        order[j // 4] = order[j // 4] << np.uint64(16) | short[:, j : j + SIZE : DEPTH]
    two = sig ^ (sig >> np.uint32(7)) ^ (sig >> np.uint32(15))
    bit = np.stack([two & np.uint32(1), (two >> np.uint32(1)) & np.uint32(1)], axis=2).reshape(n, -1)
    bits = np.packbits(bit.astype(np.uint8), axis=1).view(">u8").astype(np.int64)
    return keys.view(np.int64), np.concatenate([*order], axis=1).view(np.int64), bits


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, orders, sketch) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = shingler(words)
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                sets = [sh.set_of(t) for t in part["text"].where(part["text"].notna(), None)]
                sig = np.stack([sh.signature(s) if len(s) else np.zeros(SIZE, np.uint32) for s in sets])
                keys, order, bits = describe(sig)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n_shingles": [len(s) for s in sets], "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "keys": list(keys), "orders": list(order), "sketch": list(bits)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, set_key binary, keys array<long>, orders array<long>, sketch array<long>")


def regions(tree: np.ndarray, o1: np.ndarray, o2: np.ndarray, open_first: bool, open_last: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The regions of sorted rows: for each depth, the rows in regions of that depth, their region's key,
    and whether the row before is in the same region.

    A run of rows with a common prefix is a region of that depth if it holds at most SPARSE rows, or if it has the full
    depth; otherwise its parts of the next depth are looked at. A run at an open end may go on in another
    task, which sees only its own part: it is taken at every depth it could have, so that rows of one run meet."""
    n, out = len(tree), []
    same = (tree[1:] == tree[:-1]) & (o1[1:] == o1[:-1])
    going = np.ones(n, bool)
    for depth in range(SHALLOW, DEPTH + 1):
        drop = np.uint64(16 * (ORDERED - depth))
        prefix = o2.view(np.uint64) >> drop if depth > 4 else np.zeros(n, np.uint64)
        starts = np.r_[True, ~(same & (prefix[1:] == prefix[:-1]))]
        run = np.cumsum(starts) - 1
        size = np.bincount(run)[run]
        ends = ((run == 0) & open_first) | ((run == run[-1]) & open_last)
        small = size <= SPARSE if depth < DEPTH else np.ones(n, bool)
        taken = going & small & ((size > 1) | ends)
        key = mix(mix(mix(o1.view(np.uint64) + tree.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + prefix) + np.uint64(depth))
        out.append((taken, key.view(np.int64), ~starts))
        going &= ~small | ends
    return out


def neighbours(forest: DataFrame) -> DataFrame:
    """(key, tree, label, prev) of the rows of ``forest`` (tree, o1, o2, label), sorted, that share a region with
    others, once per region; prev is the neighbour before in the same region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, open_first = None, True  # rows of the last run, which may go on
        for b in batches:
            f = b if held is None else pd.concat([held, b], ignore_index=True)
            tree, o1 = f["tree"].to_numpy(), f["o1"].to_numpy()
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (o1[1:] != o1[:-1]))
            if len(new):
                yield given(f.iloc[: new[-1] + 1], open_first, False)
                held, open_first = f.iloc[new[-1] + 1 :], False
            elif len(f) < GATHERED:
                held = f
            else:
                yield given(f, open_first, True)
                held, open_first = None, True
        if held is not None and len(held):
            yield given(held, open_first, True)

    def given(f: pd.DataFrame, open_first: bool, open_last: bool) -> pd.DataFrame:
        tree, label = f["tree"].to_numpy(), f["label"].to_numpy()
        before, out = np.r_[label[:1], label[:-1]], []
        for taken, key, follows in regions(tree, f["o1"].to_numpy(), f["o2"].to_numpy(), open_first, open_last):
            prev = pd.array(before[taken], "Int64")
            prev[~follows[taken]] = pd.NA
            out.append(pd.DataFrame({"key": key[taken], "tree": tree[taken], "label": label[taken], "prev": prev}))
        return pd.concat(out)

    return forest.mapInPandas(run, "key long, tree int, label long, prev long")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * |A and B| >= num * |A or B| on the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keep = []
            for x, y in zip(f["set_a"], f["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(both) - shared))
            yield f.loc[keep, ["a", "b"]]

    one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInPandas(run, "a long, b long").distinct()


def in_lots(placed: DataFrame) -> DataFrame:
    """The nodes of crowded regions in lots of about ``LOT``, once for every block (i, j) of two lots to
    compare. The largest component's nodes have lots of their own, after the others; these
    meet the others only, so that i is always a lot of nodes outside it."""
    lots = placed.withColumns({"outer": F.expr(f"CAST((crowd - top_n) div {LOT} AS INT) + 1"), "inner": F.expr(f"CAST(top_n div {LOT} AS INT) + 1")})
    lots = lots.withColumn("lot", F.expr("CAST(IF(comp = top, outer + pmod(xxhash64(a), inner), pmod(xxhash64(a), outer)) AS INT)"))
    other = F.explode(F.expr("sequence(0, IF(comp = top, outer, outer + inner) - 1)"))
    return lots.select("*", other.alias("with")).withColumns({"i": F.least("lot", "with"), "j": F.greatest("lot", "with")}).drop("outer", "inner", "with", "crowd", "top", "top_n")


def in_crowds(placed: DataFrame, sets: DataFrame, num: int, den: int, most: int, longs: int) -> DataFrame:
    """The links (a, b) that crowded regions still hold between different components.

    A region is cut into lots, and pairs of lots are compared as one block: sizes,
    sketches and shared regions as arrays, the pairs that pass on their full sets. No pair
    becomes a row unless it is a link, and a task holds two lots at a time."""

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        one = f[f["lot"] == f["i"]]
        two = one if f["i"].iloc[0] == f["j"].iloc[0] else f[f["lot"] == f["j"]]
        if not len(one) or not len(two):
            return pd.DataFrame([], columns=["a", "b"])
        tree = int(f["tree"].iloc[0])
        a, b = one["a"].to_numpy(), two["a"].to_numpy()
        ca, cb = one["comp"].to_numpy(), two["comp"].to_numpy()
        na, nb = one["a_n_shingles"].to_numpy(), two["a_n_shingles"].to_numpy()
        ok = ca[:, None] != cb[None, :]
        ok &= num * np.maximum(na[:, None], nb[None, :]) <= den * np.minimum(na[:, None], nb[None, :])
        if one is two:
            ok &= a[:, None] < b[None, :]
        apart = np.zeros(ok.shape, np.int64)
        for k in range(longs):
            x = one[f"a_s{k}"].to_numpy().view(np.uint64)[:, None] ^ two[f"a_s{k}"].to_numpy().view(np.uint64)[None, :]
            apart += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
        ok &= apart <= most
        keys_a, keys_b = np.stack(one["a_keys"].to_numpy()), np.stack(two["a_keys"].to_numpy())
        for t in range(tree):
            ok &= keys_a[:, t][:, None] != keys_b[:, t][None, :]
        sets_a = [np.frombuffer(s, np.uint64) for s in one["set"]]
        sets_b = [np.frombuffer(s, np.uint64) for s in two["set"]]
        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(ok.any(axis=1)):
            js, s = np.flatnonzero(ok[i]), sets_a[i]
            ends = np.cumsum([len(sets_b[j]) for j in js])
            all_b = np.concatenate([sets_b[j] for j in js])
            hit = s[np.minimum(np.searchsorted(s, all_b), len(s) - 1)] == all_b
            shared = np.add.reduceat(hit, np.r_[0, ends[:-1]])
            union = len(s) + np.diff(np.r_[0, ends]) - shared
            links += [(int(a[i]), int(b[j])) for j in js[den * shared >= num * union]]
        return pd.DataFrame([(min(x), max(x)) for x in links], columns=["a", "b"])

    blocks = in_lots(placed).join(sets.select(F.col("label").alias("a"), "set"), "a")
    return blocks.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(label, component): the smallest node label reachable, for every label that
    an edge (a, b) names. Alternates large-star and small-star steps: each
    edge moves to the smallest neighbour known, until all point at the root."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if now == state:
            return e.select(F.col("u").alias("label"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("label"), F.col("v").alias("component")).distinct())
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        e = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e, "edges")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``
    (doc_id, text): documents are linked from a Jaccard similarity of num/den."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sigs = cut(signatures(docs, words), "signatures")
    first = {c: F.first(c).alias(c) for c in ("n_shingles", "keys", "orders", "sketch")}
    nodes = cut(sigs.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc"), *first.values()).withColumn("label", F.monotonically_increasing_id()), "nodes")

    each = F.posexplode(F.arrays_zip("keys", F.slice("orders", 1, TREES).alias("o1"), F.slice("orders", TREES + 1, TREES).alias("o2")))
    forest = nodes.select("label", each.alias("tree", "x")).select("tree", F.col("x.o1").alias("o1"), F.col("x.o2").alias("o2"), "label")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["tree", "o1", "o2", "label"]
    active = cut(neighbours(forest.repartitionByRange(width, *order).sortWithinPartitions(*order)), "active")

    differ = (1 - num / den) * 3 / 4  # unequal values still agree in their two bits one time in four
    most = int(SIZE * differ + SIGMAS * (SIZE * differ * (1 - differ)) ** 0.5)
    longs = 2 * SIZE // 64
    facts = nodes.select("label", "n_shingles", "keys", *(F.col("sketch")[i].alias(f"s{i}") for i in range(longs)))

    def side(name: str) -> DataFrame:
        return facts.toDF(*(f"{name}_{c}" if c != "label" else name for c in facts.columns))

    apart = " + ".join(f"bit_count(((a_s{i} ^ b_s{i}) | shiftrightunsigned(a_s{i} ^ b_s{i}, 1)) & {0x5555555555555555}L)" for i in range(longs))
    near = f"{num} * greatest(a_n_shingles, b_n_shingles) <= {den} * least(a_n_shingles, b_n_shingles) AND {apart} <= {most}"

    labels = nodes.select("label", "doc", "set_key").join(active.select("label").distinct(), "label", "left_semi")
    small = labels.count() <= BROADCAST_ROWS
    sets = cut(full_sets(docs.join(F.broadcast(labels) if small else labels, F.col("doc_id") == F.col("doc")), words), "sets")

    pairs = active.filter("prev <> label").select(F.least("label", "prev").alias("a"), F.greatest("label", "prev").alias("b")).distinct()
    pairs = pairs.join(side("a").drop("a_keys"), "a").join(side("b").drop("b_keys"), "b").filter(near).select("a", "b", F.expr(apart).alias("apart"))
    ends = pairs.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("end"))
    best = W.partitionBy("end").orderBy("apart", "a", "b")
    proposed = cut(ends.withColumn("r", F.row_number().over(best)).filter(f"r <= {PROPOSALS}").select("a", "b").distinct(), "proposed")
    linked = cut(confirm(proposed, sets, num, den), "linked")
    comp = components(linked)

    placed = active.select("key", "tree", "label").distinct().join(comp, "label", "left").select("key", "tree", F.col("label").alias("a"), F.coalesce("component", "label").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("crowd"), F.max(F.struct("n", "comp")).alias("top")).filter("parts > 1").select("key", "crowd", F.col("top.comp").alias("top"), F.col("top.n").alias("top_n"))
    placed = cut(placed.join(mixed, "key").join(side("a"), "a"), "placed")
    few = placed.filter(f"crowd <= {CROWD}").drop("top_n")
    other = few.drop("tree", "crowd").toDF(*(c if c == "key" else "b" + c[1:] if c[0] == "a" else f"b_{c}" for c in few.columns if c not in ("tree", "crowd")))
    # A pair that shares all DEPTH values in several trees comes up in the first of them only.
    first_shared = "array_position(zip_with(a_keys, b_keys, (x, y) -> x = y), true) IN (0, tree + 1)"
    open_pairs = (few.filter("comp <> top").join(other, "key")
                  .filter(f"comp <> b_comp AND (b_comp = b_top OR a < b) AND {near} AND {first_shared}")
                  .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                  .join(proposed, ["a", "b"], "left_anti"))
    crowded = in_crowds(placed.filter(f"crowd > {CROWD}"), sets, num, den, most, longs)
    linked = linked.unionByName(cut(confirm(open_pairs, sets, num, den), "linked")).unionByName(cut(crowded, "linked")).distinct()
    comp = components(linked)

    rooted = nodes.select("set_key", "doc", "label").join(comp, "label", "left").select("set_key", "doc", F.coalesce("component", "label").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("component")), "root").select("set_key", "component")
    out = sigs.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", of.alias("component_id"), (F.col("doc_id") == of).alias("kept"))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(label, set): the sorted 64-bit shingle hashes of each node, computed again from
    (label, set_key, text) rows; rows whose text has another set are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = shingler(words)
        for b in batches:
            sets = [sh.set_of(t).tobytes() for t in b["text"].where(b["text"].notna(), None)]
            own = [hashlib.blake2b(s, digest_size=16).digest() == bytes(k) for s, k in zip(sets, b["set_key"])]
            yield pd.DataFrame({"label": b["label"].to_numpy(), "set": sets})[own]

    return docs.select("label", "set_key", "text").mapInPandas(run, "label long, set binary").dropDuplicates(["label"])


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


#: All pairs of documents whose sets differ, by the shingles they share; then what is reachable.
ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
                      ELSE list_sort(list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1:i + 3]))) END AS s FROM doc
), sets AS MATERIALIZED (SELECT s, min(doc_id) AS id, len(s) AS n FROM grams WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s
), gram AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM sets
), pair AS (
  SELECT a.id AS a, b.id AS b FROM gram a JOIN gram b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edge AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (SELECT id AS a, id AS b FROM sets UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), root AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, len(g.s)::BIGINT AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS component_id,
       doc_id = CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS kept
FROM grams g LEFT JOIN sets t ON len(g.s) > 0 AND t.s = g.s LEFT JOIN root ON root.id = t.id
"""
