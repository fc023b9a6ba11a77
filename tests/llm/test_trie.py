"""The z-fast trie against all prefixes written out."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tianguis.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}


def rebuilt(own):
    out = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(int(c / 100) * 100, [])[:h] + ts[h:]  # the remainder has the sign of c, as in SQL
    return out


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        return [node, *(x for k in children[node] for x in below(k))]

    out = []
    for node, cs in members.items():
        sub = below(node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]),
                    sum(not children[x] for x in sub), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def conversations(seed, n, deep, kinds):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(kinds)) for c in range(n) for t in range(rng.randint(1, deep))]


@pytest.mark.parametrize("seed, n, deep, kinds", [(1, 120, 5, ["a", "bb"]), (2, 80, 17, ["x"]), (3, 60, 9, ["a", "é\U0001f600", "", "ccc"])])
def test_any_conversations(spark, seed, n, deep, kinds):
    rows = conversations(seed, n, deep, kinds)
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == COLUMNS
    assert rows_of(got) == brute(turns_of(rows))


def test_query_with_rebuilt_conversations(spark, tmp_path):
    rows = conversations(5, 330, 8, ["a", "b", "the same"])
    rows += [(c, 0, "user", "common") for c in range(1000, 1500)]                       # one common conversation
    rows += [(None, 0, "user", "lost"), (400, None, None, None), (400, None, "user", "first"), (400, 3, "user", "z"), (400, 3, "user", "y")]
    rows += [(400, 3, "user", "y"), (-5, 0, "user", "minus"), (-100, 0, "user", "base"), (-100, 1, "user", "more")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({"key": F.lit(1), "depth": F.lit("clash"), "hs": F.lit(2)})
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(trie.op13_trie(spark, str(tmp_path))) == brute({c: ts for c, ts in rebuilt(turns_of(rows)).items()})




def test_no_rows(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_fat_search_finds_the_deepest_node(spark):
    rows = conversations(7, 50, 33, ["x", "y"])
    rows = [(c, t, "u", text if t > 6 else "x") for c, t, _, text in rows]
    seqs = trie.sequences(trie.digested(spark.createDataFrame(rows, SCHEMA))).select("key", "hs", "qs").dropDuplicates(["key"])
    nodes = trie.build(seqs.limit(30)).cache()
    depth = {bytes(r.id): r.e for r in nodes.collect()}
    for f, (p, e) in [(8, (6, 13)), (4, (3, 7)), (6, (5, 6)), (16, (0, 31))]:
        assert spark.sql(f"SELECT {trie.two_fattest(f'{p}L', f'{e}L')}").first()[0] == f
    asked = seqs.select("key", F.size("hs").alias("n"), F.lit(0).alias("a"), "hs", "qs")
    found = trie.located(asked, nodes, 40).collect()
    for r in found:
        on_path = [d for d, h in enumerate(map(bytes, r.hs), 1) if depth.get(h) == d]
        assert r.a == max(on_path, default=0)
        shared = {bytes(h) for x in nodes.collect() for h in x.hs}
        assert r.l == max([d for d, h in enumerate(map(bytes, r.hs), 1) if h in shared], default=0)


def test_end_digests_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    members = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.lit(b"hot")).otherwise(F.lit(b"b")).alias("key"), (F.col("id") - 250).alias("conv_id"))
    got = {bytes(r.key): r.ends for r in trie.end_digests(members).collect()}
    for key, keep in ((b"hot", lambda i: i % 3 > 0), (b"b", lambda i: i % 3 == 0)):
        assert got[key] == sha256(",".join(str(i - 250) for i in range(500) if keep(i)).encode()).hexdigest()
