"""Systematic sampling against a plain computation, and its bounds."""

import re
from collections import defaultdict
from fractions import Fraction
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tianguis.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, source string, text string"


def brute(rows, weights=(5, 2, 1), most=3, seed="mix"):
    """(doc_id, size, source_size, target, taken), document by document, in exact arithmetic."""
    docs = [(i, s, len(WORD.findall(t)) if t else 0) for i, s, t in rows]
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, limit, share = sum(sizes.values()), {s: most * n for s, n in sizes.items()}, {}
    open_ = set(order)
    while True:
        rest = total - sum(limit[s] for s in order if s not in open_)
        wide = sum(weight[s] for s in open_)
        share = {s: Fraction(rest * weight[s], wide) if s in open_ else Fraction(limit[s]) for s in order}
        over = {s for s in open_ if share[s] > limit[s]}
        if not over or over == open_:
            break
        open_ -= over
    unit, out = 10**15, []
    draws = [int(md5(f"{seed}/offset:{k}".encode()).hexdigest()[:12], 16) * unit >> 48 for k in range(64)]
    for s in order:
        target = float(share[s])
        step = min(int(1e15 * (target / sizes[s])) if sizes[s] else 0, most * unit)
        mine = sorted((n, md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i is not None, i or 0) for i, x, n in docs if x == s)
        tries = []
        for k, u in enumerate(draws):
            taken = [n * (((r + 1) * step + u) // unit - (r * step + u) // unit) for r, (n, *_) in enumerate(mine)]
            tries.append((abs(sum(taken) - target), k, taken))
        out += [(i if known else None, n, sizes[s], target, t) for (n, _, known, i), t in zip(mine, min(tries)[2])]
    return sorted(out, key=str)


def some_rows():
    rows = [(i, f"s{i % 7}", "word " * (i * 37 % 91)) for i in range(300)]
    rows += [(1000 + i, "s1", "long\ttext\x0bhere\n" * 400) for i in range(3)]       # hot sizes
    rows += [(2000 + i, None, "a b c") for i in range(20)] + [(None, "s2", "x y"), (None, "s2", None), (None, None, "")]
    rows += [(5, "s5", "word " * 5)] * 4 + [(3000, "", "z " * 9), (3001, "é", "one word")]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_plain_computation(spark, parts):
    rows = some_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"size": F.lit(1), "copies": F.lit("x"), "_source": F.lit(2), "n": F.lit(3)})
    got = mixing.planned(docs).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_bounds(spark):
    rows = some_rows()
    got = mixing.planned(spark.createDataFrame(rows, SCHEMA), ("source",)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    assert abs(sum(rs[0].target for rs in by.values()) - sum(r.size for r in got)) < 1e-6
    for rs in by.values():
        assert rs[0].target <= 3 * rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)


def test_the_mix_holds_each_row_as_often_as_it_is_taken(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * (1 + i % 5)) for i in range(60)], SCHEMA).withColumn("target", F.lit("clash"))
    plan = {r.doc_id: (r.copies, r.size) for r in mixing.planned(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "source", "text", "copy"]
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.doc_id].append(r.copy)
        assert len(r.text.split()) == plan[r.doc_id][1]
    assert {i: sorted(c) for i, c in seen.items()} == {i: list(range(1, c + 1)) for i, (c, _) in plan.items() if c}


def test_empty_and_wordless(spark):
    assert mixing.planned(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.planned(spark.createDataFrame([(1, "a", ""), (2, None, None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_a_hot_source_lies_in_many_tasks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"), F.lit("same text").alias("text"))
    got = mixing.planned(docs, ("source",)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 2 for r in got)
