"""Components equal those of comparing all pairs."""

import random

import numpy as np
import pytest

from tianguis.llm.near_dedup import DEPTH, SHALLOW, SPARSE, components, near_duplicates, neighbours, regions


def shingles(text, k):
    words = text.encode().lower().split() if text else []
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, num, den):
    """component by row, through all pairs of distinct sets."""
    sets = [shingles(t, k) for _, t in rows]
    distinct = list({s for (i, _), s in zip(rows, sets) if s and i is not None})
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    at = {s: n for n, s in enumerate(distinct)}
    low = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            low[find(at[s])] = min(low.get(find(at[s]), i), i)
    return sorted(((i, len(s), None if i is None else low[find(at[s])] if s else i) for (i, _), s in zip(rows, sets)), key=str)


def corpus(rng, n_groups=12, group=8, words=60, edits=8):
    vocabulary = [f"w{i}" for i in range(500)]
    rows, at = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(group):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((at, " ".join(copy)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, num, den", [(3, 85, 100), (5, 80, 100)])
def test_equals_all_pairs(spark, k, num, den):
    rows = corpus(random.Random(k))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "Two words"), (1004, "two WORDS"), (1005, "two\x1cwords"), (None, rows[0][1]), (7, rows[0][1]), rows[3], (1006, "x " * 50000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, label int, key int").repartition(3)
    got = near_duplicates(docs, k, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_crowded_regions_and_joins_agree(spark, monkeypatch):
    """One large group whose members are linked in part: the same components whether regions are compared in small
    blocks or by a join."""
    import tianguis.llm.near_dedup as N

    rows = corpus(random.Random(9), n_groups=1, group=150, words=80, edits=14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 85, 100)
    for crowd, lot in ((10**9, 384), (2, 16)):
        monkeypatch.setattr(N, "CROWD", crowd)
        monkeypatch.setattr(N, "LOT", lot)
        monkeypatch.setattr(N, "PROPOSALS", 1)
        got = N.near_duplicates(docs, 3, 85, 100).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_a_stray_node_does_not_repeat_the_largest_component(spark):
    import tianguis.llm.near_dedup as N

    n = 20 * N.LOT
    placed = spark.range(n + 1).selectExpr("id AS a", "7L AS key", f"IF(id = {n}, 1L, 0L) AS comp", f"{n + 1}L AS crowd", "0L AS top", f"{n}L AS top_n")
    rows = N.in_lots(placed).select("a", "i", "j", "lot").collect()
    assert len(rows) == n + 22  # each of the many once, the stray one per lot: 21 of theirs, its own
    assert all(r.i == 0 for r in rows) and {r.j for r in rows} == set(range(22))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.label: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 200: 200, 201: 200}


def orders(seed, n):
    """Sorted (tree, o1, o2) with crowded and sparse prefixes."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 3, (n, 8)) * (rng.random((n, 8)) < rng.choice([0.1, 0.5, 1.0], (n, 1)))
    values[: n // 2, :4] = rng.integers(0, 30, (n // 2, 4))
    tree = rng.integers(0, 2, n)
    rows = sorted((int(t), *map(int, v)) for t, v in zip(tree, values))
    pack = lambda v: v[0] << 48 | v[1] << 32 | v[2] << 16 | v[3]
    return rows, np.array([r[0] for r in rows]), np.array([pack(r[1:5]) for r in rows], np.int64), np.array([pack(r[5:9]) for r in rows], np.int64)


@pytest.mark.parametrize("seed", range(4))
def test_the_depth_of_a_region_follows_its_crowd(seed):
    rows, tree, o1, o2 = orders(seed, 300)
    crowd = {d: {} for d in range(SHALLOW, DEPTH + 1)}
    for r in rows:
        for d, c in crowd.items():
            c[r[: d + 1]] = c.get(r[: d + 1], 0) + 1
    for depth, (taken, key, _) in zip(crowd, regions(tree, o1, o2, False, False)):
        for r, t in zip(rows, taken):
            above = all(crowd[d][r[: d + 1]] > SPARSE for d in range(SHALLOW, depth))
            n = crowd[depth][r[: depth + 1]]
            assert t == (above and n > 1 and (n <= SPARSE or depth == DEPTH))
        assert len({(r[: depth + 1], k) for r, k, t in zip(rows, key, taken) if t}) == len({k for k, t in zip(key, taken) if t}) == len({r[: depth + 1] for r, t in zip(rows, taken) if t})
    assert any(t[0].any() for t in regions(tree, o1, o2, False, False))


@pytest.mark.parametrize("cuts", [[], [150], [10, 11, 200, 201], list(range(5, 300, 7))])
def test_rows_that_share_the_full_depth_meet_wherever_tasks_end(cuts):
    rows, tree, o1, o2 = orders(9, 300)
    found = [set() for _ in rows]
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        for taken, key, _ in regions(tree[a:b], o1[a:b], o2[a:b], True, True):
            for i in np.flatnonzero(taken):
                found[a + i].add(int(key[i]))
    for i, x in enumerate(rows):
        for j in range(i):
            if rows[j][: DEPTH + 1] == x[: DEPTH + 1]:
                assert found[i] & found[j]


def test_regions_do_not_depend_on_batches(spark, monkeypatch):
    import tianguis.llm.near_dedup as N

    _, tree, o1, o2 = orders(3, 400)
    forest = spark.createDataFrame([(int(t), int(a), int(b), i) for i, (t, a, b) in enumerate(zip(tree, o1, o2))], "tree int, o1 long, o2 long, label long").coalesce(1)
    got = {}
    for rows in (10_000, 3):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        try:
            got[rows] = sorted(map(str, neighbours(forest.sortWithinPartitions("tree", "o1", "o2", "label")).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[10_000] == got[3]
    monkeypatch.setattr(N, "GATHERED", 5)  # a run is cut: its rows meet at the full depth at least
    cut_up = N.neighbours(forest.sortWithinPartitions("tree", "o1", "o2", "label")).collect()
    assert {r.label for r in cut_up} >= {r.label for r in neighbours(forest.sortWithinPartitions("tree", "o1", "o2", "label")).collect()}
