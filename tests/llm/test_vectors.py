"""Both vector searches equal comparing all pairs."""

import random
from fractions import Fraction
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from tianguis.llm import ann, blocks, vafile


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def vectors(seed, n=260, dim=7):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[4][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1020, []), (1040, [0.0] * dim), (1060, [nan] * dim), (1100, [inf] + [0.0] * (dim - 1)), (1120, [None] * dim), (1140, [1.0, 2.0]), (1160, [2.0, 1.0]), (1150, [1.0, -1.0]), (None, [1.0] * dim)]
    rows.append(rows[20])  # a repeated row, a query of its own
    return rows


def brute(rows, modulus, k, score, zeros):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and isfinite(x) for x in v) and (zeros or any(v))]
    out = []
    for q, x in good:
        if q % modulus == 0:
            found = sorted((-score(x, y), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def sequential(x, y):
    s = 0.0
    for a, b in zip(x, y):
        s += a * b
    return s


@pytest.fixture(params=[(262144, 4096, 512, 1 << 22), (64, 32, 8, 1)])
def sizes(request, monkeypatch):
    for name, value in zip(("GROUP", "CANDIDATES", "QUERIES", "LEAST_PAIRS"), request.param):
        monkeypatch.setattr(blocks, name, value)
    if request.param[0] == 64:
        monkeypatch.setattr(blocks, "HELD", 50)


def test_nearest(spark, sizes):
    rows = vectors(1)
    got = sorted(map(tuple, ann.nearest(table(spark, rows), "vec_id % 20 = 0", 5).collect()))
    assert got == brute(rows, 20, 5, sequential, zeros=False)


@pytest.mark.parametrize("scale", [1, 300])
def test_top_k(spark, sizes, scale):
    """With components over a wide range a cell holds several values."""
    rows = [(i, [x * scale if x is not None else None for x in v] if v is not None else None) for i, v in vectors(2)]
    whole = lambda x, y: sum(floor(Fraction(float(np.float32(a))) * 256) * floor(Fraction(float(np.float32(b))) * 256) for a, b in zip(x, y))
    got = sorted(map(tuple, vafile.top_k(table(spark, rows), "vec_id % 50 = 0", 5).collect()))
    assert got == brute(rows, 50, 5, whole, zeros=True)


def test_a_common_vector(spark):
    """One vector on a third of all rows, with ids and rows repeated, and copies a hair apart."""
    rows = vectors(8, 90)
    rows += [(2000 + i, [1.0] * 7) for i in range(70)] + [(2020, [1.0] * 7)] * 30 + [(3000 + i, [1.0] * 6 + [1.0 + i * 1e-6]) for i in range(40)]
    got = sorted(map(tuple, ann.nearest(table(spark, rows), "vec_id % 20 = 0", 5).collect()))
    assert got == brute([(i, [float(np.float32(x)) for x in v] if v and None not in v else v) for i, v in rows], 20, 5, sequential, zeros=False)


def test_few_candidates_and_empty_table(spark):
    few = table(spark, [(0, [1.0, 2.0]), (20, [0.5, 0.5])])
    assert [tuple(r)[:3] for r in ann.nearest(few, "vec_id % 20 = 0", 5).orderBy("query_id").collect()] == [(0, 1, 20), (20, 1, 0)]
    assert ann.nearest(few.limit(0), "vec_id % 20 = 0").count() == 0 and vafile.top_k(few.limit(0), "vec_id % 50 = 0").count() == 0
    assert ann.nearest(few, "vec_id = 7").count() == 0


def test_blocks_are_written_once_and_hold_bytes(spark):
    """What the join sends are codes of one byte per component; read again in another order the blocks are the same."""
    rows = blocks.entries(blocks.usable(table(spark, [(i, [float(i), 1.0]) for i in range(400)]), True))
    for kind in (ann.Int8(), vafile.Cells()):
        made = blocks.in_blocks(rows, 64, kind.candidates)
        once, again = (sorted((r.part, r.block, bytes(r.ids), bytes(r.codes)) for r in made.collect()) for _ in range(2))
        assert once == again and sum(len(c) for *_, c in once) == 400 * 2 * (2 if isinstance(kind, ann.Int8) else 1)
    found = ann.nearest(table(spark, vectors(5)), "vec_id % 20 = 0", 5)
    assert "Repartition" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_the_grid():
    for q, c, width in [(1, 1, 8), (10**3, 5 * 10**4, 200), (5 * 10**6, 10**8, 16000), (0, 0, 8), (10**6, 10, 64)]:
        g, h = blocks.grid(q, c, width)
        assert g >= 1 and h >= 1 and c / g <= blocks.GROUP * 1.01 and q / h <= blocks.QUERY_GROUP * 1.01
        assert q * c / (g * h) <= blocks.MOST_PAIRS * 1.5


@pytest.mark.parametrize("kind", [ann.Int8(), vafile.Cells()])
@pytest.mark.parametrize("scale", [1e-20, 1.0, 1e4, 1e15, 1e300])
def test_bounds_hold(kind, scale):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(20, 33)) * scale, rng.standard_t(2, size=(300, 33)) * 500
    if isinstance(kind, vafile.Cells):
        q, c = np.floor(q), np.floor(c * min(scale, 1e15))
    low, high = kind.bounds(33, kind.queries(q), kind.candidates(c))
    with np.errstate(over="ignore", invalid="ignore"):
        exact = np.stack([kind.exact(np.repeat(q[i : i + 1], 300, 0), c) for i in range(20)])
    fine = np.isfinite(exact)
    assert fine.any() or scale == 1e300  # where sums overflow on the way there is no score to bound
    assert (low <= exact)[fine].all() and (exact <= high)[fine].all() and not np.isnan(low).any() and not np.isnan(high).any()


def test_closer_bounds_hold():
    rng = np.random.default_rng(5)
    kind = ann.Int8()
    for scale in (1e-20, 1.0, 1e15):
        q, c = rng.normal(size=(20, 65)) * scale, rng.standard_t(2, size=(300, 65))
        at, which = (x.ravel() for x in np.meshgrid(range(20), range(300), indexing="ij"))
        packed = kind.queries(q), kind.candidates(c)
        low, high = kind.closer(65, *packed, at, which)
        wide_low, wide_high = kind.bounds(65, *packed)
        exact = kind.exact(q[at], c[which])
        assert (low <= exact).all() and (exact <= high).all()
        assert ((high - low) * 100 < (wide_high - wide_low)[at, which]).all()


def test_largest_lower_bounds():
    at, low = np.array([2, 0, 2, 2, 0, 2]), np.array([1.0, 5.0, 3.0, 2.0, 7.0, 0.0])
    assert [sorted(r) for r in blocks.largest(at, low, 3, 3).tolist()] == [[-inf, 5, 7], [-inf] * 3, [1, 2, 3]]


def test_cells_of_small_numbers_are_exact():
    rng = np.random.default_rng(4)
    c, q = np.floor(rng.uniform(-120, 120, size=(500, 9))), np.floor(rng.normal(size=(7, 9)) * 256)
    low, high = vafile.Cells().bounds(9, vafile.Cells().queries(q), vafile.Cells().candidates(c))
    assert np.allclose(low, q @ c.T, rtol=1e-9, atol=1e-3) and np.allclose(low, high, rtol=1e-9, atol=1e-3)
