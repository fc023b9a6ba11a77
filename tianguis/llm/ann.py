"""Nearest neighbours by a block matrix join with quantised products.

Vectors are scaled to int8, one scale each, once per block; the blocks of int8 values are what the join sends.
A tile's int8 products (exact in
single precision, as they stay below 2**24) give every inner product within an
error bound known from the two scales. A candidate whose upper bound is below the query's
k-th largest lower bound cannot be among its k nearest. For the pairs that a tile leaves, a second int8 value
per component, the rest of the first in 254ths of its scale, narrows the bounds as much. What is left then is
fetched, computed again in double precision and merged by heaps. The
bounds make the result exact: recall is 1.

Vectors that are null, empty, zero, or hold null or non-finite components take no part.
Vectors of another dimension than the query's are no candidates. Repeated rows
are candidates and queries of their own; a query's own row is every row with its vec_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tianguis.llm.blocks import best_matches, usable
from tianguis.llm.common import table

#: Components whose int8 products sum below 2**24.
EXACT_DIMENSIONS = 1024
#: Steps of the second int8 value to one of the first.
FINER = 254
#: Pairs bounded again at a time.
CHUNK = 1 << 16


class Int8:
    """Components as int8 multiples of a scale per vector, then what is left of them as int8 multiples of
    1/254 of it; further figures: the scales and the sums of absolute values."""

    def candidates(self, v: np.ndarray) -> tuple[bytes, bytes]:
        scale = np.abs(v).max(axis=1) / 127
        unit = np.where(scale > 0, scale, 1)[:, None]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            first = np.clip(np.rint(v / unit), -127, 127)
            rest = np.clip(np.nan_to_num(np.rint((v - first * unit) / (unit / FINER))), -127, 127)
            total = np.abs(v).sum(axis=1)
        return first.astype(np.int8).tobytes() + rest.astype(np.int8).tobytes(), np.stack([scale, total]).tobytes()

    queries = candidates

    def bounds(self, dim: int, q: tuple[bytes, bytes], c: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        (a, (sa, ta)), (b, (sb, tb)) = ((np.frombuffer(codes, np.int8).reshape(2, -1, dim)[0].astype(np.float32), np.frombuffer(aux).reshape(2, -1)) for codes, aux in (q, c))
        product = np.zeros((len(a), len(b)))
        for j in range(0, dim, EXACT_DIMENSIONS):
            product += a[:, j : j + EXACT_DIMENSIONS] @ b[:, j : j + EXACT_DIMENSIONS].T
        with np.errstate(over="ignore", invalid="ignore"):
            near = product * sa[:, None] * sb[None, :]
            # |q.c - near| <= sum |q| err(c) + sum |c| err(q) + dim err(q) err(c), err being half a scale; a little more for rounding.
            error = (ta[:, None] * sb[None, :] + sa[:, None] * tb[None, :]) * 0.5 + dim * 0.25 * sa[:, None] * sb[None, :]
            error = error * (1 + 1e-6) + np.abs(near) * 1e-12
            low, high = near - error, near + error
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def closer(self, dim: int, q: tuple[bytes, bytes], c: tuple[bytes, bytes], at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, (sa, ta)), (b, (sb, tb)) = ((np.frombuffer(codes, np.int8).reshape(2, -1, dim), np.frombuffer(aux).reshape(2, -1)) for codes, aux in (q, c))
        low, high = np.empty(len(at)), np.empty(len(at))
        for i in range(0, len(at), CHUNK):
            x, y = at[i : i + CHUNK], which[i : i + CHUNK]
            with np.errstate(over="ignore", invalid="ignore"):
                p, r = ((m[0][k] + m[1][k] / FINER) * s[k][:, None] for m, s, k in ((a, sa, x), (b, sb, y)))
                near, fa, fb = (p * r).sum(axis=1), sa[x] / FINER, sb[y] / FINER
                error = (ta[x] * fb + fa * tb[y]) * 0.5 + dim * 0.25 * fa * fb
                error = error * (1 + 1e-6) + (ta[x] * sb[y] * 127 + np.abs(near)) * 1e-12  # the rest for rounding
                low[i : i + CHUNK], high[i : i + CHUNK] = near - error, near + error
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def exact(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Row-wise inner products, added from the first component to the last."""
        out = np.zeros(len(q))
        with np.errstate(over="ignore", invalid="ignore"):
            for j in range(q.shape[1]):
                out += q[:, j] * c[:, j]
        return out


def nearest(vectors: DataFrame, chosen: str, k: int = 20) -> DataFrame:
    """The k nearest of the rows that ``chosen`` names: query_id, rank, vec_id, score."""
    return best_matches(usable(vectors, zero_too=False), chosen, Int8(), k, "double")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
