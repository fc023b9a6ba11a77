"""Exact top-k by vector-approximation files.

The table of integer vectors gets a file of approximations, written once: per block of vectors and dimension, the cell
(one of ``CELLS``, of equal width over the block) that holds the component, one byte each. A query scans the
cells first: a component lies between its cell's edges, so the sum of q * (edge + cell * width) over the
dimensions, one product of matrices, bounds the score from both sides, with the widths as the gap. Exact
vectors are then read in the order of the bounds, best first: twice k of them, then those that the k-th
exact score does not rule out, which makes the k-th result certain.

Larger products are better here, so the lower-bound order of distances is the
upper-bound order of scores. Ties go on: a candidate whose bound equals the k-th score is still read.

Vectors that are null, empty, or hold null or non-finite components take no part; those
of another dimension than the query's are no candidates. Components stay exact as
long as scores are below 2**53; beyond, scores saturate at the largest long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.blocks import best_matches, usable
from tianguis.llm.common import table

CELLS = 256
SCALE = 256
LARGEST = (1 << 63) - 1024


class Cells:
    """Cells of a block's candidates, with the lowest edge and the width per dimension; queries as they are."""

    def candidates(self, v: np.ndarray) -> tuple[bytes, bytes]:
        low, high = v.min(axis=0), v.max(axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            width = np.maximum(np.ceil((high - low + 1) / CELLS), 1)
            cell = np.floor((v - low) / width)
        return np.clip(np.nan_to_num(cell), 0, CELLS - 1).astype(np.uint8).tobytes(), np.stack([low, width]).tobytes()

    def queries(self, v: np.ndarray) -> tuple[bytes, bytes]:
        return v.tobytes(), b""

    def bounds(self, dim: int, q: tuple[bytes, bytes], c: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        v, (low, width) = np.frombuffer(q[0]).reshape(-1, dim), np.frombuffer(c[1]).reshape(2, dim)
        cell = np.frombuffer(c[0], np.uint8).reshape(-1, dim).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            near = (v * width) @ cell.T + (v @ low)[:, None]
            slack = 1e-12 * (np.abs(v) @ (np.abs(low) + CELLS * width))
            slack[~np.isfinite(slack)] = np.inf  # sums may overflow on the way: no bound
            near[np.isinf(slack)] = 0
            least = near + (np.minimum(v, 0) @ (width - 1) - slack)[:, None]
            most = near + (np.maximum(v, 0) @ (width - 1) + slack)[:, None]
        # scores saturate, so their bounds do
        return np.clip(np.nan_to_num(least, nan=-LARGEST), -LARGEST, LARGEST), np.clip(np.nan_to_num(most, nan=LARGEST), -LARGEST, LARGEST)

    def closer(self, dim: int, q: tuple[bytes, bytes], c: tuple[bytes, bytes], at: np.ndarray, which: np.ndarray) -> None:
        return None

    def exact(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of whole numbers held as doubles: sums below 2**53 are exact in any order."""
        with np.errstate(over="ignore", invalid="ignore"):
            s = (q * c).sum(axis=1)
        return np.where(np.abs(s) < LARGEST, s, np.sign(s) * LARGEST)


def top_k(vectors: DataFrame, chosen: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest integer products."""
    whole = usable(vectors, zero_too=True).select("vec_id", F.expr(f"transform(v, x -> CAST(floor({SCALE} * x) AS DOUBLE))").alias("v"))
    return best_matches(whole, chosen, Cells(), k, "long")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
