"""Vectors in blocks of approximations, and the join of query blocks with candidate blocks.

An approximation holds one byte per component and is made once, when the blocks are written; blocks are what
the join sends. From two blocks, bounds of all their inner products follow at once. The join is a grid:
candidate blocks are dealt to ``g`` rows of cells and query blocks to ``h`` columns, each block is
sent to the cells of its row or column, and a cell compares all its pairs of blocks, with the k-th
largest lower bound so far as each query's bar. Pairs that a tile leaves are bounded again, more closely, from what
the blocks hold besides; what may then still be among the k best of a query goes on: bounds and places only. Per query the bar is set again over all cells, then exact vectors are fetched by place: first of the
best upper bounds, then of those that the k-th exact score found does not rule out. Scores are merged by heaps.

Rows that are alike in id and vector are one entry with a count. Of equal vectors only those with the
k + 1 smallest ids are candidates: no query can have another among its k best. A vector held by a
third of all rows thus costs no more than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, sqrt
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tianguis.llm.common import cut

#: Vectors of a candidate block and of a query block.
CANDIDATES = 4096
QUERIES = 512
#: Vectors of a cell, at most about: candidates, queries.
GROUP = 262_144
QUERY_GROUP = 16_384
#: Pairs that make a cell worth while, and pairs that one cell compares at most.
LEAST_PAIRS = 1 << 22
MOST_PAIRS = 1 << 31
#: Candidates of a block of queries that a cell holds before it drops those below the bar.
HELD = 1 << 20

BLOCK = "part int, block int, dim int, rows binary, ids binary, codes binary, aux binary"


class Approximation(Protocol):
    """One byte per component, and what bounds inner products with it."""

    def candidates(self, v: np.ndarray) -> tuple[bytes, bytes]:
        """Codes and further figures of a block of candidates."""

    def queries(self, v: np.ndarray) -> tuple[bytes, bytes]:
        """The same of a block of queries."""

    def bounds(self, dim: int, q: tuple[bytes, bytes], c: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all inner products (queries x candidates), none of them NaN."""

    def closer(self, dim: int, q: tuple[bytes, bytes], c: tuple[bytes, bytes], at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Closer bounds of the pairs (at, which) of a tile, or None where there are none."""

    def exact(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of pairs of vectors, row by row."""


def largest(at: np.ndarray, low: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k largest of the ``low`` of each of n queries (rows of a matrix, filled up with -inf)."""
    order = np.lexsort((-low, at))
    at, low = at[order], low[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    out = np.full((n, k), -np.inf)
    out[at[place < k], place[place < k]] = low[place < k]
    return out


def usable(vectors: DataFrame, zero_too: bool) -> DataFrame:
    """(vec_id, v): rows whose vector, as doubles, is there, is not empty and has only finite
    components, and with ``zero_too`` also those that are zero throughout."""
    v = vectors.select(F.col("vec_id").cast("long"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("v"))
    fine = "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return v.filter(fine if zero_too else f"{fine} AND exists(v, x -> x <> 0)")


def entries(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v, times): the distinct rows of ``vectors`` (vec_id, v), written, with a place of their own."""
    return cut(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("row", F.monotonically_increasing_id()), "vectors")


def in_blocks(rows: DataFrame, most: int, make) -> DataFrame:
    """Blocks of (row, vec_id, v), written; one dimension per block, approximated by ``make``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            rows = held.pop(dim)
            codes, aux = make(np.stack([v for _, _, v in rows]).astype(np.float64))
            at, ids = (np.array([r[k] for r in rows], np.int64).tobytes() for k in (0, 1))
            return pd.DataFrame({"part": [part], "block": [made], "dim": [dim], "rows": [at], "ids": [ids], "codes": [codes], "aux": [aux]})

        for b in batches:
            for r, i, v in zip(b["row"], b["vec_id"], b["v"]):
                rows = held.setdefault(len(v), [])
                rows.append((r, i, v))
                if len(rows) == most:
                    yield block(len(v))
                    made += 1
        for dim in list(held):
            yield block(dim)
            made += 1

    return cut(rows.select("row", "vec_id", "v").mapInPandas(run, BLOCK), "blocks")


def grid(queries: int, candidates: int, width: int) -> tuple[int, int]:
    """Rows and columns of cells: enough for ``width`` tasks if there is work for them, for a
    bounded number of pairs and of vectors per cell, and in the proportion that sends least."""
    pairs = queries * candidates
    tasks = max(1, min(pairs // LEAST_PAIRS, width), ceil(pairs / MOST_PAIRS))
    g = max(1, min(ceil(candidates / CANDIDATES), round(sqrt(tasks * candidates / max(1, queries)))), ceil(candidates / GROUP))
    return g, max(1, min(ceil(queries / QUERIES), ceil(tasks / g)), ceil(queries / QUERY_GROUP))


def bounded(candidates: DataFrame, queries: DataFrame, g: int, h: int, kind: Approximation, k: int) -> DataFrame:
    """(q_row, row, vec_id, low, high): per cell and query, the candidates that may be among its k best there."""

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for y in q.itertuples(index=False):
            q_rows, q_ids = np.frombuffer(y.rows, np.int64), np.frombuffer(y.ids, np.int64)
            top = np.full((len(q_ids), k), -np.inf)
            held, size = [], 0

            def above() -> list[tuple[np.ndarray, ...]]:
                """What is held and not below the bar, as one."""
                at, *rest = (np.concatenate(x) for x in zip(*held))
                keep = rest[-1] >= top.min(axis=1)[at]
                return [(at[keep], *(x[keep] for x in rest))]

            for x in c.itertuples(index=False):
                if x.dim != y.dim:
                    continue
                rows, ids = np.frombuffer(x.rows, np.int64), np.frombuffer(x.ids, np.int64)
                low, high = kind.bounds(x.dim, (y.codes, y.aux), (x.codes, x.aux))
                own = q_ids[:, None] == ids[None, :]
                low[own] = -np.inf
                best = low if len(ids) <= k else np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k :]
                bar = np.partition(np.concatenate([top, best], axis=1), best.shape[1], axis=1)[:, best.shape[1]]
                at, which = np.nonzero((high >= bar[:, None]) & ~own)
                low, high = kind.closer(x.dim, (y.codes, y.aux), (x.codes, x.aux), at, which) or (low[at, which], high[at, which])
                # each candidate counts once: by its closer bound, or not at all
                top = np.partition(np.concatenate([top, largest(at, low, len(q_ids), k)], axis=1), k, axis=1)[:, k:]
                held.append((at, rows[which], ids[which], low, high))
                size += len(at)
                if size > HELD:
                    held = above()
                    size = len(held[0][0])
            if held:
                ((at, rows, ids, low, high),) = above()
                out.append(pd.DataFrame({"q_row": q_rows[at], "row": rows, "vec_id": ids, "low": low, "high": high}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["q_row", "row", "vec_id", "low", "high"])

    def cells(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        dealt = side.withColumn(own, F.expr(f"CAST(pmod(xxhash64(part, block), {n}) AS INT)"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("g", "h")

    # the function's name and no closure cell of this module goes to the workers
    return cells(candidates, "g", g, "h", h).cogroup(cells(queries, "h", h, "g", g)).applyInPandas(lambda c, q: compare(c, q), "q_row long, row long, vec_id long, low double, high double")


def scored(pairs: DataFrame, rows: DataFrame, kind: Approximation) -> DataFrame:
    """(q_row, vec_id, times, score): the exact scores of ``pairs`` (q_row, row), by fetching the vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["v"].map(len)
            for _, f in b.groupby(dims):
                s = kind.exact(np.stack(f["q"].to_numpy()), np.stack(f["v"].to_numpy()))
                yield pd.DataFrame({"q_row": f["q_row"].to_numpy(), "vec_id": f["vec_id"].to_numpy(), "times": f["times"].to_numpy(), "score": s})

    c = rows.select("row", "vec_id", "times", "v")
    q = rows.select(F.col("row").alias("q_row"), F.col("v").alias("q"))
    return pairs.select("q_row", "row").join(c, "row").join(q, "q_row").select("q_row", "q", "vec_id", "times", "v").mapInPandas(run, "q_row long, vec_id long, times long, score double")


def best_matches(vectors: DataFrame, chosen: str, kind: Approximation, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, v) that ``chosen``
    names, its k best among all rows with another vec_id, by score, ties to smaller ids. ``score`` is the
    scores' type. Each repeated row is a candidate, and a query, of its own."""
    rows = entries(vectors)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.expr(chosen), 1)).alias("q")).first()
    g, h = grid(size["q"], size["n"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nth = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    candidates = in_blocks(rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1), CANDIDATES, kind.candidates)
    asked = rows.filter(chosen)
    queries = in_blocks(asked.repartition(max(1, ceil(size["q"] / QUERIES))), QUERIES, kind.queries)

    listed = bounded(candidates, queries, g, h, kind, k).groupBy("q_row").agg(F.sort_array(F.collect_list(F.struct("high", "low", "row")), asc=False).alias("found"))
    bar = f"CASE WHEN size(found) >= {k} THEN sort_array(transform(found, x -> x.low), false)[{k - 1}] ELSE -double('Infinity') END"
    # as a lambda's argument the bar is computed once per query, not once per candidate
    listed = cut(listed.select("q_row", F.expr(f"transform(array({bar}), b -> filter(found, x -> x.high >= b))[0]").alias("found")), "bounds")

    def fetched(pairs: DataFrame, found: str) -> DataFrame:
        return scored(pairs.select("q_row", F.explode(F.expr(found)).alias("x")).select("q_row", "x.row"), rows, kind)

    first = cut(fetched(listed, f"slice(found, 1, {2 * k})"), "first")
    kth = first.groupBy("q_row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("q_row", F.expr(f"CASE WHEN size(s) >= {k} THEN s[{k - 1}] ELSE -double('Infinity') END").alias("kth"))
    more = listed.filter(f"size(found) > {2 * k}").join(kth, "q_row")
    rest = fetched(more, f"filter(slice(found, {2 * k + 1}, size(found)), x -> x.high >= kth)")
    every = first.unionByName(rest).groupBy("q_row").agg(F.collect_list(F.struct("score", "vec_id", "times")).alias("s"))
    whole = np.dtype("int64" if score == "long" else "float64")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, copies, s in zip(b["query_id"], b["copies"], b["s"]):
                best = heapq.nsmallest(k, ((-x["score"], x["vec_id"]) for x in s for _ in range(min(x["times"], k))))
                out += [(query, r, i, -v) for _ in range(copies) for r, (v, i) in enumerate(best, 1)]
            f = pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
            yield f.assign(score=f["score"].astype(whole))

    asked = asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("times").alias("copies"))
    return every.join(asked, "q_row").select("query_id", "copies", "s").mapInPandas(merged, f"query_id long, rank int, vec_id long, score {score}")
