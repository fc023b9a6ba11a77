"""Mixing sources to target weights by systematic sampling.

Sources get shares of all words by weight; no source is taken more than ``MOST`` times over, and what
that leaves is shared out again by weight among the others until none is above. Within a
source every document expects target / source size copies. The documents of a source stand in
one order; the prefix sum of expected copies, plus one random offset per source, crosses integers,
and a document is taken once for each integer that its own step crosses.

The order is by size, then by a hash of the id. With documents of one size side by side, the
words taken differ from the target by less than the source's largest document: the
running count of copies is never off by one, and sizes only grow along the order. Of ``DRAWS``
random offsets each source keeps the one whose words come nearest its target, which matters where a
few long documents make up a source.

The order is made by a range sort over all sources, so a source that holds a third of all documents
lies in many tasks. A document's rank is its place within its task plus the counts of the tasks
before, of which there is one row per task and source. Ranks, copies and sums are exact decimals.

A null text or one without words has size 0; it expects copies like any other document and adds no
words. A null source is a source of its own, the last one. With no words at all every target is 0. Null
ids and repeated rows are documents each; equal rows may swap their copies, which no one can
see. Reruns agree, whatever the partitioning: the offsets are hashes of ``seed`` and their number.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tianguis.llm.common import cut, table

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MOST = 3
SEED = "mix"
WORDS = r"[^\x20\x09-\x0D]+"
#: Random offsets that a source chooses from.
DRAWS = 64
#: Copies are counted in units of 1 / UNIT. Ranks up to 10**16 have exact products with a step.
UNIT = 10**15
RANK, STEP, PRODUCT = "decimal(17,0)", "decimal(19,0)", "decimal(37,0)"


def source_key(source: Column) -> Column:
    """A key that sorts as sources do, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def levels(sources: DataFrame, weights: tuple[int, ...], most: int) -> tuple[int, int]:
    """The share of one unit of weight as (numerator, denominator), once the excess of sources at
    their limit is shared out: each round adds up the limits of those above it (they stay there, as the
    share only grows) and shares the rest by weight. One row a round comes to the driver."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("decimal(38,0)").alias("t")).first()["t"]
    num, den = 0, 1
    while True:
        above = F.lit(most).cast("decimal(30,0)") * F.col("source_size") * F.lit(den) < F.col("weight") * F.lit(num)
        r = sources.agg(F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("s"),
                        F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w")).first()
        rest, weight = int(total) - most * int(r["s"] or 0), int(r["w"] or 0)
        if not weight or (rest, weight) == (num, den):
            return num, den
        num, den = rest, weight


def offsets(seed: str) -> list[int]:
    """Random offsets between 0 and 1, in units."""
    return [int(hashlib.md5(f"{seed}/offset:{k}".encode()).hexdigest()[:12], 16) * UNIT >> 48 for k in range(DRAWS)]


def numbered(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """``sources`` with ``nth``, from 0 in the order of the sources. Rows were sorted by source, so sources
    are counted per task in which they start, then over the tasks."""
    first = runs.groupBy("_source").agg(F.min("_first").alias("_start")).withColumn("_in", F.shiftright("_start", 33))
    tasks = first.groupBy("_in").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("_in", before.alias("_before"))
    nth = F.col("_before") + F.row_number().over(W.partitionBy("_in").orderBy("_start")) - 1
    return sources.join(first.join(tasks, "_in").select("_source", nth.alias("nth")), "_source")


def planned(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, the columns ``keep``, size,
    source_size, target (of the source), copies, taken (words, repeats counted)."""
    spark = docs.sparkSession
    kept = F.struct(F.lit(0).alias("_"), *keep).alias("_kept")
    rows = docs.select("doc_id", kept, F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
                       source_key(F.col("source").cast("string")).alias("_source"), F.monotonically_increasing_id().alias("_row"))
    order = ["_source", "size", "_mixed", "doc_id", "_row"]
    rows = rows.withColumn("_mixed", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.select("doc_id", "_kept", "size", "_source", "_at"), "mix-order").withColumn("_task", F.shiftright("_at", 33))

    # one row per task and source: where it starts, how many documents and words it holds
    runs = cut(placed.groupBy("_source", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_words")), "mix-runs")
    sources = numbered(runs.groupBy("_source").agg(F.sum("_words").cast("long").alias("source_size")), runs)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = cut(sources.select("_source", "source_size", weight.cast("decimal(10,0)").alias("weight")), "mix-sources")
    num, den = levels(sources, weights, most)

    limit = F.lit(most).cast("decimal(30,0)") * F.col("source_size")
    share = F.col("weight") * F.lit(num).cast("decimal(28,0)")
    target = F.when(limit * F.lit(den) < share, limit.cast("double")).otherwise(share.cast("double") / F.lit(float(den)))
    each = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    step = F.least(F.floor(F.lit(float(UNIT)) * each), F.lit(most * UNIT)).cast(STEP)
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_source").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).join(sources.withColumn("target", target).withColumn("_step", step), "_source")
    runs = runs.select("_source", "_task", (F.col("_before") - F.col("_first")).alias("_shift"), "source_size", "target", "_step")

    def reached(at: Column) -> Column:
        """Expected copies of the first ``at`` documents, in units."""
        return (at.cast(RANK) * F.col("_step")).cast(PRODUCT)

    unit = F.lit(UNIT).cast("decimal(16,0)")
    rank = F.col("_at") + F.col("_shift")
    ranked = placed.join(runs, ["_source", "_task"]).withColumns({"_from": reached(rank), "_to": reached(rank + 1)}).select(
        "doc_id", "_kept", "size", "_source", "source_size", "target",
        (F.floor(F.col("_to") / unit) - F.floor(F.col("_from") / unit)).cast("long").alias("_whole"),
        (F.col("_from") % unit).cast("long").alias("_from"), (F.col("_to") % unit).cast("long").alias("_to"))

    def copies(offset: Column | int) -> Column:
        """Integers crossed from ``_from`` to ``_to`` when all prefix sums start at ``offset``."""
        return F.col("_whole") + (F.col("_to") + offset >= UNIT).cast("long") - (F.col("_from") + offset >= UNIT).cast("long")

    draws = offsets(seed)
    tried = ranked.groupBy("_source").agg(F.max("target").alias("_target"), *[F.sum(F.col("size") * copies(u)).alias(f"_{k}") for k, u in enumerate(draws)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("_target")).alias("off"), F.lit(k).alias("k"), F.lit(u).alias("offset")) for k, u in enumerate(draws)]))
    chosen = cut(tried.select("_source", best["offset"].alias("_offset")), "mix-offsets")
    out = ranked.join(chosen, "_source").withColumn("copies", copies(F.col("_offset")))
    return out.select("doc_id", *[F.col("_kept")[c].alias(c) for c in keep], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Its copies are told apart by
    ``copy``, from 1 (a column of that name, or named as the plan's columns, gives way)."""
    own = tuple(c for c in docs.columns if c != "doc_id" and c not in ("size", "source_size", "target", "copies", "taken", "copy"))
    plan = planned(docs, own, weights, most, seed).filter("copies > 0")
    return plan.select("doc_id", *own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce('a' || source, 'b') AS source,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS mixed
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS size, 3 * sum(size)::HUGEINT AS most,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source) - 1) % 3]::HUGEINT AS weight
  FROM d GROUP BY source
), by_need AS (
  SELECT *, sum(most) OVER before AS gone, sum(weight) OVER before AS weighed, sum(size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM s WINDOW before AS (ORDER BY most::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, most * (all_weight - coalesce(weighed, 0))::HUGEINT < weight * (total - coalesce(gone, 0))::HUGEINT AS full_up FROM by_need
), level AS (
  SELECT any_value(total)::HUGEINT - coalesce(sum(most) FILTER (WHERE full_up), 0)::HUGEINT AS num,
         coalesce(sum(weight) FILTER (WHERE NOT full_up), 1)::HUGEINT AS den
  FROM settled
), t AS (
  SELECT source, size AS source_size, CASE WHEN full_up THEN most::DOUBLE ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target
  FROM settled, level
), r AS (
  SELECT d.doc_id, d.size, source, source_size, target,
         least(coalesce(floor(1e15 * (target / nullif(source_size::DOUBLE, 0))), 0)::HUGEINT, 3000000000000000::HUGEINT) AS step,
         row_number() OVER (PARTITION BY source ORDER BY d.size, mixed, d.doc_id NULLS FIRST)::HUGEINT AS place
  FROM d JOIN t USING (source)
), draw AS (
  SELECT k, ('0x' || md5('mix/offset:' || k)[1:12])::HUGEINT * 1000000000000000 // 281474976710656 AS start FROM range(64) AS x(k)
), tries AS (
  SELECT doc_id, size, source, source_size, target, k,
         size * ((place * step + start) // 1000000000000000 - ((place - 1) * step + start) // 1000000000000000) AS taken
  FROM r, draw
), best AS (
  SELECT source, arg_min(k, (off, k)) AS k FROM (SELECT source, k, abs(sum(taken)::DOUBLE - any_value(target)) AS off FROM tries GROUP BY source, k) GROUP BY source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, taken::BIGINT AS taken FROM tries JOIN best USING (source, k)
"""
