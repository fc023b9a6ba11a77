"""Licence lines and texts by diagonal voting, in DataFrame operations only.

A document's words are cut once; each position's rolling word pair is hashed
and joined to the same pairs of the templates. A match of document position p with
template position t votes for the diagonal p - t. Votes are
counted per document, template and diagonal; diagonals that are neighbours (a word put
in or left out moves the rest of a copy by one) and whose votes follow one another are merged,
and the merged span is verified: phrases must stand whole on
one diagonal, longer templates must be covered to ``COVERAGE``.

The templates are a fixed, small table, the only side that is broadcast. Besides the
matches, one row per document goes through the join, so that documents without any
match keep their word counts. Only matches are shuffled.

A null text is empty: no words, null positions, empty labels, score 0. Repeated
rows are returned each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import table

#: Fixed phrases: a place is a whole phrase, word by word.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Longer templates of common licence notices; partial copies count from COVERAGE.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
PAIR = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Diagonals at most this far apart may belong to one copy.
DRIFT = 2
#: Share of a longer template's word pairs that a span must hold.
COVERAGE = 0.85
#: What separates words, after A-Z are lower-cased.
BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def templates(spark: SparkSession, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row per word pair of each template, plus the row (place -1) that
    every document's own row meets."""
    rows = [(-1, "", True, -1, 0, None, None)]
    for i, (label, text) in enumerate((*phrases, *notices)):
        words = text.split()
        if len(words) < PAIR:
            raise ValueError(f"a template has at least {PAIR} words: {text!r}")
        rows += [(i, label, i < len(phrases), at, len(words) - 1, *pair) for at, pair in enumerate(zip(words, words[1:]))]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, at int, pairs int, w0 string, w1 string")
    return t.withColumn("gram", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("w0", "w1")))


def word_places(docs: DataFrame) -> DataFrame:
    """(row, doc_id, w, n_words): a document's words, with A-Z and nothing else lower-cased."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    w = F.array_remove(F.expr(f"split(t, '{BETWEEN}')"), "")
    return docs.select("doc_id", text.alias("t")).select(F.monotonically_increasing_id().alias("row"), "doc_id", w.alias("w")).withColumn("n_words", F.size("w"))


def license_matches(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """One row per place found, and one (template -1) per row of ``docs``:
    row, doc_id, n_words, template, label, base, first, last (word positions, last exclusive), coverage."""
    spark = docs.sparkSession
    t = F.broadcast(templates(spark, phrases, notices))
    # A whole array column is repeated on every row that explode makes; only the two words and the counts go on.
    at = word_places(docs).select("row", "doc_id", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - PAIR, F.lit(-1)))).alias("p"))
    at = at.select("row", "doc_id", "n_words", "p", F.expr("CASE WHEN p >= 0 THEN w[p] END").alias("x0"), F.expr("CASE WHEN p >= 0 THEN w[p + 1] END").alias("x1"))
    at = at.withColumn("gram", F.when(F.col("p") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("x0", "x1")))
    votes = at.join(t, "gram").filter("(p < 0 AND at < 0) OR (p >= 0 AND at >= 0 AND x0 = w0 AND x1 = w1)")

    key = ["row", "doc_id", "n_words", "template", "label", "base", "pairs"]
    diagonals = votes.withColumn("diagonal", F.expr("p - at")).groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.min("at").alias("t_lo"), F.max("at").alias("t_hi"))
    # A diagonal continues the one before it (in document order) if it is near and goes on further in the
    # template. Each diagonal of a phrase stands for itself.
    by = "PARTITION BY row, template ORDER BY lo, diagonal"
    run = f"""NOT base AND diagonal - lag(diagonal) OVER ({by}) BETWEEN -{DRIFT} AND {DRIFT}
              AND t_lo > lag(t_hi) OVER ({by}) AND lo - lag(hi) OVER ({by}) <= {DRIFT} + 1 + t_lo - lag(t_hi) OVER ({by})"""
    linked = diagonals.withColumn("new", F.expr(f"CASE WHEN {run} THEN 0 ELSE 1 END"))
    spans = linked.withColumn("span", F.expr(f"sum(new) OVER ({by} ROWS UNBOUNDED PRECEDING)")).groupBy(*key, "span").agg(F.sum("votes").alias("votes"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    covered = F.when(F.col("template") < 0, 0.0).otherwise(F.least(F.col("votes") / F.col("pairs"), F.lit(1.0)))
    verified = F.expr(f"template < 0 OR (base AND votes = pairs) OR (NOT base AND coverage >= {COVERAGE})")
    return spans.withColumn("coverage", covered).filter(verified).select("row", "doc_id", "n_words", "template", "label", "base", "first", F.expr("last + 2").alias("last"), "coverage")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    place = F.col("base") & (F.col("template") >= 0)
    is_label = F.col("template") >= 0

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return found.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("first"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"),
        joined(is_label).alias("labels"),
        F.coalesce(F.max(F.when(is_label, F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).drop("row")


def _listed(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> str:
    """The templates as SQL rows."""
    return ", ".join(f"({i}, '{label}', {i < len(phrases)}, '{text}')" for i, (label, text) in enumerate((*phrases, *notices)))


ORACLE = rf"""
WITH given AS (SELECT * FROM (VALUES {_listed(PHRASES, NOTICES)}) AS x(template, label, base, text)),
told AS (SELECT *, string_split(text, ' ') AS t, len(string_split(text, ' ')) - 1 AS pairs FROM given),
doc AS (
  SELECT row_number() OVER () AS row, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), place AS (
  SELECT row, template, label, p FROM (SELECT row, w, unnest(range(len(w))) AS p FROM doc) JOIN told ON base AND w[p + 1] = t[1] AND w[p + 1:p + len(t)] = t
), by_base AS (
  SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY row
), vote AS (
  SELECT row, template, label, pairs, p, k FROM (SELECT row, w, unnest(range(len(w) - 1)) AS p FROM doc)
  JOIN (SELECT *, unnest(range(pairs)) AS k FROM told WHERE NOT base) ON w[p + 1] = t[k + 1] AND w[p + 2] = t[k + 2]
), diagonal AS (
  SELECT row, template, label, pairs, p - k AS d, count(*) AS votes, min(p) AS lo, max(p) AS hi, min(k) AS k_lo, max(k) AS k_hi FROM vote GROUP BY ALL
), step AS (
  SELECT *, NOT coalesce(d - lag(d) OVER o BETWEEN -{DRIFT} AND {DRIFT} AND k_lo > lag(k_hi) OVER o
                         AND lo - lag(hi) OVER o <= {DRIFT + 1} + k_lo - lag(k_hi) OVER o, false) AS fresh
  FROM diagonal WINDOW o AS (PARTITION BY row, template ORDER BY lo, d)
), span AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY row, template ORDER BY lo, d) AS span FROM step
), found AS (
  SELECT row, label, least(sum(votes)::DOUBLE / any_value(pairs)::DOUBLE, 1.0) AS coverage FROM span GROUP BY row, template, label, span HAVING coverage >= {COVERAGE}
  UNION ALL SELECT row, label, 1.0 FROM place
), by_label AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM doc LEFT JOIN by_base USING (row) LEFT JOIN by_label USING (row)
"""
