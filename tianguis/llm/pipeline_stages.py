"""The stages of the corpus pipeline, each from documents to documents (the last to packed pieces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm.common import cut
from tianguis.llm.language import UNDETERMINED, determined, least_confidence, profiles
from tianguis.llm.near_dedup import near_duplicates
from tianguis.llm.packing import pack
from tianguis.llm.pii import Field, counts, redact

#: Half of the pieces that a worker remembers while packing: fewer than in a query of its own, as executors have grown in the stages before.
REMEMBERED = 125_000


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the profiles can tell: null texts, texts without a letter and those whose
    best cosine is no better than chance (random letters, scripts not learned, a letter or two) go, but no more
    than one in a thousand of the labelled documents that are told right. All labelled documents are learned from;
    where there are none, every text with a letter stays."""
    labelled = docs.filter(F.col("lang") != UNDETERMINED)
    learned = profiles(labelled)
    return determined(docs, learned, least_confidence(labelled, learned) if learned else 0.0)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity of 0.8 or
    more): the one with the smallest id, null ids last. Rows are told apart by a key of their own, so
    repeated and null ids take part like any other."""
    keyed = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    kept = found.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first).select("first._row")
    return keyed.join(kept, "_row", "left_semi").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced by kinds."""
    return redact(docs, Field(counts(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing query returns them."""
    return pack(docs, remembered=REMEMBERED)
