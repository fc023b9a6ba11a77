"""Training-corpus pipeline over ``documents``: language identification, near
duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read back as the next stage's docs. ``run`` does so in the
cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tianguis.llm.common import cut, outside, scratch, table
from tianguis.llm.pipeline_stages import keep_identified, keep_one_of_each, packed, redact_personal_data

STAGES = [
    ("language", keep_identified),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_personal_data),
    ("packing", packed),
]

#: SQL can express none of the four methods; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written before the next stage reads it; what a stage writes in between
    is removed then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark, name):
            made = stage(spark, docs, sf_dir)
            with outside():
                docs = cut(made, f"stage-{name}")
    return docs
