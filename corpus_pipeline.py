"""A corpus pipeline of four stages: toxicity, line dedup, near-dedup, packing.

``run`` applies the stages to ``documents``; each result is written as Parquet to
the shared folder and reread, so a lost executor costs no earlier stage.  The folder
of a stage is deleted once the next one is written.

Null and empty texts pass toxicity, line dedup and near-dedup and are packed as the
single end id; repeated rows lose to one of them in near-dedup, unless they have no
words; an empty table gives no rows.  All columns but the text (and ``n_chars``, which
follows it) stay as they were up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import line_dedup, neardup, packing, toxicity
from sparkloom.llm.common import delete_folder, shared_folder, table
from sparkloom.llm.queries import ADDED, PATTERN, RANKS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't call toxic.  The model is fitted on the labelled rows of ``documents``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "toxic")
    return toxicity.drop_toxic(docs, "text", model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; ``n_chars`` follows the text."""
    return line_dedup.with_char_counts(line_dedup.drop_recurring_lines(docs, "doc_id", "text"), "text", "n_chars")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs, "doc_id", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, "doc_id", "text", RANKS, PATTERN, added=ADDED)


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]

#: Tokens and a fitted model can't be had in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{k}-{name}"
    return docs
