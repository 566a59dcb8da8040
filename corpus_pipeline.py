"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token ids.

``STAGES`` lists (name, function) pairs.  Each function takes (spark, docs, sf_dir) and returns a
DataFrame that the caller writes as Parquet and reads again as the next stage's ``docs``; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from impressa.llm.decontaminate import decontaminate
from impressa.llm.mixture import mixed_documents
from impressa.llm.quality_rules import quality_rules
from impressa.llm.registry import table
from impressa.llm.setsketch import drop_near_duplicates
from impressa.llm.tokens import token_digest
from impressa.session import ensure_checkpoint_dir


SIMILAR = 80  # percent of shared word shingles from which the stage takes texts as copies; op7 has 85


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, SIMILAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digest(spark, docs)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("token ids", token_ids),
]

# Components, templates and token ids cannot be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
