"""Evaluation plans: scorers plugged into the metric bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.functions.scalar import hash_uniform
from impressa.operators import metrics as M


def random_scores(candidates: DataFrame, seed: int | None = None) -> DataFrame:
    """A uniform score per (impression, item) from md5 — reproducible in any engine."""
    parts = ([F.lit(str(seed))] if seed is not None else []) + [F.col("imp_id"), F.col("news_id")]
    return candidates.withColumn("score", hash_uniform(*parts))


def both_classes(candidates: DataFrame) -> DataFrame:
    """Impressions with at least one click and one non-click (where every performance metric exists)."""
    g = candidates.groupBy("imp_id").agg(F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_n"))
    keep = g.where((F.col("_p") > 0) & (F.col("_p") < F.col("_n"))).select("imp_id")
    return candidates.join(keep, "imp_id", "left_semi")


def random_baseline(candidates: DataFrame, news=None, history=None, senti_cols=(), ks=(5, 10),
                    max_history: int = 50) -> DataFrame:
    """Evaluate the random ranker (performance bundle, plus diversity when news is given)."""
    return M.evaluate(random_scores(candidates), news, history, senti_cols, ks, max_history)
