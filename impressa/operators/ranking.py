"""Ranking windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators.metrics import rank_candidates  # noqa: F401  (W1)


def top_k(scored: DataFrame, k: int, by: str = "imp_id", score: str = "score", pos: str = "pos") -> DataFrame:
    """The k best candidates per group (k = min(k, n)); the rank filter lets Spark insert a
    partial per-group limit before the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(pos))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_n_report(scored: DataFrame, news: DataFrame, n: int, detail_cols: list[str]) -> DataFrame:
    """W3 + J8: top-n candidates of each impression with their item details (n >= 1 enforced)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    t = top_k(scored, n)
    return t.join(news.select("news_id", *detail_cols), "news_id").select(
        "imp_id", "rank", "news_id", *detail_cols, "label", "score")


def best_k_runs(log: DataFrame, metric: str, k: int = 3, mode: str = "max",
                run: str = "run", step: str = "epoch") -> DataFrame:
    """The k best epochs of each run by a monitored metric (checkpoint selection).

    ``log`` is long (run, epoch, metric, value)."""
    m = log.where(F.col("metric") == metric)
    order = F.desc("value") if mode == "max" else F.asc("value")
    w = Window.partitionBy(run).orderBy(order, F.asc(step))
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def early_stop_epoch(log: DataFrame, metric: str, patience: int = 5, min_delta: float = 1e-4,
                     mode: str = "max", run: str = "run", step: str = "epoch") -> DataFrame:
    """The epoch at which early stopping fires (or the last epoch), per run, plus the epoch
    of the last improvement.

    An epoch improves when it beats the best *recorded* value by more than ``min_delta`` (the
    best is only updated on improvement); stopping fires once ``patience`` epochs in a row did
    not improve.  This is a sequential fold, run with ``aggregate`` over the run's epochs in
    order — one short list per run (runs have at most a few hundred epochs).
    """
    sign = 1.0 if mode == "max" else -1.0
    m = log.where(F.col("metric") == metric).select(run, F.struct(F.col(step).cast("long").alias("e"),
                                                                  (F.col("value").cast("double") * sign).alias("v")).alias("x"))
    g = m.groupBy(run).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_e"),
                    F.lit(0).cast("long").alias("wait"), F.lit(None).cast("long").alias("stop"))

    def step_fn(acc, x):
        improved = acc["best"].isNull() | (x["v"] > acc["best"] + F.lit(min_delta))
        wait = F.when(improved, F.lit(0).cast("long")).otherwise(acc["wait"] + 1)
        nxt = F.struct(F.when(improved, x["v"]).otherwise(acc["best"]).alias("best"),
                       F.when(improved, x["e"]).otherwise(acc["best_e"]).alias("best_e"),
                       wait.alias("wait"),
                       F.when(wait >= patience, x["e"]).otherwise(F.lit(None).cast("long")).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(nxt)

    folded = g.select(run, F.aggregate("xs", init, step_fn).alias("s"), F.element_at("xs", -1)["e"].alias("last"))
    return folded.select(run, F.coalesce(F.col("s.stop"), F.col("last")).alias("stop_epoch"),
                         F.col("s.best_e").alias("best_epoch"), F.col("s.stop").isNotNull().alias("stopped_early"))


def union_ids(*dfs: DataFrame, col: str = "news_id") -> DataFrame:
    """Distinct ids over several sources."""
    out = None
    for d in dfs:
        s = d.select(col)
        out = s if out is None else out.unionByName(s)
    return out.distinct()


def dedupe_list(col) -> F.Column:
    """U2 on an array column."""
    return F.array_distinct(F.col(col) if isinstance(col, str) else col)


def new_keys(candidates: DataFrame, existing: DataFrame, col: str = "key") -> DataFrame:
    """Keys not yet in a dictionary (anti-join)."""
    return candidates.select(col).distinct().join(existing.select(col), col, "left_anti")
