"""Result tables and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar(agg: DataFrame):
    """The single value of a one-row, one-column aggregate (a bounded result, read eagerly)."""
    row = agg.first()
    return None if row is None else row[0]


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of several one-row aggregates, without a join: the rows are unioned
    (missing columns null) and folded by one global aggregate over those few rows."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in u.columns])


def experiments_long(per_imp: DataFrame, experiment: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric per experiment: long (experiment, metric, value, n_used)."""
    stacked = per_imp.select(F.col(experiment), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("v")) for m in metrics
    ])).alias("x")).select(experiment, "x.*")
    return stacked.groupBy(experiment, "metric").agg(F.avg("v").alias("value"), F.count("v").alias("n_used"))


def compare_experiments(*results: tuple[str, DataFrame]) -> DataFrame:
    """Union of several (metric, value) results, tagged with their experiment name."""
    out = None
    for name, df in results:
        t = df.select(F.lit(name).alias("experiment"), "metric", "value")
        out = t if out is None else out.unionByName(t)
    return out


def results_table(long: DataFrame, experiments: list[str] | None = None) -> DataFrame:
    """Metrics as rows, experiments as columns.  Passing the experiment names keeps the
    pivot to one pass (otherwise Spark first collects the distinct names)."""
    g = long.groupBy("metric")
    g = g.pivot("experiment", experiments) if experiments else g.pivot("experiment")
    return g.agg(F.first("value"))


def batch_profile(df: DataFrame) -> DataFrame:
    """(column, type, min_len, max_len) — array columns get their size range, others null.
    All sizes come from one aggregation pass."""
    aggs, fields = [], df.schema.fields
    for f in fields:
        if isinstance(f.dataType, T.ArrayType):
            aggs += [F.min(F.size(f.name)).alias(f"mn_{f.name}"), F.max(F.size(f.name)).alias(f"mx_{f.name}")]
    g = df.agg(*aggs) if aggs else df.limit(1).select(F.lit(1).alias("_one"))
    rows = []
    for f in fields:
        arr = isinstance(f.dataType, T.ArrayType)
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                             (F.col(f"mn_{f.name}") if arr else F.lit(None)).cast("long").alias("min_len"),
                             (F.col(f"mx_{f.name}") if arr else F.lit(None)).cast("long").alias("max_len")))
    return g.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
