"""Dataset profiles: length, time and survival distributions.

Each distribution is a grouped count (partial aggregation before the shuffle); the share and
dense-fill steps run on the aggregated table, whose size is the number of distinct lengths or
bins, never the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.functions.text import DEFAULT_TOKEN_PATTERN, token_count, word_count

# Distinct-count sketches: 2^SKETCH_LG_K registers, relative standard error SKETCH_ERROR / sqrt(registers)
# of a merged one.
SKETCH_LG_K, SKETCH_ERROR = 14, 1.04


def with_lengths(news: DataFrame, fields=("title", "abstract"), pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """G1 + G2: ``<f>_len`` (whitespace words) and ``<f>_len_tok`` (tokens) for each text field."""
    cols = {}
    for f in fields:
        cols[f"{f}_len"] = word_count(f)
        cols[f"{f}_len_tok"] = token_count(f, pattern)
    return news.withColumns(cols)


def history_length(parsed: DataFrame) -> DataFrame:
    """Number of history items (empty history = 0)."""
    return parsed.withColumn("history_len", F.size("history"))


def length_counts(df: DataFrame, col: str) -> DataFrame:
    """(length, n) ordered by length."""
    return df.groupBy(F.col(col).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length")


def length_shares(df: DataFrame, col: str, scale: float = 1.0, remove_zero: bool = False) -> DataFrame:
    """Share of rows per length times ``scale``; zero length removed *after* the share
    was computed when ``remove_zero``.  The window runs over the aggregated table only."""
    c = df.groupBy(F.col(col).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    s = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()) * F.lit(float(scale)))
    if remove_zero:
        s = s.where(F.col("length") != 0)
    return s.select("length", "share")


def dense_fill(counts: DataFrame, key: str = "length", value: str = "n", lo=None, hi=None) -> DataFrame:
    """Every key between min and max (or [lo, hi]) with missing ones as 0."""
    b = counts.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    if lo is not None:
        b = b.withColumn("_lo", F.lit(lo).cast("long"))
    if hi is not None:
        b = b.withColumn("_hi", F.lit(hi).cast("long"))
    grid = b.select(F.explode(F.sequence(F.col("_lo").cast("long"), F.col("_hi").cast("long"))).alias(key))
    return grid.join(counts.withColumn(key, F.col(key).cast("long")), key, "left") \
        .select(key, F.coalesce(F.col(value), F.lit(0)).alias(value))


def per_hour(df: DataFrame, time: str = "time") -> DataFrame:
    """Rows per clock hour."""
    return df.groupBy(F.date_trunc("hour", F.col(time)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def hour_grid(df: DataFrame, time: str = "time", step_hours: int = 3) -> DataFrame:
    """G9 axis: ``step_hours`` grid from the floor of the first to the ceiling of the last hour."""
    step = step_hours * 3600
    b = df.agg(F.min(F.unix_seconds(F.col(time).cast("timestamp"))).alias("lo"),
               F.max(F.unix_seconds(F.col(time).cast("timestamp"))).alias("hi"))
    b = b.select(F.floor(F.floor(F.col("lo") / 3600) * 3600 / step).alias("a"),
                 F.ceil(F.floor(F.col("hi") / 3600) * 3600 / step).alias("z"))
    return b.select(F.explode(F.sequence("a", "z")).alias("i")).select(
        F.timestamp_seconds(F.col("i") * step).alias("tick"))


def survival_hours(exposures: DataFrame, item: str = "news_id", time: str = "time") -> DataFrame:
    """Per item, hours between its first and last exposure."""
    g = exposures.groupBy(item).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    micros = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))
    return g.select(item, (micros / F.lit(3.6e9)).alias("survival_hours"))


def survival_histogram(survival: DataFrame, width: float = 0.5) -> DataFrame:
    """Counts in bins (a, a + width] from 0 up to max + width, empty bins included.

    A survival of exactly 0 lies in no bin (bins are open on the left, Q11)."""
    binned = survival.where(F.col("survival_hours") > 0).select(
        F.ceil(F.col("survival_hours") / F.lit(width)).cast("long").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    top = survival.agg(F.floor(F.max("survival_hours") / F.lit(width)).cast("long").alias("_b"))
    grid = top.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("_b") + 1)).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", ((F.col("bin") - 1) * F.lit(width)).alias("lower"), (F.col("bin") * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"))


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Exact or HyperLogLog distinct count (the latter for very large tables)."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)
    return df.agg(agg.alias(f"n_{col}"))


def distinct_sketches(df: DataFrame, part, cols: list[str], lg_k: int = SKETCH_LG_K) -> DataFrame:
    """G12 at scale: (part, metric, sketch), one mergeable distinct-count sketch of 2^lg_k registers (some 8 to 16 KB at 14)
    per part and column, to be stored by ``metric_store.write_partials`` and merged at any time.
    Values are compared as strings; nulls do not count."""
    stacked = df.select(part, F.explode(F.array(*[F.struct(
        F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("x"))
    return stacked.groupBy(part, "x.metric").agg(F.hll_sketch_agg("x.v", lg_k).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., metric, n): the estimated distinct counts over all stored parts, or over each group of them;
    the relative standard error is 1.04 / sqrt(2^lg_k), 0.8% at 14."""
    keys = [*(by or []), "metric"]
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def per_category(news: DataFrame, category: str = "category", subcategory: str | None = None,
                 rollup: bool = False) -> DataFrame:
    """Items per category (and subcategory; ``rollup`` adds the category subtotals)."""
    if subcategory is None:
        return news.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    g = news.rollup(category, subcategory) if rollup else news.groupBy(category, subcategory)
    return g.agg(F.count(F.lit(1)).alias("n"))


def most_viewed(exploded: DataFrame, n: int = 10, item: str = "news_id") -> DataFrame:
    """The ``n`` most shown items (ties by id) — the limit is the report itself."""
    c = exploded.groupBy(item).agg(F.count(F.lit(1)).alias("views"))
    return c.orderBy(F.desc("views"), F.asc(item)).limit(n)


def share_at_most(df: DataFrame, col: str, k: int) -> DataFrame:
    """Share of rows with ``col <= k``."""
    return df.agg(F.avg((F.col(col) <= k).cast("double")).alias(f"share_{col}_le_{k}"))


def metric_by_length(per_imp: DataFrame, lengths: DataFrame, metric: str = "auc",
                     length: str = "history_len") -> DataFrame:
    """Mean of a per-impression metric grouped by history length."""
    j = per_imp.select("imp_id", metric).where(F.col(metric).isNotNull()).join(lengths.select("imp_id", length),
                                                                              "imp_id")
    return j.groupBy(length).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n"))
