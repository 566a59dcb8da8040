"""Parsing, filtering and padding of impression logs.

All row-local work is array/higher-order expressions on the log line itself, so it runs inside
the scan stage with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.functions.scalar import explode_default, parse_log_time, split_history
from impressa.operators.skew import lookup_join

def _tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), " +"), lambda x: x != "")


def parse_impressions(col) -> Column:
    """``N12-1 N34-0`` -> [(pos, news_id, label)]: id = all but the last 2 characters,
    clicked = ends with ``1``."""
    return F.transform(_tokens(col), lambda x, i: F.struct(
        (i + 1).alias("pos"), x.substr(F.lit(1), F.length(x) - 2).alias("news_id"),
        F.when(x.endswith("1"), 1).otherwise(0).alias("label")))


def parse_impressions_dash(col) -> Column:
    """The same tokens split on ``-`` (equal to P1 unless an id contains ``-``)."""
    return F.transform(_tokens(col), lambda x, i: F.struct(
        (i + 1).alias("pos"), F.split(x, "-").getItem(0).alias("news_id"),
        F.split(x, "-").getItem(1).cast("int").alias("label")))


def parse_behaviors(raw: DataFrame) -> DataFrame:
    """P1 + P4 + P6 on a raw behaviors frame: typed (imp_id, user_id, time, history, candidates);
    a frame read without its history column has none."""
    return raw.select(F.col("imp_id").cast("long").alias("imp_id"), "user_id",
                      parse_log_time("time").alias("time"),
                      *([split_history("history").alias("history")] if "history" in raw.columns else []),
                      parse_impressions("impressions").alias("candidates"),
                      *[c for c in raw.columns if c not in ("imp_id", "user_id", "time", "history", "impressions")])


def candidate_lines(cands: DataFrame) -> DataFrame:
    """Long candidates (imp_id, pos, news_id, label) -> (imp_id, candidates), one log line each."""
    return cands.groupBy("imp_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "news_id", "label"))).alias("candidates"))


def explode_impressions(parsed: DataFrame, keep=("imp_id", "user_id", "time")) -> DataFrame:
    """One row per shown candidate (imp_id, ..., pos, news_id, label)."""
    return parsed.select(*keep, F.inline("candidates"))


def explode_history(parsed: DataFrame, keep=("imp_id",)) -> DataFrame:
    """History list -> long (imp_id, hpos, news_id)."""
    return parsed.select(*keep, F.posexplode("history").alias("hpos", "news_id")) \
        .withColumn("hpos", (F.col("hpos") + 1).cast("long"))


def explode_with_default(df: DataFrame, col: str, default=-1, out: str | None = None) -> DataFrame:
    """P5: explode a list column; an empty list yields one row with ``default``."""
    return df.withColumn(out or col, F.explode(explode_default(col, default)))


def trainable(parsed: DataFrame, n_negative: int) -> DataFrame:
    """Impressions with at least one click and at least ``n_negative`` non-clicks."""
    pos = F.size(F.filter("candidates", lambda c: c["label"] == 1))
    neg = F.size(F.filter("candidates", lambda c: c["label"] == 0))
    return parsed.where((pos >= 1) & (neg >= n_negative))


def trainable_long(cands: DataFrame, n_negative: int) -> DataFrame:
    """P7 on long candidates (imp_id, pos, news_id, label): per-impression counts + having."""
    g = cands.groupBy("imp_id").agg(F.sum((F.col("label") == 1).cast("long")).alias("n_pos"),
                                    F.sum((F.col("label") == 0).cast("long")).alias("n_neg"))
    return g.where((F.col("n_pos") >= 1) & (F.col("n_neg") >= n_negative))


def user_index(df: DataFrame, user2int: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Dense user id, 0 for users not in the dictionary (key, idx)."""
    u = user2int.select(F.col("key").alias(user_col), F.col("idx").alias("user"))
    return df.join(u, user_col, "left").withColumn("user", F.coalesce(F.col("user"), F.lit(0)).cast("long"))


def clean_history(history_long: DataFrame, catalogue: DataFrame, row: str = "imp_id", tasks: int | None = None) -> DataFrame:
    """History items that exist in the catalogue, deduplicated per row (sorted ids are the
    natural order of the long form).  The join by item takes ``tasks`` partitions, if that is more than the
    session's number; an item's rows are deduplicated where they were joined."""
    return lookup_join(history_long.select("news_id", row), catalogue.select("news_id").distinct(), ["news_id"],
                       "left_semi", tasks=tasks).distinct()


def min_valid_ratio(scored: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Keep impressions whose share of non-zero scores is at least ``ratio``."""
    w = Window.partitionBy("imp_id")
    share = F.avg((F.col("score") != 0).cast("double")).over(w)
    return scored.withColumn("_share", share).where(F.col("_share") >= ratio).drop("_share")


def used_and_total(scored: DataFrame, kept: DataFrame) -> DataFrame:
    """P14 report: (n_used, n_total) impressions."""
    from impressa.operators.report import one_row
    a = kept.agg(F.countDistinct("imp_id").alias("n_used"))
    b = scored.agg(F.countDistinct("imp_id").alias("n_total"))
    return one_row(a, b)


def by_impression(df: DataFrame, imp_id) -> DataFrame:
    """One impression."""
    return df.where(F.col("imp_id") == F.lit(imp_id))


def by_index(df: DataFrame, position: int, order: str = "imp_id") -> DataFrame:
    """The row at a position (from 0) of the table sorted by ``order``."""
    from impressa.operators.vocab import dense_index
    return dense_index(df, [order], "_at", start=0).where(F.col("_at") == position).drop("_at")


def prune_fill(df: DataFrame, cols: list[str], fill: str = "") -> DataFrame:
    """Keep columns, empty string for nulls."""
    return df.select(*cols).na.fill(fill)
