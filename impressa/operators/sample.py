"""Sampling, splitting and subsetting.

Every draw is a function of (seed, row keys) through md5, so it does not depend on partitioning
or task retries, and any SQL engine can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.functions.scalar import click_mask, hash_key, hash_uniform
from impressa.operators.skew import lookup_join
from impressa.operators.vocab import dense_index
from impressa.session import stored

HEX60 = 15  # hex digits of md5 used for the exact-k sort key (60 bits, fits a signed long)


def negative_draw(lines: DataFrame, n_negative: int, seed: int = 1234) -> DataFrame:
    """For every click of a trainable impression, ``n_negative`` distinct non-clicks of the
    same impression drawn uniformly without replacement.

    ``lines`` has imp_id and ``candidates`` (pos, news_id, label) of one log line each, so the
    draw is a set of array expressions on the row, without a shuffle.  Floyd's algorithm picks the N
    indices with N hash draws per click: for t = m-N .. m-1, r = h(seed, imp, click position, t)
    mod (t+1); take r unless already taken, else t.  A click is its position, so an item clicked
    twice gives two rows.  Output: the other columns of ``lines`` plus click_pos, pos_news and
    ``negatives`` in draw order.
    """
    n = n_negative
    neg = F.transform(F.filter("candidates", lambda c: c["label"] == 0), lambda c: c["news_id"])
    rows = lines.withColumn("_neg", neg).where(F.size("_neg") >= n)
    keep = [c for c in lines.columns if c != "candidates"]
    rows = rows.select(*keep, "_neg", F.explode(F.filter("candidates", lambda c: c["label"] == 1)).alias("_click"))
    rows = rows.select(*keep, "_neg", F.col("_click.pos").cast("long").alias("click_pos"),
                       F.col("_click.news_id").alias("pos_news"))
    m = F.size("_neg").cast("long")
    seed_s = F.lit(str(seed))

    def step(acc, t):
        r = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", seed_s, F.col("imp_id").cast("string"),
                                                           F.col("click_pos").cast("string"), t.cast("string"))),
                                      1, 8), 16, 10).cast("long"), t + 1)
        return F.concat(acc, F.array(F.when(F.array_contains(acc, r), t).otherwise(r)))

    picks = F.aggregate(F.sequence(m - n, m - 1), F.array().cast("array<long>"), step)
    return rows.withColumn("_picks", picks).withColumn("negatives", F.transform(
        "_picks", lambda j: F.get("_neg", j.cast("int")))).drop("_neg", "_picks")


def draws_long(draws: DataFrame) -> DataFrame:
    """(imp_id, click_pos, pos_news, draw 1..N, neg_news)."""
    x = draws.select("imp_id", "click_pos", "pos_news", F.posexplode("negatives").alias("draw", "neg_news"))
    return x.withColumn("draw", (F.col("draw") + 1).cast("long"))


def training_rows(draws: DataFrame, n_negative: int) -> DataFrame:
    """D1 output rows: ``candidates`` = [click] + negatives in draw order, ``mask`` = 1 0...0, and
    the other columns of the log line."""
    return draws.withColumns({"candidates": F.concat(F.array("pos_news"), "negatives"),
                              "mask": click_mask(n_negative)}).drop("negatives")


def split_fraction(df: DataFrame, fraction: float, seed: int = 1234, key: str = "imp_id") -> DataFrame:
    """Adds ``part`` = 'val' for a hash-chosen share ``fraction`` of rows, else 'train';
    fraction 0 means no validation part."""
    u = hash_uniform(F.lit(str(seed)), F.col(key))
    return df.withColumn("part", F.when((F.lit(fraction) > 0) & (u < F.lit(float(fraction))), "val")
                         .otherwise("train"))


def _sort_key(seed: int, key: str):
    return F.conv(F.substring(F.md5(hash_key(F.lit(str(seed)), F.col(key))), 1, HEX60), 16, 10).cast("long")


def sample_exact(df: DataFrame, k: int, seed: int = 1234, key: str = "imp_id",
                 bits_per_level: int = 16, final_rows: int = 200_000) -> DataFrame:
    """D3: exactly ``k`` rows, the ones with the smallest md5(seed|key) (ties by key).

    Instead of a global sort + limit (which funnels k rows through one task), the threshold is
    found from histograms of the hash's leading bits (bounded tables, 2^bits rows), narrowing one
    level at a time until the boundary bucket is small; rows below it are kept by a filter and
    only the boundary bucket is ranked.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    # stored once: every level reads one hash column; the row number tells equal keys apart
    h = stored(df.withColumn("_h", _sort_key(seed, key)).withColumn("_tie", F.monotonically_increasing_id()))
    total_bits = HEX60 * 4
    lo_prefix, prev_shift, shift, need = None, total_bits, total_bits, k
    cond_below = F.lit(False)
    while True:
        prev_shift, shift = shift, max(0, shift - bits_per_level)
        in_prefix = F.lit(True) if lo_prefix is None else (F.shiftright("_h", prev_shift) == lo_prefix)
        hist = (h.where(in_prefix).groupBy(F.shiftright("_h", shift).alias("b")).count()
                .orderBy("b").collect())  # at most 2^bits_per_level rows
        if lo_prefix is None:  # the first level also counts every row
            n = sum(row["count"] for row in hist)
            if k > n:
                raise ValueError(f"k must be at most {n}, got {k}")
        acc = 0
        for row in hist:
            if acc + row["count"] >= need:
                bucket, cnt = row["b"], row["count"]
                break
            acc += row["count"]
        cond_below = cond_below | (in_prefix & (F.shiftright("_h", shift) < bucket))
        need -= acc
        lo_prefix = bucket
        if cnt <= final_rows or shift == 0:
            break
    # ties in all hash bits go on by key, then by row; numbering is distributed, so the boundary may be of any size
    boundary = h.where(F.shiftright("_h", shift) == bucket)
    picked = dense_index(boundary, ["_h", key, "_tie"], "_r").where(F.col("_r") <= need).drop("_r")
    return h.where(cond_below).unionByName(picked).drop("_h", "_tie")


def split_exact(df: DataFrame, size: float | int, seed: int = 1234, key: str = "imp_id") -> DataFrame:
    """D2, exact: adds ``part`` = 'val' for exactly ceil(size * rows) rows (a share below 1) or ``size`` rows (a
    whole number), the ones with the smallest md5(seed|key), else 'train'; size 0 means no validation part."""
    if size < 0 or (size > 1 and size != int(size)):
        raise ValueError("size must be a share up to 1 or a whole number of rows")
    if size == 0:
        return df.withColumn("part", F.lit("train"))
    n = df.count()
    k = int(size) if size > 1 or isinstance(size, int) else math.ceil(size * n)
    if n == 0:
        return df.withColumn("part", F.lit("train"))
    # the largest chosen (hash, key) splits the table by a predicate
    chosen = sample_exact(df.select(key), k, seed, key)
    last = chosen.agg(F.max(F.struct(_sort_key(seed, key).alias("h"), F.col(key).alias("k"))).alias("m")).first()["m"]
    h = _sort_key(seed, key)
    val = (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= F.lit(last["k"])))
    return df.withColumn("part", F.when(val, "val").otherwise("train"))


def catalogue_subset(news: DataFrame, behaviors_long_ids: DataFrame) -> DataFrame:
    """News rows referenced by history or candidates (blank ids dropped)."""
    ids = behaviors_long_ids.select("news_id").where(F.col("news_id").isNotNull() &
                                                     (F.col("news_id").cast("string") != "")).distinct()
    return news.join(ids, "news_id", "left_semi")


def referenced_ids(parsed: DataFrame) -> DataFrame:
    """U1 for D4: ids of history items and of candidates."""
    h = parsed.select(F.explode("history").alias("news_id"))
    c = parsed.select(F.explode("candidates.news_id").alias("news_id"))
    return h.unionByName(c).distinct()


def eval_rows(parsed: DataFrame, user2int: DataFrame, tasks: int | None = None) -> DataFrame:
    """Unsampled evaluation rows: user id (0 if unknown), history, candidates, click mask.  A large dictionary
    is joined over ``tasks`` partitions, if that is more than the session's number."""
    u = user2int.select(F.col("key").alias("user_id"), F.col("idx").alias("user"))
    return lookup_join(parsed, u, ["user_id"], "left", tasks=tasks).select(
        "imp_id", F.coalesce("user", F.lit(0)).cast("long").alias("user"), "history",
        F.transform("candidates", lambda c: c["news_id"]).alias("candidates"),
        F.transform("candidates", lambda c: c["label"]).alias("mask"))
