"""Feature joins between impressions and the catalogue.

The catalogue is a dimension: it is broadcast only if its estimated size is small, otherwise
joined by shuffle with hot items split (``lookup_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impressa.functions.scalar import pad_left_keep_first, pad_left_keep_last
from impressa.operators.skew import dealt, lookup_join


def attach_features(df: DataFrame, news: DataFrame, cols: list[str], on_missing: str = "drop",
                    key: str = "news_id") -> DataFrame:
    """Rows of ``df`` with item features.  Items missing from the catalogue are dropped
    (``'drop'``), kept with nulls (``'keep'``) or make the call fail (``'error'``, like the
    reference's KeyError, Q15)."""
    dim = news.select(key, *cols, F.lit(True).alias("_hit"))
    j = lookup_join(df, dim, [key], "left")
    if on_missing == "error":  # checked row by row, in the same pass
        fail = F.raise_error(F.concat(F.lit("item missing from the catalogue: "), F.col(key).cast("string")))
        j = j.where(F.coalesce("_hit", fail.cast("boolean")))
    elif on_missing == "drop":
        j = j.where(F.col("_hit"))
    elif on_missing != "keep":
        raise ValueError("on_missing must be 'drop', 'keep' or 'error'")
    return j.drop("_hit")


def missing_items(df: DataFrame, news: DataFrame, key: str = "news_id") -> DataFrame:
    """Report for Q15: the ids of ``df`` that the catalogue lacks, with their row counts."""
    return df.join(news.select(key), key, "left_anti").groupBy(key).count()


def to_index(df: DataFrame, dictionary: DataFrame, key_col: str, out: str = "idx") -> DataFrame:
    """Key -> dense id through a (key, idx) dictionary."""
    d = dictionary.select(F.col("key").alias(key_col), F.col("idx").alias(out))
    return lookup_join(df, d, [key_col], "inner")


def _zero_of(dt, length: int | None = None):
    """The padding value of a type: 0, the empty string, or for arrays the padded text of no item."""
    if isinstance(dt, T.ArrayType):
        return F.array_repeat(_zero_of(dt.elementType), length or 0).cast(dt)
    if isinstance(dt, T.StringType):
        return F.lit("")
    return F.lit(0).cast(dt)


def _field(name):
    return lambda x: x[name]


def _shared_features(rows: DataFrame, items: DataFrame, tasks: int | None) -> DataFrame:
    """``rows`` (reader, news_id, ...) with ``_f``, the item's columns as a struct; null if ``items`` lacks it.  An item's
    columns are sent once to each reader that has the item, however many of its rows name it."""
    sent = lookup_join(dealt(rows.select("reader", "news_id"), tasks, "reader").distinct(), items, ["news_id"], tasks=tasks) \
        .select("reader", "news_id", F.struct(*items.columns).alias("_f"))
    own = [c for c in rows.columns if c not in ("reader", "news_id")]
    both = rows.select("*", F.lit(True).alias("_row")).unionByName(sent, allowMissingColumns=True)
    both = both.repartition(tasks, "reader") if tasks else both.repartition("reader")
    found = F.collect_list("_f").over(Window.partitionBy("reader", "news_id"))
    return both.withColumn("_all", found).where("_row").select("reader", "news_id", *own, F.explode_outer("_all").alias("_f"))


def impression_view(cands: DataFrame, history: DataFrame, news: DataFrame, feature_cols: list[str],
                    max_history: int = 50, keep: str = "first", array_lengths: dict[str, int] | None = None,
                    on_missing: str = "drop", tasks: int | None = None) -> DataFrame:
    """One row per impression with aligned arrays ``h_<f>`` (padded in front to
    ``max_history``, P9/Q2) and ``c_<f>`` (all candidates in position order), ``labels`` and
    the ``history_len`` before padding (Q3).  Ids and features may be numbers, strings or
    arrays; padding is a zero of the column's type, for an array a zero text of its fixed length
    (``array_lengths``).  Items missing from the catalogue are dropped and counted in
    ``n_missing``, or fail the job with ``on_missing='error'``.

    If ``cands`` and ``history`` have a ``reader``, the same for all rows of an impression, an item's features are sent
    once to each reader instead of once for each row; ``tasks`` then deal the readers.

    Groups are single impressions, bounded by one log line."""
    if on_missing not in ("drop", "error"):
        raise ValueError("on_missing must be 'drop' or 'error'")
    feats = [c for c in feature_cols if c != "news_id"]
    nf = news.select("news_id", *feats)
    types = {f.name: f.dataType for f in nf.schema.fields}
    lengths = array_lengths or {}
    mark = F.lit(True).alias("_known")
    attach = "error" if on_missing == "error" else "keep"

    pad = pad_left_keep_first if keep == "first" else pad_left_keep_last
    if "reader" in cands.columns and "reader" in history.columns:
        rows = history.select("reader", "imp_id", "news_id", F.col("hpos").cast("long").alias("at"), F.lit(None).cast(cands.schema["label"].dataType).alias("label"),
                              F.lit(True).alias("old")) \
            .unionByName(cands.select("reader", "imp_id", "news_id", F.col("pos").cast("long").alias("at"), "label", F.lit(False).alias("old")))
        x = _shared_features(rows, nf, tasks)
        if on_missing == "error":
            fail = F.raise_error(F.concat(F.lit("item missing from the catalogue: "), F.coalesce(F.col("news_id").cast("string"), F.lit("null"))))
            x = x.where(F.when(F.col("_f").isNull(), fail.cast("boolean")).otherwise(True))
        old, known = F.col("old"), F.col("_f").isNotNull()
        g = x.groupBy("reader", "imp_id").agg(
            F.array_sort(F.collect_list(F.when(old & known, F.struct("at", "_f")))).alias("_h"),
            F.array_sort(F.collect_list(F.when(~old & known, F.struct("at", "label", "_f")))).alias("_c"),
            F.sum((~known).cast("long")).alias("n_missing"), F.max(~old).alias("_shown")).where("_shown")
        item = lambda c: lambda x: x["_f"][c]
        return g.select(
            "imp_id", *[F.transform("_c", item(c)).alias(f"c_{c}") for c in nf.columns],
            F.transform("_c", lambda x: x["label"]).alias("labels"),
            *[pad(F.transform("_h", item(c)), max_history, _zero_of(types[c], lengths.get(c))).alias(f"h_{c}") for c in nf.columns],
            F.least(F.size("_h"), F.lit(max_history)).alias("history_len"), "n_missing")

    def attached(rows, order, extra):
        j = attach_features(rows, nf.select("*", mark), [*feats, "_known"], attach)
        g = j.groupBy("imp_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("_known"), F.struct(order, *extra, *nf.columns)))).alias("_x"),
            F.sum(F.col("_known").isNull().cast("long")).alias("_gone"))
        return g

    hg = attached(history, "hpos", []).select(
        "imp_id", *[pad(F.transform("_x", _field(c)), max_history, _zero_of(types[c], lengths.get(c))).alias(f"h_{c}")
                    for c in nf.columns],
        F.least(F.size("_x"), F.lit(max_history)).alias("history_len"), F.col("_gone").alias("_h_gone"))
    cg = attached(cands, "pos", ["label"]).select(
        "imp_id", *[F.transform("_x", _field(c)).alias(f"c_{c}") for c in nf.columns],
        F.transform("_x", lambda x: x["label"]).alias("labels"), F.col("_gone").alias("_c_gone"))
    out = cg.join(hg, "imp_id", "left")
    fills = {f"h_{c}": F.coalesce(F.col(f"h_{c}"), F.array_repeat(_zero_of(types[c], lengths.get(c)), max_history))
             for c in nf.columns}
    fills["history_len"] = F.coalesce(F.col("history_len"), F.lit(0))
    fills["n_missing"] = (F.col("_c_gone") + F.coalesce("_h_gone", F.lit(0))).cast("long")
    return out.withColumns(fills).drop("_c_gone", "_h_gone")


def history_details(history: DataFrame, news: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """The first ``n`` history items of each impression with their details (padding is not
    stored in the long form, so it is skipped by construction)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    h = history.where(F.col("hpos") <= n)
    return attach_features(h, news, cols, "drop").select("imp_id", "hpos", *cols)
