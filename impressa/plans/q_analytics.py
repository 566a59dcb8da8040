"""Queries for the dataset profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from impressa.operators import analytics as G
from impressa.operators import metrics as M
from impressa.operators import parse as P
from impressa.plans.evaluate import random_scores
from impressa.plans.output import finish
from impressa.plans.registry import query
from impressa.session import stored
from impressa.sources import fixtures as fx
from impressa.sources.fixtures import with_views


TRAIN_ART = "(SELECT * FROM fx_articles WHERE split = 'train')"
WLEN = "len(list_filter(string_split_regex(trim({c}), '\\s+'), lambda x: x <> ''))"
TLEN = "len(regexp_extract_all(lower(trim({c})), '@TOKEN@'))"


def _train_articles(spark, d):
    return G.with_lengths(fx.articles(spark, d).where(F.col("split") == "train"))


def _parsed_train(spark, d):
    p = P.parse_behaviors(fx.raw_behaviors(spark, d))
    return G.history_length(p.where(F.col("split") == "train"))


@query("g1_word_lengths", with_views(["fx_articles"], f"""
SELECT news_id, CAST({WLEN.format(c='title')} AS BIGINT) AS title_len,
       CAST({WLEN.format(c='abstract')} AS BIGINT) AS abstract_len FROM {TRAIN_ART}"""))
def g1_word_lengths(spark, d):
    return finish(_train_articles(spark, d).select("news_id", "title_len", "abstract_len"))


@query("g2_token_lengths", with_views(["fx_articles"], f"""
SELECT news_id, CAST({TLEN.format(c='title')} AS BIGINT) AS title_len_tok,
       CAST({TLEN.format(c='abstract')} AS BIGINT) AS abstract_len_tok FROM {TRAIN_ART}"""))
def g2_token_lengths(spark, d):
    return finish(_train_articles(spark, d).select("news_id", "title_len_tok", "abstract_len_tok"))


HIST_LEN_SQL = """hl AS (
  SELECT i.imp_id, count(h.news_id) AS history_len FROM fx_impressions i LEFT JOIN fx_history h USING (imp_id)
  WHERE i.split = 'train' GROUP BY i.imp_id)"""


@query("g3_history_length", with_views(["fx_impressions", "fx_history"],
                                       "SELECT imp_id, CAST(history_len AS BIGINT) AS history_len FROM hl",
                                       extra=[HIST_LEN_SQL]))
def g3_history_length(spark, d):
    return finish(_parsed_train(spark, d).select("imp_id", "history_len"))


@query("g4_abstract_word_length_counts", with_views(["fx_articles"], f"""
SELECT CAST({WLEN.format(c='abstract')} AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS n FROM {TRAIN_ART} GROUP BY 1"""))
def g4_length_counts(spark, d):
    # abstracts: titles are two-word part names, so their histogram has one bar
    return finish(G.length_counts(_train_articles(spark, d), "abstract_len"))


@query("g5_title_token_shares", with_views(["fx_articles"], f"""
SELECT CAST(length AS BIGINT) AS length, round(n / SUM(n) OVER () * 10, 6) AS share FROM (
  SELECT {TLEN.format(c='title')} AS length, count(*) AS n FROM {TRAIN_ART} GROUP BY 1)"""))
def g5_title_token_shares(spark, d):
    return finish(G.length_shares(_train_articles(spark, d), "title_len_tok", 10.0))


@query("g5_abstract_token_shares", with_views(["fx_articles"], f"""
SELECT CAST(length AS BIGINT) AS length, round(n / SUM(n) OVER () * 10, 6) AS share FROM (
  SELECT {TLEN.format(c='abstract')} AS length, count(*) AS n FROM {TRAIN_ART} GROUP BY 1)"""))
def g5_abstract_token_shares(spark, d):
    return finish(G.length_shares(_train_articles(spark, d), "abstract_len_tok", 10.0))


@query("g6_abstract_token_shares_nonzero", with_views(["fx_articles"], f"""
SELECT CAST(length AS BIGINT) AS length, round(share, 6) AS share FROM (
  SELECT length, n / SUM(n) OVER () * 100 AS share FROM (
    SELECT {TLEN.format(c='abstract')} AS length, count(*) AS n FROM {TRAIN_ART} GROUP BY 1)) WHERE length <> 0"""))
def g6_abstract_token_shares_nonzero(spark, d):
    return finish(G.length_shares(_train_articles(spark, d), "abstract_len_tok", 100.0, remove_zero=True))


@query("g7_dense_history_histogram", with_views(["fx_impressions", "fx_history"], """
SELECT CAST(g.length AS BIGINT) AS length, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest(range((SELECT min(history_len) FROM hl), (SELECT max(history_len) FROM hl) + 1)) AS length) g
LEFT JOIN (SELECT history_len AS length, count(*) AS n FROM hl GROUP BY 1) c USING (length)""",
                                                extra=[HIST_LEN_SQL]))
def g7_dense_history_histogram(spark, d):
    return finish(G.dense_fill(G.length_counts(_parsed_train(spark, d), "history_len")))


@query("g8_history_length_counts", with_views(["fx_impressions", "fx_history"], """
SELECT CAST(history_len AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS n FROM hl GROUP BY 1""",
                                              extra=[HIST_LEN_SQL]))
def g8_history_length_counts(spark, d):
    return finish(G.length_counts(_parsed_train(spark, d), "history_len"))


@query("g9_exposures_per_hour", with_views(["fx_exposures"], """
SELECT CAST(date_trunc('hour', time) AS VARCHAR) AS hour, CAST(count(*) AS BIGINT) AS n FROM fx_exposures GROUP BY 1"""))
def g9_exposures_per_hour(spark, d):
    return finish(G.per_hour(fx.exposures(spark, d)))


@query("g9_hour_grid", with_views(["fx_exposures"], """
SELECT CAST(tick AS VARCHAR) AS tick FROM (
  SELECT unnest(range(time_bucket(INTERVAL 3 HOUR, min(date_trunc('hour', time))),
                      time_bucket(INTERVAL 3 HOUR, max(date_trunc('hour', time)) - INTERVAL 1 MICROSECOND) + INTERVAL 3 HOUR + INTERVAL 1 SECOND,
                      INTERVAL 3 HOUR)) AS tick FROM fx_exposures)"""))
def g9_hour_grid(spark, d):
    return finish(G.hour_grid(fx.exposures(spark, d)))


SURV_SQL = """surv AS (
  SELECT news_id, (epoch_us(max(time)) - epoch_us(min(time))) / 3.6e9 AS survival_hours FROM fx_exposures GROUP BY news_id)"""


@query("g10_survival_hours", with_views(["fx_exposures"], """
SELECT news_id, round(survival_hours, 6) AS survival_hours FROM surv""", extra=[SURV_SQL]))
def g10_survival_hours(spark, d):
    return finish(G.survival_hours(fx.exposures(spark, d)))


@query("g11_survival_histogram", with_views(["fx_exposures"], """
SELECT CAST(g.bin AS BIGINT) AS bin, round((g.bin - 1) * 0.5, 6) AS lower, round(g.bin * 0.5, 6) AS upper,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT unnest(range(1, CAST(floor((SELECT max(survival_hours) FROM surv) / 0.5) AS BIGINT) + 2)) AS bin) g
LEFT JOIN (SELECT CAST(ceil(survival_hours / 0.5) AS BIGINT) AS bin, count(*) AS n FROM surv
           WHERE survival_hours > 0 GROUP BY 1) c USING (bin)""", extra=[SURV_SQL]))
def g11_survival_histogram(spark, d):
    return finish(G.survival_histogram(G.survival_hours(fx.exposures(spark, d))))


@query("g12_distinct_users_and_news", with_views(["fx_impressions", "fx_articles"], """
SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n_user_id,
       CAST((SELECT count(DISTINCT news_id) FROM fx_articles WHERE split = 'train') AS BIGINT) AS n_news_id
FROM fx_impressions WHERE split = 'train'"""))
def g12_distinct_users_and_news(spark, d):
    u = G.distinct_count(fx.impressions(spark, d).where(fx.is_split("train")), "user_id")
    n = G.distinct_count(fx.articles(spark, d).where(F.col("split") == "train"), "news_id")
    from impressa.operators.report import one_row
    return finish(one_row(u, n))


@query("g12_merged_sketches", with_views(["fx_impressions", "fx_exposures"], """
SELECT 'user_id' AS metric, CAST(count(DISTINCT user_id) AS BIGINT) AS n_exact, true AS within_bound FROM fx_impressions
UNION ALL SELECT 'news_id', CAST(count(DISTINCT news_id) AS BIGINT), true FROM fx_exposures"""))
def g12_merged_sketches(spark, d):
    """G12 from sketches per day, stored and merged: exact count, and whether the merged estimate lies within
    four standard errors of it."""
    users = fx.impressions(spark, d).select(F.to_date("time").cast("string").alias("day"), "user_id")
    items = fx.exposures(spark, d).select(F.to_date("time").cast("string").alias("day"), "news_id")
    out = None
    for rows, col in ((users, "user_id"), (items, "news_id")):
        merged = G.merge_distinct(stored(G.distinct_sketches(rows, "day", [col])))
        exact = G.distinct_count(rows, col).select(F.lit(col).alias("metric"), F.lit(None).cast("long").alias("n"), F.col(f"n_{col}").alias("n_exact"))
        both = merged.withColumn("n_exact", F.lit(None).cast("long")).unionByName(exact)
        out = both if out is None else out.unionByName(both)
    one = out.groupBy("metric").agg(F.max("n").alias("n"), F.max("n_exact").alias("n_exact"))
    error = 4 * G.SKETCH_ERROR / 2 ** (G.SKETCH_LG_K / 2)
    return finish(one.select("metric", "n_exact", (F.abs(F.col("n") - F.col("n_exact")) <= F.lit(error) * F.col("n_exact")).alias("within_bound")))


@query("g13_news_per_category", with_views(["fx_news"], """
SELECT category, subcategory, CAST(count(*) AS BIGINT) AS n FROM fx_news GROUP BY ROLLUP (category, subcategory)"""))
def g13_news_per_category(spark, d):
    return finish(G.per_category(fx.news(spark, d), "category", "subcategory", rollup=True))


@query("g14_most_viewed", with_views(["fx_candidates"], """
SELECT news_id, CAST(count(*) AS BIGINT) AS views FROM fx_candidates GROUP BY news_id
ORDER BY views DESC, news_id LIMIT 10"""))
def g14_most_viewed(spark, d):
    return finish(G.most_viewed(fx.candidates(spark, d)))


@query("g15_share_within_limits", with_views(["fx_articles", "fx_impressions", "fx_history"], f"""
SELECT round((SELECT avg(CASE WHEN {TLEN.format(c='title')} <= 20 THEN 1.0 ELSE 0.0 END) FROM {TRAIN_ART}), 6) AS share_title_len_tok_le_20,
       round((SELECT avg(CASE WHEN {TLEN.format(c='abstract')} <= 50 THEN 1.0 ELSE 0.0 END) FROM {TRAIN_ART}), 6) AS share_abstract_len_tok_le_50,
       round((SELECT avg(CASE WHEN history_len <= 50 THEN 1.0 ELSE 0.0 END) FROM hl), 6) AS share_history_len_le_50""",
                                             extra=[HIST_LEN_SQL]))
def g15_share_within_limits(spark, d):
    a = _train_articles(spark, d)
    h = _parsed_train(spark, d)
    from impressa.operators.report import one_row
    out = one_row(G.share_at_most(a, "title_len_tok", 20), G.share_at_most(a, "abstract_len_tok", 50),
                  G.share_at_most(h, "history_len", 50))
    return finish(out)


@query("g16_auc_by_history_length", with_views(["fx_candidates", "fx_impressions", "fx_history"], """
SELECT CAST(coalesce(h.n, 0) AS BIGINT) AS history_len, round(avg(a.auc), 6) AS mean_auc, CAST(count(*) AS BIGINT) AS n
FROM (SELECT imp_id,
        (SUM(CASE WHEN label > 0 THEN arank ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0) / (SUM(label) * (COUNT(*) - SUM(label))) AS auc
      FROM (SELECT *, RANK() OVER (PARTITION BY imp_id ORDER BY score) + (COUNT(*) OVER (PARTITION BY imp_id, score) - 1) / 2.0 AS arank
            FROM scored) GROUP BY imp_id HAVING SUM(label) > 0 AND SUM(label) < COUNT(*)) a
LEFT JOIN (SELECT imp_id, count(*) AS n FROM fx_history GROUP BY imp_id) h USING (imp_id)
GROUP BY 1""", extra=["""scored AS (
  SELECT imp_id, pos, news_id, label,
         CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST(imp_id AS VARCHAR), CAST(news_id AS VARCHAR))), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS score
  FROM fx_candidates)"""]))
def g16_auc_by_history_length(spark, d):
    per = M.auc(random_scores(fx.candidates(spark, d)))
    lens = P.parse_behaviors(fx.raw_behaviors(spark, d)).select("imp_id", F.size("history").alias("history_len"))
    return finish(G.metric_by_length(per, lens))
