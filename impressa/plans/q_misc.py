"""Queries for scalar functions, losses, model selection, set operations and result tables
(F1, F2, F4-F11, W4, W5, U1-U3, G22, S13, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from impressa.functions import scalar as S
from impressa.operators import losses as L
from impressa.operators import metrics as M
from impressa.operators import parse as P
from impressa.operators import ranking as R
from impressa.operators import report as RP
from impressa.operators import sample as D
from impressa.operators import scoring as B
from impressa.operators import vocab as V
from impressa.plans.evaluate import random_scores
from impressa.plans.output import finish
from impressa.plans.registry import query
from impressa.sources import fixtures as fx
from impressa.sources.fixtures import with_views

MAX_HISTORY = 50  # of the history sentiment; its mean divides by it

HASH_SCORE = ("CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST({imp} AS VARCHAR), CAST({news} AS VARCHAR))), 1, 8)) AS BIGINT) "
              "AS DOUBLE) / 4294967296.0")


@query("f1_signed_sentiment", with_views(["fx_news"], "SELECT news_id, round(senti_b, 6) AS senti_b FROM fx_news"))
def f1_signed_sentiment(spark, d):
    p = fx.table(spark, d, "part")
    prob = F.lit(0.5) + (F.col("p_size") % 50).cast("double") / F.lit(100.0)
    label = F.when(F.col("p_size") % 2 == 0, "POSITIVE").otherwise("NEGATIVE")
    return finish(p.select(F.col("p_partkey").alias("news_id"), S.signed_sentiment(label, prob).alias("senti_b")))


@query("f2_lexicon_sentiment", with_views(["fx_docs", "fx_lexicon"], """
SELECT d.news_id, round(coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15.0), 6) AS sentiment
FROM fx_docs d LEFT JOIN (
  SELECT t.news_id, SUM(l.valence) AS x FROM (
    SELECT news_id, unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token FROM fx_docs) t
  JOIN fx_lexicon l USING (token) GROUP BY t.news_id) s USING (news_id)"""))
def f2_lexicon_sentiment(spark, d):
    return finish(L.lexicon_sentiment(fx.docs(spark, d), "news_id", "text", fx.lexicon(spark, d)))


@query("f2_modified_sentiment", with_views(["fx_docs", "fx_lexicon", "fx_modifiers"], """
SELECT d.news_id, round(coalesce(x, 0) / sqrt(coalesce(x, 0) * coalesce(x, 0) + 15.0), 6) AS sentiment
FROM fx_docs d LEFT JOIN (SELECT news_id, SUM(v) AS x FROM step3 GROUP BY news_id) s USING (news_id)""", extra=["""mods AS (
  SELECT * FROM fx_modifiers WHERE token NOT IN (SELECT token FROM fx_lexicon))""", """toks AS (
  SELECT news_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS i
  FROM (SELECT news_id, regexp_extract_all(lower(trim(text)), '@TOKEN@') AS t FROM fx_docs))""", """before AS (
  SELECT *, lag(token, 1) OVER w AS p1, lag(token, 2) OVER w AS p2, lag(token, 3) OVER w AS p3
  FROM toks WINDOW w AS (PARTITION BY news_id ORDER BY i))""", """step0 AS (
  SELECT b.*, l.valence AS v FROM before b JOIN fx_lexicon l USING (token))""", *[f"""step{k} AS (
  SELECT s.* REPLACE ((v + sign(v) * coalesce(m.boost, 0) * {decay}) * CASE WHEN m.negates THEN {L.NEGATION} ELSE 1.0 END AS v)
  FROM step{k - 1} s LEFT JOIN mods m ON m.token = s.p{k})""" for k, decay in enumerate(L.BOOST_DECAY, 1)]]))
def f2_modified_sentiment(spark, d):
    """F2 with negations and boosters among the three tokens before a known one."""
    return finish(L.modified_sentiment(fx.docs(spark, d), "news_id", "text", fx.lexicon(spark, d), fx.modifiers(spark, d)))


@query("f4_sigmoid", with_views(["fx_candidates"], f"""
SELECT imp_id, pos, round(1.0 / (1.0 + exp(-(10 * {HASH_SCORE.format(imp='imp_id', news='news_id')} - 5))), 6) AS p
FROM fx_candidates"""))
def f4_sigmoid(spark, d):
    s = random_scores(fx.candidates(spark, d))
    return finish(s.select("imp_id", "pos", S.sigmoid(F.col("score") * 10 - 5).alias("p")))


@query("f5_relu", with_views(["fx_news"], "SELECT news_id, round(greatest(senti_a, 0.0), 6) AS r FROM fx_news"))
def f5_relu(spark, d):
    return finish(fx.news(spark, d).select("news_id", S.relu("senti_a").alias("r")))


@query("f6_l2_normalise", with_views(["fx_vectors"], """
SELECT news_id, round(list_sum(list_transform(CAST(vec AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(vec AS DOUBLE[]), lambda y: y * y))))), 6) AS vec_sum
FROM fx_vectors"""))
def f6_l2_normalise(spark, d):
    v = fx.vectors(spark, d).select("news_id", S.l2_normalise_array("vec").alias("u"))
    return finish(v.select("news_id", F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("vec_sum")))


@query("f7_cosine", with_views(["fx_vectors"], """
SELECT a.news_id, round(list_cosine_similarity(CAST(a.vec AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS cosine
FROM fx_vectors a JOIN embeddings e ON e.vec_id = (7 * a.news_id) % (SELECT count(*) FROM embeddings)"""))
def f7_cosine(spark, d):
    e = fx.table(spark, d, "embeddings")
    a = fx.vectors(spark, d).withColumn("vec_id", F.pmod(F.col("news_id") * 7, F.lit(e.count())))
    j = a.join(e.select("vec_id", F.col("embedding").alias("other")), "vec_id")
    return finish(j.select("news_id", S.cosine("vec", "other").alias("cosine")))


# ---- losses over D1 training rows -------------------------------------------------------------

def _floyd():
    from impressa.plans.q_prepare import _floyd_sql
    return _floyd_sql()


TRAIN_ROWS_SQL = ["""tr AS (
  SELECT imp_id, pos_news, 0 AS slot, pos_news AS news_id FROM (SELECT DISTINCT imp_id, pos_news FROM draws)
  UNION ALL SELECT imp_id, pos_news, draw, neg_news FROM draws)""",
                  f"""trs AS (SELECT tr.*, 1.0 / (1.0 + exp(-{HASH_SCORE.format(imp='imp_id', news='news_id')})) AS y FROM tr)"""]


def _train_rows(spark, d):
    lines = P.candidate_lines(fx.candidates(spark, d))
    rows = D.training_rows(D.negative_draw(lines, 4, 1234), 4)
    slots = rows.select("imp_id", "pos_news", F.posexplode("candidates").alias("slot", "news_id"))
    return random_scores(slots.withColumn("slot", F.col("slot").cast("long")))


@query("f8_cross_entropy", with_views(["fx_candidates"], """
SELECT imp_id, pos_news, round(ln(SUM(exp(y))) - max(CASE WHEN slot = 0 THEN y END), 6) AS ce
FROM trs GROUP BY imp_id, pos_news""", extra=_floyd() + TRAIN_ROWS_SQL))
def f8_cross_entropy(spark, d):
    return finish(L.cross_entropy_first(_train_rows(spark, d)))


PRED_SQL = """pred AS (
  SELECT v.news_id, list_dot_product(CAST(v.vec AS DOUBLE[]), {w}) + 0.05 AS s_hat, n.senti_a AS s
  FROM fx_vectors v JOIN fx_news n USING (news_id))"""


def _pred(spark, d):
    from impressa.plans.q_scoring import B_PRED, W_PRED
    p = B.predict_sentiment(fx.vectors(spark, d), W_PRED, B_PRED)
    return p.join(fx.news(spark, d).select("news_id", F.col("senti_a").alias("s")), "news_id")


def _pred_sql():
    from impressa.plans.q_scoring import _dl, W_PRED
    return PRED_SQL.format(w=_dl(W_PRED))


@query("f9_sentiment_mae", with_views(["fx_vectors", "fx_news"], "SELECT round(avg(abs(s_hat - s)), 6) AS mae FROM pred",
                                      extra=[_pred_sql()]))
def f9_sentiment_mae(spark, d):
    return finish(L.sentiment_mae(_pred(spark, d)))


DIV_SQL = """dv AS (
  SELECT trs.*, n.senti_a AS s_c, coalesce(hs.m, 0.0) AS s_mean FROM trs JOIN fx_news n USING (news_id)
  LEFT JOIN (SELECT h.imp_id, SUM(n2.senti_a) / 50.0 AS m FROM fx_history h JOIN fx_news n2 USING (news_id) GROUP BY h.imp_id) hs
  USING (imp_id))"""


def _div_rows(spark, d):
    rows = _train_rows(spark, d).join(fx.news(spark, d).select("news_id", F.col("senti_a").alias("s_c")), "news_id")
    sm = M.history_sentiment(fx.history(spark, d), fx.news(spark, d), ["senti_a"], MAX_HISTORY)
    return rows.join(sm, "imp_id", "left").withColumn("s_mean", F.coalesce("s_mean_senti_a", F.lit(0.0)))


@query("f10_sentiment_diversity_loss", with_views(["fx_candidates", "fx_news", "fx_history"], """
SELECT round(avg(greatest(s_mean * s_c * (1.0 / (1.0 + exp(-""" + HASH_SCORE.format(imp='imp_id', news='news_id')
                                                    + """))), 0.0)), 6) AS div_loss FROM dv""",
                                                    H=MAX_HISTORY, extra=_floyd() + TRAIN_ROWS_SQL + [DIV_SQL]))
def f10_sentiment_diversity_loss(spark, d):
    return finish(L.sentiment_diversity_loss(_div_rows(spark, d)))


@query("f11_loss_report", with_views(["fx_candidates", "fx_news", "fx_history", "fx_vectors"], """
SELECT round(ce, 6) AS ce, round(mae, 6) AS mae, round(div_loss, 6) AS div_loss, round(ce + 0.4 * mae + 10.0 * div_loss, 6) AS total
FROM (SELECT avg(ce) AS ce FROM (SELECT ln(SUM(exp(y))) - max(CASE WHEN slot = 0 THEN y END) AS ce FROM trs GROUP BY imp_id, pos_news)),
     (SELECT avg(abs(s_hat - s)) AS mae FROM pred),
     (SELECT avg(greatest(s_mean * s_c * y, 0.0)) AS div_loss FROM dv)""",
                                       H=MAX_HISTORY, extra=_floyd() + TRAIN_ROWS_SQL + [DIV_SQL, _pred_sql()]))
def f11_loss_report(spark, d):
    return finish(L.loss_report(_div_rows(spark, d), _pred(spark, d), 0.4, 10.0))


# ---- model selection over a metrics log (W4, W5) ----------------------------------------------

LOG_SQL = """mlog AS (
  SELECT event_type AS run, CAST(day(ts) AS BIGINT) AS epoch, 'val_auc' AS metric, avg(value) AS value
  FROM events GROUP BY 1, 2)"""


def _metrics_log(spark, d):
    ev = fx.table(spark, d, "events")
    return ev.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch")) \
        .agg(F.avg("value").alias("value")).withColumn("metric", F.lit("val_auc"))


@query("w4_best_k_epochs", with_views([], """
SELECT run, epoch, round(value, 6) AS value, CAST(place AS BIGINT) AS place FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY value DESC, epoch) AS place FROM mlog WHERE metric = 'val_auc')
WHERE place <= 3""", extra=[LOG_SQL]))
def w4_best_k_epochs(spark, d):
    return finish(R.best_k_runs(_metrics_log(spark, d), "val_auc", 3).select("run", "epoch", "value", "place"))


W5_SQL = with_views([], """
SELECT f.run, coalesce(f.stop, l.last_epoch) AS stop_epoch, f.best_e AS best_epoch, f.stop IS NOT NULL AS stopped_early
FROM fold f JOIN (SELECT run, max(rn) AS rn, max(epoch) AS last_epoch FROM ord GROUP BY run) l
  ON l.run = f.run AND l.rn = f.rn""", extra=[LOG_SQL, """ord AS (
  SELECT run, epoch, value, ROW_NUMBER() OVER (PARTITION BY run ORDER BY epoch) AS rn FROM mlog WHERE metric = 'val_auc')""",
    """fold(run, rn, best, best_e, wait, stop) AS (
  SELECT run, rn, value, epoch, 0, CAST(NULL AS BIGINT) FROM ord WHERE rn = 1
  UNION ALL
  SELECT o.run, o.rn,
    CASE WHEN f.stop IS NOT NULL THEN f.best WHEN o.value > f.best + 0.0001 THEN o.value ELSE f.best END,
    CASE WHEN f.stop IS NOT NULL THEN f.best_e WHEN o.value > f.best + 0.0001 THEN o.epoch ELSE f.best_e END,
    CASE WHEN f.stop IS NOT NULL THEN f.wait WHEN o.value > f.best + 0.0001 THEN 0 ELSE f.wait + 1 END,
    CASE WHEN f.stop IS NOT NULL THEN f.stop WHEN o.value > f.best + 0.0001 THEN NULL
         WHEN f.wait + 1 >= 5 THEN o.epoch ELSE NULL END
  FROM fold f JOIN ord o ON o.run = f.run AND o.rn = f.rn + 1)"""]).replace("WITH ", "WITH RECURSIVE ", 1)


@query("w5_early_stop_epoch", W5_SQL)
def w5_early_stop_epoch(spark, d):
    return finish(R.early_stop_epoch(_metrics_log(spark, d), "val_auc", patience=5, min_delta=1e-4))


# ---- set operations ------------------------------------------------------------------------------

@query("u1_union_ids", with_views(["fx_candidates", "fx_history", "fx_impressions"], """
SELECT news_id FROM fx_history WHERE imp_id IN (SELECT imp_id FROM fx_impressions WHERE split = 'test')
UNION SELECT news_id FROM fx_candidates WHERE imp_id IN (SELECT imp_id FROM fx_impressions WHERE split = 'test')"""))
def u1_union_ids(spark, d):
    test = fx.impressions(spark, d).where(fx.is_split("test")).select("imp_id")
    return finish(R.union_ids(fx.history(spark, d).join(test, "imp_id"), fx.candidates(spark, d).join(test, "imp_id")))


@query("u2_dedupe_list", with_views(["fx_candidates", "fx_history"], """
SELECT imp_id, CAST(count(DISTINCT news_id) AS BIGINT) AS n_distinct FROM (
  SELECT imp_id, news_id FROM fx_history UNION ALL SELECT imp_id, news_id FROM fx_candidates) GROUP BY imp_id"""))
def u2_dedupe_list(spark, d):
    h = fx.history(spark, d).groupBy("imp_id").agg(F.collect_list("news_id").alias("h"))
    c = fx.candidates(spark, d).groupBy("imp_id").agg(F.collect_list("news_id").alias("c"))
    j = c.join(h, "imp_id", "left").select(
        "imp_id", F.size(R.dedupe_list(F.concat("c", F.coalesce("h", F.array().cast("array<bigint>"))))).alias("n_distinct"))
    return finish(j)


@query("u3_new_keys", with_views(["fx_articles", "fx_word_vectors"], """
SELECT DISTINCT token AS key FROM art_tokens WHERE so = 1
EXCEPT SELECT DISTINCT token FROM art_tokens WHERE so = 0""", extra=[
    """art_tokens AS (
  SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END AS so, unnest(regexp_extract_all(lower(trim(abstract)), '@TOKEN@')) AS token
  FROM fx_articles)"""]))
def u3_new_keys(spark, d):
    a = fx.articles(spark, d)
    test = V.tokens_long(a.where(F.col("split") == "test"), "news_id", "abstract").select(F.col("token").alias("key"))
    train = V.tokens_long(a.where(F.col("split") == "train"), "news_id", "abstract").select(F.col("token").alias("key"))
    return R.new_keys(test, train.distinct())


# ---- experiment comparison and result tables (G22, S13, S14) ------------------------------------

EXP_SQL = [f"""exp_scored AS (
  SELECT 'random' AS experiment, imp_id, pos, label, {HASH_SCORE.format(imp='imp_id', news='news_id')} AS score FROM fx_candidates
  UNION ALL
  SELECT 'popularity', c.imp_id, c.pos, c.label, CAST(p.views AS DOUBLE) FROM fx_candidates c
  JOIN (SELECT news_id, count(*) AS views FROM fx_candidates GROUP BY news_id) p USING (news_id))""",
           """exp_rk AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, imp_id ORDER BY score DESC, pos) AS r,
         ROW_NUMBER() OVER (PARTITION BY experiment, imp_id ORDER BY label DESC, pos) AS ri,
         RANK() OVER (PARTITION BY experiment, imp_id ORDER BY score) + (COUNT(*) OVER (PARTITION BY experiment, imp_id, score) - 1) / 2.0 AS arank
  FROM exp_scored)""",
           """exp_perf AS (
  SELECT experiment, imp_id,
    CASE WHEN SUM(label) > 0 AND SUM(label) < COUNT(*) THEN
      (SUM(CASE WHEN label > 0 THEN arank ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0) / (SUM(label) * (COUNT(*) - SUM(label))) END AS auc,
    CASE WHEN SUM(label) > 0 THEN SUM(label / r) / SUM(label) END AS mrr,
    CASE WHEN SUM(CASE WHEN ri <= 5 THEN (pow(2, label) - 1) / log2(ri + 1) ELSE 0 END) > 0 THEN
      SUM(CASE WHEN r <= 5 THEN (pow(2, label) - 1) / log2(r + 1) ELSE 0 END) / SUM(CASE WHEN ri <= 5 THEN (pow(2, label) - 1) / log2(ri + 1) ELSE 0 END) END AS ndcg5
  FROM exp_rk GROUP BY experiment, imp_id)""",
           """exp_long AS (
  SELECT experiment, metric, AVG(v) AS value FROM (
    SELECT experiment, 'auc' AS metric, auc AS v FROM exp_perf UNION ALL SELECT experiment, 'mrr', mrr FROM exp_perf
    UNION ALL SELECT experiment, 'ndcg_at_5', ndcg5 FROM exp_perf) GROUP BY experiment, metric)"""]


def _experiments(spark, d):
    cands = fx.candidates(spark, d)
    views = cands.groupBy("news_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    runs = {"random": random_scores(cands), "popularity": cands.join(views, "news_id")}
    out = []
    for name, scored in runs.items():
        per = M.performance(scored, ks=(5,)).select("imp_id", "auc", "mrr", F.col("`ndcg@5`").alias("ndcg_at_5"))
        out.append((name, M.summarize(per, ["auc", "mrr", "ndcg_at_5"])))
    return RP.compare_experiments(*out)


@query("g22_compare_experiments", with_views(["fx_candidates"], """
SELECT experiment, metric, round(value, 6) AS value FROM exp_long""", extra=EXP_SQL))
def g22_compare_experiments(spark, d):
    return finish(_experiments(spark, d))


@query("s13_results_table", with_views(["fx_candidates"], """
SELECT metric, round(max(CASE WHEN experiment = 'popularity' THEN value END), 6) AS popularity,
       round(max(CASE WHEN experiment = 'random' THEN value END), 6) AS random
FROM exp_long GROUP BY metric""", extra=EXP_SQL))
def s13_results_table(spark, d):
    return finish(RP.results_table(_experiments(spark, d), ["popularity", "random"]))


@query("s14_batch_profile", with_views(["fx_candidates"], """
SELECT * FROM (VALUES ('imp_id', 'bigint', NULL::BIGINT, NULL::BIGINT), ('history_len', 'int', NULL, NULL),
                      ('h_news_id', 'array<bigint>', 10, 10)) AS t("column", "type", min_len, max_len)
UNION ALL SELECT 'c_news_id', 'array<bigint>', min(c), max(c) FROM (SELECT imp_id, count(*) AS c FROM fx_candidates GROUP BY imp_id)
UNION ALL SELECT 'labels', 'array<bigint>', min(c), max(c) FROM (SELECT imp_id, count(*) AS c FROM fx_candidates GROUP BY imp_id)"""))
def s14_batch_profile(spark, d):
    from impressa.operators.joins import impression_view
    v = impression_view(fx.candidates(spark, d), fx.history(spark, d), fx.news(spark, d), ["news_id"], 10)
    prof = RP.batch_profile(v.select("imp_id", "h_news_id", "history_len", "c_news_id", "labels"))
    return prof.select("column", "type", "min_len", "max_len")
