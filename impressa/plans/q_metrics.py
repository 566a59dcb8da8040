"""Queries for ranking, metrics and evaluation bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from impressa.operators import metrics as M
from impressa.plans.evaluate import both_classes, random_scores
from impressa.plans.output import finish
from impressa.plans.registry import query
from impressa.sources import fixtures as fx
from impressa.sources.fixtures import with_views

H = 50
KS = (5, 10)
SENTI = ("senti_a", "senti_b")


def _safe(df):
    return df.select(*[F.col(f"`{c}`").alias(c.replace("@", "_at_")) for c in df.columns])


def _scored(spark, d):
    return random_scores(fx.candidates(spark, d))


def _per_imp(spark, d, senti=SENTI, topics=True):
    return M.impression_metrics(_scored(spark, d), fx.news(spark, d), fx.history(spark, d),
                                senti_cols=senti, ks=KS, max_history=H, topics=topics, tasks=fx.tasks(spark, d))


# ---- oracle building blocks (DuckDB) -----------------------------------------------------------

SCORED_SQL = """scored AS (
  SELECT imp_id, pos, news_id, label,
         CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST(imp_id AS VARCHAR), CAST(news_id AS VARCHAR))), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS score
  FROM fx_candidates)"""

RANKED_SQL = """rk AS (
  SELECT s.*, n.senti_a, n.senti_b, n.category, n.subcategory,
         list_distinct([n.category, n.subcategory]) AS topics,
         ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY score DESC, pos) AS r,
         ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY label DESC, pos) AS ri,
         RANK() OVER (PARTITION BY imp_id ORDER BY score) + (COUNT(*) OVER (PARTITION BY imp_id, score) - 1) / 2.0 AS arank
  FROM scored s LEFT JOIN fx_news n USING (news_id))"""


def _perf_sql(ks=KS):
    nd = ",\n".join(
        f"""CASE WHEN SUM(CASE WHEN ri <= {k} THEN (pow(2, label) - 1) / log2(ri + 1) ELSE 0 END) > 0 THEN
      SUM(CASE WHEN r <= {k} THEN (pow(2, label) - 1) / log2(r + 1) ELSE 0 END)
      / SUM(CASE WHEN ri <= {k} THEN (pow(2, label) - 1) / log2(ri + 1) ELSE 0 END) END AS "ndcg_at_{k}\"""" for k in ks)
    return f"""perf AS (
  SELECT imp_id, COUNT(*) AS n_cand, SUM(label) AS n_pos,
    CASE WHEN SUM(label) > 0 AND SUM(label) < COUNT(*) THEN
      (SUM(CASE WHEN label > 0 THEN arank ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0)
      / (SUM(label) * (COUNT(*) - SUM(label))) END AS auc,
    CASE WHEN SUM(label) > 0 THEN SUM(label / r) / SUM(label) END AS mrr,
    {nd}
  FROM rk GROUP BY imp_id)"""


def _senti_sql(ks=KS, h=H):
    cols = []
    for c, nm in (("senti_a", "senti_a"), ("senti_b", "senti_b")):
        cols.append(f"greatest(0.0, coalesce(max(hs.m_{c}), 0) * SUM({c} / r)) AS senti_mrr_{nm}")
        for k in ks:
            cols.append(f"greatest(0.0, coalesce(max(hs.m_{c}), 0) * SUM(CASE WHEN r <= {k} THEN {c} ELSE 0 END)) AS senti_at_{k}_{nm}")
    return [f"""hs AS (
  SELECT h.imp_id, SUM(n.senti_a) / {float(h)} AS m_senti_a, SUM(n.senti_b) / {float(h)} AS m_senti_b
  FROM fx_history h JOIN fx_news n USING (news_id) WHERE h.hpos <= {h} GROUP BY h.imp_id)""",
            f"""senti AS (
  SELECT rk.imp_id, {", ".join(cols)} FROM rk LEFT JOIN hs USING (imp_id) GROUP BY rk.imp_id)"""]


def _ils_sql(ks=KS):
    # brute force over candidate pairs (oracle side only)
    cols = []
    for k in ks:
        for c in ("senti_a", "senti_b"):
            cols.append(f"AVG(CASE WHEN a.r <= {k} AND b.r <= {k} THEN abs(a.{c} - b.{c}) / 2 END) AS ils_senti_at_{k}_{c}")
        cols.append(f"""AVG(CASE WHEN a.r <= {k} AND b.r <= {k} THEN
            CASE WHEN len(a.topics) = 0 OR len(b.topics) = 0 THEN 0.0
                 ELSE len(list_intersect(a.topics, b.topics)) / sqrt(len(a.topics) * len(b.topics)) END END) AS ils_topic_at_{k}""")
    return [f"""ils AS (
  SELECT a.imp_id, {", ".join(cols)} FROM rk a JOIN rk b ON a.imp_id = b.imp_id AND a.r < b.r GROUP BY a.imp_id)"""]


def _topic_sql(ks=KS, h=H):
    vk = ", ".join(f"SUM(CASE WHEN r <= {k} THEN 1.0 ELSE 0 END) AS v{k}" for k in ks)
    dots = ", ".join(
        f"CASE WHEN SUM(v{k} * v{k}) > 0 THEN SUM(coalesce(u, 0) * v{k}) / sqrt(SUM(v{k} * v{k})) ELSE 0 END AS topic_div_at_{k}"
        for k in ks)
    return [f"""ht AS (
  SELECT h.imp_id, t.topic, COUNT(*) AS cnt FROM fx_history h JOIN fx_news n USING (news_id),
       unnest(list_distinct([n.category, n.subcategory])) AS t(topic)
  WHERE h.hpos <= {h} GROUP BY h.imp_id, t.topic)""",
            """ut AS (SELECT imp_id, topic, cnt / sqrt(SUM(cnt * cnt) OVER (PARTITION BY imp_id)) AS u FROM ht)""",
            f"""ct AS (
  SELECT imp_id, t.topic, SUM(1.0 / r) AS vm, {vk} FROM rk, unnest(topics) AS t(topic) GROUP BY imp_id, t.topic)""",
            f"""topic AS (
  SELECT ct.imp_id,
    CASE WHEN SUM(vm * vm) > 0 THEN SUM(coalesce(u, 0) * vm) / sqrt(SUM(vm * vm)) ELSE 0 END AS topic_mrr, {dots}
  FROM ct LEFT JOIN ut ON ut.imp_id = ct.imp_id AND ut.topic = ct.topic GROUP BY ct.imp_id)"""]


def per_imp_sql(select: str, senti=True, topics=True, views_extra=()) -> str:
    ctes = [SCORED_SQL, RANKED_SQL, _perf_sql()]
    views = ["fx_candidates", "fx_news", "fx_history", *views_extra]
    if senti:
        ctes += _senti_sql() + _ils_sql()
    if topics:
        ctes += _topic_sql()
    joined = """allm AS (SELECT * FROM perf""" + (" LEFT JOIN senti USING (imp_id) LEFT JOIN ils USING (imp_id)"
                                                 if senti else "") + \
        (" LEFT JOIN topic USING (imp_id)" if topics else "") + ")"
    return with_views(views, select, H, ctes + [joined])


def _r(col):
    return f'round(CAST("{col}" AS DOUBLE), 6) AS "{col}"'


ALL_METRICS = (["auc", "mrr", "ndcg_at_5", "ndcg_at_10"]
               + [f"{m}_{c}" for c in SENTI for m in ("senti_mrr", "senti_at_5", "senti_at_10")]
               + ["topic_mrr", "topic_div_at_5", "topic_div_at_10"]
               + [f"ils_senti_at_{k}_{c}" for c in SENTI for k in KS]
               + ["ils_topic_at_5", "ils_topic_at_10"])


# ---- W1-W3, F3 ------------------------------------------------------------------------------------

@query("w1_rank_candidates", with_views(["fx_candidates"], """
SELECT imp_id, pos, news_id, label, round(score, 6) AS score,
       CAST(ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY score DESC, pos) AS BIGINT) AS rank
FROM scored""", extra=[SCORED_SQL]))
def w1_rank_candidates(spark, d):
    return finish(M.rank_candidates(_scored(spark, d)))


@query("w2_top_k_per_impression", with_views(["fx_candidates"], """
SELECT imp_id, news_id, rank FROM (
  SELECT imp_id, news_id, CAST(ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY score DESC, pos) AS BIGINT) AS rank
  FROM scored) WHERE rank <= 5""", extra=[SCORED_SQL]))
def w2_top_k(spark, d):
    from impressa.operators.ranking import top_k
    return finish(top_k(_scored(spark, d), 5).select("imp_id", "news_id", "rank"))


@query("w3_top_n_report", with_views(["fx_candidates", "fx_news"], """
SELECT t.imp_id, t.rank, t.news_id, n.title, n.category, t.label, round(t.score, 6) AS score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY score DESC, pos) AS BIGINT) AS rank FROM scored) t
JOIN fx_news n USING (news_id) WHERE t.rank <= 3""", extra=[SCORED_SQL]))
def w3_top_n_report(spark, d):
    from impressa.operators.ranking import top_n_report
    return finish(top_n_report(_scored(spark, d), fx.news(spark, d), 3, ["title", "category"]))


@query("f3_softmax", with_views(["fx_candidates"], """
SELECT imp_id, pos, round(e / SUM(e) OVER (PARTITION BY imp_id), 6) AS prob
FROM (SELECT imp_id, pos, exp(score - max(score) OVER (PARTITION BY imp_id)) AS e FROM scored)""", extra=[SCORED_SQL]))
def f3_softmax(spark, d):
    return finish(M.softmax(_scored(spark, d)).select("imp_id", "pos", "prob"))


# ---- M1-M9, M11 per impression ------------------------------------------------------------------

@query("m1_auc", per_imp_sql("SELECT imp_id, round(auc, 6) AS auc FROM perf WHERE auc IS NOT NULL",
                             senti=False, topics=False))
def m1_auc(spark, d):
    return finish(M.auc(_scored(spark, d)))


@query("m2_ndcg_at_10", per_imp_sql('SELECT imp_id, round("ndcg_at_10", 6) AS ndcg FROM perf WHERE "ndcg_at_10" IS NOT NULL',
                                    senti=False, topics=False))
def m2_ndcg(spark, d):
    return finish(M.ndcg(_scored(spark, d), 10))


@query("m3_mrr", per_imp_sql("SELECT imp_id, round(mrr, 6) AS mrr FROM perf WHERE mrr IS NOT NULL",
                             senti=False, topics=False))
def m3_mrr(spark, d):
    return finish(M.mrr(_scored(spark, d)))


@query("m3_mrr_at_5", with_views(["fx_candidates"], """
SELECT imp_id, round(SUM(CASE WHEN r <= 5 THEN label / r ELSE 0 END) / SUM(CASE WHEN r <= 5 THEN label ELSE 0 END), 6) AS mrr
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY score DESC, pos) AS r FROM scored)
GROUP BY imp_id HAVING SUM(CASE WHEN r <= 5 THEN label ELSE 0 END) > 0""", extra=[SCORED_SQL]))
def m3_mrr_at_5(spark, d):
    return finish(M.mrr(_scored(spark, d), 5))


def _metric_query(name, col, senti, topics):
    sql = per_imp_sql(f'SELECT imp_id, {_r(col)} FROM allm WHERE "{col}" IS NOT NULL', senti=senti, topics=topics)

    @query(name, sql)
    def fn(spark, d):
        per = _safe(_per_imp(spark, d, SENTI if senti else (), topics))
        return finish(per.select("imp_id", col).where(F.col(col).isNotNull()))
    return fn


_metric_query("m4_senti_mrr", "senti_mrr_senti_a", True, False)
_metric_query("m5_senti_at_5", "senti_at_5_senti_b", True, False)
_metric_query("m6_topic_mrr", "topic_mrr", False, True)
_metric_query("m7_topic_at_5", "topic_div_at_5", False, True)
_metric_query("m8_ils_senti_at_5", "ils_senti_at_5_senti_a", True, False)
_metric_query("m9_ils_topic_at_10", "ils_topic_at_10", True, True)


@query("m11_impression_metrics", per_imp_sql(
    "SELECT imp_id, CAST(n_cand AS BIGINT) AS n_cand, CAST(n_pos AS BIGINT) AS n_pos, "
    + ", ".join(_r(c) for c in ALL_METRICS) + " FROM allm"))
def m11_impression_metrics(spark, d):
    return finish(_safe(_per_imp(spark, d)))


def _bundle_sql(metrics, where=""):
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS v FROM allm {where}" for m in metrics)
    return f"""SELECT metric, round(AVG(v), 6) AS value, CAST(COUNT(v) AS BIGINT) AS n_used
FROM ({parts}) GROUP BY metric"""


@query("m10_test_bundle", per_imp_sql(_bundle_sql(ALL_METRICS)))
def m10_test_bundle(spark, d):
    per = _safe(_per_imp(spark, d))
    return finish(M.summarize(per, ALL_METRICS))


_VAL = ["auc", "mrr", "ndcg_at_5", "ndcg_at_10"] + [f"{m}_{c}" for c in SENTI
                                                    for m in ("senti_mrr", "senti_at_5", "senti_at_10")]


@query("m15_validation_bundle", per_imp_sql(_bundle_sql(_VAL), topics=False))
def m15_validation_bundle(spark, d):
    per = _safe(_per_imp(spark, d, SENTI, topics=False))
    return finish(M.summarize(per, _VAL))


@query("m13_random_baseline", with_views(["fx_candidates"], _bundle_sql(["auc", "mrr", "ndcg_at_5", "ndcg_at_10"]),
                                         extra=[SCORED_SQL.replace("FROM fx_candidates", """FROM fx_candidates
  WHERE imp_id IN (SELECT imp_id FROM fx_candidates GROUP BY imp_id HAVING SUM(label) > 0 AND SUM(label) < COUNT(*))"""),
                                                RANKED_SQL.replace("LEFT JOIN fx_news n USING (news_id)",
                                                                   "LEFT JOIN (SELECT NULL::BIGINT AS news_id, NULL::DOUBLE AS senti_a, NULL::DOUBLE AS senti_b, NULL AS category, NULL AS subcategory) n USING (news_id)"),
                                                _perf_sql(), "allm AS (SELECT * FROM perf)"]))
def m13_random_baseline(spark, d):
    cands = both_classes(fx.candidates(spark, d))
    per = _safe(M.performance(random_scores(cands), ks=KS))
    return finish(M.summarize(per, ["auc", "mrr", "ndcg_at_5", "ndcg_at_10"]))


@query("m12_first_impressions", per_imp_sql(
    "SELECT imp_id, round(auc, 6) AS auc, round(mrr, 6) AS mrr FROM allm ORDER BY imp_id LIMIT 100",
    senti=False, topics=False))
def m12_first_impressions(spark, d):
    per = M.performance(_scored(spark, d), ks=KS)
    return finish(M.first_impressions(per.select("imp_id", "auc", "mrr"), 100))


@query("m16_bundle_by_split", per_imp_sql(
    "SELECT i.split, x.metric, round(AVG(x.v), 6) AS value, CAST(COUNT(x.v) AS BIGINT) AS n_used FROM ("
    + " UNION ALL ".join(f"SELECT imp_id, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS v FROM allm"
                         for m in ["auc", "mrr", "topic_mrr", "ils_topic_at_5"])
    + ") x JOIN fx_impressions i USING (imp_id) GROUP BY i.split, x.metric", views_extra=("fx_impressions",)))
def m16_bundle_by_split(spark, d):
    """M16 compared per experiment: the same bundle on the train-period and test-period impressions."""
    from impressa.operators.report import experiments_long
    per = _safe(_per_imp(spark, d)).join(fx.impressions(spark, d).select("imp_id", "split"), "imp_id")
    return finish(experiments_long(per, "split", ["auc", "mrr", "topic_mrr", "ils_topic_at_5"]))
