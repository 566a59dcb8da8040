"""Queries for batch scoring with supplied vectors and weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from impressa.functions.scalar import dot
from impressa.operators import scoring as B
from impressa.operators import vocab as V
from impressa.operators.skew import in_waves
from impressa.plans.output import finish
from impressa.plans.registry import query
from impressa.session import cut_lineage, stored
from impressa.sources import fixtures as fx
from impressa.sources.fixtures import with_views

H = 50  # history items a user vector is made of
DIM = 64
ATT = 4

# A tiny deterministic "trained model" (weights are parameters, data come from tables).
_rng = np.random.RandomState(11)
W_ATT = _rng.normal(0, 0.2, (ATT, DIM)).round(4)
B_ATT = _rng.normal(0, 0.1, ATT).round(4)
Q_ATT = _rng.normal(0, 1.0, ATT).round(4)
W_CAT = _rng.normal(0, 0.2, (ATT, DIM)).round(4)
B_CAT = _rng.normal(0, 0.1, ATT).round(4)
W_SENT = _rng.normal(0, 0.2, (ATT, DIM + 1)).round(4)
W_PRED = _rng.normal(0, 0.2, DIM).round(4)
B_PRED = 0.05


def _views(views, body, extra=None):
    return with_views(views, body, H, extra)


def _dl(v) -> str:
    return "CAST([" + ", ".join(repr(float(x)) for x in v) + "] AS DOUBLE[])"


def _logit_sql(x: str, w=W_ATT, b=B_ATT, q=Q_ATT) -> str:
    return " + ".join(f"({float(q[a])!r}) * tanh(list_dot_product(CAST({x} AS DOUBLE[]), {_dl(w[a])}) + ({float(b[a])!r}))"
                      for a in range(len(q)))


def _pool_sql(name: str, src: str, group: str, logit_of: str, out: str) -> list[str]:
    """attention pooling of (group, vec) rows of ``src`` in DuckDB."""
    return [f"""{name}_a AS (
  SELECT {group}, vec, exp(lg - max(lg) OVER (PARTITION BY {group})) AS e FROM (SELECT {group}, vec, {logit_of} AS lg FROM {src}))""",
            f"""{name}_w AS (SELECT {group}, vec, e / SUM(e) OVER (PARTITION BY {group}) AS alpha FROM {name}_a)""",
            f"""{name} AS (
  SELECT {group}, list(v ORDER BY d) AS {out} FROM (
    SELECT {group}, d, SUM(alpha * vec[d]) AS v FROM {name}_w, generate_series(1, len(vec)) AS t(d) GROUP BY {group}, d)
  GROUP BY {group})"""]


HIST_ITEMS_SQL = """hist_items AS (SELECT h.imp_id, v.vec FROM fx_history h JOIN fx_vectors v USING (news_id))"""


def _user_vecs(spark, d, weighted=True):
    hist, tasks = fx.history(spark, d, with_reader=True), fx.tasks(spark, d)
    if weighted:
        return B.user_vectors(hist, fx.vectors(spark, d), W_ATT, B_ATT, Q_ATT, max_history=H, tasks=tasks)
    return B.user_vectors(hist, fx.vectors(spark, d), max_history=H, tasks=tasks)


def _vec_summary(col):
    return [F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("vec_sum"),
            F.element_at(col, 1).cast("double").alias("v1")]


VEC_SUM_SQL = "round(list_sum(CAST({c} AS DOUBLE[])), 6) AS vec_sum, round(CAST({c}[1] AS DOUBLE), 6) AS v1"


@query("b1_embed_tokens", _views(["fx_bench_tokens", "fx_word_vectors"], f"""
SELECT b.item_id, b.tpos, CAST(v.idx AS BIGINT) AS idx, {VEC_SUM_SQL.format(c='w.vec')}
FROM bench_tok b JOIN vocab v ON v.key = b.token JOIN weights w ON w.idx = v.idx""",
                                     extra=["""bench_tok AS (
  SELECT item_id, unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token,
         generate_subscripts(regexp_extract_all(lower(trim(text)), '@TOKEN@'), 1) - 1 AS tpos FROM benchmark)""",
                                            """vocab AS (SELECT token AS key, ROW_NUMBER() OVER (ORDER BY token) AS idx FROM fx_bench_tokens)""",
                                            """weights AS (SELECT v.idx, w.vec FROM vocab v JOIN fx_word_vectors w ON w.token = v.key)"""]))
def b1_embed_tokens(spark, d):
    b = fx.table(spark, d, "benchmark")
    vocab = V.sorted_ids(b.select(F.explode(B_tokens("text")).alias("key")))
    weights = V.gather_vectors(vocab, fx.word_vectors(spark, d))
    toks = V.tokens_long(b, "item_id", "text").join(vocab.withColumnRenamed("key", "token"), "token")
    out = B.embed_tokens(toks.select("item_id", "tpos", "idx"), weights)
    return finish(out.select("item_id", "tpos", "idx", *_vec_summary(F.col("vec"))))


def B_tokens(c):
    from impressa.functions.text import tokenize
    return tokenize(c)


@query("b2_attention_pool_history", _views(["fx_history", "fx_vectors"], f"""
SELECT imp_id, {VEC_SUM_SQL.format(c='user_vec')} FROM uv""",
                                               extra=[HIST_ITEMS_SQL] + _pool_sql("uv", "hist_items", "imp_id",
                                                                                  _logit_sql("vec"), "user_vec")))
def b2_attention_pool_history(spark, d):
    return finish(_user_vecs(spark, d).select("imp_id", *_vec_summary(F.col("user_vec"))))


MAX_TEXT = 50
ARTICLES_A_TASK = 7500  # whose tokens and vectors one task moves, about


def _b3_sql():
    parts = [f"tanh(list_dot_product(v, {_dl(W_ATT[a])}))" for a in range(ATT)]
    return _views(["fx_articles", "fx_word_vectors"], f"""
SELECT news_id, round({" + ".join(parts)}, 6) AS vec_sum, round({parts[0]}, 6) AS v1 FROM (
  SELECT news_id, list(x ORDER BY d) AS v FROM (
    SELECT news_id, d, AVG(CAST(vec[d] AS DOUBLE)) AS x FROM tv, generate_series(1, len(vec)) AS t(d) GROUP BY news_id, d)
  GROUP BY news_id)""", extra=[f"""tv AS (
  SELECT news_id, vec FROM (
    SELECT t.news_id, w.vec, ROW_NUMBER() OVER (PARTITION BY t.news_id ORDER BY t.tpos) AS rn FROM (
      SELECT news_id, unnest(regexp_extract_all(lower(trim(abstract)), '@TOKEN@')) AS token,
             generate_subscripts(regexp_extract_all(lower(trim(abstract)), '@TOKEN@'), 1) AS tpos FROM fx_articles) t
    JOIN fx_word_vectors w USING (token)) WHERE rn <= {MAX_TEXT})"""])


@query("b3_encode_catalogue", _b3_sql())
def b3_encode_catalogue(spark, d):
    """B3 with a caller kernel (tanh of a projected mean) over the first known tokens of every abstract."""
    w = W_ATT.T  # (64, 4)

    def kernel(batch, mask):
        return np.tanh(batch.sum(axis=1) / mask.sum(axis=1)[:, None] @ w)

    arts = fx.articles(spark, d)
    vec = stored(fx.word_vectors(spark, d))
    tasks = -(-fx.news(spark, d).count() // ARTICLES_A_TASK)

    def first_places(part, n):  # of every token of a wave's articles
        toks = V.field_tokens(part(arts), ["row_key"])
        return toks.groupBy("token").agg(F.min(F.struct("row_key", "_field", "tpos")).alias("_at")).select("token", "_at.*")

    w2i = V.word_ids(arts, vec, ["row_key"], tokens=in_waves(first_places, "news_id", tasks))
    weights = stored(V.gather_vectors(w2i, vec))

    def encoded(part, n):
        toks = V.tokens_long(part(arts), "news_id", "abstract").join(w2i.withColumnRenamed("key", "token"), "token")
        enc = B.encode_catalogue(toks.select("news_id", "tpos", "idx"), weights, kernel, ATT, max_len=MAX_TEXT, kept=True)
        return enc.select("news_id", *_vec_summary(F.col("vec")))

    return finish(in_waves(encoded, "news_id", tasks))


CAT_EMB_SQL = """cat_emb AS (
  SELECT c.category, e.embedding AS vec FROM (SELECT DISTINCT category FROM fx_news) c
  JOIN embeddings e ON e.vec_id = CAST(('0x' || substr(md5(c.category), 1, 8)) AS BIGINT) % (SELECT count(*) FROM embeddings))"""


def _cat_emb(spark, d, col="category"):
    from impressa.functions.scalar import hash_int32
    e = fx.table(spark, d, "embeddings")
    c = fx.news(spark, d).select(F.col(col).alias("category")).distinct() \
        .withColumn("vec_id", F.pmod(hash_int32("category"), F.lit(e.count())))
    return c.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("category", "vec")


def _relu_lin_sql(x, w, b):
    return "[" + ", ".join(f"greatest(0.0, list_dot_product(CAST({x} AS DOUBLE[]), {_dl(w[a])}) + ({float(b[a])!r}))"
                           for a in range(len(b))) + "]"


@query("b4_category_vectors", _views(["fx_news"], f"""
SELECT category, {VEC_SUM_SQL.format(c='v')} FROM (SELECT category, {_relu_lin_sql('vec', W_CAT, B_CAT)} AS v FROM cat_emb)""",
                                         extra=[CAT_EMB_SQL]))
def b4_category_vectors(spark, d):
    cv = B.category_vectors(_cat_emb(spark, d), W_CAT, B_CAT)
    return finish(cv.select("category", *_vec_summary(F.col("vec"))))


@query("b5_fuse_views", _views(["fx_news", "fx_vectors"], f"""
SELECT news_id, {VEC_SUM_SQL.format(c='vec')} FROM fused""",
                                   extra=[CAT_EMB_SQL.replace("cat_emb AS", "cat_emb0 AS"),
                                          CAT_EMB_SQL.replace("cat_emb AS", "sub_emb0 AS").replace("category", "subcategory"),
                                          """views AS (
  SELECT news_id, vec FROM fx_vectors
  UNION ALL SELECT n.news_id, c.vec FROM fx_news n JOIN cat_emb0 c ON c.category = n.category
  UNION ALL SELECT n.news_id, s.vec FROM fx_news n JOIN sub_emb0 s ON s.subcategory = n.subcategory)"""]
                                   + _pool_sql("fused", "views", "news_id", _logit_sql("vec"), "vec")))
def b5_fuse_views(spark, d):
    n = fx.news(spark, d)
    cat = n.select("news_id", "category").join(_cat_emb(spark, d), "category").select("news_id", "vec")
    sub = n.select("news_id", F.col("subcategory").alias("category")).join(_cat_emb(spark, d, "subcategory"),
                                                                           "category").select("news_id", "vec")
    views = fx.vectors(spark, d).select("news_id", "vec").unionByName(cat).unionByName(sub)
    fused = B.fuse_views(views, W_ATT, B_ATT, Q_ATT)
    return finish(fused.select("news_id", *_vec_summary(F.col("vec"))))


@query("b6_sentiment_aware_vectors", _views(["fx_news", "fx_vectors"], f"""
SELECT news_id, {VEC_SUM_SQL.format(c='v')} FROM (
  SELECT v.news_id, [{", ".join(f"list_dot_product(list_concat(CAST(v.vec AS DOUBLE[]), [n.senti_a]), {_dl(W_SENT[a])})" for a in range(ATT))}] AS v
  FROM fx_vectors v JOIN fx_news n USING (news_id))"""))
def b6_sentiment_aware_vectors(spark, d):
    nv = fx.vectors(spark, d).join(fx.news(spark, d).select("news_id", "senti_a"), "news_id")
    out = B.sentiment_aware(nv, "senti_a", W_SENT)
    return finish(out.select("news_id", *_vec_summary(F.col("vec"))))


@query("b7_predict_sentiment", _views(["fx_vectors"], f"""
SELECT news_id, round(list_dot_product(CAST(vec AS DOUBLE[]), {_dl(W_PRED)}) + {B_PRED}, 6) AS s_hat FROM fx_vectors"""))
def b7_predict_sentiment(spark, d):
    return finish(B.predict_sentiment(fx.vectors(spark, d), W_PRED, B_PRED).select("news_id", "s_hat"))


@query("b8_mean_user_vectors", _views(["fx_history", "fx_vectors"], f"""
SELECT imp_id, {VEC_SUM_SQL.format(c='user_vec')} FROM (
  SELECT imp_id, list(v ORDER BY d) AS user_vec FROM (
    SELECT imp_id, d, AVG(CAST(vec[d] AS DOUBLE)) AS v FROM hist_items, generate_series(1, len(vec)) AS t(d) GROUP BY imp_id, d)
  GROUP BY imp_id)""", extra=[HIST_ITEMS_SQL]))
def b8_mean_user_vectors(spark, d):
    return finish(_user_vecs(spark, d, weighted=False).select("imp_id", *_vec_summary(F.col("user_vec"))))


@query("b9_long_term_users", _views(["fx_impressions", "fx_history", "fx_vectors"], f"""
SELECT i.imp_id, CAST(128 AS BIGINT) AS dims,
       round(coalesce(list_sum(CAST(e.embedding AS DOUBLE[])), 0) + coalesce(list_sum(r.user_vec), 0), 6) AS vec_sum
FROM fx_impressions i LEFT JOIN embeddings e ON e.vec_id = i.user_id % (SELECT count(*) FROM embeddings) AND i.user_id % 3 <> 0
LEFT JOIN (SELECT imp_id, list(v ORDER BY d) AS user_vec FROM (
    SELECT imp_id, d, AVG(CAST(vec[d] AS DOUBLE)) AS v FROM hist_items, generate_series(1, len(vec)) AS t(d) GROUP BY imp_id, d)
  GROUP BY imp_id) r USING (imp_id)""", extra=[HIST_ITEMS_SQL]))
def b9_long_term_users(spark, d):
    """Users with user_id % 3 == 0 have no long-term vector (unknown -> zeros)."""
    cands = fx.candidates(spark, d)
    rows = cut_lineage(fx.impressions(spark, d, cands))
    imps = rows.withColumnRenamed("user_id", "user")
    e = fx.table(spark, d, "embeddings")
    users = imps.select("user").distinct().where(F.col("user") % 3 != 0) \
        .withColumn("vec_id", F.pmod("user", F.lit(e.count()))).join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id") \
        .select("user", "vec")
    hist = fx.history(spark, d, rows, cands, with_reader=True)
    out = B.long_term_users(fx.with_reader(imps, rows), users, None, "con", history=hist, news_vecs=fx.vectors(spark, d), max_history=H,
                            tasks=fx.tasks(spark, d))
    return finish(out.select("imp_id", F.size("user_vec").alias("dims"),
                             F.aggregate("user_vec", F.lit(0.0), lambda a, x: a + x).alias("vec_sum")))


@query("b10_score_candidates", _views(["fx_candidates", "fx_history", "fx_vectors"], """
SELECT c.imp_id, c.pos, round(coalesce(list_dot_product(CAST(v.vec AS DOUBLE[]), u.user_vec), 0.0), 6) AS score
FROM fx_candidates c LEFT JOIN fx_vectors v USING (news_id) LEFT JOIN uv u USING (imp_id)""",
                                          extra=[HIST_ITEMS_SQL] + _pool_sql("uv", "hist_items", "imp_id",
                                                                             _logit_sql("vec"), "user_vec")))
def b10_score_candidates(spark, d):
    cands = fx.candidates(spark, d)
    imps = cut_lineage(fx.impressions(spark, d, cands))
    hist = fx.history(spark, d, imps, cands, with_reader=True)
    cands = stored(fx.with_reader(cands, imps).select("reader", "imp_id", "pos", "news_id"))
    s = B.score_shared(cands, hist, fx.vectors(spark, d), W_ATT, B_ATT, Q_ATT,
                       max_history=H, tasks=fx.tasks(spark, d))
    return finish(s.select("imp_id", "pos", "score"))


@query("b10_dot_product_pairs", _views(["fx_vectors"], """
SELECT a.news_id, round(list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS dot
FROM fx_vectors a JOIN embeddings e ON e.vec_id = (7 * a.news_id) % (SELECT count(*) FROM embeddings)"""))
def b10_dot_product_pairs(spark, d):
    e = fx.table(spark, d, "embeddings")
    a = fx.vectors(spark, d).withColumn("vec_id", F.pmod(F.col("news_id") * 7, F.lit(e.count())))
    j = a.join(e.select("vec_id", F.col("embedding").alias("other")), "vec_id")
    return finish(j.select("news_id", dot("vec", "other").alias("dot")))


READER_ITEMS = 20  # benchmark items that one reader has: the readers grow with the table
READER_SQL = f"item_id // {READER_ITEMS}"


@query("b11_adhoc_scores", _views(["fx_word_vectors"], """
SELECT c.item_id, round(list_dot_product(c.vec, r.user_vec), 6) AS score
FROM iv c JOIN rv r ON r.reader = """ + READER_SQL.replace("item_id", "c.item_id") + " WHERE c.item_id % 2 = 0",
                                  extra=["""tv AS (
  SELECT b.item_id, w.vec FROM (SELECT item_id, unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token FROM benchmark) b
  JOIN fx_word_vectors w USING (token))"""] + _pool_sql("iv", "tv", "item_id", _logit_sql("vec"), "vec")
                                  + [f"hv AS (SELECT {READER_SQL} AS reader, vec FROM iv WHERE item_id % 2 = 1)"]
                                  + _pool_sql("rv", "hv", "reader", _logit_sql("vec"), "user_vec")))
def b11_adhoc_scores(spark, d):
    """Ad-hoc texts, encoded with an existing dictionary and pooled by attention: odd benchmark items
    are the histories of readers of 20 items each, even ones their candidates."""
    b = fx.table(spark, d, "benchmark")
    vec = fx.word_vectors(spark, d)
    w2i = V.sorted_ids(vec.select(F.col("token").alias("key")))
    ids = V.encode_batch(b, w2i, "item_id", "text", on_missing="drop")
    toks = ids.select("item_id", F.posexplode("ids").alias("tpos", "idx")).where(F.col("idx") != 0)
    vecs = B.embed_tokens(toks, V.gather_vectors(w2i, vec))
    items = B.attention_pool(vecs, "item_id", "vec", W_ATT, B_ATT, Q_ATT) \
        .withColumn("reader", F.floor(F.col("item_id") / READER_ITEMS))
    readers = B.attention_pool(items.where(F.col("item_id") % 2 == 1), "reader", "vec", W_ATT, B_ATT, Q_ATT, out="user_vec")
    out = items.where(F.col("item_id") % 2 == 0).join(readers, "reader")
    return finish(out.select("item_id", dot("vec", "user_vec").alias("score")))


# A click model's weights, for scoring that does not depend on a fit.
CLICK_WEIGHTS = {"npmi": 1.5, "dot": 0.02, "topic_overlap": 0.4, "senti_a": -0.3}
CLICK_BIAS = -1.0


def _click_rows(spark, d, split=None):
    """D1 rows, one per slot, with the features of the click model; those of one ``split`` only, if named."""
    from impressa.operators import cooccur as C
    from impressa.operators import parse as P
    from impressa.operators import sample as D
    from impressa.operators import metrics as M
    from impressa.operators.skew import lookup_join
    cands = cut_lineage(fx.candidates(spark, d))
    imps = cut_lineage(fx.impressions(spark, d, cands))
    hist = fx.history(spark, d, imps, cands, with_reader=True)
    news = fx.news(spark, d)
    kept = imps if split is None else imps.where(fx.is_split(split))
    lines = cands if split is None else cands.join(kept.select("imp_id"), "imp_id", "left_semi")
    rows = D.training_rows(D.negative_draw(P.candidate_lines(lines), 4, 1234), 4)
    slots = stored(fx.with_reader(rows.select("imp_id", "click_pos", F.posexplode("candidates").alias("slot", "news_id"))
                                  .withColumn("pos", F.col("click_pos") * 10 + F.col("slot")), imps))
    train = imps.where(fx.is_split("train"))
    table = stored(C.learn_npmi(hist.join(train.select("imp_id"), "imp_id"), train, catalogue=news, reader="reader"))
    # only the histories of impressions with slots are looked up below
    hist = stored(hist.join(slots.select("imp_id").distinct(), "imp_id", "left_semi"))
    # every step is stored, which releases its shuffle files
    x = stored(C.max_npmi_scores(slots, hist, table).withColumnRenamed("score", "npmi"))
    x = stored(B.score_shared(x, hist, fx.vectors(spark, d), max_history=H, tasks=fx.tasks(spark, d)).withColumnRenamed("score", "dot"))
    x = lookup_join(x, news.select("news_id", "senti_a", M.topic_array(news).alias("_t")), ["news_id"])
    counts = M.history_topic_counts(hist, news, H)
    shared = x.select("imp_id", "pos", F.explode("_t").alias("topic")).join(counts, ["imp_id", "topic"]) \
        .groupBy("imp_id", "pos").agg(F.sum("cnt").alias("topic_overlap"))
    x = x.join(shared, ["imp_id", "pos"], "left").withColumn("topic_overlap", F.coalesce("topic_overlap", F.lit(0.0)))
    return x.join(kept.select("imp_id", "split"), "imp_id").withColumn("label", (F.col("slot") == 0).cast("int")) \
        .select("imp_id", "click_pos", "slot", "news_id", "split", "label", *CLICK_WEIGHTS)


def _click_sql():
    from impressa.plans.q_cooccur import NPMI_SQL
    from impressa.plans.q_prepare import _floyd_sql
    ctes = [*_floyd_sql(), """slots AS (
  SELECT DISTINCT imp_id, click_pos, 0 AS slot, pos_news AS news_id FROM draws
  UNION ALL SELECT imp_id, click_pos, draw, neg_news FROM draws)""", *NPMI_SQL[:5], """hd AS (SELECT DISTINCT imp_id, news_id FROM fx_history)""",
            """best AS (SELECT s.imp_id, s.click_pos, s.slot, max(n.npmi) AS npmi FROM slots s JOIN hd h USING (imp_id)
  JOIN npmi n ON n.i = least(s.news_id, h.news_id) AND n.j = greatest(s.news_id, h.news_id) GROUP BY 1, 2, 3)""",
            f"""hist_items AS (SELECT h.imp_id, v.vec FROM fx_history h JOIN fx_vectors v USING (news_id) WHERE h.hpos <= {H})""",
            """um AS (SELECT imp_id, list(v ORDER BY d) AS user_vec FROM (
    SELECT imp_id, d, AVG(CAST(vec[d] AS DOUBLE)) AS v FROM hist_items, generate_series(1, len(vec)) AS t(d) GROUP BY imp_id, d)
  GROUP BY imp_id)""",
            "nt AS (SELECT news_id, unnest(list_distinct([category, subcategory])) AS topic FROM fx_news)",
            f"""tc AS (SELECT h.imp_id, t.topic, count(*) AS cnt FROM fx_history h JOIN nt t USING (news_id) WHERE h.hpos <= {H} GROUP BY 1, 2)""",
            """ov AS (SELECT s.imp_id, s.click_pos, s.slot, SUM(tc.cnt) AS topic_overlap FROM slots s JOIN nt t USING (news_id)
  JOIN tc ON tc.imp_id = s.imp_id AND tc.topic = t.topic GROUP BY 1, 2, 3)""",
            """feat AS (
  SELECT s.imp_id, s.click_pos, s.slot, s.news_id, coalesce(b.npmi, 0.0) AS npmi,
         coalesce(list_dot_product(CAST(v.vec AS DOUBLE[]), u.user_vec), 0.0) AS dot,
         CAST(coalesce(o.topic_overlap, 0) AS DOUBLE) AS topic_overlap, n.senti_a
  FROM slots s LEFT JOIN best b USING (imp_id, click_pos, slot) JOIN fx_news n USING (news_id) LEFT JOIN fx_vectors v USING (news_id)
  LEFT JOIN um u USING (imp_id) LEFT JOIN ov o USING (imp_id, click_pos, slot))"""]
    logit = " + ".join(f"({w!r}) * {c}" for c, w in CLICK_WEIGHTS.items())
    return with_views(["fx_impressions", "fx_candidates", "fx_history", "fx_news", "fx_vectors"], f"""
SELECT imp_id, click_pos, slot, news_id, round(npmi, 6) AS npmi, round(dot, 6) AS dot, topic_overlap, round(senti_a, 6) AS senti_a,
       round(1.0 / (1.0 + exp(-({logit} + ({CLICK_BIAS!r})))), 6) AS score FROM feat""", extra=ctes)


@query("b12_click_scores", _click_sql())
def b12_click_scores(spark, d):
    """B12 with fixed weights: the features of every D1 slot and its click probability."""
    x = _click_rows(spark, d)
    logit = sum((F.col(c) * F.lit(w) for c, w in CLICK_WEIGHTS.items()), F.lit(CLICK_BIAS))
    return finish(x.select("imp_id", "click_pos", F.col("slot").cast("long").alias("slot"), "news_id", *CLICK_WEIGHTS,
                           (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("score")))


@query("b12_click_model")
def b12_click_model(spark, d):
    """Logistic click model fit on the train-period D1 rows, evaluated on the test-period ones,
    each row a click among its drawn non-clicks."""
    from impressa.operators import metrics as M
    s = stored(_click_rows(spark, d).select("imp_id", "click_pos", "slot", "news_id", "split", "label", *CLICK_WEIGHTS))  # both splits, and each pass of the fit
    va, model = B.fit_click_model(s.where(F.col("split") == "train"), list(CLICK_WEIGHTS))
    scored = B.apply_click_model(s.where(F.col("split") == "test"), va, model)
    row = F.concat_ws("|", "imp_id", "click_pos")
    per = M.performance(scored.select(row.alias("imp_id"), F.col("slot").alias("pos"), "news_id", "label", "score"), ks=(5, 10))
    per = per.select("imp_id", "auc", "mrr", F.col("`ndcg@5`").alias("ndcg_at_5"))
    return finish(M.summarize(per, ["auc", "mrr", "ndcg_at_5"]))
