"""Queries for sources and sinks (S1-S12): each writes a table derived from the driver's tables
in its log/storage format into the session's shared scratch folder, reads it back with the
source under test and returns what came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from impressa.operators import parse as P
from impressa.operators import sample as D
from impressa.operators import vocab as V
from impressa.plans.output import finish, rnd
from impressa.plans.registry import query
from impressa.sources import fixtures as fx
from impressa.sources import store as ST
from impressa.sources import tsv as TS
from impressa.sources.fixtures import with_views



def _raw(spark, d):
    return fx.raw_behaviors(spark, d)


def _flat(col):
    """TSV fields cannot hold tabs or line breaks."""
    return F.regexp_replace(F.col(col), r"[\t\r\n]+", " ")


@query("s1_read_behaviors_tsv", with_views(["fx_impressions", "fx_raw"], """
SELECT r.imp_id, r.user_id, CAST(i.time AS VARCHAR) AS time, r.history, r.impressions FROM fx_raw r JOIN fx_impressions i USING (imp_id)"""))
def s1_read_behaviors_tsv(spark, d):
    path = ST.scratch_path(spark, "behaviors")
    TS.write_tsv(_raw(spark, d).select(*TS.BEHAVIOR_COLUMNS), path)
    parsed = P.parse_behaviors(TS.read_behaviors(spark, path))
    shown = F.transform("candidates", lambda c: F.concat(c["news_id"], F.lit("-"), c["label"].cast("string")))
    return finish(parsed.select("imp_id", "user_id", "time", F.array_join("history", " ").alias("history"),
                                F.array_join(shown, " ").alias("impressions")))


def _news_lines(spark, d):
    a = fx.articles(spark, d)
    even = (F.col("row_key") % 2 == 0)
    return a.select("news_id", "category", "subcategory", _flat("title").alias("title"),
                    _flat("abstract").alias("abstract"),
                    F.concat(F.lit("https://news.example/"), F.col("news_id")).alias("url"),
                    F.when(even, "[]").otherwise("").alias("title_entities"),
                    F.when(even, "[]").otherwise("").alias("abstract_entities"))


@query("s2_read_news_tsv", with_views(["fx_articles"], """
SELECT news_id, category, subcategory, title, md5(regexp_replace(abstract, '[\\t\\r\\n]+', ' ', 'g')) AS abstract,
       'https://news.example/' || news_id AS url, CASE WHEN row_key % 2 = 0 THEN '[]' ELSE '' END AS entities FROM fx_articles"""))
def s2_read_news_tsv(spark, d):
    path = ST.scratch_path(spark, "news")
    TS.write_tsv(_news_lines(spark, d), path)
    return TS.read_news(spark, path).select("news_id", "category", "subcategory", "title", F.md5("abstract").alias("abstract"), "url",
                                            F.coalesce("title_entities", F.lit("")).alias("entities"))


@query("s3_load_splits", with_views(["fx_impressions", "fx_raw"], """
SELECT i.split, i.imp_id, r.user_id, CAST(i.time AS VARCHAR) AS time, r.impressions FROM fx_impressions i JOIN fx_raw r USING (imp_id)"""))
def s3_load_splits(spark, d):
    base = ST.scratch_path(spark, "dataset")
    raw = _raw(spark, d)
    for s in ("train", "test"):
        TS.write_tsv(raw.where(F.col("split") == s).select(*TS.BEHAVIOR_COLUMNS), f"{base}/{s}/behaviors.tsv")
    both = TS.load_splits(spark, base, "behaviors", ("train", "test"))
    parsed = P.parse_behaviors(both)
    shown = F.transform("candidates", lambda c: F.concat(c["news_id"], F.lit("-"), c["label"].cast("string")))
    return finish(parsed.select("split", "imp_id", "user_id", "time", F.array_join(shown, " ").alias("impressions")))


@query("s4_strict_lines", with_views(["fx_articles"], """
SELECT CASE WHEN row_key % 2 = 0 THEN 'good' ELSE 'rejected' END AS kind, CAST(count(*) AS BIGINT) AS n
FROM fx_articles GROUP BY 1"""))
def s4_strict_lines(spark, d):
    path = ST.scratch_path(spark, "news-strict")
    TS.write_tsv(_news_lines(spark, d), path)
    good, bad = TS.read_lines_strict(spark, path, TS.NEWS_COLUMNS, strip=True)
    g = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("kind"), "n")
    b = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("kind"), "n")
    return finish(g.unionByName(b))


VEC_SQL = """SELECT token, CAST(len(vec) AS BIGINT) AS dims, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS vec_sum
FROM fx_word_vectors"""


def _vec_out(v):
    return finish(v.select("token", F.size("vec").alias("dims"),
                           F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("vec_sum")))


@query("s5_read_text_vectors", with_views(["fx_word_vectors"], VEC_SQL))
def s5_read_text_vectors(spark, d):
    path = ST.scratch_path(spark, "vectors-txt")
    ST.write_text_vectors(fx.word_vectors(spark, d), path)
    good, _bad = ST.read_text_vectors(spark, path, dims=64)
    return _vec_out(good)


@query("s6_load_cached_vectors", with_views(["fx_word_vectors"], VEC_SQL))
def s6_load_cached_vectors(spark, d):
    path = ST.scratch_path(spark, "vectors-cache")
    ST.cache_vectors(fx.word_vectors(spark, d), path)
    return _vec_out(ST.load_cached_vectors(spark, path, 64))


def _word2int(spark, d):
    return _qp()._word2int(spark, d)


def _qp():
    from impressa.plans import q_prepare as QP
    return QP


@query("s7_dictionary_tsv", with_views(["fx_articles", "fx_word_vectors"], "SELECT key, idx FROM word2int",
                                       extra=[_qp().ART_TOKENS_SQL, _qp().WORD2INT_SQL]))
def s7_dictionary_tsv(spark, d):
    path = ST.scratch_path(spark, "word2int")
    TS.write_dictionary(_word2int(spark, d), path, fmt="tsv")
    return finish(TS.read_dictionary(spark, path, fmt="tsv"))


@query("s8_parsed_news_tsv", with_views(_qp().PARSED_NEWS_VIEWS, _qp().PARSED_NEWS_SQL, extra=_qp().PARSED_NEWS_CTES))
def s8_parsed_news_tsv(spark, d):
    path = ST.scratch_path(spark, "parsed-news")
    ST.write_parsed_news(_qp()._prepared(spark, d, with_history=False)["parsed_news"].drop("news_idx"), path, fmt="tsv")
    columns = ("news_id", "category", "subcategory", "title", "abstract", "senti_a", "senti_b")
    return _qp().news_out(ST.read_parsed_news(spark, path, fmt="tsv", columns=columns))


@query("s9_behavior_tables", "SELECT 'train' AS split, * FROM (" + with_views(
    _qp().TRAIN_ROWS_VIEWS, _qp().TRAIN_ROWS_SQL, extra=_qp().TRAIN_ROWS_CTES) + ") UNION ALL SELECT 'val', imp_id, 0, user, history, "
    "candidates, mask FROM (" + _qp()._eval_sql(f"r.split = 'train' AND {_qp().VAL_HASH.format(imp='c.imp_id')}")
    + ") UNION ALL SELECT 'test', imp_id, 0, user, history, candidates, mask FROM (" + _qp()._eval_sql("r.split = 'test'") + ")")
def s9_behavior_tables(spark, d):
    """Sampled training rows and unsampled validation and test rows in one partitioned dataset."""
    t = _qp()._prepared(spark, d)
    path = ST.scratch_path(spark, "behaviors-parquet")
    ST.write_behaviors({"train": t["train_rows"], "val": t["val_rows"], "test": t["test_rows"]}, path)
    back = None
    for split in ("train", "val", "test"):
        part = ST.read_behaviors_split(spark, path, split)
        back = part if back is None else back.unionByName(part)
    return _qp()._rows_out(back.withColumn("click_pos", F.coalesce("click_pos", F.lit(0))))


@query("s10_embedding_matrix_file", with_views(["fx_articles", "fx_word_vectors"], """
SELECT CAST(0 AS BIGINT) AS idx, CAST((SELECT max(len(vec)) FROM fx_word_vectors) AS BIGINT) AS dims, 0.0 AS vec_sum
UNION ALL
SELECT w.idx, CAST(len(v.vec) AS BIGINT), round(list_sum(list_transform(CAST(v.vec AS DOUBLE[]), lambda x: round(x, 6))), 4)
FROM word2int w JOIN fx_word_vectors v ON v.token = w.key""", extra=[_qp().ART_TOKENS_SQL, _qp().WORD2INT_SQL]))
def s10_embedding_matrix_file(spark, d):
    m = V.gather_vectors(_word2int(spark, d), fx.word_vectors(spark, d))
    path = ST.scratch_path(spark, "embedding")
    ST.write_embedding_matrix(m, path)
    back = ST.load_embedding_matrix(spark, path)
    return finish(back.select("idx", F.size("vec").alias("dims"),
                              rnd(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("vec_sum")))


@query("s11_dump_first_scored", with_views(["fx_candidates"], """
SELECT imp_id, CAST(count(*) AS BIGINT) AS n, round(SUM(round(score, 6)), 6) AS score_sum,
       string_agg(CAST(label AS VARCHAR), ' ' ORDER BY pos) AS labels
FROM scored WHERE imp_id IN (SELECT DISTINCT imp_id FROM fx_candidates ORDER BY imp_id LIMIT 102) GROUP BY imp_id""",
                                           extra=["""scored AS (
  SELECT imp_id, pos, label,
         CAST(CAST(('0x' || substr(md5(concat_ws('|', CAST(imp_id AS VARCHAR), CAST(news_id AS VARCHAR))), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS score
  FROM fx_candidates)"""]))
def s11_dump_first_scored(spark, d):
    from impressa.plans.evaluate import random_scores
    path = ST.scratch_path(spark, "dump")
    ST.dump_first(random_scores(fx.candidates(spark, d)), path)
    back = spark.read.option("header", "true").csv(path)
    s = F.split("scores", " ")
    return finish(back.select(F.col("imp_id").cast("long").alias("imp_id"), F.size(s).alias("n"),
                              F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double")).alias("score_sum"),
                              "labels"))


@query("s12_write_sampled_behaviors", with_views(["fx_impressions"], "SELECT imp_id FROM picked",
                                                 extra=[_qp().SAMPLE_SQL]))
def s12_write_sampled_behaviors(spark, d):
    raw = _raw(spark, d)
    sampled = D.sample_exact(raw, 1000, 1234)
    path = ST.scratch_path(spark, "sampled")
    TS.write_tsv(sampled.select(*TS.BEHAVIOR_COLUMNS), path)
    return finish(TS.read_behaviors(spark, path).select("imp_id"))
