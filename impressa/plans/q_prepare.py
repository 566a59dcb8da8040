"""Queries for log parsing, padding, dictionaries, sampling and feature joins
(P1-P13, P16, V1-V13, D1-D7, J1-J4, J7, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from impressa.functions import scalar as S
from impressa.functions.text import ABBREVIATIONS, INITIALS, SPACE_RUN, STOPPED, TOKEN_RULES, rule_words, tokenize, tokenize_rules
from impressa.operators import parse as P
from impressa.operators import sample as D
from impressa.operators import vocab as V
from impressa.plans.output import finish, rnd
from impressa.plans.registry import query
from impressa.session import cut_lineage, stored
from impressa.sources import fixtures as fx
from impressa.sources.fixtures import with_views



def _parsed(spark, d, with_history=False):
    return P.parse_behaviors(fx.raw_behaviors(spark, d, with_history))


def _num(col):
    """'N123' -> 123 (the fixture's article ids)."""
    return F.substring(F.col(col) if isinstance(col, str) else col, 2, 100).cast("long")


# ---- P: parsing and padding ---------------------------------------------------------------------

@query("p1_parse_impressions", with_views(["fx_candidates"], """
SELECT imp_id, pos, 'N' || CAST(news_id AS VARCHAR) AS news_id, label FROM fx_candidates"""))
def p1_parse_impressions(spark, d):
    raw = fx.raw_behaviors(spark, d, with_history=False)
    return finish(raw.select("imp_id", F.inline(P.parse_impressions("impressions"))))


@query("p2_parse_impressions_dash", with_views(["fx_candidates"], """
SELECT imp_id, pos, 'N' || CAST(news_id AS VARCHAR) AS news_id, label FROM fx_candidates"""))
def p2_parse_impressions_dash(spark, d):
    raw = fx.raw_behaviors(spark, d, with_history=False)
    return finish(raw.select("imp_id", F.inline(P.parse_impressions_dash("impressions"))))


@query("p3_explode_impressions", with_views(["fx_candidates", "fx_impressions"], """
SELECT c.imp_id, 'N' || CAST(c.news_id AS VARCHAR) AS news_id, CAST(i.time AS VARCHAR) AS time, c.label
FROM fx_candidates c JOIN fx_impressions i USING (imp_id)"""))
def p3_explode_impressions(spark, d):
    ex = P.explode_impressions(_parsed(spark, d))
    return finish(ex.select("imp_id", "news_id", "time", "label"))


@query("p4_history_length", with_views(["fx_impressions", "fx_history"], """
SELECT i.imp_id, CAST(count(h.news_id) AS BIGINT) AS history_len
FROM fx_impressions i LEFT JOIN fx_history h USING (imp_id) GROUP BY i.imp_id"""))
def p4_history_length(spark, d):
    return finish(_parsed(spark, d, True).select("imp_id", F.size("history").alias("history_len")))


@query("p5_explode_with_default", with_views(["fx_impressions", "fx_history"], """
SELECT i.imp_id, coalesce(h.news_id, -1) AS news_id
FROM fx_impressions i LEFT JOIN fx_history h USING (imp_id)"""))
def p5_explode_with_default(spark, d):
    p = _parsed(spark, d, True).select("imp_id", F.transform("history", lambda x: _num(x)).alias("ids"))
    return finish(P.explode_with_default(p, "ids", -1, "news_id").select("imp_id", "news_id"))


@query("p6_parse_time", with_views(["fx_impressions"], """
SELECT imp_id, CAST(time AS VARCHAR) AS time FROM fx_impressions"""))
def p6_parse_time(spark, d):
    return finish(_parsed(spark, d).select("imp_id", "time"))


@query("p7_trainable_impressions", with_views(["fx_candidates"], """
SELECT imp_id, CAST(SUM(label) AS BIGINT) AS n_pos, CAST(SUM(1 - label) AS BIGINT) AS n_neg
FROM fx_candidates GROUP BY imp_id HAVING SUM(label) >= 1 AND SUM(1 - label) >= 4"""))
def p7_trainable_impressions(spark, d):
    t = P.trainable(_parsed(spark, d), 4)
    return finish(t.select("imp_id",
                           F.size(F.filter("candidates", lambda c: c["label"] == 1)).alias("n_pos"),
                           F.size(F.filter("candidates", lambda c: c["label"] == 0)).alias("n_neg")))


@query("p8_pad_candidates", with_views(["fx_candidates"], """
SELECT imp_id, array_to_string(list_resize(list(news_id ORDER BY pos), 5, 0), ' ') AS ids
FROM fx_candidates GROUP BY imp_id"""))
def p8_pad_candidates(spark, d):
    p = _parsed(spark, d).select("imp_id", F.transform("candidates", lambda c: _num(c["news_id"])).alias("ids"))
    return p.select("imp_id", F.array_join(S.pad_right("ids", 5, 0), " ").alias("ids"))


HIST_PAD_SQL = with_views(["fx_impressions", "fx_history"], """
SELECT i.imp_id, array_to_string(list_concat(list_resize([0], greatest(0, 10 - coalesce(len(h.l), 0)), 0),
                                             coalesce(h.l[1:10], [])), ' ') AS ids
FROM fx_impressions i LEFT JOIN (SELECT imp_id, list(news_id ORDER BY hpos) AS l FROM fx_history GROUP BY imp_id) h
USING (imp_id)""")


@query("p9_pad_history", HIST_PAD_SQL)
def p9_pad_history(spark, d):
    p = _parsed(spark, d, True).select("imp_id", F.transform("history", lambda x: _num(x)).alias("ids"))
    return p.select("imp_id", F.array_join(S.pad_left_keep_first("ids", 10, 0), " ").alias("ids"))


@query("p10_pad_fixed_length", with_views(["fx_impressions", "fx_history"], """
SELECT i.imp_id, array_to_string(list_resize(coalesce(h.l, []), 20, -1), ' ') AS ids
FROM fx_impressions i LEFT JOIN (SELECT imp_id, list(news_id ORDER BY hpos) AS l FROM fx_history GROUP BY imp_id) h
USING (imp_id)"""))
def p10_pad_fixed_length(spark, d):
    p = _parsed(spark, d, True).select("imp_id", F.transform("history", lambda x: _num(x)).alias("ids"))
    return p.select("imp_id", F.array_join(S.pad_right("ids", 20, -1), " ").alias("ids"))


USER2INT_SQL = """user2int AS (
  SELECT key, CAST(ROW_NUMBER() OVER (ORDER BY t, imp_id) AS BIGINT) AS idx FROM (
    SELECT 'U' || CAST(user_id AS VARCHAR) AS key, time AS t, imp_id,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY time, imp_id) AS rn
    FROM fx_impressions WHERE split = 'train') WHERE rn = 1)"""


def _user2int(parsed):
    train = parsed.where(F.col("split") == "train")
    return V.first_seen_ids(train, "user_id", ["time", "imp_id"])


@query("p12_user_index", with_views(["fx_impressions"], """
SELECT i.imp_id, coalesce(u.idx, 0) AS user FROM fx_impressions i
LEFT JOIN user2int u ON u.key = 'U' || CAST(i.user_id AS VARCHAR) WHERE i.split = 'test'""", extra=[USER2INT_SQL]))
def p12_user_index(spark, d):
    parsed = _parsed(spark, d)
    u2i = _user2int(parsed)
    test = parsed.where(F.col("split") == "test")
    return finish(P.user_index(test, u2i).select("imp_id", "user"))


@query("p13_clean_history", with_views(["fx_candidates", "fx_impressions", "fx_history"], """
SELECT DISTINCT h.imp_id, h.news_id FROM fx_history h
WHERE h.news_id IN (SELECT c.news_id FROM fx_candidates c JOIN fx_impressions i USING (imp_id) WHERE i.split = 'train')"""))
def p13_clean_history(spark, d):
    cands, imps = fx.candidates(spark, d), fx.impressions(spark, d)
    catalogue = cands.join(imps.where(fx.is_split("train")).select("imp_id"), "imp_id").select("news_id")
    return finish(P.clean_history(fx.history(spark, d), catalogue, tasks=fx.tasks(spark, d)))


@query("p15_one_impression", with_views(["fx_impressions", "fx_raw"], """
SELECT 'id' AS lookup, imp_id, user_id, history FROM fx_raw WHERE imp_id = 7
UNION ALL
SELECT 'index', imp_id, user_id, history FROM fx_raw WHERE imp_id = (
  SELECT imp_id FROM fx_impressions ORDER BY imp_id LIMIT 1 OFFSET 100)"""))
def p15_one_impression(spark, d):
    """By its id, and by its position in the sorted log (the single row is the feature)."""
    parsed = _parsed(spark, d, True)
    both = P.by_impression(parsed, 7).withColumn("lookup", F.lit("id")).unionByName(
        P.by_index(parsed, 100).withColumn("lookup", F.lit("index")))
    return finish(both.select("lookup", "imp_id", "user_id", F.array_join("history", " ").alias("history")))


@query("p16_prune_fill", with_views(["fx_impressions", "fx_history"], """
SELECT i.imp_id, coalesce(h.first_item, '') AS first_item FROM fx_impressions i
LEFT JOIN (SELECT imp_id, 'N' || CAST(news_id AS VARCHAR) AS first_item FROM fx_history WHERE hpos = 1) h USING (imp_id)"""))
def p16_prune_fill(spark, d):
    p = _parsed(spark, d, True).select("imp_id", F.get(F.col("history"), 0).alias("first_item"))
    return P.prune_fill(p, ["imp_id", "first_item"])


# ---- V: tokens and dictionaries -----------------------------------------------------------------

@query("v1_token_counts", with_views(["fx_docs"], """
SELECT token, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token FROM fx_docs) GROUP BY token"""))
def v1_token_counts(spark, d):
    t = fx.docs(spark, d).select(F.explode(tokenize("text")).alias("token"))
    return finish(t.groupBy("token").count().withColumnRenamed("count", "n"))


def _rules_sql():
    """The cascade of ``tokenize_rules`` as nested DuckDB calls."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(' ' || lower(text) || ' ', {quoted(SPACE_RUN)}, '  ', 'g')"
    for pattern, new in TOKEN_RULES:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    stem = f"regexp_extract(w, {quoted(STOPPED)}, 1)"
    words = ", ".join(map(quoted, ABBREVIATIONS))
    return with_views(["fx_docs"], f"""
SELECT token, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(CASE WHEN {stem} = '' OR regexp_matches(w, {quoted(INITIALS)}) OR {stem} IN ({words}) THEN [w]
                     ELSE [{stem}, '.'] END) AS token
  FROM (SELECT unnest(string_split_regex({t}, ' +')) AS w FROM fx_docs) WHERE w <> '') GROUP BY token""")


@query("v1_rule_token_counts", _rules_sql())
def v1_rule_token_counts(spark, d):
    """V1 by the cascade of rewrite rules, which runs once over each distinct word."""
    words = fx.docs(spark, d).select(F.explode(rule_words("text")).alias("word")).groupBy("word").count()
    # a fixed number of tasks: few bytes of words here are much work
    words = words.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "word")
    t = words.select("count", F.explode(tokenize_rules("word")).alias("token"))
    return finish(t.groupBy("token").agg(F.sum("count").alias("n")))


@query("v2_user_first_seen_ids", with_views(["fx_impressions"], "SELECT key, idx FROM user2int",
                                            extra=[USER2INT_SQL]))
def v2_user_first_seen_ids(spark, d):
    return finish(_user2int(_parsed(spark, d)))


NEWS2INT_SQL = """news2int AS (
  SELECT news_id AS key, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, row_key) AS BIGINT) AS idx
  FROM fx_articles)"""


def _news2int(spark, d):
    a = fx.articles(spark, d).withColumn("_so", F.when(F.col("split") == "train", 0).otherwise(1))
    return V.first_seen_ids(a, "news_id", ["_so", "row_key"])


@query("v3_news_first_seen_ids", with_views(["fx_articles"], "SELECT key, idx FROM news2int", extra=[NEWS2INT_SQL]))
def v3_news_first_seen_ids(spark, d):
    return finish(_news2int(spark, d))


CATEGORY2INT_SQL = """c2i AS (
SELECT key, CAST(ROW_NUMBER() OVER (ORDER BY so, row_key, f) AS BIGINT) AS idx FROM (
  SELECT key, so, row_key, f, ROW_NUMBER() OVER (PARTITION BY key ORDER BY so, row_key, f) AS rn FROM (
    SELECT category AS key, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS so, row_key, 0 AS f FROM fx_articles
    UNION ALL
    SELECT subcategory, CASE WHEN split = 'train' THEN 0 ELSE 1 END, row_key, 1 FROM fx_articles))
WHERE rn = 1)"""


@query("v4_shared_category_ids", with_views(["fx_articles"], "SELECT key, idx FROM c2i", extra=[CATEGORY2INT_SQL]))
def v4_shared_category_ids(spark, d):
    a = fx.articles(spark, d).withColumn("_so", F.when(F.col("split") == "train", 0).otherwise(1))
    return finish(V.shared_category_ids(a, ["_so", "row_key"]))


ART_TOKENS_SQL = """art_tokens AS MATERIALIZED (
  SELECT so, row_key, news_id, f, tpos, token FROM (
    SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END AS so, row_key, news_id, 0 AS f,
           unnest(regexp_extract_all(lower(trim(title)), '@TOKEN@')) AS token,
           generate_subscripts(regexp_extract_all(lower(trim(title)), '@TOKEN@'), 1) - 1 AS tpos FROM fx_articles
    UNION ALL
    SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END, row_key, news_id, 1,
           unnest(regexp_extract_all(lower(trim(abstract)), '@TOKEN@')),
           generate_subscripts(regexp_extract_all(lower(trim(abstract)), '@TOKEN@'), 1) - 1 FROM fx_articles))"""

WORD2INT_SQL = """word2int AS MATERIALIZED (
  SELECT token AS key, CAST(ROW_NUMBER() OVER (ORDER BY so, row_key, f, tpos) AS BIGINT) AS idx FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY token ORDER BY so, row_key, f, tpos) AS rn
    FROM art_tokens WHERE token IN (SELECT token FROM fx_word_vectors)) WHERE rn = 1)"""


def _texts_and_words(spark, d):
    """(articles by text key, token list of each text once, dictionary)."""
    a = fx.articles(spark, d, with_text=False).withColumn("_so", F.when(F.col("split") == "train", 0).otherwise(1))
    toks = V.token_lists(fx.texts(spark, d), "text_key", "text")
    return a, toks, V.shared_text_word_ids(a, fx.word_vectors(spark, d), ["_so", "row_key"], "title", "text_key", toks)


def _word2int(spark, d):
    return _texts_and_words(spark, d)[2]


@query("v5_word_ids", with_views(["fx_articles", "fx_word_vectors"], "SELECT key, idx FROM word2int",
                                 extra=[ART_TOKENS_SQL, WORD2INT_SQL]))
def v5_word_ids(spark, d):
    return finish(_word2int(spark, d))


@query("v6_sorted_ids", with_views(["fx_history"], """
SELECT CAST(news_id AS VARCHAR) AS key, CAST(ROW_NUMBER() OVER (ORDER BY CAST(news_id AS VARCHAR)) AS BIGINT) AS idx
FROM (SELECT DISTINCT news_id FROM fx_history)"""))
def v6_sorted_ids(spark, d):
    h = fx.history(spark, d).select(F.col("news_id").cast("string").alias("key"))
    return finish(V.sorted_ids(h))


def _encoded_sql(name: str, field: int, length: int) -> str:
    return f"""{name} AS (
  SELECT a.news_id, array_to_string(list_resize(coalesce(e.l, []), {length}, 0), ' ') AS ids FROM fx_articles a LEFT JOIN (
    SELECT news_id, list(idx ORDER BY tpos) AS l FROM (
      SELECT t.news_id, t.tpos, w.idx, ROW_NUMBER() OVER (PARTITION BY t.news_id ORDER BY t.tpos) AS rn
      FROM art_tokens t JOIN word2int w ON w.key = t.token WHERE t.f = {field}) WHERE rn <= {length} GROUP BY news_id) e
  USING (news_id))"""


ENCODED_SQL = _encoded_sql("encoded", 1, 50)
PARSED_NEWS_VIEWS = ["fx_articles", "fx_word_vectors"]
PARSED_NEWS_CTES = [ART_TOKENS_SQL, WORD2INT_SQL, ENCODED_SQL, _encoded_sql("encoded_title", 0, 20), CATEGORY2INT_SQL]
PARSED_NEWS_SQL = """
SELECT a.news_id, c.idx AS category, s.idx AS subcategory, t.ids AS title, e.ids AS abstract,
       round(a.senti_a, 6) AS senti_a, round(a.senti_b, 6) AS senti_b
FROM fx_articles a JOIN c2i c ON c.key = a.category JOIN c2i s ON s.key = a.subcategory
JOIN encoded e USING (news_id) JOIN encoded_title t USING (news_id)"""


@query("v7_encode_abstracts", with_views(["fx_articles", "fx_word_vectors"], "SELECT news_id, ids FROM encoded",
                                         extra=[ART_TOKENS_SQL, WORD2INT_SQL, ENCODED_SQL]))
def v7_encode_abstracts(spark, d):
    a, toks, w2i = _texts_and_words(spark, d)
    each = V.encode_lists(toks, w2i, "text_key", 50, "ids")
    return a.join(each, "text_key").select("news_id", F.array_join("ids", " ").alias("ids"))


@query("v8_extend_ids", with_views(["fx_articles", "fx_word_vectors"], """
SELECT key, idx FROM w_train
UNION ALL
SELECT token AS key, (SELECT max(idx) FROM w_train) + CAST(ROW_NUMBER() OVER (ORDER BY row_key, f, tpos) AS BIGINT) AS idx
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY token ORDER BY row_key, f, tpos) AS rn FROM art_tokens
      WHERE so = 1 AND token IN (SELECT token FROM fx_word_vectors) AND token NOT IN (SELECT key FROM w_train)) x
WHERE rn = 1""", extra=[ART_TOKENS_SQL, """w_train AS (
  SELECT token AS key, CAST(ROW_NUMBER() OVER (ORDER BY row_key, f, tpos) AS BIGINT) AS idx FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY token ORDER BY row_key, f, tpos) AS rn
    FROM art_tokens WHERE so = 0 AND token IN (SELECT token FROM fx_word_vectors)) WHERE rn = 1)"""]))
def v8_extend_ids(spark, d):
    a = fx.articles(spark, d)
    vec = stored(fx.word_vectors(spark, d))
    train = V.word_ids(a.where(F.col("split") == "train"), vec, ["row_key"])
    test_toks = V.field_tokens(a.where(F.col("split") == "test"), ["row_key"])
    firsts = test_toks.groupBy(F.col("token").alias("key")).agg(F.min(F.struct("row_key", "_field", "tpos")).alias("o")) \
        .join(vec.select(F.col("token").alias("key")).distinct(), "key", "left_semi")
    return finish(V.extend_ids(train, firsts, ["o"]))


@query("v9_embedding_matrix", with_views(["fx_articles", "fx_word_vectors"], """
SELECT CAST(0 AS BIGINT) AS idx, CAST((SELECT max(len(vec)) FROM fx_word_vectors) AS BIGINT) AS dims, 0.0 AS vec_sum
UNION ALL
SELECT w.idx, CAST(len(v.vec) AS BIGINT), round(CAST(list_sum(v.vec) AS DOUBLE), 4)
FROM word2int w JOIN fx_word_vectors v ON v.token = w.key""", extra=[ART_TOKENS_SQL, WORD2INT_SQL]))
def v9_embedding_matrix(spark, d):
    m = V.gather_vectors(_word2int(spark, d), fx.word_vectors(spark, d))
    return finish(m.select("idx", F.size("vec").alias("dims"),
                           rnd(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
                           .alias("vec_sum")))


@query("v10_decode_ids", with_views(["fx_articles", "fx_word_vectors"], """
SELECT a.news_id, coalesce(e.text, '') AS text FROM fx_articles a LEFT JOIN (
  SELECT news_id, string_agg(token, ' ' ORDER BY tpos) AS text FROM (
    SELECT t.news_id, t.tpos, t.token, ROW_NUMBER() OVER (PARTITION BY t.news_id ORDER BY t.tpos) AS rn
    FROM art_tokens t JOIN word2int w ON w.key = t.token WHERE t.f = 1) WHERE rn <= 50 GROUP BY news_id) e
USING (news_id)""", extra=[ART_TOKENS_SQL, WORD2INT_SQL]))
def v10_decode_ids(spark, d):
    a, toks, w2i = _texts_and_words(spark, d)
    each = V.encode_lists(toks, w2i, "text_key", 50, "ids")
    return a.select("news_id", "text_key").join(V.decode_ids(each, "text_key", "ids", w2i), "text_key").drop("text_key")


@query("v11_lookup_by_index", with_views(["fx_articles"], """
SELECT n.idx, a.news_id, a.title, a.category FROM news2int n JOIN fx_articles a ON a.news_id = n.key""",
                                         extra=[NEWS2INT_SQL]))
def v11_lookup_by_index(spark, d):
    n2i = _news2int(spark, d)
    out = V.lookup_by_index(n2i, fx.articles(spark, d), n2i.select("idx"))
    return finish(out.select("idx", "news_id", "title", "category"))


BENCH_TOKENS_SQL = """bench_tok AS (
  SELECT item_id, unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token,
         generate_subscripts(regexp_extract_all(lower(trim(text)), '@TOKEN@'), 1) AS tpos FROM benchmark)"""


@query("v12_encode_batch", with_views(["fx_bench_tokens"], """
SELECT item_id, CAST(len(l) AS BIGINT) AS n_ids, CAST(list_sum(list_resize(l, (SELECT max(c) FROM (SELECT count(*) c FROM bench_tok GROUP BY item_id)), 0)) AS BIGINT) AS id_sum,
       CAST((SELECT max(c) FROM (SELECT count(*) c FROM bench_tok GROUP BY item_id)) AS BIGINT) AS padded_len
FROM (SELECT b.item_id, list(v.idx ORDER BY b.tpos) AS l FROM bench_tok b JOIN vocab v ON v.key = b.token GROUP BY b.item_id)""",
                                      extra=[BENCH_TOKENS_SQL, """vocab AS (
  SELECT token AS key, CAST(ROW_NUMBER() OVER (ORDER BY token) AS BIGINT) AS idx FROM fx_bench_tokens)"""]))
def v12_encode_batch(spark, d):
    b = fx.table(spark, d, "benchmark")
    vocab = V.sorted_ids(b.select(F.explode(tokenize("text")).alias("key")))
    enc = V.encode_batch(b, vocab, "item_id", "text", on_missing="error")
    return finish(enc.select("item_id", F.size(F.filter("ids", lambda x: x != 0)).alias("n_ids"),
                             F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                             F.size("ids").alias("padded_len")))


# ---- D: sampling and preparation ----------------------------------------------------------------

def _floyd_sql(n=4, seed=1234):
    def h(t):
        return (f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST(imp_id AS VARCHAR), "
                f"CAST(click_pos AS VARCHAR), CAST({t} AS VARCHAR))), 1, 8)) AS BIGINT)")
    rs = ", ".join(f"{h(f'm - {n - i}')} % (m - {n - i} + 1) AS r{i}" for i in range(n))
    picks = ["r0 AS p0"]
    for i in range(1, n):
        prev = ", ".join(f"p{j}" for j in range(i))
        picks.append(f"CASE WHEN r{i} IN ({prev}) THEN m - {n - i} ELSE r{i} END AS p{i}")
    # p_i depend on earlier p_j: nest one SELECT per step
    body = f"SELECT imp_id, click_pos, pos_news, m, {rs} FROM ps"
    cur = body
    cols = "imp_id, click_pos, pos_news, m, " + ", ".join(f"r{i}" for i in range(n))
    done = []
    for i in range(n):
        cur = f"SELECT {cols}{''.join(', ' + x for x in done)}, {picks[i]} FROM ({cur})"
        done.append(f"p{i}")
    unp = " UNION ALL ".join(f"SELECT imp_id, click_pos, pos_news, CAST({i + 1} AS BIGINT) AS draw, p{i} AS j FROM fl"
                             for i in range(n))
    return [f"""neg AS (SELECT imp_id, news_id, ROW_NUMBER() OVER (PARTITION BY imp_id ORDER BY pos) - 1 AS j
  FROM fx_candidates WHERE label = 0)""",
            """st AS (SELECT imp_id, SUM(1 - label) AS m FROM fx_candidates GROUP BY imp_id)""",
            f"""ps AS (SELECT c.imp_id, c.pos AS click_pos, c.news_id AS pos_news, s.m FROM fx_candidates c JOIN st s USING (imp_id)
  WHERE c.label = 1 AND s.m >= {n})""",
            f"fl AS ({cur})",
            f"""draws AS (SELECT u.imp_id, u.click_pos, u.pos_news, u.draw, neg.news_id AS neg_news FROM ({unp}) u
  JOIN neg ON neg.imp_id = u.imp_id AND neg.j = u.j)"""]


def _draws(spark, d):
    return D.negative_draw(P.candidate_lines(fx.candidates(spark, d)), 4, 1234)


@query("d1_negative_draw", with_views(["fx_candidates"], "SELECT imp_id, click_pos, pos_news, draw, neg_news FROM draws",
                                      extra=_floyd_sql()))
def d1_negative_draw(spark, d):
    return finish(D.draws_long(_draws(spark, d)))


@query("d1_training_rows", with_views(["fx_candidates"], """
SELECT imp_id, click_pos, pos_news, CAST(pos_news AS VARCHAR) || ' ' || string_agg(CAST(neg_news AS VARCHAR), ' ' ORDER BY draw) AS candidates,
       '1 0 0 0 0' AS mask
FROM draws GROUP BY imp_id, click_pos, pos_news""", extra=_floyd_sql()))
def d1_training_rows(spark, d):
    rows = D.training_rows(_draws(spark, d), 4)
    return finish(rows.select("imp_id", "click_pos", "pos_news", F.array_join("candidates", " ").alias("candidates"),
                              F.array_join("mask", " ").alias("mask")))


@query("d2_split_fraction", with_views(["fx_impressions"], """
SELECT imp_id, CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '1234', CAST(imp_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 < 0.1
            THEN 'val' ELSE 'train' END AS part
FROM fx_impressions WHERE split = 'train'"""))
def d2_split_fraction(spark, d):
    t = fx.impressions(spark, d).where(fx.is_split("train"))
    return D.split_fraction(t, 0.1, 1234).select("imp_id", "part")


SAMPLE_SQL = """picked AS (
  SELECT imp_id FROM fx_impressions
  ORDER BY CAST(('0x' || substr(md5(concat_ws('|', '1234', CAST(imp_id AS VARCHAR))), 1, 15)) AS BIGINT), imp_id
  LIMIT 1000)"""


@query("d3_sample_exact", with_views(["fx_impressions"], "SELECT imp_id FROM picked", extra=[SAMPLE_SQL]))
def d3_sample_exact(spark, d):
    return finish(D.sample_exact(fx.impressions(spark, d).select("imp_id"), 1000, 1234))


@query("d4_catalogue_subset", with_views(["fx_articles", "fx_raw"], """
SELECT a.news_id, a.title FROM fx_articles a WHERE a.news_id IN (
  SELECT unnest(string_split(history, ' ')) FROM fx_raw WHERE split = 'test' AND history <> ''
  UNION SELECT 'N' || CAST(c.news_id AS VARCHAR) FROM fx_candidates c JOIN fx_impressions i USING (imp_id) WHERE i.split = 'test')"""))
def d4_catalogue_subset(spark, d):
    parsed = _parsed(spark, d, True).where(F.col("split") == "test")
    return D.catalogue_subset(fx.articles(spark, d), D.referenced_ids(parsed)).select("news_id", "title")


@query("d5_resize", with_views(["fx_articles", "fx_raw"], """
SELECT a.news_id, a.title FROM fx_articles a WHERE a.news_id IN (
  SELECT unnest(string_split(r.history, ' ')) FROM fx_raw r JOIN picked USING (imp_id) WHERE r.history <> ''
  UNION SELECT 'N' || CAST(c.news_id AS VARCHAR) FROM fx_candidates c JOIN picked USING (imp_id))""",
                               extra=[SAMPLE_SQL]))
def d5_resize(spark, d):
    from impressa.plans.prepare import resize
    beh, news = resize(_parsed(spark, d, True), fx.articles(spark, d), 1000, 1234)
    return news.select("news_id", "title")


@query("d6_eval_rows", with_views(["fx_impressions", "fx_candidates"], """
SELECT c.imp_id, coalesce(u.idx, 0) AS user,
       string_agg('N' || CAST(c.news_id AS VARCHAR), ' ' ORDER BY c.pos) AS candidates,
       string_agg(CAST(c.label AS VARCHAR), ' ' ORDER BY c.pos) AS mask
FROM fx_candidates c JOIN fx_impressions i USING (imp_id)
LEFT JOIN user2int u ON u.key = 'U' || CAST(i.user_id AS VARCHAR)
WHERE i.split = 'test' GROUP BY c.imp_id, u.idx""", extra=[USER2INT_SQL]))
def d6_eval_rows(spark, d):
    parsed = _parsed(spark, d, True)
    ev = D.eval_rows(parsed.where(F.col("split") == "test"), _user2int(parsed), fx.tasks(spark, d))
    return finish(ev.select("imp_id", "user", F.array_join("candidates", " ").alias("candidates"),
                            F.array_join(F.transform("mask", lambda x: x.cast("string")), " ").alias("mask")))


VAL_HASH = ("CAST(('0x' || substr(md5(concat_ws('|', '1234', CAST({imp} AS VARCHAR))), 1, 8)) AS BIGINT) "
            "/ 4294967296.0 < 0.1")
U2I_PREPARED_SQL = f"""u2i AS (
  SELECT key, CAST(ROW_NUMBER() OVER (ORDER BY t, imp_id) AS BIGINT) AS idx FROM (
    SELECT 'U' || CAST(user_id AS VARCHAR) AS key, time AS t, imp_id,
           ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY time, imp_id) AS rn
    FROM fx_impressions WHERE split = 'train' AND NOT ({VAL_HASH.format(imp='imp_id')}))
  WHERE rn = 1)"""
TRAIN_ROWS_VIEWS = ["fx_candidates", "fx_impressions", "fx_raw"]
# candidates of the train part (train period minus the hash-drawn validation share), ids as strings
TRAIN_ROWS_CTES = [f"""fx_cand_tr AS (
  SELECT c.imp_id, c.pos, 'N' || CAST(c.news_id AS VARCHAR) AS news_id, c.label FROM fx_candidates c
  JOIN fx_impressions i USING (imp_id) WHERE i.split = 'train' AND NOT ({VAL_HASH.format(imp='i.imp_id')}))""",
                   *[x.replace("FROM fx_candidates", "FROM fx_cand_tr").replace("JOIN fx_candidates", "JOIN fx_cand_tr")
                     for x in _floyd_sql()], U2I_PREPARED_SQL]
TRAIN_ROWS_SQL = """
SELECT d.imp_id, d.click_pos, u.idx AS user, r.history,
       d.pos_news || ' ' || string_agg(d.neg_news, ' ' ORDER BY d.draw) AS candidates, '1 0 0 0 0' AS mask
FROM draws d JOIN fx_raw r USING (imp_id) JOIN u2i u ON u.key = r.user_id
GROUP BY d.imp_id, d.click_pos, d.pos_news, u.idx, r.history"""


def _eval_sql(where: str) -> str:
    return with_views(["fx_candidates", "fx_raw"], f"""
SELECT c.imp_id, coalesce(u.idx, 0) AS user, r.history, string_agg('N' || CAST(c.news_id AS VARCHAR), ' ' ORDER BY c.pos) AS candidates,
       string_agg(CAST(c.label AS VARCHAR), ' ' ORDER BY c.pos) AS mask
FROM fx_candidates c JOIN fx_raw r USING (imp_id) LEFT JOIN u2i u ON u.key = r.user_id
WHERE {where} GROUP BY c.imp_id, u.idx, r.history""", extra=[U2I_PREPARED_SQL])


def _prepared(spark, d, with_history=True):
    from impressa.plans.prepare import prepare
    return prepare(_parsed(spark, d, with_history), fx.articles(spark, d, with_text=False), fx.word_vectors(spark, d), n_negative=4,
                   val_fraction=0.1, seed=1234, sentiment_cols=("senti_a", "senti_b"), texts=fx.texts(spark, d))


def _rows_out(rows):
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("history", "candidates", "mask")}
    return finish(rows.select(*[joined.get(c, F.col(c)) for c in rows.columns]))


def news_out(parsed):
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("title", "abstract")}
    return finish(parsed.select("news_id", F.col("category").cast("long").alias("category"),
                                F.col("subcategory").cast("long").alias("subcategory"), joined["title"], joined["abstract"],
                                "senti_a", "senti_b"))


@query("d7_prepare_train_rows", with_views(TRAIN_ROWS_VIEWS, TRAIN_ROWS_SQL, extra=TRAIN_ROWS_CTES))
def d7_prepare_train_rows(spark, d):
    return _rows_out(_prepared(spark, d)["train_rows"])


@query("d7_prepare_val_rows", _eval_sql(f"r.split = 'train' AND {VAL_HASH.format(imp='c.imp_id')}"))
def d7_prepare_val_rows(spark, d):
    return _rows_out(_prepared(spark, d)["val_rows"])


@query("d7_prepare_test_rows", _eval_sql("r.split = 'test'"))
def d7_prepare_test_rows(spark, d):
    return _rows_out(_prepared(spark, d)["test_rows"])


@query("d7_prepare_parsed_news", with_views(PARSED_NEWS_VIEWS, PARSED_NEWS_SQL, extra=PARSED_NEWS_CTES))
def d7_prepare_parsed_news(spark, d):
    return news_out(_prepared(spark, d, with_history=False)["parsed_news"])


@query("d7_prepare_train_dictionary", with_views(PARSED_NEWS_VIEWS, """
SELECT w.key, w.idx, round(list_sum(CAST(v.vec AS DOUBLE[])), 4) AS vec_sum FROM word2int w JOIN fx_word_vectors v ON v.token = w.key
WHERE w.key IN (SELECT token FROM art_tokens WHERE so = 0)""", extra=PARSED_NEWS_CTES[:2]))
def d7_prepare_train_dictionary(spark, d):
    """The dictionary and the matrix as they are before the test split extends them."""
    t = _prepared(spark, d)
    m = t["embedding_weights_train"].withColumn("vec_sum", rnd(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 4))
    return finish(t["word2int_train"].join(m.select("idx", "vec_sum"), "idx").select("key", "idx", "vec_sum"))


# ---- J: feature joins ---------------------------------------------------------------------------

@query("j1_history_features", with_views(["fx_history", "fx_news"], """
SELECT h.imp_id, h.hpos, h.news_id, n.category, round(n.senti_a, 6) AS senti_a
FROM fx_history h JOIN fx_news n USING (news_id)"""))
def j1_history_features(spark, d):
    from impressa.operators.joins import attach_features
    h = attach_features(fx.history(spark, d), fx.news(spark, d), ["category", "senti_a"], on_missing="drop")
    return finish(h.select("imp_id", "hpos", "news_id", "category", "senti_a"))


@query("j2_candidate_features", with_views(["fx_candidates", "fx_news"], """
SELECT c.imp_id, c.pos, c.news_id, n.subcategory, round(n.senti_b, 6) AS senti_b, c.label
FROM fx_candidates c JOIN fx_news n USING (news_id)"""))
def j2_candidate_features(spark, d):
    from impressa.operators.joins import attach_features
    c = attach_features(fx.candidates(spark, d), fx.news(spark, d), ["subcategory", "senti_b"], on_missing="error")
    return finish(c.select("imp_id", "pos", "news_id", "subcategory", "senti_b", "label"))


def _j3_sql():
    h = lambda c, zero: (f"array_to_string(list_concat(list_resize([{zero}], greatest(0, 10 - coalesce(len(h.{c}), 0)), {zero}), "  # noqa: E731
                         f"coalesce(h.{c}[1:10], [])), ' ')")
    cols = {"news_id": "''", "category": "''", "subcategory": "''", "senti_a": "'0.0'", "senti_b": "'0.0'",
            "title": "repeat(' 0', 20)[2:]", "abstract": "repeat(' 0', 50)[2:]"}
    item = """items AS (SELECT a.news_id, a.category, a.subcategory, CAST(round(a.senti_a, 6) AS VARCHAR) AS senti_a,
  CAST(round(a.senti_b, 6) AS VARCHAR) AS senti_b, t.ids AS title, e.ids AS abstract
  FROM fx_articles a JOIN encoded e USING (news_id) JOIN encoded_title t USING (news_id))"""
    hl = ", ".join(f"list(n.{c} ORDER BY h.hpos) AS {c}" for c in cols)
    cl = ", ".join(f"string_agg(n.{c}, ' ' ORDER BY c.pos) AS {c}" for c in cols)
    return with_views(["fx_impressions", "fx_history", "fx_candidates", *PARSED_NEWS_VIEWS], f"""
SELECT i.imp_id, {", ".join(f"md5({h(c, z)}) AS h_{c}, md5(c.{c}) AS c_{c}" for c, z in cols.items())},
  CAST(least(coalesce(len(h.news_id), 0), 10) AS BIGINT) AS history_len, c.labels, CAST(0 AS BIGINT) AS n_missing
FROM fx_impressions i
LEFT JOIN (SELECT h.imp_id, {hl} FROM fx_history h JOIN items n ON n.news_id = 'N' || CAST(h.news_id AS VARCHAR)
           WHERE h.hpos <= 10 GROUP BY h.imp_id) h USING (imp_id)
JOIN (SELECT c.imp_id, {cl}, string_agg(CAST(c.label AS VARCHAR), ' ' ORDER BY c.pos) AS labels
      FROM fx_candidates c JOIN items n ON n.news_id = 'N' || CAST(c.news_id AS VARCHAR) GROUP BY c.imp_id) c USING (imp_id)""",
                      extra=[*PARSED_NEWS_CTES[:4], item])


@query("j3_impression_view", _j3_sql())
def j3_impression_view(spark, d):
    """The model view over string ids, string, numeric and array features; rows are compared by the
    md5 of each rendered column."""
    from impressa.operators.joins import impression_view
    from impressa.operators.skew import in_waves
    t = _prepared(spark, d, with_history=False)
    texts = t["parsed_news"].select("news_id", "title", "abstract")
    news = stored(fx.articles(spark, d, with_text=False).select("news_id", "category", "subcategory", rnd(F.col("senti_a"), 6).alias("senti_a"),
                                        rnd(F.col("senti_b"), 6).alias("senti_b")).join(texts, "news_id"))
    named = lambda df: df.withColumn("news_id", F.concat(F.lit("N"), F.col("news_id").cast("string")))
    cands = fx.candidates(spark, d)
    imps = cut_lineage(fx.impressions(spark, d, cands))
    history = fx.history(spark, d, imps, cands, with_reader=True).where(F.col("hpos") <= 10)
    cands = stored(fx.with_reader(cands, imps))

    def text(c):
        one = (lambda x: F.array_join(F.transform(x, lambda y: y.cast("string")), " ")) if c.endswith(("title", "abstract")) \
            else (lambda x: x.cast("string"))
        return F.md5(F.array_join(F.transform(c, one), " ")).alias(c)

    def view(part, n):
        v = impression_view(named(part(cands)), named(part(history)), news,
                            ["news_id", "category", "subcategory", "senti_a", "senti_b", "title", "abstract"], max_history=10,
                            array_lengths={"title": 20, "abstract": 50}, tasks=n)
        skip = ("imp_id", "labels", "history_len", "n_missing")
        return v.select("imp_id", *[text(c) for c in v.columns if c not in skip], "history_len",
                        F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"), "n_missing")

    # a wave's features are released when its impressions are rendered
    return finish(in_waves(view, "reader", fx.tasks(spark, d)))


@query("j4_news_index", with_views(["fx_candidates", "fx_articles"], """
SELECT c.imp_id, c.pos, n.idx FROM fx_candidates c JOIN news2int n ON n.key = 'N' || CAST(c.news_id AS VARCHAR)""",
                                   extra=[NEWS2INT_SQL]))
def j4_news_index(spark, d):
    from impressa.operators.joins import to_index
    c = fx.candidates(spark, d).withColumn("key", F.concat(F.lit("N"), F.col("news_id").cast("string")))
    return finish(to_index(c, _news2int(spark, d), "key").select("imp_id", "pos", "idx"))


@query("j7_known_tokens", with_views(["fx_docs", "fx_word_vectors"], """
SELECT token, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token FROM fx_docs)
WHERE token IN (SELECT token FROM fx_word_vectors) GROUP BY token"""))
def j7_known_tokens(spark, d):
    t = fx.docs(spark, d).select(F.explode(tokenize("text")).alias("token"))
    k = t.join(fx.word_vectors(spark, d).select("token"), "token", "left_semi")
    return finish(k.groupBy("token").count().withColumnRenamed("count", "n"))


@query("j9_history_details", with_views(["fx_history", "fx_news"], """
SELECT h.imp_id, h.hpos, n.title FROM fx_history h JOIN fx_news n USING (news_id) WHERE h.hpos <= 5"""))
def j9_history_details(spark, d):
    from impressa.operators.joins import history_details
    return finish(history_details(fx.history(spark, d), fx.news(spark, d), 5, ["title"]))
