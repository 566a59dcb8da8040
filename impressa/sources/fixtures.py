"""Views that map the driver's tables onto the impression-log data model.

impressions = orders, candidates = line items grouped by (order, part), users = customers,
news = parts, text = documents, exposures = events.  Every view is a lazy DataFrame over the
parquet tables, so its work grows with them.  ``SQL`` holds the same views as DuckDB CTEs for
the oracle; ``with_views`` assembles them in dependency order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impressa.functions.scalar import hash_int32, signed_sentiment
from impressa.functions.text import DEFAULT_TOKEN_PATTERN, tokenize
from impressa.operators.skew import estimated_bytes, skew_join
from impressa.session import cut_lineage, stored

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Fixed value: the fixture's split date.
SPLIT_DATE = "2000-01-01"
TASK_BYTES = 4 << 20  # of the line items' files that one task works on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark, sf_dir) -> int:
    """Partitions of what is built from the line items: the session's number, and more where the table is so
    large that a task would hold over some 300,000 of its rows.  Adaptive execution may join the session's partitions
    into as few as there are cores, but keeps any other number; so where the cores are too few, it is another."""
    wanted = -(-estimated_bytes(table(spark, sf_dir, "lineitem")) // TASK_BYTES)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual + 1, wanted) if wanted > spark.sparkContext.defaultParallelism else max(usual, wanted)


def _dealt(df: DataFrame, n: int, key: str, otherwise: DataFrame | None = None) -> DataFrame:
    """``df`` dealt over ``n`` partitions by ``key`` if the session's number is too small."""
    few = n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df if otherwise is None else otherwise) if few else df.repartition(n, key)


def candidates(spark, sf_dir) -> DataFrame:
    """(imp_id, news_id, label, pos): one row per (order, part); clicked if any line was returned."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    n = tasks(spark, sf_dir)
    # One exchange by order key serves both the grouping and the position window.
    grouped = (_dealt(li, n, "l_orderkey", li.repartition("l_orderkey"))
               .groupBy(F.col("l_orderkey").alias("imp_id"), F.col("l_partkey").alias("news_id"))
               .agg(F.max((F.col("l_returnflag") == "R").cast("long")).alias("label")))
    return grouped.withColumn("pos", F.row_number().over(
        Window.partitionBy("imp_id").orderBy("news_id")).cast("long"))


def impressions(spark, sf_dir, cands: DataFrame | None = None) -> DataFrame:
    """(imp_id, user_id, time, split) for orders that have candidates.

    The ids come from the candidate view, which is already partitioned by order, so the
    semi-join shuffles only ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cands = cands if cands is not None else candidates(spark, sf_dir)
    has = cands.select(F.col("imp_id").alias("o_orderkey"))
    o = o.join(has, "o_orderkey", "left_semi")
    return o.select(F.col("o_orderkey").alias("imp_id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("time"),
                    F.when(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "train")
                    .otherwise("test").alias("split"))


def is_split(name: str, time: str = "time"):
    """The train/test predicate written on the time column itself, so it reaches the ``orders``
    scan as a date filter (row groups outside the period are skipped) instead of a CASE value."""
    cut = F.lit(SPLIT_DATE).cast("timestamp_ntz")
    if name == "train":
        return F.col(time) < cut
    return (F.col(time) >= cut) | F.col(time).isNull()


def history(spark, sf_dir, imps: DataFrame | None = None, cands: DataFrame | None = None,
            materialize: bool = True, with_reader: bool = False) -> DataFrame:
    """(imp_id, hpos, news_id): all the user's clicks in strictly earlier dated orders, oldest
    first.  Nothing is cut here; operators that keep a part of it take the length as parameter.
    ``with_reader`` adds the user as ``reader`` and keeps a reader's impressions together.

    A user's clicks are numbered once, in order of time: the history of an impression is a beginning of
    that list, so the number of a click is its place in every history that holds it.  The numbered clicks are
    joined to the user's impressions (a hot user is split by the skew-aware join).  An impression that comes several
    times has the clicks of all its rows, which are numbered inside it."""
    cands = cands if cands is not None else candidates(spark, sf_dir)
    imps = imps if imps is not None else impressions(spark, sf_dir, cands)
    n = tasks(spark, sf_dir)
    same = Window.partitionBy("imp_id")
    rows = imps.select("imp_id", "user_id", "time", F.min("user_id").over(same).alias("reader"),
                       (F.count(F.lit(1)).over(same) > 1).alias("_twice"))
    rows = stored(rows) if materialize else rows
    clicks = (cands.where(F.col("label") == 1).select(F.col("imp_id").alias("click_imp"), "news_id")
              .join(rows.select(F.col("imp_id").alias("click_imp"), "user_id", F.col("time").alias("click_time")),
                    "click_imp")
              .where(F.col("user_id").isNotNull() & F.col("click_time").isNotNull()))
    order = ["click_time", "click_imp", "news_id"]
    clicks = _dealt(clicks, n, "user_id") \
        .withColumn("hpos", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long"))
    clicks = stored(clicks) if materialize else clicks
    cols = [*(["reader"] if with_reader else []), "imp_id", "hpos", "news_id"]

    def joined(some):
        return skew_join(_dealt(some.drop("_twice"), n, "user_id"), clicks, ["user_id"], condition=F.col("click_time") < F.col("time"))

    out = joined(rows.where("not _twice")).select(*cols)
    if not materialize or not rows.where("_twice").isEmpty():
        w = Window.partitionBy("imp_id").orderBy(*order)
        out = out.unionByName(joined(rows.where("_twice")).withColumn("hpos", F.row_number().over(w).cast("long")).select(*cols))
    out = out.repartition(n, "reader" if with_reader else "imp_id")
    # The history feeds several branches of most plans; Spark does not share sub-plans whose
    # column pruning differs, so it is written once to the shared checkpoint folder, hash
    # partitioned by impression (or reader), which later groupings and joins by it reuse.
    return cut_lineage(out) if materialize else out


def with_reader(rows: DataFrame, imps: DataFrame) -> DataFrame:
    """``rows`` of impressions with the reader that their history has; an impression without one is a reader alone."""
    who = imps.groupBy("imp_id").agg(F.min("user_id").alias("reader"))
    return rows.join(who, "imp_id", "left").withColumn("reader", F.coalesce("reader", "imp_id"))


def news(spark, sf_dir) -> DataFrame:
    """(news_id, category, subcategory, title, senti_a, senti_b)."""
    p = table(spark, sf_dir, "part")
    prob = F.lit(0.5) + (F.col("p_size") % 50).cast("double") / F.lit(100.0)
    label = F.when(F.col("p_size") % 2 == 0, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE"))
    return p.select(F.col("p_partkey").alias("news_id"), F.col("p_brand").alias("category"),
                    F.col("p_type").alias("subcategory"), F.col("p_name").alias("title"),
                    ((F.col("p_retailprice") - F.lit(950.0)) / F.lit(50.0)).alias("senti_a"),
                    signed_sentiment(label, prob).alias("senti_b"))


def _count(df: DataFrame) -> int:
    """Row count of a (small) lookup table, used as a modulus."""
    return df.count()


def vectors(spark, sf_dir) -> DataFrame:
    """(news_id, vec): part p gets embedding row p % count(embeddings)."""
    e = table(spark, sf_dir, "embeddings")
    n = _count(e)
    p = table(spark, sf_dir, "part").select("p_partkey").withColumn("vec_id", F.pmod(F.col("p_partkey"), F.lit(n)))
    return p.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id") \
        .select(F.col("p_partkey").alias("news_id"), "vec")


def docs(spark, sf_dir) -> DataFrame:
    """(news_id, category, subcategory, text) from documents."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("news_id"), F.col("lang").alias("category"),
        F.col("source").alias("subcategory"), "text")


def articles(spark, sf_dir, with_text: bool = True) -> DataFrame:
    """Raw news catalogue rows (news_id, category, subcategory, title, abstract, split, row_key,
    senti_a, senti_b): parts with their name as title and document ``p % count(documents)`` as
    abstract.  Without the text, ``text_key`` says which document it is (see ``texts``)."""
    d = table(spark, sf_dir, "documents")
    n = _count(d)
    p = news(spark, sf_dir).withColumn("doc_id", F.pmod(F.col("news_id"), F.lit(n)))
    abstract = F.col("text").alias("abstract") if with_text else F.col("doc_id").alias("text_key")
    if with_text:  # a fixed number of tasks: a few bytes of keys become many texts here
        p, d = (x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id") for x in (p, d.select("doc_id", "text")))
    return p.join(d.select("doc_id", *(["text"] if with_text else [])), "doc_id").select(
        F.concat(F.lit("N"), F.col("news_id").cast("string")).alias("news_id"), "category", "subcategory", "title",
        abstract, F.when(F.col("news_id") % 2 == 0, "train").otherwise("test").alias("split"),
        F.col("news_id").alias("row_key"), "senti_a", "senti_b")


def texts(spark, sf_dir) -> DataFrame:
    """(text_key, text): every abstract once."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_key"), "text")


def exposures(spark, sf_dir) -> DataFrame:
    """(news_id, time): event ts with the JSON key ``k`` as item."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.get_json_object("props", "$.k").cast("long").alias("news_id"),
                     F.col("ts").alias("time"))


def word_vectors(spark, sf_dir) -> DataFrame:
    """(token, vec): the word-vector table, over nine in ten (by hash) of the distinct tokens of
    ``documents`` and ``benchmark``; token t gets embedding row hash(t) % count(embeddings)."""
    e = table(spark, sf_dir, "embeddings")
    n = _count(e)
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    h = hash_int32("token")
    toks = (texts.select(F.explode(tokenize("text")).alias("token")).distinct()
            .withColumn("_h", h).where(F.pmod("_h", F.lit(10)) != 0).withColumn("vec_id", F.pmod("_h", F.lit(n))))
    return toks.join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("token", "vec")


def lexicon(spark, sf_dir) -> DataFrame:
    """(token, valence): distinct ``benchmark`` tokens with a valence in [-4, 4] by hash, 0 dropped."""
    toks = table(spark, sf_dir, "benchmark").select(F.explode(tokenize("text")).alias("token")).distinct()
    return (toks.withColumn("valence", (F.pmod(hash_int32(F.lit("lex"), "token"), F.lit(9)) - 4).cast("double"))
            .where(F.col("valence") != 0))


def modifiers(spark, sf_dir) -> DataFrame:
    """(token, boost, negates): by hash a quarter of the distinct ``benchmark`` tokens negate, a quarter
    strengthen and a quarter weaken."""
    toks = table(spark, sf_dir, "benchmark").select(F.explode(tokenize("text")).alias("token")).distinct()
    kind = F.pmod(hash_int32(F.lit("mod"), "token"), F.lit(4))
    return toks.select("token", F.when(kind == 1, 0.293).when(kind == 2, -0.293).otherwise(0.0).alias("boost"),
                       (kind == 0).alias("negates")).where(kind != 3)


def raw_behaviors(spark, sf_dir, with_history: bool = True) -> DataFrame:
    """fx_raw: the views rendered back to log strings (imp_id, user_id, time, history, impressions,
    split).  A reader that does not look at the history leaves it out, and it is not built."""
    cands = candidates(spark, sf_dir)
    imps = impressions(spark, sf_dir, cands)
    cs = (cands.groupBy("imp_id")
          .agg(F.array_sort(F.collect_list(F.struct("pos", "news_id", "label"))).alias("c"))
          .select("imp_id", F.array_join(F.transform("c", lambda x: F.concat(
              F.lit("N"), x["news_id"].cast("string"), F.lit("-"), x["label"].cast("string"))), " ")
              .alias("impressions")))
    user = F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id")
    time = F.date_format("time", "M/d/yyyy h:mm:ss a").alias("time")
    if not with_history:
        return imps.join(cs, "imp_id").select("imp_id", user, time, "impressions", "split")
    hist = history(spark, sf_dir)
    hs = (hist.groupBy("imp_id")
          .agg(F.array_sort(F.collect_list(F.struct("hpos", "news_id"))).alias("h"))
          .select("imp_id", F.array_join(F.transform("h", lambda x: F.concat(F.lit("N"), x["news_id"].cast("string"))),
                                         " ").alias("history")))
    return (imps.join(hs, "imp_id", "left").join(cs, "imp_id")
            .select("imp_id", user, time, F.coalesce("history", F.lit("")).alias("history"), "impressions", "split"))


# ---------------------------------------------------------------------------------------------
# DuckDB text of the same views (the oracle side).

SQL = {
    "fx_candidates": """fx_candidates AS (
  SELECT l_orderkey AS imp_id, l_partkey AS news_id,
         CAST(MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS label,
         CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS BIGINT) AS pos
  FROM lineitem GROUP BY l_orderkey, l_partkey)""",
    "fx_impressions": """fx_impressions AS (
  SELECT o_orderkey AS imp_id, o_custkey AS user_id, o_orderdate AS time,
         CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'test' END AS split
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""",
    "fx_clicks": """fx_clicks AS (
  SELECT i.user_id, i.time AS click_time, c.imp_id, c.news_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY i.user_id ORDER BY i.time, c.imp_id, c.news_id) AS BIGINT) AS hpos
  FROM fx_candidates c JOIN fx_impressions i ON i.imp_id = c.imp_id WHERE c.label = 1)""",
    "fx_history": """fx_history AS (
  SELECT i.imp_id, k.hpos, k.news_id FROM fx_impressions i
  JOIN fx_clicks k ON k.user_id = i.user_id AND k.click_time < i.time WHERE {H})""",
    "fx_news": """fx_news AS (
  SELECT p_partkey AS news_id, p_brand AS category, p_type AS subcategory, p_name AS title,
         (p_retailprice - 950.0) / 50.0 AS senti_a,
         CASE WHEN p_size % 2 = 0 THEN 2 * (0.5 + CAST(p_size % 50 AS DOUBLE) / 100.0) - 1
              ELSE 1 - 2 * (0.5 + CAST(p_size % 50 AS DOUBLE) / 100.0) END AS senti_b
  FROM part)""",
    "fx_vectors": """fx_vectors AS (
  SELECT p.p_partkey AS news_id, e.embedding AS vec FROM part p
  JOIN embeddings e ON e.vec_id = p.p_partkey % (SELECT count(*) FROM embeddings))""",
    "fx_docs": """fx_docs AS (
  SELECT doc_id AS news_id, lang AS category, source AS subcategory, text FROM documents)""",
    "fx_articles": """fx_articles AS MATERIALIZED (
  SELECT 'N' || CAST(p.news_id AS VARCHAR) AS news_id, p.category, p.subcategory,
         p.title, d.text AS abstract,
         CASE WHEN p.news_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, p.news_id AS row_key, p.senti_a, p.senti_b
  FROM fx_news p JOIN documents d ON d.doc_id = p.news_id % (SELECT count(*) FROM documents))""",
    "fx_exposures": """fx_exposures AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS news_id, ts AS time FROM events)""",
    "fx_bench_tokens": """fx_bench_tokens AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token FROM benchmark)""",
    "fx_all_tokens": """fx_all_tokens AS MATERIALIZED (
  SELECT DISTINCT unnest(regexp_extract_all(lower(trim(text)), '@TOKEN@')) AS token
  FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))""",
    "fx_word_vectors": """fx_word_vectors AS MATERIALIZED (
  SELECT t.token, e.embedding AS vec FROM fx_all_tokens t
  JOIN embeddings e ON e.vec_id = CAST(('0x' || substr(md5(t.token), 1, 8)) AS BIGINT) % (SELECT count(*) FROM embeddings)
  WHERE CAST(('0x' || substr(md5(t.token), 1, 8)) AS BIGINT) % 10 <> 0)""",
    "fx_lexicon": """fx_lexicon AS (
  SELECT token, CAST(CAST(('0x' || substr(md5('lex|' || token), 1, 8)) AS BIGINT) % 9 - 4 AS DOUBLE) AS valence
  FROM fx_bench_tokens
  WHERE CAST(('0x' || substr(md5('lex|' || token), 1, 8)) AS BIGINT) % 9 <> 4)""",
    "fx_modifiers": """fx_modifiers AS (
  SELECT token, CASE k WHEN 1 THEN 0.293 WHEN 2 THEN -0.293 ELSE 0.0 END AS boost, k = 0 AS negates
  FROM (SELECT token, CAST(('0x' || substr(md5('mod|' || token), 1, 8)) AS BIGINT) % 4 AS k FROM fx_bench_tokens) WHERE k <> 3)""",
    "fx_raw": """fx_raw AS (
  SELECT i.imp_id, 'U' || CAST(i.user_id AS VARCHAR) AS user_id,
         strftime(i.time, '%-m/%-d/%Y %-I:%M:%S %p') AS time,
         coalesce(h.history, '') AS history, c.impressions, i.split
  FROM fx_impressions i
  LEFT JOIN (SELECT imp_id, string_agg('N' || CAST(news_id AS VARCHAR), ' ' ORDER BY hpos) AS history
             FROM fx_history GROUP BY imp_id) h USING (imp_id)
  JOIN (SELECT imp_id, string_agg('N' || CAST(news_id AS VARCHAR) || '-' || CAST(label AS VARCHAR), ' ' ORDER BY pos) AS impressions
        FROM fx_candidates GROUP BY imp_id) c USING (imp_id))""",
}

DEPENDS = {
    "fx_raw": ["fx_impressions", "fx_history", "fx_candidates"],
    "fx_impressions": [],
    "fx_candidates": [],
    "fx_clicks": ["fx_candidates", "fx_impressions"],
    "fx_history": ["fx_clicks"],
    "fx_news": [],
    "fx_vectors": [],
    "fx_docs": [],
    "fx_articles": ["fx_news"],
    "fx_exposures": [],
    "fx_bench_tokens": [],
    "fx_all_tokens": [],
    "fx_word_vectors": ["fx_all_tokens"],
    "fx_lexicon": ["fx_bench_tokens"],
    "fx_modifiers": ["fx_bench_tokens"],
}


def with_views(views: list[str], body: str, H: int | None = None, extra: list[str] | None = None) -> str:
    """``WITH <views in dependency order>, <extra CTEs> <body>`` for DuckDB.  ``H`` keeps the first
    H history items, for the oracles of operators that do so themselves."""
    order: list[str] = []

    def add(v):
        for d in DEPENDS[v]:
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = [SQL[v].replace("{H}", f"k.hpos <= {H}" if H else "true") for v in order] + list(extra or [])
    sql = "WITH " + ",\n".join(ctes) + "\n" + body
    return sql.replace("@TOKEN@", DEFAULT_TOKEN_PATTERN)
