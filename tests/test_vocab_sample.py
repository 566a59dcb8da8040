"""Dictionaries, sampling and splitting: invariants and partition independence."""
import pytest
from pyspark.sql import functions as F

from impressa.operators import parse as P
from impressa.operators import sample as D
from impressa.operators import vocab as V


def test_dense_index_is_gapless_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    out = V.dense_index(df, ["k"]).collect()
    pairs = sorted((r["k"], r["idx"]) for r in out)
    assert [p[1] for p in pairs] == list(range(1, 5001))


def test_dense_index_independent_of_partitions(spark):
    df = spark.range(0, 3000).select((F.col("id") * 13 % 3000).alias("k"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted((r["k"], r["idx"]) for r in V.dense_index(df, ["k"]).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted((r["k"], r["idx"]) for r in V.dense_index(df, ["k"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_first_seen_and_shared_categories(spark):
    ev = spark.createDataFrame([("b", 2), ("a", 3), ("b", 1), ("c", 4)], "key string, t long")
    assert sorted((r["key"], r["idx"]) for r in V.first_seen_ids(ev, "key", ["t"]).collect()) == \
        [("a", 2), ("b", 1), ("c", 3)]
    news = spark.createDataFrame([(1, "sports", "soccer"), (2, "news", "news"), (3, "sports", "tennis")],
                                 "row long, category string, subcategory string")
    ids = dict((r["key"], r["idx"]) for r in V.shared_category_ids(news, ["row"]).collect())
    assert ids == {"sports": 1, "soccer": 2, "news": 3, "tennis": 4}


def test_extend_ids_keeps_old(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "key string, idx long")
    new = spark.createDataFrame([("y", 0), ("z", 1), ("w", 2)], "key string, o long")
    out = dict((r["key"], r["idx"]) for r in V.extend_ids(old, new, ["o"]).collect())
    assert out == {"x": 1, "y": 2, "z": 3, "w": 4}


def test_encode_text_drops_unknown_before_truncation(spark):
    news = spark.createDataFrame([(1, "The cat sat on THE mat"), (2, "zzz")], "row long, t string")
    w2i = spark.createDataFrame([("the", 1), ("cat", 2), ("mat", 3)], "key string, idx long")
    out = {r["row"]: r["t_ids"] for r in V.encode_text(news, w2i, "row", "t", 3).collect()}
    assert out[1] == [1, 2, 1] and out[2] == [0, 0, 0]
    dec = {r["row"]: r["text"] for r in V.decode_ids(V.encode_text(news, w2i, "row", "t", 5), "row", "t_ids",
                                                     w2i).collect()}
    assert dec[1] == "the cat the mat" and dec[2] == ""


def test_encode_batch_fails_on_unknown(spark):
    texts = spark.createDataFrame([(1, "cat zebra")], "row long, t string")
    w2i = spark.createDataFrame([("cat", 1)], "key string, idx long")
    with pytest.raises(Exception, match="missing from the dictionary"):
        V.encode_batch(texts, w2i, "row", "t").collect()


def _cands(spark):
    data = []
    for imp in range(30):
        for pos in range(1, 12):
            data.append((imp, pos, 1000 * imp + pos, 1 if pos in (2, 5, 9) else 0))
    return P.candidate_lines(spark.createDataFrame(data, "imp_id long, pos long, news_id long, label long"))


def _draw(lines, n, seed):
    return D.draws_long(D.negative_draw(lines, n, seed))


def test_negative_draw_invariants(spark):
    draws = _draw(_cands(spark), 4, 1234)
    g = draws.groupBy("imp_id", "pos_news").agg(F.countDistinct("neg_news").alias("d"), F.count("*").alias("n"))
    assert g.count() == 30 * 3
    assert all(r["d"] == 4 and r["n"] == 4 for r in g.collect())
    negs = {r["neg_news"] % 1000 for r in draws.collect()}
    assert negs.isdisjoint({2, 5, 9})
    # reproducible
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, _draw(_cands(spark), 4, 1234).collect()))


def test_negative_draw_is_roughly_uniform(spark):
    data = [(imp, pos, pos, 1 if pos == 1 else 0) for imp in range(400) for pos in range(1, 9)]
    c = P.candidate_lines(spark.createDataFrame(data, "imp_id long, pos long, news_id long, label long"))
    counts = _draw(c, 3, 7).groupBy("neg_news").count().collect()
    freq = [r["count"] for r in counts]
    assert len(freq) == 7 and max(freq) / min(freq) < 1.5  # 7 negatives, each expected 3/7 of 400


def test_item_clicked_twice_gives_two_rows(spark):
    line = spark.createDataFrame([(1, "N1-1 N1-1 N2-0 N3-0 N4-0")], "imp_id long, impressions string")
    lines = line.select("imp_id", P.parse_impressions("impressions").alias("candidates"))
    rows = D.training_rows(D.negative_draw(lines, 2), 2).orderBy("click_pos").collect()
    assert [r["click_pos"] for r in rows] == [1, 2]
    assert all(len(r["candidates"]) == 3 and r["candidates"][0] == "N1" and r["mask"] == [1, 0, 0] for r in rows)


def test_negative_draw_needs_no_shuffle(spark):
    line = spark.createDataFrame([(1, "N1-1 N2-0 N3-0")], "imp_id long, impressions string")
    lines = line.select("imp_id", P.parse_impressions("impressions").alias("candidates"))
    plan = D.negative_draw(lines, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sample_exact_matches_sort_limit(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "imp_id")
    got = sorted(r["imp_id"] for r in D.sample_exact(df, 1234, seed=9, final_rows=50).collect())
    key = D._sort_key(9, "imp_id")
    want = sorted(r["imp_id"] for r in df.orderBy(key, "imp_id").limit(1234).collect())
    assert got == want
    with pytest.raises(ValueError):
        D.sample_exact(df, 0)


def test_split_fraction(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "imp_id")
    share = D.split_fraction(df, 0.1).agg(F.avg((F.col("part") == "val").cast("double"))).collect()[0][0]
    assert 0.09 < share < 0.11
    assert D.split_fraction(df, 0.0).where("part = 'val'").count() == 0


def test_prepare_builds_every_table(spark):
    from impressa.plans.prepare import prepare
    from impressa.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    out = prepare(P.parse_behaviors(fx.raw_behaviors(spark, d)), fx.articles(spark, d),
                  fx.word_vectors(spark, d), n_negative=2)
    assert set(out.keys()) >= {"train_rows", "parsed_news", "embedding_weights", "test_rows"}
    pn = out["parsed_news"].collect()
    assert pn and all(len(r["title"]) == 20 and len(r["abstract"]) == 50 for r in pn)
    rows = out["train_rows"].collect()
    assert rows and all(len(r["candidates"]) == 3 and r["mask"] == [1, 0, 0] for r in rows)
    emb = out["embedding_weights"]
    assert emb.where("idx = 0").collect()[0]["vec"] == [0.0] * 64


def test_lists_are_encoded_by_their_beginning_unless_it_has_too_few_known_tokens(spark):
    texts = [(1, "a b " * 30), (2, "x " * 40 + "a b a b b"), (3, "x x a"), (4, None), (5, "x " * 7 + "b " + "x " * 3 + "a x a"),
             (6, "a b"), (6, "b a a a x b"), (None, "a"), (7, "x a x b x a x b x x")]
    news = spark.createDataFrame(texts, "row long, t string")
    w2i = spark.createDataFrame([("a", 1), ("b", 2)], "key string, idx long")
    lists = V.token_lists(news, "row", "t")
    for big in (16 << 20, 0):
        old = V.lookup_join.__defaults__, V.broadcast_if_small.__defaults__, V.fits.__defaults__
        try:
            V.lookup_join.__defaults__, V.broadcast_if_small.__defaults__, V.fits.__defaults__ = ("inner", big, *old[0][2:]), (big,), (big,)
            got = V.encode_lists(lists, w2i, "row", 3, "ids").collect()
        finally:
            V.lookup_join.__defaults__, V.broadcast_if_small.__defaults__, V.fits.__defaults__ = old
        got = {r["row"]: sorted(r["ids"]) if r["row"] == 6 else r["ids"] for r in got}
        assert got == {1: [1, 2, 1], 2: [1, 2, 1], 3: [1, 0, 0], 4: [0] * 3, 5: [2, 1, 1], 6: got[6], None: [0] * 3, 7: [1, 2, 1]}
        assert got[6] in ([1, 1, 2], [1, 2, 2])  # equal keys: both first tokens, and one of the second ones


def test_only_the_beginnings_of_lists_are_looked_up(spark):
    """The rest of a list is read for the lists that need it alone."""
    seen = []
    texts = spark.createDataFrame([(i, "a b c d " * 25 + f"rest{i}") for i in range(20)], "row long, t string")
    w2i = spark.createDataFrame([("a", 1), ("b", 2)], "key string, idx long")
    real = V.lookup_join
    try:
        V.lookup_join = lambda big, *a, **k: (seen.append(big), real(big, *a, **k))[1]
        out = V.encode_lists(V.token_lists(texts, "row", "t"), w2i, "row", 4, "ids").collect()
    finally:
        V.lookup_join = real
    assert all(r["ids"] == [1, 2, 1, 2] for r in out) and [x.count() for x in seen] == [20 * 8, 0]


def test_dictionary_of_shared_texts_takes_lists_and_equal_rows(spark):
    news = spark.createDataFrame([(4, 5, "b b"), (0, 5, "z"), (0, 5, "z"), (2, 6, None), (3, None, "d"), (1, 8, "q")], "row_key long, text_key long, title string")
    texts = spark.createDataFrame([(5, "d x b x q"), (5, "b d"), (6, "q b x"), (7, "x y"), (None, "y"), (8, None)], "text_key long, text string")
    vectors = spark.createDataFrame([(t,) for t in "bdxy"], "token string")
    args = (news, vectors, ["row_key"], "title", "text_key")
    for toks in (V.tokens_long(texts, "text_key", "text"), V.token_lists(texts, "text_key", "text")):
        for big in (16 << 20, 0):
            old, V.fits.__defaults__ = V.fits.__defaults__, (big,)
            try:
                got = sorted((r.key, *r.first) for r in V.shared_text_word_ids(*args, toks, with_first=True).collect())
            finally:
                V.fits.__defaults__ = old
            assert got == [("b", 0, 1, 0), ("d", 0, 1, 0), ("x", 0, 1, 1)]
