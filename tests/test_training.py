"""Batches, stored and running metrics, mergeable pooling, listwise fit, exact split: invariants and edges."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from impressa.operators import batches as BT
from impressa.operators import metric_store as MS
from impressa.operators import sample as D
from impressa.operators import scoring as B
from impressa.operators import vocab as V


def test_batches_hold_every_key_once_and_only_the_last_is_short(spark):
    keys = spark.range(1000).select(F.col("id").alias("imp_id"))
    got = BT.epoch_batches(keys.repartition(7), "imp_id", 2, 64, bucket_rows=50).collect()
    for epoch in (0, 1):
        rows = [r for r in got if r.epoch == epoch]
        assert sorted(r.imp_id for r in rows) == list(range(1000))
        sizes = [sum(r.batch == b for r in rows) for b in range(16)]
        assert sizes == [64] * 15 + [40] and {(r.batch, r.slot) for r in rows} == {(i // 64, i % 64) for i in range(1000)}
    order = [[r.imp_id for r in sorted(got, key=lambda r: (r.batch, r.slot)) if r.epoch == e] for e in (0, 1)]
    assert order[0] != order[1] != list(range(1000))
    # neither the partitioning nor the size of the buckets changes the draw
    assert sorted(map(tuple, got)) == sorted(map(tuple, BT.epoch_batches(keys, "imp_id", 2, 64).collect()))


def test_batches_in_key_order_and_without_the_short_one(spark):
    keys = spark.range(10).select((F.col("id") * 3).alias("k"))
    got = BT.epoch_batches(keys, "k", 2, 4, shuffle=False, drop_last=True).collect()
    assert sorted(map(tuple, got)) == [(e, i // 4, i % 4, i * 3) for e in (0, 1) for i in range(8)]
    assert BT.epoch_batches(keys.limit(0), "k", 1, 4).count() == 0
    with pytest.raises(ValueError):
        BT.epoch_batches(keys, "k", 0, 4)


def test_collate_pads_to_the_longest_of_the_batch(spark):
    view = spark.createDataFrame([(1, [5], ["a"], 9), (2, [6, 7], ["b", "c"], 8), (3, [], [], 7)],
                                 "imp_id long, c array<int>, s array<string>, user int")
    b = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 1, 1), (0, 1, 0, 3)], "epoch int, batch long, slot long, imp_id long")
    got = sorted(BT.collate(b, view, "imp_id", ["c", "s", "user"]).collect(), key=lambda r: r.batch)
    assert got[0].imp_id == [2, 1] and got[0].c == [[6, 7], [5, 0]] and got[0].s == [["b", "c"], ["a", ""]]
    assert got[0].c_len == [2, 1] and got[0].user == [8, 9] and got[1].c == [[]] and got[1].size == 1


def test_partials_merge_skip_stored_parts_and_repeat_safely(spark, tmp_path):
    per = spark.createDataFrame([(1, "a", .5, None), (2, "a", .25, 1.0), (3, "b", 1.0, None), (4, "c", None, None)],
                                "imp_id long, day string, auc double, mrr double")
    path = str(tmp_path / "parts")
    assert MS.read_partials(spark, path, "day") is None and MS.pending(per, None, "day").count() == 4
    first = per.where("day <> 'b'")
    MS.write_partials(MS.partials(first, "day"), path, "day")
    MS.write_partials(MS.partials(first, "day"), path, "day")  # a repeated run replaces its parts
    left = MS.pending(per, MS.read_partials(spark, path, "day"), "day")
    assert [r.imp_id for r in left.collect()] == [3]
    MS.write_partials(MS.partials(left, "day"), path, "day")
    got = {r.metric: (r.value, r.n_used) for r in MS.merge(MS.read_partials(spark, path, "day")).collect()}
    assert got == {"auc": (pytest.approx(1.75 / 3), 3), "mrr": (1.0, 1)}
    by = {(r.day, r.metric): r.value for r in MS.merge(MS.read_partials(spark, path, "day"), ["day"]).collect()}
    assert by["a", "auc"] == pytest.approx(.375) and by["c", "auc"] is None


def test_running_means_over_many_partitions(spark):
    vals = [None if i % 5 == 0 else float(i % 7) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "imp_id long, auc double").repartition(9)
    got = {r.imp_id: r.run_auc for r in MS.running_means(df, ["auc"]).collect()}
    for i in range(300):
        seen = [v for v in vals[:i + 1] if v is not None]
        assert (got[i] is None) if not seen else abs(got[i] - np.mean(seen)) < 1e-12
    assert MS.running_means(df.limit(0), ["auc"]).count() == 0


def pooled(x, w, b, q, pad_to=None):
    logit = np.tanh(x @ w.T + b) @ q
    spare = max((pad_to or 0) - len(x), 0)
    pad = np.tanh(b) @ q
    top = max(logit.max(), pad) if spare else logit.max()
    e = np.exp(logit - top)
    return (e[:, None] * x).sum(axis=0) / (e.sum() + spare * np.exp(pad - top))


def test_pooling_folds_states_of_a_group_that_is_spread_over_batches(spark):
    r = np.random.default_rng(3)
    n, dim = 200_000, 4
    x = r.normal(size=(n, dim)).round(3)
    g = np.where(np.arange(n) % 50 == 0, 1 + np.arange(n) % 40, 0)  # group 0 holds nearly all rows
    w, b, q = r.normal(size=(3, dim)), r.normal(size=3), r.normal(size=3) * 4
    items = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(g, x)], "imp_id long, vec array<double>") \
        .unionByName(spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0])], "imp_id long, vec array<double>")).repartition(6)
    for pad in (None, 5000):
        out = B.attention_pool(items, "imp_id", "vec", w, b, q, mask_padding=pad is None, pad_to=pad)
        got = {row.imp_id: np.array(row.vec) for row in out.collect()}
        assert set(got) == set(g.tolist()) | {None}
        for k in set(g.tolist()):
            assert np.allclose(got[k], pooled(x[g == k], w, b, q, pad), atol=1e-9)
    mean = {row.imp_id: row.vec for row in B.mean_pool(items, "imp_id", "vec").collect()}
    assert np.allclose(mean[0], x[g == 0].mean(axis=0)) and mean[None] == [1.0, 2.0, 3.0, 4.0]
    assert B.mean_pool(items.limit(0), "imp_id", "vec").count() == 0


def f8(slots, w, apply_sigmoid):
    from impressa.operators.losses import cross_entropy_first
    score = sum((F.col(c) * float(v) for c, v in zip("ab", w)), F.lit(0.0))
    return cross_entropy_first(slots.withColumn("score", score), apply_sigmoid=apply_sigmoid).agg(F.avg("ce")).first()[0]


@pytest.mark.parametrize("apply_sigmoid", [True, False])
def test_listwise_fit_reaches_a_minimum_of_f8(spark, apply_sigmoid):
    r = np.random.default_rng(8)
    rows = []
    for i in range(300):
        x = r.normal(size=(4, 2))
        click = int(np.argmax(x @ [1.5, -.7] + r.gumbel(size=4)))
        order = [click] + [k for k in range(4) if k != click]
        rows += [(i, 0, slot, float(x[k, 0]), float(x[k, 1])) for slot, k in enumerate(order)]
    slots = spark.createDataFrame(rows, "imp_id long, pos_news int, slot int, a double, b double").repartition(3)
    data = B.listwise_rows(slots, ["a", "b"], ["imp_id", "pos_news"])
    w, loss, grad = B.fit_listwise(data, 2, apply_sigmoid)
    assert np.abs(grad).max() <= 1e-8 and loss == pytest.approx(f8(slots, w, apply_sigmoid), abs=1e-9)
    for step in ([.1, 0], [-.1, 0], [0, .1], [0, -.1]):
        assert f8(slots, w + np.array(step), apply_sigmoid) > loss
        up = B.listwise_objective(data, w + np.array(step) * 1e-3, apply_sigmoid)[0]
        at = B.listwise_objective(data, w + np.array(step), apply_sigmoid)
        slope = (B.listwise_objective(data, w + np.array(step) * 1.001, apply_sigmoid)[0] - at[0]) / 1e-3
        assert up >= loss and slope == pytest.approx(float(at[1] @ step), abs=1e-4)
    if not apply_sigmoid:
        assert np.allclose(w, [1.5, -.7], atol=.5)


def test_listwise_fit_without_rows(spark):
    empty = spark.createDataFrame([], "imp_id long, pos_news int, slot int, a double, b double")
    w, loss, _ = B.fit_listwise(B.listwise_rows(empty, ["a", "b"], ["imp_id", "pos_news"]), 2)
    assert w.tolist() == [0, 0] and loss == 0


def test_exact_sample_with_equal_keys_and_exact_split(spark):
    same = spark.range(30_000).select(F.lit(7).alias("imp_id"), F.col("id").alias("x")).repartition(6)
    got = D.sample_exact(same, 12_345).collect()
    assert len(got) == 12_345 and len({r.x for r in got}) == 12_345
    imps = spark.range(101).select(F.col("id").alias("imp_id"))
    for size, want in ((.1, 11), (0, 0), (7, 7), (1.0, 101), (1, 1)):
        assert D.split_exact(imps, size).where("part = 'val'").count() == want
    assert D.split_exact(imps.limit(0), .5).count() == 0
    small = {r.imp_id for r in D.split_exact(imps, .1).where("part = 'val'").collect()}
    assert small < {r.imp_id for r in D.split_exact(imps, .3).where("part = 'val'").collect()}
    with pytest.raises(ValueError):
        D.split_exact(imps, 1.5)


def test_dense_ids_over_many_partitions(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        got = V.sorted_ids(keys.repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.key, r.idx) for r in got) == [(f"k{i:06d}", i + 1) for i in range(5000)]


def test_encoder_keeps_the_first_known_tokens_only(spark):
    tokens = spark.createDataFrame([("n1", i, i % 3) for i in range(5000)] + [("n2", 0, 2)], "news_id string, tpos int, idx long")
    weights = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "idx long, vec array<double>")
    seen = B.encode_catalogue(tokens, weights, lambda x, mask: np.stack([x[:, :, 0].sum(1), x[:, :, 1].sum(1), mask.sum(1)], axis=1),
                              3, max_len=5)
    assert {r.news_id: r.vec for r in seen.collect()} == {"n1": [3.0, 2.0, 5.0], "n2": [0.0, 1.0, 1.0]}


def test_long_baskets_are_cut_into_block_pairs(spark):
    from impressa.operators import cooccur as C
    rows = [(1, list(range(23))), (2, [5, 9]), (3, [4]), (4, []), (5, list(range(40, 48)))]
    bsk = spark.createDataFrame(rows, "imp_id long, items array<long>")
    want = sorted((k, a, b) for k, x in rows for a in x for b in x if a < b)
    for block in (1, 4, 8, 1000):
        assert sorted(map(tuple, C.basket_pairs(bsk, block=block).select("imp_id", "i", "j").collect())) == want
    big = spark.createDataFrame([(list(range(3000)),)], "items array<long>")
    pairs = C.basket_pairs(big, block=100)
    assert pairs.count() == 3000 * 2999 // 2
    assert pairs.select(F.spark_partition_id()).distinct().count() > 2


def test_npmi_lookup_sends_only_known_pairs(spark):
    from impressa.operators import cooccur as C
    r = np.random.default_rng(4)
    for kind, name in (("long", lambda k: int(k)), ("string", lambda k: f"N{k:03d}")):
        table = [(*sorted((name(a), name(b))), float(v)) for (a, b), v in
                 {(int(a), int(b)): v for a, b, v in zip(r.integers(0, 60, 90), r.integers(60, 120, 90), r.normal(size=90))}.items()]
        cands = [(i, p, name(x)) for i in range(50) for p, x in enumerate(r.integers(0, 120, 6))]
        hist = [(i, name(x)) for i in range(45) for x in r.integers(0, 120, 1 if i else 400)]
        score = {(i, j): v for i, j, v in table}
        items = {}
        for i, x in hist:
            items.setdefault(i, set()).add(x)
        want = sorted((i, p, max([score[min(x, y), max(x, y)] for y in items.get(i, ()) if (min(x, y), max(x, y)) in score], default=0.0))
                      for i, p, x in cands)
        c = spark.createDataFrame(cands, f"imp_id long, pos int, news_id {kind}")
        h = spark.createDataFrame(hist, f"imp_id long, news_id {kind}")
        t = spark.createDataFrame(table, f"i {kind}, j {kind}, npmi double")
        got = C.max_npmi_scores(c.repartition(3), h, t)
        assert sorted((r.imp_id, r.pos, r.score) for r in got.collect()) == want
        assert C.max_npmi_scores(c, h, t.limit(0)).agg(F.sum(F.abs("score"))).first()[0] == 0


def test_shared_pooling_equals_pooling_each_list(spark):
    r = np.random.default_rng(5)
    dim, rows = 4, []
    for imp in range(900):  # reader 7 has half of the impressions; histories overlap, with repeats and unknown items
        reader = 7 if imp % 2 else imp % 60
        rows += [(reader, imp, h + 1, int(x)) for h, x in enumerate(r.integers(0, 45, size=imp % 9))]
    hist = spark.createDataFrame(rows, "reader long, imp_id long, hpos long, news_id long").repartition(5)
    vecs = [(i % 40, r.normal(size=dim).round(3).tolist()) for i in range(43)]  # items 40-44 unknown, 0-2 twice
    news = spark.createDataFrame(vecs, "news_id long, vec array<float>")
    w, b, q = r.normal(size=(3, dim)), r.normal(size=3), r.normal(size=3) * 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # readers go on over batches
    try:
        for args, pad in (((w, b, q), True), ((w, b, q), False), ((), True)):
            for most in (6, None if pad else 7):
                shared = B.user_vectors(hist, news, *args, max_history=most, mask_padding=pad, tasks=3)
                plain = B.user_vectors(hist.drop("reader"), news, *args, max_history=most, mask_padding=pad)
                got, want = ({x.imp_id: x.user_vec for x in df.collect()} for df in (shared, plain))
                assert len(got) == shared.count() == len(want) > 700
                assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert B.user_vectors(hist.limit(0), news, tasks=3).count() == 0


def test_shared_pooling_sends_an_item_once_to_a_reader(spark):
    hist = spark.createDataFrame([(1, i, h, h) for i in range(50) for h in range(8)], "reader long, imp_id long, hpos long, news_id long")
    news = spark.createDataFrame([(h, [float(h), 1.0]) for h in range(8)], "news_id long, vec array<float>")
    out = B.user_vectors(hist, news, tasks=2)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [reader" in text and "mapinarrow" in text.lower() and text.lower().count("mapinarrow") == 1
    assert {tuple(x.user_vec) for x in out.collect()} == {(3.5, 1.0)}


def test_baskets_of_a_reader_stay_together(spark):
    from impressa.operators import cooccur as C
    h = spark.createDataFrame([(u, 10 * u + i, n) for u in range(4) for i in range(5) for n in range(i + 1)], "reader long, imp_id long, news_id long")
    users = h.select(F.col("reader").alias("user_id"))
    plain, kept = (sorted(map(tuple, C.learn_npmi(h, users, reader=x).collect())) for x in (None, "reader"))
    assert plain == kept and len(kept) == 10


def test_known_keys_are_looked_up_once_a_key(spark):
    events = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(400)] + [(400, None)], "at long, token string")
    known = spark.createDataFrame([("d",), ("b",), ("b",), ("x",)], "token string")
    got = V.first_seen_ids(events.repartition(5), "token", ["at"], known=known)
    assert sorted((r.key, r.idx) for r in got.collect()) == [("b", 1), ("d", 2)]
    news = spark.createDataFrame([(1, 5, "b b"), (0, 5, "z"), (2, 6, None), (3, None, "d")], "row_key long, text_key long, title string")
    texts = spark.createDataFrame([(5, "d x b x q"), (6, "q b"), (7, "x y")], "text_key long, text string")
    vectors = spark.createDataFrame([(t,) for t in "bdxy"], "token string")
    toks = V.tokens_long(texts, "text_key", "text")
    shared = V.shared_text_word_ids(news, vectors, ["row_key"], "title", "text_key", toks, with_first=True)
    plain = V.word_ids(news.join(texts, "text_key", "left").withColumnRenamed("text", "abstract"), vectors, ["row_key"], with_first=True)
    want = [("b", 3, 0, 1, 2), ("d", 1, 0, 1, 0), ("x", 2, 0, 1, 1)]
    for ids in (shared, plain):
        assert sorted((r.key, r.idx, *r.first) for r in ids.collect()) == want


def test_texts_of_the_catalogue_are_dealt_to_many_tasks(spark):
    from impressa.sources import fixtures as fx
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arts = fx.articles(spark, "/root/testdata/sf0.001")
    assert sum(len(p) > 0 for p in arts.select("news_id", "abstract").rdd.glom().collect()) > n // 2


def test_click_rows_of_one_split_are_those_of_all(spark):
    from impressa.plans import q_scoring as Q
    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    one = Q._click_rows(spark, d, "train")
    assert rows(one) == rows(Q._click_rows(spark, d).where("split = 'train'")) and one.count() > 0


def test_stored_steps_leave_no_shuffle_files(spark):
    from impressa.session import RELEASE_CONF, cut_lineage, stored
    import glob
    import os
    files = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
                     for f in glob.glob(os.path.join(d.getPath(), "*", "shuffle_*.data"))}
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), "id").groupBy("k").agg(F.sum("id").alias("s"))
    before, conf = files(), spark.conf.get(RELEASE_CONF, None)
    for step in (stored, cut_lineage):
        kept = step(df)
        assert files() <= before and kept.count() == 37 and kept.agg(F.sum("s")).first()[0] == 4999 * 2500
        before = files()
    assert df.count() == 37 and spark.conf.get(RELEASE_CONF, None) == conf


def _reader_rows(r):
    hist, cands = [], []
    for imp in range(300):  # reader 7 has half of the impressions; items 40-44 are unknown, 0-2 come twice
        reader = 7 if imp % 2 else imp % 20
        hist += [(reader, imp, h + 1, int(x)) for h, x in enumerate(r.integers(0, 45, size=imp % 9))]
        cands += [(reader, imp, p, int(x) if x < 47 else None) for p, x in enumerate(r.integers(0, 48, size=imp % 4))]
    return hist, cands + [(9000, 9000, 1, 3), (None, None, 1, 3)]


def test_shared_scores_equal_two_joins(spark, monkeypatch):
    from impressa.operators import skew
    r = np.random.default_rng(6)
    hist, cands = _reader_rows(r)
    hist = spark.createDataFrame(hist, "reader long, imp_id long, hpos long, news_id long").repartition(5)
    cands = spark.createDataFrame(cands, "reader long, imp_id long, pos int, news_id long").repartition(3)
    news = spark.createDataFrame([(i % 40, r.normal(size=4).round(3).tolist()) for i in range(43)], "news_id long, vec array<float>")
    w, b, q = r.normal(size=(3, 4)), r.normal(size=3), r.normal(size=3) * 4
    rows = lambda df: sorted((str(x.imp_id), x.pos, str(x.news_id), round(x.score, 9) + 0.0) for x in df.collect())
    for args in ((w, b, q), ()):
        want = rows(B.score_candidates(cands.drop("reader"), news, B.user_vectors(hist.drop("reader"), news, *args, max_history=6)))
        assert len(want) > 400 and rows(B.score_shared(cands, hist, news, *args, max_history=6, tasks=3)) == want
        with monkeypatch.context() as m:
            m.setattr(skew, "WAVE_TASKS", 2)  # two tasks at a time
            assert rows(B.score_shared(cands, hist, news, *args, max_history=6, tasks=7)) == want
            m.setattr(B, "LISTS_AT_ONCE", 5)
            assert rows(B.score_shared(cands, hist, news, *args, max_history=6, tasks=3)) == want
    none = rows(B.score_shared(cands, hist.limit(0), news, tasks=3))
    assert len(none) == len(want) and {x[3] for x in none} == {0.0}


def test_shared_scores_send_no_vector_to_a_candidate(spark):
    hist, cands = _reader_rows(np.random.default_rng(6))
    hist = spark.createDataFrame(hist, "reader long, imp_id long, hpos long, news_id long")
    cands = spark.createDataFrame(cands, "reader long, imp_id long, pos int, news_id long")
    news = spark.createDataFrame([(h, [float(h), 1.0]) for h in range(8)], "news_id long, vec array<float>")
    text = B.score_shared(cands, hist, news, tasks=2)._jdf.queryExecution().optimizedPlan().toString()
    assert text.lower().count("mapinarrow") == 1 and text.splitlines()[0].startswith("MapInArrow")


def test_waves_deal_every_key_once(spark, monkeypatch):
    from impressa.operators import skew
    monkeypatch.setattr(skew, "WAVE_TASKS", 3)
    df, seen = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("k")), []

    def step(part, tasks):
        seen.append(tasks)
        return part(df).groupBy("k").count()

    got = skew.in_waves(step, "k", 8).collect()
    assert seen == [3, 3, 3] and sorted(x.k or 0 for x in got) == list(range(100)) and {x["count"] for x in got} == {1}
    assert skew.waves(None) == skew.waves(3) == 1


def test_click_model_reads_stored_rows(spark, monkeypatch):
    """The fit makes several passes: none of them may build the rows again."""
    from impressa.plans import q_scoring as Q
    plans = []
    fit = B.fit_click_model
    monkeypatch.setattr(B, "fit_click_model", lambda train, cols: plans.append(train) or fit(train, cols))
    assert Q.b12_click_model(spark, "/root/testdata/sf0.001").count() == 3
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "parquet" in text


def test_long_term_vectors_in_the_readers_pass(spark, monkeypatch):
    from impressa.operators import skew
    r = np.random.default_rng(7)
    hist, cands = _reader_rows(r)
    hist = spark.createDataFrame(hist, "reader long, imp_id long, hpos long, news_id long")
    imps = spark.createDataFrame([(x, i, x) for x, i in {(c[0], c[1]) for c in cands if c[0] is not None}] + [(7, 1, 5), (9001, 9001, None)],
                                 "reader long, imp_id long, user long")
    news = spark.createDataFrame([(i, r.normal(size=4).round(3).tolist()) for i in range(40)], "news_id long, vec array<float>")
    users = spark.createDataFrame([(u, r.normal(size=3).round(3).tolist()) for u in (2, 5, 7)], "user long, vec array<float>")
    rows = lambda df: sorted((x.imp_id, [round(v, 9) for v in x.user_vec]) for x in df.collect())
    plain = rows(B.long_term_users(imps, users, B.user_vectors(hist.drop("reader"), news, max_history=5)))
    assert len(plain) == imps.count() and {len(v) for _, v in plain} == {7}
    for most in (64, 2):
        monkeypatch.setattr(skew, "WAVE_TASKS", most)
        assert rows(B.long_term_users(imps, users, None, history=hist, news_vecs=news, max_history=5, tasks=5)) == plain
    bare = B.long_term_users(imps, users, None, history=hist.limit(0), news_vecs=news, tasks=5)
    assert {len(v) for _, v in rows(bare)} == {3}


@pytest.mark.parametrize("name", ["j3_impression_view", "m11_running_means", "b3_encode_catalogue"])
def test_waves_return_the_rows_of_one_plan(spark, monkeypatch, name):
    from impressa.operators import skew
    from impressa.plans import q_scoring as Q
    from impressa.plans.registry import load_all
    rows = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    run, d, steps = load_all()[name][0], "/root/testdata/sf0.001", []
    monkeypatch.setattr(skew, "WAVE_TASKS", 4)
    monkeypatch.setattr(Q, "ARTICLES_A_TASK", 30)
    kept = skew.stored
    monkeypatch.setattr(skew, "stored", lambda df: steps.append(1) or kept(df))
    waved = rows(run(spark, d))
    assert len(steps) >= 2  # every wave's result is stored before the next one starts
    monkeypatch.setattr(skew, "WAVE_TASKS", 1000)
    assert waved == rows(run(spark, d)) and len(waved) > 100
