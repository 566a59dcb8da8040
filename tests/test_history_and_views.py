"""Whole histories, the typed model view, per-item scoring hooks, and tasks away from the repository."""
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from impressa.operators import cooccur as C
from impressa.operators import joins as J
from impressa.operators import metrics as M
from impressa.operators import parse as P
from impressa.operators import scoring as B
from impressa.operators import skew as K
from impressa.sources.fixtures import TABLES
from test_oracles import _rows

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def one_user(spark, tmp_path_factory):
    """The driver's smallest tables with 150 orders, all of one user, whose history passes 50 clicks."""
    base = str(tmp_path_factory.mktemp("one-user"))
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 10 = 0").withColumn("o_custkey", F.lit(1).cast("long"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "orders":
            df = orders
        elif t == "lineitem":
            df = df.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        df.coalesce(1).write.parquet(f"{base}/{t}.parquet")
    return base


@pytest.mark.parametrize("name", ["g3_history_length", "g15_share_within_limits", "g18_pair_counts", "g19_npmi", "p4_history_length",
                                  "d7_prepare_train_rows", "d7_prepare_test_rows", "m14_npmi_ranker_eval", "m4_senti_mrr",
                                  "b8_mean_user_vectors"])
def test_long_history_matches_oracle(spark, one_user, name):
    duckdb = pytest.importorskip("duckdb")
    from impressa.plans.registry import load_all
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{one_user}/{t}.parquet/*.parquet')")
    con.execute("SET TimeZone='UTC'")
    fn, sql = load_all()[name]
    df = fn(spark, one_user)
    got, res = [tuple(r) for r in df.collect()], con.execute(sql)
    # with one user NPMI's denominator can be nearly 0, so large values are compared by 8 digits
    digits = lambda rows: [tuple(float(f"{v:.8g}") if isinstance(v, float) else v for v in r) for r in rows]
    assert _rows(df.columns, digits(got)) == _rows([d[0] for d in res.description], digits(res.fetchall()))
    if name == "g3_history_length":
        assert max(r[df.columns.index("history_len")] for r in got) > 50
    if name == "g15_share_within_limits":
        assert got[0][df.columns.index("share_history_len_le_50")] < 1


def test_impression_view_types_and_missing_items(spark):
    news = spark.createDataFrame([("N1", "sport", 0.5, [7, 8]), ("N2", "news", -1.0, [9, 0])],
                                 "news_id string, category string, senti double, title array<int>")
    cands = spark.createDataFrame([(1, 1, "N2", 1), (1, 2, "N1", 0), (1, 3, "gone", 0), (2, 1, "N1", 1)],
                                  "imp_id long, pos long, news_id string, label long")
    hist = spark.createDataFrame([(1, 1, "N1"), (1, 2, "gone"), (1, 3, "N2")], "imp_id long, hpos long, news_id string")
    view = J.impression_view(cands, hist, news, ["news_id", "category", "senti", "title"], 3, array_lengths={"title": 2})
    a, b = view.orderBy("imp_id").collect()
    assert a.h_news_id == ["", "N1", "N2"] and a.h_category == ["", "sport", "news"] and a.h_senti == [0.0, 0.5, -1.0]
    assert a.h_title == [[0, 0], [7, 8], [9, 0]] and a.c_news_id == ["N2", "N1"] and a.labels == [1, 0]
    assert (a.history_len, a.n_missing) == (2, 2)
    assert b.h_title == [[0, 0]] * 3 and b.h_news_id == [""] * 3 and (b.history_len, b.n_missing) == (0, 0)
    with pytest.raises(Exception, match="missing from the catalogue"):
        J.impression_view(cands, hist, news, ["news_id"], 3, on_missing="error").collect()


def test_impression_view_of_readers_equals_the_plain_one(spark):
    news = spark.createDataFrame([("N1", "sport", [7, 8]), ("N2", "news", [9, 0]), ("N2", "copy", [5, 5]), (None, "null", [1, 1]), ("N3", None, [3, 4])],
                                 "news_id string, category string, title array<int>")
    cands = spark.createDataFrame([(9, 1, 1, "N2", 1), (9, 1, 2, "N1", 0), (9, 1, 3, "gone", 0), (9, 2, 1, "N1", 1), (8, 3, 1, None, 0), (8, 3, 2, "N3", 1),
                                   (None, 4, 1, "N3", 1), (None, 5, 1, "gone", 0)],
                                  "reader long, imp_id long, pos long, news_id string, label long")
    hist = spark.createDataFrame([(9, 1, 1, "N1"), (9, 1, 2, "gone"), (9, 1, 3, "N2"), (9, 2, 1, "N3"), (8, 3, 1, "N3"), (8, 3, 2, "N3"), (8, 7, 1, "N1")],
                                 "reader long, imp_id long, hpos long, news_id string")
    args = (news, ["news_id", "category", "title"], 3)
    plain = J.impression_view(cands.drop("reader"), hist.drop("reader"), *args, array_lengths={"title": 2})
    shared = J.impression_view(cands, hist, *args, array_lengths={"title": 2}, tasks=11)
    order = lambda df: sorted(df.select(sorted(plain.columns)).collect(), key=lambda r: r.imp_id)
    assert sorted(shared.columns) == sorted(plain.columns) and order(shared) == order(plain) and len(order(plain)) == 5
    with pytest.raises(Exception, match="missing from the catalogue"):
        J.impression_view(cands, hist, *args, on_missing="error").collect()
    known = J.impression_view(cands.where("news_id = 'N3'"), hist.where("news_id = 'N3'"), *args, on_missing="error")
    assert [r.n_missing for r in known.collect()] == [0, 0]
    sent = J._shared_features(cands.unionByName(hist, allowMissingColumns=True), news.where("news_id = 'N1'"), 3)
    assert sent.where("_f.category = 'sport'").count() == 4


def test_missing_items_fail_in_the_same_pass(spark):
    news = spark.createDataFrame([(1, "a")], "news_id long, category string")
    rows = spark.createDataFrame([(1,), (2,)], "news_id long")
    out = J.attach_features(rows, news, ["category"], "error")  # no job yet
    with pytest.raises(Exception, match="missing from the catalogue"):
        out.collect()
    assert J.attach_features(rows.where("news_id = 1"), news, ["category"], "error").count() == 1


def test_npmi_counts_catalogue_items_only(spark):
    hist = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 99)], "imp_id long, hpos long, news_id long")
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    news = spark.createDataFrame([(10,), (11,)], "news_id long")
    assert {(r.i, r.j) for r in C.learn_npmi(hist, users, catalogue=news).collect()} == {(10, 11)}


def test_mrr_k_limits_ranks(spark):
    scored = spark.createDataFrame([(1, p, p, 1.0 - p / 10, 1 if p == 1 else 0) for p in range(1, 5)],
                                   "imp_id long, pos long, news_id long, score double, label long")
    news = spark.createDataFrame([(p, f"c{p}", f"s{p}", 0.5) for p in range(1, 5)], "news_id long, category string, subcategory string, s double")
    hist = spark.createDataFrame([(1, 1, 4)], "imp_id long, hpos long, news_id long")
    row = lambda k: M.impression_metrics(scored, news, hist, ("s",), (2,), 1, mrr_k=k).collect()[0]
    every, two = row(None), row(2)
    assert every["senti_mrr_s"] == pytest.approx(0.5 * 0.5 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    assert two["senti_mrr_s"] == pytest.approx(0.5 * 0.5 * 1.5)
    assert two["topic_mrr"] == 0 and every["topic_mrr"] > 0  # the history's topics are at rank 4


W, BIAS, Q = np.array([[0.5, -0.2], [0.1, 0.3]]), np.array([0.1, -0.1]), np.array([1.0, 2.0])


def _softmax_pool(x, pad=0):
    x = np.concatenate([np.asarray(x, float), np.zeros((pad, 2))])
    e = np.exp(np.tanh(x @ W.T + BIAS) @ Q)
    return (e / e.sum()) @ x


def test_user_vectors_attention_padding_and_kernels(spark):
    vecs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0, 0.5]), (3, [3.0, 3.0])], "news_id long, vec array<double>")
    hist = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3), (8, 1, 2)], "imp_id long, hpos long, news_id long")
    got = {r.imp_id: r.user_vec for r in B.user_vectors(hist, vecs, W, BIAS, Q, max_history=2).collect()}
    assert np.allclose(got[7], _softmax_pool([[1, 2], [-1, 0.5]])) and np.allclose(got[8], [-1, 0.5])
    got = {r.imp_id: r.user_vec for r in B.user_vectors(hist, vecs, W, BIAS, Q, max_history=4, mask_padding=False).collect()}
    assert np.allclose(got[8], _softmax_pool([[-1, 0.5]], 3))
    assert np.allclose(got[7], _softmax_pool([[1, 2], [-1, 0.5], [3, 3]], 1))

    def last(batch, mask):  # the last real row of each sequence
        return batch[np.arange(len(batch)), mask.sum(1) - 1]

    got = {r.imp_id: r.user_vec for r in B.user_vectors(hist, vecs, kernel=last, dim_out=2).collect()}
    assert got == {7: [3.0, 3.0], 8: [-1.0, 0.5]}
    imps = spark.createDataFrame([(7, 1), (8, 0)], "imp_id long, user long")
    users = spark.createDataFrame([(1, [10.0, 20.0])], "user long, vec array<double>")
    recent = B.user_vectors(hist, vecs)
    seqs = hist.join(vecs, "news_id")
    got = {r.imp_id: r.user_vec for r in B.long_term_users(
        imps, users, recent, "ini", seqs, lambda x, m, state: state + x.sum(1), 2).collect()}
    assert np.allclose(got[7], [13, 25.5]) and np.allclose(got[8], [-1, 0.5])
    got = {r.imp_id: r.user_vec for r in B.long_term_users(imps, users, recent).collect()}
    assert np.allclose(got[8], [0, 0, -1, 0.5])


def test_tasks_find_the_package_from_an_unrelated_folder(tmp_path):
    """Only the driver's sys.path knows the repository; the executors must get the package from it."""
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
sys.path.remove({REPO!r})
q = e.queries()
for name in ("b2_attention_pool_history", "b4_category_vectors", "b6_sentiment_aware_vectors", "b11_adhoc_scores"):
    assert q[name](spark, {SF!r}).count() > 0, name
print("all found")
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all found" in out.stdout, out.stderr[-2000:]


def _lines_and_orders(spark, path, lines, orders):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, t string") \
        .select("o_orderkey", "o_custkey", F.col("t").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{path}/orders.parquet")


def test_history_numbers_clicks_once_and_keeps_repeated_impressions(spark, tmp_path):
    from impressa.sources import fixtures as fx
    r = np.random.default_rng(2)
    d = str(tmp_path)
    orders = [(i, int(r.integers(0, 9)), f"1997-01-{1 + int(r.integers(0, 28)):02d}") for i in range(120)]
    orders += [orders[5], (7, 3, "1997-01-20"), (8, None, "1997-01-25"), (121, 4, None), (None, 4, "1997-01-03")]
    lines = [(int(r.integers(0, 122)), int(r.integers(0, 30)), "RNA"[int(r.integers(0, 3))]) for _ in range(700)]
    _lines_and_orders(spark, d, lines, orders)
    clicked = {(o, p) for o, p, f in lines if f == "R"}
    shown = {o for o, _, _ in lines}
    imps = [o for o in orders if o[0] in shown]
    clicks = [(t, o, p, u) for o, u, t in imps for (x, p) in clicked if x == o and u is not None and t is not None]
    want = []
    for imp in {o for o, _, _ in imps}:
        items = sorted((t, o, p) for _, u, at in [x for x in imps if x[0] == imp] if at is not None
                       for t, o, p, v in clicks if v == u and t < at)
        want += [(imp, i + 1, p) for i, (_, _, p) in enumerate(items)]
    for stored in (True, False):
        assert sorted(map(tuple, fx.history(spark, d, materialize=stored).collect())) == sorted(want)
    by = fx.history(spark, d, with_reader=True)
    assert sorted(map(tuple, by.drop("reader").collect())) == sorted(want)
    assert by.groupBy("imp_id").agg(F.countDistinct("reader").alias("n")).where("n > 1").count() == 0


def test_views_use_more_tasks_on_larger_tables(spark, tmp_path, monkeypatch):
    from impressa.sources import fixtures as fx
    d = str(tmp_path)
    _lines_and_orders(spark, d, [(i, j, "R") for i in range(200) for j in range(3)], [(i, i % 9, f"1997-01-{1 + i % 28:02d}") for i in range(200)])
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fx.tasks(spark, d) == usual
    rows = sorted(map(tuple, fx.history(spark, d).collect()))
    monkeypatch.setattr(fx, "TASK_BYTES", 100)
    n = fx.tasks(spark, d)
    assert n > usual and fx.candidates(spark, d).rdd.getNumPartitions() == n == fx.history(spark, d).rdd.getNumPartitions()
    assert sorted(map(tuple, fx.history(spark, d).collect())) == rows


def test_partitions_of_the_views_are_kept_where_the_session_has_more(spark, tmp_path, monkeypatch):
    """Adaptive execution would join the session's partitions into as few as there are cores."""
    from impressa.sources import fixtures as fx
    d = str(tmp_path)
    _lines_and_orders(spark, d, [(i, j, "R") for i in range(200) for j in range(3)], [(i, i % 9, f"1997-01-{1 + i % 28:02d}") for i in range(200)])
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted(map(tuple, fx.candidates(spark, d).collect()))
    monkeypatch.setattr(fx, "TASK_BYTES", -(-fx.estimated_bytes(fx.table(spark, d, "lineitem")) // (usual - 1)))
    n = fx.tasks(spark, d)
    assert n == usual + 1 and fx.candidates(spark, d).rdd.getNumPartitions() == n
    assert sorted(map(tuple, fx.candidates(spark, d).collect())) == rows


def test_history_and_users_are_joined_over_the_tasks(spark):
    from impressa.operators import sample as D
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) + 3
    hist = spark.createDataFrame([(i, h % 4) for i in range(20) for h in range(8)] + [(None, 1), (None, 1), (3, None)], "imp_id long, news_id long")
    shown = spark.createDataFrame([(1,), (1,), (3,), (None,), (9,)], "news_id long")
    parsed = spark.createDataFrame([(i, f"U{i % 5}" if i % 7 else None, ["N1"], [("N2", 1), ("N3", 0)]) for i in range(30)],
                                   "imp_id long, user_id string, history array<string>, candidates array<struct<news_id:string,label:int>>")
    users = spark.createDataFrame([("U1", 1), ("U2", 2)], "key string, idx long")
    old, limit = K.lookup_join.__defaults__, "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(limit)
    try:
        K.lookup_join.__defaults__ = ("inner", 0, *old[2:])  # nothing is small
        spark.conf.set(limit, "-1")
        kept, rows = P.clean_history(hist, shown, tasks=n), D.eval_rows(parsed, users, n)
        assert kept.rdd.getNumPartitions() == n == rows.rdd.getNumPartitions()
        assert sorted(map(tuple, kept.select(F.coalesce("imp_id", F.lit(-1)), "news_id").collect())) == \
            sorted([(i, x) for i in range(20) for x in (1, 3)] + [(-1, 1)])
        assert sorted((r.imp_id, r.user) for r in rows.collect()) == [(i, {1: 1, 2: 2}.get(i % 5, 0) if i % 7 else 0) for i in range(30)]
    finally:
        K.lookup_join.__defaults__ = old
        spark.conf.set(limit, usual)
