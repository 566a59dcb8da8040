"""NPMI on a hand example, the max-over-history ranker, top-k, model selection, skew joins."""
import math

import pytest
from pyspark.sql import functions as F

from impressa.operators import cooccur as C
from impressa.operators import ranking as R
from impressa.operators.skew import skew_join


def test_npmi_hand_example(spark):
    hist = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 10), (2, 1, 10), (2, 2, 12), (3, 1, 11)],
                                 "imp_id long, hpos long, news_id long")
    users = spark.createDataFrame([("a",), ("b",), ("a",)], "user_id string")
    t = {(r["i"], r["j"]): (r["c_ij"], r["npmi"]) for r in C.learn_npmi(hist, users).collect()}
    # baskets {10,11}, {10,12}, {11}: c10=2, c11=2, c12=1; N = 2 distinct users
    n, eps = 2.0, 1e-10
    c, npmi = t[(10, 11)]
    want = math.log(1 * n / (2 * 2 + eps)) / (-math.log(1 / n + eps) + eps)
    assert c == 1 and npmi == pytest.approx(want)
    assert set(t) == {(10, 11), (10, 12)}


def test_max_npmi_scores_zero_when_unknown(spark):
    table = spark.createDataFrame([(10, 11, 1, 0.3), (10, 12, 1, -0.2)], "i long, j long, c_ij long, npmi double")
    cands = spark.createDataFrame([(1, 1, 11, 1), (1, 2, 12, 0), (1, 3, 13, 0)],
                                  "imp_id long, pos long, news_id long, label long")
    hist = spark.createDataFrame([(1, 1, 10)], "imp_id long, hpos long, news_id long")
    s = {r["pos"]: r["score"] for r in C.max_npmi_scores(cands, hist, table).collect()}
    assert s == {1: 0.3, 2: -0.2, 3: 0.0}


def test_basket_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],), ([],)], "items array<long>")
    pairs = sorted((r["i"], r["j"]) for r in C.basket_pairs(df).collect())
    assert pairs == [(1, 2), (1, 3), (2, 3)]


def test_top_k_and_best_epochs(spark):
    s = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (1, 3, 0.5)], "imp_id long, pos long, score double")
    assert [r["pos"] for r in R.top_k(s, 2).orderBy("rank").collect()] == [2, 3]
    log = spark.createDataFrame([("r", e, "val_auc", v) for e, v in enumerate([0.5, 0.6, 0.55, 0.7, 0.6], 1)],
                                "run string, epoch long, metric string, value double")
    assert [r["epoch"] for r in R.best_k_runs(log, "val_auc", 2).orderBy("place").collect()] == [4, 2]


def test_early_stop_fold(spark):
    vals = [0.5, 0.6, 0.60005, 0.60011, 0.59, 0.58, 0.57, 0.56, 0.9]
    log = spark.createDataFrame([("r", e, "m", v) for e, v in enumerate(vals, 1)],
                                "run string, epoch long, metric string, value double")
    r = R.early_stop_epoch(log, "m", patience=3, min_delta=1e-4).collect()[0]
    # 0.60011 beats the recorded best 0.6 by > 1e-4 (the best is not moved by 0.60005)
    assert r["best_epoch"] == 4 and r["stop_epoch"] == 7 and r["stopped_early"]


def test_salted_join_equals_plain(spark):
    big = spark.range(0, 20000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50)).alias("k"),
                                       F.col("id").alias("v"))
    small = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    a = skew_join(big, small, ["k"], "inner", mode="aqe")
    b = skew_join(big, small, ["k"], "inner", hot_rows=1000, salts=8, mode="salt")
    assert sorted(map(tuple, a.select("k", "v", "w").collect())) == sorted(map(tuple, b.select("k", "v", "w").collect()))
    c = skew_join(big, small.withColumnRenamed("w", "w2"), ["k"], "inner", condition=F.col("v") > F.col("w2"),
                  hot_rows=1000, salts=8, mode="salt")
    assert c.count() == big.join(small, "k").where("v > w").count()


def test_history_fixture_same_under_salting(spark):
    from impressa.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, fx.history(spark, d, materialize=False).collect()))
    spark.conf.set("impressa.skew.mode", "salt")
    spark.conf.set("impressa.skew.hotRows", "100")  # with the 1% sample: every sampled user is hot
    try:
        salted = sorted(map(tuple, fx.history(spark, d, materialize=False).collect()))
    finally:
        spark.conf.unset("impressa.skew.mode")
        spark.conf.unset("impressa.skew.hotRows")
    assert plain == salted and len(plain) > 0
