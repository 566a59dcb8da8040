"""Hand-computed metric examples (ties, no click, one candidate, equal category/subcategory,
empty history) and invariants."""
import math

import pytest
from pyspark.sql import functions as F

from impressa.operators import metrics as M

SCHEMA = "imp_id long, pos long, news_id long, score double, label long"


def _scored(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def _by_imp(df, col):
    return {r["imp_id"]: r[col] for r in df.collect()}


def test_auc_with_ties_and_undefined(spark):
    data = [
        (1, 1, 10, 0.9, 1), (1, 2, 11, 0.5, 0), (1, 3, 12, 0.5, 1), (1, 4, 13, 0.1, 0),
        (2, 1, 10, 0.3, 0), (2, 2, 11, 0.2, 0),          # no click: undefined
        (3, 1, 10, 0.7, 1),                               # one candidate, only a click: undefined
    ]
    per = M.performance(_scored(spark, data), ks=(5,))
    auc = _by_imp(per, "auc")
    # pairs (pos, neg): (0.9,0.5)=1 (0.9,0.1)=1 (0.5,0.5)=0.5 (0.5,0.1)=1 -> 3.5/4
    assert auc[1] == pytest.approx(0.875)
    assert auc[2] is None and auc[3] is None


def test_mrr_counts_every_click(spark):
    data = [(1, 1, 10, 0.9, 0), (1, 2, 11, 0.8, 1), (1, 3, 12, 0.7, 1)]
    per = M.performance(_scored(spark, data), ks=())
    # (1/2 + 1/3) / 2 (mean over all clicked items, not the first hit)
    assert _by_imp(per, "mrr")[1] == pytest.approx((1 / 2 + 1 / 3) / 2)


def test_ndcg_and_tie_order_by_position(spark):
    data = [(1, 1, 10, 0.5, 0), (1, 2, 11, 0.5, 1), (1, 3, 12, 0.1, 0)]
    per = M.performance(_scored(spark, data), ks=(2,))
    # tie broken by position: ranks 1 (pos 1, label 0), 2 (pos 2, label 1)
    assert _by_imp(per, "ndcg@2")[1] == pytest.approx((1 / math.log2(3)) / 1.0)


def test_auc_flip_invariant(spark):
    from impressa.plans.evaluate import random_scores
    import random
    rnd = random.Random(5)
    data = [(i, p, p, 0.0, rnd.randint(0, 1)) for i in range(40) for p in range(1, 8)]
    s = random_scores(_scored(spark, data).drop("score"))
    a = M.performance(s, ks=(5,)).select("imp_id", F.col("auc").alias("a"), F.col("`ndcg@5`").alias("n"))
    b = M.performance(s.withColumn("score", -F.col("score")), ks=()).select("imp_id", F.col("auc").alias("b"))
    for r in a.join(b, "imp_id").where(F.col("a").isNotNull()).collect():
        assert r["a"] + r["b"] == pytest.approx(1.0)
        assert r["n"] <= 1.0 + 1e-12


def _news(spark):
    return spark.createDataFrame([
        (10, "sports", "soccer", 0.5), (11, "news", "news", -0.5),   # category == subcategory
        (12, "sports", "tennis", 1.0), (20, "sports", "soccer", 0.2), (21, "news", "politics", -0.4),
    ], "news_id long, category string, subcategory string, s double")


def test_sentiment_topic_and_ils(spark):
    scored = _scored(spark, [(1, 1, 10, 0.9, 1), (1, 2, 11, 0.5, 0), (1, 3, 12, 0.1, 0),
                             (2, 1, 10, 0.4, 1), (2, 2, 12, 0.6, 0)])
    hist = spark.createDataFrame([(1, 1, 20), (1, 2, 21)], "imp_id long, hpos long, news_id long")
    per = M.impression_metrics(scored, _news(spark), hist, senti_cols=["s"], ks=(2,), max_history=4)
    r = {x["imp_id"]: x for x in per.collect()}
    s_mean = (0.2 - 0.4) / 4  # padded-length denominator (Q4)
    assert r[1]["senti_mrr_s"] == pytest.approx(max(0.0, s_mean * (0.5 / 1 - 0.5 / 2 + 1.0 / 3)))
    assert r[1]["senti@2_s"] == pytest.approx(max(0.0, s_mean * (0.5 - 0.5)))
    # empty history -> 0 for sentiment and topic metrics
    assert r[2]["senti_mrr_s"] == 0.0 and r[2]["topic_mrr"] == 0.0
    # ILS-senti@2 of impression 1: |0.5 - (-0.5)| / 2
    assert r[1]["ils_senti@2_s"] == pytest.approx(0.5)
    # topic@2: user counts sports 1, soccer 1, news 1, politics 1 (norm 2);
    # top-2 candidates: {sports, soccer}, {news} -> v = (1,1,1), |v| = sqrt(3); dot = 3 / 2
    assert r[1]["topic_div@2"] == pytest.approx(3 / 2 / math.sqrt(3))
    # ILS-topic@2: cos({sports, soccer}, {news}) = 0
    assert r[1]["ils_topic@2"] == pytest.approx(0.0)
    # impression 2, top-2 = {sports, tennis} then {sports, soccer}: cosine 1/2
    assert r[2]["ils_topic@2"] == pytest.approx(0.5)


def test_more_tasks_than_the_session_has_give_the_same_metrics(spark, monkeypatch):
    from impressa.operators import skew
    rows = [(i, p, (i * 7 + p * 3) % 23, (i * 31 + p * 17) % 10 / 10, int((i + p) % 3 == 0)) for i in range(40) for p in range(1, 6)]
    scored = _scored(spark, rows)
    hist = spark.createDataFrame([(i, p, (i + p * 5) % 23) for i in range(0, 60, 2) for p in range(1, 8)], "imp_id long, hpos long, news_id long")
    news = spark.createDataFrame([(n, f"c{n % 4}" if n % 5 else None, f"s{n % 6}", n / 7, -n / 9) for n in range(20)],
                                 "news_id long, category string, subcategory string, a double, b double")

    def run(tasks):
        out = M.impression_metrics(scored, news, hist, ("a", "b"), (2, 5), 6, tasks=tasks)
        return out, {r.imp_id: [None if v is None else round(v, 9) for v in r] for r in out.collect()}
    few, want = run(None)
    assert len(want) == 40 and run(19)[1] == want
    # no row is dealt by impression and topic: both sides of the topic scores stay with their impression
    assert "topic" not in "".join(x for x in few._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x)
    monkeypatch.setattr(skew, "fits", lambda *a: False)
    monkeypatch.setattr(M, "fits", lambda *a: False)
    many, got = run(19)
    assert got == want
    assert "hashpartitioning(imp_id" in many._jdf.queryExecution().toString() and ", 19)" in many._jdf.queryExecution().toString()


def test_ils_single_candidate_is_undefined(spark):
    scored = _scored(spark, [(1, 1, 10, 0.9, 1)])
    per = M.impression_metrics(scored, _news(spark), None, senti_cols=["s"], ks=(5,))
    r = per.collect()[0]
    assert r["ils_senti@5_s"] is None and r["ils_topic@5"] is None


def test_summarize_skips_undefined(spark):
    scored = _scored(spark, [(1, 1, 10, 0.9, 1), (1, 2, 11, 0.1, 0), (2, 1, 10, 0.3, 0)])
    out = {r["metric"]: (r["value"], r["n_used"]) for r in M.summarize(M.performance(scored, ks=(5,))).collect()}
    assert out["auc"] == (1.0, 1)


def test_softmax_sums_to_one(spark):
    scored = _scored(spark, [(1, 1, 10, 2.0, 1), (1, 2, 11, 1.0, 0), (2, 1, 10, 0.0, 0)])
    sums = M.softmax(scored).groupBy("imp_id").agg(F.sum("prob").alias("t")).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in sums)
