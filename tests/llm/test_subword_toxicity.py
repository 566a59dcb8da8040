"""Toxicity classifier: features and gradients against plain code, held-out accuracy on unseen spellings."""
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from impressa.llm import subword_toxicity as m
from impressa.llm.textnum import text_buffer
from tests.llm.util import edge_docs, lower, no_docs


def plain_bag(text):
    """{n-gram: share} in plain Python, n-grams as bytes with edges marked by a space (the word itself without)."""
    ws = [w.encode() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", lower(text))]
    out = {}
    for w in ws:
        marked = b" " + w + b" "
        grams = [("word", w)] + [(k, marked[i:i + k]) for k in m.GRAMS for i in range(len(marked) - k + 1)]
        for g in grams:
            out[g] = out.get(g, 0) + 1 / len(grams) / len(ws)
    return out


def test_features_are_the_subword_bags():
    texts = ["You IDIOT, you 1d1ot!", "", "a", None, " \n.", "Ünïcode wörter-und 日本語 a1", "x" * 40]
    rows, share, before = m.features(*text_buffer(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        got = np.bincount(rows[before[k]:before[k + 1]], share[before[k]:before[k + 1]], 1 << m.BITS)
        bag = plain_bag(text)
        assert np.allclose(sorted(got[got > 0]), sorted(bag.values()))  # no two n-grams of these texts share a row
        assert abs(got.sum() - (1 if bag else 0)) < 1e-9


def test_steps_follow_the_gradient_of_the_softmax():
    model = m.Model()
    model.u = np.random.default_rng(1).normal(size=(2, m.DIM)).astype(np.float32)
    rows, share = np.array([3, 9, 77]), np.array([.5, .3, .2], np.float32)

    def loss(e, u, b):
        z = u @ (share @ e) + b
        return np.log(np.exp(z).sum()) - z[1]

    e, u, b = model.e[rows].astype(float), model.u.astype(float), model.b.astype(float)
    model.g[rows], model.ug = 1e4, 1e4  # steps along the gradient, 1/100 of the rate
    before = model.e[rows].copy(), model.u.copy(), model.b.copy()
    model.learn(rows, share, 1)
    for moved, at, rate in ((before[0] - model.e[rows], 0, m.RATE), (before[1] - model.u, 1, m.TOP_RATE), (before[2] - model.b, 2, m.TOP_RATE)):
        x = [e, u, b]
        numeric = np.zeros_like(x[at])
        for i in np.ndindex(numeric.shape):
            up, down = [v.copy() for v in x], [v.copy() for v in x]
            up[at][i] += 1e-5
            down[at][i] -= 1e-5
            numeric[i] = (loss(*up) - loss(*down)) / 2e-5
        assert np.allclose(moved * 1e2 / rate, numeric, atol=2e-2 * np.abs(numeric).max() + 1e-3)


def corpus(spark, n=500):
    r = random.Random(2)
    syllables = ["an", "er", "ti", "on", "lo", "ha", "me", "su", "ri", "ta", "qui", "bel"]
    rows = []
    for i in range(n):
        ws = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:  # every insult has its own ending, so whole words never repeat
            for _ in range(5):
                ws[r.randrange(len(ws))] = "zorgx" + "".join(r.choice(syllables) for _ in range(2))
        rows.append((i, " ".join(ws), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_unseen_misspellings_are_caught(spark):
    rows = corpus(spark)
    train = rows.where("doc_id % 3 <> 1")
    model = m.fit(rows.select("doc_id", "text"), train.select("doc_id", "label"))
    got = m.score(rows, model).join(rows, "doc_id").where("doc_id % 3 = 1").select("label", "score").collect()
    bad, good = [r.score for r in got if r.label], [r.score for r in got if not r.label]
    assert np.mean([b > g for b in bad for g in good]) > 0.98 and np.mean(np.array(bad) >= m.THRESHOLD) > 0.8
    again = m.fit(rows.select("doc_id", "text"), train.select("doc_id", "label"))
    assert np.array_equal(model.weights(), again.weights())


def test_edges(spark):
    docs = edge_docs(spark).withColumn("label", F.lit("other")).withColumn("score", F.lit(9))
    none = m.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int"))
    assert {r.score for r in m.score(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 0), (5, 1), (7, 0), (999, 1)], "doc_id long, label int")
    got = m.score(docs, m.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert m.score(no_docs(spark), none).count() == 0
    assert m.fit(no_docs(spark), labels).weights().any() is np.False_
