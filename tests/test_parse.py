"""Log parsing, padding and TSV sources on hand-made rows (edge rows of FIXTURES.md §5)."""
from pyspark.sql import functions as F

from impressa.functions import scalar as S
from impressa.operators import parse as P
from impressa.sources import tsv as TS


def _raw(spark):
    return spark.createDataFrame([
        (1, "U1", "11/13/2019 8:36:57 AM", "N1 N2", "N3-1 N4-0"),
        (2, "U2", "11/13/2019 12:00:00 PM", "", "N5-0"),          # empty history, no click
        (3, "U1", "1/2/2020 11:59:59 PM", "N1 N2 N3 N4 N5 N6", "N7-1 N8-1"),
    ], "imp_id long, user_id string, time string, history string, impressions string")


def test_parse_behaviors(spark):
    p = {r["imp_id"]: r for r in P.parse_behaviors(_raw(spark)).collect()}
    assert p[2]["history"] == []
    assert [(c["pos"], c["news_id"], c["label"]) for c in p[1]["candidates"]] == [(1, "N3", 1), (2, "N4", 0)]
    assert str(p[3]["time"]) == "2020-01-02 23:59:59"
    assert str(p[1]["time"]) == "2019-11-13 08:36:57"


def test_dash_split_equals_suffix_rule(spark):
    r = _raw(spark).select(P.parse_impressions("impressions").alias("a"),
                           P.parse_impressions_dash("impressions").alias("b")).collect()
    assert all(x["a"] == x["b"] for x in r)


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    out = df.select(S.pad_right("a", 2).alias("r"), S.pad_left_keep_first("a", 4).alias("l"),
                    S.pad_left_keep_last("a", 2).alias("k"), S.click_mask(3).alias("m")).collect()
    assert out[0]["r"] == [1, 2] and out[1]["r"] == [0, 0]
    assert out[0]["l"] == [0, 1, 2, 3] and out[1]["l"] == [0, 0, 0, 0]
    assert out[0]["k"] == [2, 3]
    assert out[0]["m"] == [1, 0, 0, 0]


def test_explode_default_and_trainable(spark):
    parsed = P.parse_behaviors(_raw(spark))
    ex = P.explode_with_default(parsed.select("imp_id", "history"), "history", "-1").where("imp_id = 2")
    assert [r["history"] for r in ex.collect()] == ["-1"]
    assert sorted(r["imp_id"] for r in P.trainable(parsed, 1).collect()) == [1]


def test_user_index_unknown_is_zero(spark):
    parsed = P.parse_behaviors(_raw(spark))
    d = spark.createDataFrame([("U1", 7)], "key string, idx long")
    out = {r["imp_id"]: r["user"] for r in P.user_index(parsed, d).collect()}
    assert out == {1: 7, 2: 0, 3: 7}


def test_tsv_roundtrip_and_strict_lines(spark, tmp_path):
    path = str(tmp_path / "beh")
    TS.write_tsv(_raw(spark), path)
    back = TS.read_behaviors(spark, path)
    assert back.where("imp_id = 2").collect()[0]["history"] == ""
    lines = tmp_path / "news.tsv"
    lines.write_text("N1\ta\tb\tt\tab\tu\t[]\t[]\nN2\ta\tb\tt\tab\tu\t\t\nbroken line\n")
    good, bad = TS.read_lines_strict(spark, str(lines), TS.NEWS_COLUMNS)
    assert [r["news_id"] for r in good.collect()] == ["N1"]
    assert bad.count() == 2


def test_min_valid_ratio(spark):
    s = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5), (2, 1, 0.0), (2, 2, 0.0)], "imp_id long, pos long, score double")
    kept = P.min_valid_ratio(s, 0.5)
    assert sorted({r["imp_id"] for r in kept.collect()}) == [1]
    r = P.used_and_total(s, kept).collect()[0]
    assert (r["n_used"], r["n_total"]) == (1, 2)


def test_by_impression_and_prune_fill(spark):
    parsed = P.parse_behaviors(_raw(spark))
    assert [r["imp_id"] for r in P.by_impression(parsed, 3).collect()] == [3]
    df = spark.createDataFrame([(1, None), (2, "x")], "imp_id long, h string")
    assert sorted(tuple(r) for r in P.prune_fill(df, ["imp_id", "h"]).collect()) == [(1, ""), (2, "x")]
