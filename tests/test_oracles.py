"""Registered queries against their DuckDB oracles on the driver's sf0.001 tables.

A representative subset runs by default; IMPRESSA_FULL_ORACLE=1 runs every registered query
(scripts/check_oracle.py does the same at any scale)."""
import math
import os

import pytest

SF = os.environ.get("IMPRESSA_ORACLE_SF", "/root/testdata/sf0.001")
SUBSET = ["m10_test_bundle", "m11_impression_metrics", "m13_random_baseline", "m14_npmi_ranker_eval",
          "p1_parse_impressions", "p9_pad_history", "p12_user_index", "v4_shared_category_ids", "v5_word_ids",
          "v7_encode_abstracts", "v8_extend_ids", "d1_negative_draw", "d3_sample_exact", "d6_eval_rows",
          "j3_impression_view", "g11_survival_histogram", "g13_news_per_category", "g19_npmi",
          "g20_max_npmi_scores", "b2_attention_pool_history", "b10_score_candidates", "f2_lexicon_sentiment",
          "f2_modified_sentiment", "v1_rule_token_counts", "g12_merged_sketches",
          "f11_loss_report", "w4_best_k_epochs", "w5_early_stop_epoch", "d7_prepare_train_rows",
          "s1_read_behaviors_tsv", "s4_strict_lines", "s13_results_table"]


def _names():
    from impressa.plans.registry import load_all
    q = load_all()
    names = sorted(q) if os.environ.get("IMPRESSA_FULL_ORACLE") else SUBSET
    return [n for n in names if q[n][1]]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from impressa.sources.fixtures import TABLES
    if not os.path.isdir(SF):
        pytest.skip(f"no test data at {SF}")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from impressa.plans.registry import load_all
    fn, sql = load_all()[name]
    df = fn(spark, SF)
    res = duck.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() == 19
    assert set(e.oracle_sql()) <= set(e.queries())
