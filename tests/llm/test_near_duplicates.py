"""SetSketch near-duplicates against brute force over all pairs."""
import random

import numpy as np
import pytest

import corpus_pipeline as P
from impressa.llm import setsketch as S
from util import DOCS, edge_docs, lower, no_docs, words


def brute(rows, percent=85):
    sets = {}
    for doc_id, text in rows:
        w = words(lower(text))
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i]:
                shared = len(sets[i] & sets[j])
                if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n=260, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(4000)]
    rows, doc_id = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        for _ in range(n // 12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((doc_id, rng.choice([" ", "\n"]).join(copy).capitalize()))
            doc_id += 1
    return rows + [(doc_id + k, " ".join(rng.choice(vocabulary) for _ in range(80))) for k in range(40)]


@pytest.mark.parametrize("block", [2048, 16])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in S.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.op7(spark, d).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs])


def test_edges(spark):
    got = sorted((tuple(r) for r in S.near_duplicates(edge_docs(spark)).collect()), key=str)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[1] == by_id[2][:1] + (1, True) and by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True)
    assert by_id[4] == (1, 4, True) and by_id[None] == (1, None, True)
    assert by_id[5][1:] == (5, True) and by_id[6][1:] == (5, False)
    assert [r for r in got if r[0] == 7] == [(7, 1, 7, True)] * 2
    assert S.near_duplicates(no_docs(spark)).count() == 0
    clash = edge_docs(spark).withColumnsRenamed({"lang": "id", "source": "regs", "n_chars": "n"})
    assert S.drop_near_duplicates(clash).columns == clash.columns


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 63, (2, 500), dtype=np.uint64)
    union = S.registers(np.concatenate([a, b]))
    assert (union == np.maximum(S.registers(a), S.registers(b))).all()
    shared = np.concatenate([a[:450], b[:50]])
    n = np.array([500.0])
    assert S.screened(S.registers(a)[None], S.registers(shared)[None], n, n).all()  # similarity 0.82
    assert not S.screened(S.registers(a)[None], S.registers(b)[None], n, n).any()


def test_pipeline_stage_links_from_80_percent(spark):
    rng = random.Random(9)
    rows = []
    for k in range(12):  # one changed word in the middle of n: (n - 9) of (n + 1) shingles are shared, 0.78 to 0.86
        n = 44 + 3 * k
        base = [f"t{k}word{i}" for i in range(n)]
        copy = list(base)
        copy[n // 2] = f"other{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    rows += [(100 + i, t) for i, t in near_copies(seed=6)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    want = brute(rows, 80)
    assert want != brute(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(docs, 80).collect()} == want
    assert {r.doc_id for r in P.drop_copies(spark, docs, "").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_screen_and_bands_follow_the_threshold():
    assert (S.screen_at(85), S.band_rows(85)) == (0.76, 7) and (S.screen_at(80), S.band_rows(80)) == (0.70, 5)
    for percent in (50, 70, 80, 85, 95):
        rows = S.band_rows(percent)
        assert rows == 1 or (1 - (percent / 100) ** rows) ** (S.REGISTERS // rows) < 1e-6
