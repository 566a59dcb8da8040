"""Deep-shallow sorting and repeated-string removal against brute force."""
import hashlib
import random

import numpy as np
import pytest

from impressa.llm import suffix_dedup as D
from util import DOCS, edge_docs, no_docs


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) in order; rows with one id are ordered by text."""
    seen, out = set(), []
    for doc_id, text in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - D.LENGTH + 1):
            x = b[s:s + D.LENGTH]
            if x in seen:
                gone[s:s + D.LENGTH] = True
            seen.add(x)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_sorting(letters):
    rng = np.random.default_rng(letters)
    data = rng.integers(97, 97 + letters, 3000, dtype=np.uint8)
    start, group = rng.integers(0, 2700, 600), rng.integers(0, 4, 600)
    length = np.array([30, 100, 184, 7])[group]
    order, label = D.deep_shallow(D.symbols8(data), start, length, group)
    keys = [(group[i], data[start[i]:start[i] + length[i]].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:])] == (label[1:] == label[:-1]).tolist()


def passages(seed=2):
    rng = random.Random(seed)
    text = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    shared = [text(150), text(99), text(100), text(400), "x" * 350, "ab" * 200, "né" * 90]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 250))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 60))]
        rows.append((i, "".join(parts)))
    return rows + [(i + 1000, t) for i, t in rows[:20]]


@pytest.mark.parametrize("hot,group_bytes", [(D.HOT, D.GROUP_BYTES), (3, 4000), (D.HOT, 4000)])
def test_removal_equals_brute_force(spark, monkeypatch, hot, group_bytes):
    rows = passages()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = sorted(tuple(r)[:5] for r in D.remove_repeats(docs, hot, group_bytes).collect())
    assert got == sorted(brute(rows))


def test_expansion_in_slices(spark, monkeypatch):
    monkeypatch.setattr(D, "EXPANDED", 10)
    rows = passages(3)
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    assert sorted(tuple(r)[:5] for r in D.remove_repeats(docs).collect()) == sorted(brute(rows))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in D.op4(spark, d).collect()) == sorted(brute(rows))


def test_edges(spark):
    docs = edge_docs(spark, [(8, "z" * 99, "en", "a", 99), (8, "y" * 120, "en", "a", 120)])
    got = sorted((tuple(r)[:5] for r in D.remove_repeats(docs).collect()), key=str)
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert D.remove_repeats(no_docs(spark)).count() == 0
    assert D.remove_repeats(docs.withColumnsRenamed({"lang": "g", "source": "marks"})).count() == docs.count()
