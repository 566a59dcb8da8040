"""The pipeline stage by stage against brute force, and run() as a whole."""
import collections
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from test_near_duplicates import brute
from test_rules_mixture_leaks import base_features
from util import words

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        stages.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, single, clean, mixed, tokens = stages
    everything = spark.read.parquet(f"{SF}/documents.parquet").collect()
    # too few labels certify no cutoff here, so the base rule alone decides
    want = {r.doc_id for r in everything if (f := base_features(r.text))[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    assert {r.doc_id for r in good} == want
    groups = brute([(r.doc_id, r.text) for r in good], P.SIMILAR)
    assert {r.doc_id for r in single} == {i for i, (_, c) in groups.items() if i == c}
    flat = lambda t: " " + " ".join(words((t or "").lower())) + " "
    items = [flat(b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in single if any(i in flat(r.text) for i in items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in single} - leaks and leaks
    sizes = {r.doc_id: len(words(r.text)) for r in clean}
    taken = collections.Counter()
    for r in mixed:
        taken[r.doc_id] += len(words(r.text))
    assert set(taken) <= set(sizes) and all(taken[i] <= 3 * sizes[i] for i in taken)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    at, rows = 0, []
    for r in sorted(mixed, key=lambda r: (r.doc_id, r.text)):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        rows.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokens)) == sorted(rows)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(rows)
