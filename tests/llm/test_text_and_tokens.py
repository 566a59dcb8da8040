"""Text helpers, Simple-8b round trips and the token files against the library itself."""
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from impressa.llm import textnum as X
from impressa.llm import tokens as K
from util import DOCS, edge_docs, lower, no_docs, words


def _buffer(texts):
    return X.text_buffer(pa.chunked_array([pa.array(texts, pa.string())]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b x한\x85\xa0.", max_size=30)), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    buf, off = _buffer(texts)
    hashes, before = X.word_hashes(buf, off)
    seen = {}
    for k, t in enumerate(texts):
        w = words(lower(t))
        assert before[k + 1] - before[k] == len(w)
        for word, h in zip(w, hashes[before[k]:before[k + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    shingles, ends = X.shingle_hashes(hashes, before)
    for k, t in enumerate(texts):
        w = words(lower(t))
        assert ends[k + 1] - ends[k] == (max(1, len(w) - 4) if w else 0)
    if len(buf) > 8:
        assert (X.rolling_hash(buf, 8) == X.span_hash(X.prefix_hash(buf), np.arange(len(buf) - 7), np.arange(8, len(buf) + 1))).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2 ** 30 - 2)), max_size=400))
def test_simple8b_round_trip(ids):
    assert K.unpack(K.pack(np.array(ids, np.uint32))).tolist() == ids


def test_simple8b_long_runs_and_offsets():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.zeros(5000, int), rng.integers(0, 50_257, 20_000), [2 ** 30 - 2]]).astype(np.uint32)
    payload = K.pack(ids)
    assert (K.unpack(payload) == ids).all()
    n, n_words, _, stride = np.frombuffer(payload, "<u4", 4, 4).tolist()
    marks = np.frombuffer(payload, "<u4", -(-n_words // stride), 20)
    assert n == len(ids) and marks[0] == 0 and (np.diff(marks.astype(int)) > 0).all()


@pytest.fixture(scope="module")
def path():
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _library(path, text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(path):
    rng = random.Random(3)
    texts = ["", "a  b\n\n c\t\td  ", "don't we'll <|endoftext|>", "café Ünü ×2 ÷ 1,234.5 \r\n é÷", " \n a", "x\x1c\x85y 한국"]
    texts += ["".join(rng.choice("ab é1.,! \n\tÀ'") for _ in range(60)) for _ in range(300)]
    buf, off = _buffer(texts)
    got = [x.tolist() for x in K.Encoder(path).documents(buf, off)]
    assert got == [_library(path, t) for t in texts]


def test_digest_of_the_files(spark, path):
    docs = edge_docs(spark)
    got = [tuple(r) for r in K.token_digest(spark, docs, path).collect()]
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*_library(path, text), K.END_ID], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert K.token_digest(spark, no_docs(spark), path).count() == 0
    clash = docs.withColumnsRenamed({"lang": "shard", "source": "start"})
    assert K.token_digest(spark, clash, path).count() == len(want) and DOCS
