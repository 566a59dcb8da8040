"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into words (runs of letters and digits, ASCII capitals lowered).  A word is the bag of its
character n-grams of ``GRAMS`` bytes, with its edges marked, and of the word itself, hashed into
``2 ** BITS`` rows of an embedding table; its vector is their mean, the text's vector the mean over its
words, and a softmax over two classes reads it.  Misspelt or unseen words share the n-gram vectors of
the words they resemble.

Training: from the labelled rows the caller allows, the ``MAX_ROWS`` with the smallest hash of doc_id (a
bounded, documented sample; below that bound, all) are dealt to shards of ``SHARD_ROWS``.  All shards start a round
from the same parameters and run AdaGrad over embeddings and softmax together; then every embedding row becomes
the mean of the shards' rows, weighted by how many of their texts use it, so a row that one shard alone
has seen keeps what it learnt.  ``ROUNDS`` such rounds follow one another.  Only parameters of a fixed size
travel.  Every text is scored whole: the softmax's difference is folded into one weight per embedding row,
so a score is a segmented sum.

Defined cases: null or empty texts have no word, the zero vector and the score of the bias; several
labels of one document count as toxic if any says so, null labels do not count; without any usable label every
score is 0.5; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.llm.textnum import LOWER, chunks, mix64, prefix_hash, rolling_hash, span_hash, text_buffer
from impressa.session import cut_lineage

BITS, DIM, GRAMS = 17, 8, (3, 4, 5)
MAX_ROWS, SHARD_ROWS, ROUNDS, EPOCHS = 20_000, 4_000, 3, 3
RATE, TOP_RATE, SEED = 30.0, 0.1, 13  # a text's shares are small, so embedding rows take long steps
BLOCK = 1024  # embedding rows that travel together
THRESHOLD = 0.7  # fixed by the contract

_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True


def features(buf: np.ndarray, offsets: np.ndarray):
    """(embedding row, share, features before each document) of a chunk of texts; a text's shares add up to 1."""
    docs = len(offsets) - 1
    data = np.insert(LOWER[buf], offsets, 32)  # an edge before every text and after the last
    data = np.where(_LETTER[data], data, 32).astype(np.uint8)
    off = offsets + np.arange(docs + 1)
    letter = data != 32
    gaps = np.concatenate([[0], np.cumsum(~letter)])
    begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    number = np.cumsum(np.concatenate([[False], letter[1:] & ~letter[:-1]])) - 1  # word at or before a byte
    hashes, words = [span_hash(prefix_hash(data), begin, end)], [np.arange(len(begin))]
    for k in GRAMS:
        if len(data) < k:
            continue
        # the inner bytes belong to one word; an edge byte may be its mark
        at = np.flatnonzero(gaps[k - 1:len(data)] == gaps[1:len(data) - k + 2])
        hashes.append(mix64(rolling_hash(data, k)[at] + np.uint64(k)))
        words.append(number[at + 1])
    word = np.concatenate(words)
    rows = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32)
    doc = np.searchsorted(off, begin, "right") - 1
    per_doc = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    share = 1.0 / (np.bincount(word, minlength=len(begin)) * per_doc[doc]) if len(begin) else np.zeros(0)
    of = doc[word]
    order = np.argsort(of, kind="stable")
    return rows[order], share[word[order]], np.searchsorted(of[order], np.arange(docs + 1), "left")


class Model:
    """Embeddings ``e`` (rows x DIM), their squared-gradient sums ``g``, softmax ``u`` (2 x DIM) and bias ``b``."""

    def __init__(self):
        r = np.random.default_rng(SEED)
        self.e = r.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        self.g = np.zeros(1 << BITS, np.float32)
        self.u = np.stack([-np.ones(DIM), np.ones(DIM)]).astype(np.float32) / np.sqrt(DIM)
        self.b = np.zeros(2, np.float32)
        self.ug, self.trained = 1e-3, False

    def weights(self) -> np.ndarray:
        """The logit of class 1 per unit of an embedding row, and behind it the bias."""
        if not self.trained:
            return np.zeros((1 << BITS) + 1)
        return np.append(self.e @ (self.u[1] - self.u[0]), self.b[1] - self.b[0]).astype(np.float64)

    def learn(self, rows: np.ndarray, share: np.ndarray, label: int) -> None:
        """One AdaGrad step on one text, in embeddings and softmax together."""
        e = self.e[rows]
        v = share @ e
        z = self.u @ v + self.b
        p = np.exp(z - z.max())
        d = p / p.sum()
        d[label] -= 1.0
        to_row = d @ self.u
        self.g[rows] += share * share * (to_row @ to_row)
        self.e[rows] = e - (RATE * share / np.sqrt(self.g[rows] + 1e-12))[:, None] * to_row[None, :]
        du = np.outer(d, v)
        self.ug += float((du * du).sum() + d @ d)
        step = TOP_RATE / np.sqrt(self.ug)
        self.u -= (step * du).astype(np.float32)
        self.b -= (step * d).astype(np.float32)


def _train(model: Model):
    """A round of one shard: blocks of embedding rows as (block, sums weighted by use), -1 for the softmax."""
    def run(t: pa.Table) -> pa.Table:
        mine = Model()
        mine.e, mine.g, mine.u, mine.b, mine.ug = (x.copy() if isinstance(x, np.ndarray) else x
                                                   for x in (model.e, model.g, model.u, model.b, model.ug))
        t = t.sort_by("h")
        buf, off = text_buffer(t.column("text"))
        label, texts = t.column("label").to_pylist(), []
        for i, j in chunks(off):
            rows, share, before = features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
            for k in range(j - i):
                at, back = np.unique(rows[before[k]:before[k + 1]], return_inverse=True)
                texts.append((at, np.bincount(back, share[before[k]:before[k + 1]], len(at)).astype(np.float32), label[i + k]))
        use = np.zeros(1 << BITS, np.float32)
        for at, _, _ in texts:
            use[at] += 1
        order = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            for k in order.permutation(len(texts)):
                mine.learn(*texts[k])
        out = np.concatenate([use[:, None], mine.g[:, None] * use[:, None], mine.e * use[:, None]], axis=1)
        blocks = [k for k in range((1 << BITS) // BLOCK) if use[k * BLOCK:(k + 1) * BLOCK].any()]
        flat = [out[k * BLOCK:(k + 1) * BLOCK].astype(np.float32).tobytes() for k in blocks]
        n = len(texts)
        top = np.concatenate([[n], mine.u.ravel() * n, mine.b * n, [mine.ug * n]]).astype(np.float32).tobytes()
        return pa.table({"block": pa.array([*blocks, -1], pa.int64()), "sums": pa.array([*flat, top], pa.binary())})
    return run


def _added(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.float32) for b in t["sums"].to_pylist()], axis=0, dtype=np.float64)
    return pa.table({"block": t["block"][:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


PARTS = "block long, sums binary"


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model after all rounds, from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1).
    The parameters, 2 ** BITS rows whatever the input, are all that reaches the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()) \
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = cut_lineage(usable.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows))
    shards = max(1, -(-sample.count() // SHARD_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id") \
        .dropDuplicates(["doc_id", "text"]).select("text", "label", "h", F.pmod("h", F.lit(shards)).alias("shard"))
    rows = cut_lineage(rows)
    model = Model()
    for _ in range(ROUNDS):
        parts = rows.groupBy("shard").applyInArrow(_train(model), PARTS).groupBy("block").applyInArrow(_added, PARTS).collect()
        for r in parts:
            sums = np.frombuffer(r["sums"], np.float32)
            if r["block"] < 0:
                mean = sums[1:] / sums[0]
                model.u, model.b, model.ug = mean[:2 * DIM].reshape(2, DIM), mean[2 * DIM:2 * DIM + 2], float(mean[-1])
                model.trained = True
            else:
                sums = sums.reshape(BLOCK, DIM + 2)
                used = np.flatnonzero(sums[:, 0])
                at = r["block"] * BLOCK + used
                model.g[at] = sums[used, 1] / sums[used, 0]
                model.e[at] = sums[used, 2:] / sums[used, :1]
    return model


def _score(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            out = []
            for i, j in chunks(off):
                rows, share, before = features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                # each text is added up from 0, so that its score does not depend on the texts before it
                logit = np.bincount(np.repeat(np.arange(j - i), np.diff(before)), weights[rows] * share, j - i) + weights[-1]
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(_score(model.weights()), "doc_id long, score double")


@query("op13_subword_toxicity")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score",
                                                 (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
