"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is cut into words (runs of letters, of digits, of other characters).  Features are hashed
into ``2 ** BITS`` coordinates: words and word pairs, shapes of words (capitals, digits, the
punctuation itself) alone, in pairs and in threes, and whether a word repeats one of the two before it.
A feature's value is its share of the text's features of that family, so long and short texts are
comparable and a score is one sparse dot product, a segmented sum over a batch.

Training uses every labelled row the caller allows.  Rows are dealt to shards of about
``SHARD_ROWS`` rows by a hash of doc_id; each shard runs FTRL-proximal over its rows in hash order,
and the shards' weights are averaged, weighted by rows, by a Spark aggregation per coordinate.
Only the averaged model, at most ``2 ** BITS`` numbers, reaches the driver and the scoring tasks.

Defined cases: null or empty texts have no feature and get the intercept's score; several labels
of one document count as good only if all say so, null labels do not count; without any usable
label every score is 0.5; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.llm.textnum import chunks, mix64, prefix_hash, span_hash, text_buffer
from impressa.session import cut_lineage

BITS, SHARD_ROWS, MAX_BROADCAST = 18, 4_000, 1_000_000
ALPHA, BETA, L1, L2, EPOCHS = 6.0, 1.0, 1e-4, 1e-4, 3
FAMILIES = 6
THRESHOLD = 0.3  # fixed by the contract

# Kinds of bytes: 1 letter (bytes of longer characters count as letters), 2 digit, 3 separator, 4 other.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x80:] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b" \t\n\x0b\x0c\r")] = 3


def _case(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end a capital, and bytes that end a small letter (ASCII and Latin-1)."""
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (after & (data <= 0x9E))
    lower = ((data >= 97) & (data <= 122)) | (after & (data >= 0x9F))
    return upper, lower


def features(buf: np.ndarray, offsets: np.ndarray):
    """(coordinate, value, features before each document) of a chunk of texts, doc by doc."""
    docs = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(docs + 1, np.int64)
    kind = _KIND[buf]
    run = np.zeros(len(buf) + 1, bool)
    run[offsets] = True
    run = run[:-1]
    run[1:] |= kind[1:] != kind[:-1]
    edge = np.append(np.flatnonzero(run), len(buf))
    word = kind[edge[:-1]] != 3
    start, end = edge[:-1][word], edge[1:][word]
    before = np.searchsorted(start, offsets, "left")
    n = len(start)
    doc = np.repeat(np.arange(docs), np.diff(before))
    exact = span_hash(prefix_hash(buf), start, end)
    upper, lower = (np.concatenate([[0], np.cumsum(x)]) for x in _case(buf))
    ups, downs, k = upper[end] - upper[start], lower[end] - lower[start], kind[start]
    shape = (np.minimum(ups, 2) * 2 + np.minimum(downs, 1) + 8 * np.minimum(end - start, 3)).astype(np.uint64)
    shape = mix64(np.where(k == 4, exact, np.where(k == 2, np.minimum(end - start, 9).astype(np.uint64) + np.uint64(1000), shape)))

    def joined(values, back):
        out = values.copy()
        for b in range(1, back + 1):
            prior = np.zeros(n, np.uint64)
            prior[b:] = np.where(doc[b:] == doc[:-b], values[:-b], np.uint64(0))
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + prior)
        return out

    same = np.zeros(n, np.uint64)
    for b in (1, 2):
        same[b:] += ((exact[b:] == exact[:-b]) & (doc[b:] == doc[:-b])).astype(np.uint64)
    families = [exact, joined(exact, 1), shape, joined(shape, 1), joined(shape, 2), same]
    hashed = np.stack([mix64(f + np.uint64((i + 1) * 0xA24BAED4963EE407 % 2 ** 64)) for i, f in enumerate(families)], axis=1)
    coords = (hashed >> np.uint64(64 - BITS)).astype(np.int64).ravel()
    values = np.repeat(1.0 / np.maximum(np.diff(before), 1)[doc], FAMILIES)
    return coords, values, before * FAMILIES


def _weights(z, n):
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last is the intercept) after ``EPOCHS`` passes over (coordinates, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for at, x, y in rows:
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return _weights(z, n)


def _train(batches):
    """One shard per key, rows sorted by shard; gives (coordinate, weight * rows, rows)."""
    rows: list = []
    key = None

    def flush():
        w = ftrl(rows)
        at = np.flatnonzero(w)
        # coordinate -1 carries the shard's number of rows
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at] * len(rows), len(rows)))],
                                          names=["at", "w"])

    for batch in batches:
        buf, off = text_buffer(batch.column("text"))
        label, shard = batch.column("label").to_pylist(), batch.column("shard").to_pylist()
        for i, j in chunks(off):
            coords, values, before = features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
            for k in range(j - i):
                if shard[i + k] != key:
                    if rows:
                        yield flush()
                    rows, key = [], shard[i + k]
                a, b = before[k], before[k + 1]
                at, back = np.unique(coords[a:b], return_inverse=True)
                x = np.bincount(back, values[a:b], len(at)) if len(at) else np.zeros(0)
                rows.append((np.append(at, 1 << BITS), np.append(x, 1.0), label[i + k]))
    if rows:
        yield flush()


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Averaged weights from ``docs`` (doc_id, text) with ``labels`` (doc_id, label 0/1)."""
    usable = cut_lineage(labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
                         .groupBy("doc_id").agg(F.min("label").cast("int").alias("label")))
    count = usable.count()
    shards = max(1, -(-count // SHARD_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(usable) if count <= MAX_BROADCAST else usable, "doc_id") \
        .withColumn("h", F.xxhash64("doc_id")).withColumn("shard", F.pmod("h", F.lit(shards)))
    sums = rows.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text").select("text", "label", "shard") \
        .mapInArrow(_train, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).collect()  # bounded by 2^BITS
    model = np.zeros((1 << BITS) + 1)
    found = {r["at"]: r["w"] for r in sums}
    total = found.pop(-1, 0.0)
    if total:
        model[list(found)] = np.array(list(found.values())) / total
    return model


def _score(model: np.ndarray):
    weights = model.astype(np.float32)

    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            out = []
            for i, j in chunks(off):
                coords, values, before = features(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                total = np.concatenate([[0.0], np.cumsum(weights[coords].astype(np.float64) * values)])
                logit = total[before[1:]] - total[before[:-1]] + float(weights[-1])
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(_score(model), "doc_id long, score double")


@query("op8_ftrl_quality")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
