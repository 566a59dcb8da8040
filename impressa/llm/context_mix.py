"""Language-model scoring by online logistic context mixing.

The model codes a text byte by byte (an end symbol last), each byte as eight binary decisions from
the high bit down.  Five contexts (the last 0 to 4 bytes) each have exact (zeros, ones) counts of
every bit node seen, which predict the next bit; the predictions are mixed in the logistic domain.  The weight of a
predictor is gated by its own count (how often its context was seen) and by the bit's place, and
an adaptive map from the mixed prediction to the observed frequency refines the result.  The
decisions of a context always sum to a proper distribution over bytes.

Documents are dealt to groups of a few megabytes.  Weights and map are learned in every group, going
through its training texts once, in growing chunks: the bits of a chunk are predicted from the
counts of what came before in the group, errors move the weights (a damped Newton step per weight)
and the map, then the chunk's counts are added.  The weights of all groups are averaged; they and the
map (a few kilobytes) alone go through the driver.  Since the bits of equal (four bytes, next byte)
strings cost the same, each distinct one of a chunk is handled once.

Scores use the counts of all training texts: each group asks for its distinct words and its distinct
(context, bit node) pairs once, hash buckets add up the training counts of all groups and answer.
So what is gathered grows with the training texts, and no count table is collected or sent to all.
Contexts are exact, words are 64-bit hashes.

Defined cases: null text is empty (one end token, one end symbol); a null doc_id counts as training
text of an id "" and is not held out; without any training text the model is uniform; repeated
rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.llm.textnum import LOWER, chunks, mix64, prefix_hash, span_hash, text_buffer, word_spans
from impressa.session import cut_lineage

PREDICTORS = 5
CONFIDENCE, MAP_BINS = 12, 33  # gates by count, bins of the final map
END = 0xFF  # never a byte of UTF-8
FIRST_CHUNK, CHUNK, GROUP_BYTES = 1 << 16, 4_000_000, 8 << 20
STEPS, RATE, PRIOR = 8, 0.5, 0.4


def symbols(buf: np.ndarray, offsets: np.ndarray):
    """(40-bit key of four preceding bytes and the byte itself of every symbol of a chunk, the end
    symbols included; first symbol of every text); before the first byte of a text the context is zero."""
    length = np.diff(offsets) + 1
    starts = np.cumsum(length) - length
    data = np.insert(buf, np.asarray(offsets[1:]) - offsets[0], np.uint8(END))
    keys = data.astype(np.uint64)
    for back in (1, 2):  # two bytes, then four
        keys[back:] |= keys[:-back] << np.uint64(8 * back)
    keys[4:] |= data[:-4].astype(np.uint64) << np.uint64(32)
    for inside in range(PREDICTORS - 1):
        keys[(starts + inside)[length > inside]] &= np.uint64((1 << (8 * inside + 8)) - 1)
    return keys, starts


def distinct(keys: np.ndarray):
    """(distinct keys, number of each, positions sorted by key) of at most 2^22 keys."""
    both = np.sort(keys << np.uint64(22) | np.arange(len(keys), dtype=np.uint64))
    keys = both >> np.uint64(22)
    first = _changes(keys)
    return keys[first], np.diff(np.append(first, len(keys))), (both & np.uint64(0x3FFFFF)).astype(np.int32)


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Positions where an ordered array takes a new value."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])


def ranked(values: np.ndarray, bits: int):
    """(values ascending, their former positions) of numbers below 2^bits."""
    if len(values) >= 1 << (64 - bits):
        order = np.argsort(values, kind="stable")
        return values[order], order
    low = np.uint64(64 - bits)
    both = np.sort(values << low | np.arange(len(values), dtype=np.uint64))
    return both >> low, (both & np.uint64((1 << (64 - bits)) - 1)).astype(np.int64)


def merged(parts, bits: int):
    """(distinct values ascending, their summed counts) of parts (values, counts by column)."""
    values, order = ranked(np.concatenate([v for v, _ in parts]), bits)
    first = _changes(values)
    counts = np.concatenate([c for _, c in parts], axis=-1)[..., order]
    return values[first], np.add.reduceat(counts, first, axis=-1) if len(first) else counts


def orders(keys: np.ndarray):
    """Distinct keys of each order, 0 to 4, and for each order above 0 the places of its keys among
    those of the order below; ``keys`` are the distinct ones of order 4, ascending."""
    short, below = [keys], []
    for order in range(PREDICTORS - 2, -1, -1):
        values, position = ranked(short[0] & np.uint64((1 << (8 * order + 8)) - 1), 8 * order + 8)
        new = np.append(True, values[1:] != values[:-1])[:len(values)]
        back = np.empty(len(values), np.int64)
        back[position] = np.cumsum(new) - 1
        short.insert(0, values[new])
        below.insert(0, back)
    return short, [None, *below]


def nodes(short: np.ndarray):
    """For each bit place: (bit of each key, its node's place among the distinct nodes, first key of
    each node, the distinct nodes ascending) of the distinct keys of an order; a node is the context
    and the bits before."""
    for place in range(8):
        prefix = short >> np.uint64(8 - place)
        new = np.append(True, prefix[1:] != prefix[:-1])[:len(prefix)]
        first = prefix[new]
        codes = (first >> np.uint64(place)) << np.uint64(8) | np.uint64(1 << place) | first & np.uint64((1 << place) - 1)
        yield ((short >> np.uint64(7 - place)) & np.uint64(1)).astype(np.int64), np.cumsum(new) - 1, np.flatnonzero(new), codes


def windows(offsets: np.ndarray, first: int = CHUNK):
    """Document ranges of growing size, up to ``CHUNK`` symbols; a longer document is a range alone."""
    target = first
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets + np.arange(n + 1), offsets[i] + i + target, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i, target = j, min(2 * target, CHUNK)


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Model:
    """Counts by node, weights and final map."""

    def __init__(self):
        self.codes = [np.zeros(0, np.uint64) for _ in range(PREDICTORS)]
        self.counts = [np.zeros((2, 0)) for _ in range(PREDICTORS)]  # float32 stops counting at 2^24
        self.weights = np.full((PREDICTORS, CONFIDENCE, 8), 0.3, np.float64)
        self.map = np.zeros((8, MAP_BINS, 2), np.float64)
        self.seen = 0.0

    def stretched(self, k: int, codes: np.ndarray):
        """(stretched prediction, gate) of nodes of predictor ``k``."""
        if not len(self.codes[k]):
            return np.zeros(len(codes)), np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes[k], codes), len(self.codes[k]) - 1)
        zeros, ones = self.counts[k][:, at] * (self.codes[k][at] == codes)
        return np.log((ones + PRIOR) / (zeros + PRIOR)), np.minimum(np.log2(zeros + ones + 1).astype(np.int64), CONFIDENCE - 1)

    def predictions(self, keys: np.ndarray):
        """For each bit place: (place, bit, per predictor (stretched prediction, gate))."""
        short, below = orders(keys)
        back = [np.arange(len(keys))]
        for b in below[:0:-1]:
            back.insert(0, b[back[0]])
        for place, found in enumerate(zip(*map(nodes, short))):
            parts = []
            for k, (_, node, _, codes) in enumerate(found):
                x, gate = self.stretched(k, codes)
                at = node[back[k]]
                parts.append((x[at], gate[at]))
            yield place, found[-1][0], parts

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Adds to the counts of the nodes of distinct ascending keys; those of a key with number 0 are
        known from then on."""
        if not len(keys):
            return
        short, below = orders(keys)
        for k in range(PREDICTORS - 1, -1, -1):
            parts = [(self.codes[k], self.counts[k])]
            for bit, _, first, codes in nodes(short[k]):
                ones, both = np.add.reduceat(times * bit, first), np.add.reduceat(times, first)
                parts.append((codes, np.stack([both - ones, ones])))
            self.codes[k], self.counts[k] = merged(parts, 8 * k + 8)
            if k:
                times = np.bincount(below[k], times, len(short[k - 1]))

    def mixed(self, place: int, parts, use=slice(None)):
        return sum(np.take(self.weights[k, :, place], gate[use]) * x[use] for k, (x, gate) in enumerate(parts))

    def refined(self, place: int, mixed: np.ndarray) -> np.ndarray:
        """Probability of a one: the squashed mix, moved half way to the frequency seen at it."""
        at = _bin(mixed)
        zeros, ones = self.map[place, at, 0], self.map[place, at, 1]
        trust = (zeros + ones) / (zeros + ones + 200.0)
        p = _squash(mixed)
        return np.clip(p + 0.5 * trust * ((ones + 0.5) / (zeros + ones + 1.0) - p), 1e-6, 1 - 1e-6)

    def learn(self, keys: np.ndarray, times: np.ndarray) -> None:
        """One online step over distinct keys with their numbers."""
        times = times.astype(np.float64)
        if self.seen:
            for place, bit, parts in self.predictions(keys):
                for step in range(STEPS):
                    use = slice(step, None, STEPS)
                    some = [(x[use], gate[use]) for x, gate in parts]
                    p = _squash(self.mixed(place, some))
                    wrong, slope = times[use] * (bit[use] - p), times[use] * np.maximum(p * (1 - p), 1e-4)
                    for k, (x, gate) in enumerate(some):
                        g = np.bincount(gate, wrong * x, CONFIDENCE)
                        h = np.bincount(gate, slope * x * x, CONFIDENCE)
                        self.weights[k, :, place] += RATE * g / (h * PREDICTORS + 50.0)
                at = _bin(self.mixed(place, parts))
                for b in (0, 1):
                    self.map[place, :, b] += np.bincount(at, times * (bit == b), MAP_BINS)
        self.add(keys, times)
        self.seen += times.sum()

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte after its context; distinct ascending keys.  The weighted
        predictions of an order are added up for its keys, and handed on to the order above."""
        total = np.zeros(len(keys))
        short, below = orders(keys)
        for place, found in enumerate(zip(*map(nodes, short))):
            mixed = 0.0
            for k, (_, node, _, codes) in enumerate(found):
                x, gate = self.stretched(k, codes)
                mixed = (x * self.weights[k, gate, place])[node] + (mixed[below[k]] if k else 0.0)
            p = self.refined(place, mixed)
            total += np.log10(np.where(found[-1][0] == 1, p, 1 - p))
        return total

    def learn_texts(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        for i, j in windows(offsets, CHUNK if self.seen > CHUNK else FIRST_CHUNK):
            keys, _ = symbols(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            for a in range(0, len(keys), 1 << 22):
                self.learn(*distinct(keys[a:a + (1 << 22)])[:2])

    def count_texts(self, buf: np.ndarray, offsets: np.ndarray, held: np.ndarray) -> None:
        """Adds the texts that are not ``held``; the nodes of all are known from then on."""
        parts = [(np.zeros(0, np.uint64), np.zeros(0))]
        for i, j in windows(offsets):
            keys, starts = symbols(buf[offsets[i]:offsets[j]], offsets[i:j + 1])
            both = np.sort(keys << np.uint64(1) | np.repeat(held[i:j], np.diff(np.append(starts, len(keys)))))
            keys = both >> np.uint64(1)
            first = _changes(keys)
            trained = np.append(0, np.cumsum((both & np.uint64(1)) == 0, dtype=np.int64))
            parts.append((keys[first], np.diff(trained[np.append(first, len(keys))]).astype(np.float64)))
        self.add(*merged(parts, 40))

    def score_texts(self, buf: np.ndarray, offsets: np.ndarray, counts=None) -> np.ndarray:
        """log10 probability of every text by the model's counts, or by what ``counts`` gives for the
        texts' nodes (by order, ascending)."""
        out, seen = np.zeros(len(offsets) - 1), []
        for i, j in windows(offsets):
            keys, starts = symbols(buf[offsets[i]:offsets[j]], offsets[i:j + 1])
            seen.append((i, j, starts, [distinct(keys[a:a + (1 << 22)]) for a in range(0, len(keys), 1 << 22)]))
        keys = [each for *_, parts in seen for each, _, _ in parts]
        if not keys:
            return out
        keys = np.unique(np.concatenate(keys))
        if counts is not None:
            short, _ = orders(keys)
            self.codes = [np.sort(np.concatenate([codes for *_, codes in nodes(s)])) for s in short]
            self.counts = counts(self.codes)
        cost = self.log10(keys)
        for i, j, starts, parts in seen:
            each = []
            for found, times, position in parts:
                at = np.empty(len(position))
                at[position] = np.repeat(cost[np.searchsorted(keys, found)], times)
                each.append(at)
            out[i:j] = np.add.reduceat(np.concatenate(each), starts)
        return out


def _bin(mixed: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(mixed * 2) + MAP_BINS // 2, 0, MAP_BINS - 1).astype(np.int64)


def _compress(a: np.ndarray) -> bytes:
    return len(a.tobytes()).to_bytes(8, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _expand(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), kind)


def _learn(key, group):
    """Weights and map, learned online from a group's training texts."""
    model = Model()
    held = group.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
    model.learn_texts(*text_buffer(group.filter(pa.array(~held)).column("text")))
    blob = [_compress(np.append(model.weights.ravel() * model.seen, model.seen)), _compress(model.map)] if model.seen else []
    return pa.table({"what": pa.array([-1, -2][:len(blob)], pa.int32()), "blob": pa.array(blob, pa.binary())})


def _add_up(batches):
    """Sums the blobs of each kind of a partition."""
    sums: dict = {}
    for batch in batches:
        for what, blob in zip(*(c.to_pylist() for c in batch.columns)):
            part = _expand(blob, np.float64)
            sums[what] = sums[what] + part if what in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(map(_compress, sums.values()), pa.binary())],
                                         names=["what", "blob"])


_PART = "what int, blob binary"


def train(dealt) -> Model:
    """Weights and map of all groups' training texts, without counts; the driver receives two rows."""
    parts = dealt.applyInArrow(_learn, _PART).mapInArrow(_add_up, _PART).repartition("what").mapInArrow(_add_up, _PART).collect()
    model = Model()
    for r in parts:
        part = _expand(r["blob"], np.float64)
        if r["what"] == -1:
            model.weights, model.seen = (part[:-1] / part[-1]).reshape(model.weights.shape), float(part[-1])
        else:
            model.map = part.reshape(model.map.shape).copy()
    return model


def _word_hashes(buf, off):
    start, end, before = word_spans(LOWER[buf], off)
    return span_hash(prefix_hash(LOWER[buf]), start, end), before


def _group_words(group: pa.Table):
    """(hash of every word, words before each document, held out) of a group."""
    buf, off = text_buffer(group.column("text"))
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in chunks(off):
        h, before = _word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        hashes.append(h)
        counts.append(np.diff(before))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), \
        group.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def _dealt_nodes(by_order, bucket_bits: int):
    """(nodes of all orders, bucket of each, positions sorted by bucket)."""
    codes = np.concatenate([c | np.uint64(k << 40) for k, c in enumerate(by_order)])
    bucket = (mix64(codes >> np.uint64(8)) >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(codes), np.int64)
    return codes, bucket, ranked(bucket.astype(np.uint64), max(bucket_bits, 1))[1]


def _ask(bucket_bits: int):
    """A group's distinct words and nodes with their training counts, cut into hash buckets; those of
    nodes are numbered from -1 down."""
    def run(key, group):
        words, before, held = _group_words(group)
        asked = np.unique(words)
        seen, times = np.unique(words[~np.repeat(held, np.diff(before))], return_counts=True)
        counts = np.zeros(len(asked), np.uint32)
        counts[np.searchsorted(asked, seen)] = times
        bucket = (asked >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(asked), np.int64)
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(asked)) if len(asked) else [0]
        spans = list(zip(edges[:-1], edges[1:]))
        rows = [(int(bucket[a]), asked[a:b].tobytes(), _compress(counts[a:b])) for a, b in spans]
        model = Model()
        model.count_texts(*text_buffer(group.column("text")), held)
        codes, bucket, order = _dealt_nodes(model.codes, bucket_bits)
        both = np.concatenate(model.counts, axis=1).astype(np.uint32)
        ends = np.cumsum(np.bincount(bucket))
        for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if a < b:
                at = order[a:b]
                rows.append((-1 - k, _compress(np.diff(codes[at], prepend=np.uint64(0))), _compress(both[:, at])))
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "g": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "asked": pa.array([r[1] for r in rows], pa.binary()),
            "counts": pa.array([r[2] for r in rows], pa.binary())})
    return run


def _answer(key, asked):
    """Counts over all groups for what each group asked of one bucket; group -1 gets the bucket's
    numbers of distinct and of all training words."""
    if key[0].as_py() < 0:
        return _answer_nodes(key, asked)
    hashes = [np.frombuffer(b, np.uint64) for b in asked.column("asked").to_pylist()]
    counts = [_expand(b, np.uint32) for b in asked.column("counts").to_pylist()]
    _, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    at = np.cumsum([0, *map(len, hashes)])
    replies = [_compress(total[back[a:b]]) for a, b in zip(at[:-1], at[1:])]
    n = len(replies)
    return pa.table({"g": pa.array([*asked.column("g").to_pylist(), -1], pa.int64()),
                     "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
                     "counts": pa.array([*replies, None], pa.binary()),
                     "v": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
                     "n": pa.array([0] * n + [int(total.sum())], pa.int64())})


def _answer_nodes(key, asked):
    codes = [np.cumsum(_expand(b, np.uint64)) for b in asked.column("asked").to_pylist()]
    at = np.cumsum([0, *map(len, codes)])
    _, back = np.unique(np.concatenate(codes), return_inverse=True)
    counts = np.concatenate([_expand(b, np.uint32).reshape(2, -1) for b in asked.column("counts").to_pylist()], axis=1)
    total = np.stack([np.bincount(back, c).astype(np.int64) for c in counts])
    n = len(codes)
    return pa.table({"g": asked.column("g").cast(pa.int64()), "bucket": pa.array([key[0].as_py()] * n, pa.int64()),
                     "counts": pa.array([_compress(total[:, back[a:b]]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
                     "v": pa.array([0] * n, pa.int64()), "n": pa.array([0] * n, pa.int64())})


_DIGEST = "doc_id long, held_out boolean, words long, known long, base double, score double, bytes long, v long, n long"


def _scores(learned: Model, group: pa.Table, rows, bucket_bits: int) -> np.ndarray:
    """Scores of a group's texts with the learned weights and map and the answered counts of its nodes."""
    def counts(by_order):
        _, _, order = _dealt_nodes(by_order, bucket_bits)
        both = np.empty((2, len(order)))
        both[:, order] = np.concatenate([_expand(b, np.int64).reshape(2, -1) for _, b in rows], axis=1)
        ends = np.cumsum([0, *map(len, by_order)])
        return [both[:, a:b] for a, b in zip(ends[:-1], ends[1:])]

    model = Model()
    model.weights, model.map, model.seen = learned.weights, learned.map, learned.seen
    return model.score_texts(*text_buffer(group.column("text")), counts)


def _score(model, bucket_bits: int):
    """Scores a group's documents with the model and the answered counts."""
    def run(key, group, replies):
        out = {"doc_id": group.column("doc_id").to_pylist()}
        docs = len(out["doc_id"])
        if docs:
            words, before, held = _group_words(group)
            asked, back = np.unique(words, return_inverse=True)
            rows = sorted(zip(replies.column("bucket").to_pylist(), replies.column("counts").to_pylist()))
            count = np.concatenate([np.zeros(0, np.int64), *(_expand(b, np.int64) for k, b in rows if k >= 0)])[back]
            scores = _scores(model.value, group, [r for r in reversed(rows) if r[0] < 0], bucket_bits)
            doc = np.repeat(np.arange(docs), np.diff(before))
            out |= {"held_out": held, "words": np.diff(before), "known": np.bincount(doc, count > 0, docs).astype(np.int64),
                    "base": np.bincount(doc, np.log10(count + 1.0), docs)}
            out |= {"score": scores, "bytes": np.diff(text_buffer(group.column("text"))[1]), "v": [0] * docs, "n": [0] * docs}
        else:  # the stray group -1: totals
            out = {"doc_id": [None], "held_out": [None], "words": [-1], "known": [0], "base": [0.0], "score": [0.0], "bytes": [0],
                   "v": [sum(replies.column("v").to_pylist())], "n": [sum(replies.column("n").to_pylist())]}
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})
    return run


def score_corpus(spark: SparkSession, docs: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of
    every row; the rows that are not ``held_out`` are the training texts.  The bits are those of the
    whole text and its end symbol; null for an empty text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"),
                    F.sum((~F.col("held_out")).cast("long")).alias("train")).collect()[0]
    groups = max(1, -(-(size["b"] or 0) // GROUP_BYTES))
    bits = int(groups - 1).bit_length()
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))).groupBy("g")
    model = spark.sparkContext.broadcast(train(dealt))
    answers = dealt.applyInArrow(_ask(bits), "bucket long, g long, asked binary, counts binary") \
        .groupBy("bucket").applyInArrow(_answer, "g long, bucket long, counts binary, v long, n long")
    scored = cut_lineage(dealt.cogroup(answers.groupBy("g")).applyInArrow(_score(model, bits), _DIGEST))
    totals = scored.where("words < 0").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()[0]
    ends = size["train"] or 0
    v, n = (totals["v"] or 0) + (1 if ends else 0), (totals["n"] or 0) + ends
    tokens = F.col("words") + 1
    return scored.where("words >= 0").select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 1.0)) - tokens * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
        F.col("bytes").alias("n_bytes"), F.when(F.col("bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("bytes")).alias("bits_per_byte"))


@query("op6_context_mix_scores")
def op6(spark, sf_dir):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_corpus(spark, table(spark, sf_dir, "documents"), held)
