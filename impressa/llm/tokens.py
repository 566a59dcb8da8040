"""Token-ID output: byte-level BPE ids in Simple-8b blocks.

``encode_corpus`` writes a folder of Parquet files in ascending doc_id order; every row is one
block of whole documents::

    shard, block    place of the block: files in order of shard, blocks in order inside
    start           ids of all earlier blocks of the shard
    n_ids           ids in the block
    doc_ids, doc_lens   documents of the block and their numbers of ids, end id included
    payload         the coded ids

A payload holds, little-endian: b"S8B1", n_ids, n_words, n_escapes and STRIDE (4 bytes each); for
every STRIDE-th word the number of ids before it and the number of escapes before it (4 bytes
each); the words (8 bytes each); the escaped ids (4 bytes each).  The top four bits of a word select
how many codes of which width its other 60 bits hold, first code lowest.  The all-ones code of the
word's width stands for the next escaped id, so one large id does not widen its neighbours; which
width escapes is chosen per block by size.  Codes after the last id are zero padding.  With the
offsets a reader decodes any run of words on its own, all words of one selector at a time.

Defined cases: null text is an empty document (the end id alone); null doc_ids come first; rows
that repeat a doc_id are ordered by text; an empty table gives no rows; extra columns are ignored.
Blocks never split a document, so memory is bounded by the longest one.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.llm.textnum import chunks, prefix_hash, span_hash, text_buffer
from impressa.session import ensure_checkpoint_dir

END_ID, BLOCK_IDS, STRIDE = 0, 65_536, 1024
# Codes in a word and their width, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"S8B1"
# Bits that an id needs beside the all-ones code, which is taken.
_WIDTH = np.ceil(np.log2(np.arange(1 << 17) + 2.0)).astype(np.uint8)


def _sliding_max(width: np.ndarray):
    """Maximum of the next c widths at every place, for each count c, ascending; past the end
    counts as width 0."""
    n, have, now = len(width), 1, width
    for c in COUNTS[::-1]:
        while have < c:
            step = min(have, c - have)
            wider = now.copy()
            if step < n:
                np.maximum(now[:n - step], now[step:], out=wider[:n - step])
            now, have = wider, have + step
        yield c, now


def pack(ids: np.ndarray) -> bytes:
    """Simple-8b payload of an array of ids below 2^30."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    width = _WIDTH[ids] if n and ids.max() < len(_WIDTH) else np.ceil(np.log2(ids.astype(np.float64) + 2)).astype(np.uint8)
    hist = np.bincount(width, minlength=64)
    slot = np.array([60 / COUNTS[np.searchsorted(WIDTHS, max(w, 1))] for w in range(61)])
    costs = {w: (hist[:w + 1] * slot[:w + 1]).sum() + hist[w + 1:].sum() * 36 for w in (8, 10, 12, 15, 20, 30)}
    limit = min(costs, key=costs.get)
    escaped = width > limit
    width[escaped] = 1
    best = np.zeros(n, np.uint8)
    for s, (c, widest) in zip(range(len(COUNTS) - 1, -1, -1), _sliding_max(width)):
        best[widest <= WIDTHS[s]] = s
    choice, step, at, starts = best.tobytes(), COUNTS.tolist(), 0, []
    while at < n:
        starts.append(at)
        at += step[choice[at]]
    starts = np.array(starts, np.int64)
    sel = best[starts] if n else np.zeros(0, np.uint8)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    esc = np.concatenate([escaped, np.zeros(60, bool)])
    words = np.zeros(len(starts), np.uint64)
    for s in range(len(COUNTS)):
        at = np.flatnonzero(sel == s)
        if len(at):
            place = starts[at][:, None] + np.arange(COUNTS[s])
            codes = np.where(esc[place], np.uint64((1 << int(WIDTHS[s])) - 1), padded[place])
            codes <<= (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[at] = np.bitwise_or.reduce(codes, axis=1) | np.uint64(s << 60)
    out_of = ids[escaped].astype("<u4")
    before = np.concatenate([[0], np.cumsum(escaped)])[starts[::STRIDE]]
    head = np.array([n, len(words), len(out_of), STRIDE], "<u4").tobytes()
    return b"".join([MAGIC, head, starts[::STRIDE].astype("<u4").tobytes(), before.astype("<u4").tobytes(),
                     words.astype("<u8").tobytes(), out_of.tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """Ids of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, n_words, n_esc, stride = np.frombuffer(payload, "<u4", 4, 4).tolist()
    marks = -(-n_words // stride)
    at = 20 + 8 * marks
    words = np.frombuffer(payload, "<u8", n_words, at)
    escapes = np.frombuffer(payload, "<u4", n_esc, at + 8 * n_words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[sel])
    out = np.zeros(int(ends[-1]) if n_words else 0, np.uint32)
    lost = np.zeros(len(out), bool)
    for s in np.unique(sel):
        of = np.flatnonzero(sel == s)
        place = (ends[of] - COUNTS[s])[:, None] + np.arange(COUNTS[s])
        ones = np.uint64((1 << int(WIDTHS[s])) - 1)
        codes = (words[of][:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)) & ones
        out[place] = codes
        lost[place] = codes == ones
    if n_esc:
        out[lost] = escapes
    return out[:n]


# Bytes of ASCII and of the Latin letters U+00C0..U+00FF by kind: 0 other, 1 letter, 2 digit, 3 space.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KIND[0x80:0xC0] = 1
_KIND[0xC3] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b" \t\n\x0b\x0c\r")] = 3
_PLAIN = np.zeros(256, bool)
_PLAIN[:0xC0] = True
_PLAIN[0xC3] = True
_PLAIN[[0x27, 0x7C]] = False  # contractions and special-token strings take the library's own path


# Byte-level BPE names each byte by a visible character: itself, or the next one from U+0100 on.
_VISIBLE, _spare = {}, 256
for _b in range(256):
    if 33 <= _b <= 126 or 161 <= _b <= 172 or 174 <= _b:
        _VISIBLE[_b] = chr(_b)
    else:
        _VISIBLE[_b], _spare = chr(_spare), _spare + 1


def _plain(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents' pieces are exactly their runs of one kind of byte: ASCII without the
    characters that have rules of their own, and Latin letters from U+00C0 on."""
    bad = ~_PLAIN[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    bad |= ((buf & 0xC0) == 0x80) & ~after
    bad |= after & ((buf == 0x97) | (buf == 0xB7))
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = False
    return out


class Encoder:
    """Ids of texts by the ``tokenizers`` library.  Pieces the tokenizer would split a plain text
    into are found for a whole batch at once, and each distinct piece is encoded once."""

    KEEP = 3_000_000  # pieces remembered between batches

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)  # ids of known piece i: flat[at[i]:at[i + 1]]
        self.flat = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        # a piece needs no further splitting, so it goes straight to the library's BPE model
        ids = [[t.id for t in self.model.tokenize(p.decode("latin-1").translate(_VISIBLE))] for p in pieces]
        length = np.array([len(x) for x in ids], np.int64)
        flat = np.array([y for x in ids for y in x], np.uint32)
        if len(self.known) + len(keys) > self.KEEP:
            self.known, self.at, self.flat = self.known[:0], self.at[:1], self.flat[:0]
        known = np.concatenate([self.known, keys])
        sizes = np.concatenate([np.diff(self.at), length])
        flat = np.concatenate([self.flat, flat])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        order = np.argsort(known)
        sizes = sizes[order]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.flat = flat[np.repeat(starts[order] - self.at[:-1], sizes) + np.arange(self.at[-1])]
        self.known = known[order]

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each document) of a buffer of plain documents."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _KIND[data]
        space, blank = kind == 3, data == 0x20
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        run = cut[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        follows = np.zeros(n, bool)  # white space directly before a word of the same document
        follows[:-1] = space[:-1] & ~space[1:] & ~cut[1:-1]
        joined = np.zeros(n, bool)
        joined[1:] = (follows & blank)[:-1]
        first = (run & ~joined) | follows
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        keys = span_hash(prefix_hash(data), start, end)
        uniq, at, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != uniq[inside]
        if new.any():
            raw = data.tobytes()
            if len(self.known) + int(new.sum()) > self.KEEP:
                new[:] = True
            pieces = [raw[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())]
            self._learn(uniq[new], pieces)
            place = np.searchsorted(self.known, uniq)
        piece = place[back]
        sizes = (self.at[1:] - self.at[:-1])[piece]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.at[piece] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, offsets, "left")]

    def documents(self, buf: np.ndarray, offsets: np.ndarray):
        """Ids of each document of a batch, in order, without the end id."""
        for i, j in chunks(offsets, 2 << 20):
            part, off = buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            ok = _plain(part, off)
            other = iter(())
            if not ok.all():
                other = iter(self._library([bytes(part[off[k]:off[k + 1]]).decode() for k in np.flatnonzero(~ok)]))
                part = part[np.repeat(ok, np.diff(off))]
                off = np.concatenate([[0], np.cumsum(np.diff(off)[ok])])
            ids, before = self.plain(part, off)
            at = 0
            for o in ok:
                if o:
                    yield ids[before[at]:before[at + 1]]
                    at += 1
                else:
                    yield np.array(next(other), np.uint32)


_encoders: dict[str, Encoder] = {}

_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("payload", pa.binary())])
_BLOCK_DDL = "shard int, block long, start long, n_ids long, doc_ids array<long>, doc_lens array<int>, payload binary"


def _encode(path: str):
    def run(batches):
        from pyspark import TaskContext
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        shard = TaskContext.get().partitionId()
        held, names, lens, size, block, start = [], [], [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([
                pa.array([x], t.type) for x, t in zip(
                    (shard, block, start, size, names, lens, pack(np.concatenate(held))), _BLOCK)], schema=_BLOCK)

        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.documents(buf, offsets)):
                held.append(np.append(ids, np.uint32(END_ID)))
                names.append(doc_id)
                lens.append(len(held[-1]))
                size += lens[-1]
                if size >= BLOCK_IDS:
                    yield flush()
                    block, start = block + 1, start + size
                    held, names, lens, size = [], [], [], 0
        if held:
            yield flush()
    return run


def encode_corpus(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes (doc_id, text) as Simple-8b blocks under ``path``, shards in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(_encode(tokenizer), _BLOCK_DDL).write.parquet(path)


def _decode(batches):
    for batch in batches:
        for shard, start, names, lens, payload in zip(*(batch.column(c).to_pylist() for c in (
                "shard", "start", "doc_ids", "doc_lens", "payload"))):
            raw = memoryview(unpack(payload).astype("<u4")).cast("B")
            ends = np.cumsum([0, *lens])
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(lens), pa.int32()), pa.array(names, pa.int64()),
                 pa.array(start + ends[:-1]), pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    blocks = spark.read.parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    docs = blocks.select("shard", "start", "doc_ids", "doc_lens", "payload") \
        .mapInArrow(_decode, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(sums, "shard").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"),
                                           "n_tokens", "ids_crc32")


def token_digest(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes ``docs``, writes the files into the shared folder and reads them back."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{ensure_checkpoint_dir(spark)}/simple8b-{uuid.uuid4().hex}"
    encode_corpus(docs, path, str(tokenizer))
    return read_digest(spark, path)


@query("op1_simple8b_tokens")
def op1(spark, sf_dir):
    return token_digest(spark, table(spark, sf_dir, "documents"))
