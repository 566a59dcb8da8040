"""Removal of repeated 100-byte strings by deep-shallow suffix sorting.

A byte is removed if a 100-byte string that covers it also starts earlier (in a document with a
smaller doc_id, or earlier in the same one).  Only suffixes that can repeat are sorted:

1. Each 100-byte string is owned by its anchor, the smallest (hashed) 16-byte string inside it, so
   equal strings have equal anchors at equal offsets.  Consecutive starts share an anchor; a run of
   them with its text is a region of at most 184 bytes.  Regions lie about 43 bytes apart.
2. Groups of documents send their distinct anchor hashes to hash buckets, which answer how often
   each occurs anywhere.  Regions whose anchor occurs once cannot repeat and are done.
3. Inside a group the remaining regions are sorted, and of equal ones only the earliest goes on; the
   others are removed on the spot.  So a text that is copied any number of times costs one
   region per group.
4. Buckets receive the regions by anchor and sort them in the same way; where an anchor has
   different regions, the suffixes at all their starts are sorted to depth 100 and all but the
   earliest of equal ones are removed.  An anchor with ``HOT`` occurrences or more is not sent as
   regions but as single 100-byte strings, spread by their own hash, so no bucket gathers it.
5. The removed stretches return to the documents' group.

Sorting is deep-shallow: a multikey quicksort over 8-byte symbols splits the suffixes down to a
shallow depth; groups that still share a long common prefix are ordered by blind tries, in which
a suffix is compared once with its group's first suffix and hangs at the place and byte where it
branches off.  Both run for all groups of a task at once.

Defined cases: null text is empty; a null doc_id comes after all others; rows that repeat a doc_id
are separate documents ordered by text; documents under 100 bytes lose nothing; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.llm.textnum import chunks, mix64, prefix_hash, rolling_hash, span_hash, text_buffer

LENGTH, ANCHOR, SHALLOW = 100, 16, 24
WINDOW = LENGTH - ANCHOR + 1
GROUP_BYTES, HOT, EXPANDED, STRETCH = 4 << 20, 100_000, 200_000, 1 << 17
_POSITION = np.uint64((1 << 22) - 1)


def symbols8(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one big-endian number; zeros follow the end."""
    out = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        wider = out << np.uint64(8 * step)
        wider[:-step] |= out[step:]
        out = wider
    return out


def _at_depth(sym: np.ndarray, start: np.ndarray, length: np.ndarray, depth) -> np.ndarray:
    """Symbols at ``start + depth``, cut off at the string's length."""
    left = np.clip(length - depth, 0, 8).astype(np.uint64)
    got = sym[np.minimum(start + depth, len(sym) - 1)]
    shift = (np.uint64(8) - left) * np.uint64(8)
    return np.where(left == 0, np.uint64(0), (got >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))


def _split(at: np.ndarray, label: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Labels after a round: places ``at`` hold members sorted by (label, keys); a group's label
    is its first place, so splitting one group leaves all others alone."""
    new = np.append(True, label[1:] != label[:-1])[:len(label)]
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return at[np.flatnonzero(new)][np.cumsum(new) - 1]


def _crowded(label: np.ndarray) -> np.ndarray:
    """Members of sorted groups of at least two."""
    same = label[1:] == label[:-1]
    return (np.append(same, False) | np.append(False, same))[:len(label)]


def deep_shallow(sym: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray):
    """Sorts strings by (group, bytes); gives (order, class of each place), equal strings of a
    group having one class.  Strings of a group have one length.  A round touches only members
    of groups that are not settled yet."""
    order = np.argsort(group, kind="stable")
    at = np.arange(len(order))
    label = _split(at, group[order]) if len(order) else at
    # shallow: multikey quicksort, one 8-byte symbol a round, only where a group is not a single string
    for depth in range(0, SHALLOW, 8):
        at = at[_crowded(label[at])]
        if not len(at):
            return order, label
        who, lab = order[at], label[at]
        lane = _at_depth(sym, start[who], length[who], depth)
        by = np.lexsort((lane, lab))
        order[at] = who[by]
        label[at] = _split(at, lab[by], lane[by])
    # deep: blind tries; every round hangs each member on the path of its group's first string
    depth = np.full(len(at), SHALLOW)
    go = _crowded(label[at]) & (depth < length[order[at]])
    at, depth = at[go], depth[go]
    while len(at):
        who, lab = order[at], label[at]
        first = np.append(True, lab[1:] != lab[:-1])
        head = who[np.flatnonzero(first)][np.cumsum(first) - 1]
        lcp, done = depth.copy(), np.zeros(len(at), bool)
        mine, theirs = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            a, b, d = who[live], head[live], lcp[live]
            diff = _at_depth(sym, start[a], length[a], d) ^ _at_depth(sym, start[b], length[b], d)
            apart = diff != 0
            over = ~apart & (d + 8 >= length[a])
            x, bits = live[apart], diff[apart]
            step = np.zeros(len(x), np.int64)
            for k in range(1, 8):
                step += bits < np.uint64(1 << (64 - 8 * k))
            lcp[x] += step
            mine[x] = (sym[start[who[x]] + lcp[x]] >> np.uint64(56)).astype(np.int64)
            theirs[x] = (sym[start[head[x]] + lcp[x]] >> np.uint64(56)).astype(np.int64)
            done[live[over]] = True
            live = live[~apart & ~over]
            lcp[live] += 8
        side = np.where(done, 1, np.where(mine < theirs, 0, 2))
        key = np.where(done, 0, np.where(side == 0, lcp, -lcp))
        byte = np.where(done, 0, mine)
        by = np.lexsort((byte, key, side, lab))
        order[at] = who[by]
        label[at] = now = _split(at, lab[by], side[by], key[by], byte[by])
        go = _crowded(now) & ~done[by]
        at, depth = at[go], lcp[by][go] + 1
    return order, label


def regions(buf: np.ndarray, offsets: np.ndarray):
    """(anchor hash, first start, last start, anchor place) of every region of the documents."""
    out: list = [[], [], [], []]
    for i, j in chunks(offsets, STRETCH):
        for a in range(int(offsets[i]), int(offsets[j]), 2 * STRETCH):  # a longer document goes in stretches
            b = min(int(offsets[j]), a + 2 * STRETCH + LENGTH - 1)
            data = buf[a:b]
            n = len(data) - ANCHOR + 1
            if n < WINDOW:
                continue
            hashed = rolling_hash(data, ANCHOR)
            least = (hashed & ~_POSITION) | np.arange(n, dtype=np.uint64)
            have = 1
            while have < WINDOW:
                step = min(have, WINDOW - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            ok = np.zeros(len(least), bool)  # starts whose 100 bytes lie in one document
            for lo, hi in zip(offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist()):
                ok[max(lo - a, 0):max(hi - a - LENGTH + 1, 0)] = True
            start = np.flatnonzero(ok)
            if not len(start):
                continue
            anchor = (least[start] & _POSITION).astype(np.int64)
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            last = np.append(first[1:], len(start)) - 1
            # anchors are minima, so their hashes are small; mixed again they fill the buckets evenly
            for to, x in zip(out, (mix64(~hashed[anchor[first]]), start[first] + a, start[last] + a, anchor[first] + a)):
                to.append(x)
    empty = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, t), *x]) for t, x in zip(empty, out))


def _texts(group: pa.Table):
    """(doc_ids, bytes, offsets) of a group in document order."""
    group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return (group.column("doc_id"), *text_buffer(group.column("text")))


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _cut(bucket: np.ndarray):
    """(bucket, from, to) of the runs of a sorted array."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(bucket)]))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _ask(bits: int):
    """Distinct anchor hashes of a group with their numbers, by bucket."""
    def run(key, group):
        _, buf, off = _texts(group)
        asked, times = np.unique(regions(buf, off)[0], return_counts=True)
        cuts = _cut(_bucket(asked, bits))
        return pa.table({"bucket": pa.array([c for c, _, _ in cuts], pa.int64()),
                         "g": pa.array([key[0].as_py()] * len(cuts), pa.int64()),
                         "asked": pa.array([asked[a:b].tobytes() for _, a, b in cuts], pa.binary()),
                         "times": pa.array([_pack(times[a:b].astype("<u4")) for _, a, b in cuts], pa.binary())})
    return run


def _answer(hot: int):
    """For each hash a group asked about: 0 it occurs once, 1 it repeats, 2 it is hot."""
    def run(key, asked):
        hashes = [np.frombuffer(b, np.uint64) for b in asked.column("asked").to_pylist()]
        times = [np.frombuffer(_unpack(b), "<u4") for b in asked.column("times").to_pylist()]
        _, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, np.concatenate(times))
        kind = ((total > 1).astype(np.uint8) + (total >= hot))[back].astype(np.uint8)
        at = np.cumsum([0, *map(len, hashes)])
        return pa.table({"g": asked.column("g"), "bucket": pa.array([key[0].as_py()] * len(hashes), pa.int64()),
                         "kinds": pa.array([_pack(kind[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())})
    return run


_RECORD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("anchor", "u1"), ("size", "<u2")])


def _copies(sym, where, size, group, doc, at):
    """Places of strings that equal an earlier one (by doc, then place) of their group, and the rest."""
    order, label = deep_shallow(sym, where, size, group)
    by = np.lexsort((at[order], doc[order], label))
    order, label = order[by], label[by]
    first = np.append(True, label[1:] != label[:-1])[:len(label)]
    return order[~first], order[first]


def _local(bits: int):
    """Sorts the repeated regions of a group; gives its removed stretches and, by bucket, the earliest
    of every class of equal regions."""
    def run(key, group, replies):
        g = key[0].as_py()
        ids, buf, off = _texts(group)
        out = {"bucket": [], "g": [], "marks": [], "records": [], "text": []}
        hashes, first, last, anchor = regions(buf, off)
        rows = sorted(zip(replies.column("bucket").to_pylist(), replies.column("kinds").to_pylist()))
        asked, back = np.unique(hashes, return_inverse=True)
        kind = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(_unpack(b), np.uint8) for _, b in rows)])[back] \
            if len(hashes) else np.zeros(0, np.uint8)
        use = kind > 0
        if use.any():
            hashes, first, last, anchor, kind = hashes[use], first[use], last[use], anchor[use], kind[use]
            doc = np.array([x if x is not None else (1 << 63) - 1 for x in ids.to_pylist()], np.int64)
            doc = doc[np.searchsorted(off, first, "right") - 1]
            sym = symbols8(buf)
            size, lead = last - first + LENGTH, anchor - first
            same = np.unique(mix64(hashes + (size * 256 + lead).astype(np.uint64)), return_inverse=True)[1]
            gone, kept = _copies(sym, first, size, same, doc, first)
            marks = [np.stack([first[gone], last[gone] + LENGTH], axis=1)]
            warm, hot = kept[kind[kept] == 1], kept[kind[kept] == 2]
            parts = [(hashes[warm], doc[warm], first[warm], lead[warm], size[warm])]
            if len(hot):  # every start on its own, of equal ones again only the earliest
                n = size[hot] - LENGTH + 1
                begin = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d, full = np.repeat(doc[hot], n), np.full(len(begin), LENGTH)
                own = span_hash(prefix_hash(buf), begin, begin + LENGTH)
                gone, kept = _copies(sym, begin, full, np.unique(own, return_inverse=True)[1], d, begin)
                marks.append(np.stack([begin[gone], begin[gone] + LENGTH], axis=1))
                parts.append((own[kept], d[kept], begin[kept], np.zeros(len(kept), np.int64), full[kept]))
            hashes, doc, first, lead, size = (np.concatenate(x) for x in zip(*parts))
            bucket = _bucket(hashes, bits)
            by = np.argsort(bucket, kind="stable")
            records = np.zeros(len(by), _RECORD)
            for name, x in zip(_RECORD.names, (hashes, doc, first, lead, size)):
                records[name] = x[by]
            for b, lo, hi in _cut(bucket[by]):
                r = records[lo:hi]
                n = r["size"].astype(np.int64)
                take = np.repeat(r["at"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out["bucket"].append(b)
                out["marks"].append(None)
                out["records"].append(_pack(r))
                out["text"].append(_pack(buf[take]))
            out["bucket"].append(g % (1 << bits))
            out["marks"].append(_pack(np.concatenate(marks).astype("<u4")))
            out["records"].append(None)
            out["text"].append(None)
            out["g"] = [g] * len(out["bucket"])
        return pa.table({c: pa.array(v, pa.int64() if c in ("bucket", "g") else pa.binary()) for c, v in out.items()})
    return run


def _merge(key, parts):
    """Sorts the regions of a bucket; gives the stretches to remove by group of documents."""
    out_g, out_marks = [], []
    records, texts, owner = [], [], []
    for g, marks, rec, text in zip(*(parts.column(c).to_pylist() for c in ("g", "marks", "records", "text"))):
        if marks is not None:
            out_g.append(g)
            out_marks.append(marks)
        else:
            records.append(np.frombuffer(_unpack(rec), _RECORD))
            texts.append(np.frombuffer(_unpack(text), np.uint8))
            owner.append(np.full(len(records[-1]), g))
    if records:
        rec, owner = np.concatenate(records), np.concatenate(owner)
        sym = symbols8(np.concatenate(texts))
        size, at, doc = rec["size"].astype(np.int64), rec["at"].astype(np.int64), rec["doc"]
        lead = rec["anchor"].astype(np.int64)
        where = np.cumsum(size) - size
        same = np.unique(mix64(rec["hash"] + (size * 256 + lead).astype(np.uint64)), return_inverse=True)[1]
        gone, kept = _copies(sym, where, size, same, doc, at)
        marks = [(owner[gone], at[gone], at[gone] + size[gone])]
        of = np.unique(rec["hash"][kept], return_inverse=True)[1]
        mixed = np.bincount(of)[of] > 1  # anchors with several different regions
        kept, of = kept[mixed], of[mixed]
        n = size[kept] - LENGTH + 1

        def starts(members, shift):
            label = of[members] * 256 + (lead[kept[members]] - shift)
            here, who = where[kept[members]] + shift, kept[members]
            gone, _ = _copies(sym, here, np.full(len(here), LENGTH), label, doc[who], at[who] + shift)
            marks.append((owner[who[gone]], at[who[gone]] + shift[gone], at[who[gone]] + shift[gone] + LENGTH))

        if n.sum() <= EXPANDED:
            members = np.repeat(np.arange(len(kept)), n)
            starts(members, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        else:  # strings that match have their anchor at the same offset
            for offset in range(WINDOW):
                shift = lead[kept] - offset
                members = np.flatnonzero((shift >= 0) & (shift < n))
                if len(members):
                    starts(members, shift[members])
        g, lo, hi = (np.concatenate(x) for x in zip(*marks))
        by = np.lexsort((lo, g))
        for one, a, b in _cut(g[by]):
            out_g.append(one)
            out_marks.append(_pack(np.stack([lo[by][a:b], hi[by][a:b]], axis=1).astype("<u4")))
    return pa.table({"g": pa.array(out_g, pa.int64()), "marks": pa.array(out_marks, pa.binary())})


def _remove(with_text: bool):
    def run(key, group, marks):
        return _without(group, marks, with_text)
    return run


def _without(group, marks, with_text):
    """A group's documents without the marked stretches."""
    ids, buf, off = _texts(group)
    spans = np.frombuffer(b"".join(map(_unpack, marks.column("marks").to_pylist())), "<u4").reshape(-1, 2)
    edge = np.zeros(len(buf) + 1, np.int32)
    for column, sign in ((0, 1), (1, -1)):
        np.add.at(edge, spans[:, column], np.int32(sign))
    gone = np.cumsum(edge)[:-1] > 0
    out = {"n_bytes": np.diff(off), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        g = gone[a:b]
        kept = buf[a:b][~g].tobytes()
        out["n_removed"].append(b - a - len(kept))
        out["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept if with_text else None)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.table({"doc_id": ids, **{c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)}})


def remove_repeats(docs: DataFrame, hot: int = HOT, group_bytes: int = GROUP_BYTES, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` has the bytes that
    remain (null without text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).collect()[0]["b"] or 0
    groups = max(1, -(-total // group_bytes))
    bits = int(groups - 1).bit_length()
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups))).groupBy("g")
    answers = dealt.applyInArrow(_ask(bits), "bucket long, g long, asked binary, times binary") \
        .groupBy("bucket").applyInArrow(_answer(hot), "g long, bucket long, kinds binary")
    local = dealt.cogroup(answers.groupBy("g")).applyInArrow(
        _local(bits), "bucket long, g long, marks binary, records binary, text binary")
    marks = local.groupBy("bucket").applyInArrow(_merge, "g long, marks binary")
    return dealt.cogroup(marks.groupBy("g")).applyInArrow(
        _remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


@query("op4_deep_shallow_dedup")
def op4(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
