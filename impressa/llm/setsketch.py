"""Near-duplicate documents by SetSketch registers.

Every document's set of distinct 5-word shingles is summarised by ``REGISTERS`` SetSketch
registers: register i is ``floor(1 - log_b x_i)`` truncated to a byte, where x_i is the minimum
over the set of exponential variables that depend only on (i, shingle).  Registers of a union are
the elementwise maxima, and two registers agree with a probability close to the Jaccard
similarity.

1. Documents with equal sets form a class (exact copies); its smallest doc_id goes on.
2. Bands of registers are joined on their values.  The rows of a band follow from the threshold: as
   many as let a pair at the threshold miss all bands with probability below 1e-6 (36 bands of 7
   at 0.85, 50 of 5 at 0.80).
3. Inside a bucket the similarity is estimated jointly from the greater, smaller and equal
   registers by likelihood: the likelihood is concave, so its slope at the screen, four
   standard errors below the threshold, tells on which side its maximum lies.  Only pairs whose
   maximum lies above go on.
4. A pair is a link if ``100 * intersection >= percent * union`` of the full shingle sets (85 in the
   query).
5. Links are contracted to components.  Step 3 runs twice: first it proposes all screened pairs of
   small buckets and, in large ones, for each member its hub and its best partner; then, with the
   components known, every screened pair that still lies in different components.  So a large
   group of copies costs links in proportion to its size, and no link that joins components is
   left out.  Buckets above ``BLOCK`` members are compared block by block, in the second run each pair of blocks in
   a group of its own, so memory stays bounded.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; a text of
1 to 4 words is one shingle; rows with a null doc_id are returned unlinked with a null component;
rows that repeat a doc_id with other texts are one document, represented by the set with the
smallest hash; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.llm.registry import query, table
from impressa.llm.textnum import chunks, mix64, shingle_hashes, text_buffer, word_hashes
from impressa.session import cut_lineage

REGISTERS, BASE, RATE = 252, 1.1, 20.0
SMALL, BLOCK = 16, 2048
FEW_IDS = 4_000_000  # 32 MB of ids


def screen_at(percent: int) -> float:
    """Four standard errors of an estimate from all registers below the threshold."""
    t = percent / 100
    return round(t - 4 * (t * (1 - t) / REGISTERS) ** 0.5, 2)


def band_rows(percent: int) -> int:
    """The most registers a band may have for a pair at the threshold to miss all bands with
    probability below 1e-6 (one if no number does)."""
    return max((r for r in range(1, 33) if (1 - (percent / 100) ** r) ** (REGISTERS // r) < 1e-6), default=1)


def _doc_sets(batch: pa.RecordBatch):
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    buf, off = text_buffer(batch.column("text"))
    for i, j in chunks(off):
        words, before = word_hashes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
        shingles, ends = shingle_hashes(words, before)
        for k in range(j - i):
            yield i + k, np.unique(shingles[ends[k]:ends[k + 1]])


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; the hash of element and register is a
    multiply-shift of the element's hash."""
    rng = np.random.default_rng(7)
    mult = rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at:at + 512, None] * mult
        part += add
        part ^= part >> np.uint64(32)
        part *= mult[::-1]
        np.minimum(least, part.min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 255).astype(np.uint8)


def _set_hash(hashes: np.ndarray) -> int:
    """64-bit hash of a set; as a sum it does not depend on the order."""
    return int(mix64(hashes.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _sketch(batches):
    for batch in batches:
        n, first, second, regs = [], [], [], []
        for _, s in _doc_sets(batch):
            n.append(len(s))
            first.append(_set_hash(s))
            second.append(_set_hash(s ^ np.uint64(0x5851F42D4C957F2D)))
            regs.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.int64()),
                                          pa.array(second, pa.int64()), pa.array(regs, pa.binary())],
                                         names=["doc_id", "n", "h1", "h2", "regs"])


def _full_sets(batches):
    for batch in batches:
        sets = [s.view(np.int64) for _, s in _doc_sets(batch)]
        first = [_set_hash(s) for s in sets]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(first, pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], names=["doc_id", "h1", "shingles"])


def screened(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = 85) -> np.ndarray:
    """Whether the joint likelihood of similarity of (a_i, b_i) is maximal above the screen."""
    screen = screen_at(percent)
    more = (a > b).sum(1, dtype=np.int64)
    less = (a < b).sum(1, dtype=np.int64)
    same = a.shape[1] - more - less
    u, c, log_b = na / (na + nb), (BASE - 1) / BASE, np.log(BASE)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-9) * c) / log_b
    slope = lambda x: c / (1 - np.maximum(x, 1e-9) * c) / log_b
    x, y = u - (1 - u) * screen, (1 - u) - u * screen
    p1, p2 = np.maximum(p(x), 1e-9), np.maximum(p(y), 1e-9)
    g1, g2 = -(1 - u) * slope(x), -u * slope(y)
    rise = more * g1 / p1 + less * g2 / p2 - same * (g1 + g2) / np.maximum(1 - p1 - p2, 1e-9)
    return (rise > 0) & (np.minimum(na, nb) >= screen * np.maximum(na, nb))


def _pairs(ids, regs, n, comp, side, small: bool, band: int):
    """Proposed pairs of one bucket (or of two blocks of it, told apart by ``side``)."""
    m = len(ids)
    two = side.min() != side.max()
    if comp is None and m > small:
        mode = np.array([np.bincount(regs[:, i], minlength=256).argmax() for i in range(0, REGISTERS, 4)], np.uint8)
        hub = int((regs[:, ::4] == mode).sum(1).argmax())
        rows, cols = [np.arange(m)], [np.full(m, hub)]
        for i in range(m):  # the best partner of each member
            agree = (regs[:, ::4] == regs[i, ::4]).sum(1)
            agree[i] = -1
            rows.append(np.array([i]))
            cols.append(np.array([agree.argmax()]))
        x, y = np.concatenate(rows), np.concatenate(cols)
        x, y = np.minimum(x, y), np.maximum(x, y)
        x, y = np.unique(np.stack([x, y])[:, x != y], axis=1)
        yield x, y
        return
    for i in range(m - 1):
        y = np.arange(i + 1, m)
        if two:
            y = y[side[y] != side[i]]
        if comp is not None:
            y = y[comp[y] != comp[i]]
        if len(y):
            yield np.full(len(y), i), y


def _propose(second: bool, percent: int):
    """Reads rows sorted by bucket; gives pairs (a < b) that pass the screen.  In the second run a
    pair that meets in several bands is given by the first of them only."""
    width = band_rows(percent)

    def run(batches):
        held: list = []

        def flush(rows):
            ids = np.concatenate([r[0] for r in rows])
            if len(ids) < 2:
                return None
            regs = np.concatenate([r[1] for r in rows])
            n = np.concatenate([r[2] for r in rows]).astype(np.float64)
            comp = np.concatenate([r[3] for r in rows])
            side = np.concatenate([r[4] for r in rows])
            band = int(rows[0][5])
            if second and (comp == comp[0]).all():
                return None
            out = []
            for x, y in _pairs(ids, regs, n, comp if second else None, side, SMALL, band):
                ok = screened(regs[x], regs[y], n[x], n[y], percent)
                x, y = x[ok], y[ok]
                if second and band and len(x):
                    before = regs[x, :band * width].reshape(len(x), band, width) == \
                        regs[y, :band * width].reshape(len(x), band, width)
                    first = ~before.all(2).any(1)
                    x, y = x[first], y[first]
                if len(x):
                    out.append(np.stack([ids[x], ids[y]]))
            if not out:
                return None
            got = np.concatenate(out, axis=1)
            got = np.unique(np.sort(got, axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "block", "id", "n", "comp", "side")}
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            change = np.flatnonzero((np.diff(cols["band"]) != 0) | (np.diff(cols["key"]) != 0) | (np.diff(cols["block"]) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                k = (cols["band"][s], cols["key"][s], cols["block"][s])
                if k != key:
                    if held and (got := flush(held)) is not None:
                        yield got
                    held, key = [], k
                held.append((cols["id"][s:e], regs[s:e], cols["n"][s:e], cols["comp"][s:e], cols["side"][s:e], k[0]))
        if held and (got := flush(held)) is not None:
            yield got
    return run


def _buckets(reps: DataFrame, percent: int) -> DataFrame:
    """(id, band, key, blocks): members of buckets that hold at least two representatives."""
    width = band_rows(percent)
    bands = REGISTERS // width
    rows = reps.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.substring("regs", i * width + 1, F.lit(width)))))
        .alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, ["band", "key"]).select("id", "band", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))


def _blocks(buckets: DataFrame, every_pair: bool) -> DataFrame:
    """``buckets`` with (block, side).  A bucket above BLOCK members is split into blocks by a hash that differs from
    band to band; with ``every_pair`` each pair of blocks is a group, else each block meets itself only."""
    own = buckets.withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int"))
    if not every_pair:
        return own.withColumn("block", F.col("own").cast("long")).withColumn("side", F.lit(0)).drop("own", "blocks")
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("block", F.least("own", "other").cast("long") * 1000003 + F.greatest("own", "other")) \
        .withColumnRenamed("own", "side").drop("other", "blocks")


def _proposals(buckets: DataFrame, reps: DataFrame, comps: DataFrame | None, percent: int) -> DataFrame:
    """Screened pairs.  The first run (no ``comps``) looks for some links of every block; the second one for
    every link between different components, in the buckets that still hold more than one."""
    info = reps.select("id", "n", "regs")
    if comps is None:
        rows = _blocks(buckets, False).join(info.withColumn("comp", F.col("id")), "id")
    else:
        comp = info.select("id").join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
        known = buckets.join(comp, "id")
        mixed = known.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi") \
            .select("band", "key")
        rows = _blocks(known.join(mixed, ["band", "key"], "left_semi"), True).join(info, "id")
    rows = rows.select("band", "key", "block", "id", "n", "comp", "side", "regs") \
        .repartition("band", "key", "block").sortWithinPartitions("band", "key", "block", "id")
    return rows.mapInArrow(_propose(comps is not None, percent), "a long, b long").distinct()


def _few(ids: DataFrame) -> DataFrame:
    """Distinct ids for a semi or anti join with the texts; sent to all executors only when a count
    shows that they are at most ``FEW_IDS``, so that the texts stay where they are."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold.  The sets are dealt by document once; both
    sides of a pair read that exchange."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(_few(used), "doc_id", "left_semi") \
        .mapInArrow(_full_sets, "doc_id long, h1 long, shingles array<long>") \
        .groupBy("doc_id").agg(F.min_by("shingles", "h1").alias("shingles"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b") \
        .withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return both.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))) \
        .select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable, for the ids in ``links`` (a, b), by alternating star
    contraction; every round is checkpointed, and a hot id meets only partial minima and joins."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = cut_lineage(after)
        mark = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        edges = after
        if mark == seen:
            break
        seen = mark
    return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut_lineage(docs.mapInArrow(_sketch, "doc_id long, n long, h1 long, h2 long, regs binary"))
    some = sketch.where("n > 0 and doc_id is not null").groupBy("doc_id") \
        .agg(F.min(F.struct("h1", "h2", "n")).alias("x")).select("doc_id", "x.*")
    classes = some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"))
    ids = cut_lineage(some.join(classes, ["h1", "h2", "n"]))
    members = ids.where("doc_id <> id").select("doc_id", "id")
    reps = cut_lineage(ids.where("doc_id = id").join(sketch.select("doc_id", "h1", "h2", "regs"), ["doc_id", "h1", "h2"])
                       .groupBy("id").agg(F.first("n").alias("n"), F.first("regs").alias("regs")))
    buckets = cut_lineage(_buckets(reps, percent))
    tried = cut_lineage(_proposals(buckets, reps, None, percent))
    first = cut_lineage(verified(tried, docs, percent))
    comps = cut_lineage(components(first))
    rest = cut_lineage(_proposals(buckets, reps, comps, percent).join(tried, ["a", "b"], "left_anti"))
    links = first.unionByName(verified(rest, docs, percent)) \
        .unionByName(members.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    final = components(links)
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")) \
        .join(final.select(F.col("id").alias("doc_id"), "comp"), "doc_id", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` without the documents that are not the first of their component.  Rows that repeat a
    doc_id are one document and stay or go together; rows with a null doc_id stay."""
    gone = cut_lineage(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct())
    return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)


@query("op7_setsketch_near_duplicates")
def op7(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
