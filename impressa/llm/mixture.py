"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom but fixed order, form one sequence that
is packed into blocks of ``BLOCK`` words.  The output consists of shards of equally many slots.  Every
shard draws its source counts: the whole part of a source's expected count is certain, and the slots
left over are one multinomial draw over the fractional parts (residual multinomial sampling), so a
shard's counts are random with the right means and a source's total stays within a few blocks of its
target.  The counts decide what is taken: a source's slots are numbered through the shards in order.
Slot k of a source is pass ``k div blocks`` over its blocks, and a keyed
permutation of the block indices, one per pass, says which block it takes (swap-or-not shuffle,
a bijection for any number of blocks).  Blocks are joined to the document pieces by index.  A
source has at most three passes; slots that a draw gives it beyond them stay empty, so no word is taken more than
three times.

Positions are prefix sums over (source, bucket): documents of a source are hashed into buckets of
about a million words, summed inside a bucket and offset by the bucket totals, so a source that
holds a third of all rows is spread like any other.  Slots are expanded in chunks, never from one
row.  Only DataFrame functions run.

Defined cases: null source is the last source; null, empty or blank texts have size 0, are never
taken and stay in the report; equal rows are separate documents; empty input gives empty
output; extra columns pass through ``mixed_documents`` (names that begin with two underscores are
reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.exprs import let, words
from impressa.llm.registry import query, table
from impressa.session import cut_lineage

BLOCK, SHARD, PASSES, SEED, ROUNDS = 64, 4096, 3, 20240, 24
MAX_SHARDS = 1_000_000  # of an output; beyond it shards grow
BUCKET_WORDS, MAX_BROADCAST = 1_000_000, 20_000


def targets(sized: DataFrame) -> DataFrame:
    """(source, sid, source_size, target, blocks, slots), one row per source.

    The reshared targets are a water level: ordered by cap / weight, a source stops at its cap
    exactly if filling all sources to its ratio takes no more than the total."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(named)).withColumn("w", (1 + (F.col("sid") - 1) % 3).cast("double")) \
        .withColumn("cap", (PASSES * F.col("source_size")).cast("double"))
    everything, upto = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    per = per.withColumns({"total": F.sum("source_size").over(everything).cast("double"),
                           "all_w": F.sum("w").over(everything),
                           "cap_to": F.sum("cap").over(upto), "w_to": F.sum("w").over(upto)})
    per = per.withColumn("full", F.col("cap_to") + F.col("cap") / F.col("w") * (F.col("all_w") - F.col("w_to")) <= F.col("total"))
    per = per.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything),
                           "w_full": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(everything)})
    level = (F.col("total") - F.col("cap_full")) / F.nullif(F.col("all_w") - F.col("w_full"), F.lit(0.0))
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap"))))
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    slots = F.when(blocks > 0, F.least(F.round(F.col("target") / F.col("source_size") * blocks), PASSES * blocks)) \
        .otherwise(0).cast("long")
    return per.select("source", "sid", "source_size", "target", blocks.alias("blocks"), slots.alias("slots"))


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Image of ``i`` under a keyed bijection of 0..n-1."""
    def step(x: Column, r: Column) -> Column:
        turn = F.pmod(F.xxhash64(F.lit(SEED), *key, r), n)
        return let(F.pmod(turn - x, n), lambda y: F.when(
            F.xxhash64(F.lit(SEED + 1), *key, r, F.greatest(x, y)).bitwiseAND(1) == 1, y).otherwise(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, step)


def _sources_side(sources: DataFrame) -> DataFrame:
    """Broadcast only a checked number of sources; else the adaptive join splits hot ones."""
    return F.broadcast(sources) if sources.count() <= MAX_BROADCAST else sources


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with sid, size and the start of their words in the source's sequence; sources)."""
    key = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
    sized = cut_lineage(docs.select(key.alias("__k"), "doc_id", F.col("source").alias("source"),
                                    F.size(words(F.col("text"))).cast("long").alias("size")))
    sources = cut_lineage(targets(sized))
    named = _sources_side(sources.withColumnRenamed("source", "__s"))
    d = sized.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    buckets = F.floor(F.col("source_size") / BUCKET_WORDS) + 1
    d = d.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "__k"), buckets))
    inside = Window.partitionBy("sid", "bucket").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = d.join(sums, ["sid", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
    return cut_lineage(placed.select("__k", "doc_id", "sid", "size", "source_size", "target", "start")), sources


def shard_counts(sources: DataFrame, shard_slots: int = SHARD) -> DataFrame:
    """(shard, sid, blocks, n, first): how many slots each output shard draws from each source, and the number of
    the first of them among the source's slots.  One row per shard and source with a target."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).collect()[0]["n"]
    shard_slots = max(shard_slots, -(-total // MAX_SHARDS))
    shards = max(1, -(-total // shard_slots))
    rows = sources.where("slots > 0").select("sid", "blocks", "slots", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    size = F.when(F.col("shard") < shards - 1, F.lit(shard_slots)).otherwise(F.lit(total - (shards - 1) * shard_slots)).cast("long")
    mean = F.col("slots").cast("double") * size / F.lit(float(max(total, 1)))
    rows = rows.withColumn("sure", F.floor(mean + 1e-9)).withColumn("part", F.greatest(mean - F.col("sure"), F.lit(0.0)))
    whole, order = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy("sid")
    upto = F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"upto": upto, "left": (size - F.sum("sure").over(whole)).cast("int"), "parts": F.sum("part").over(whole)})
    rows = rows.withColumns({"low": F.coalesce(F.lag("upto").over(order), F.lit(0.0)),
                             "high": F.when(F.lead("upto").over(order).isNotNull(), F.col("upto")).otherwise(float("inf"))})

    def drawn(i: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", i), F.lit(1 << 52)).cast("double") / float(1 << 52)
        return (u * F.col("parts") >= F.col("low")) & (u * F.col("parts") < F.col("high"))

    draws = F.when(F.col("left") > 0, F.sequence(F.lit(1), F.col("left"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("n", F.col("sure") + F.size(F.filter(draws, drawn)))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("shard", "sid", "blocks", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))


def mix(placed: DataFrame, sources: DataFrame, shard_slots: int = SHARD) -> DataFrame:
    """The mix: (shard, slot, sid, block, pass, start, from_word, n_words), one row per document
    piece of a slot; (sid, start) is the document."""
    counts = shard_counts(sources, shard_slots).where("n > 0") \
        .repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "shard")
    slots = counts.select("shard", "sid", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("k")) \
        .where(F.col("k") < F.col("blocks") * PASSES)
    slots = slots.withColumn("pass", F.floor(F.col("k") / F.col("blocks"))).select(
        "sid", "k", "pass", "shard",
        permuted(F.pmod("k", "blocks"), F.col("blocks"), F.col("sid"), F.col("pass")).alias("block"))
    slots = slots.withColumn("slot", F.row_number().over(
        Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 3), "sid", "k"), "sid", "k")))
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    pieces = placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * BLOCK)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    pieces = pieces.select("sid", "block", "start", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"))
    # both sides grow with the corpus; expanded slots look as small as the table of sources to the planner
    return slots.hint("merge").join(pieces, ["sid", "block"]).select("shard", "slot", "sid", "block", "pass", "start", "from_word", "n_words")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``: for every pass, the words of a document
    that the pass takes, with the white space that follows them.  A document the mix leaves out
    is gone; one it takes n times has up to n rows.  Rows lie by output shard, in the order of the first
    slot that takes of them."""
    placed, sources = located(docs)
    taken = mix(placed, sources).groupBy("sid", "start", "pass") \
        .agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias("pieces"), F.min(F.struct("shard", "slot")).alias("at"))
    rows = taken.join(placed.where("size > 0").select("__k", "sid", "start"), ["sid", "start"]) \
        .select("__k", F.col("pieces").alias("__pieces"), F.col("at.shard").alias("__shard"), F.col("at.slot").alias("__slot"))
    key = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
    whole = docs.withColumn("__k", key).dropDuplicates(["__k"])
    out = rows.join(whole, "__k")
    segments = F.split(F.regexp_replace("text", "^[ \\t-\\r]+", ""), "(?<=[ \\t-\\r])(?=[^ \\t-\\r])")
    text = let(segments, lambda s: F.array_join(F.flatten(F.transform(
        F.col("__pieces"), lambda p: F.slice(s, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))), ""))
    out = out.withColumn("text", F.regexp_replace(text, "[ \\t-\\r]+$", ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.repartition("__shard").sortWithinPartitions("__shard", "__slot").select(*docs.columns)


@query("op5_multinomial_block_mix")
def op5(spark, sf_dir):
    placed, sources = located(table(spark, sf_dir, "documents"))
    taken = mix(placed, sources).groupBy("sid", "start").agg(F.sum("n_words").alias("taken"), F.min(F.struct("shard", "slot")).alias("at"))
    hit = placed.where("size > 0").join(taken, ["sid", "start"], "left")
    return hit.unionByName(placed.where("size = 0"), allowMissingColumns=True) \
        .select("doc_id", "size", "source_size", F.col("target").alias("target"),
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))
