"""Mini-batches of a model view (J3): a keyed permutation per epoch, exact batch ids, collated arrays.

The order of an epoch is the order of md5(seed, epoch, key), so it depends on nothing but the keys.
Ranks come without a global sort: hashes are uniform, so their leading bits deal the rows into
buckets of bounded size, bucket counts give each bucket's first rank, and rows are numbered inside
their bucket.  Batches of one epoch are full, only the last one may be short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impressa.functions.scalar import hash_int32
from impressa.session import stored

HASH_BITS = 32
BUCKET_ROWS = 50_000  # rows numbered in one group


def epoch_batches(keys: DataFrame, key: str, epochs: int, batch_size: int, seed: int = 1234, shuffle: bool = True,
                  drop_last: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(epoch, batch, slot, key): every key once per epoch, ``batch_size`` keys a batch.

    ``shuffle=False`` numbers the keys in key order in every epoch, as an evaluation loader does;
    ``drop_last`` leaves a short last batch out (as the feature asks).  ``key`` is unique."""
    if epochs < 1 or batch_size < 1:
        raise ValueError("epochs and batch_size must be at least 1")
    if not shuffle:
        from impressa.operators.vocab import dense_index
        ranked = dense_index(keys.select(key), [key], "_rank", start=0) \
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        total = F.max("_rank") + 1
        n = ranked.agg(F.coalesce(total, F.lit(0))).first()[0]
    else:
        drawn = stored(keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
                       .withColumn("_h", hash_int32(F.lit(str(seed)), "epoch", key)))
        n = drawn.count() // epochs
        bits = min(HASH_BITS, max(0, (-(-n // bucket_rows) - 1).bit_length()))
        dealt = drawn.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
        before = Window.partitionBy("epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        first = dealt.groupBy("epoch", "_b").agg(F.count(F.lit(1)).alias("_n")) \
            .select("epoch", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # one row per bucket
        inside = F.row_number().over(Window.partitionBy("epoch", "_b").orderBy("_h", key)) - 1
        ranked = dealt.withColumn("_rank", inside).join(first, ["epoch", "_b"]) \
            .withColumn("_rank", F.col("_rank") + F.col("_first"))
    out = ranked.select("epoch", F.floor(F.col("_rank") / batch_size).cast("long").alias("batch"),
                        F.pmod("_rank", F.lit(batch_size)).cast("long").alias("slot"), key)
    return out.where(F.col("batch") < n // batch_size) if drop_last else out


def _padded(dt: T.DataType, rows: Column) -> Column:
    """A batch's arrays filled up behind to the longest of them with a zero of the element type."""
    zero = F.lit("") if isinstance(dt.elementType, T.StringType) else F.lit(0).cast(dt.elementType)
    width = F.array_max(F.transform(rows, lambda x: F.size(x)))
    return F.transform(rows, lambda x: F.concat(x, F.array_repeat(zero, width - F.size(x))))


def collate(batches: DataFrame, view: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per batch: ``size``, the keys in slot order and every column of ``cols`` as an array over
    the slots; array columns are padded to the longest of their batch, and ``<col>_len`` gives the true
    lengths.  Keys without a row in ``view`` fail the join and are left out.  A group is one batch."""
    types = {f.name: f.dataType for f in view.schema.fields}
    ragged = [c for c in cols if isinstance(types[c], T.ArrayType) and not isinstance(types[c].elementType, T.ArrayType)]
    j = batches.join(view.select(key, *cols), key)
    g = j.groupBy("epoch", "batch").agg(F.array_sort(F.collect_list(F.struct("slot", key, *cols))).alias("_x"))

    def field(c):
        return F.transform("_x", lambda x: x[c])

    def lengths(c):
        return F.transform("_x", lambda x: F.size(x[c]))

    return g.select("epoch", "batch", F.size("_x").cast("long").alias("size"), field(key).alias(key),
                    *[(_padded(types[c], field(c)) if c in ragged else field(c)).alias(c) for c in cols],
                    *[lengths(c).alias(f"{c}_len") for c in ragged])
