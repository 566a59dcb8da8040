"""Join helpers that keep hot keys and broadcasts under control.

* ``broadcast_if_small`` broadcasts a side only if Catalyst's size estimate of its plan is at most
  ``max_bytes``; no job runs for it.  Otherwise the normal shuffle join is kept, and adaptive
  execution may still broadcast a side whose measured size proves small.
* ``skew_join`` splits hot keys of the big side over ``salts`` buckets and copies the small side's
  rows of those keys into every bucket.  Hot keys are found on a sample, which is materialised
  once, so both sides are salted by the same set; a wrong guess only costs speed, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.session import cut_lineage, stored

# Tuning defaults.
DEFAULT_BROADCAST_BYTES = 16 << 20
DEFAULT_HOT_ROWS = 1_000_000
DEFAULT_SALTS = 32
HOT_SAMPLE_FRACTION = 0.01
WAVE_TASKS = 64  # tasks whose shuffle files are on disk at once where these carry vectors or texts


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's output size (file sizes for scans, an upper bound for
    joins); reading it runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    return estimated_bytes(df) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits(df, max_bytes) else df


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = DEFAULT_HOT_ROWS,
             fraction: float = HOT_SAMPLE_FRACTION, seed: int = 17) -> DataFrame:
    """Keys holding more than ``hot_rows`` rows (estimated on a sample).

    At most rows(df) / hot_rows keys can qualify, which is the broadcast bound used below.
    """
    min_sampled = max(1, int(hot_rows * fraction))
    return (df.select(*keys).sample(fraction=fraction, seed=seed)
            .groupBy(*keys).count().where(F.col("count") >= min_sampled).select(*keys))


SKEW_MODE_CONF = "impressa.skew.mode"  # "aqe" (default) or "salt"
HOT_ROWS_CONF = "impressa.skew.hotRows"  # rows above which a key counts as hot in "salt" mode


def skew_mode(spark) -> str:
    return (spark.conf.get(SKEW_MODE_CONF, "aqe") or "aqe").lower()


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
              condition=None, hot_rows: int | None = None, salts: int = DEFAULT_SALTS,
              mode: str | None = None) -> DataFrame:
    """Equi-join on ``keys`` (plus an optional extra condition) that survives hot keys.

    ``mode='aqe'`` (default, session conf ``impressa.skew.mode``) plans a plain shuffle join and
    lets adaptive execution split oversized partitions of the big side at runtime (no extra
    pass over the data).  ``mode='salt'`` spreads keys found hot on a 1% sample over ``salts``
    buckets and copies the small side's rows of those keys to every bucket — for engines or
    join shapes where runtime splitting is not available.

    ``condition`` is a Column over non-key columns, which must have distinct names on the
    two sides.
    """
    mode = mode or skew_mode(big.sparkSession)
    if mode == "aqe":
        if condition is None:
            return big.join(small, keys, how)
        b, s = big.alias("_b"), small.alias("_s")
        cond = [F.col(f"_b.{k}") == F.col(f"_s.{k}") for k in keys] + [condition]
        cols = [F.col(f"_b.{k}").alias(k) for k in keys]
        cols += [F.col(f"_b.{c}") for c in big.columns if c not in keys]
        cols += [F.col(f"_s.{c}") for c in small.columns if c not in keys]
        return b.join(s, cond, how).select(*cols)
    if hot_rows is None:
        hot_rows = int(big.sparkSession.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
    # materialised, so that both sides see the same set; bounded by rows / hot_rows
    hot = F.broadcast(cut_lineage(hot_keys(big, keys, hot_rows).withColumn("_hot", F.lit(True))))
    b = (big.join(hot, keys, "left")
         .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]),
                                                           F.lit(salts))).otherwise(F.lit(0)))
         .drop("_hot").alias("_b"))
    s = (small.join(hot, keys, "left")
         .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                        .otherwise(F.array(F.lit(0)))))
         .drop("_hot").alias("_s"))
    cond = [F.col(f"_b.{k}") == F.col(f"_s.{k}") for k in keys] + [F.col("_b._salt") == F.col("_s._salt")]
    if condition is not None:
        cond.append(condition)
    out = b.join(s, cond, how)
    cols = [F.col(f"_b.{k}").alias(k) for k in keys]
    cols += [F.col(f"_b.{c}") for c in big.columns if c not in keys]
    cols += [F.col(f"_s.{c}") for c in small.columns if c not in keys]
    return out.select(*cols)


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt over ``tasks`` partitions by ``keys``, if that is more than the session's number of them."""
    few = not tasks or tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if few else df.repartition(tasks, *keys)


def lookup_join(big: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner",
                max_bytes: int = DEFAULT_BROADCAST_BYTES, tasks: int | None = None, back: str | None = None) -> DataFrame:
    """Join a big fact table to a dimension: broadcast the dimension when its estimated size is
    small, otherwise a shuffle join that survives hot keys.

    ``tasks``, where it is more than the session's number of shuffle partitions, is the number that the shuffle join
    deals both sides to; its rows are then dealt again by ``back``, the column that ``big`` was dealt by.  Adaptive
    execution does not split hot keys of such a join: a hot key's rows stream past one dimension row."""
    if fits(dim, max_bytes):
        return big.join(F.broadcast(dim), keys, how)
    if not tasks or tasks <= int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return skew_join(big, dim, keys, how)
    out = skew_join(big.repartition(tasks, *keys), dim.repartition(tasks, *keys), keys, how)
    return out.repartition(tasks, back) if back else out


def waves(tasks: int | None) -> int:
    return -(-tasks // WAVE_TASKS) if tasks else 1


def in_waves(step: Callable[..., DataFrame], key: str, tasks: int | None) -> DataFrame:
    """``step(part, tasks)``, whose result for a key depends on that key's rows only; ``part`` is applied to its inputs.

    Up to ``WAVE_TASKS`` tasks it is one plan.  Above, the keys are dealt by hash over waves of as many tasks, one after
    the other: a wave's result is stored and its shuffle files are released before the next begins, so what is on disk
    at once does not grow with the tables."""
    n = waves(tasks)
    if n == 1:
        return step(lambda df: df, tasks)

    def wave(k):
        return stored(step(lambda df: df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k), -(-tasks // n)))

    return reduce(DataFrame.unionByName, [wave(k) for k in range(n)])
