"""The exposure analytics (G9 hourly counts, G10 first/last exposure) on a Structured Streaming
source.  The reference has no streaming; these are the same aggregates kept incrementally for
logs that arrive as files, with a watermark bounding the state of the hourly windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPOSURE_SCHEMA = T.StructType([T.StructField("news_id", T.LongType()), T.StructField("time", T.TimestampType())])


def read_exposures(spark: SparkSession, path: str, schema: T.StructType = EXPOSURE_SCHEMA,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def hourly_counts(stream: DataFrame, watermark: str, time: str = "time") -> DataFrame:
    """G9 incrementally: exposures per clock hour.  The caller says how late a row may be; later
    ones are dropped by Spark's state cleanup (append mode emits each hour once it is final)."""
    return (stream.withWatermark(time, watermark)
            .groupBy(F.window(time, "1 hour").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("hour"), "n"))


def survival_state(stream: DataFrame, item: str = "news_id", time: str = "time") -> DataFrame:
    """G10 incrementally: first and last exposure and survival hours per item (update mode;
    the state is one row per item)."""
    g = stream.groupBy(item).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    micros = F.unix_micros(F.col("last")) - F.unix_micros(F.col("first"))
    return g.select(item, "first", "last", (micros / F.lit(3.6e9)).alias("survival_hours"))
