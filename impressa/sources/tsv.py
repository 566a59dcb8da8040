"""Header-less, positional TSV sources and sinks of the log format.

Schemas are explicit (never inferred) and quoting is off, matching a raw split on tabs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The positional column names of the two log files.
BEHAVIOR_COLUMNS = ["imp_id", "user_id", "time", "history", "impressions"]
NEWS_COLUMNS = ["news_id", "category", "subcategory", "title", "abstract", "url",
                "title_entities", "abstract_entities"]
SPLITS = ("train", "test", "dev")


def _schema(cols, types=None) -> T.StructType:
    types = types or {}
    return T.StructType([T.StructField(c, types.get(c, T.StringType()), True) for c in cols])


def read_tsv(spark: SparkSession, path, cols, types=None) -> DataFrame:
    return (spark.read.schema(_schema(cols, types))
            .option("sep", "\t").option("header", "false").option("quote", "")
            .option("escape", "").option("mode", "PERMISSIVE").csv(path))


def read_behaviors(spark: SparkSession, path) -> DataFrame:
    """Behaviors file; missing text fields become ``""``."""
    df = read_tsv(spark, path, BEHAVIOR_COLUMNS, {"imp_id": T.LongType()})
    return df.na.fill("", ["user_id", "time", "history", "impressions"])


def read_news(spark: SparkSession, path) -> DataFrame:
    """News catalogue; missing fields become ``""``."""
    return read_tsv(spark, path, NEWS_COLUMNS).na.fill("")


def load_splits(spark: SparkSession, base: str, kind: str = "behaviors", splits=("train", "test")) -> DataFrame:
    """S3: the named splits of a dataset folder (``{base}/{split}/{kind}.tsv``) with a ``split``
    column; filtering on it later only reads the matching files' rows."""
    unknown = set(splits) - set(SPLITS)
    if unknown:
        raise ValueError(f"unknown split(s): {sorted(unknown)}")
    reader = read_behaviors if kind == "behaviors" else read_news
    parts = [reader(spark, f"{base}/{s}/{kind}.tsv").withColumn("split", F.lit(s)) for s in splits]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_lines_strict(spark: SparkSession, path, cols, strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw lines with strict arity -> (good rows, rejected lines).

    ``strip=True`` trims surrounding whitespace first like the reference, so a line whose trailing
    fields are empty has too few fields and is rejected (Q14) instead of failing the job.
    """
    line = F.col("value")
    if strip:
        line = F.regexp_replace(line, r"^\s+|\s+$", "")
    raw = spark.read.text(path).select(line.alias("line"), F.split(line, "\t", -1).alias("f"))
    ok = F.size("f") == len(cols)
    good = raw.where(ok).select(*[F.col("f").getItem(i).alias(c) for i, c in enumerate(cols)])
    bad = raw.where(~ok).select("line", F.size("f").alias("n_fields"))
    return good, bad


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S12 (and the TSV form of S7): header-less tab-separated text, no quoting."""
    (df.write.mode(mode).option("sep", "\t").option("header", "false").option("quote", "")
     .option("escape", "").option("emptyValue", "").option("nullValue", "").csv(path))


def write_dictionary(d: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Key -> idx dictionary; Parquet by default, TSV on request."""
    d = d.select("key", "idx")
    if fmt == "tsv":
        write_tsv(d, path)
    else:
        d.write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Dictionary back as (key, idx)."""
    if fmt == "tsv":
        return read_tsv(spark, path, ["key", "idx"], {"idx": T.LongType()})
    return spark.read.parquet(path)
