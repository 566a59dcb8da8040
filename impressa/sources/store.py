"""Stored tables: word vectors, prepared news/behaviour tables, embedding matrices, dumps
(S5, S6, S8-S11).  Parquet is the default format; TSV variants match the log tooling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from impressa.session import ensure_checkpoint_dir
from impressa.sources.tsv import read_tsv, write_tsv


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never a machine-local one)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/io-{name}-{uuid.uuid4().hex[:12]}"


def read_text_vectors(spark: SparkSession, path: str, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``token v1 ... vd`` text lines -> (token, vec array<float>); lines whose width differs
    from ``dims`` (when given), or that hold anything but numbers after the token, are returned as
    rejects instead of failing the job."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("p"))
    rows = parts.select(F.col("p").getItem(0).alias("token"),
                        F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.try_cast("float")).alias("vec"))
    # without a width, a line must at least hold a token and numbers only
    ok = (F.size("vec") == dims) if dims is not None else (F.size("vec") > 0)
    ok = ok & (F.col("token") != "") & ~F.exists("vec", lambda x: x.isNull())
    return rows.where(ok), rows.where(~ok)


def write_text_vectors(vectors: DataFrame, path: str) -> None:
    """The text format of S5 (for round trips and exports)."""
    line = F.concat_ws(" ", F.col("token"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)


def cache_vectors(vectors: DataFrame, path: str) -> None:
    """S5 binary cache: Parquet instead of the reference's array file + token list."""
    vectors.write.mode("overwrite").parquet(path)


def load_cached_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """Cached vectors; a row of the wrong width is an error (like the reference's assert)."""
    v = spark.read.parquet(path)
    if v.where(F.size("vec") != dims).limit(1).count():
        raise ValueError(f"malformed vector rows (width != {dims}) in {path}")
    return v


def write_parsed_news(parsed: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Prepared news; the TSV variant joins id arrays with spaces."""
    if fmt == "tsv":
        cols = [F.array_join(F.col(f.name), " ").alias(f.name) if isinstance(f.dataType, T.ArrayType)
                else F.col(f.name).cast("string") for f in parsed.schema.fields]
        write_tsv(parsed.select(*cols), path)
    else:
        parsed.write.mode("overwrite").parquet(path)


def read_parsed_news(spark: SparkSession, path: str, fmt: str = "parquet",
                     columns=("news_id", "category", "subcategory", "title", "abstract")) -> DataFrame:
    """S8 read-back; TSV id lists are split and cast to int."""
    if fmt != "tsv":
        return spark.read.parquet(path)
    raw = read_tsv(spark, path, list(columns))
    out = raw
    for c in ("title", "abstract"):
        if c in columns:
            out = out.withColumn(c, F.transform(F.split(c, " "), lambda x: x.cast("int")))
    for c in ("category", "subcategory"):
        if c in columns:
            out = out.withColumn(c, F.col(c).cast("int"))
    for c in columns[5:]:  # sentiment columns
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


def write_behaviors(tables: dict[str, DataFrame], path: str) -> None:
    """Behaviour tables of all splits in one dataset partitioned by ``split`` (readers that
    filter on it only open the matching folders)."""
    parts = None
    for split, df in tables.items():
        t = df.withColumn("split", F.lit(split))
        parts = t if parts is None else parts.unionByName(t, allowMissingColumns=True)
    parts.write.mode("overwrite").partitionBy("split").parquet(path)


def read_behaviors_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_embedding_matrix(matrix: DataFrame, path: str, decimals: int = 6) -> None:
    """(idx, vec) rounded to ``decimals`` places, zero row included by the caller (V9)."""
    matrix.select("idx", F.transform("vec", lambda x: F.round(x.cast("double"), decimals)).alias("vec")) \
        .write.mode("overwrite").parquet(path)


def load_embedding_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dump_first(scored: DataFrame, path: str, n: int = 102) -> None:
    """The first ``n`` scored impressions (the limit is the feature) as CSV rows of
    (imp_id, scores, labels) in position order."""
    first = scored.select("imp_id").distinct().orderBy("imp_id").limit(n)
    g = scored.join(first, "imp_id").groupBy("imp_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "score", "label"))).alias("_s"))
    out = g.select("imp_id",
                   F.array_join(F.transform("_s", lambda s: F.format_number(s["score"], 6)), " ").alias("scores"),
                   F.array_join(F.transform("_s", lambda s: s["label"].cast("string")), " ").alias("labels"))
    out.write.mode("overwrite").option("header", "true").csv(path)
