"""Streaming exposure aggregates equal the batch operators on the same rows."""
import tempfile

from pyspark.sql import functions as F

from impressa.operators import analytics as G
from impressa.sources import fixtures as fx
from impressa.streaming import exposures as SX

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="impressa-stream-src-")
    ck = tempfile.mkdtemp(prefix="impressa-stream-ck-")
    ex = fx.exposures(spark, SF).select("news_id", F.col("time").cast("timestamp").alias("time"))
    ex.repartition(3).write.mode("overwrite").parquet(src)
    q = (SX.survival_state(SX.read_exposures(spark, src, max_files_per_trigger=1))
         .writeStream.outputMode("update").format("memory").queryName("surv_test")
         .option("checkpointLocation", ck).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT news_id, max(survival_hours) AS s FROM surv_test GROUP BY news_id")
    want = G.survival_hours(fx.exposures(spark, SF))
    a = sorted((r["news_id"], round(r["s"], 6)) for r in got.collect())
    b = sorted((r["news_id"], round(r["survival_hours"], 6)) for r in want.collect())
    assert a == b
