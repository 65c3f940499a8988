"""The usage log as a stream: windowed counts with a watermark for late entries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.operators.usage import clean_outcome
from ctxspark.session import shared_folder


def log_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files of usage entries, read as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_usage(entries: DataFrame, window: str = "1 day", late: str = "60 days") -> DataFrame:
    """``day, runs, hits, misses`` per window of ``logged_at``. Entries later than ``late`` are dropped, repeats within it once."""
    outcome = clean_outcome(F.col("outcome"))
    once = entries.withColumn("logged_at", F.col("logged_at").cast("timestamp")).withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["entry_id"])
    return once.groupBy(F.window("logged_at", window).alias("w")).agg(
        F.count_if(F.col("entry_type") == "run").alias("runs"),
        F.count_if((F.col("entry_type") == "feedback") & (outcome == "hit")).alias("hits"),
        F.count_if((F.col("entry_type") == "feedback") & (outcome == "miss")).alias("misses")).select(
        F.col("w.start").alias("day"), "runs", "hits", "misses")


def drained(stream: DataFrame) -> DataFrame:
    """Run a streaming aggregate over all that is there, into a table in the shared folder, and read that.

    Each micro batch's groups overwrite earlier states of the same group by taking the last batch.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/n={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c != "day"]
    parts = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).option("basePath", f"{base}/out").parquet(f"{base}/out/*")
    return parts.groupBy("day").agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select("day", "r.*")
