"""An extension beyond batch evaluation: answers that arrive as files, evaluated as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import captions


def answer_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_accuracy(answers: DataFrame) -> DataFrame:
    """(prompt_type, fact, n, right): a streaming aggregate over the facts of arriving answers, in update or complete mode."""
    return captions.facts_long(answers).groupBy("prompt_type", "fact").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): tumbling windows; rows later than the watermark are dropped, and a window is final after it."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append_metrics(metrics: DataFrame, path: str, checkpoint: str):
    """Per-batch metrics appended as JSON, one batch written once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{path}/batch={number}")

    return metrics.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
