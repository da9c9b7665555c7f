"""The ledger as a stream: snapshots that arrive as files are appended once each, however often a batch is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.model import LEDGER
from tesserae.sources.sinks import append_ledger


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LEDGER).option("multiLine", True).json(folder).withColumnRenamed("createdAt", "created_at")


def follow(stream: DataFrame, ledger: str, checkpoint: str, once: bool = False):
    """Append to the ledger; partitions are named by content, so a batch that runs again replaces its own output."""

    def write(batch: DataFrame, _: int) -> None:
        append_ledger(batch.select(F.col("created_at"), "solution", "totals", "projects"), ledger)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
