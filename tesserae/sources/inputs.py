"""Inputs by increments: a stored state of hashes, so that only files that changed are read again.

A state is a table (path, length, modified, sha256). A file whose length and time of change are those of the state keeps its
hash; the others are read. States are kept by run, and a run that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.relational import difference
from tesserae.sources.model import SKIPPED, kept_paths

STATE = "path string, length long, modified timestamp, sha256 string"


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)


def listing(spark: SparkSession, folder: str, glob: str = "*", skip: tuple = SKIPPED) -> DataFrame:
    """(path, length, modified) of the files below a folder; no file is opened."""
    return kept_paths(files(spark, folder, glob), folder, skip, ["length", F.col("modificationTime").alias("modified")])


def reusable(listed: DataFrame, state: DataFrame) -> DataFrame:
    """(path, length, modified, sha256): a file has the state's hash if its length and time are the state's, else none."""
    known = state.select(F.col("path").alias("__p"), F.col("length").alias("__l"), F.col("modified").alias("__m"), F.col("sha256").alias("__h"))
    same = (F.col("path") == F.col("__p")) & F.col("length").eqNullSafe(F.col("__l")) & F.col("modified").eqNullSafe(F.col("__m"))
    return listed.join(known, same, "left").select("path", "length", "modified", F.col("__h").alias("sha256"))


def refreshed(spark: SparkSession, folder: str, state: DataFrame, glob: str = "*", skip: tuple = SKIPPED) -> DataFrame:
    """(path, length, modified, sha256, was_read): the state of now, made by reading what the given state doesn't know.

    Files older than the oldest such file are pruned by the scan itself, before they are opened.
    """
    rows = reusable(listing(spark, folder, glob, skip), state)
    fresh = rows.filter("sha256 IS NULL")
    oldest = fresh.agg(F.min("modified").alias("m")).first()["m"]
    kept = rows.filter("sha256 IS NOT NULL").withColumn("was_read", F.lit(False))
    if oldest is None:
        return kept
    newer = files(spark, folder, glob).filter(F.col("modificationTime") >= F.lit(oldest))
    hashed = kept_paths(newer, folder, skip, ["content"]).withColumnRenamed("path", "__p")
    read = fresh.drop("sha256").join(hashed, F.col("path") == F.col("__p")).select("path", "length", "modified", F.sha2("content", 256).alias("sha256"), F.lit(True).alias("was_read"))
    return kept.unionByName(read)


def staleness(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files changed, added and removed between two states, by their hashes."""
    return difference(before, now, "path", "sha256")


def save_state(state: DataFrame, folder: str, run: int) -> None:
    rows = state.select("path", "length", "modified", "sha256").withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)


def last_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of the last run; the folder must have one."""
    states = spark.read.schema(STATE + ", run int").parquet(folder)
    last = states.agg(F.max("run").alias("r")).first()["r"]
    return states.filter(F.col("run") == F.lit(last)).drop("run")
