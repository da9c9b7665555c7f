"""Settings in layers: defaults, a file, the environment and flags; the last layer that sets a key decides."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spelled(key: Column) -> Column:
    """Keys are the same whatever their case and separators: targetFramework, target-framework, TARGET_FRAMEWORK."""
    return F.lower(F.regexp_replace(key, "[-_.]", ""))


def environment(spark: SparkSession, variables: Mapping[str, str], prefix: str) -> DataFrame:
    """(key, value) of the variables with a prefix."""
    rows = [(k[len(prefix) :], v) for k, v in variables.items() if k.startswith(prefix)]
    return spark.createDataFrame(rows, "key string, value string")


def effective(layers: list[tuple[str, DataFrame]], by: tuple = ()) -> DataFrame:
    """(*by, key, value, source): each key's value in the last layer that has one, and that layer's name.

    layers (name, frame of *by, key, value), the weakest first; a null value sets nothing, of one layer's repeats the
    greatest value counts. The key is spelled as in the first layer that has it, by name among equals.
    """
    ranked = [df.select(*by, "key", "value", F.lit(k).alias("rank"), F.lit(name).alias("source")) for k, (name, df) in enumerate(layers)]
    rows = reduce(DataFrame.unionByName, ranked).filter("key IS NOT NULL")
    best = F.max(F.when(F.col("value").isNotNull(), F.struct("rank", "value", "source"))).alias("x")
    out = rows.groupBy(*by, spelled(F.col("key")).alias("k")).agg(best, F.min(F.struct("rank", "key")).alias("name"))
    return out.filter("x IS NOT NULL").select(*by, F.col("name.key").alias("key"), F.col("x.value").alias("value"), F.col("x.source").alias("source"))
