"""Session helper for local runs, tests and the benchmark; clusters bring their own session."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tesserae")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A table of the data folder, read by Spark alone so that any store it knows will do."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started."""
    here, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), here]))


def checkpoint_ready(spark: SparkSession) -> None:
    """Give the session a checkpoint folder: the one the cluster names; where none is named, a local one, on one machine only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="tesserae-checkpoint-")
        sc.setCheckpointDir(named)
