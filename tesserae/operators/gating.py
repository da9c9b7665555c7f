"""Cases that a change of version switches on: labelled segments of versions, looked up for each pair of versions in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import version_key
from tesserae.operators.relational import SMALL_ROWS


def label_changes(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(current, target, detector, case, was, becomes): cases whose label differs between two versions.

    pairs (current, target); segments (detector, case, begins, label): a case's label is that of the last segment that
    begins at or before the version, a null begin before all others. Segments are written by hand and counted; they go
    to every task as one value, so that the pairs, which are few beside the projects that have them, don't move.
    """
    if len(segments.select(F.lit(1)).limit(SMALL_ROWS + 1).collect()) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} segments")
    keyed = segments.select("detector", "case", F.struct(version_key(F.col("begins")).alias("k"), "label").alias("s"))
    cases = keyed.groupBy("detector", "case").agg(F.array_sort(F.collect_list("s")).alias("s"))
    table = cases.agg(F.collect_list(F.struct("detector", "case", "s")).alias("t"))
    rows = pairs.select("current", "target").distinct().withColumns({"__a": version_key(F.col("current")), "__b": version_key(F.col("target")), "__t": table.scalar()})

    def at(case: Column, key: str) -> Column:
        held = F.filter(case["s"], lambda s: s["k"].isNull() | (s["k"] <= F.col(key)))
        return F.try_element_at(held, F.lit(-1))["label"]

    told = F.transform("__t", lambda c: F.struct(c["detector"].alias("detector"), c["case"].alias("case"), at(c, "__a").alias("was"), at(c, "__b").alias("becomes")))
    found = rows.select("current", "target", F.explode(F.filter(told, lambda c: ~c["was"].eqNullSafe(c["becomes"]))).alias("x"))
    return found.select("current", "target", "x.detector", "x.case", "x.was", "x.becomes")


def gated(projects: DataFrame, segments: DataFrame) -> DataFrame:
    """(project, current, target, detector, case, was, becomes) of projects that a higher version changes something for.

    projects (project, current, target); without a version in use, or with one that isn't lower, nothing changes.
    """
    rising = projects.filter(version_key(F.col("current")) < version_key(F.col("target")))
    told = label_changes(rising, segments).withColumnsRenamed({"current": "__c", "target": "__t"})
    return rising.select("project", "current", "target").join(told, (F.col("current") == F.col("__c")) & (F.col("target") == F.col("__t"))).drop("__c", "__t")
