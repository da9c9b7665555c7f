"""Package versions: support, audit status, constraints, consolidation, redirects and file matches.

Versions travel as strings beside a sortable key (functions.scalars.version_key); `max_by` and windows order by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import in_range, version_key, version_range
from tesserae.operators.consolidation import settle
from tesserae.operators.relational import first_per_key


def candidates(feed: DataFrame, in_use: DataFrame, prerelease: bool = False) -> DataFrame:
    """(id, version): versions in use, and listed ones that are stable or may be prereleases."""
    listed = feed.filter("listed") if prerelease else feed.filter("listed").filter(version_key(F.col("version"))["stable"] == 1)
    return in_use.select("id", "version").unionByName(listed.select("id", "version")).distinct()


def supporting(versions: DataFrame) -> DataFrame:
    """(id, newest, lowest): newest and true lowest version with `supports`.

    The lowest is a minimum, not a search by halves, so it is right where support comes and goes between versions.
    """
    key = version_key(F.col("version"))
    good = versions.filter("supports").withColumn("__k", key)
    return good.groupBy("id").agg(F.max_by("version", "__k").alias("newest"), F.min_by("version", "__k").alias("lowest"))


def audit_status(in_use: DataFrame, found: DataFrame, versions: DataFrame, replacements: DataFrame) -> DataFrame:
    """(id, status): unknown, ok, upgrade, replace or blocked.

    in_use (id, version, supports, empty), found (id) in a feed, versions (id, version, supports), replacements (id).
    Unknown support (null) is not ok; a supporting version counts as an upgrade only above all that don't support.
    """
    key = version_key(F.col("version"))
    held = in_use.withColumn("__k", key).groupBy("id").agg(
        F.bool_and(F.coalesce("supports", F.lit(False))).alias("ok"),
        F.max(F.when(~F.col("supports"), F.col("__k"))).alias("bad"),
        F.bool_and(F.coalesce("empty", F.lit(False))).alias("empty"),
    )
    newest = supporting(versions).select(F.col("id").alias("__n"), version_key(F.col("newest")).alias("best"))
    known = found.select(F.col("id").alias("__f")).distinct()
    other = replacements.select(F.col("id").alias("__r")).distinct()
    rows = held.join(newest, F.col("id") == F.col("__n"), "left").join(known, F.col("id") == F.col("__f"), "left").join(other, F.lower("id") == F.lower("__r"), "left")
    status = (
        F.when(F.col("__f").isNull(), "unknown")
        .when(F.col("empty") & F.col("__r").isNotNull(), "replace")
        .when(F.col("ok"), "ok")
        .when(F.col("best").isNotNull() & (F.col("bad").isNull() | (F.col("best") > F.col("bad"))), "upgrade")
        .when(F.col("__r").isNotNull(), "replace")
        .otherwise("blocked")
    )
    return rows.select("id", status.alias("status"))


def choose(options: DataFrame, constraints: DataFrame, lowest: bool = True) -> DataFrame:
    """(id, version): the lowest or newest option within all of its id's ranges. constraints (id, range)."""
    bounds = constraints.select(F.col("id").alias("__c"), version_range(F.col("range")).alias("__b")).distinct()
    keyed = options.select("id", "version").distinct().withColumn("__k", version_key(F.col("version")))
    held = keyed.join(bounds, F.col("id") == F.col("__c"), "left").groupBy("id", "version", "__k").agg(F.bool_and(F.col("__b").isNull() | in_range(F.col("__k"), F.col("__b"))).alias("ok"))
    pick = F.min_by if lowest else F.max_by
    return held.filter("ok").groupBy("id").agg(pick("version", "__k").alias("version"))


def deciding(constraints: DataFrame, chosen: DataFrame) -> DataFrame:
    """The constraint that decided: the highest lower bound not above the choice, then kind, then project."""
    rows = constraints.join(chosen.select(F.col("id").alias("__i"), version_key(F.col("version")).alias("__v")), F.col("id") == F.col("__i"))
    rows = rows.withColumn("__low", version_key(version_range(F.col("range"))["low"])).filter("__low <= __v")
    return first_per_key(rows, ["id"], [F.desc("__low"), F.col("kind"), F.col("project")]).drop("__i", "__v", "__low")


def align_families(chosen: DataFrame, families: DataFrame, available: DataFrame, constraints: DataFrame | None = None) -> DataFrame:
    """Members of a family take its highest member version; those that lack it, or whose own ranges (id, range) forbid it, keep theirs.

    Packages without a family are not brought together.
    """
    known = families.select(F.col("id").alias("__f"), "family").filter("family IS NOT NULL").distinct()
    rows = chosen.join(known, F.col("id") == F.col("__f"), "left").drop("__f")
    alone = rows.filter("family IS NULL").select("id", "version")
    rows = rows.filter("family IS NOT NULL")
    key = version_key(F.col("version"))
    top = rows.groupBy(F.col("family").alias("__g")).agg(F.max(F.struct(key.alias("k"), F.col("version").alias("v")))["v"].alias("__top"))
    rows = rows.join(top, F.col("family") == F.col("__g"))
    has = available.select(F.col("id").alias("__i"), F.col("version").alias("__v")).distinct()
    rows = rows.join(has, (F.col("id") == F.col("__i")) & (F.col("__top") == F.col("__v")), "left")
    takes = F.col("__v").isNotNull()
    if constraints is not None:
        asked = constraints.select(F.col("id").alias("__c"), version_range(F.col("range")).alias("__b")).distinct()
        barred = rows.join(asked, F.col("id") == F.col("__c")).filter(~in_range(version_key(F.col("__top")), F.col("__b"))).select(F.col("__c").alias("__bar")).distinct()
        rows, takes = rows.join(barred, F.col("id") == F.col("__bar"), "left"), takes & F.col("__bar").isNull()
    return rows.select("id", F.when(takes, F.col("__top")).otherwise(F.col("version")).alias("version")).unionByName(alone)


def supports_all(options: DataFrame, usage: DataFrame, support: DataFrame) -> DataFrame:
    """Options (id, version) that support every framework their id is used for: usage (id, tfm), support (id, version, tfm)."""
    asked = usage.select(F.col("id").alias("__i"), F.col("tfm").alias("__t")).distinct()
    wanted = asked.groupBy("__i").agg(F.count("__t").alias("__n"))
    held = support.select("id", "version", "tfm").distinct().join(asked, (F.col("id") == F.col("__i")) & (F.col("tfm") == F.col("__t")))
    held = held.groupBy(F.col("id").alias("__h"), F.col("version").alias("__v")).agg(F.count("tfm").alias("__m"))
    rows = options.join(wanted, F.col("id") == F.col("__i"), "left").join(held, (F.col("id") == F.col("__h")) & (F.col("version") == F.col("__v")), "left")
    return rows.filter("__n IS NULL OR coalesce(__m, 0) = __n").select(*options.columns)


def unsatisfied(constraints: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, ranges): packages without a version within all their constraints, and what these ask, sorted."""
    has = chosen.filter("version IS NOT NULL").select(F.col("id").alias("__i"))
    rows = constraints.join(has, F.col("id") == F.col("__i"), "left_anti")
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("range")).alias("ranges"))


def pins_below(chosen: DataFrame, pins: DataFrame) -> DataFrame:
    """(id, project, pin, version): pins under the version chosen for the others."""
    rows = pins.join(chosen.select(F.col("id").alias("__i"), F.col("version").alias("__v")), F.lower("id") == F.lower("__i"))
    return rows.filter(version_key(F.col("version")) < version_key(F.col("__v"))).select("id", "project", F.col("version").alias("pin"), F.col("__v").alias("version"))


def consolidate(direct: DataFrame, options: DataFrame, dependencies: DataFrame, families: DataFrame | None = None, pins: DataFrame | None = None, lowest: bool = True) -> tuple[DataFrame, int]:
    """One version for each package, and the rounds it took: `consolidation.settle` for constraints without a chain.

    direct (id, project, kind, range), options (id, version), dependencies (id, version, dep_id, range), pins (id, project,
    version): a project's pin takes its constraints away, one without a project asks for its version beside the others.
    """
    base = direct.select("id", "project", "kind", "range", F.array(F.concat_ws(" ", "project", "range")).alias("chain"))
    settled = settle(base, options, dependencies, families, pins, lowest, options)
    return settled.chosen.select("id", "version"), settled.rounds


def redirects(referenced: DataFrame, deployed: DataFrame, existing: DataFrame, prune: bool = False) -> DataFrame:
    """(name, action, old, version, was): what to do about each binding redirect; names ignore case.

    referenced (name, version), deployed (name, version, signed), existing (name, old, version, place): `old` is the
    range it redirects, and of several entries for a name the one with the least place counts. Several deployed versions
    count as their highest.

    lower: what is deployed is under the highest reference, so none is written. Otherwise one is needed where a
    reference to a signed assembly differs: added; changed if its range or version is another; else unchanged. One that
    is not needed stays if it names what is deployed (unchanged), else follows it (changed); if nothing deploys it, it
    is stale, or pruned.
    """
    held = deployed.withColumn("__k", version_key(F.col("version"))).groupBy(F.lower("name").alias("d"))
    held = held.agg(F.max_by("version", "__k").alias("to"), F.max("__k").alias("k"), F.bool_or("signed").alias("signed"))
    asked = referenced.withColumn("__k", version_key(F.col("version"))).groupBy(F.lower("name").alias("r")).agg(F.max("__k").alias("top"), F.min("__k").alias("least"))
    present = existing.groupBy(F.lower("name").alias("o")).agg(F.min_by(F.struct("old", "version"), "place").alias("e"))
    rows = held.join(asked, F.col("d") == F.col("r"), "left").join(present, F.col("d") == F.col("o"), "full_outer")
    signed = F.coalesce("signed", F.lit(False))
    lower = F.coalesce(signed & (F.col("top") > F.col("k")), F.lit(False))
    needed = F.coalesce(signed & ~lower & ((F.col("least") != F.col("k")) | (F.col("top") != F.col("k"))), F.lit(False))
    wanted, has = F.concat(F.lit("0.0.0.0-"), F.col("to")), F.col("e").isNotNull()
    action = (
        F.when(needed & ~has, "added")
        .when(needed & ((F.col("e.old") != wanted) | (F.col("e.version") != F.col("to"))), "changed")
        .when(needed, "unchanged")
        .when(has & F.col("to").isNull(), "pruned" if prune else "stale")
        .when(has & (F.col("e.version") != F.col("to")), "changed")
        .when(has, "unchanged")
    )
    rows = rows.select(F.coalesce("d", "o").alias("name"), F.explode(F.array(F.when(lower, "lower"), action)).alias("action"), "to", wanted.alias("wanted"), "e").filter("action IS NOT NULL")
    writes = F.col("action").isin("added", "changed")
    return rows.select(
        "name", "action", F.when(writes, F.col("wanted")).when(F.col("action") != "lower", F.col("e.old")).alias("old"),
        F.when(writes | (F.col("action") == "lower"), F.col("to")).otherwise(F.col("e.version")).alias("version"), F.when(F.col("action") == "changed", F.col("e.version")).alias("was"),
    )


# Kinds of file match, the best first.
MATCH_ORDER = ["path", "identical", "file version", "informational version", "assembly version", "newer"]


def best_match(matches: DataFrame) -> DataFrame:
    """One package version for each file: by kind of match, listed before unlisted, then the lower version.

    matches (file, package, version, match, listed). An unlisted version is never offered as a newer one.
    """
    rank = F.array_position(F.array(*map(F.lit, MATCH_ORDER)), F.col("match"))
    rows = matches.filter("listed OR match != 'newer'").filter(rank > 0)
    return first_per_key(rows, ["file"], [rank, F.desc("listed"), version_key(F.col("version")), F.col("package")])


def newest_in_range(versions: DataFrame, text: str, required: int) -> DataFrame:
    """(id, version): the newest release in a range that supports as many frameworks as asked. versions (id, version, framework)."""
    key = version_key(F.col("version"))
    rows = versions.withColumn("__k", key).filter((F.col("__k")["stable"] == 1) & in_range(F.col("__k"), version_range(F.lit(text))))
    full = rows.groupBy("id", "version", "__k").agg(F.countDistinct("framework").alias("n")).filter(F.col("n") >= required)
    return full.groupBy("id").agg(F.max_by("version", "__k").alias("version"))
