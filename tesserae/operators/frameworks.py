"""Target frameworks: names as parsed values, which serves which, and which is nearest, as Spark expressions.

A framework is struct(family, version (four numbers as one), platform, platform_version). Names are short (net48,
netstandard2.0, net8.0-windows10.0.19041) or long (.NETFramework,Version=v4.8). Compatibility is a partial order that
follows from the parsed names: within a family, higher versions take what lower ones offer; a platform takes what no
platform offers; and each version of .NET Framework and .NET (Core) implements .NET Standard up to some version. Unknown
names serve only themselves. Names ignore case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.relational import few, first_per_key

FRAMEWORK, STANDARD, MODERN, PORTABLE, ANY, UNKNOWN = "framework", "standard", "modern", "portable", "any", "unknown"

# The first version of each family that implements a version of .NET Standard.
FRAMEWORK_STANDARD = [("4.5", "1.1"), ("4.5.1", "1.2"), ("4.6", "1.3"), ("4.6.1", "2.0")]
MODERN_STANDARD = [("1.0", "1.6"), ("2.0", "2.0"), ("3.0", "2.1")]
# Long names of families.
LONG_NAMES = {".netframework": FRAMEWORK, ".netstandard": STANDARD, ".netcoreapp": MODERN}


def packed(text: Column) -> Column:
    """Up to four numbers with dots as one number that orders like them; each stays below 32,768."""
    parts = F.split(text, r"\.")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("long"), F.lit(0).cast("long"))
    return sum((number(i + 1) * F.lit(1 << 15 * (3 - i)).cast("long") for i in range(4)), F.lit(0).cast("long"))


def literal(version: str) -> Column:
    numbers = [int(x) for x in version.split(".")] + [0] * 4
    return F.lit(sum(n << 15 * (3 - i) for i, n in enumerate(numbers[:4]))).cast("long")


def framework(name: Column) -> Column:
    """The parsed framework of a name; a null name has none."""
    text = F.lower(F.trim(name))
    long_family, long_version = F.regexp_extract(text, r"^(\.net[a-z]+),\s*version=v?([0-9.]+)", 1), F.regexp_extract(text, r"^(\.net[a-z]+),\s*version=v?([0-9.]+)", 2)
    pattern = r"^(netstandard|netcoreapp|net)(\d[0-9.]*)?(?:-([a-z]+)([0-9.]*))?$"
    head, digits, platform, platform_version = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3, 4))
    dotted = F.when(digits.contains(".") | (digits == ""), digits).otherwise(F.array_join(F.split(digits, ""), "."))
    # without a dot every digit is a number of its own: net472 is 4.7.2, net50 is 5.0
    version = packed(F.when(long_version != "", long_version).otherwise(F.regexp_replace(dotted, r"^\.+|\.+$", "")))
    family = (
        F.when(text.isin("any", "dotnet"), ANY).when(text.startswith("portable-"), PORTABLE)
        .when(long_family != "", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LONG_NAMES.items() for x in kv]), long_family), F.lit(UNKNOWN)))
        .when(head == "netstandard", STANDARD).when(head == "netcoreapp", MODERN)
        .when((head == "net") & (version >= literal("5.0")), MODERN).when(head == "net", FRAMEWORK).otherwise(UNKNOWN)
    )
    return F.when(
        name.isNotNull(),
        F.struct(
            family.alias("family"), F.when(family.isin(FRAMEWORK, STANDARD, MODERN), version).otherwise(F.lit(0).cast("long")).alias("version"),
            F.when(family == MODERN, platform).otherwise("").alias("platform"), F.when(family == MODERN, packed(platform_version)).otherwise(F.lit(0).cast("long")).alias("platform_version"), text.alias("text"),
        ),
    )


def standard_of(target: Column) -> Column:
    """The highest version of .NET Standard that a framework implements; null for none."""
    out = F.when(target["family"] == STANDARD, target["version"])
    for family, table in ((FRAMEWORK, FRAMEWORK_STANDARD), (MODERN, MODERN_STANDARD)):
        for least, standard in reversed(table):
            out = out.when((target["family"] == family) & (target["version"] >= literal(least)), literal(standard))
    return out


def serves(target: Column, offered: Column) -> Column:
    """Whether a target can use what is offered for a framework, both parsed."""
    same = (target["family"] == offered["family"]) & (target["version"] >= offered["version"])
    platform = (offered["platform"] == "") | ((offered["platform"] == target["platform"]) & (offered["platform_version"] <= target["platform_version"]))
    standard = (offered["family"] == STANDARD) & F.coalesce(standard_of(target) >= offered["version"], F.lit(False))
    # a portable name lists what it is for; .NET Framework takes it if one of these serves it
    parts = F.split(F.regexp_replace(offered["text"], "^portable-", ""), r"\+")
    portable = (offered["family"] == PORTABLE) & (target["family"] == FRAMEWORK) & F.exists(parts, lambda p: p.rlike(r"^net\d") & (short_version(p) <= target["version"]) & (short_version(p) < literal("5.0")))
    return (offered["family"] == ANY) | (offered["text"] == target["text"]) | (same & platform & target["family"].isin(FRAMEWORK, STANDARD, MODERN)) | standard | portable


def short_version(name: Column) -> Column:
    """The version of a short .NET Framework name."""
    return packed(F.array_join(F.split(F.regexp_extract(name, r"^net(\d+)", 1), ""), "."))


def nearness(target: Column, offered: Column) -> Column:
    """An order of what serves a target, the nearest first: itself, its family from the newest, its platform before none, the standard from the newest, portable, any."""
    kind = F.when(offered["family"] == target["family"], 0).when(offered["family"] == STANDARD, 1).when(offered["family"] == PORTABLE, 2).otherwise(3)
    return F.struct(kind.alias("kind"), (-offered["version"]).alias("version"), F.when(offered["platform"] == "", 1).otherwise(0).alias("plain"), (-offered["platform_version"]).alias("platform_version"), offered["text"].alias("text"))


def precedence(targets: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(target, framework, rank): for each target the frameworks that serve it, the nearest with rank 1.

    One-column frames of names; targets are few and counted, and each framework is tried on all, which is the answer's
    size. Names that differ in case alone or mean the same are kept apart and rank by their text.
    """
    names = frameworks.select(F.col(frameworks.columns[0]).alias("framework")).filter("framework IS NOT NULL").distinct()
    asked = targets.select(F.col(targets.columns[0]).alias("target")).filter("target IS NOT NULL")
    rows = names.withColumn("offered", framework(F.col("framework"))).withColumn("target", F.explode(few(asked, "target"))).withColumn("wanted", framework(F.col("target")))
    rows = rows.filter(serves(F.col("wanted"), F.col("offered"))).groupBy("target").agg(F.array_sort(F.collect_list(F.struct(nearness(F.col("wanted"), F.col("offered")).alias("k"), "framework"))).alias("x"))
    return rows.select("target", F.posexplode("x").alias("at", "x")).select("target", F.col("x.framework").alias("framework"), (F.col("at") + 1).alias("rank"))


def target_support(targets: DataFrame, assets: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """(package, version, target, supports): whether a version has something that a target can use.

    assets (package, version, framework) decide, or, where a version has none, the frameworks of its dependency groups
    (the same columns); a version with neither serves all. A row with a null framework only says that a version exists.
    """
    held = assets.select("package", "version", "framework", F.lit(0).alias("kind"))
    if dependencies is not None:
        held = held.unionByName(dependencies.select("package", "version", "framework", F.lit(1).alias("kind")))
    names = precedence(targets.select("target"), held.select("framework")).groupBy(F.col("framework").alias("f")).agg(F.collect_set("target").alias("fits"))
    named = held.join(names, F.col("framework") == F.col("f"), "left")
    each = named.groupBy("package", "version").agg(
        F.max(F.when(F.col("framework").isNotNull() & (F.col("kind") == 0), True)).alias("own"), F.max(F.when(F.col("framework").isNotNull() & (F.col("kind") == 1), True)).alias("other"),
        F.flatten(F.collect_set(F.when(F.col("kind") == 0, F.col("fits")))).alias("by_assets"), F.flatten(F.collect_set(F.when(F.col("kind") == 1, F.col("fits")))).alias("by_dependencies"),
    )
    rows = each.withColumn("target", F.explode(few(targets, "target")))
    supports = F.when(F.col("own"), F.array_contains("by_assets", F.col("target"))).when(F.col("other"), F.array_contains("by_dependencies", F.col("target"))).otherwise(True)
    return rows.select("package", "version", "target", supports.alias("supports"))


def nearest_dependencies(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """(package, version, target, framework): of a version's dependency groups the one nearest to a target; none if none serves it.

    wanted (package, version, target), groups (package, version, framework).
    """
    order = precedence(wanted.select("target"), groups.select("framework")).select(F.col("target").alias("t"), F.col("framework").alias("f"), "rank")
    rows = wanted.join(groups, ["package", "version"]).join(order, (F.col("target") == F.col("t")) & (F.col("framework") == F.col("f")))
    return first_per_key(rows, ["package", "version", "target"], [F.col("rank")]).select("package", "version", "target", "framework")


def sort_key(name: Column) -> Column:
    """Frameworks in the order of reports: .NET Framework, .NET Standard, .NET, then others; each by version and text."""
    f = framework(name)
    rank = F.when(f["family"] == FRAMEWORK, 0).when(f["family"] == STANDARD, 1).when(f["family"] == MODERN, 2).otherwise(3)
    return F.struct(rank.alias("rank"), f["version"].alias("version"), name.alias("name"))
