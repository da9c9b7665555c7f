"""Reports over the model: totals, areas, series, headline, applications, roll-ups and diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import ancestors, directory_key, unix_path
from tesserae.operators.graph import application_closure, closure, readiness, wide, with_starts
from tesserae.operators.relational import complete, first_per_key, first_with_ties, not_in

# The framework classes.
CLASSES = ["framework", "standard", "modern", "dual"]


def domain(spark, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], [name])


def totals(projects: DataFrame, by: str = "framework_class", values: list[str] | None = None) -> DataFrame:
    """(by, projects, loc) for every value of the domain, zeros included."""
    counted = projects.groupBy(by).agg(F.count("id").alias("projects"), F.sum("loc").alias("loc"))
    return complete(counted, domain(projects.sparkSession, by, values or CLASSES), [by], ["projects", "loc"]).orderBy(by)


def areas(projects: DataFrame) -> DataFrame:
    """(area, framework_class, projects, loc): every class for every area."""
    rows = projects.withColumn("area", directory_key(F.col("id")))
    counted = rows.groupBy("area", "framework_class").agg(F.count("id").alias("projects"), F.sum("loc").alias("loc"))
    pairs = rows.select("area").distinct().withColumn("framework_class", F.explode(F.array(*map(F.lit, CLASSES))))
    return complete(counted, pairs, ["area", "framework_class"], ["projects", "loc"]).orderBy("area", "framework_class")


def headline(projects: DataFrame) -> DataFrame:
    """One row; the portable share is rounded half away from zero, and 0 for no lines."""
    framework = F.col("framework_class") == "framework"
    n, loc = F.count("id"), F.coalesce(F.sum("loc"), F.lit(0))
    own = F.coalesce(F.sum(F.when(framework, F.col("loc"))), F.lit(0))
    share = F.coalesce(F.round(F.try_divide(100.0 * (loc - own), loc), 1), F.lit(0.0))
    return projects.agg(n.alias("projects"), loc.alias("loc"), F.count_if(framework).alias("framework_projects"), own.alias("framework_loc"), share.alias("portable_percent"))


def series(snapshots: DataFrame, solution: str | None, created_at: str, since: str | None = None, current: DataFrame | None = None) -> DataFrame:
    """Snapshots of one solution, since a time and before the model's; of equal times the last in file order stays.

    Times are ISO strings and compare as strings; snapshots (created_at, solution, file, ...). current: the model's own
    point, which ends the series whatever `since` says.
    """
    rows = snapshots.filter(F.col("solution").eqNullSafe(F.lit(solution))).filter(F.col("created_at") < created_at)
    rows = rows.filter(F.col("created_at") >= since) if since is not None else rows
    rows = first_per_key(rows, ["created_at"], [F.desc("file")])
    return (rows if current is None else rows.unionByName(current, allowMissingColumns=True)).orderBy("created_at")


def change_since_first(points: DataFrame, at: str, value: str, keys: list[str] = ()) -> DataFrame:
    """points with change, the value less the first one's (of the keys, if any); of equal times the least value is first."""
    first = F.min(F.struct(at, value))
    if not keys:
        return points.withColumn("change", F.col(value) - points.agg(first.alias("x")).select(F.col(f"x.{value}")).scalar())
    low = points.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first.alias("__x"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return points.join(low, same).withColumn("change", F.col(value) - F.col(f"__x.{value}")).drop("__x", *[f"__{k}" for k in keys])


def application(projects: DataFrame, edges: DataFrame, hosted: DataFrame, start, states: DataFrame | None = None) -> DataFrame:
    """One row for an application: size of its closure, framework-only projects left, its status and what is ready next.

    It is ready only if it is the one project left; hosted projects that are left block it. states: their readiness, if known.
    """
    near = application_closure(edges, hosted, start)
    states = (readiness(projects, edges) if states is None else states).withColumnRenamed("id", "__i")
    rows = projects.join(wide(near), F.col("id") == F.col("node"), "left_semi").join(wide(states), F.col("id") == F.col("__i"))
    left = F.count_if(F.col("framework_class") == "framework")
    ready = F.array_sort(F.collect_set(F.when(F.col("readiness") == "ready", F.col("id"))))
    own = F.count_if((F.col("framework_class") == "framework") & (F.col("id") == F.lit(start)))
    status = F.when(left == 0, "done").when((left == 1) & (own == 1), "ready").otherwise("blocked")
    return rows.agg(F.lit(start).alias("application"), F.count("id").alias("projects"), left.alias("remaining"), status.alias("status"), ready.alias("next"))


# Kinds of project that are applications.
APPLICATION_KINDS = ["console", "service", "web", "winforms", "wpf"]


def application_report(projects: DataFrame, edges: DataFrame, hosted: DataFrame, starts: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """(application, projects, remaining, status, next) of all applications at once; see `application` for one.

    starts: a one-column frame of applications; by default projects of `APPLICATION_KINDS` that nothing hosts. states: the projects' readiness, if known.
    """
    if starts is None:
        free = hosted.filter("hosted_by IS NOT NULL").select(F.col("id").alias("__h")).distinct()
        starts = projects.filter(F.col("kind").isin(*APPLICATION_KINDS)).select("id").join(wide(free), F.col("id") == F.col("__h"), "left_anti")
    own = starts.select(F.col(starts.columns[0]).cast(edges.schema["src"].dataType).alias("node")).distinct()
    link = hosted.filter("hosted_by IS NOT NULL").select(F.col("hosted_by").alias("src"), F.col("id").alias("dst"))
    seeds = with_starts(closure(link, own), own).select(F.col("src").alias("application"), F.col("dst").alias("seed"))
    roots = seeds.select(F.col("seed").alias("node")).distinct()
    below = with_starts(closure(edges, roots), roots)
    near = seeds.join(wide(below), F.col("seed") == F.col("src")).select("application", F.col("dst").alias("node")).distinct()
    states = (readiness(projects, edges) if states is None else states).withColumnRenamed("id", "__i")
    rows = near.join(wide(projects), F.col("node") == F.col("id")).join(wide(states), F.col("id") == F.col("__i"))
    left = F.count_if(F.col("framework_class") == "framework")
    mine = F.count_if((F.col("framework_class") == "framework") & (F.col("id") == F.col("application")))
    status = F.when(left == 0, "done").when((left == 1) & (mine == 1), "ready").otherwise("blocked")
    ready = F.array_sort(F.collect_set(F.when(F.col("readiness") == "ready", F.col("id"))))
    return rows.groupBy("application").agg(F.count("id").alias("projects"), left.alias("remaining"), status.alias("status"), ready.alias("next"))


def library_report(projects: DataFrame, edges: DataFrame, shipped: DataFrame, hosted: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(project, shipped, status, closure, remaining, remaining_loc, next) of each shipped library that nothing hosts.

    projects (id, kind, framework_class, loc), shipped (id, reason), hosted (id, ...). A library is done if no
    framework-only project is left in its closure, itself included, ready if it is the only one, else blocked; next are those that are ready.
    """
    own = projects.filter("kind = 'library'").join(wide(shipped.select("id", F.col("reason").alias("shipped"))), "id").join(wide(hosted.select("id")), "id", "left_anti").select(F.col("id").alias("project"), "shipped")
    starts = own.select("project")
    states = (readiness(projects, edges) if states is None else states).withColumnRenamed("id", "__i")
    near = with_starts(closure(edges, starts), starts).join(wide(projects), F.col("dst") == F.col("id")).join(wide(states), F.col("id") == F.col("__i"), "left")
    left = F.col("framework_class") == "framework"
    n, mine = F.count_if(left), F.count_if(left & (F.col("id") == F.col("src")))
    status = F.when(n == 0, "done").when((n == 1) & (mine == 1), "ready").otherwise("blocked")
    told = near.groupBy("src").agg(
        status.alias("status"), F.count("id").alias("closure"), n.alias("remaining"), F.coalesce(F.sum(F.when(left, F.col("loc"))), F.lit(0)).alias("remaining_loc"), F.array_sort(F.collect_set(F.when(left & (F.col("readiness") == "ready"), F.col("id")))).alias("next")
    )
    return own.join(wide(told), F.col("project") == F.col("src")).drop("src")


def error_rollup(errors: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """By code: errors and projects, most first; and the k most frequent texts. Repeats of one error count once."""
    rows = errors.select("code", "project", "file", "line", "message").distinct()
    by_code = rows.groupBy("code").agg(F.count(F.lit(1)).alias("errors"), F.countDistinct("project").alias("projects")).orderBy(F.desc("errors"), "code")
    texts = rows.groupBy("message").count().orderBy(F.desc("count"), "message").limit(k)
    return by_code, texts


def explained_difference(before: DataFrame, after: DataFrame, packages: DataFrame, declared: DataFrame) -> DataFrame:
    """(change, reason, n, names): references added and removed, each told by a package, a declaration or neither.

    before, after (name) ignore case; packages (name, package), declared (name).
    """
    low = lambda df: df.select(F.lower("name").alias("name")).distinct()
    a, b = low(before), low(after)
    rows = not_in(b, a, ["name"]).withColumn("change", F.lit("added")).unionByName(not_in(a, b, ["name"]).withColumn("change", F.lit("removed")))
    by_package = packages.groupBy(F.lower("name").alias("__p")).agg(F.min("package").alias("package"))
    rows = rows.join(by_package, F.col("name") == F.col("__p"), "left").join(low(declared).withColumnRenamed("name", "__d"), F.col("name") == F.col("__d"), "left")
    reason = F.when(F.col("package").isNotNull(), F.concat(F.lit("package "), F.col("package"))).when(F.col("__d").isNotNull(), "declared").otherwise("unexplained")
    return rows.groupBy("change", reason.alias("reason")).agg(F.count("name").alias("n"), F.array_sort(F.collect_set("name")).alias("names")).orderBy("change", "reason")


def compile_differences(before: DataFrame, after: DataFrame, packages: DataFrame, declared: DataFrame, facades: DataFrame) -> DataFrame:
    """(kind, change, reason, source, n, names): what a compilation gains and loses, references told by where they come from.

    before, after (kind, name): references ignore case, sources and resources do not. A reference is told by its
    package, packages (name, package), else by a framework declaration, declared (name), else by a facade, facades (name); the
    reason is null for what isn't a reference.
    """
    reference = F.col("kind") == "reference"
    # a reference is known by its lower case and told by its least spelling
    sides = [df.groupBy("kind", F.when(reference, F.lower("name")).otherwise(F.col("name")).alias("key")).agg(F.min("name").alias("name")) for df in (before, after)]
    rows = not_in(sides[1], sides[0], ["kind", "key"]).withColumn("change", F.lit("added")).unionByName(not_in(sides[0], sides[1], ["kind", "key"]).withColumn("change", F.lit("removed")))
    low = lambda df, name: df.select(F.lower("name").alias(name)).distinct()
    by_package = packages.groupBy(F.lower("name").alias("__p")).agg(F.min("package").alias("package"))
    rows = rows.join(by_package, F.col("key") == F.col("__p"), "left").join(low(declared, "__d"), F.col("key") == F.col("__d"), "left").join(low(facades, "__f"), F.col("key") == F.col("__f"), "left")
    why = F.when(F.col("package").isNotNull(), "package").when(F.col("__d").isNotNull(), "declaration").when(F.col("__f").isNotNull(), "facade").otherwise("unexplained")
    rows = rows.select("kind", "change", "name", F.when(reference, why).alias("reason"), F.when(reference, F.col("package")).alias("source"))
    return rows.groupBy("kind", "change", "reason", "source").agg(F.count("name").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


# Names and endings of files that builds pick up for every project beneath their folder.
BUILD_WIDE = r"(?i)(^|/)(global\.json|nuget\.config|[^/]*\.props|[^/]*\.targets)$"


def affected(paths: DataFrame, projects: DataFrame, compiles: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(path, project): the owners of each path, and with edges (src, dst) what references an owner directly.

    The first level that has an owner counts, and all its owners: the project file itself; projects that compile the
    file; for build-wide files every project beneath their folder; projects in the deepest folder that holds the path;
    else every project beneath the path, or beneath its folder. Case is ignored, slashes may be backward.
    projects (id, folder), compiles (project, file). All levels are equi-joins on lower-case keys: a path's own
    ancestors, or a project's.
    """
    p = F.regexp_replace(unix_path(F.col("path")), "/+$", "")
    rows = paths.select("path", F.lower(p).alias("k")).distinct().withColumn("in", F.when(F.col("k").contains("/"), F.regexp_replace("k", "/[^/]*$", "")).otherwise("."))
    all_ = projects.select(F.col("id").alias("project"), F.lower("id").alias("pk"), F.lower(F.when(F.col("folder").isin("", "."), F.lit(".")).otherwise(F.col("folder"))).alias("fk"))
    beneath = all_.select("project", F.explode(ancestors(F.col("pk"))).alias("above"))
    wide = F.col("k").rlike(BUILD_WIDE)
    own = rows.join(all_, F.col("k") == F.col("pk")).select("path", "project", F.lit(0).alias("level"))
    compiled = rows.join(compiles.select("project", F.lower("file").alias("f")), F.col("k") == F.col("f")).select("path", "project", F.lit(1).alias("level"))
    build = rows.filter(wide).join(beneath, F.col("in") == F.col("above")).select("path", "project", F.lit(2).alias("level"))
    # a build-wide file with nothing beneath it belongs to none
    none = rows.filter(wide).select("path", F.lit(None).cast(projects.schema["id"].dataType).alias("project"), F.lit(2).alias("level"))
    tried = rows.select("path", F.explode(ancestors(F.col("k"))).alias("at"))
    held = tried.join(all_, F.col("at") == F.col("fk")).withColumn("depth", F.when(F.col("at") == ".", 0).otherwise(F.length("at")))
    held = first_with_ties(held, ["path"], [F.desc("depth")]).select("path", "project", F.lit(3).alias("level"))
    under = rows.join(beneath, F.col("k") == F.col("above")).select("path", "project", F.lit(4).alias("level"))
    beside = rows.join(beneath, F.col("in") == F.col("above")).select("path", "project", F.lit(5).alias("level"))
    found = own
    for part in (compiled, build, none, held, under, beside):
        found = found.unionByName(part)
    owners = first_with_ties(found, ["path"], [F.col("level")]).filter("project IS NOT NULL").select("path", "project").distinct()
    if edges is None:
        return owners
    users = owners.join(edges.select("src", "dst"), F.col("project") == F.col("dst")).select("path", F.col("src").alias("project"))
    return owners.unionByName(users).distinct()


def package_index(projects: DataFrame, ids: str = "id") -> DataFrame:
    """(id, version, projects): sorted projects of each package version; ids ignore case and keep their least spelling."""
    return projects.groupBy(F.lower(ids).alias("key"), "version").agg(F.min(ids).alias("id"), F.array_sort(F.collect_set("project")).alias("projects")).drop("key")


def assembly_index(packages: DataFrame) -> DataFrame:
    """(assembly, id, version): for each assembly the package named like it, else the first by id and version."""
    order = [(F.lower("id") == F.lower("assembly")).desc(), F.lower("id"), F.col("version")]
    return first_per_key(packages, ["assembly"], order)


def moved_types(source_before: DataFrame, source_after: DataFrame, destination_after: DataFrame) -> DataFrame:
    """(name): former types of the source that are in the destination and no longer in the source."""
    return source_before.select("name").distinct().join(destination_after.select("name"), "name", "left_semi").join(source_after.select("name"), "name", "left_anti")


def directive_totals(regions: DataFrame) -> DataFrame:
    """(project, files, lines) of conditional regions, and a null project for all: shared files count once there.

    regions (project, file, region, lines): a region is named within its file, so that two of equal length both count.
    """
    one = regions.select("project", "file", "region", "lines").distinct().groupBy("project").agg(F.countDistinct("file").alias("files"), F.sum("lines").alias("lines"))
    every = regions.select("file", "region", "lines").distinct().agg(F.lit(None).cast("string").alias("project"), F.countDistinct("file").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return one.unionByName(every)
