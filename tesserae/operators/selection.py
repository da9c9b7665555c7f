"""Selections that rank, vote, fall back or fold: nearest groups, path votes, ordered candidates, batches, hazards."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import ancestors, unix_path
from tesserae.operators.graph import bounded, closure, leaf_first, local_components, reverse, wide, with_starts
from tesserae.operators.relational import few, first_per_key, first_with_ties, not_in
from tesserae.session import checkpoint_ready


def nearest_group(wanted: DataFrame, groups: DataFrame, precedence: DataFrame) -> DataFrame:
    """(package, target, framework): of a package's groups the one that suits a target best.

    wanted (package, target), groups (package, framework), precedence (target, framework, rank): lower ranks are nearer.
    """
    fits = groups.join(precedence, "framework").select(F.col("package").alias("__p"), F.col("target").alias("__t"), "framework", "rank")
    rows = wanted.join(fits, (F.col("package") == F.col("__p")) & (F.col("target") == F.col("__t")))
    return first_per_key(rows, ["package", "target"], [F.col("rank"), F.col("framework")]).select("package", "target", "framework")


def platform_only(assets: DataFrame, marker: str = "windows") -> DataFrame:
    """(package, evidence): the first asset folder, library before reference, whose framework names the platform."""
    order = F.when(F.col("folder") == "lib", 0).when(F.col("folder") == "ref", 1).otherwise(2)
    rows = assets.filter(F.lower("framework").contains(marker))
    return first_per_key(rows, ["package"], [order, F.col("framework")]).select("package", F.concat_ws("/", "folder", "framework").alias("evidence"))


def windows_evidence(assets: DataFrame, precedence: DataFrame, native: DataFrame) -> DataFrame:
    """(package, target, evidence): why a package serves a target on Windows alone.

    assets (package, path, framework, marker): a marker says what ties an assembly to Windows. precedence (target,
    framework, rank). Of lib, else ref, the framework nearest to the target decides, by its first marked assembly. A package
    with neither whose runtime files, native (package, path) first, are all for Windows is told by the first of them.
    """
    root = F.when(F.lower("path").startswith("lib/"), 0).when(F.lower("path").startswith("ref/"), 1)
    held = assets.withColumn("root", root)
    fits = held.filter("root IS NOT NULL").join(precedence.withColumnRenamed("framework", "__w"), F.col("framework") == F.col("__w"))
    near = first_with_ties(fits, ["package", "target"], [F.col("root"), F.col("rank"), F.col("framework")])
    by_assembly = near.filter("marker IS NOT NULL").groupBy("package", "target").agg(F.min_by(F.concat_ws(": ", "path", "marker"), "path").alias("evidence"))
    runtime = native.select("package", "path", F.lit(0).alias("kind")).unionByName(held.filter(F.lower("path").startswith("runtimes/")).select("package", "path", F.lit(1).alias("kind")))
    runtime = not_in(runtime, held.filter("root IS NOT NULL"), ["package"])
    parts = F.split("path", "/")
    ours = F.coalesce((F.size(parts) > 1) & F.lower(F.get(parts, F.lit(1))).startswith("win"), F.lit(False))
    first = runtime.groupBy("package").agg(F.min(F.struct("kind", "path")).alias("x"), F.min(ours).alias("all")).filter("all")
    what = F.when(F.col("x.kind") == 0, ": native code for Windows only").otherwise(": code for Windows only")
    each = first.select("package", F.concat("x.path", what).alias("evidence"), F.explode(few(precedence, "target")).alias("target"))
    return by_assembly.unionByName(each.select("package", "target", "evidence"))


def zipped(left: Column, right: Column) -> Column:
    """Pairs by position, as long as the shorter of two arrays."""
    n = F.least(F.size(left), F.size(right))
    return F.transform(F.slice(F.arrays_zip(left.alias("a"), right.alias("b")), 1, F.greatest(n, F.lit(0))), lambda x: F.struct(x["a"].alias("left"), x["b"].alias("right")))


def path_prefix(logged: DataFrame, files: DataFrame) -> DataFrame:
    """(prefix, votes): each logged path votes for the prefix whose rest exists; most votes, then the least prefix.

    logged (path) absolute, files (path) relative. The longest rest that exists is a path's vote.
    """
    parts = F.split(unix_path(F.col("path")), "/")
    rows = logged.select(F.col("path").alias("__l"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("__k", "rest"), parts.alias("parts"))
    known = rows.join(files.select(F.col("path").alias("__f")), F.col("rest") == F.col("__f"), "left_semi")
    votes = first_per_key(known, ["__l"], [F.col("__k")]).select(F.array_join(F.slice("parts", 1, F.col("__k")), "/").alias("prefix"))
    return votes.groupBy("prefix").agg(F.count(F.lit(1)).alias("votes")).orderBy(F.desc("votes"), "prefix").limit(1)


def governing(folders: DataFrame, marks: DataFrame) -> DataFrame:
    """(folder, mark): the nearest folder at or above each that holds a mark."""
    tried = folders.select("folder", F.explode(F.array_union(ancestors(F.col("folder")), F.array("folder"))).alias("__at"))
    found = tried.join(marks.select(F.col("folder").alias("mark")).distinct(), F.col("__at") == F.col("mark"))
    depth = F.when(F.col("mark") == ".", 0).otherwise(F.size(F.split("mark", "/")))
    return found.groupBy("folder").agg(F.max_by("mark", depth).alias("mark"))


def version_hazards(props: DataFrame, projects: DataFrame, listed: DataFrame, old_style: DataFrame) -> DataFrame:
    """(hazard, path, folder): what goes wrong with central package versions.

    props (folder, imports_parent): folders that hold central versions. `outside`: a project that the solution doesn't list
    but a folder governs; `shadows`: a folder below another one that doesn't import it; `old style`: a listed project
    with a package list of its own. projects, listed, old_style (id); listing ignores case.
    """
    folder = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(".")
    known = listed.select(F.lower("id").alias("__k")).distinct()
    out = projects.select("id").distinct().join(known, F.lower("id") == F.col("__k"), "left_anti").withColumn("__in", folder(F.col("id")))
    over = governing(out.select(F.col("__in").alias("folder")).distinct(), props)
    outside = out.join(over, F.col("__in") == F.col("folder")).select(F.lit("outside").alias("hazard"), F.col("id").alias("path"), F.col("mark").alias("folder"))
    nested = props.filter("folder != '.'").select(F.col("folder").alias("at"), "imports_parent", folder(F.col("folder")).alias("__in"))
    above = governing(nested.select(F.col("__in").alias("folder")).distinct(), props)
    shadows = nested.filter("NOT coalesce(imports_parent, false)").join(above, F.col("__in") == F.col("folder")).select(F.lit("shadows").alias("hazard"), F.col("at").alias("path"), F.col("mark").alias("folder"))
    old = listed.select("id").distinct().join(old_style.select("id"), "id", "left_semi")
    return outside.unionByName(shadows).unionByName(old.select(F.lit("old style").alias("hazard"), F.col("id").alias("path"), F.lit(None).cast("string").alias("folder")))


def below_but_missing(on_disk: DataFrame, listed: DataFrame, folder: str) -> DataFrame:
    """(id): projects below a folder that the solution doesn't list, whatever their case."""
    inside = on_disk if folder == "." else on_disk.filter(F.lower("id").startswith(folder.lower().rstrip("/") + "/"))
    keyed = listed.select(F.lower("id").alias("__k")).distinct()
    return inside.join(keyed, F.lower("id") == F.col("__k"), "left_anti").select("id")


def priority_mapping(sources: DataFrame, entries: list[tuple[str, str]], references: DataFrame, eligible: DataFrame) -> DataFrame:
    """(source, target, origin): explicit entries first, in order, else eligible project references.

    Entries are (pattern, template): a pattern ends in * or is a whole name, a template may hold {name}.
    references (source, target), eligible (target). Sources keep all references that tie.
    """
    made = None
    for k, (pattern, template) in enumerate(entries):
        hit = F.col("source").startswith(pattern[:-1]) if pattern.endswith("*") else F.col("source") == pattern
        part = sources.filter(hit).select("source", F.replace(F.lit(template), F.lit("{name}"), F.col("source")).alias("target"), F.lit("map").alias("origin"), F.lit(k).alias("level"))
        made = part if made is None else made.unionByName(part)
    by_reference = references.join(eligible.select(F.col("target").alias("__t")).distinct(), F.col("target") == F.col("__t"), "left_semi")
    by_reference = by_reference.select("source", "target", F.lit("reference").alias("origin"), F.lit(len(entries)).alias("level"))
    rows = by_reference if made is None else made.unionByName(by_reference)
    return first_with_ties(rows, ["source"], [F.col("level")]).drop("level").distinct()


def counterparts(projects: DataFrame, entries: list[tuple[str, str]], edges: DataFrame, unsuited: DataFrame) -> DataFrame:
    """(project, counterpart, source, problem): where the code of each project that applies may go; a problem says why not.

    projects (id, name, applies, language, excluded, frozen, framework_class, compiled, test). entries (pattern, template)
    in order of precedence, as in `priority_mapping`, over names; a target is an id or else a name, whatever its case, and
    one that no project has, or several have, counts as none. A project with a matching entry takes entries alone; any other, unless a
    test, takes what it refers to, if that is portable, no test and without a problem. A project without a
    candidate has one row without a counterpart, of source `map` or `none`. unsuited (project, counterpart, target):
    targets for which a project can't refer to a counterpart.
    """
    asked, low = projects.filter("applies"), F.lower
    made = None
    for pattern, template in entries:
        hit = F.col("name").startswith(pattern[:-1]) if pattern.endswith("*") else F.col("name") == pattern
        part = asked.filter(hit).select(F.col("id").alias("project"), F.replace(F.lit(template), F.lit("{name}"), F.col("name")).alias("to"))
        made = part if made is None else made.unionByName(part)
    if made is None:
        made = asked.limit(0).select(F.col("id").alias("project"), F.col("name").alias("to"))
    by_id = projects.groupBy(low("id").alias("i")).agg(F.min("id").alias("a"))
    by_name = projects.groupBy(low("name").alias("n")).agg(F.min("id").alias("b"), F.count("id").alias("k")).filter("k = 1")
    mapped = made.distinct().join(wide(by_id), low("to") == F.col("i"), "left").join(wide(by_name), low("to") == F.col("n"), "left")
    mapped = mapped.select("project", F.coalesce("a", "b").alias("counterpart"), F.lit("map").alias("source")).distinct()
    rest = not_in(asked.filter("NOT test").select(F.col("id").alias("project")), made, ["project"])
    fit = projects.filter("framework_class IN ('standard', 'dual') AND NOT test").select(F.col("id").alias("__c"))
    referred = rest.join(wide(edges.select("src", "dst").distinct()), F.col("project") == F.col("src")).join(wide(fit), F.col("dst") == F.col("__c"), "left_semi").select("project", F.col("dst").alias("counterpart"), F.lit("references").alias("source"))
    rows = mapped.filter("counterpart IS NOT NULL").unionByName(referred)

    facts = projects.select(F.col("id").alias("__c"), "language", "excluded", "frozen", "framework_class", "compiled")
    back = closure(edges, rows.select("counterpart").distinct()).select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    least = unsuited.groupBy(F.col("project").alias("__p"), F.col("counterpart").alias("__u")).agg(F.min("target").alias("target"))
    rows = rows.join(wide(facts), F.col("counterpart") == F.col("__c")).join(wide(back), (F.col("counterpart") == F.col("__s")) & (F.col("project") == F.col("__d")), "left")
    rows = rows.join(wide(least), (F.col("project") == F.col("__p")) & (F.col("counterpart") == F.col("__u")), "left")
    problem = (
        F.when(F.col("project") == F.col("counterpart"), "itself").when(F.col("language") != "csharp", "language").when(F.col("excluded"), "excluded").when(F.col("frozen"), "frozen")
        .when(F.col("framework_class") == "framework", "framework only").when(F.col("framework_class") == "modern", "modern only").when(~F.col("compiled"), "not compiled")
        .when(F.col("__d").isNotNull(), "depends on it").when(F.col("target").isNotNull(), F.concat(F.lit("no reference for "), "target"))
    )
    rows = rows.select("project", "counterpart", "source", problem.alias("problem")).filter("source = 'map' OR problem IS NULL")
    bare = not_in(asked.select(F.col("id").alias("project")), rows, ["project"]).join(wide(made.select(F.col("project").alias("__m")).distinct()), F.col("project") == F.col("__m"), "left")
    kind = projects.schema["id"].dataType
    return rows.unionByName(bare.select("project", F.lit(None).cast(kind).alias("counterpart"), F.when(F.col("__m").isNotNull(), "map").otherwise("none").alias("source"), F.lit(None).cast("string").alias("problem")))


def ordered_candidates(names: DataFrame, configured: DataFrame, built_in: DataFrame) -> DataFrame:
    """(name, place, id): configured ids, then built-in ones, then the name itself; repeats in another case are left out.

    configured, built_in (name, place, id).
    """
    own = names.select("name", F.lit(0).alias("place"), F.col("name").alias("id"))
    sources = [configured.select("name", "place", "id"), built_in.select("name", "place", "id"), own]
    rows = None
    for k, s in enumerate(sources):
        part = s.withColumn("level", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    first = first_per_key(rows.withColumn("__k", F.lower("id")), ["name", "__k"], [F.col("level"), F.col("place"), F.col("id")])
    ordered = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("level", "place", "id"))).alias("ids"))
    return ordered.select("name", F.posexplode("ids").alias("place", "x")).select("name", "place", "x.id")


def entities(calls: DataFrame) -> DataFrame:
    """(project, tfms, sources, references): compiler calls put together to projects, each set sorted."""
    sets = {c: F.array_sort(F.collect_set(s)) for c, s in (("tfms", "tfm"), ("sources", "source"), ("references", "reference"))}
    return calls.groupBy("project").agg(*[v.alias(k) for k, v in sets.items()])


def first_cause(settings: DataFrame, causes: list[tuple[str, Column]]) -> DataFrame:
    """(project, cause, file): the first cause that holds, and the first file in import order that sets the property."""
    chain = None
    for name, holds in causes:
        chain = F.when(holds, name) if chain is None else chain.when(holds, name)
    rows = settings.withColumn("cause", chain).filter("cause IS NOT NULL")
    rank = F.array_position(F.array(*[F.lit(n) for n, _ in causes]), F.col("cause"))
    return first_per_key(rows, ["project"], [rank, F.col("import_order")]).select("project", "cause", "file")


def case_mismatches(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found): paths that exist only in another case, with the least spelling on disk."""
    missing = not_in(asked.select("path"), files.select("path"), ["path"])
    spelled = files.groupBy(F.lower("path").alias("__k")).agg(F.min("path").alias("found"))
    return missing.join(spelled, F.lower("path") == F.col("__k")).select("path", "found")


def case_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found, segment, actual): asked paths that exist only in another case, followed segment by segment.

    In each folder the spelling asked for is taken if it is there, else the least one that differs in case alone; a
    path that has neither is not on disk. segment and actual are the first that differ. files (path); their folders exist too.
    """
    checkpoint_ready(asked.sparkSession)
    parts = F.split("path", "/")
    inside = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("folder"), F.element_at(parts, i).alias("name")))).alias("e"))
    names = inside.groupBy("e.folder", F.lower("e.name").alias("key")).agg(F.array_sort(F.collect_set("e.name")).alias("names")).checkpoint()
    none = F.lit(None).cast("string")
    rows = asked.select("path").distinct().select("path", parts.alias("parts"), F.lit("").alias("at"), none.alias("segment"), none.alias("actual")).checkpoint()
    out = rows.limit(0)
    for i in range(rows.agg(F.max(F.size("parts"))).first()[0] or 0):
        own = F.get("parts", F.lit(i))
        step = rows.join(names, (F.col("at") == F.col("folder")) & (F.lower(own) == F.col("key")))
        took = F.when(F.array_contains("names", own), own).otherwise(F.get("names", F.lit(0)))
        new = F.col("segment").isNull() & (took != own)
        at = took if i == 0 else F.concat_ws("/", "at", took)
        rows = step.select("path", "parts", at.alias("at"), F.when(new, own).otherwise(F.col("segment")).alias("segment"), F.when(new, took).otherwise(F.col("actual")).alias("actual")).checkpoint()
        out = out.unionByName(rows.filter(F.size("parts") == i + 1))
        rows = rows.filter(F.size("parts") > i + 1)
    return out.filter("segment IS NOT NULL").select("path", F.col("at").alias("found"), "segment", "actual")


def greedy_edits(edits: Column) -> Column:
    """Of edits (start, end), the longest of each start, then from the left those that overlap none kept before."""
    longest = F.array_sort(edits, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    empty = F.filter(edits, lambda e: F.lit(False))
    zero = F.struct(F.lit(-1).cast("long").alias("to"), empty.alias("kept"))
    keep = lambda acc, e: F.when(
        e["start"].cast("long") >= acc["to"], F.struct(e["end"].cast("long").alias("to"), F.concat(acc["kept"], F.array(e)).alias("kept"))
    ).otherwise(acc)
    return F.aggregate(longest, zero, keep)["kept"]


def assembly_usage(uses: DataFrame) -> DataFrame:
    """(assembly, uses, types): how often each assembly is bound to, and its types that are used, sorted."""
    return uses.groupBy("assembly").agg(F.count(F.lit(1)).alias("uses"), F.array_sort(F.collect_set("type")).alias("types"))


def on_lines(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings within new lines: ranges (file, first, last) are exploded to lines, which makes an equi-join."""
    lines = ranges.select(F.col("file").alias("__f"), F.explode(F.sequence("first", "last")).alias("__l")).distinct()
    return findings.join(lines, (F.col("file") == F.col("__f")) & (F.col("line") == F.col("__l")), "left_semi")


def shipped_reasons(projects: DataFrame, external: DataFrame, packable: DataFrame, beside: DataFrame, named: DataFrame, used: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """(id, reason): why a project may be used from outside, by priority; each of the others is a frame of ids.

    Only `libraries` (by default, all) are shipped for a specification beside them, or for want of an application.
    """
    rows, chain = projects.select("id"), None
    for k, (name, df) in enumerate((("external", external), ("packable", packable), ("nuspec beside", beside), ("nuspec names it", named))):
        rows = rows.join(df.select(F.col(df.columns[0]).alias(f"__{k}")).distinct(), F.col("id") == F.col(f"__{k}"), "left")
        chain = F.when(F.col(f"__{k}").isNotNull(), name) if chain is None else chain.when(F.col(f"__{k}").isNotNull(), name)
    rows = rows.join(used.select(F.col(used.columns[0]).alias("__u")).distinct(), F.col("id") == F.col("__u"), "left")
    rows = rows.select("id", chain.when(F.col("__u").isNull(), "no application").alias("reason")).filter("reason IS NOT NULL")
    if libraries is None:
        return rows
    asked = libraries.select(F.col(libraries.columns[0]).alias("__l")).distinct()
    others = rows.join(asked, F.col("id") == F.col("__l"), "left_anti").filter("reason NOT IN ('nuspec beside', 'no application')")
    # what isn't a library may still be named by a specification elsewhere
    hidden = rows.join(asked, F.col("id") == F.col("__l"), "left_anti").filter("reason = 'nuspec beside'").select("id")
    through = hidden.join(named.select(F.col(named.columns[0]).alias("__n")).distinct(), F.col("id") == F.col("__n"), "left_semi").withColumn("reason", F.lit("nuspec names it"))
    return rows.join(asked, F.col("id") == F.col("__l"), "left_semi").unionByName(others).unionByName(through)


def libraries(projects: DataFrame, edges: DataFrame, shipped: DataFrame) -> DataFrame:
    """(library, projects, remaining): the closure of each shipped library and the framework-only projects in it."""
    own = shipped.select(F.col(shipped.columns[0]).alias("src"))
    near = with_starts(closure(edges, own), own).join(wide(projects.select("id", "framework_class")), F.col("dst") == F.col("id"))
    return near.groupBy(F.col("src").alias("library")).agg(F.count("id").alias("projects"), F.count_if(F.col("framework_class") == "framework").alias("remaining"))


def partial_dependency(projects: DataFrame, edges: DataFrame, hosted: DataFrame | None = None) -> DataFrame:
    """(id, because): the project itself if partial, else the least partial project among its dependencies.

    hosted (id, hosted_by): what a project hosts, directly or not, counts with what that depends on.
    """
    from tesserae.operators.reach import carried

    part = projects.filter("partial").select(F.col("id").alias("p"))
    label = carried(reverse(edges), part.select(F.col("p").alias("node"), F.col("p").alias("label")))
    if hosted is not None:  # what a host hosts stands above what that depends on: labels go there first, then to the hosts
        label = carried(hosted.filter("hosted_by IS NOT NULL").select(F.col("id").alias("src"), F.col("hosted_by").alias("dst")), label)
    rows = projects.select("id").distinct().join(wide(label), F.col("id") == F.col("node")).join(wide(part), F.col("id") == F.col("p"), "left")
    return rows.select("id", F.coalesce("p", "label").alias("because"))


def batches(edges: DataFrame, nodes: DataFrame, size: int) -> list[list]:
    """Nodes in batches of about `size`, none before what it needs; nodes that need each other share a batch. Bounded."""
    of = local_components(bounded(edges), {r[0] for r in nodes.select(nodes.columns[0]).collect()})
    groups: dict = defaultdict(list)
    for n in leaf_first(edges, nodes):
        groups[of.get(n, n)].append(n)
    out: list[list] = []
    for g in groups.values():
        if out and len(out[-1]) + len(g) <= size:
            out[-1] += g
        else:
            out.append(list(g))
    return out


def kept_move_set(candidates: DataFrame, needs: DataFrame, movable: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(node): the largest set of movable candidates whose needs are all in the set or outside the candidates.

    needs (src, dst). A candidate that can't move takes those that need it along, round by round. With `wanted`, a
    one-column frame, what is left and neither wanted nor needed by what is, directly or not, is dropped.
    """
    from tesserae.operators.graph import reached_set

    c = candidates.select(F.col(candidates.columns[0]).alias("node")).distinct()
    stuck = c.join(movable.select(F.col(movable.columns[0]).alias("m")), F.col("node") == F.col("m"), "left_anti")
    inner = needs.join(c.select(F.col("node").alias("a")), F.col("src") == F.col("a"), "left_semi").join(c.select(F.col("node").alias("b")), F.col("dst") == F.col("b"), "left_semi")
    out = reached_set(reverse(inner), stuck).withColumnRenamed("node", "o")
    kept = c.join(out, F.col("node") == F.col("o"), "left_anti")
    if wanted is None:
        return kept
    asked = kept.join(wanted.select(F.col(wanted.columns[0]).alias("w")), F.col("node") == F.col("w"), "left_semi")
    # what a kept candidate needs among the candidates is kept as well, so the walk stays inside
    return reached_set(inner.select("src", "dst"), asked)
