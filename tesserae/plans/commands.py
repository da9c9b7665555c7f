"""The analyses as whole answers over the normalised tables of a workspace (sources.model.tables).

Each takes the tables and options and returns frames; sources.sinks writes them out. Filters narrow listings only:
numbers always come from the whole model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import directory_key
from tesserae.operators import consolidation, cuts, facts, fixpoints, gating, graph, reports, rules, versions
from tesserae.operators.relational import baseline, longest_prefix


def used(t: dict[str, DataFrame]) -> DataFrame:
    return graph.used_edges(t["edge"], t["modern_list"], t["modern_ref"])


def plan(t: dict[str, DataFrame], only_for=None, frontier: bool = False, exclude_kinds: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(listing, counts)."""
    rows = graph.plan(t["project"].select("id", "name", "kind", "framework_class", "loc"), t["edge"], used(t), only_for, frontier, exclude_kinds, t["project"].select("id", "hosted_by"))
    return rows, graph.plan_counts(rows)


def graph_view(t: dict[str, DataFrame], focus=None, depth: int | None = None, direction: str = "both", include_kinds: tuple = (), exclude_kinds: tuple = (), edge_kinds: str = "all", cluster: str | None = None) -> dict[str, DataFrame]:
    """nodes, edges, cycles and the ten projects that block most, as a view of part of the graph."""
    edges = t["edge"] if edge_kinds == "all" else t["edge"].filter("kind = 'project'")
    p = t["project"]
    shown = p.filter(F.col("kind").isin(*include_kinds)) if include_kinds else p
    shown = shown.filter(~F.col("kind").isin(*exclude_kinds)) if exclude_kinds else shown
    shown = shown.select("id")
    if focus is not None:
        own = p.filter(F.col("id") == F.lit(focus)).select("id")
        near = graph.neighbourhood(edges, own, depth, direction)
        shown = shown.join(graph.wide(near), F.col("id") == F.col("node"), "left_semi").unionByName(own).distinct()
    keep = shown.select(F.col("id").alias("s"))
    inside = edges.join(graph.wide(keep), F.col("src") == F.col("s"), "left_semi").join(graph.wide(keep), F.col("dst") == F.col("s"), "left_semi")
    states = graph.readiness(p, used(t)).withColumnRenamed("id", "a")
    key = directory_key(F.col("id")) if cluster == "directory" else F.col("kind") if cluster == "kind" else F.lit(None).cast("string")
    nodes = p.join(graph.wide(keep), F.col("id") == F.col("s"), "left_semi").join(graph.wide(states), F.col("id") == F.col("a")).drop("a").withColumn("cluster", key).orderBy("id")
    blocks = graph.blocked_counts(p, used(t)).withColumnRenamed("n", "blocks")
    top = blocks.join(graph.wide(keep), F.col("blocker") == F.col("s"), "left_semi").orderBy(F.desc("blocks"), "blocker").limit(10)
    return {"nodes": nodes, "edges": inside.orderBy("src", "dst", "kind"), "cycles": shown_cycles(t["edge"], keep, inside), "top_blockers": top}


def shown_cycles(edges: DataFrame, keep: DataFrame, inside: DataFrame) -> DataFrame:
    """(component, members): cycles of the whole graph, cut to the shown projects; one alone stays only with an edge to itself."""
    rows = graph.cycles(edges).select("component", F.explode("members").alias("m")).join(graph.wide(keep), F.col("m") == F.col("s"), "left_semi")
    loops = inside.filter("src = dst").select(F.col("src").alias("l")).distinct()
    rows = rows.join(graph.wide(loops), F.col("m") == F.col("l"), "left")
    cut = rows.groupBy("component").agg(F.array_sort(F.collect_set("m")).alias("members"), F.count("l").alias("n"))
    return cut.filter("size(members) > 1 OR n > 0").select(F.col("members")[0].alias("component"), "members").orderBy("component")


def slice_view(t: dict[str, DataFrame], requested: DataFrame, dependents: bool = False, tests: bool = False) -> DataFrame:
    return graph.slice_closure(t["project"].select("id", "kind"), t["edge"], requested, dependents, tests).orderBy("node")


def report(t: dict[str, DataFrame], snapshots: DataFrame | None = None, solution: str | None = None, created_at: str | None = None, since: str | None = None, shipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """headline, classes, areas, frontier and applications; with snapshots the series, with shipped (id, reason) the libraries.

    snapshots (created_at, solution, file, projects, loc, framework_loc): the model's own point, made at created_at, ends
    the series; change is that of framework lines since the first point. The finished applications (libraries) are
    counted in `done`.
    """
    p = t["project"]
    hosted = p.filter("hosted_by IS NOT NULL").select("id", "hosted_by")
    states = graph.readiness(p, used(t))
    out = {"headline": reports.headline(p), "classes": reports.totals(p), "areas": reports.areas(p), "frontier": states.filter("readiness = 'ready'").orderBy("id")}
    out["applications"] = reports.application_report(p, used(t), hosted, states=states).orderBy("application")
    if shipped is not None:
        out["libraries"] = reports.library_report(p, used(t), shipped, hosted, states).orderBy("project")
    if snapshots is not None:
        now = out["headline"].select(F.lit(created_at).alias("created_at"), F.lit(solution).alias("solution"), "projects", "loc", "framework_loc")
        points = reports.series(snapshots, solution, created_at, since, now).select("created_at", "projects", "loc", "framework_loc")
        out["series"] = reports.change_since_first(points, "created_at", "framework_loc").orderBy("created_at")
    finished = lambda name: out[name].agg(F.lit(name).alias("of"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"))
    out["done"] = finished("applications").unionByName(finished("libraries")) if shipped is not None else finished("applications")
    return out


def audit(uses: DataFrame, rule_table: DataFrame, rule_keys: DataFrame, packs: list[str] | None = None, target: str | None = None, overrides: DataFrame | None = None, weak: str | None = None, strong: tuple = ()) -> dict[str, DataFrame]:
    """Findings of rules over symbol uses (symbol, project, file, line, column, position, namespace), and their summary."""
    force = rules.active(rule_table, packs, target=target, overrides=overrides)
    hits = rules.match(uses.withColumn("keys", rules.symbol_keys(F.col("symbol"))), rule_keys).drop("keys")
    found = hits.join(rules.small(force.withColumnRenamed("rule", "r")), F.col("rule") == F.col("r")).drop("r")
    found = rules.suppress(found, weak, list(strong)) if weak else found
    found = rules.one_per_line(found, ["position", "symbol"]).orderBy("rule", "project", "file", "line", "column", "symbol")
    return {"findings": found, "summary": rules.summary(found), "namespaces": rules.top_namespaces(found)}


def deps_audit(t: dict[str, DataFrame], support: DataFrame, found: DataFrame, replacements: DataFrame, package: str | None = None, project: str | None = None, ignored: tuple = ()) -> DataFrame:
    """(id, status, replacement): support (id, version, supports, empty), replacements (pattern, replacement, whole).

    Ignored packages are left out; with `package`, all others are, and with `project`, versions it doesn't use. Package
    names ignore case.
    """
    usage = t["package_usage"]
    usage = usage.filter(~F.lower("id").isin(*[i.lower() for i in ignored])) if ignored else usage
    usage = usage.filter(F.lower("id") == package.lower()) if package is not None else usage
    usage = usage.filter(F.col("project") == project) if project is not None else usage
    in_use = usage.select("id", "version").distinct().join(support, ["id", "version"], "left")
    known = longest_prefix(in_use.select("id").distinct(), "id", replacements, "pattern", "whole")
    has = known.filter("replacement IS NOT NULL")
    status = versions.audit_status(in_use, found, support, has.select("id"))
    return status.join(known.select("id", "replacement"), "id", "left").orderBy("id")


def deps_gac(references: DataFrame) -> DataFrame:
    """(project, uses, names): framework assemblies that projects refer to; references (project, name, kind)."""
    rows = references.filter("kind = 'framework'")
    return rows.groupBy("project").agg(F.count("name").alias("uses"), F.array_sort(F.collect_set(F.lower("name"))).alias("names")).orderBy("project")


# What may become of a framework assembly.
GAC_KINDS = ["builtin", "package", "compat-pack", "none", "unknown"]


def gac_report(references: DataFrame, mapping: DataFrame, usages: DataFrame, refinements: DataFrame | None = None, types: DataFrame | None = None, project: str | None = None) -> dict[str, DataFrame]:
    """references (project, name, kind, package, usages) with what becomes of each, and a summary of six counts.

    references (project, name, kind), those of kind `framework` are asked; mapping (name, kind, package), names ignore
    case and unmapped ones are `unknown`; usages (project, name, n), null where they weren't measured; an assembly measured
    0 times is unused. refinements (name, place, only, needs, kind, package) change the mapping where a project
    uses some of the assembly's types, all of them are in `only`, and one ends with `needs`, if that is set; the first by
    place counts. types (project, name, types): what is used.
    """
    asked = references.filter("kind = 'framework'").select("project", "name", F.lower("name").alias("__n"))
    asked = asked.filter(F.lower("project") == project.lower()) if project is not None else asked
    told = mapping.groupBy(F.lower("name").alias("__m")).agg(F.min(F.struct("kind", "package")).alias("__as"))
    rows = asked.join(rules.small(told), F.col("__n") == F.col("__m"), "left").drop("__m")
    if refinements is not None and types is not None:
        rows = rows.join(types.select(F.col("project").alias("__p"), F.lower("name").alias("__t"), F.array_distinct("types").alias("__used")), (F.col("project") == F.col("__p")) & (F.col("__n") == F.col("__t")), "left").drop("__p", "__t")
        held = refinements.groupBy(F.lower("name").alias("__r")).agg(F.array_sort(F.collect_list(F.struct("place", "only", "needs", "kind", "package"))).alias("__rs"))
        some = F.coalesce(F.size("__used") > 0, F.lit(False))
        fits = F.filter("__rs", lambda r: (F.size(F.array_except("__used", r["only"])) == 0) & (r["needs"].isNull() | F.exists("__used", lambda u: u.endswith(r["needs"]))))
        better = F.when(some, F.get(fits, F.lit(0)))
        rows = rows.join(rules.small(held), F.col("__n") == F.col("__r"), "left").withColumn("__better", better)
        rows = rows.withColumn("__as", F.when(F.col("__better").isNotNull(), F.struct(F.col("__better.kind").alias("kind"), F.col("__better.package").alias("package"))).otherwise(F.col("__as")))
    counted = usages.select(F.col("project").alias("__p"), F.lower("name").alias("__u"), F.col("n").alias("usages"))
    rows = rows.join(counted, (F.col("project") == F.col("__p")) & (F.col("__n") == F.col("__u")), "left")
    rows = rows.select("project", "name", F.coalesce("__as.kind", F.lit("unknown")).alias("kind"), F.col("__as.package").alias("package"), "usages")
    counts = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in GAC_KINDS]
    return {"references": rows.orderBy("project", F.lower("name"), "name"), "summary": rows.agg(*counts, F.count_if(F.col("usages") == 0).alias("unused"))}


def deps_consolidate(t: dict[str, DataFrame], options: DataFrame, dependencies: DataFrame, support: DataFrame | None = None, families: DataFrame | None = None, pins: DataFrame | None = None, package: str | None = None, family: str | None = None, ignored: tuple = (), newest: bool = False) -> dict[str, DataFrame]:
    """chosen versions with what decided them, conflicts with their chain, constraints of the last round, and pins to report.

    options (id, version) and dependencies (id, version, dep_id, range) come from a feed; support (id, version, tfm) keeps
    options that every framework of a package's projects can use, projects that pin it aside. package or family (a prefix)
    narrow the choice; what shares a family with a package that is chosen for is chosen for as well.
    """
    usage = t["package_usage"]
    usage = usage.filter(~F.lower("id").isin(*[i.lower() for i in ignored])) if ignored else usage
    known = families.filter("family IS NOT NULL").select(F.upper("id").alias("__u"), F.col("family").alias("__family")).distinct() if families is not None else None
    if package is not None or family is not None:
        asked = F.lit(False)
        asked = asked | (F.lower("id") == package.lower()) if package is not None else asked
        asked = asked | F.lower("id").startswith(family.lower()) if family is not None else asked
        ids = usage.filter(asked).select("id").distinct()
        if known is not None:
            near = ids.join(known, F.upper("id") == F.col("__u")).select(F.col("__family").alias("__near")).distinct()
            ids = ids.unionByName(usage.select("id").distinct().join(known.join(near, F.col("__family") == F.col("__near")), F.upper("id") == F.col("__u"), "left_semi")).distinct()
        usage = usage.join(ids.select(F.col("id").alias("__i")), F.col("id") == F.col("__i"), "left_semi")
    ids = usage.select("id").distinct()
    transitive = consolidation.transitive_constraints(ids, t["resolved_package"], t["resolved_dependency"])
    none = usage.select("id", "project", "version").limit(0)
    pins = pins if pins is not None else none
    if support is not None:
        asking = consolidation.without_pinned(usage, pins).select("id", F.col("project").alias("__p"))
        frameworks = t["project"].select(F.col("id").alias("__q"), F.explode("tfms").alias("tfm"))
        options = versions.supports_all(options, asking.join(frameworks, F.col("__p") == F.col("__q")).select("id", "tfm"), support)
    settled = consolidation.settle(consolidation.direct_constraints(usage).unionByName(transitive), options, dependencies, families, pins, not newest)
    return {
        "chosen": consolidation.reasons(settled, not newest).orderBy("id"), "conflicts": consolidation.conflicts(settled.constraints, settled.chosen, ids).orderBy("id"),
        "constraints": settled.constraints.orderBy("id", "kind", "project", "range"), "pins": consolidation.pin_report(pins, transitive, settled.chosen).orderBy("id", "project"),
        "missing": settled.chosen.filter("missing IS NOT NULL").select("id", "family", "missing").orderBy("id"),
    }


def redirects_sync(referenced: DataFrame, deployed: DataFrame, existing: DataFrame, only: list[str] | None = None, prune: bool = False) -> DataFrame:
    rows = versions.redirects(referenced, deployed, existing, prune)
    return (rows.filter(F.col("name").isin(*[n.lower() for n in only])) if only is not None else rows).orderBy("name", "action")


def resolve_dlls(matches: DataFrame) -> DataFrame:
    return versions.best_match(matches).orderBy("file")


def dead_code(declarations: DataFrame, uses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unused declarations with their confidence; evidence (symbol, low_evidence, is_public, shipped, is_action, is_friend)."""
    known = evidence.withColumnRenamed("symbol", "__s")
    flags = [c for c in evidence.columns if c != "symbol"]
    rows = rules.dead_code(declarations, uses).join(known, F.col("symbol") == F.col("__s"), "left").drop("__s")
    return rules.confidence(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})).orderBy("file", "begin", "symbol")


def ifdef_report(regions: DataFrame, symbol: str | None = None) -> DataFrame:
    """Totals of conditional regions (project, file, region, lines, symbol), of one symbol or of all."""
    return reports.directive_totals(regions if symbol is None else regions.filter(F.col("symbol") == symbol))


def seams(type_edges: DataFrame, tainted: DataFrame, sites: DataFrame) -> dict[str, DataFrame]:
    """The cut of each project, and its boundaries by number with their score (`cuts.seams`)."""
    return {"cuts": cuts.project_cuts(type_edges, tainted).select("project", "src", "dst", "members").orderBy("project", "src", "dst"), "seams": cuts.seams(type_edges, tainted, sites).orderBy("project", F.length("seam"), "seam")}


def verify(paths: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(project) to build for changed paths: their owners and what references these directly."""
    folder = F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]*$", "")).otherwise(".")
    found = reports.affected(paths, t["project"].select("id", folder.alias("folder")), t["compile_item"], t["edge"])
    return found.select("project").distinct().orderBy("project")


def verdict(current: DataFrame, known: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """One row: new, known and fixed errors, all codes that the baseline has nowhere, and whether it passes."""
    sides = baseline(current, known, keys)
    fresh = sides.filter("standing = 'new'").select(code).distinct().join(known.select(F.col(code).alias("__c")).distinct(), F.col(code) == F.col("__c"), "left_anti")
    count = lambda s: F.count_if(F.col("standing") == s).alias(s)
    codes = fresh.agg(F.array_sort(F.collect_set(F.col(code).cast("string"))).alias("c"))
    rows = sides.agg(count("new"), count("known"), count("fixed"))
    return rows.withColumns({"new_codes": codes.scalar(), "passes": F.col("new") == 0})


def serializer_scan(facts_: DataFrame, detectors: DataFrame, projects: DataFrame, segments: DataFrame, calls: DataFrame, verdicts: DataFrame, depth: int = 4, severities: DataFrame | None = None, directions: DataFrame | None = None) -> dict[str, DataFrame]:
    """sites with their entry point or why they have none, findings, and a summary of sites and findings by project.

    A site is a fact (shape, name, symbol, project, file, line, column) that a detector (detector, shape, pattern) fits. It
    is a finding for each case of its detector (segments (detector, case, begins, label)) whose label changes from the version
    that its project uses to the target: projects (project, current, target). Findings have one order: detector, project,
    file, line, column, case, symbol. directions (detector, case, direction): cases that no code shows, one
    finding for each project that has a site of that direction. severities (detector, severity): `info` where none is given.
    Entry points as in `fixpoints.entry_points`, with calls (src, dst) and verdicts (node, reason).
    """
    places = ["project", "file", "line", "column", "symbol"]
    extra = ["direction"] if directions is not None else []
    sites = facts.detected(facts_.select("shape", "name", *places, *extra), detectors)
    entry = fixpoints.entry_points(sites.select("symbol").distinct(), calls, verdicts, depth)
    sites = sites.join(entry.select(F.col("start").alias("__s"), "entry", "path", "reason"), F.col("symbol") == F.col("__s"), "left").drop("__s")
    on = gating.gated(projects, segments).select(F.col("project").alias("__p"), F.col("detector").alias("__d"), "case", "was", "becomes")
    shown = ["detector", *places, "case", "was", "becomes", "entry", "path", "reason"]
    found = sites.join(on, (F.col("project") == F.col("__p")) & (F.col("detector") == F.col("__d"))).select(*shown)
    if directions is not None:
        asked = rules.small(directions.select(F.col("detector").alias("__e"), F.col("case").alias("__c"), F.col("direction").alias("__w")))
        here = sites.select(F.col("project").alias("__q"), F.col("direction").alias("__x")).distinct()
        whole = on.join(asked, (F.col("__d") == F.col("__e")) & (F.col("case") == F.col("__c"))).join(here, (F.col("__p") == F.col("__q")) & (F.col("__w") == F.col("__x")), "left_semi")
        kinds = {f.name: f.dataType for f in found.schema}
        none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("file", "line", "column", "symbol")]
        found = found.unionByName(whole.select(F.col("__d").alias("detector"), F.col("__p").alias("project"), *none, "case", "was", "becomes", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("entry", "path", "reason")]))
    if severities is not None:
        found = found.join(rules.small(severities.select(F.col("detector").alias("__d"), "severity")), F.col("detector") == F.col("__d"), "left").drop("__d")
        found = found.withColumn("severity", F.coalesce("severity", F.lit("info")))
    else:
        found = found.withColumn("severity", F.lit("info"))
    n = sites.groupBy("project").agg(F.count(F.lit(1)).alias("sites"))
    hits = found.groupBy(F.col("project").alias("__p")).agg(F.count(F.lit(1)).alias("findings"))
    summary = n.join(hits, F.col("project") == F.col("__p"), "left").select("project", "sites", F.coalesce("findings", F.lit(0)).alias("findings"))
    return {"sites": sites, "findings": found.orderBy("detector", "project", "file", "line", "column", "case", "symbol"), "summary": summary.orderBy("project")}
