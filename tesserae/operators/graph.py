"""Graph operators over edge tables (src, dst): closures, components, readiness, waves, slices, paths.

Two forms of the closure agree. Edge lists of up to `LOCAL_EDGES` rows (the size is checked) travel to every task as
an adjacency, and start nodes are walked in parallel; longer ones go through a semi-naive loop of joins whose rounds
are checkpointed. Readiness, waves and components make no pairs: one pass over the components of a graph within the
bound, values carried along edges in rounds of joins beyond it. Orders and paths (`leaf_first_places`, `ways_round`,
`shortest_path`) have both forms too; lists on the driver (`leaf_first`, `cycle_path`) refuse graphs beyond the bound.

Edges are counted before they travel, and in joins of the second form neither side goes through the driver, unless it
has at most `SENT_ROWS` rows.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import checkpoint_ready

#: Most edges that are sent to tasks or walked on the driver; two ids to an edge.
LOCAL_EDGES = 500_000
#: Most rows of a join's side that are sent to every task, by way of the driver.
SENT_ROWS = 20_000
#: Rounds of a loop whose results are kept apart before they are put together; rounds end by themselves.
APART = 16


def plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def fits(df: DataFrame, limit: int) -> bool:
    """Whether there are at most `limit` rows; they are counted where they are."""
    return df.count() <= limit


def wide(df: DataFrame) -> DataFrame:
    """The frame as a side of a join that shuffles both sides, however small its files look: none goes through the driver."""
    return df.hint("merge")


def sent(df: DataFrame) -> DataFrame:
    """A checkpointed frame as a side of a join: sent to every task if it has few rows of numbers, else shuffled like the other side.

    A table of text keys takes a whole memory page of the driver, up to 64 MB in each round, however few its rows are.
    """
    texts = any(t in ("string", "binary") for _, t in df.dtypes)
    return wide(df) if texts or not fits(df, SENT_ROWS) else F.broadcast(df)


def local_edges(edges: DataFrame, limit: int = LOCAL_EDGES) -> dict | None:
    """The adjacency, neighbours in order; None if there are more edges than the limit, and then none is sent."""
    if not fits(edges, limit):
        return None
    rows = edges.select("src", "dst").toArrow()
    out = defaultdict(list)
    for s, d in sorted(zip(rows["src"].to_pylist(), rows["dst"].to_pylist())):
        out[s].append(d)
    return dict(out)


def gathered(parts: list[DataFrame]) -> DataFrame:
    """All parts as one; from time to time they are put together, so that neither plans nor rewriting grow with the rounds."""
    if len(parts) > APART:
        parts[:] = [reduce(DataFrame.unionByName, parts).checkpoint()]
    return reduce(DataFrame.unionByName, parts)


def walk(start, adjacency: dict, depth: int | None = None) -> list:
    """Nodes within `depth` steps, start first, in the order of a breadth-first search."""
    seen, level = {start: None}, [start]
    while level and (depth is None or depth > 0):
        level = [n for m in level for n in adjacency.get(m, ()) if n not in seen and not seen.setdefault(n)]
        depth = None if depth is None else depth - 1
    return list(seen)


def ids_with_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def closure(edges: DataFrame, starts: DataFrame | None = None, depth: int | None = None, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(src, dst) for every dst that src reaches within `depth` steps; a start is not in its own reach.

    starts: a one-column frame; by default every node with an edge.
    """
    edges = plain(edges)
    starts = (starts.select(F.col(starts.columns[0]).alias("src")) if starts is not None else edges.select("src")).distinct()
    adjacency = local_edges(edges, local_limit)
    if adjacency is None:
        return closure_by_joins(edges, starts, depth)
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for s in batch.column(0).to_pylist():
                reached = walk(s, adjacency, depth)[1:]
                src += [s] * len(reached)
                dst += reached
                if len(src) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(src, batch.column(0).type), pa.array(dst, batch.column(0).type)], ["src", "dst"])
                    src, dst = [], []
            yield pa.RecordBatch.from_arrays([pa.array(src, batch.column(0).type), pa.array(dst, batch.column(0).type)], ["src", "dst"])

    return starts.mapInArrow(run, f"src {kind}, dst {kind}")


def closure_by_joins(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """The same for graphs of any size: starts travel in words of 64, so that no pair is shuffled or kept."""
    from tesserae.operators.reach import ids_of, pairs_by_joins

    edges = plain(edges)
    return pairs_by_joins(edges, ids_of(starts, edges), depth)


def with_starts(reach: DataFrame, starts: DataFrame) -> DataFrame:
    """Reach pairs with each start in its own reach, as slices and applications count it."""
    own = starts.select(F.col(starts.columns[0]).alias("src"))
    return reach.unionByName(own.select("src", F.col("src").alias("dst"))).distinct()


def reached_set(edges: DataFrame, seeds: DataFrame, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node) of all that any seed reaches, seeds included: one walk for all seeds together."""
    edges, seeds = plain(edges), seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    adjacency = local_edges(edges, local_limit)
    if adjacency is not None and seeds.count() <= local_limit:
        seen = {r["node"] for r in seeds.collect()}
        todo = deque(seen)
        while todo:
            for n in adjacency.get(todo.popleft(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seeds.sparkSession.createDataFrame([(x,) for x in sorted(seen)], seeds.schema)
    checkpoint_ready(edges.sparkSession)
    steps = edges.select(F.col("src").alias("mid"), F.col("dst").alias("to")).checkpoint()
    new = seeds.checkpoint()
    parts = [new]
    while not new.isEmpty():
        found = steps.join(sent(new), F.col("node") == F.col("mid")).select(F.col("to").alias("node")).distinct()
        new = found.join(wide(gathered(parts).select(F.col("node").alias("known"))), F.col("node") == F.col("known"), "left_anti").checkpoint()
        parts.append(new)
    return gathered(parts)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def scc(edges: DataFrame, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): nodes that reach each other share their least node; single nodes are left out. No pairs are made."""
    edges = plain(edges).filter("src != dst")
    adjacency = local_edges(edges, local_limit)
    if adjacency is None:
        return scc_by_colours(edges)
    of = local_components(adjacency, set(adjacency))
    size = Counter(of.values())
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(n, c) for n, c in of.items() if size[c] > 1], f"node {kind}, component {kind}")


def spread(edges: DataFrame, state: DataFrame, least: list[str], most: list[str]) -> DataFrame:
    """State (node, ...) with each value carried along edges (src, dst) to every node that src reaches, the least or the most of all.

    Semi-naive: only nodes whose values got better send them on; a node's rows are aggregated before the shuffle.
    """
    checkpoint_ready(edges.sparkSession)
    names = least + most
    steps = edges.select(F.col("src").alias("mid"), F.col("dst").alias("to")).checkpoint()
    merge = lambda df: df.groupBy("node").agg(*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    state = merge(state).checkpoint()
    new = state
    while not new.isEmpty():
        come = merge(steps.join(sent(new), F.col("node") == F.col("mid")).select(F.col("to").alias("node"), *names))
        old = state.select(F.col("node").alias("__o"), *[F.col(c).alias(f"__o_{c}") for c in names])
        better = [F.col(f"__o_{c}").isNull() | ((F.col(c) < F.col(f"__o_{c}")) if c in least else (F.col(c) > F.col(f"__o_{c}"))) for c in names]
        new = come.join(wide(old), F.col("node") == F.col("__o"), "left").filter(reduce(lambda x, y: x | y, better)).select("node", *names).checkpoint()
        state = merge(state.unionByName(new)).checkpoint()
    return state


def scc_by_colours(edges: DataFrame) -> DataFrame:
    """Components by trimming and colours, for graphs of any size.

    Nodes without a way in or out are on no cycle and go. The rest take the least node that reaches them as colour; the
    nodes of a colour that reach its own node are one component, which goes too; edges between colours go with it.
    """
    checkpoint_ready(edges.sparkSession)
    rest, parts, n = edges.checkpoint(), [edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)], -1
    while True:
        while (now := rest.count()) != n:
            n = now
            ends, begins = rest.select(F.col("dst").alias("e")).distinct(), rest.select(F.col("src").alias("b")).distinct()
            rest = rest.join(wide(ends), F.col("src") == F.col("e"), "left_semi").join(wide(begins), F.col("dst") == F.col("b"), "left_semi").checkpoint()
        if not n:
            return gathered(parts)
        nodes = rest.select(F.col("src").alias("node")).distinct()
        colour = spread(rest, nodes.withColumn("c", F.col("node")), ["c"], [])
        one, two = (colour.select(F.col("node").alias(f"n{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
        inner = rest.join(wide(one), F.col("src") == F.col("n1")).join(wide(two), F.col("dst") == F.col("n2")).filter("c1 = c2").select("src", "dst").checkpoint()
        found = reached_set(reverse(inner), colour.filter("node = c").select("node"), 0).join(wide(colour.select(F.col("node").alias("m"), F.col("c").alias("component"))), F.col("node") == F.col("m")).select("node", "component").checkpoint()
        alone = found.groupBy(F.col("component").alias("a")).count().filter("count = 1").select("a")
        parts.append(found.join(wide(alone), F.col("component") == F.col("a"), "left_anti"))
        gone = found.select(F.col("node").alias("g"))
        rest, n = inner.join(wide(gone), F.col("src") == F.col("g"), "left_anti").join(wide(gone), F.col("dst") == F.col("g"), "left_anti").checkpoint(), -1


def cycles(edges: DataFrame) -> DataFrame:
    """(component, members): components of more than one node, and nodes with an edge to themselves."""
    many = scc(edges)
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    alone = loops.join(wide(many.select(F.col("node").alias("n"))), F.col("node") == F.col("n"), "left_anti")
    return many.unionByName(alone).groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members")).orderBy("component")


def derive_edges(references: DataFrame, hints: DataFrame, projects: DataFrame) -> DataFrame:
    """Project references to known ids, and file references whose stem names the assembly of just one project.

    references (project, target), hints (project, stem), projects (id, assembly_name): assembly names ignore case,
    a name of several projects resolves to none, and a project's own output is no edge.
    """
    known = projects.select(F.col("id").alias("k"))
    direct = references.join(known, F.col("target") == F.col("k"), "left_semi").select(F.col("project").alias("src"), F.col("target").alias("dst"), F.lit("project").alias("kind"))
    owners = projects.groupBy(F.lower("assembly_name").alias("name")).agg(F.min("id").alias("owner"), F.count("id").alias("n")).filter("n = 1").drop("n")
    through = hints.join(owners, F.lower("stem") == F.col("name")).filter("owner != project").select(F.col("project").alias("src"), F.col("owner").alias("dst"), F.lit("assembly").alias("kind"))
    return direct.unionByName(through).distinct().orderBy("src", "dst", "kind")


def used_edges(edges: DataFrame, modern_lists: DataFrame, modern_refs: DataFrame) -> DataFrame:
    """Edges without the project references of a dual project that its modern targets don't use.

    modern_lists (project): projects that have such a list, even an empty one; modern_refs (project, target).
    """
    listed = edges.join(wide(modern_lists.select(F.col("project").alias("p")).distinct()), F.col("src") == F.col("p"), "left").join(
        wide(modern_refs.select(F.col("project").alias("q"), F.col("target").alias("t")).distinct()), (F.col("src") == F.col("q")) & (F.col("dst") == F.col("t")), "left"
    )
    return listed.filter("kind != 'project' OR p IS NULL OR q IS NOT NULL").drop("p", "q", "t")


def blockers(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, blocker): framework-only projects among all that a project depends on; only what these are needed by is walked."""
    framework = projects.filter("framework_class = 'framework'").select("id")
    known = projects.select(F.col("id").alias("__i"))
    return closure(reverse(edges), framework).join(wide(known), F.col("dst") == F.col("__i"), "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("blocker"))


def blocked_counts(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """(blocker, n): how many projects each framework-only project blocks, without a row for each pair."""
    from tesserae.operators.reach import reach_counts

    framework = projects.filter("framework_class = 'framework'").select("id")
    return reach_counts(reverse(edges), framework, projects.select("id")).filter("n > 0").withColumnRenamed("node", "blocker")


def readiness(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, readiness): blocked by a framework-only dependency, else ready if itself framework-only, else done."""
    return standings(projects, edges, waves=False).select("id", "readiness")


def standings(projects: DataFrame, edges: DataFrame, whole: DataFrame | None = None, local_limit: int = LOCAL_EDGES, groups: DataFrame | None = None, waves: bool = True) -> DataFrame:
    """(id, readiness, wave), in time that grows with the edges: no pairs of projects are made.

    A project is blocked if the least or the most framework-only project that it reaches is another one. Its wave is 0
    if it is done, else one more than the latest wave among framework-only projects that it reaches outside its own
    cycle; cycles are those of `whole`, by default of the edges themselves.

    groups: the components of `whole` as `scc` gives them, if they are known. Without `waves` that column may be missing.
    """
    whole = edges if whole is None else whole
    used, every = local_edges(plain(edges), local_limit), local_edges(plain(whole), local_limit)
    if used is None or every is None or not fits(projects, local_limit):
        return standings_by_joins(projects, plain(edges), whole, groups, waves)
    rows = projects.select("id", "framework_class").toArrow()
    ids = rows["id"].to_pylist()
    framework = {i for i, c in zip(ids, rows["framework_class"].to_pylist()) if c == "framework"}
    kind = projects.schema["id"].dataType.simpleString()
    found = local_standings(ids, framework, used, local_components(every, set(every)))
    return projects.sparkSession.createDataFrame(found, f"id {kind}, readiness string, wave int")


def local_standings(ids: list, framework: set, used: dict, cycle: dict) -> list[tuple]:
    """One pass over the components of the used edges, what is needed first."""
    of = local_components(used, set(used) | set(ids))
    groups: dict = {}
    for n, c in of.items():
        groups.setdefault(c, []).append(n)
    of_cycle = lambda n: cycle.get(n, n)
    # by component: least and most framework-only project reached by an edge or more; latest waves reached beyond the own cycle, and in all
    reach, beyond, within, state, wave = {}, {}, {}, {}, {}
    for c in reversed(groups):
        members = groups[c]
        seen, far, near = [], 0, 0
        for n in members:
            for k in used.get(n, ()):
                if k in framework:
                    seen.append(k)
                if of[k] == c:
                    continue
                seen += reach[of[k]]
                if of_cycle(k) == of_cycle(n):
                    far, near = max(far, beyond[of[k]]), max(near, within[of[k]])
                else:
                    far = max(far, within[of[k]])
        reach[c], beyond[c] = ((min(seen), max(seen)) if seen else ()), far
        for n in members:
            blocked = any(k != n for k in reach[c])
            state[n] = "blocked" if blocked else "ready" if n in framework else "done"
            wave[n] = 0 if state[n] == "done" else 1 + far
        within[c] = max([far, near, *(wave[n] for n in members if n in framework)])
    return [(i, state[i], wave[i]) for i in ids]


def standings_by_joins(projects: DataFrame, edges: DataFrame, whole: DataFrame, groups: DataFrame | None = None, waves: bool = True) -> DataFrame:
    """The same for graphs of any size: values are carried against the edges until none gets better."""
    checkpoint_ready(projects.sparkSession)
    back = reverse(edges).checkpoint()
    p = projects.select("id", (F.col("framework_class") == "framework").alias("fw")).checkpoint()
    fw = p.filter("fw").select(F.col("id").alias("f"))
    first = back.join(wide(fw), F.col("src") == F.col("f")).select(F.col("dst").alias("node"), F.col("src").alias("lo"), F.col("src").alias("hi"))
    met = spread(back, first, ["lo"], ["hi"])
    rows = p.join(wide(met), F.col("id") == F.col("node"), "left")
    blocked = F.coalesce((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id")), F.lit(False))
    states = rows.select("id", "fw", F.when(blocked, "blocked").when(F.col("fw"), "ready").otherwise("done").alias("readiness")).checkpoint()
    if not waves:
        return states.select("id", "readiness")
    groups = scc(whole).checkpoint() if groups is None else groups
    one, two = (groups.select(F.col("node").alias(f"n{k}"), F.col("component").alias(f"c{k}")) for k in (1, 2))
    ways = back.join(wide(one), F.col("src") == F.col("n1"), "left").join(wide(two), F.col("dst") == F.col("n2"), "left")
    ways = ways.select("src", "dst", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)).alias("same")).checkpoint()
    facts = states.select(F.col("id").alias("i"), (F.col("fw") & (F.col("readiness") != "done")).alias("counts"))
    # far: latest wave reached beyond the own cycle; within: latest in all, the project itself included
    state = p.join(wide(facts), F.col("id") == F.col("i")).select(F.col("id").alias("node"), "counts", F.lit(0).alias("far"), F.when(F.col("counts"), 1).otherwise(0).alias("within")).checkpoint()
    new = state.filter("within > 0").checkpoint()
    while not new.isEmpty():
        come = ways.join(sent(new), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(
            F.max(F.when(F.col("same"), F.col("far")).otherwise(F.col("within"))).alias("f"), F.max(F.when(F.col("same"), F.col("within"))).alias("w")
        )
        far = F.greatest("far", F.coalesce("f", F.lit(0)))
        within = F.greatest("within", F.coalesce("w", F.lit(0)), far, F.when(F.col("counts"), far + 1).otherwise(0))
        after = state.join(wide(come), F.col("node") == F.col("to"), "left").select("node", "counts", far.alias("far"), within.alias("within"), (far > F.col("far")).alias("a"), (within > F.col("within")).alias("b")).checkpoint()
        new, state = after.filter("a OR b").select("node", "counts", "far", "within").checkpoint(), after.select("node", "counts", "far", "within")
    waves_ = state.select("node", "far")
    wave = F.when(F.col("readiness") == "done", 0).otherwise(F.col("far") + 1).cast("int")
    return states.join(wide(waves_), F.col("id") == F.col("node")).select("id", "readiness", wave.alias("wave"))


def framework_references(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from a project that is not framework-only to one that is."""
    a = projects.filter("framework_class != 'framework'").select(F.col("id").alias("a"))
    b = projects.filter("framework_class = 'framework'").select(F.col("id").alias("b"))
    return edges.join(a, F.col("src") == F.col("a"), "left_semi").join(b, F.col("dst") == F.col("b"), "left_semi")


def waves(projects: DataFrame, edges: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(id, wave): 0 if done, else one more than the latest wave among blockers outside the project's own cycle in `whole`."""
    return standings(projects, edges, whole).select("id", "wave")


def plan(projects: DataFrame, edges: DataFrame, used: DataFrame | None = None, only_for=None, frontier: bool = False, exclude_kinds: tuple = (), hosted: DataFrame | None = None) -> DataFrame:
    """The listing: numbers come from the whole graph, filters only narrow the rows."""
    used = edges if used is None else used
    from tesserae.operators.reach import reach_counts, reach_lists

    checkpoint_ready(projects.sparkSession)
    radius = reach_counts(reverse(edges)).withColumnRenamed("node", "r")
    groups = scc(edges).checkpoint()
    rows = projects.join(wide(standings(projects, used, edges, groups=groups).withColumnRenamed("id", "a")), F.col("id") == F.col("a")).drop("a")
    rows = rows.join(wide(radius), F.col("id") == F.col("r"), "left").withColumn("blast_radius", F.coalesce("n", F.lit(0))).drop("r", "n")
    found = reach_lists(used, projects.filter("framework_class = 'framework'").select("id")).select(F.col("node").alias("a"), F.col("reached").alias("blockers"))
    rows = rows.join(wide(found), F.col("id") == F.col("a"), "left").drop("a")
    member = groups.select(F.col("node").alias("a"), F.lit(True).alias("in_cycle"))
    rows = rows.join(wide(member), F.col("id") == F.col("a"), "left").drop("a").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    if only_for is not None:
        near = application_closure(edges, hosted, only_for) if hosted is not None else reached_set(edges, projects.filter(F.col("id") == F.lit(only_for)).select("id"))
        rows = rows.join(wide(near.withColumnRenamed("node", "a")), F.col("id") == F.col("a"), "left_semi").filter("readiness != 'done'")
    if frontier:
        rows = rows.filter("readiness = 'ready'")
    if exclude_kinds:
        rows = rows.filter(~F.col("kind").isin(*exclude_kinds))
    return rows.orderBy("wave", F.desc("blast_radius"), "id")


def plan_counts(listing: DataFrame) -> DataFrame:
    """One row: projects and how many are done, ready and blocked, and the last wave (0 for an empty plan)."""
    states = {s: F.count_if(F.col("readiness") == s).alias(s) for s in ("done", "ready", "blocked")}
    return listing.agg(F.count("id").alias("projects"), *states.values(), F.coalesce(F.max("wave"), F.lit(0)).alias("waves"))


def neighbourhood(edges: DataFrame, focus: DataFrame, depth: int | None, direction: str = "both") -> DataFrame:
    """(node) within depth of the focus nodes, themselves included."""
    own = focus.select(F.col(focus.columns[0]).alias("node"))
    out = own
    if direction != "dependents":
        out = out.unionByName(closure(edges, own, depth).select(F.col("dst").alias("node")))
    if direction != "dependencies":
        out = out.unionByName(closure(reverse(edges), own, depth).select(F.col("dst").alias("node")))
    return out.distinct()


def hosted_projects(hosted: DataFrame) -> DataFrame:
    """(src, dst): what each host hosts, directly or through what it hosts. hosted (id, hosted_by)."""
    return closure(hosted.filter("hosted_by IS NOT NULL").select(F.col("hosted_by").alias("src"), F.col("id").alias("dst")))


def application_closure(edges: DataFrame, hosted: DataFrame, start) -> DataFrame:
    """(node): the start, what it hosts, and what these depend on; hosts reached on the way bring nothing."""
    link = hosted.filter("hosted_by IS NOT NULL").select(F.col("hosted_by").alias("src"), F.col("id").alias("dst"))
    seed = edges.sparkSession.createDataFrame([(start,)], ["node"]).select(F.col("node").cast(edges.schema["src"].dataType).alias("node"))
    return reached_set(edges, reached_set(link, seed))


def slice_closure(projects: DataFrame, edges: DataFrame, requested: DataFrame, dependents: bool = False, tests: bool = False, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node): the requested projects and their dependencies; dependents and tests with a direct reference bring theirs."""
    adjacency = local_edges(plain(edges), local_limit)
    if adjacency is not None:
        ask = requested.select(F.col(requested.columns[0]).alias("node")).distinct()
        test = projects.filter("kind = 'test'").select("id")
        if fits(ask, local_limit) and (not tests or fits(test, local_limit)):
            asked, known = ask.collect(), test.collect() if tests else []
            found = sorted(local_slice(adjacency, {r[0] for r in asked}, dependents, {r[0] for r in known}))
            return edges.sparkSession.createDataFrame([(n,) for n in found], f"node {edges.schema['src'].dataType.simpleString()}")
    closed = reached_set(edges, requested, local_limit)
    if dependents:
        up = reached_set(reverse(edges), requested, local_limit).join(wide(closed.withColumnRenamed("node", "c")), F.col("node") == F.col("c"), "left_anti")
        closed = closed.unionByName(reached_set(edges, up, local_limit)).distinct()
    if tests:
        inside = closed.withColumnRenamed("node", "c")
        direct = edges.join(wide(inside), F.col("dst") == F.col("c"), "left_semi").select(F.col("src").alias("node")).distinct()
        found = direct.join(wide(projects.filter("kind = 'test'").select("id")), F.col("node") == F.col("id"), "left_semi").join(wide(inside), F.col("node") == F.col("c"), "left_anti")
        closed = closed.unionByName(reached_set(edges, found, local_limit)).distinct()
    return closed


def local_slice(adjacency: dict, requested: set, dependents: bool, tests: set) -> set:
    """The slice over one adjacency: each node is walked once each way."""
    closed = walked(adjacency, requested, set())
    if dependents:
        back = defaultdict(list)
        for s, ds in adjacency.items():
            for d in ds:
                back[d].append(s)
        walked(adjacency, walked(back, requested, set()), closed)
    return walked(adjacency, {t for t in tests if closed.intersection(adjacency.get(t, ()))}, closed)


def walked(adjacency: dict, seeds: set, seen: set) -> set:
    """seen with all that the seeds reach, seeds included; what was seen before is not entered again."""
    todo = [s for s in seeds if s not in seen]
    seen.update(todo)
    while todo:
        for n in adjacency.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def least_label(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, label): the least of the seeds that reach a node; a seed reaches itself. No pairs are made."""
    from tesserae.operators.reach import carried

    own = F.col(seeds.columns[0])
    return carried(edges, seeds.select(own.alias("node"), own.alias("label")))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest chain below a node of an acyclic graph; an order by (level, node) is leaf first."""
    checkpoint_ready(edges.sparkSession)
    rest = plain(edges).checkpoint()
    open_ = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct().checkpoint()
    out, level = None, 0
    while not open_.isEmpty():
        waiting = rest.select(F.col("src").alias("w")).distinct()
        now = open_.join(waiting, F.col("node") == F.col("w"), "left_anti").checkpoint()
        if now.isEmpty():
            raise ValueError("the graph has a cycle")
        part = now.select("node", F.lit(level).alias("level"))
        out = part if out is None else out.unionByName(part)
        done = now.select(F.col("node").alias("d"))
        rest = rest.join(done, F.col("dst") == F.col("d"), "left_anti").checkpoint()
        open_ = open_.join(done, F.col("node") == F.col("d"), "left_anti").checkpoint()
        level += 1
    return out if out is not None else edges.select(F.col("src").alias("node"), F.lit(0).alias("level")).limit(0)


# ---- sequential, bounded


def bounded(edges: DataFrame) -> dict:
    adjacency = local_edges(plain(edges))
    if adjacency is None:
        raise ValueError(f"more than {LOCAL_EDGES} edges: this order is sequential")
    return adjacency


def local_components(adjacency: dict, nodes) -> dict:
    """node -> least node of its strongly connected component: two passes of depth-first search."""
    order, seen = [], set()
    for root in sorted(nodes):
        stack = [] if root in seen else [(root, iter(adjacency.get(root, ())))]
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(adjacency.get(n, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
    back = defaultdict(list)
    for s, ds in adjacency.items():
        for d in ds:
            back[d].append(s)
    of = {}
    for root in reversed(order):
        if root not in of:
            group, todo = [], [root]
            of[root] = root
            while todo:
                x = todo.pop()
                group.append(x)
                for n in back[x]:
                    if n not in of:
                        of[n] = root
                        todo.append(n)
            least = min(group)
            of.update(dict.fromkeys(group, least))
    return of


def leaf_first(edges: DataFrame, nodes: DataFrame) -> list:
    """Every project after what it needs; among those ready, the component with the least first member is next."""
    adjacency = bounded(edges)
    return local_order(adjacency, {r[0] for r in nodes.select(nodes.columns[0]).collect()} | set(adjacency) | {d for ds in adjacency.values() for d in ds})


def local_order(adjacency: dict, names: set) -> list:
    of = local_components(adjacency, names)
    needs, users = defaultdict(set), defaultdict(set)
    for s, ds in adjacency.items():
        for d in ds:
            if of[s] != of[d]:
                needs[of[s]].add(of[d])
                users[of[d]].add(of[s])
    members = defaultdict(list)
    for n in sorted(names):
        members[of[n]].append(n)
    ready = [c for c in members if not needs[c]]
    heapq.heapify(ready)
    out = []
    while ready:
        c = heapq.heappop(ready)
        out += members[c]
        for u in users[c]:
            needs[u].discard(c)
            if not needs[u]:
                heapq.heappush(ready, u)
    return out


def leaf_first_places(edges: DataFrame, nodes: DataFrame, local_limit: int = LOCAL_EDGES) -> DataFrame:
    """(node, place): the order of `leaf_first`, places from 0, for graphs of any size.

    By joins: let m be the greatest of a component and all that it needs. What has an m below another's comes first, m
    itself before all others of its m, and these follow by the same rule among themselves. So the values of m, one a turn,
    are a key whose order is the order asked for; a turn carries them along what is left of the needs.
    """
    edges = plain(edges)
    kind = edges.schema["src"].dataType.simpleString()
    names = ids_with_edges(edges).unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node IS NOT NULL")).distinct()
    adjacency = local_edges(edges, local_limit)
    if adjacency is not None and fits(names, local_limit):
        order = local_order(adjacency, set(names.toArrow().column(0).to_pylist()))
        return edges.sparkSession.createDataFrame([(n, k) for k, n in enumerate(order)], f"node {kind}, place long")
    from tesserae.operators.relational import numbered

    checkpoint_ready(edges.sparkSession)
    of = scc(edges, local_limit).select(F.col("node").alias("n"), "component").checkpoint()
    rows = names.join(sent(of), F.col("node") == F.col("n"), "left").select("node", F.coalesce("component", "node").alias("c")).checkpoint()
    a, b = (rows.select(F.col("node").alias(f"n{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    needs = edges.join(wide(a), F.col("src") == F.col("n1")).join(wide(b), F.col("dst") == F.col("n2")).filter("c1 != c2")
    needs = needs.select(F.col("c2").alias("src"), F.col("c1").alias("dst")).distinct().checkpoint()
    left, parts = rows.select(F.col("c").alias("node")).distinct().withColumn("key", F.array().cast(f"array<{kind}>")).checkpoint(), []
    while not left.isEmpty():
        top = spread(needs, left.select("node", F.col("node").alias("m")), [], ["m"]).withColumnRenamed("node", "t")
        now = left.join(wide(top), F.col("node") == F.col("t")).select("node", F.concat("key", F.array("m")).alias("key"), "m").checkpoint()
        parts.append(now.filter("m = node").select("node", "key"))
        left = now.filter("m != node")
        a, b = (left.select(F.col("node").alias(f"n{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
        needs = needs.join(wide(a), F.col("src") == F.col("n1")).join(wide(b), F.col("dst") == F.col("n2")).filter("m1 = m2").select("src", "dst").checkpoint()
        left = left.drop("m")
    keys = gathered(parts).withColumnRenamed("node", "k") if parts else left.withColumnRenamed("node", "k")
    return numbered(rows.join(wide(keys), F.col("c") == F.col("k")).select("node", "key"), [F.col("key"), F.col("node")], "place", 0).select("node", "place")


def cycle_path(edges: DataFrame, members: list) -> list:
    """A readable way round a cycle from its first member and back, by sorted depth-first search; else the members and the first again."""
    return way_round(bounded(edges), members)


def way_round(edges: dict, members: list) -> list:
    inside, start = set(members), min(members)
    adjacency = {s: [d for d in edges.get(s, ()) if d in inside] for s in inside}
    path, seen, stack = [start], {start}, [iter(adjacency.get(start, ()))]
    while stack:
        for n in stack[-1]:
            if n == start:
                return [*path, start]
            if n not in seen:
                seen.add(n)
                path.append(n)
                stack.append(iter(adjacency.get(n, ())))
                break
        else:
            stack.pop()
            path.pop()
    return [*sorted(members), start]


def ways_round(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(component, path): the way of `cycle_path` round each of `cycles`, from its least member and back.

    groups: the components as `scc` gives them, if they are known. A component's inner edges are one group; one with more than LOCAL_EDGES edges is refused, as that search is sequential.
    """
    edges = plain(edges)
    kind = edges.schema["src"].dataType.simpleString()
    checkpoint_ready(edges.sparkSession)
    of = (scc(edges) if groups is None else groups).checkpoint()
    a, b = (of.select(F.col("node").alias(f"n{k}"), F.col("component").alias(f"c{k}")) for k in (1, 2))
    inner = edges.join(sent(a), F.col("src") == F.col("n1")).join(sent(b), F.col("dst") == F.col("n2")).filter("c1 = c2").select(F.col("c1").alias("component"), "src", "dst")

    def way(rows: pa.Table) -> pa.Table:
        if rows.num_rows > LOCAL_EDGES:
            raise ValueError(f"a cycle of more than {LOCAL_EDGES} edges: a way round it is sequential")
        adjacency = defaultdict(list)
        for s, d in sorted(zip(rows["src"].to_pylist(), rows["dst"].to_pylist())):
            adjacency[s].append(d)
        path = pa.array([way_round(adjacency, list(adjacency))], pa.list_(rows["src"].type))
        return pa.table([rows["component"].slice(0, 1), path], ["component", "path"])

    alone = edges.filter("src = dst").join(sent(of.select(F.col("node").alias("n"))), F.col("src") == F.col("n"), "left_anti")
    ways = inner.groupBy("component").applyInArrow(way, f"component {kind}, path array<{kind}>")
    return ways.unionByName(alone.select(F.col("src").alias("component"), F.array("src", "src").alias("path")))


def shortest_path(edges: DataFrame, start, goal, local_limit: int = LOCAL_EDGES) -> list | None:
    """Breadth first, neighbours in order; None if there is no way."""
    adjacency = local_edges(plain(edges), local_limit)
    if adjacency is None:
        return shortest_path_by_joins(edges, start, goal)
    before, todo = {start: None}, deque([start])
    while todo:
        node = todo.popleft()
        if node == goal:
            path = []
            while node is not None:
                path.append(node)
                node = before[node]
            return path[::-1]
        for n in adjacency.get(node, ()):
            if n not in before:
                before[n] = node
                todo.append(n)
    return None


def shortest_path_by_joins(edges: DataFrame, start, goal) -> list | None:
    """Levels from the start until the goal is met, then back over them: of a node's ways on, the one over its least neighbour."""
    checkpoint_ready(edges.sparkSession)
    steps, kind = plain(edges).checkpoint(), edges.schema["src"].dataType.simpleString()
    one = edges.sparkSession.range(1)
    new = one.select(F.lit(start).cast(kind).alias("node")).checkpoint()
    levels, known = [new], [new]
    while new.filter(F.col("node") == F.lit(goal)).isEmpty():
        found = steps.join(sent(new), F.col("src") == F.col("node")).select("dst").distinct()
        new = found.join(wide(gathered(known)), F.col("dst") == F.col("node"), "left_anti").select(F.col("dst").alias("node")).checkpoint()
        if new.isEmpty():
            return None
        levels.append(new)
        known.append(new)
    ways = one.select(F.lit(goal).cast(kind).alias("node"), F.array(F.lit(goal).cast(kind)).alias("path")).checkpoint()
    for level in reversed(levels[:-1]):
        step = steps.join(sent(ways), F.col("dst") == F.col("node")).select("src", "dst", "path").join(sent(level), F.col("src") == F.col("node"), "left_semi")
        ways = step.groupBy("src").agg(F.min_by("path", "dst").alias("path")).select(F.col("src").alias("node"), F.concat(F.array("src"), "path").alias("path")).checkpoint()
    return ways.first()["path"]


def distances(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, distance) from the nearest start, by levels; for graphs of any size."""
    checkpoint_ready(edges.sparkSession)
    steps = plain(edges).select(F.col("src").alias("mid"), F.col("dst").alias("to")).checkpoint()
    new = starts.select(F.col(starts.columns[0]).alias("node")).distinct().withColumn("distance", F.lit(0)).checkpoint()
    parts, level = [new], 0
    while not new.isEmpty():
        level += 1
        found = steps.join(sent(new), F.col("node") == F.col("mid")).select(F.col("to").alias("node")).distinct().withColumn("distance", F.lit(level))
        new = found.join(wide(gathered(parts).select(F.col("node").alias("known"))), F.col("node") == F.col("known"), "left_anti").checkpoint()
        parts.append(new)
    return gathered(parts)
