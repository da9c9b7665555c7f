"""Graph operators on hand-made models: migration waves, leaf-first order, cycles, slices, cuts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cuts, fixpoints, graph, reach

# Fixed values, a model with a known plan. Ten projects: Contracts (standard) <- Core <- Data <- Web and Data.Tests; Core <- Tool; Contracts <- Api (dual); A <-> B <- Report.
TEN = [
    ("lib/Contracts/Contracts.csproj", "standard", "library", []),
    ("src/Core/Core.csproj", "framework", "library", ["lib/Contracts/Contracts.csproj"]),
    ("src/Data/Data.csproj", "framework", "library", ["src/Core/Core.csproj"]),
    ("src/Web/Web.csproj", "framework", "web", ["src/Data/Data.csproj"]),
    ("src/Tool/Tool.csproj", "framework", "console", ["src/Core/Core.csproj"]),
    ("src/Api/Api.csproj", "dual", "web", ["lib/Contracts/Contracts.csproj"]),
    ("legacy/A/A.csproj", "framework", "library", ["legacy/B/B.csproj"]),
    ("legacy/B/B.csproj", "framework", "library", ["legacy/A/A.csproj"]),
    ("src/Report/Report.csproj", "framework", "library", ["legacy/A/A.csproj"]),
    ("tests/Data.Tests/Data.Tests.csproj", "framework", "test", ["src/Data/Data.csproj"]),
]


def model(spark, shuffle=False):
    rows = list(TEN)
    if shuffle:
        random.Random(3).shuffle(rows)
    projects = spark.createDataFrame([(i, c, k) for i, c, k, _ in rows], "id string, framework_class string, kind string")
    edges = spark.createDataFrame([(i, r, "project") for i, _, _, rs in rows for r in rs], "src string, dst string, kind string")
    return projects, edges


def edges_of(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


@pytest.mark.parametrize("shuffle", [False, True])
def test_plan_of_ten(spark, shuffle):
    projects, edges = model(spark, shuffle)
    rows = graph.plan(projects.repartition(3), edges.repartition(2)).collect()
    assert [(r["id"].rsplit("/", 1)[1], r["wave"]) for r in rows] == [
        ("Contracts.csproj", 0), ("Api.csproj", 0), ("Core.csproj", 1), ("A.csproj", 1), ("B.csproj", 1), ("Data.csproj", 2), ("Report.csproj", 2), ("Tool.csproj", 2), ("Web.csproj", 3), ("Data.Tests.csproj", 3),
    ]
    by = {r["id"]: r for r in rows}
    assert by["lib/Contracts/Contracts.csproj"]["blast_radius"] == 6 and by["src/Core/Core.csproj"]["blast_radius"] == 4
    assert by["src/Web/Web.csproj"]["blockers"] == ["src/Core/Core.csproj", "src/Data/Data.csproj"]
    assert by["legacy/A/A.csproj"]["readiness"] == "blocked" and by["legacy/B/B.csproj"]["in_cycle"] and not by["src/Report/Report.csproj"]["in_cycle"]


def test_plan_counts_and_filters(spark):
    projects, edges = model(spark)
    assert tuple(graph.plan_counts(graph.plan(projects, edges)).first()) == (10, 2, 1, 7, 3)
    frontier = graph.plan(projects, edges, frontier=True).collect()
    assert [(r["id"], r["blast_radius"]) for r in frontier] == [("src/Core/Core.csproj", 4)]
    web = graph.plan(projects, edges, only_for="src/Web/Web.csproj").collect()
    assert [r["id"] for r in web] == ["src/Core/Core.csproj", "src/Data/Data.csproj", "src/Web/Web.csproj"]
    assert graph.plan(projects, edges, only_for="src/Api/Api.csproj").count() == 0
    core = graph.plan(projects, edges, exclude_kinds=("test",)).filter("id = 'src/Core/Core.csproj'").first()
    assert core["blast_radius"] == 4
    assert tuple(graph.plan_counts(graph.plan(projects.limit(0), edges.limit(0))).first()) == (0, 0, 0, 0, 0)


def test_leaf_first_order(spark):
    e = edges_of(spark, ("App", "B"), ("App", "A"), ("A", "Core"), ("B", "Core"))
    nodes = spark.createDataFrame([("App",), ("B",), ("A",), ("Core",)], "id string")
    assert graph.leaf_first(e, nodes) == ["Core", "A", "B", "App"]
    assert [r["node"] for r in graph.levels(e).orderBy("level", "node").collect()] == ["Core", "A", "B", "App"]
    with pytest.raises(ValueError):
        graph.levels(edges_of(spark, ("a", "b"), ("b", "a")))


def test_every_project_comes_after_what_it_needs(spark):
    random.seed(1)
    pairs = {(f"n{random.randint(0, 40)}", f"n{random.randint(0, 40)}") for _ in range(70)}
    e = edges_of(spark, *pairs)
    order = graph.leaf_first(e, e.select("src"))
    place, of = {n: i for i, n in enumerate(order)}, {r["node"]: r["component"] for r in graph.scc(e).collect()}
    assert all(place[d] < place[s] or of.get(s) == of.get(d) for s, d in pairs if s != d)
    assert len(order) == len({x for p in pairs for x in p})


def test_cycles(spark):
    e = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"))
    assert [(r["component"], r["members"]) for r in graph.cycles(e).collect()] == [("a", ["a", "b", "c"]), ("e", ["e"])]
    assert graph.cycle_path(e, ["a", "b", "c"]) == ["a", "b", "c", "a"]


def test_closures_agree(spark):
    random.seed(7)
    pairs = {(random.randint(0, 30), random.randint(0, 30)) for _ in range(50)}
    e = spark.createDataFrame(list(pairs), "src long, dst long")
    pairs_of = lambda df: {tuple(r) for r in df.collect()}
    for depth in (None, 1, 3):
        assert pairs_of(graph.closure(e, depth=depth)) == pairs_of(graph.closure(e, depth=depth, local_limit=0))
    seeds = spark.createDataFrame([(3,), (5,)], "node long")
    assert pairs_of(graph.reached_set(e, seeds)) == pairs_of(graph.reached_set(e, seeds, local_limit=0))
    assert graph.closure(e.limit(0)).count() == 0


def test_edges_from_assembly_names(spark):
    projects = spark.createDataFrame([("p1", "Core"), ("p2", "core.data"), ("p3", "Twice"), ("p4", "twice")], "id string, assembly_name string")
    references = spark.createDataFrame([("p1", "p2"), ("p1", "gone")], "project string, target string")
    hints = spark.createDataFrame([("p2", "CORE"), ("p1", "core"), ("p1", "twice")], "project string, stem string")
    assert [tuple(r) for r in graph.derive_edges(references, hints, projects).collect()] == [("p1", "p2", "project"), ("p2", "p1", "assembly")]


def test_used_edges_tell_empty_from_absent(spark):
    e = spark.createDataFrame([("dual", "x", "project"), ("dual", "y", "project"), ("dual", "z", "assembly"), ("empty", "x", "project"), ("plain", "x", "project")], "src string, dst string, kind string")
    lists = spark.createDataFrame([("dual",), ("empty",)], "project string")
    refs = spark.createDataFrame([("dual", "x")], "project string, target string")
    assert {(r["src"], r["dst"]) for r in graph.used_edges(e, lists, refs).collect()} == {("dual", "x"), ("dual", "z"), ("plain", "x")}


def test_slices_and_applications(spark):
    projects, edges = model(spark)
    ask = spark.createDataFrame([("src/Core/Core.csproj",)], "id string")
    names = lambda df: {r["node"].rsplit("/", 1)[-1] for r in df.collect()}
    assert names(graph.slice_closure(projects, edges, ask)) == {"Core.csproj", "Contracts.csproj"}
    assert names(graph.slice_closure(projects, edges, ask, dependents=True)) == {"Core.csproj", "Contracts.csproj", "Data.csproj", "Web.csproj", "Tool.csproj", "Data.Tests.csproj"}
    data = spark.createDataFrame([("src/Data/Data.csproj",)], "id string")
    assert "Data.Tests.csproj" in names(graph.slice_closure(projects, edges, data, tests=True))
    assert "Data.Tests.csproj" not in names(graph.slice_closure(projects, edges, ask, tests=True))
    e = edges_of(spark, ("site", "lib"), ("area", "x"), ("lib", "host"))
    hosted = spark.createDataFrame([("area", "site"), ("inner", "area"), ("other", "host"), ("site", None)], "id string, hosted_by string")
    assert names(graph.application_closure(e, hosted, "site")) == {"site", "lib", "area", "x", "inner", "host"}


def test_paths_and_distances(spark):
    e = edges_of(spark, ("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"))
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "d"] and graph.shortest_path(e, "d", "a") is None
    assert {(r["node"], r["distance"]) for r in graph.distances(e, spark.createDataFrame([("a",)], "n string")).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_minimum_cut_nearest_the_sink():
    assert cuts.minimum_cut({("s", "a"): 1, ("a", "t"): 1}, {"s"}, {"t"}) == [("a", "t")]
    two = {("s", "a"): 3, ("s", "b"): 3, ("a", "m"): 1, ("b", "m"): 1, ("m", "t"): 5}
    assert cuts.minimum_cut(two, {"s"}, {"t"}) == [("a", "m"), ("b", "m")]
    assert cuts.minimum_cut({("a", "b"): 1}, set(), {"b"}) == []


def test_minimum_cuts_equal_the_least_of_all_cuts():
    random.seed(4)
    for _ in range(300):
        edges = {(random.randint(0, 7), random.randint(0, 7)): random.randint(1, 3) for _ in range(14)}
        nodes = sorted({n for e in edges for n in e})
        sources = set(random.sample(nodes, 2))
        sinks = set(random.sample(sorted(set(nodes) - sources), 2)) if len(nodes) > 3 else set()
        free = sorted(set(nodes) - sources - sinks)
        sides = [sinks | {n for k, n in enumerate(free) if m >> k & 1} for m in range(2 ** len(free))] if sinks else []
        cost = lambda side: sum(c for (a, b), c in edges.items() if a not in side and b in side)
        side = min(sides, key=lambda s: (cost(s), len(s)), default=None)
        least = [] if side is None else sorted((a, b) for a, b in edges if a not in side and b in side)
        assert cuts.minimum_cut(edges, sources, sinks) == least


def test_minimum_cut_of_many_ways_takes_no_search_for_each():
    n = 20_000
    edges = {(f"s{k}", f"m{k}"): 2 for k in range(n)} | {(f"m{k}", f"t{k}"): 1 for k in range(n)}
    began = time.perf_counter()
    found = cuts.minimum_cut(edges, {f"s{k}" for k in range(n)}, {f"t{k}" for k in range(n)})
    assert len(found) == n and all(a[0] == "m" for a, _ in found) and time.perf_counter() - began < 20


def test_cut_of_each_project_and_scores(spark):
    rows = [("p", "s", "a", "m1"), ("p", "a", "t", "m1"), ("p", "a", "t", "m1"), ("q", "s", "t", "m1"), ("q", "s", "t", "m2")]
    e = spark.createDataFrame(rows, "project string, src string, dst string, member string")
    clean, dirty = (spark.createDataFrame([("p", x), ("q", x)], "project string, node string") for x in ("s", "t"))
    assert {tuple(r) for r in cuts.seam_cuts(e, clean, dirty).collect()} == {("p", "a", "t", 1), ("q", "s", "t", 2)}
    one = spark.range(1).select(cuts.seam_score(F.lit(0.5), F.lit(3), F.lit(False)).alias("s")).first()["s"]
    assert one == 0.33
    g = edges_of(spark, ("s", "b"), ("b", "t"), ("s", "c"))
    roots, bad = spark.createDataFrame([("s",)], "n string"), spark.createDataFrame([("t",)], "n string")
    assert cuts.articulates(g, "b", roots, bad) and not cuts.articulates(g, "c", roots, bad)


def test_helpers_are_the_largest_set(spark):
    uses = edges_of(spark, ("t1", "h1"), ("h1", "h2"), ("prod", "h3"), ("h3", "h4"), ("h5", "h6"), ("h6", "h5"))
    candidates = spark.createDataFrame([(f"h{i}",) for i in range(1, 8)], "n string")
    tests = spark.createDataFrame([("t1",)], "n string")
    assert {r["node"] for r in fixpoints.helpers(candidates, uses, tests).collect()} == {"h1", "h2"}


def test_searches(spark):
    calls = edges_of(spark, ("e2", "m"), ("e1", "n"), ("m", "x"), ("n", "x"), ("z", "z"))
    starts = spark.createDataFrame([("x",)], "n string")
    entries = spark.createDataFrame([("e1",), ("e2",)], "n string")
    row = fixpoints.nearest_entry(starts, calls, entries).first()
    assert (row["entry"], row["path"]) == ("e2", ["x", "m", "e2"])
    assert fixpoints.nearest_entry(starts, calls, entries, depth=1).count() == 0
    assert {r["node"] for r in fixpoints.self_reaching(calls).collect()} == {"z"}
    assert {(r["node"], r["distance"]) for r in fixpoints.extended(entries, calls, 1).collect()} == {("e1", 0), ("e2", 0), ("m", 1), ("n", 1)}
    assert {r["start"] for r in fixpoints.reaches_within(entries, calls, starts, 2).collect()} == {"e1", "e2"}


def test_standings_and_components_agree_at_any_size(spark):
    random.seed(11)
    for n, m in ((12, 16), (25, 30), (25, 60)):
        pairs = sorted({(f"n{random.randint(0, n)}", f"n{random.randint(0, n)}") for _ in range(m)})
        whole = edges_of(spark, *pairs)
        used = edges_of(spark, *(p for p in pairs if random.random() < 0.7))
        projects = spark.createDataFrame([(f"n{i}", random.choice(["framework", "standard"])) for i in range(n + 1)], "id string, framework_class string")
        rows = lambda df: {tuple(r) for r in df.collect()}
        got = rows(graph.standings(projects, used, whole))
        assert got == rows(graph.standings(projects, used, whole, local_limit=0))
        assert rows(graph.scc(whole)) == rows(graph.scc(whole, local_limit=0))
        # by pairs
        reach, cycle = {}, {}
        for e, out in ((used, reach), (whole, cycle)):
            for s, d in rows(graph.closure(e)):
                out.setdefault(s, set()).add(d)
        same = lambda a, b: b in cycle.get(a, ()) and a in cycle.get(b, ())
        fw = {r["id"] for r in projects.collect() if r["framework_class"] == "framework"}
        blocks = {f"n{i}": reach.get(f"n{i}", set()) & fw for i in range(n + 1)}

        def wave(i):
            return 0 if not blocks[i] and i not in fw else 1 + max([wave(b) for b in blocks[i] if not same(i, b)], default=0)

        assert got == {(i, "blocked" if blocks[i] else "ready" if i in fw else "done", wave(i)) for i in blocks}


def test_unused_edge_within_a_cycle_makes_no_wave(spark):
    projects = spark.createDataFrame([("A", "framework", "library"), ("B", "framework", "library")], "id string, framework_class string, kind string")
    edges = edges_of(spark, ("A", "B"), ("B", "A"))
    rows = graph.plan(projects, edges, edges_of(spark, ("A", "B"))).collect()
    assert [(r["id"], r["wave"], r["in_cycle"]) for r in rows] == [("A", 1, True), ("B", 1, True)]


def test_cycle_path_comes_back_to_its_start(spark):
    assert graph.cycle_path(edges_of(spark, ("a", "b")), ["a", "c"]) == ["a", "c", "a"]


def test_long_chains_end(spark):
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.reached_set(chain, spark.createDataFrame([(0,)], "n long"), local_limit=0).count() == 41
    assert graph.distances(chain, spark.createDataFrame([(0,)], "n long")).agg(F.max("distance")).first()[0] == 40


def test_orders_ways_and_paths_beyond_the_bound(spark):
    random.seed(2)
    pairs = sorted({(random.randint(0, 15), random.randint(0, 15)) for _ in range(22)})
    e = spark.createDataFrame(pairs, "src long, dst long").coalesce(1).cache()
    nodes = spark.createDataFrame([(0,), (8,), (77,)], "id long")
    assert [r["node"] for r in graph.leaf_first_places(e, nodes, 0).orderBy("place").collect()] == graph.leaf_first(e, nodes)
    ways = {r["component"]: r["path"] for r in graph.ways_round(e).collect()}
    assert ways == {r["component"]: graph.cycle_path(e, r["members"]) for r in graph.cycles(e).collect()}
    for a, b in ((0, 9), (12, 3), (7, 99)):
        assert graph.shortest_path(e, a, b, 0) == graph.shortest_path(e, a, b)


def test_orders_by_keys_follow_the_heap(spark):
    # acyclic, with edges from lesser names to greater ones: a key has several turns
    random.seed(5)
    rank = random.sample(range(16), 16)
    pairs = sorted({(rank[max(a, b)], rank[min(a, b)]) for a, b in ((random.randint(0, 15), random.randint(0, 15)) for _ in range(40)) if a != b})
    e = spark.createDataFrame(pairs, "src long, dst long")
    assert [r["node"] for r in graph.leaf_first_places(e, e.select("src"), 0).orderBy("place").collect()] == graph.leaf_first(e, e.select("src"))


def test_large_joins_stay_off_the_driver(spark):
    projects, edges = model(spark)
    assert graph.local_edges(edges, 1) is None
    found = graph.standings(projects, edges, local_limit=0)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_text_keys_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "node string, label long")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    plan = edges.join(graph.sent(rows), F.col("src") == F.col("node"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def told(df):
    return sorted(map(str, df.collect()))


def by_joins(monkeypatch):
    for module in (graph, reach):
        monkeypatch.setattr(module, "local_edges", lambda edges, limit=0: None)


def test_readiness_by_joins_looks_for_no_cycles(spark, monkeypatch):
    """Cycles and waves are not computed where only the readiness is asked for."""
    projects = spark.createDataFrame([(k, "framework" if k % 3 == 0 else "standard") for k in range(1, 10)], "id long, framework_class string")
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 10)] + [(4, 8)], "src long, dst long")
    want = told(graph.readiness(projects, edges))
    by_joins(monkeypatch)
    monkeypatch.setattr(graph, "scc", lambda *a: pytest.fail("cycles were looked for"))
    assert told(graph.readiness(projects, edges)) == want


def test_plan_finds_cycles_once(spark, monkeypatch):
    """(F12, F13, F15, F16) Waves and the mark of cycles share their components."""
    projects = spark.createDataFrame([(k, "framework" if k % 3 == 0 else "standard") for k in range(1, 10)], "id long, framework_class string")
    edges = spark.createDataFrame([(k, k // 2) for k in range(2, 10)] + [(4, 8)], "src long, dst long")
    want, made, plainly = told(graph.plan(projects, edges)), [], graph.scc
    by_joins(monkeypatch)
    monkeypatch.setattr(graph, "scc", lambda *a: made.append(1) or plainly(*a))
    assert told(graph.plan(projects, edges)) == want and made == [1]


def test_closure_by_joins_keeps_no_row_for_each_pair(spark, monkeypatch):
    k = spark.range(1, 3_000).select(F.col("id").alias("src"))
    e = k.withColumn("dst", F.explode(F.array(F.expr("src div 2"), F.expr("src div 3")))).distinct()
    kept, checkpoint = [], type(e).checkpoint

    def counted(self, *args):
        out = checkpoint(self, *args)
        kept.append(out.count())
        return out

    monkeypatch.setattr(type(e), "checkpoint", counted)
    found = graph.closure(e, local_limit=0)
    monkeypatch.undo()
    pairs, want = found.count(), graph.closure(e)
    assert pairs == want.count() and found.exceptAll(want).isEmpty()
    assert sum(kept) < pairs, (sum(kept), pairs)
