"""Reach without pairs, dominators, violations, move sets and labels against plain versions on random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cuts, fixpoints, graph, moves, reach, selection


def pairs(seed, n=40, m=70, kind=int):
    random.seed(seed)
    return sorted({(kind(random.randrange(n)), kind(random.randrange(n))) for _ in range(m)})


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}")


def reached(edges, start):
    out, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in out:
                out.add(b)
                todo.append(b)
    return out


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("limit", [0, 500_000])
@pytest.mark.parametrize("seed,kind", [(1, int), (2, str)])
def test_reach_counts_and_lists(spark, monkeypatch, limit, seed, kind):
    monkeypatch.setattr(reach, "BLOCK", 64)
    edges = pairs(seed, 150, 210, kind)
    e = frame(spark, edges, "long" if kind is int else "string")
    nodes = sorted({x for p in edges for x in p})
    away = {n: reached(edges, n) - {n} for n in nodes}
    assert rows(reach.reach_counts(e, local_limit=limit), "node", "n") == [(n, len(away[n])) for n in nodes]
    some, unknown = nodes[::3], kind(9999)
    targets = spark.createDataFrame([(x,) for x in [*some, *some, unknown, None]], f"x {'long' if kind is int else 'string'}")
    starts = spark.createDataFrame([(x,) for x in [*nodes[::2], unknown]], f"y {'long' if kind is int else 'string'}")
    want = [(n, len(away[n] & set(some))) for n in nodes[::2]] + [(unknown, 0)]
    assert rows(reach.reach_counts(e, starts, targets, limit), "node", "n") == sorted(want)
    lists = {r["node"]: r["reached"] for r in reach.reach_lists(e, targets, limit).collect()}
    assert lists == {n: sorted(away[n] & set(some)) for n in nodes if away[n] & set(some)}


def test_reach_of_nothing(spark):
    e = frame(spark, [(1, 2)]).limit(0)
    assert reach.reach_counts(e).count() == 0 and reach.reach_lists(e, e.select("src")).count() == 0
    assert reach.reach_counts(e, local_limit=0).count() == 0
    alone = spark.createDataFrame([(7,)], "x long")
    assert rows(reach.reach_counts(e, alone, alone), "node", "n") == [(7, 0)]


def test_plan_makes_no_pairs(spark):
    """A line of nodes, whose closure has a row for each pair: the plan's frames hold no such thing."""
    n = 3000
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = reach.reach_counts(e)
    assert found.agg(F.sum("n")).first()[0] == n * (n - 1) // 2 and found.filter("n = 2999").first()["node"] == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_carried_labels(spark, limit):
    edges = pairs(5, 60, 70)
    state = [(random.randrange(60), random.randrange(9)) for _ in range(12)]
    want = {}
    for node, label in state:
        for x in reached(edges, node) | {node}:
            want[x] = min(label, want.get(x, label))
    found = reach.carried(frame(spark, edges), spark.createDataFrame(state, "node long, label int"), limit)
    assert rows(found, "node", "label") == sorted(want.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_slices_agree(spark, seed):
    edges = pairs(seed, 60, 60)
    projects = spark.createDataFrame([(i, "test" if i % 4 == 0 else "library") for i in range(60)], "id long, kind string")
    asked = spark.createDataFrame([(3,), (8,)], "x long")
    for dependents in (False, True):
        for tests in (False, True):
            small, large = (graph.slice_closure(projects, frame(spark, edges), asked, dependents, tests, limit) for limit in (500_000, 0))
            assert rows(small, "node") == rows(large, "node")


def test_partial_dependency_through_hosts(spark):
    edges, hosts = pairs(4, 50, 50), [(i, i // 7) for i in range(50) if i % 3 == 1 and i > 7]
    partial = {5, 11, 23, 31}
    projects = spark.createDataFrame([(i, i in partial) for i in range(50)], "id long, partial boolean")
    hosted = spark.createDataFrame(hosts, "id long, hosted_by long")
    inner = [(h, i) for i, h in hosts]
    want = []
    for i in range(50):
        inside = reached(inner, i) | {i}
        near = set().union(*(reached(edges, x) | {x} for x in inside)) & partial
        if i in partial or near:
            want.append((i, i if i in partial else min(near)))
    assert rows(selection.partial_dependency(projects, frame(spark, edges), hosted), "id", "because") == want


def test_partial_dependency_without_hosts(spark):
    projects = spark.createDataFrame([(i, i in (3, 5)) for i in range(7)], "id long, partial boolean")
    edges = frame(spark, [(0, 1), (1, 2), (2, 1), (2, 5), (2, 3), (5, 3), (6, 6)])
    assert rows(selection.partial_dependency(projects, edges), "id", "because") == [(0, 3), (1, 3), (2, 3), (3, 3), (5, 5)]


# ---- dominators and seams


@pytest.mark.parametrize("seed", range(60))
def test_dominators_equal_removal(seed):
    edges = pairs(seed, 14, random.Random(seed).randrange(8, 34))
    roots, sinks = {0, 1, 2}, {11, 12, 13}
    ways = defaultdict(list)
    for a, b in edges:
        ways[a].append(b)
    free = lambda gone: any((reached([e for e in edges if gone not in e], r) | {r}) & (sinks - {gone}) for r in roots - {gone})
    found = cuts.dominators(ways, roots, sinks)
    if not free(None):
        assert found is None
    else:
        assert set(found) == {n for n in range(14) if not free(n)}


def test_seams_of_a_project(spark):
    edges = [("p", "Root", "A", "m1"), ("p", "Root", "A", "m2"), ("p", "A", "Web", "m3"), ("p", "Other", "A", "m4"), ("p", "Web", "Deep", "m5"), ("q", "R", "X", "m1"), ("q", "R", "Y", "m2"), ("r", "Alone", "B", "m")]
    tainted = [("p", "Web"), ("p", "Deep"), ("q", "X"), ("q", "Y")]
    sites = [("p", "A", "Web", "Web.Get()", True, False), ("p", "A", "Web", "Web.Get()", True, False), ("p", "A", "Web", "Web.Now", False, True), ("p", "Web", "Web", "Web.Own()", True, False), ("q", "R", "X", "X.F()", True, True)]
    e = spark.createDataFrame(edges, "project string, src string, dst string, member string")
    t = spark.createDataFrame(tainted, "project string, node string")
    s = spark.createDataFrame(sites, "project string, src string, dst string, signature string, wire_friendly boolean, is_static boolean")
    cut = cuts.project_cuts(e, t)
    assert rows(cut, "project", "src", "dst", "members", "articulates") == [("p", "A", "Web", 1, True), ("q", "R", "X", 1, False), ("q", "R", "Y", 1, False)]
    assert {tuple(r["gateways"]) for r in cut.filter("project = 'p'").collect()} == {("A", "Web")}
    found = {(r["project"], r["seam"]): r for r in cuts.seams(e, t, s).collect()}
    web = found["p", "seam-1"]
    assert (web["boundary"], web["callers"], web["friendly"], web["score"], web["articulates"]) == ("Web", ["A"], 1, round(0.5 / 1.1, 2), True)
    assert [(m["signature"], m["call_sites"]) for m in web["members"]] == [("Web.Get()", 2), ("Web.Now", 1)]
    assert [found["q", f"seam-{k}"]["boundary"] for k in (1, 2)] == ["Y", "X"] and found["q", "seam-1"]["score"] == 0.8


# ---- violations


def plain_violation(start, calls, bad, aliases, depth):
    """A queue of members, each with its calls in order: the search that the labelling stands for."""
    queue, seen = deque([(start, [start])]), {start}
    while queue:
        node, path = queue.popleft()
        mine = sorted((p, d) for s, d, p in calls if s == node)
        for _, callee in mine:
            if callee in bad:
                return callee, [*path, callee]
            if len(path) < depth:
                for to in [callee, *sorted(i for n, i in aliases if n == callee)]:
                    if to not in seen:
                        seen.add(to)
                        queue.append((to, [*path, to]))
    return None


@pytest.mark.parametrize("seed,dispatch", [(1, False), (2, False), (3, True), (4, True)])
def test_first_violations_equal_a_queue(spark, seed, dispatch):
    random.seed(seed)
    names = [f"n{i:02}" for i in range(40)]
    calls = sorted({(random.choice(names), random.choice(names)) for _ in range(60)})
    calls = [(s, d, random.randrange(100) * 100 + k) for k, (s, d) in enumerate(calls)]
    bad, aliases = {"n03", "n17"}, sorted({(random.choice(names), random.choice(names)) for _ in range(8)}) if dispatch else []
    found = fixpoints.first_violation(
        spark.createDataFrame([(n,) for n in names], "x string"), spark.createDataFrame(calls, "src string, dst string, place int"), spark.createDataFrame([(b,) for b in bad], "b string"),
        4, spark.createDataFrame(aliases, "name string, implementation string") if dispatch else None,
    )
    got = {r["start"]: (r["callee"], r["path"]) for r in found.collect()}
    want = {n: v for n in names if (v := plain_violation(n, calls, bad, aliases, 4))}
    assert {n: (c, len(p)) for n, (c, p) in got.items()} == {n: (c, len(p)) for n, (c, p) in want.items()}
    assert got == want


# ---- move sets


def test_paths_to_a_goal(spark):
    edges = pairs(7, 30, 50, str)
    found = {r["node"]: r["path"] for r in moves.paths_to(frame(spark, edges, "string"), "4").collect()}

    def way(start):
        todo, before = deque([start]), {start: None}
        while todo:
            x = todo.popleft()
            if x == "4":
                path = []
                while x is not None:
                    path.append(x)
                    x = before[x]
                return path[::-1]
            for b in sorted(b for a, b in edges if a == x):
                if b not in before:
                    before[b] = x
                    todo.append(b)

    assert found == {n: way(n) for n in {x for p in edges for x in p} | {"4"} if way(n)}


def plain_moves(requested, needs, stuck):
    """Passes over the files by name: bring what each needs, exclude what can't, until nothing changes; then drop what nothing needs."""
    candidates, via, out = set(requested), {f: None for f in requested}, {}
    changed = True
    while changed:
        changed = False
        for f in sorted(candidates):
            if f not in candidates:
                continue
            for g in sorted(d for s, d in needs if s == f and d != f and d not in candidates):
                if g in out:
                    out[f] = (moves.KEPT_BACK, [g])
                    break
                candidates.add(g)
                via.setdefault(g, f)
                changed = True
            if f not in out and f in stuck:
                out[f] = stuck[f]
            if f in out:
                candidates.discard(f)
                changed = True
    return candidates, via, out


@pytest.mark.parametrize("seed", range(6))
def test_move_plans_equal_passes(spark, seed):
    random.seed(seed)
    files = [f"f{i:02}" for i in range(30)]
    needs = sorted({(random.choice(files), random.choice(files)) for _ in range(34)})
    requested, stuck = random.sample(files, 5), {f: ("rule", [f"why {f}"]) for f in random.sample(files, 3)}
    found, stays = moves.move_plan(
        spark.createDataFrame([(f,) for f in requested], "f string"), frame(spark, needs, "string"), frame(spark, needs, "string").limit(0),
        spark.createDataFrame([(f, *x) for f, x in stuck.items()], "file string, code string, details array<string>"),
    )
    candidates, via, out = plain_moves(requested, needs, stuck)
    wanted = set().union(*(reached([e for e in needs if set(e) <= candidates], f) | {f} for f in set(requested) & candidates)) if set(requested) & candidates else set()
    assert {r["file"] for r in found.collect()} == wanted
    told = {r["file"]: (r["code"], r["details"]) for r in stays.collect()}
    assert {f: x for f, x in told.items() if x[0] != moves.NOT_NEEDED} == out
    assert {f for f, x in told.items() if x[0] == moves.NOT_NEEDED} == candidates - wanted
    assert all(r["co_move_of"] is None or (r["co_move_of"], r["file"]) in needs for r in found.collect())


def test_move_plan_rules(spark):
    needs = frame(spark, [("A", "B"), ("B", "C"), ("A", "D"), ("E", "F"), ("X", "A")], "string")
    together = frame(spark, [("A", "A.resx"), ("A.resx", "A")], "string")
    uses = spark.createDataFrame([("C", "core"), ("D", "web"), ("F", "src"), ("D", "util")], "file string, project string")
    edges = frame(spark, [("web", "mid"), ("mid", "dest"), ("core", "base")], "string")
    stuck = moves.project_blocks(uses, edges, "src", "dest", spark.createDataFrame([("core",)], "p string"), spark.createDataFrame([("util", "no target")], "project string, reason string"))
    assert rows(stuck, "file", "code", "details") == [("D", "no target", ["util"])]
    stuck = moves.project_blocks(uses, edges, "src", "dest", spark.createDataFrame([("core",)], "p string"))
    assert rows(stuck, "file", "code", "details") == [("D", moves.PROJECT_CYCLE, ["dest", "web", "mid", "dest"])]
    ask = spark.createDataFrame([("A",), ("E",)], "f string")
    go, stay = moves.move_plan(ask, needs, together, stuck)
    assert {(r["file"], r["co_move_of"]) for r in go.collect()} == {("E", None), ("F", "E")}
    told = {r["file"]: (r["code"], r["details"]) for r in stay.collect()}
    assert told["A"] == (moves.KEPT_BACK, ["D"]) and told["D"][0] == moves.PROJECT_CYCLE and told["A.resx"] == (moves.KEPT_BACK, ["A"])
    assert told["B"] == (moves.NOT_NEEDED, ["A"]) and told["C"] == (moves.NOT_NEEDED, ["B"])
    go, stay = moves.move_plan(ask, needs, together, stuck, co_move=False)
    assert go.count() == 0 and {r["file"] for r in stay.collect()} == {"A", "A.resx", "E"}
    go, stay = moves.move_plan(ask, needs, together, stuck.limit(0), above=True)
    assert {r["file"] for r in go.collect()} == {"E"}
    assert {r["file"]: (r["code"], r["details"]) for r in stay.collect()} == {"A": (moves.USED_BY_STAYING, ["X"]), "A.resx": (moves.NOT_NEEDED, ["A"])}
    assert moves.move_plan(ask.limit(0), needs, together, stuck)[0].count() == 0


def test_counts_take_the_way_with_fuller_words(spark, monkeypatch):
    """Each node needs its half and third: a node's users lie together, what it needs does not."""
    e = frame(spark, [(k, k // m) for k in range(1, 700) for m in (2, 3)])
    made, plainly = [], reach.words_by_joins
    monkeypatch.setattr(reach, "words_by_joins", lambda edges, marks: made.append(plainly(edges, marks)) or made[-1])
    starts, targets = (spark.createDataFrame([(k,) for k in range(0, 900, m)], "x long") for m in (2, 3))
    for some in ({}, {"starts": starts, "targets": targets}):
        for edges in (e, graph.reverse(e)):
            assert rows(reach.reach_counts(edges, local_limit=0, **some), "node", "n") == rows(reach.reach_counts(edges, **some), "node", "n")
    sizes = [df.count() for df in made]
    assert len(sizes) == 4 and sizes[0] == sizes[1] < 2000
