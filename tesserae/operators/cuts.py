"""Boundary cuts of a project's type graph: minimum cut, articulation and seam scores, one project to a task.

type_edge (project, src, dst, member); the capacity of an edge is the number of members that use it. Of all minimum
cuts the one nearest the tainted side is taken: the source side is everything that can't reach the sink any more.
A project's types are few thousands by nature, so a project is one group, which gives its cut and its dominators at once.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minimum_cut(edges: dict[tuple, int], sources: set, sinks: set) -> list[tuple]:
    """Edges of the minimum cut nearest the sinks: in each pass all shortest ways are filled at once, until none is left."""
    if not sources or not sinks:
        return []
    place = {n: k for k, n in enumerate(dict.fromkeys([*(n for e in edges for n in e), *sources, *sinks]), 2)}
    top = sum(edges.values()) + 1
    begin, end = 0, 1
    # arc x leads to heads[x] and has room[x] left; x ^ 1 is the way back
    heads, room, ways = [], [], [[] for _ in range(len(place) + 2)]

    def put(a: int, b: int, c: int) -> None:
        ways[a].append(len(heads))
        ways[b].append(len(heads) + 1)
        heads.extend((b, a))
        room.extend((c, 0))

    for (a, b), c in edges.items():
        put(place[a], place[b], c)
    for n in sources:
        put(begin, place[n], top)
    for n in sinks:
        put(place[n], end, top)
    while True:
        far, todo = [-1] * len(ways), deque([end])
        far[end] = 0
        while todo and far[begin] < 0:
            b = todo.popleft()
            for x in ways[b]:
                a = heads[x]
                if far[a] < 0 and room[x ^ 1] > 0:
                    far[a] = far[b] + 1
                    todo.append(a)
        if far[begin] < 0:
            break
        next_way, path, a = [0] * len(ways), [], begin
        while True:
            while next_way[a] < len(ways[a]):
                x = ways[a][next_way[a]]
                if room[x] > 0 and far[heads[x]] == far[a] - 1:
                    break
                next_way[a] += 1
            else:
                if not path:
                    break
                a = heads[path.pop() ^ 1]
                next_way[a] += 1
                continue
            path.append(x)
            a = heads[x]
            if a == end:
                least = min(room[x] for x in path)
                for x in path:
                    room[x] -= least
                    room[x ^ 1] += least
                # back to the start of the first full arc
                full = next(k for k, x in enumerate(path) if not room[x])
                a = heads[path[full] ^ 1]
                del path[full:]
    # the last search found all nodes that still reach the sink
    near = {n for n, k in place.items() if far[k] >= 0}
    return sorted((a, b) for a, b in edges if a not in near and b in near)


def seam_cuts(type_edges: DataFrame, clean_roots: DataFrame, tainted: DataFrame) -> DataFrame:
    """(project, src, dst, members): the cut edges between a project's clean roots and its tainted types."""
    facts = (
        type_edges.groupBy("project", "src", "dst").agg(F.countDistinct("member").alias("members")).withColumn("role", F.lit("edge"))
        .unionByName(clean_roots.select("project", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("members"), F.lit("clean").alias("role")))
        .unionByName(tainted.select("project", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("members"), F.lit("tainted").alias("role")))
    )

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[pdf.role == "edge"]
        edges = {(a, b): int(n) for a, b, n in zip(rows.src, rows.dst, rows.members)}
        found = minimum_cut(edges, set(pdf.src[pdf.role == "clean"]), set(pdf.src[pdf.role == "tainted"]))
        return pd.DataFrame([(pdf.project.iloc[0], a, b, edges[a, b]) for a, b in found], columns=["project", "src", "dst", "members"])

    return facts.groupBy("project").applyInPandas(cut, "project string, src string, dst string, members long")


def seam_score(friendly: Column, members: Column, articulates: Column) -> Column:
    """Friendly share (1 for no members), less for many members, and less unless the boundary alone parts clean from tainted types."""
    share = F.when(members == 0, F.lit(1.0)).otherwise(friendly)
    return F.bround(share / (1 + 0.1 * F.greatest(members - 1, F.lit(0))) * F.when(articulates, 1.0).otherwise(0.8), 2)


def dominators(edges: dict, roots: set, sinks: set) -> list | None:
    """Nodes that every way from a root to a sink goes through, the nearest to the roots first; None if there is no way.

    The tree of immediate dominators below a node before all roots, by passes over the nodes in reverse postorder until
    nothing changes; the answer is the line above a node behind all sinks.
    """
    top, end = object(), object()
    ways = lambda n: sorted(roots) if n is top else [] if n is end else [*sorted(edges.get(n, ())), *([end] if n in sinks else [])]
    order, seen, stack = [], {top}, [(top, iter(ways(top)))]
    while stack:
        node, rest = stack[-1]
        for n in rest:
            if n not in seen:
                seen.add(n)
                stack.append((n, iter(ways(n))))
                break
        else:
            order.append(node)
            stack.pop()
    if end not in seen:
        return None
    order.reverse()
    place, before = {n: i for i, n in enumerate(order)}, defaultdict(list)
    for n in order:
        for m in ways(n):
            before[place[m]].append(place[n])
    above, changed = [0] + [-1] * (len(order) - 1), True
    while changed:
        changed = False
        for i in range(1, len(order)):
            known = [p for p in before[i] if above[p] >= 0]
            low = known[0]
            for p in known[1:]:
                while low != p:
                    while p > low:
                        p = above[p]
                    while low > p:
                        low = above[low]
            if above[i] != low:
                above[i], changed = low, True
    line, at = [], above[place[end]]
    while at:
        line.append(order[at])
        at = above[at]
    return line[::-1]


def project_cuts(type_edges: DataFrame, tainted: DataFrame) -> DataFrame:
    """(project, src, dst, members, articulates, gateways): the cut between clean entry points and the taint of each project.

    type_edges (project, src, dst, member), tainted (project, node). Entry points are clean types that no other type
    uses. articulates: whether dst alone parts all entry points from the taint, from one dominator tree for a project;
    gateways are all types that do so. A project without a way from an entry point to the taint has no rows; one with
    a way has one at least.
    """
    none = F.lit(None).cast("string")
    facts = type_edges.groupBy("project", "src", "dst").agg(F.countDistinct("member").alias("members")).withColumn("tainted", F.lit(False))
    facts = facts.unionByName(tainted.select("project", F.col("node").alias("src"), none.alias("dst"), F.lit(0).cast("long").alias("members"), F.lit(True).alias("tainted")))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[~pdf.tainted]
        edges, ways = {(a, b): int(n) for a, b, n in zip(rows.src, rows.dst, rows.members)}, defaultdict(list)
        for a, b in edges:
            ways[a].append(b)
        dirty = set(pdf.src[pdf.tainted])
        roots = set(rows.src) - {b for _, b in edges} - dirty
        line = dominators(ways, roots, dirty)
        found = minimum_cut(edges, roots, dirty) if line is not None else []
        return pd.DataFrame([(pdf.project.iloc[0], a, b, edges[a, b], b in line, line) for a, b in found], columns=["project", "src", "dst", "members", "articulates", "gateways"])

    return facts.groupBy("project").applyInPandas(cut, "project string, src string, dst string, members long, articulates boolean, gateways array<string>")


def seams(type_edges: DataFrame, tainted: DataFrame, sites: DataFrame) -> DataFrame:
    """(project, seam, boundary, callers, members, friendly, score, articulates) of each boundary of a project's cut.

    sites (project, src, dst, signature, wire_friendly, is_static): uses of a type's members, without constructors and
    the type itself. Members are those of the boundary that its callers across the cut use; they are friendly if they
    are wire-friendly and not static. Boundaries are numbered by fewest members, most callers, most wire-friendly
    members and name, within their project.
    """
    found = project_cuts(type_edges, tainted).select("project", F.col("src").alias("caller"), F.col("dst").alias("boundary"), "articulates")
    across = found.select(F.col("project").alias("p"), F.col("caller").alias("c"), F.col("boundary").alias("b"))
    used = sites.join(across, (F.col("project") == F.col("p")) & (F.col("src") == F.col("c")) & (F.col("dst") == F.col("b")))
    used = used.groupBy("p", "b", "signature").agg(F.count(F.lit(1)).alias("call_sites"), F.bool_and("wire_friendly").alias("wire"), F.bool_or("is_static").alias("static"))
    held = used.groupBy("p", "b").agg(F.count("signature").alias("n"), F.count_if(F.col("wire")).alias("wired"), F.count_if(F.col("wire") & ~F.col("static")).alias("good"), F.array_sort(F.collect_list(F.struct("signature", "call_sites"))).alias("x"))
    rows = found.groupBy("project", "boundary").agg(F.array_sort(F.collect_set("caller")).alias("callers"), F.bool_and("articulates").alias("articulates"))
    rows = rows.join(held, (F.col("project") == F.col("p")) & (F.col("boundary") == F.col("b")), "left").fillna(0, ["n", "wired", "good"])
    share = F.coalesce(F.try_divide(F.col("good"), F.col("n")), F.lit(1.0))
    rows = rows.withColumn("score", seam_score(share, F.col("n"), F.col("articulates")))
    place = F.row_number().over(Window.partitionBy("project").orderBy("n", F.desc(F.size("callers")), F.desc("wired"), "boundary"))
    return rows.select("project", F.concat(F.lit("seam-"), place).alias("seam"), "boundary", "callers", F.coalesce("x", F.array()).alias("members"), F.col("good").alias("friendly"), "score", "articulates")


def articulates(edges: DataFrame, boundary, clean_roots: DataFrame, tainted: DataFrame) -> bool:
    """Whether no clean root reaches a tainted node once the boundary node is taken away: one walk, for one boundary of any graph."""
    from tesserae.operators.graph import reached_set

    rest = edges.filter((F.col("src") != F.lit(boundary)) & (F.col("dst") != F.lit(boundary)))
    roots = clean_roots.filter(F.col(clean_roots.columns[0]) != F.lit(boundary))
    reached = reached_set(rest, roots)
    return reached.join(tainted.select(F.col(tainted.columns[0]).alias("t")), F.col("node") == F.col("t"), "left_semi").isEmpty()
