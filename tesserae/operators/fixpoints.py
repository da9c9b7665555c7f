"""Fixed points: taint, helpers, subtypes, bounded searches. Rounds are joins, cut off by checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.graph import closure, gathered, reached_set, reverse, scc
from tesserae.operators.relational import first_per_key
from tesserae.session import checkpoint_ready


def taint(seeds: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(node): seeds, whatever leans on a tainted node by an edge, and all of a tainted node's group.

    A group taints as a whole, so its members are tied in a ring of edges through its name; the rest is one walk.
    """
    back = reverse(edges)
    if groups is not None:
        ring = groups.select("node", "component")
        back = back.unionByName(ring.select(F.col("node").alias("src"), F.col("component").alias("dst"))).unionByName(ring.select(F.col("component").alias("src"), F.col("node").alias("dst")))
    return reached_set(back, seeds)


def helpers(candidates: DataFrame, uses: DataFrame, tests: DataFrame) -> DataFrame:
    """(node): the largest set of candidates that only tests and the set itself use, and that a test reaches.

    uses (src, dst): src uses dst. A candidate goes if it has no user, or a user that is neither a test nor still in.
    """
    checkpoint_ready(candidates.sparkSession)
    test = tests.select(F.col(tests.columns[0]).alias("t")).distinct()
    kept = candidates.select(F.col(candidates.columns[0]).alias("node")).distinct()
    used = uses.select(F.col("dst").alias("u")).distinct()
    kept = kept.join(used, F.col("node") == F.col("u"), "left_semi").join(test, F.col("node") == F.col("t"), "left_anti").checkpoint()
    outside = uses.join(test, F.col("src") == F.col("t"), "left_anti").filter("src != dst").select("src", "dst").checkpoint()
    before = -1
    now = kept.count()
    while now != before:
        inside = kept.select(F.col("node").alias("k"))
        bad = outside.join(inside, F.col("src") == F.col("k"), "left_anti").select(F.col("dst").alias("b")).distinct()
        kept = kept.join(bad, F.col("node") == F.col("b"), "left_anti").checkpoint()
        before, now = now, kept.count()
    inner = uses.join(kept.select(F.col("node").alias("k")), F.col("dst") == F.col("k"), "left_semi")
    reached = reached_set(inner.select("src", "dst"), tests)
    return kept.join(reached.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left_semi")


def extended(seeds: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, distance) of all that seeds reach within depth steps: subtypes of serialized types, payload members."""
    checkpoint_ready(seeds.sparkSession)
    new = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("distance", F.lit(0)).checkpoint()
    parts, level = [new], 0
    while not new.isEmpty() and (depth is None or level < depth):
        level += 1
        step = new.select(F.col("node").alias("a")).join(edges, F.col("a") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = step.join(gathered(parts).select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti").withColumn("distance", F.lit(level)).checkpoint()
        parts.append(new)
    return gathered(parts)


def self_reaching(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node) on a cycle: a node with an edge to itself, or one of a component of several; of the seeds, if given."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    found = loops.unionByName(scc(edges).select("node")).distinct()
    return found if seeds is None else found.join(seeds.select(F.col(seeds.columns[0]).alias("s")), F.col("node") == F.col("s"), "left_semi")


def first_self_reaching(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node): the first by name of those on a cycle; no row if there is none."""
    return self_reaching(edges, seeds).agg(F.min("node").alias("node")).filter("node IS NOT NULL")


def entry_points(starts: DataFrame, callers: DataFrame, verdicts: DataFrame, depth: int = 4, listed: int = 10) -> DataFrame:
    """(start, entry, path, reason, candidates) of every start: its nearest entry point, or why it has none.

    verdicts (node, reason): a null reason qualifies; a node without a verdict is not examined, nor are its callers.
    callers (src, dst), tests left out. path runs from the entry down to the start. Without an entry the reason is
    `depth exceeded` if something calls what was examined at the last level, else the start's own, else `not
    accessible`; candidates (node, reason) are the first examined. Levels are searched in the order of their paths.
    """
    checkpoint_ready(starts.sparkSession)
    up = callers.select(F.col("dst").alias("low"), F.col("src").alias("high")).distinct()
    told = verdicts.select(F.col("node").alias("v"), "reason").dropDuplicates(["v"])
    asked = starts.select(F.col(starts.columns[0]).alias("start")).distinct().checkpoint()
    new = asked.withColumns({"node": F.col("start"), "path": F.array("start")}).checkpoint()
    seen, hits, tried, over = [new.select("start", "node")], [], [], None
    for level in range(depth + 1):
        now = new.join(told, F.col("node") == F.col("v")).drop("v").withColumn("level", F.lit(level)).checkpoint()
        hit = first_per_key(now.filter("reason IS NULL"), ["start"], [F.col("path")]).select("start", F.col("node").alias("entry"), F.reverse("path").alias("path")).checkpoint()
        rest = now.join(hit.select(F.col("start").alias("h")), F.col("start") == F.col("h"), "left_anti")
        hits.append(hit)
        tried.append(rest)
        step = rest.join(up, F.col("node") == F.col("low"))
        if level == depth:
            over = step.select(F.col("start").alias("o")).distinct()
            break
        step = step.select("start", F.col("high").alias("node"), F.concat("path", F.array("high")).alias("path"))
        known = gathered(seen).select(F.col("start").alias("s"), F.col("node").alias("n"))
        new = first_per_key(step.join(known, (F.col("start") == F.col("s")) & (F.col("node") == F.col("n")), "left_anti"), ["start", "node"], [F.col("path")]).checkpoint()
        seen.append(new.select("start", "node"))
    found, examined = gathered(hits), gathered(tried)
    own = examined.filter("level = 0").select(F.col("start").alias("w"), F.col("reason").alias("own"))
    first = examined.withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("level", "path"))).filter(F.col("k") <= listed)
    first = first.groupBy(F.col("start").alias("c")).agg(F.array_sort(F.collect_list(F.struct("k", "node", "reason"))).alias("x"))
    out = asked.join(found.withColumnRenamed("start", "f"), F.col("start") == F.col("f"), "left").join(over, F.col("start") == F.col("o"), "left")
    out = out.join(own, F.col("start") == F.col("w"), "left").join(first, F.col("start") == F.col("c"), "left")
    why = F.when(F.col("entry").isNotNull(), F.lit(None).cast("string")).when(F.col("o").isNotNull(), "depth exceeded").otherwise(F.coalesce("own", F.lit("not accessible")))
    listing = F.when(F.col("entry").isNull(), F.coalesce(F.transform("x", lambda e: F.struct(e["node"].alias("node"), e["reason"].alias("reason"))), F.array()))
    return out.select("start", "entry", "path", why.alias("reason"), listing.alias("candidates"))


def violation_steps(calls: DataFrame, bad: DataFrame, aliases: DataFrame | None = None, depth: int = 6) -> DataFrame:
    """(node, away, next): how many calls each node is away from a bad one (at most depth), and its first call on the way.

    One labelling for all starts, backward from what is bad, level by level: a node is met once, so that work goes by
    edges. calls (src, dst, and place, if calls have an order of their own; else they go by dst). aliases (name,
    implementation): a call of a name leads on to its implementations too, after the name itself, but only the name
    that is called can be bad.
    """
    checkpoint_ready(calls.sparkSession)
    place = F.col("place") if "place" in calls.columns else F.lit(0)
    direct = calls.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.min(place).alias("place")).checkpoint()
    wrong = bad.select(F.col(bad.columns[0]).alias("b")).distinct()
    first = F.min(F.struct("place", "dst", "turn", "to"))
    found = direct.withColumns({"to": F.col("dst"), "turn": F.lit(0)})
    new = found.join(wrong, F.col("dst") == F.col("b"), "left_semi").groupBy(F.col("src").alias("node")).agg(first.alias("x")).select("node", F.lit(1).alias("away"), "x.to").checkpoint()
    ways = found
    if aliases is not None:
        other = aliases.select(F.col("name").alias("n"), F.col("implementation").alias("impl")).distinct()
        ways = found.unionByName(direct.join(other, F.col("dst") == F.col("n")).select("src", "dst", "place", F.col("impl").alias("to"), F.lit(1).alias("turn")))
    ways = ways.checkpoint()
    parts, level = [new], 1
    while level < depth and not new.isEmpty():
        level += 1
        step = ways.join(new.select(F.col("node").alias("met")), F.col("to") == F.col("met"), "left_semi")
        step = step.groupBy(F.col("src").alias("node")).agg(first.alias("x")).select("node", F.lit(level).alias("away"), "x.to")
        new = step.join(gathered(parts).select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti").checkpoint()
        parts.append(new)
    return gathered(parts).select("node", "away", F.col("to").alias("next"))


def first_violation(starts: DataFrame, calls: DataFrame, bad: DataFrame, depth: int = 6, aliases: DataFrame | None = None) -> DataFrame:
    """(start, callee, path): the first bad node that a start calls within `depth` levels, and the calls that lead to it.

    The nearest comes first, among equals the one whose path is least in the order of calls (`violation_steps`); starts
    that call none have no row, and a start that is bad itself counts only where it is called.
    """
    steps = violation_steps(calls, bad, aliases, depth).checkpoint()
    asked = starts.select(F.col(starts.columns[0]).alias("start")).distinct()
    now = asked.withColumns({"node": F.col("start"), "path": F.array("start")}).join(steps, "node")
    done, levels = [], depth
    for _ in range(levels):  # down falling distances: a start has one row
        moved = now.select("start", "away", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")).checkpoint()
        done.append(moved.filter("away = 1").select("start", F.col("node").alias("callee"), "path"))
        rest = moved.filter("away > 1").drop("away")
        if rest.isEmpty():
            break
        now = rest.join(steps, "node")
    return gathered(done)


def nearest_entry(starts: DataFrame, callers: DataFrame, entries: DataFrame, depth: int = 4) -> DataFrame:
    """(start, entry, path): for each start the first entry found going up callers, level by level.

    callers (src, dst): src calls dst. A level's candidates are tried in the order of the paths that lead to them,
    and a node already met on a start's search isn't met again.
    """
    checkpoint_ready(starts.sparkSession)
    up = callers.select(F.col("dst").alias("low"), F.col("src").alias("high")).distinct()
    good = entries.select(F.col(entries.columns[0]).alias("g")).distinct()
    new = starts.select(F.col(starts.columns[0]).alias("start")).distinct().withColumns({"node": F.col("start"), "path": F.array("start")}).checkpoint()
    seen, found = new.select("start", "node"), None
    for level in range(depth + 1):
        hit = first_per_key(new.join(good, F.col("node") == F.col("g"), "left_semi"), ["start"], [F.col("path")]).select("start", F.col("node").alias("entry"), "path").checkpoint()
        found = hit if found is None else found.unionByName(hit)
        rest = new.join(hit.select(F.col("start").alias("h")), F.col("start") == F.col("h"), "left_anti")
        if level == depth or rest.isEmpty():
            break
        step = rest.join(up, F.col("node") == F.col("low")).select("start", F.col("high").alias("node"), F.concat("path", F.array("high")).alias("path"))
        known = seen.select(F.col("start").alias("s"), F.col("node").alias("n"))
        step = step.join(known, (F.col("start") == F.col("s")) & (F.col("node") == F.col("n")), "left_anti")
        new = first_per_key(step, ["start", "node"], [F.col("path")]).checkpoint()
        seen = seen.unionByName(new.select("start", "node"))
    return found


def reaches_within(starts: DataFrame, calls: DataFrame, bad: DataFrame, depth: int = 6) -> DataFrame:
    """(start): starts from which a bad node is called within depth levels."""
    reach = closure(calls, starts, depth)
    return reach.join(bad.select(F.col(bad.columns[0]).alias("b")), F.col("dst") == F.col("b"), "left_semi").select(F.col("src").alias("start")).distinct()


def callers_through_aliases(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """(caller, callee): direct calls, and calls of what a method implements or overrides. aliases (name, implementation)."""
    other = calls.join(aliases, F.col("callee") == F.col("name")).select("caller", F.col("implementation").alias("callee"))
    return calls.select("caller", "callee").unionByName(other).distinct()


def flow(slots: DataFrame, assigns: DataFrame, rounds: int = 4) -> DataFrame:
    """(node): slots a value flows to in at most `rounds` assignments (src is assigned to dst)."""
    return extended(slots, assigns, rounds).select("node")
