"""Reach without pairs, consolidation with its reasons, gateways, move plans, frameworks and wire shapes, over tables derived from `part`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import cuts, fixpoints, frameworks, graph, moves, reach, wire
from tesserae.plans import commands
from tesserae.plans.graph_queries import REACH_C, REACH_D, C, D, cyclic, dag, parts
from tesserae.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---- reach


@query(f"WITH RECURSIVE {D}, {C}, {REACH_C} SELECT src AS node, count(DISTINCT dst) FILTER (dst != src) AS n FROM r GROUP BY src UNION ALL SELECT DISTINCT dst, 0 FROM c WHERE dst NOT IN (SELECT src FROM c)")
def reach_counts(spark, d):
    return reach.reach_counts(cyclic(spark, d))


@query(f"WITH RECURSIVE {D}, {REACH_D} SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS blockers FROM r JOIN fw ON dst = fw.id WHERE src != dst AND src IN (SELECT p_partkey FROM part) GROUP BY src")
def plan_blockers(spark, d):
    listing = graph.plan(parts(spark, d), dag(spark, d)).filter("blockers IS NOT NULL")
    return listing.select("id", F.array_join(F.transform("blockers", lambda x: x.cast("string")), ",").alias("blockers"))


# ---- consolidation: package n of 60 in project pr of 9, versions 1.<size>.0

CONSOLIDATION = """pk AS (SELECT p_partkey % 60 AS n, p_partkey // 60 % 9 AS pr, min(p_size) AS lo, max(p_size) AS hi, bool_or(p_size % 4 = 0) AS direct FROM part GROUP BY 1, 2),
dep AS (SELECT pr, n, (n * 7 + 3) % 60 AS m, lo % 30 AS low FROM pk UNION ALL SELECT pr, n, (n * 11 + 5) % 60, hi % 30 FROM pk),
walk(pr, n, path) AS (SELECT pr, n, [n] FROM pk WHERE direct UNION ALL SELECT w.pr, dep.m, list_append(path, dep.m) FROM walk w JOIN dep ON dep.pr = w.pr AND dep.n = w.n JOIN pk ON pk.pr = w.pr AND pk.n = dep.m WHERE len(path) < 7),
way AS (SELECT pk.pr, pk.n, coalesce(arg_min(path, [len(path)] || path), [any_value(pk.n)]) AS path FROM pk LEFT JOIN walk w ON w.pr = pk.pr AND w.n = pk.n GROUP BY pk.pr, pk.n),
steps AS (SELECT w.pr, w.n, list('Pkg.' || lpad(pk.n::VARCHAR, 2, '0') || ' 1.' || pk.hi || '.0' ORDER BY i) AS chain FROM (SELECT pr, n, unnest(path) AS x, unnest(range(len(path))) AS i FROM way) w JOIN pk ON pk.pr = w.pr AND pk.n = w.x GROUP BY w.pr, w.n),
pinned AS (SELECT n, pr FROM pk WHERE lo = 1),
trans AS (SELECT DISTINCT dep.m AS n, dep.pr, low, list_append(s.chain, 'Pkg.' || lpad(m::VARCHAR, 2, '0') || ' >= 1.' || low || '.0') AS chain FROM dep JOIN steps s ON s.pr = dep.pr AND s.n = dep.n),
fixed AS (SELECT n, 'P' || pr AS project, 'direct' AS kind, 1 AS rk, lo AS low, ['P' || pr || ' references Pkg.' || lpad(n::VARCHAR, 2, '0') || ' 1.' || lo || '.0'] AS chain FROM pk WHERE (n, pr) NOT IN (SELECT (n, pr) FROM pinned)
  UNION ALL SELECT n, 'P' || pr, 'transitive', 2, low, chain FROM trans WHERE (n, pr) NOT IN (SELECT (n, pr) FROM pinned) AND n IN (SELECT n FROM pk)
  UNION ALL SELECT DISTINCT n, NULL, 'pin', 4, 20, ['pinned: Pkg.' || lpad(n::VARCHAR, 2, '0') || ' 1.20.0'] FROM pk WHERE n % 17 = 6),
c0 AS (SELECT pk.n, CASE WHEN any_value(pk.n % 17 = 6) THEN CASE WHEN coalesce(max(low), 0) <= 20 THEN 20 END ELSE coalesce(max(low), 0) END AS x FROM (SELECT DISTINCT n FROM pk) pk LEFT JOIN fixed USING (n) GROUP BY pk.n),
asked AS (SELECT n, project, kind, rk, low, chain FROM fixed UNION ALL SELECT n + 1, NULL, 'selected', 3, least(x, 40), ['Pkg.' || lpad(n::VARCHAR, 2, '0') || ' 1.' || x || '.0', 'Pkg.' || lpad((n + 1)::VARCHAR, 2, '0') || ' >= 1.' || least(x, 40) || '.0'] FROM c0 WHERE n % 2 = 0 AND x % 10 = 0 AND n + 1 IN (SELECT n FROM pk)),
c AS (SELECT pk.n, CASE WHEN any_value(pk.n % 17 = 6) THEN CASE WHEN coalesce(max(low), 0) <= 20 THEN 20 END ELSE coalesce(max(low), 0) END AS x FROM (SELECT DISTINCT n FROM pk) pk LEFT JOIN asked USING (n) GROUP BY pk.n)"""


def packages(spark, d: str) -> dict:
    """The tables and frames of `commands.deps_consolidate`."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 60).alias("n"), (F.expr("p_partkey div 60") % 9).alias("pr"), "p_size")
    pk = p.groupBy("n", "pr").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.bool_or(F.col("p_size") % 4 == 0).alias("direct"))
    name = lambda n, head="Pkg.": F.concat(F.lit(head), F.lpad(n.cast("string"), 2, "0"))
    version = lambda x: F.concat(F.lit("1."), x, F.lit(".0"))
    row = pk.select(F.concat(F.lit("P"), "pr").alias("project"), F.lit("t").alias("tfm"), name(F.col("n")).alias("id"), version(F.col("hi")).alias("version"), "direct", "n", "lo", "hi")
    needs = [row.select("project", "tfm", "id", "version", name((F.col("n") * a + b) % 60, "pkg.").alias("dep_id"), F.concat(F.lit("["), version(F.col(c) % 30), F.lit(", )")).alias("range")) for a, b, c in ((7, 3, "lo"), (11, 5, "hi"))]
    ids = row.select("id", "n").distinct()
    every = ids.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(60))))
    asks = every.filter("n % 2 = 0 AND x % 10 = 0").select("id", version(F.col("x")).alias("version"), name(F.col("n") + 1).alias("dep_id"), F.concat(F.lit("["), version(F.least("x", F.lit(40))), F.lit(", )")).alias("range"))
    own = row.filter("lo = 1").select("id", F.lit("1.9.0").alias("version"), "project")
    every_project = ids.filter("n % 17 = 6").select(F.upper("id").alias("id"), F.lit("1.20.0").alias("version"), F.lit(None).cast("string").alias("project"))
    return {
        "t": {"package_usage": row.select("id", version(F.col("lo")).alias("version"), "project"), "resolved_package": row, "resolved_dependency": needs[0].unionByName(needs[1]), "project": row.select(F.col("project").alias("id"), F.array("tfm").alias("tfms")).distinct()},
        "options": every.select("id", version(F.col("x")).alias("version")), "dependencies": asks, "pins": own.unionByName(every_project),
    }


@query(f"""WITH RECURSIVE {CONSOLIDATION}, why AS (SELECT asked.*, x FROM asked JOIN c USING (n) WHERE low <= x QUALIFY row_number() OVER (PARTITION BY n ORDER BY low DESC, rk, coalesce(project, ''), chain) = 1)
SELECT 'Pkg.' || lpad(c.n::VARCHAR, 2, '0') AS id, '1.' || c.x || '.0' AS version, kind, CASE WHEN kind IS NULL THEN 'The lowest version.' WHEN low = c.x THEN because || '.' ELSE 'The lowest version from 1.' || low || '.0 (' || because || ').' END AS reason
FROM c LEFT JOIN (SELECT *, CASE WHEN kind = 'transitive' THEN project || ': ' ELSE '' END || array_to_string(chain, ' → ') AS because FROM why) w ON w.n = c.n WHERE c.x IS NOT NULL""")
def consolidation_reasons(spark, d):
    return commands.deps_consolidate(**packages(spark, d))["chosen"].select("id", "version", "kind", "reason")


@query(f"""WITH RECURSIVE {CONSOLIDATION} SELECT 'Pkg.' || lpad(n::VARCHAR, 2, '0') AS id, 'pin conflict' AS code, project, array_to_string(chain, ' → ') AS chain FROM asked JOIN c USING (n) WHERE x IS NULL AND kind != 'pin' AND low > 20
QUALIFY row_number() OVER (PARTITION BY n ORDER BY low DESC, rk, coalesce(project, ''), chain) = 1""")
def consolidation_pin_conflicts(spark, d):
    return commands.deps_consolidate(**packages(spark, d))["conflicts"].select("id", "code", "project", F.array_join("chain", " → ").alias("chain"))


@query(f"""WITH RECURSIVE {CONSOLIDATION}, bad AS (SELECT t.n, t.pr, chain FROM trans t JOIN pinned USING (n, pr) WHERE low > 9 QUALIFY row_number() OVER (PARTITION BY t.n, t.pr ORDER BY low DESC, chain) = 1)
SELECT 'Pkg.' || lpad(p.n::VARCHAR, 2, '0') AS id, 'P' || p.pr AS project, CASE WHEN chain IS NOT NULL THEN 'conflict' ELSE 'below' END AS standing, '1.' || x || '.0' AS version, array_to_string(chain, ' → ') AS chain
FROM pinned p JOIN c ON c.n = p.n LEFT JOIN bad ON bad.n = p.n AND bad.pr = p.pr WHERE chain IS NOT NULL OR x > 9""")
def consolidation_pins(spark, d):
    return commands.deps_consolidate(**packages(spark, d))["pins"].select("id", "project", "standing", "version", F.array_join("chain", " → ").alias("chain"))


# ---- gateways: type t of project pr of 12

TYPES = """ty AS (SELECT p_partkey % 12 AS pr, p_partkey // 12 AS t, p_size FROM part),
e AS (SELECT DISTINCT pr, t AS a, t // 2 AS b FROM ty WHERE t > 0 UNION SELECT DISTINCT pr, t, t // 3 FROM ty WHERE t > 0 AND p_size > 25),
dirty AS (SELECT DISTINCT pr, pr % 4 AS t FROM ty),
root AS (SELECT DISTINCT pr, a AS t FROM e WHERE NOT EXISTS (SELECT 1 FROM e i WHERE i.pr = e.pr AND i.b = e.a) AND NOT EXISTS (SELECT 1 FROM dirty x WHERE x.pr = e.pr AND x.t = e.a)),
node AS (SELECT pr, a AS t FROM e UNION SELECT pr, b FROM e),
w(pr, gone, t) AS (SELECT n.pr, n.t, r.t FROM node n JOIN root r ON r.pr = n.pr AND r.t != n.t UNION SELECT w.pr, w.gone, e.b FROM w JOIN e ON e.pr = w.pr AND e.a = w.t WHERE e.b != w.gone),
u(pr, t) AS (SELECT pr, t FROM root UNION SELECT u.pr, e.b FROM u JOIN e ON e.pr = u.pr AND e.a = u.t)"""


@query(f"""WITH RECURSIVE {TYPES} SELECT n.pr AS project, n.t AS node FROM node n WHERE EXISTS (SELECT 1 FROM u JOIN dirty x ON x.pr = u.pr AND x.t = u.t WHERE u.pr = n.pr)
AND NOT EXISTS (SELECT 1 FROM w JOIN dirty x ON x.pr = w.pr AND x.t = w.t WHERE w.pr = n.pr AND w.gone = n.t)""")
def gateways(spark, d):
    """Types without which no entry point of a project reaches its taint: by dominators here, by taking each away in the SQL."""
    t = table(spark, d, "part").select((F.col("p_partkey") % 12).alias("project"), F.expr("p_partkey div 12").alias("t"), "p_size")
    e = t.filter("t > 0").select("project", F.col("t").alias("src"), F.expr("t div 2").alias("dst")).unionByName(t.filter("t > 0 AND p_size > 25").select("project", F.col("t").alias("src"), F.expr("t div 3").alias("dst")))
    named = lambda *cs: [F.col("project").cast("string")] + [F.col(c).cast("string") for c in cs]
    found = cuts.project_cuts(e.distinct().select(*named("src", "dst"), F.lit("m").alias("member")), t.select("project", (F.col("project") % 4).alias("node")).distinct().select(*named("node")))
    return found.select(F.col("project").cast("long"), F.explode("gateways").alias("node")).withColumn("node", F.col("node").cast("long")).distinct()


# ---- moves

MOVES = """f AS (SELECT p_partkey AS k, p_size FROM part), needs AS (SELECT DISTINCT k AS src, k // 2 AS dst FROM f WHERE p_size % 2 = 0 AND k // 2 != k UNION SELECT k, k // 3 FROM f WHERE p_size % 3 = 0 AND k // 3 != k),
cand(k) AS (SELECT DISTINCT k FROM f WHERE p_size >= 44 UNION SELECT dst FROM cand JOIN needs ON src = cand.k), stuck AS (SELECT DISTINCT k FROM f WHERE p_size = 6),
out(k) AS (SELECT k FROM stuck WHERE k IN (SELECT k FROM cand) UNION SELECT src FROM out JOIN needs ON dst = out.k WHERE src IN (SELECT k FROM cand)),
kept AS (SELECT k FROM cand WHERE k NOT IN (SELECT k FROM out)), go(k) AS (SELECT k FROM kept WHERE k IN (SELECT k FROM f WHERE p_size >= 44) UNION SELECT dst FROM go JOIN needs ON src = go.k JOIN kept ON kept.k = dst)"""


def move_case(spark, d) -> tuple[DataFrame, DataFrame]:
    f = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    half, third = F.expr("k div 2"), F.expr("k div 3")
    needs = f.filter((F.col("p_size") % 2 == 0) & (half != F.col("k"))).select(name(F.col("k")).alias("src"), name(half).alias("dst")).unionByName(f.filter((F.col("p_size") % 3 == 0) & (third != F.col("k"))).select(name(F.col("k")).alias("src"), name(third).alias("dst")))
    stuck = f.filter("p_size = 6").select(name(F.col("k")).alias("file"), F.lit("rule").alias("code"), F.array(F.lit("size")).alias("details")).distinct()
    return moves.move_plan(f.filter("p_size >= 44").select(name(F.col("k")).alias("file")), needs, needs.limit(0), stuck)


@query(f"WITH RECURSIVE {MOVES} SELECT k AS file, k IN (SELECT k FROM f WHERE p_size >= 44) AS requested FROM go")
def move_plan(spark, d):
    """What moves; a file that was not asked for comes for another one."""
    return move_case(spark, d)[0].select(F.col("file").cast("long").alias("file"), F.col("co_move_of").isNull().alias("requested"))


@query(f"""WITH RECURSIVE {MOVES} SELECT k AS file, CASE WHEN k IN (SELECT k FROM out) THEN 'kept back' ELSE 'not needed' END AS standing, k IN (SELECT src FROM needs JOIN out ON dst = out.k) AS for_a_need FROM cand WHERE k NOT IN (SELECT k FROM go)""")
def move_plan_stays(spark, d):
    """What stays, and whether it needs a file that stays; each reason names such a need or the file's own rule."""
    stays = move_case(spark, d)[1]
    f = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    needs = f.filter("p_size % 2 = 0").select("k", F.expr("k div 2").alias("m")).unionByName(f.filter("p_size % 3 = 0").select("k", F.expr("k div 3").alias("m"))).filter("k != m")
    out = stays.filter(F.col("code") != moves.NOT_NEEDED).select(F.col("file").cast("long").alias("o"), "code", "details")
    through = needs.join(out.select(F.col("o").alias("m"), F.lit(1).alias("x")), "m", "left_semi").select(F.col("k").alias("s")).distinct()
    told = needs.join(out.filter(F.col("code") == moves.KEPT_BACK), (F.col("k") == F.col("o")) & (F.col("m") == F.col("details")[0].try_cast("long")), "left_semi").select(F.col("k").alias("t")).distinct()
    rows = stays.select(F.col("file").cast("long").alias("file"), "code").join(through, F.col("file") == F.col("s"), "left").join(told, F.col("file") == F.col("t"), "left")
    right = (F.col("code") == moves.NOT_NEEDED) | (F.col("code") == "rule") | F.col("t").isNotNull()
    return rows.select("file", F.when(~right, "wrong reason").when(F.col("code") == moves.NOT_NEEDED, "not needed").otherwise("kept back").alias("standing"), F.col("s").isNotNull().alias("for_a_need"))


# ---- frameworks

NAMES = ["net45", "net472", "netstandard1.3", "netstandard2.0", "net6.0", "net8.0", "net8.0-windows7.0", "netcoreapp3.1", "any", ".NETFramework,Version=v4.8", "netstandard2.1"]
TARGETS = ["net48", "net8.0", "net6.0-windows10.0", "netstandard2.0"]
# the order for each target, by hand
ORDERS = {
    "net48": [".NETFramework,Version=v4.8", "net472", "net45", "netstandard2.0", "netstandard1.3", "any"],
    "net8.0": ["net8.0", "net6.0", "netcoreapp3.1", "netstandard2.1", "netstandard2.0", "netstandard1.3", "any"],
    "net6.0-windows10.0": ["net6.0", "netcoreapp3.1", "netstandard2.1", "netstandard2.0", "netstandard1.3", "any"],
    "netstandard2.0": ["netstandard2.0", "netstandard1.3", "any"],
}
ORDER = "o(target, framework, rank) AS (VALUES " + ", ".join(f"('{t}', '{n}', {k + 1})" for t, ns in ORDERS.items() for k, n in enumerate(ns)) + ")"
ASSETS = f"a AS (SELECT p_brand AS package, p_partkey % 40 AS version, p_partkey % 3 AS part, CASE WHEN p_size % 4 = 1 THEN {NAMES}[1 + (p_size + p_partkey) % 11] END AS framework FROM part), v AS (SELECT DISTINCT package, version, target FROM a, (SELECT DISTINCT target FROM o))"


def assets(spark, d) -> DataFrame:
    name = F.get(F.array(*map(F.lit, NAMES)), ((F.col("p_size") + F.col("p_partkey")) % 11).cast("int"))
    return table(spark, d, "part").select(F.col("p_brand").alias("package"), (F.col("p_partkey") % 40).alias("version"), (F.col("p_partkey") % 3).alias("part"), F.when(F.col("p_size") % 4 == 1, name).alias("framework"))


def target_names(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target string")


@query(f"""WITH {ORDER}, {ASSETS}, held AS (SELECT package, version, bool_or(part > 0 AND framework IS NOT NULL) AS own, bool_or(part = 0 AND framework IS NOT NULL) AS other FROM a GROUP BY package, version)
SELECT v.package, v.version, v.target, CASE WHEN own THEN EXISTS (SELECT 1 FROM a JOIN o ON o.framework = a.framework AND o.target = v.target WHERE a.package = v.package AND a.version = v.version AND part > 0)
  WHEN other THEN EXISTS (SELECT 1 FROM a JOIN o ON o.framework = a.framework AND o.target = v.target WHERE a.package = v.package AND a.version = v.version AND part = 0) ELSE true END AS supports FROM v JOIN held USING (package, version)""")
def framework_support(spark, d):
    """Assets decide (two thirds of the rows), or dependency groups where a version has none."""
    a = assets(spark, d)
    bare = a.withColumn("framework", F.when(F.col("part") > 0, F.col("framework")))
    return frameworks.target_support(target_names(spark), bare, a.filter("part = 0"))


@query(f"WITH {ORDER}, {ASSETS} SELECT a.package, a.version, o.target, arg_min(a.framework, rank) AS framework FROM a JOIN o USING (framework) GROUP BY a.package, a.version, o.target")
def framework_nearest(spark, d):
    a = assets(spark, d)
    wanted = a.select("package", "version").distinct().crossJoin(F.broadcast(target_names(spark)))
    return frameworks.nearest_dependencies(wanted, a.filter("framework IS NOT NULL"))


# ---- wire shapes: type k holds types k // 2 and k // 3, so that a reason comes from the types of fewer digits

SHAPES = "t AS MATERIALIZED (SELECT p_partkey AS k, p_size AS s FROM part)"
LEVEL = """a{n} AS MATERIALIZED (SELECT * FROM a{m} UNION ALL SELECT t.k, CASE WHEN s = 1 THEN 'interface' WHEN s = 2 THEN 'T' || t.k || ' has no public properties' WHEN s = 3 THEN 'T' || t.k || '.First has no public setter'
  WHEN h.why = 'interface' THEN 'T' || t.k || '.First: T' || h.k || ' is an interface' WHEN h.why IS NOT NULL THEN 'T' || t.k || '.First: ' || h.why
  WHEN s = 4 THEN 'T' || t.k || '.Second: dictionaries need string keys' WHEN r.why = 'interface' THEN 'T' || t.k || '.Second: T' || r.k || ' is an interface' WHEN r.why IS NOT NULL THEN 'T' || t.k || '.Second: ' || r.why
  WHEN s = 5 THEN 'T' || t.k || ' has events' END FROM t LEFT JOIN a{m} h ON h.k = t.k // 2 LEFT JOIN a{m} r ON r.k = t.k // 3 WHERE t.k BETWEEN {low} AND {high})"""
WIRE = ",\n".join([SHAPES, "a0 AS MATERIALIZED (SELECT k, CASE WHEN s = 1 THEN 'interface' WHEN s = 2 THEN 'T0 has no public properties' WHEN s = 3 THEN 'T0.First has no public setter' WHEN s = 4 THEN 'T0.Second: dictionaries need string keys' WHEN s = 5 THEN 'T0 has events' END AS why FROM t WHERE k = 0)"] + [LEVEL.format(n=b, m=b - 1, low=2 ** (b - 1), high=2**b - 1) for b in range(1, 22)])


@query(f"WITH {WIRE} SELECT k AS type, why FROM a21 WHERE why IS NOT NULL AND why != 'interface'")
def wire_reasons(spark, d):
    """The first reason of each type that can't cross; type 0 holds itself."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    name = lambda c: F.concat(F.lit("T"), c)
    types = t.select(name(F.col("k")).alias("type"), F.when(F.col("s") == 1, "interface").otherwise("class").alias("kind"), (F.col("s") == 5).alias("has_events"))
    held = t.filter("s != 2")
    first = held.select(name(F.col("k")).alias("type"), F.lit(1).alias("place"), F.lit("First").alias("property"), F.concat(F.lit("System.Collections.Generic.List<"), name(F.expr("k div 2")), F.lit("[]>")).alias("of"), (F.col("s") != 3).alias("settable"))
    key = F.when(F.col("s") == 4, "int").otherwise("string")
    second = held.select(name(F.col("k")).alias("type"), F.lit(2).alias("place"), F.lit("Second").alias("property"), F.concat(F.lit("System.Collections.Generic.Dictionary<"), key, F.lit(", "), name(F.expr("k div 3")), F.lit(">")).alias("of"), F.lit(True).alias("settable"))
    return wire.type_problems(types, first.unionByName(second)).select(F.substring("type", 2, 20).cast("long").alias("type"), "why")


# ---- violations through dispatch


@query(f"""WITH RECURSIVE {D}, a AS (SELECT p_partkey AS name, p_partkey + 1 AS impl FROM part WHERE p_partkey % 4 = 0),
w(start, node, path, k, hit) AS (SELECT p_partkey, p_partkey, []::BIGINT[][], 0, false FROM part
  UNION ALL SELECT start, x.too, list_append(path, [x.dst, x.turn, x.too]), k + 1, x.turn = 0 AND x.dst IN (SELECT id FROM fw) FROM w JOIN (SELECT src, dst, 0 AS turn, dst AS too FROM d UNION ALL SELECT src, dst, 1, impl FROM d JOIN a ON name = dst) x ON x.src = w.node WHERE k < 4 AND NOT hit)
SELECT start, node AS callee, array_to_string([start] || [p[3] FOR p IN path], '>') AS path FROM w WHERE hit QUALIFY row_number() OVER (PARTITION BY start ORDER BY k, path) = 1""")
def first_violations_through_dispatch(spark, d):
    p = parts(spark, d)
    aliases = p.filter("id % 4 = 0").select(F.col("id").alias("name"), (F.col("id") + 1).alias("implementation"))
    found = fixpoints.first_violation(p.select("id"), dag(spark, d), p.filter("framework_class = 'framework'").select("id"), 4, aliases)
    return found.select("start", "callee", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
