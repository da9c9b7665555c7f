"""Graph operators over graphs derived from `part`: D is acyclic (k to k // 2 and k // 3), C adds pairs k and k + 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import cuts, fixpoints, graph
from tesserae.session import checkpoint_ready, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def parts(spark, d: str) -> DataFrame:
    """(id, framework_class, kind): part 16 and up of a large size are framework-only."""
    p = table(spark, d, "part")
    framework = (F.col("p_partkey") >= 16) & (F.col("p_size") > 44)
    kind = F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("library")
    return p.select(F.col("p_partkey").alias("id"), F.when(framework, "framework").otherwise("standard").alias("framework_class"), kind.alias("kind"))


def dag(spark, d: str) -> DataFrame:
    k = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("src"))
    return k.withColumn("dst", F.explode(F.array(F.expr("src div 2"), F.expr("src div 3")))).distinct().withColumn("kind", F.lit("project"))


def cyclic(spark, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    pairs = n.filter("k % 7 = 3").select(F.col("k").alias("src"), (F.col("k") + 1).alias("dst"))
    pairs = pairs.join(graph.wide(n), F.col("dst") == F.col("k"), "left_semi")
    return dag(spark, d).select("src", "dst").unionByName(pairs).unionByName(graph.reverse(pairs)).distinct()


D = """d AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0),
fw AS (SELECT p_partkey AS id FROM part WHERE p_partkey >= 16 AND p_size > 44)"""
C = """pr AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 7 = 3),
c AS (SELECT * FROM d UNION SELECT * FROM pr UNION SELECT dst, src FROM pr)"""
REACH = "r(src, dst) AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM r JOIN {e} e ON r.dst = e.src)"
REACH_D, REACH_C = REACH.format(e="d"), REACH.format(e="c")


@query(f"WITH RECURSIVE {D}, {REACH_D} SELECT src, dst FROM r WHERE src != dst")
def closure_dag(spark, d):
    return graph.closure(dag(spark, d))


@query(f"WITH RECURSIVE {D}, {C}, {REACH_C}, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src != a.dst) SELECT src AS node, least(src, min(dst)) AS component FROM m GROUP BY src")
def scc_pairs(spark, d):
    return graph.scc(cyclic(spark, d))


@query(f"WITH RECURSIVE {D}, {C}, {REACH_C}, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src), g AS (SELECT src AS node, least(src, min(dst)) AS component FROM m GROUP BY src) SELECT component, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM g GROUP BY component")
def cycle_members(spark, d):
    return graph.cycles(cyclic(spark, d)).select("component", F.array_join("members", ",").alias("members"))


READY = """st AS (SELECT p_partkey AS id, CASE WHEN EXISTS (SELECT 1 FROM r JOIN fw ON r.dst = fw.id WHERE r.src = p_partkey AND r.src != r.dst) THEN 'blocked'
  WHEN p_partkey IN (SELECT id FROM fw) THEN 'ready' ELSE 'done' END AS readiness FROM part)"""


@query(f"WITH RECURSIVE {D}, {REACH_D}, {READY} SELECT id, readiness FROM st")
def readiness(spark, d):
    return graph.readiness(parts(spark, d), dag(spark, d))


@query(f"""WITH RECURSIVE {D}, {REACH_D}, {READY}, b AS (SELECT src AS id, dst AS blocker FROM r JOIN fw ON r.dst = fw.id),
w(id, wave) AS (SELECT id, CASE WHEN readiness = 'done' THEN 0 ELSE 1 END FROM st UNION SELECT b.id, w.wave + 1 FROM w JOIN b ON b.blocker = w.id WHERE w.wave > 0)
SELECT id, max(wave)::INTEGER AS wave FROM w GROUP BY id""")
def waves(spark, d):
    return graph.waves(parts(spark, d), dag(spark, d))


@query(f"""WITH RECURSIVE {D}, {REACH_D}, {READY}, b AS (SELECT src AS id, dst AS blocker FROM r JOIN fw ON r.dst = fw.id),
w(id, wave) AS (SELECT id, CASE WHEN readiness = 'done' THEN 0 ELSE 1 END FROM st UNION SELECT b.id, w.wave + 1 FROM w JOIN b ON b.blocker = w.id WHERE w.wave > 0),
up AS (SELECT dst AS id, count(DISTINCT src) AS n FROM r WHERE src != dst GROUP BY dst)
SELECT st.id, readiness, max(wave)::INTEGER AS wave, coalesce(max(n), 0) AS blast_radius FROM st JOIN w USING (id) LEFT JOIN up USING (id) GROUP BY st.id, readiness HAVING st.id % 5 != 0""")
def plan_without_tests(spark, d):
    return graph.plan(parts(spark, d), dag(spark, d), exclude_kinds=("test",)).select("id", "readiness", "wave", "blast_radius")


@query(f"""WITH RECURSIVE {D}, {REACH_D}, {READY}, b AS (SELECT src AS id, dst AS blocker FROM r JOIN fw ON r.dst = fw.id),
w(id, wave) AS (SELECT id, CASE WHEN readiness = 'done' THEN 0 ELSE 1 END FROM st UNION SELECT b.id, w.wave + 1 FROM w JOIN b ON b.blocker = w.id WHERE w.wave > 0)
SELECT count(DISTINCT st.id) AS projects, count(DISTINCT st.id) FILTER (readiness = 'done') AS done, count(DISTINCT st.id) FILTER (readiness = 'ready') AS ready, count(DISTINCT st.id) FILTER (readiness = 'blocked') AS blocked, coalesce(max(wave), 0)::INTEGER AS waves FROM st JOIN w USING (id)""")
def plan_counts(spark, d):
    e, p = dag(spark, d), parts(spark, d)
    return graph.plan_counts(graph.standings(p, e))


@query(f"""WITH RECURSIVE {D}, n(node, k) AS (SELECT 40::BIGINT, 0 UNION SELECT d.dst, k + 1 FROM n JOIN d ON d.src = n.node WHERE k < 2),
u(node, k) AS (SELECT 40::BIGINT, 0 UNION SELECT d.src, k + 1 FROM u JOIN d ON d.dst = u.node WHERE k < 2) SELECT node FROM n UNION SELECT node FROM u""")
def neighbourhood_depth2(spark, d):
    return graph.neighbourhood(dag(spark, d), spark.range(40, 41), 2)


@query(f"""WITH RECURSIVE {D}, q(node) AS (VALUES (40::BIGINT), (77)), a(node) AS (SELECT node FROM q UNION SELECT d.dst FROM a JOIN d ON d.src = a.node),
up(node) AS (SELECT node FROM q UNION SELECT d.src FROM up JOIN d ON d.dst = up.node), b(node) AS (SELECT node FROM up UNION SELECT d.dst FROM b JOIN d ON d.src = b.node),
ab AS (SELECT node FROM a UNION SELECT node FROM b), t(node) AS (SELECT src FROM d WHERE dst IN (SELECT node FROM ab) AND src % 5 = 0 UNION SELECT d.dst FROM t JOIN d ON d.src = t.node)
SELECT node FROM ab UNION SELECT node FROM t""")
def slice_closure(spark, d):
    asked = spark.createDataFrame([(40,), (77,)], "node long")
    return graph.slice_closure(parts(spark, d), dag(spark, d), asked, dependents=True, tests=True)


@query(f"WITH RECURSIVE {D}, {REACH_D} SELECT dst AS blocker, count(*) AS n FROM r JOIN fw ON r.dst = fw.id WHERE r.src IN (SELECT p_partkey FROM part) GROUP BY dst ORDER BY n DESC, dst LIMIT 10")
def top_blockers(spark, d):
    return graph.blocked_counts(parts(spark, d), dag(spark, d)).orderBy(F.desc("n"), "blocker").limit(10)


@query(f"WITH {D} SELECT src, dst FROM d WHERE src NOT IN (SELECT id FROM fw) AND dst IN (SELECT id FROM fw)")
def framework_refs(spark, d):
    return graph.framework_references(parts(spark, d), dag(spark, d)).select("src", "dst")


@query("""WITH p AS (SELECT s_suppkey AS id, lower(substr(s_name, 1, length(s_name) - (s_suppkey % 2)::INTEGER)) AS name FROM supplier),
o AS (SELECT name, min(id) AS owner FROM p GROUP BY name HAVING count(*) = 1)
SELECT s_suppkey AS src, s_nationkey::BIGINT AS dst, 'project' AS kind FROM supplier WHERE s_nationkey IN (SELECT id FROM p)
UNION SELECT s_suppkey + 1, owner, 'assembly' FROM supplier JOIN o ON lower(s_name) = name WHERE owner != s_suppkey + 1""")
def edge_derivation(spark, d):
    s = table(spark, d, "supplier")
    projects = s.select(F.col("s_suppkey").alias("id"), F.expr("substr(s_name, 1, length(s_name) - cast(s_suppkey % 2 AS int))").alias("assembly_name"))
    references = s.select(F.col("s_suppkey").alias("project"), F.col("s_nationkey").cast("long").alias("target"))
    hints = s.select((F.col("s_suppkey") + 1).alias("project"), F.col("s_name").alias("stem"))
    return graph.derive_edges(references, hints, projects)


@query(f"WITH {D} SELECT src, dst FROM d WHERE NOT (src % 4 = 0 AND dst % 3 != 0)")
def used_edges(spark, d):
    e = dag(spark, d)
    lists = e.filter("src % 4 = 0").select(F.col("src").alias("project"))
    refs = e.filter("src % 4 = 0 AND dst % 3 = 0").select(F.col("src").alias("project"), F.col("dst").alias("target"))
    return graph.used_edges(e, lists, refs).select("src", "dst")


HOSTED = "h AS (SELECT p_partkey AS id, p_partkey // 10 AS hosted_by FROM part WHERE p_partkey % 10 = 1 AND p_partkey > 10)"


@query(f"WITH RECURSIVE {HOSTED}, r(src, dst) AS (SELECT hosted_by, id FROM h UNION SELECT r.src, h.id FROM r JOIN h ON h.hosted_by = r.dst) SELECT src, dst FROM r WHERE src != dst")
def hosted_projects(spark, d):
    return graph.hosted_projects(hosting(spark, d))


def hosting(spark, d):
    return table(spark, d, "part").filter("p_partkey % 10 = 1 AND p_partkey > 10").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 10").alias("hosted_by"))


@query(f"""WITH RECURSIVE {D}, {HOSTED}, s(node) AS (SELECT 1::BIGINT UNION SELECT h.id FROM s JOIN h ON h.hosted_by = s.node),
a(node) AS (SELECT node FROM s UNION SELECT d.dst FROM a JOIN d ON d.src = a.node) SELECT node FROM a""")
def application_closure(spark, d):
    return graph.application_closure(dag(spark, d), hosting(spark, d), 1)


@query(f"""WITH RECURSIVE {D}, a(node, label) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 50 = 49 UNION SELECT d.dst, label FROM a JOIN d ON d.src = a.node)
SELECT node, min(label) AS label FROM a GROUP BY node""")
def least_application(spark, d):
    seeds = table(spark, d, "part").filter("p_partkey % 50 = 49").select("p_partkey")
    return graph.least_label(dag(spark, d), seeds)


@query(f"WITH RECURSIVE {D}, l(node, k) AS (SELECT dst, 0 FROM d WHERE dst NOT IN (SELECT src FROM d) UNION SELECT d.src, k + 1 FROM l JOIN d ON d.dst = l.node) SELECT node, max(k)::INTEGER AS level FROM l GROUP BY node")
def leaf_first_levels(spark, d):
    return graph.levels(dag(spark, d))


@query(f"""WITH RECURSIVE {D}, {C}, w(node, k) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 97 = 96 UNION SELECT c.dst, k + 1 FROM w JOIN c ON c.src = w.node WHERE k < 30)
SELECT node, min(k)::INTEGER AS distance FROM w GROUP BY node""")
def distances(spark, d):
    return graph.distances(cyclic(spark, d), table(spark, d, "part").filter("p_partkey % 97 = 96").select("p_partkey"))


@query(f"""WITH RECURSIVE {D}, {C}, {REACH_C}, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src),
s(node) AS (SELECT p_partkey FROM part WHERE p_partkey IN (20, 31, 45) UNION SELECT x FROM (SELECT c.src AS x, c.dst AS y FROM c UNION ALL SELECT m.src, m.dst FROM m) e JOIN s ON e.y = s.node)
SELECT node FROM s""")
def taint(spark, d):
    e = cyclic(spark, d)
    seeds = table(spark, d, "part").filter("p_partkey IN (20, 31, 45)").select("p_partkey")
    return fixpoints.taint(seeds, e, graph.scc(e))


@query(f"""WITH RECURSIVE {D}, tests AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 0 AND p_partkey >= 100),
cand AS (SELECT p_partkey AS id FROM part WHERE p_size > 3 AND p_partkey >= 20 AND p_partkey NOT IN (SELECT id FROM tests) AND p_partkey IN (SELECT dst FROM d)),
gone(id) AS (SELECT DISTINCT c.id FROM cand c JOIN d ON d.dst = c.id WHERE d.src NOT IN (SELECT id FROM tests) AND d.src NOT IN (SELECT id FROM cand)
  UNION SELECT c.id FROM gone g JOIN d ON d.src = g.id JOIN cand c ON c.id = d.dst),
kept AS (SELECT id FROM cand WHERE id NOT IN (SELECT id FROM gone)),
reached(id) AS (SELECT id FROM tests UNION SELECT d.dst FROM reached JOIN d ON d.src = reached.id WHERE d.dst IN (SELECT id FROM kept))
SELECT id AS node FROM kept WHERE id IN (SELECT id FROM reached)""")
def fixpoint_helpers(spark, d):
    p = table(spark, d, "part")
    tests = p.filter("p_partkey % 5 = 0 AND p_partkey >= 100").select("p_partkey")
    candidates = p.filter("p_size > 3 AND p_partkey >= 20").select("p_partkey")
    return fixpoints.helpers(candidates, dag(spark, d).select("src", "dst"), tests)


@query(f"""WITH RECURSIVE {D}, w(node, k) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 100 = 99 UNION SELECT d.dst, k + 1 FROM w JOIN d ON d.src = w.node WHERE k < 3)
SELECT node, min(k)::INTEGER AS distance FROM w GROUP BY node""")
def payload_closure(spark, d):
    return fixpoints.extended(table(spark, d, "part").filter("p_partkey % 100 = 99").select("p_partkey"), dag(spark, d), 3)


@query(f"WITH RECURSIVE {D}, {C}, {REACH_C} SELECT src AS node FROM r WHERE src = dst")
def self_reaching(spark, d):
    return fixpoints.self_reaching(cyclic(spark, d))


@query(f"WITH RECURSIVE {D}, w(s, node, k) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT s, d.dst, k + 1 FROM w JOIN d ON d.src = w.node WHERE k < 2) SELECT DISTINCT s AS start FROM w JOIN fw ON w.node = fw.id WHERE k > 0")
def reaches_within_2(spark, d):
    p = parts(spark, d)
    return fixpoints.reaches_within(p.select("id"), dag(spark, d), p.filter("framework_class = 'framework'").select("id"), 2)


@query(f"""WITH RECURSIVE {D}, e AS (SELECT p_partkey AS g FROM part WHERE p_partkey % 11 = 0),
w(start, node, path, k) AS (SELECT p_partkey, p_partkey, [p_partkey], 0 FROM part
  UNION ALL SELECT start, d.src, list_append(path, d.src), k + 1 FROM w JOIN d ON d.dst = w.node WHERE k < 4),
f AS (SELECT start, node, path, k, row_number() OVER (PARTITION BY start ORDER BY k, path) AS n FROM w JOIN e ON w.node = e.g)
SELECT start, node AS entry, array_to_string(path, '>') AS path FROM f WHERE n = 1""")
def nearest_entry(spark, d):
    p = table(spark, d, "part")
    found = fixpoints.nearest_entry(p.select("p_partkey"), dag(spark, d), p.filter("p_partkey % 11 = 0").select("p_partkey"))
    return found.select("start", "entry", F.array_join("path", ">").alias("path"))


@query(f"WITH {D}, a AS (SELECT p_partkey AS name, p_partkey + 1 AS implementation FROM part WHERE p_partkey % 4 = 0) SELECT src AS caller, dst AS callee FROM d UNION SELECT src, implementation FROM d JOIN a ON d.dst = a.name")
def calls_through_aliases(spark, d):
    calls = dag(spark, d).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    aliases = table(spark, d, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") + 1).alias("implementation"))
    return fixpoints.callers_through_aliases(calls, aliases)


@query()
def seam_cuts(spark, d):
    p = table(spark, d, "part").select(F.expr("p_brand").alias("project"), "p_partkey", "p_size")
    e = p.filter("p_partkey > 0").select("project", F.col("p_partkey").cast("string").alias("src"), F.explode(F.array(F.expr("cast(p_partkey div 2 AS string)"), F.expr("cast(p_partkey div 3 AS string)"))).alias("dst"), F.col("p_size").cast("string").alias("member"))
    clean = p.filter("p_size < 20").select("project", F.col("p_partkey").cast("string").alias("node"))
    dirty = p.select("project", F.expr("cast(p_partkey div 2 AS string)").alias("node")).filter("cast(node AS long) % 9 = 4")
    return cuts.seam_cuts(e, clean, dirty)


@query("""SELECT p_partkey AS boundary, round_even(CASE WHEN members = 0 THEN 1.0 ELSE friendly END / (1 + 0.1 * greatest(0, members - 1)) * CASE WHEN art THEN 1.0 ELSE 0.8 END, 2)::DOUBLE AS score,
'seam-' || row_number() OVER (ORDER BY p_size, members DESC, friendly DESC, p_partkey) AS seam FROM (SELECT p_partkey, p_size, (p_partkey % 5 / 4.0)::DOUBLE AS friendly, (p_size % 6)::BIGINT AS members, p_partkey % 2 = 0 AS art FROM part)""")
def seam_scores(spark, d):
    from tesserae.operators.relational import numbered

    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("boundary"), "p_size", (F.col("p_partkey") % 5 / 4.0).alias("friendly"), (F.col("p_size") % 6).cast("long").alias("members"), (F.col("p_partkey") % 2 == 0).alias("art"))
    rows = rows.withColumn("score", cuts.seam_score(F.col("friendly"), F.col("members"), F.col("art")))
    ordered = numbered(rows, [F.col("p_size"), F.desc("members"), F.desc("friendly"), F.col("boundary")])
    return ordered.select("boundary", "score", F.concat(F.lit("seam-"), F.col("n")).alias("seam"))


USED_C = "u AS (SELECT src, dst FROM c WHERE NOT (src % 4 = 0 AND dst % 3 != 0))"


@query(f"""WITH RECURSIVE {D}, {C}, {USED_C}, {REACH_C}, ru(src, dst) AS (SELECT src, dst FROM u UNION SELECT ru.src, u.dst FROM ru JOIN u ON ru.dst = u.src),
m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src), b AS (SELECT src AS id, dst AS blocker FROM ru JOIN fw ON dst = fw.id WHERE src != dst),
st AS (SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT id FROM b) THEN 1 WHEN p_partkey IN (SELECT id FROM fw) THEN 1 ELSE 0 END AS k FROM part),
n AS (SELECT b.id, b.blocker FROM b ANTI JOIN m ON m.src = b.id AND m.dst = b.blocker), w(id, wave) AS (SELECT id, k FROM st UNION SELECT n.id, w.wave + 1 FROM w JOIN n ON n.blocker = w.id WHERE w.wave > 0)
SELECT w.id, max(wave)::INTEGER AS wave, w.id IN (SELECT src FROM m WHERE src != dst) AS in_cycle FROM w WHERE w.id IN (SELECT id FROM st) GROUP BY w.id""")
def plan_with_unused_edges_in_cycles(spark, d):
    e = cyclic(spark, d).withColumn("kind", F.lit("project"))
    return graph.plan(parts(spark, d), e, e.filter("NOT (src % 4 = 0 AND dst % 3 != 0)")).select("id", "wave", "in_cycle")


@query(f"""WITH RECURSIVE {D}, w(path, node) AS (SELECT [150::BIGINT], 150::BIGINT UNION ALL SELECT list_append(path, d.dst), d.dst FROM w JOIN d ON d.src = w.node)
SELECT array_to_string(path, '>') AS path FROM w WHERE node = 1 ORDER BY len(path), w.path LIMIT 1""")
def shortest_path(spark, d):
    found = graph.shortest_path(dag(spark, d), 150, 1)
    return spark.createDataFrame([(">".join(map(str, found)),)], "path string")


@query(f"""WITH RECURSIVE {D}, {C}, {REACH_C}, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src != a.dst), g AS (SELECT src AS node, least(src, min(dst)) AS component FROM m GROUP BY src),
e AS (SELECT c.src, c.dst, g.component FROM c JOIN g ON g.node = c.src JOIN g h ON h.node = c.dst AND h.component = g.component)
SELECT component, count(*) AS ways FROM e WHERE src = component OR dst = component GROUP BY component""")
def cycle_paths(spark, d):
    """A way round each cycle is told by its length; here by how many edges touch the first member, which every way uses two of."""
    e = cyclic(spark, d)
    checkpoint_ready(spark)
    of = graph.scc(e).checkpoint()
    inner = e.join(graph.wide(of.select(F.col("node").alias("a"), "component")), F.col("src") == F.col("a")).join(graph.wide(of.select(F.col("node").alias("b"), F.col("component").alias("c2"))), F.col("dst") == F.col("b")).filter("component = c2")
    told = graph.ways_round(e, of).filter((F.element_at("path", 1) == F.col("component")) & (F.element_at("path", -1) == F.col("component")) & (F.size("path") > 2))
    touching = inner.filter("src = component OR dst = component").groupBy("component").agg(F.count("src").alias("ways"))
    return touching.join(graph.wide(told.select(F.col("component").alias("t"))), F.col("component") == F.col("t"), "left_semi")


@query(f"WITH RECURSIVE {D}, l(node, k) AS (SELECT dst, 0 FROM d WHERE dst NOT IN (SELECT src FROM d) UNION SELECT d.src, k + 1 FROM l JOIN d ON d.dst = l.node) SELECT count(DISTINCT node) AS nodes, 0::BIGINT AS before_its_needs FROM l")
def leaf_first(spark, d):
    """The order itself has ties that no SQL here tells; the query tells its size and how many edges point forward in it, of which there must be none."""
    e = dag(spark, d)
    checkpoint_ready(spark)
    place = graph.leaf_first_places(e, e.select("src")).checkpoint()
    a, b = place.select(F.col("place").alias("ps"), F.col("node").alias("ns")), place.select(F.col("place").alias("pd"), F.col("node").alias("nd"))
    late = e.join(graph.wide(a), F.col("src") == F.col("ns")).join(graph.wide(b), F.col("dst") == F.col("nd")).filter("src != dst").agg(F.count_if(F.col("pd") > F.col("ps")).alias("before_its_needs"))
    return late.withColumn("nodes", F.lit(place.count()))
