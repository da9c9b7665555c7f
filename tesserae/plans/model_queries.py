"""Model analyses over tables made from the driver's: affected projects, applications, series, symbols, whole commands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import facts, graph, reports, rules
from tesserae.plans import commands
from tesserae.plans.graph_queries import C, D, HOSTED, REACH_C, REACH_D, READY, dag, hosting, parts
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


def folders(spark, d: str) -> DataFrame:
    """(k, folder, id): every fourth part as a project file in a folder of its own below its brand."""
    p = table(spark, d, "part").filter("p_partkey % 4 = 0")
    return p.select(F.col("p_partkey").alias("k"), F.concat_ws("/", F.col("p_brand"), F.concat(F.lit("p"), F.col("p_partkey"))).alias("folder"), "p_brand").withColumn("id", F.concat("folder", F.lit("/"), F.lit("x.csproj")))


FOLDERS = """q AS (SELECT p_partkey AS k, p_brand AS brand, p_brand || '/p' || p_partkey AS folder, p_brand || '/p' || p_partkey || '/x.csproj' AS id FROM part WHERE p_partkey % 4 = 0),
paths(path) AS (SELECT upper(id) FROM q WHERE k % 40 = 0 UNION SELECT 'shared/f3.cs' UNION SELECT DISTINCT brand || '/Directory.Build.props' FROM q WHERE k % 12 = 0 UNION SELECT folder || '\\deep/y.cs' FROM q WHERE k % 28 = 0
  UNION SELECT brand FROM q WHERE k % 100 = 0 UNION SELECT 'elsewhere/none.txt' UNION SELECT 'elsewhere/global.json' UNION SELECT brand || '/notes.txt' FROM q WHERE k % 60 = 0),
pp AS (SELECT path, lower(replace(path, '\\', '/')) AS n, CASE WHEN contains(replace(path, '\\', '/'), '/') THEN regexp_replace(lower(replace(path, '\\', '/')), '/[^/]*$', '') ELSE '' END AS folder FROM paths),
l0 AS (SELECT path, id FROM pp JOIN q ON lower(id) = n), l1 AS (SELECT path, id FROM pp JOIN q ON k % 8 = 0 AND 'shared/f' || k % 10 || '.cs' = n),
wide AS (SELECT * FROM pp WHERE regexp_matches(n, '(^|/)(global\\.json|nuget\\.config|[^/]*\\.props|[^/]*\\.targets)$')), l2 AS (SELECT path, id FROM wide w JOIN q ON w.folder = '' OR starts_with(lower(id), w.folder || '/')),
l3 AS (SELECT path, id FROM pp JOIN q ON starts_with(n, lower(q.folder) || '/')), l4 AS (SELECT path, id FROM pp JOIN q ON starts_with(lower(id), n || '/')), l5 AS (SELECT path, id FROM pp JOIN q ON pp.folder = '' OR starts_with(lower(id), pp.folder || '/')),
own AS (SELECT * FROM l0 UNION SELECT * FROM l1 WHERE path NOT IN (SELECT path FROM l0) UNION SELECT * FROM l2 WHERE path NOT IN (SELECT path FROM l0 UNION SELECT path FROM l1)
  UNION SELECT * FROM l3 WHERE path NOT IN (SELECT path FROM l0 UNION SELECT path FROM l1 UNION SELECT path FROM wide) UNION SELECT * FROM l4 WHERE path NOT IN (SELECT path FROM l0 UNION SELECT path FROM l1 UNION SELECT path FROM wide UNION SELECT path FROM l3)
  UNION SELECT * FROM l5 WHERE path NOT IN (SELECT path FROM l0 UNION SELECT path FROM l1 UNION SELECT path FROM wide UNION SELECT path FROM l3 UNION SELECT path FROM l4))"""


def affected_inputs(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = folders(spark, d)
    path = lambda cond, c: q.filter(cond).select(c.alias("path"))
    made = [
        path("k % 40 = 0", F.upper("id")), path("k % 12 = 0", F.concat("p_brand", F.lit("/Directory.Build.props"))), path("k % 28 = 0", F.concat("folder", F.lit("\\deep/y.cs"))), path("k % 100 = 0", F.col("p_brand")),
        path("k % 60 = 0", F.concat("p_brand", F.lit("/notes.txt"))), spark.createDataFrame([("shared/f3.cs",), ("elsewhere/none.txt",), ("elsewhere/global.json",)], "path string"),
    ]
    compiles = q.filter("k % 8 = 0").select(F.col("id").alias("project"), F.concat(F.lit("shared/f"), F.col("k") % 10, F.lit(".cs")).alias("file"))
    return reduce(DataFrame.unionByName, made).distinct(), q.select("id", "folder"), compiles


@query(f"WITH {FOLDERS} SELECT path, id AS project FROM own")
def affected_owners(spark, d):
    return reports.affected(*affected_inputs(spark, d))


@query(f"WITH {FOLDERS}, e AS (SELECT a.id AS src, b.id AS dst FROM q a JOIN q b ON b.k = a.k // 8 * 4 WHERE a.k > 0) SELECT path, id AS project FROM own UNION SELECT path, src FROM own JOIN e ON e.dst = own.id")
def affected_with_dependents(spark, d):
    q = folders(spark, d)
    one, two = q.filter("k > 0").select(F.expr("k div 8 * 4").alias("to"), F.col("id").alias("src")), q.select("k", F.col("id").alias("dst"))
    edges = one.join(two, F.col("to") == F.col("k")).select("src", "dst")
    return reports.affected(*affected_inputs(spark, d), edges)


def application_sql(start: int) -> str:
    return f"""SELECT {start}::BIGINT AS application, count(*) AS projects, count(*) FILTER (p.id IN (SELECT id FROM fw)) AS remaining,
  CASE WHEN count(*) FILTER (p.id IN (SELECT id FROM fw)) = 0 THEN 'done' WHEN count(*) FILTER (p.id IN (SELECT id FROM fw)) = 1 AND count(*) FILTER (p.id = {start} AND p.id IN (SELECT id FROM fw)) = 1 THEN 'ready' ELSE 'blocked' END AS status,
  coalesce(string_agg(p.id::VARCHAR, ',' ORDER BY p.id) FILTER (readiness = 'ready'), '') AS next FROM st p WHERE p.id IN (SELECT node FROM a{start})"""


STARTS = [1, 19, 31, 151, 187]
WALKS = ", ".join(f"s{k}(node) AS (SELECT {k}::BIGINT UNION SELECT h.id FROM s{k} JOIN h ON h.hosted_by = s{k}.node), a{k}(node) AS (SELECT node FROM s{k} UNION SELECT d.dst FROM a{k} JOIN d ON d.src = a{k}.node)" for k in STARTS)


@query(f"WITH RECURSIVE {D}, {REACH_D}, {READY}, {HOSTED}, {WALKS} " + " UNION ALL ".join(application_sql(k) for k in STARTS))
def applications(spark, d):
    p, e, h = parts(spark, d), dag(spark, d), hosting(spark, d)
    states = graph.readiness(p, e)
    rows = reduce(DataFrame.unionByName, [reports.application(p, e, h, k, states) for k in STARTS])
    return rows.select(F.col("application").cast("long"), "projects", "remaining", "status", F.array_join("next", ",").alias("next"))


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS created_at, o_orderstatus AS solution, o_orderkey AS file, o_custkey AS loc FROM orders),
k AS (SELECT created_at, arg_max(loc, file) AS loc FROM s WHERE solution = 'O' AND created_at < '2001-06-01' AND created_at >= '1995-01-01' GROUP BY created_at), a AS (SELECT * FROM k UNION ALL SELECT '2001-06-01', 7)
SELECT created_at, loc, loc - first_value(loc) OVER (ORDER BY created_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS change FROM a""")
def series(spark, d):
    snapshots = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.col("o_orderstatus").alias("solution"), F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("loc"))
    now = spark.createDataFrame([("2001-06-01", "O", 7)], "created_at string, solution string, loc long")
    return reports.change_since_first(reports.series(snapshots, "O", "2001-06-01", "1995-01-01", now), "created_at", "loc").select("created_at", "loc", "change")


@query("""SELECT p_partkey, concat_ws(';', 'M:Lib.' || p_brand || '`1.Do``2(System.Int32)', 'M:Lib.' || p_brand || '`1.Do``2', 'M:Lib.' || p_brand || '.Do', 'T:Lib', 'T:Lib.' || p_brand, 'N:Lib', 'N:Lib.' || p_brand) AS keys FROM part""")
def symbol_keys(spark, d):
    symbol = F.concat(F.lit("M:Lib."), F.col("p_brand"), F.lit("`1.Do``2(System.Int32)"))
    return table(spark, d, "part").select("p_partkey", F.array_join(rules.symbol_keys(symbol), ";").alias("keys"))


CODE = """dc AS (SELECT p_partkey AS symbol, CASE WHEN p_partkey % 10 != 0 THEN p_partkey // 10 * 10 END AS owner, p_partkey % 50 AS file, p_size * 10 AS a, p_size * 10 + 200 AS b FROM part WHERE p_partkey % 3 != 1),
us AS (SELECT l_partkey AS symbol, l_suppkey % 50 AS file, l_orderkey % 700 AS position FROM lineitem WHERE l_quantity > 48),
dead AS (SELECT * FROM dc WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.symbol = dc.symbol AND NOT (us.file = dc.file AND position BETWEEN a AND b))),
cand AS (SELECT * FROM dead WHERE owner IS NULL OR owner NOT IN (SELECT symbol FROM dead))"""


def dead(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").filter("p_partkey % 3 != 1")
    owner = F.when(F.col("p_partkey") % 10 != 0, F.expr("p_partkey div 10 * 10"))
    declared = p.select(F.col("p_partkey").alias("symbol"), owner.alias("owner"), (F.col("p_partkey") % 50).alias("file"), (F.col("p_size") * 10).alias("begin"), (F.col("p_size") * 10 + 200).alias("end"), F.lit(True).alias("eligible"))
    uses = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("symbol"), (F.col("l_suppkey") % 50).alias("file"), (F.col("l_orderkey") % 700).alias("position"))
    return rules.dead_code(declared, uses)


@query(f"WITH {CODE} SELECT symbol FROM cand")
def dead_code(spark, d):
    return dead(spark, d).select("symbol")


@query(f"WITH {CODE} SELECT symbol, CASE WHEN symbol % 7 = 0 THEN 'low' WHEN symbol % 2 = 0 AND symbol % 5 = 0 THEN 'medium' WHEN symbol % 11 = 0 OR symbol % 13 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM cand")
def dead_code_confidence(spark, d):
    by = lambda n: F.col("symbol") % n == 0
    rows = dead(spark, d).withColumns({"low_evidence": by(7), "is_public": by(2), "shipped": by(5), "is_action": by(11), "is_friend": by(13)})
    return rules.confidence(rows).select("symbol", "confidence")


# ---- whole commands


def workspace(spark, d: str) -> dict[str, DataFrame]:
    """The tables that commands take: parts as projects, the acyclic graph as references."""
    p = parts(spark, d).withColumns({"name": F.concat(F.lit("p"), F.col("id")), "loc": F.lit(10)})
    e = dag(spark, d)
    hosts = hosting(spark, d).select(F.col("id").alias("h"), "hosted_by")
    refs = e.filter("src % 4 = 0 AND dst % 3 = 0").select(F.col("src").alias("project"), F.col("dst").alias("target"))
    usage = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.concat(F.lit("1."), F.col("p_size")).alias("version"), F.col("p_partkey").alias("project"))
    return {"project": p.join(graph.wide(hosts), F.col("id") == F.col("h"), "left").drop("h"), "edge": e, "modern_list": e.filter("src % 4 = 0").select(F.col("src").alias("project")), "modern_ref": refs, "package_usage": usage}


USED = "x AS (SELECT src, dst FROM d WHERE NOT (src % 4 = 0 AND dst % 3 != 0)), r(src, dst) AS (SELECT src, dst FROM x UNION SELECT r.src, x.dst FROM r JOIN x ON r.dst = x.src)"


@query(f"""WITH RECURSIVE {D}, {USED}, {READY}, up(src, dst) AS (SELECT src, dst FROM d UNION SELECT up.src, d.dst FROM up JOIN d ON up.dst = d.src), n AS (SELECT dst AS id, count(*) AS n FROM up WHERE src != dst GROUP BY dst)
SELECT st.id, readiness, coalesce(n, 0) AS blast_radius FROM st LEFT JOIN n USING (id) WHERE readiness = 'ready'""")
def command_plan_frontier(spark, d):
    return commands.plan(workspace(spark, d), frontier=True)[0].select("id", "readiness", "blast_radius")


@query(f"""WITH RECURSIVE {D}, n(node, k) AS (SELECT 40::BIGINT, 0 UNION SELECT d.dst, k + 1 FROM n JOIN d ON d.src = n.node WHERE k < 2), u(node, k) AS (SELECT 40::BIGINT, 0 UNION SELECT d.src, k + 1 FROM u JOIN d ON d.dst = u.node WHERE k < 2),
s AS (SELECT node FROM (SELECT node FROM n UNION SELECT node FROM u) WHERE node % 5 != 0 AND node IN (SELECT p_partkey FROM part) UNION SELECT 40)
SELECT src, dst FROM d WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)""")
def command_graph_edges(spark, d):
    return commands.graph_view(workspace(spark, d), focus=40, depth=2, exclude_kinds=("test",))["edges"].select("src", "dst")


@query(f"""WITH RECURSIVE {D}, {C}, {REACH_C}, m AS (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src), g AS (SELECT src AS node, least(src, min(dst)) AS component FROM m GROUP BY src),
k AS (SELECT component, string_agg(node::VARCHAR, ',' ORDER BY node) AS members, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM c WHERE c.src = node AND c.dst = node)) AS loop FROM g WHERE node % 5 != 0 GROUP BY component) SELECT members FROM k WHERE n > 1 OR loop""")
def command_graph_cycles(spark, d):
    from tesserae.plans.graph_queries import cyclic

    t = workspace(spark, d) | {"edge": cyclic(spark, d).withColumn("kind", F.lit("project"))}
    return commands.graph_view(t, exclude_kinds=("test",))["cycles"].select(F.array_join("members", ",").alias("members"))


@query(f"""WITH RECURSIVE {D}, a(node) AS (VALUES (40::BIGINT), (77) UNION SELECT d.dst FROM a JOIN d ON d.src = a.node), t(node) AS (SELECT src FROM d WHERE dst IN (SELECT node FROM a) AND src % 5 = 0 UNION SELECT d.dst FROM t JOIN d ON d.src = t.node)
SELECT node FROM a UNION SELECT node FROM t""")
def command_slice(spark, d):
    return commands.slice_view(workspace(spark, d), spark.createDataFrame([(40,), (77,)], "node long"), tests=True)


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 16 AND p_size > 44 THEN 'framework' ELSE 'standard' END AS c FROM part) SELECT k AS framework_class, count(p.id) AS projects, (count(p.id) * 10)::BIGINT AS loc
FROM (VALUES ('framework'), ('standard'), ('modern'), ('dual')) v(k) LEFT JOIN p ON p.c = k GROUP BY k""")
def command_report_classes(spark, d):
    # ids of text, as commands get them
    keys = {"project": ["id", "hosted_by"], "edge": ["src", "dst"], "modern_list": ["project"], "modern_ref": ["project", "target"]}
    t = {k: df.withColumns({c: F.col(c).cast("string") for c in keys.get(k, [])}) for k, df in workspace(spark, d).items()}
    return commands.report(t)["classes"]


@query("""WITH u AS (SELECT DISTINCT p_brand AS id, p_size AS v FROM part), s AS (SELECT id, bool_and(v % 3 = 0) AS ok, max(v) FILTER (v % 3 != 0) AS bad, max(v) FILTER (v % 3 = 0) AS best FROM u GROUP BY id)
SELECT id, CASE WHEN id = 'Brand#11' THEN 'unknown' WHEN ok THEN 'ok' WHEN best > bad THEN 'upgrade' WHEN id LIKE 'Brand#1%' THEN 'replace' ELSE 'blocked' END AS status, CASE WHEN id LIKE 'Brand#1%' THEN 'Other' END AS replacement FROM s""")
def command_deps_audit(spark, d):
    t = workspace(spark, d)
    support = t["package_usage"].select("id", "version").distinct().withColumns({"supports": F.substring_index("version", ".", -1).cast("int") % 3 == 0, "empty": F.lit(False)})
    known = spark.createDataFrame([("Brand#1", "Other", False)], "pattern string, replacement string, whole boolean")
    return commands.deps_audit(t, support, support.filter("id != 'Brand#11'").select("id"), known).select("id", "status", "replacement")


@query("""WITH u AS (SELECT p_brand AS project, 'f' || p_partkey % 9 AS file, p_size AS line, p_partkey AS position, p_type LIKE '%O%' AS hit FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY project, file, line ORDER BY position) AS n FROM u WHERE hit)
SELECT project, file, line, position FROM k WHERE n = 1""")
def command_audit(spark, d):
    p = table(spark, d, "part")
    symbol = F.concat(F.lit("M:Lib."), F.when(F.col("p_type").contains("O"), "Old").otherwise("New"), F.lit(".Do(System.Int32)"))
    uses = p.select(symbol.alias("symbol"), F.col("p_brand").alias("project"), F.concat(F.lit("f"), F.col("p_partkey") % 9).alias("file"), F.col("p_size").alias("line"), F.lit(1).alias("column"), F.col("p_partkey").alias("position"), F.lit("Lib").alias("namespace"))
    table_ = spark.createDataFrame([("R1", "api", "error", None, None), ("R2", "api", "none", None, None)], "rule string, pack string, severity string, below double, severity_below string")
    keys = spark.createDataFrame([("R1", "T:Lib.Old", False), ("R2", "N:Lib", False)], "rule string, key string, is_exclude boolean")
    return commands.audit(uses, table_, keys)["findings"].select("project", "file", "line", "position")


# ---- facts


@query("""WITH t AS (SELECT p_partkey AS type, CASE WHEN p_size = 1 THEN 'stream' WHEN p_size < 12 THEN 'simple' ELSE 'data' END AS kind FROM part), m AS (SELECT p_partkey AS type, p_partkey // 2 AS of FROM part WHERE p_size >= 12 AND p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_size >= 12 AND p_partkey > 0),
bad(type) AS (SELECT type FROM t WHERE kind = 'stream' UNION SELECT m.type FROM bad JOIN m ON m.of = bad.type) SELECT type, type NOT IN (SELECT type FROM bad) AS friendly FROM t""".replace("WITH t", "WITH RECURSIVE t"))
def wire_friendly(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") == 1, "stream").when(F.col("p_size") < 12, "simple").otherwise("data")
    members = dag(spark, d).join(p.filter("p_size >= 12").select("p_partkey"), F.col("src") == F.col("p_partkey")).select(F.col("src").alias("type"), F.col("dst").alias("of"))
    return facts.wire_friendly(p.select(F.col("p_partkey").alias("type"), kind.alias("kind")), members).select("type", "friendly")


@query("""WITH f AS (SELECT event_id, user_id AS project, event_type AS name, event_id % 5 AS a FROM events) SELECT event_id, CASE WHEN name = 'click' AND a = 0 THEN 'C0' WHEN name = 'view' THEN 'V' END AS rule FROM f WHERE (name = 'click' AND a = 0) OR (name = 'view' AND project NOT IN (SELECT project FROM f WHERE name = 'purchase'))""")
def fact_matchers(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("project"), F.col("event_type").alias("name"), (F.col("event_id") % 5).alias("a"))
    found = facts.matched(e, [("C0", (F.col("name") == "click") & (F.col("a") == 0)), ("V", F.col("name") == "view")])
    return facts.unless_in_project(found, "V", e.filter("name = 'purchase'")).select("event_id", "rule")


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE l_returnflag WHEN 'A' THEN 'first' WHEN 'R' THEN 'second' END, 'other') AS label FROM lineitem")
def map_lookup_default(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", facts.looked_up(F.col("l_returnflag"), {"A": "first", "R": "second"}, "other").alias("label"))


@query("""WITH t AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS x FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, chr(10))) - ends_with(x, chr(10))::INTEGER END AS n FROM t)
SELECT doc_id, (n // 3)::BIGINT AS removed, (n // 4)::BIGINT AS added FROM s""")
def line_differences(spark, d):
    """Each text against itself without every third line and with a new one after every fourth: a shortest script undoes just that."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").withColumn("x", F.regexp_replace("text", "\r\n", "\n"))
    lines = F.when(F.col("x") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("x", r"\n\z", ""), "\n", -1))
    edited = F.flatten(F.transform(lines, lambda x, i: F.concat(F.when((i + 1) % 3 != 0, F.array(x)).otherwise(F.array().cast("array<string>")), F.when((i + 1) % 4 == 0, F.array(F.concat(F.lit("\u0001new line "), i))).otherwise(F.array().cast("array<string>")))))
    after = F.when(F.size(edited) > 0, F.concat(F.array_join(edited, "\n"), F.lit("\n"))).otherwise("")
    return facts.line_differences(docs.select("doc_id", F.col("text").alias("before"), after.alias("after")), "doc_id").select("doc_id", "removed", "added")


DETECT = "f AS (SELECT p_partkey AS symbol, p_brand AS project, CASE p_size % 4 WHEN 0 THEN 'attribute' WHEN 1 THEN 'base' WHEN 2 THEN 'call' ELSE 'member' END AS shape, p_type AS name FROM part)"


@query(f"""WITH {DETECT} SELECT detector, symbol FROM (SELECT CASE WHEN shape = 'attribute' AND name LIKE '%D' THEN 'property-name' WHEN shape = 'base' AND name LIKE '%MY' THEN 'converter' WHEN shape = 'call' THEN 'settings' END AS detector, symbol FROM f) WHERE detector IS NOT NULL""")
def serializer_detectors(spark, d):
    shape = F.element_at(F.array(*map(F.lit, ["attribute", "base", "call", "member"])), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("project"), shape.alias("shape"), F.col("p_type").alias("name"))
    table_ = spark.createDataFrame([("property-name", "attribute", "%D"), ("converter", "base", "%MY"), ("settings", "call", "%")], "detector string, shape string, pattern string")
    return facts.detected(rows, table_).select("detector", "symbol")


@query("""WITH now AS (SELECT DISTINCT event_type AS code, user_id AS project, event_id % 7 AS file FROM events WHERE event_id % 2 = 0 AND event_type != 'error'), old AS (SELECT DISTINCT event_type AS code, user_id AS project, event_id % 7 AS file FROM events WHERE event_id % 3 = 0 AND event_type NOT IN ('view', 'signup')),
n AS (SELECT * FROM now EXCEPT SELECT * FROM old), f AS (SELECT * FROM old EXCEPT SELECT * FROM now), k AS (SELECT * FROM now INTERSECT SELECT * FROM old)
SELECT (SELECT count(*) FROM n) AS new, (SELECT count(*) FROM k) AS known, (SELECT count(*) FROM f) AS fixed, (SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM n WHERE code NOT IN (SELECT code FROM old)) AS new_codes, (SELECT count(*) FROM n) = 0 AS passes""")
def command_verify_verdict(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("code"), F.col("user_id").alias("project"), (F.col("event_id") % 7).alias("file"))
    found = commands.verdict(e.filter("event_id % 2 = 0 AND code != 'error'"), e.filter("event_id % 3 = 0 AND code NOT IN ('view', 'signup')"), ["code", "project", "file"])
    return found.select("new", "known", "fixed", F.array_join("new_codes", ",").alias("new_codes"), "passes")


@query("""WITH x AS (SELECT source AS project, doc_id % 50 AS file, doc_id AS region, n_chars % 10 AS lines, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS symbol FROM documents WHERE doc_id % 2 = 0)
SELECT project, count(DISTINCT file) AS files, sum(lines)::BIGINT AS lines FROM x GROUP BY project UNION ALL SELECT NULL, count(DISTINCT file), sum(lines)::BIGINT FROM x""")
def command_ifdef_report(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("project"), (F.col("doc_id") % 50).alias("file"), F.col("doc_id").alias("region"), (F.col("n_chars") % 10).alias("lines"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("symbol"))
    return commands.ifdef_report(rows, "A")


@query("""WITH k AS (SELECT lower(p_name) AS n, p_brand AS project FROM part) SELECT project, count(*) AS uses, count(DISTINCT n) AS names FROM k GROUP BY project""")
def command_gac(spark, d):
    found = commands.deps_gac(table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("name"), F.lit("framework").alias("kind")))
    return found.select("project", "uses", F.size("names").cast("long").alias("names"))


@query(f"""WITH RECURSIVE {D}, {HOSTED}, hs(src, dst) AS (SELECT hosted_by, id FROM h UNION SELECT hs.src, h.id FROM hs JOIN h ON h.hosted_by = hs.dst), s(p, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT src, dst FROM hs),
r(p, node) AS (SELECT p, node FROM s UNION SELECT r.p, d.dst FROM r JOIN d ON d.src = r.node), x AS (SELECT p AS id, node AS because, CASE WHEN p = node THEN 0 ELSE 1 END AS l FROM r JOIN fw ON fw.id = node)
SELECT id, because FROM (SELECT id, because, row_number() OVER (PARTITION BY id ORDER BY l, because) AS n FROM x WHERE id IN (SELECT p_partkey FROM part)) WHERE n = 1""")
def partial_dependency_with_hosted(spark, d):
    from tesserae.operators import selection

    p = parts(spark, d).withColumn("partial", F.col("framework_class") == "framework")
    return selection.partial_dependency(p, dag(spark, d), hosting(spark, d))
