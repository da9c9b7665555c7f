"""Documents written and read back, inputs by increments, settings in layers, and whole commands with their gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import gating, reports
from tesserae.plans import commands
from tesserae.plans.graph_queries import D, HOSTED, READY, REACH_D, dag, hosting, parts
from tesserae.plans.model_queries import STARTS, WALKS, application_sql
from tesserae.session import checkpoint_ready, table
from tesserae.sources import documents, feed, inputs, settings

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def scratch(spark, name: str) -> str:
    """A path of its own in the shared folder."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


# ---- documents


@query("""WITH g AS (SELECT CASE WHEN s_suppkey % 3 != 0 THEN 'f' || s_suppkey % 7 END AS file, CASE WHEN s_suppkey % 2 != 0 THEN s_suppkey % 5 END AS line, 'N' || s_nationkey AS code, s_name FROM supplier WHERE s_nationkey % 4 != 0)
SELECT 'result' AS list, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS place, p_partkey::VARCHAR AS key, p_name AS told FROM part
UNION ALL SELECT 'diagnostics', row_number() OVER (ORDER BY file NULLS FIRST, line NULLS FIRST, code, s_name) - 1, code, s_name FROM g""")
def envelope_round_trip(spark, d):
    p, s = table(spark, d, "part").select("p_partkey", "p_name", "p_size"), table(spark, d, "supplier")
    file, line = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("f"), F.col("s_suppkey") % 7)), F.when(F.col("s_suppkey") % 2 != 0, F.col("s_suppkey") % 5)
    severity = F.when(F.col("s_nationkey") % 4 == 0, "none").otherwise("warning")
    told = s.select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("code"), severity.alias("severity"), file.alias("file"), line.cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.col("s_name").alias("message"))
    path = scratch(spark, "envelope")
    documents.write_document(documents.envelope_lines(p, [F.desc("p_size"), F.col("p_partkey")], {"command": "parts", "version": "1"}, told), path)
    back = documents.read_envelope(spark, path, "p_partkey long, p_name string, p_size int")
    rows = back.select(F.lit("result").alias("list"), F.posexplode("result").alias("place", "x")).select("list", F.col("place").cast("long").alias("place"), F.col("x.p_partkey").cast("string").alias("key"), F.col("x.p_name").alias("told"))
    return rows.unionByName(back.select(F.lit("diagnostics").alias("list"), F.posexplode("diagnostics").alias("place", "x")).select("list", F.col("place").cast("long").alias("place"), F.col("x.code").alias("key"), F.col("x.message").alias("told")))


@query("""WITH f AS (SELECT 'R' || p_size % 4 AS rule, p_brand AS project, 'f' || p_partkey % 9 AS file, p_size AS line, (p_partkey % 7)::INTEGER AS col, 'M:' || p_partkey AS symbol, p_type AS message FROM part)
SELECT row_number() OVER (ORDER BY rule, project, file, line, col, symbol) - 1 AS place, rule, CASE rule WHEN 'R0' THEN 'error' WHEN 'R1' THEN 'warning' ELSE 'note' END AS level, project, file, line, col AS "column", symbol, message,
  CASE rule WHEN 'R0' THEN 0 WHEN 'R1' THEN 1 WHEN 'R2' THEN 2 END AS index FROM f""")
def sarif_round_trip(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size") % 4
    severity = F.when(n == 0, "error").when(n == 1, "warning").when(n == 2, "info").otherwise("hidden")
    found = p.select(
        F.concat(F.lit("R"), n).alias("rule"), F.col("p_brand").alias("project"), F.concat(F.lit("f"), F.col("p_partkey") % 9).alias("file"), F.col("p_size").alias("line"), (F.col("p_partkey") % 7).cast("int").alias("column"),
        F.concat(F.lit("M:"), F.col("p_partkey")).alias("symbol"), severity.alias("severity"), F.col("p_type").alias("message"),
    )
    ran = spark.createDataFrame([(r, f"rule {r} of parts", None, None, "info", "api", "parts") for r in ("R0", "R1", "R2", "R9")], "rule string, title string, recommendation string, help_uri string, severity string, category string, pack string")
    path = scratch(spark, "sarif")
    documents.write_document(documents.sarif_lines(found, ran, "tesserae", "1"), path)
    return documents.read_sarif(spark, path).withColumn("place", F.col("place").cast("long"))


# ---- inputs and settings


@query("""SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change, doc_id % 7 != 0 AS was_read FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 IN (0, 1)
UNION ALL SELECT 'new' || doc_id, 'added', true FROM documents WHERE doc_id % 11 = 0""")
def input_increments(spark, d):
    """A state of the documents is stored; then some are changed, some only touched, some removed and some added."""
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = lambda text, second: [F.length(text).cast("long").alias("length"), F.timestamp_seconds(second).alias("modified"), F.sha2(text, 256).alias("sha256")]
    before = docs.select(F.col("doc_id").cast("string").alias("path"), *at(F.col("text"), F.lit(1000)))
    folder = scratch(spark, "inputs")
    inputs.save_state(before, folder, 1)
    state = inputs.last_state(spark, folder)
    left = docs.filter("doc_id % 7 != 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 < 2, 2000).otherwise(1000).alias("at"))
    now = left.unionByName(docs.filter("doc_id % 11 = 0").select(F.concat(F.lit("new"), F.col("doc_id")).alias("path"), "text", F.lit(2000).alias("at"))).select("path", *at(F.col("text"), F.col("at")))
    kept = inputs.reusable(now.drop("sha256"), state)
    # only what the state doesn't know is hashed again
    fresh = kept.filter("sha256 IS NULL").drop("sha256").join(now.select("path", "sha256"), "path")
    after = kept.filter("sha256 IS NOT NULL").unionByName(fresh)
    change = inputs.staleness(state, after).withColumnRenamed("path", "__p")
    rows = state.select("path").unionByName(after.select("path")).distinct().join(change, F.col("path") == F.col("__p"), "left").join(fresh.select(F.col("path").alias("__f")), F.col("path") == F.col("__f"), "left")
    return rows.select("path", F.coalesce("change", F.lit("unchanged")).alias("change"), F.col("__f").isNotNull().alias("was_read")).filter("change != 'unchanged' OR was_read")


@query("""SELECT p_partkey, 'targetFramework' AS key, coalesce(CASE WHEN p_size % 5 = 0 AND p_size % 10 != 0 THEN 'g' END, CASE WHEN p_size % 3 = 0 THEN 'e' END, CASE WHEN p_size % 2 = 0 THEN 'f' || p_size END, 'd') AS value,
CASE WHEN p_size % 5 = 0 AND p_size % 10 != 0 THEN 'flags' WHEN p_size % 3 = 0 THEN 'environment' WHEN p_size % 2 = 0 THEN 'file' ELSE 'defaults' END AS source FROM part""")
def effective_settings(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    layer = lambda df, key, value: df.select("p_partkey", F.lit(key).alias("key"), value.cast("string").alias("value"))
    layers = [
        ("defaults", layer(p, "targetFramework", F.lit("d"))), ("file", layer(p.filter("p_size % 2 = 0"), "target-framework", F.concat(F.lit("f"), F.col("p_size")))),
        ("environment", layer(p.filter("p_size % 3 = 0"), "TARGET_FRAMEWORK", F.lit("e"))), ("flags", layer(p.filter("p_size % 5 = 0"), "targetframework", F.when(F.col("p_size") % 10 != 0, "g"))),
    ]
    return settings.effective(layers, ("p_partkey",))


# ---- a recorded feed


@query("""WITH k AS (SELECT p_brand, p_size, min(p_partkey) AS m FROM part GROUP BY 1, 2)
SELECT replace(p_brand, '#', '.') AS id, '1.' || p_size || '.0' AS version, 'net' || p_size % 3 AS framework, 'Q&' || m AS dep_id, '[1.' || p_size || ', )' AS range, 'lib/net' || p_size % 3 || '/a.dll' AS file FROM k""")
def feed_round_trip(spark, d):
    k = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("m"))
    framework = F.concat(F.lit("net"), F.col("p_size") % 3)
    need = F.struct(F.concat(F.lit("Q&"), F.col("m")).alias("id"), F.concat(F.lit("[1."), F.col("p_size"), F.lit(", )")).alias("range"))
    groups = F.array(F.struct(framework.alias("framework"), F.array(need).alias("dependencies")), F.struct(F.lit(None).cast("string").alias("framework"), F.array().cast("array<struct<id:string,`range`:string>>").alias("dependencies")))
    files = F.array(F.concat(F.lit("lib/"), framework, F.lit("/a.dll")), F.lit("readme <1>.txt"))
    path = scratch(spark, "feed")
    feed.recorded(k.select(F.replace("p_brand", F.lit("#"), F.lit(".")).alias("id"), F.concat(F.lit("1."), F.col("p_size"), F.lit(".0")).alias("version"), files.alias("files"), groups.alias("groups"))).write.parquet(path)
    read = feed.packages(spark.read.parquet(path))
    return feed.dependencies(read).join(feed.assets(read), ["id", "version", "framework"])


# ---- commands


@query(f"WITH RECURSIVE {D}, {REACH_D}, {READY}, {HOSTED}, {WALKS} " + " UNION ALL ".join(application_sql(k) for k in STARTS))
def application_report(spark, d):
    starts = table(spark, d, "part").filter(F.col("p_partkey").isin(STARTS)).select("p_partkey")
    rows = reports.application_report(parts(spark, d), dag(spark, d), hosting(spark, d), starts)
    return rows.select(F.col("application").cast("long").alias("application"), "projects", "remaining", "status", F.array_join("next", ",").alias("next"))


@query("""WITH v AS (SELECT DISTINCT p_size AS a, p_size + 8 AS b FROM part), x AS (SELECT a, b, 'one' AS "case", CASE WHEN a < 10 THEN 'x' WHEN a < 30 THEN 'y' ELSE 'x' END AS was, CASE WHEN b < 10 THEN 'x' WHEN b < 30 THEN 'y' ELSE 'x' END AS becomes FROM v
  UNION ALL SELECT a, b, 'two', CASE WHEN a >= 45 THEN 'q' END, CASE WHEN b >= 45 THEN 'q' END FROM v)
SELECT '1.' || a || '.0' AS current, '1.' || b || '.0' AS target, 'call' AS detector, "case", was, becomes FROM x WHERE was IS DISTINCT FROM becomes""")
def label_changes(spark, d):
    pairs = table(spark, d, "part").select(F.concat(F.lit("1."), F.col("p_size"), F.lit(".0")).alias("current"), F.concat(F.lit("1."), F.col("p_size") + 8, F.lit(".0")).alias("target"))
    held = [("call", "one", "1.30.0", "x"), ("call", "one", None, "x"), ("call", "one", "1.10.0", "y"), ("call", "two", "1.45.0", "q")]
    return gating.label_changes(pairs, spark.createDataFrame(held, "detector string, case string, begins string, label string"))


SCAN = """b AS (SELECT p_partkey AS symbol, p_brand AS project, replace(p_brand, 'Brand#', '')::INTEGER AS v, CASE p_size % 4 WHEN 0 THEN 'attr' WHEN 2 THEN CASE WHEN p_type LIKE '%O%' THEN 'call' END END AS detector, p_size % 2 = 0 AS reads FROM part),
s AS (SELECT * FROM b WHERE detector IS NOT NULL), w AS (SELECT symbol, [x FOR x IN [symbol, symbol // 2, symbol // 4, symbol // 8, symbol // 16] IF x % 3 = 0 AND (x > 0 OR symbol = 0)] AS good FROM s),
e AS (SELECT symbol, good[1] AS entry, CASE WHEN len(good) > 0 THEN NULL WHEN symbol // 16 >= 2 THEN 'depth exceeded' ELSE 'private' END AS reason FROM w)"""


@query(f"""WITH {SCAN} SELECT detector, project, symbol, 'names' AS "case", 'a' AS was, 'b' AS becomes, 'error' AS severity, entry, reason FROM s JOIN e USING (symbol) WHERE detector = 'attr' AND v < 25
UNION ALL SELECT detector, project, symbol, 'dates', 'd', 'c', 'info', entry, reason FROM s JOIN e USING (symbol) WHERE detector = 'call' AND v >= 20 AND v < 28
UNION ALL SELECT DISTINCT 'data', project, NULL::BIGINT, 'values', 'o', 'n', 'info', NULL::BIGINT, NULL FROM s WHERE v < 15""")
def command_serializer_scan(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size") % 4
    shape = F.when(n == 0, "attribute").when(n == 2, "call").otherwise("other")
    found = p.select(shape.alias("shape"), F.col("p_type").alias("name"), F.col("p_brand").alias("project"), F.concat(F.lit("f"), F.col("p_partkey") % 9).alias("file"), F.col("p_size").alias("line"), (F.col("p_partkey") % 7).alias("column"), F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") % 2 == 0, "read").otherwise("write").alias("direction"))
    detectors = spark.createDataFrame([("attr", "attribute", "%"), ("call", "call", "%O%")], "detector string, shape string, pattern string")
    projects = p.select(F.col("p_brand").alias("project"), F.concat(F.lit("1."), F.substring_index("p_brand", "#", -1), F.lit(".0")).alias("current"), F.lit("1.30.0").alias("target")).distinct()
    held = [("attr", "names", None, "a"), ("attr", "names", "1.25.0", "b"), ("call", "dates", None, "c"), ("call", "dates", "1.20.0", "d"), ("call", "dates", "1.28.0", "c"), ("data", "values", None, "o"), ("data", "values", "1.15.0", "n")]
    segments = spark.createDataFrame(held, "detector string, case string, begins string, label string")
    calls = p.filter("p_partkey >= 2").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    verdicts = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 3 != 0, "private").alias("reason"))
    whole = spark.createDataFrame([("data", "values", "read")], "detector string, case string, direction string")
    out = commands.serializer_scan(found, detectors, projects, segments, calls, verdicts, severities=spark.createDataFrame([("attr", "error")], "detector string, severity string"), directions=whole)
    return out["findings"].select("detector", "project", "symbol", "case", "was", "becomes", "severity", "entry", "reason")


@query("""WITH r AS (SELECT DISTINCT p_brand AS project, p_size % 12 AS n FROM part WHERE p_size % 3 != 0), u AS (SELECT p_brand AS project, p_size % 12 AS n, count(*) FILTER (p_type LIKE '%A%') AS usages FROM part WHERE p_size % 12 != 5 GROUP BY 1, 2),
t AS (SELECT p_brand AS project, bool_and(p_size % 5 IN (0, 1, 3)) AND bool_or(p_size % 5 = 1) AS fits FROM part WHERE p_size % 12 = 1 GROUP BY 1)
SELECT project, 'System.' || n AS name, CASE n WHEN 1 THEN CASE WHEN fits THEN 'builtin' ELSE 'package' END WHEN 2 THEN 'compat-pack' WHEN 4 THEN 'none' WHEN 7 THEN 'builtin' ELSE 'unknown' END AS kind,
  CASE WHEN n = 1 AND NOT fits THEN 'P1' WHEN n = 2 THEN 'C' END AS package, usages FROM r LEFT JOIN u USING (project, n) LEFT JOIN t USING (project)""")
def command_gac_report(spark, d):
    p = table(spark, d, "part").withColumns({"project": F.col("p_brand"), "name": F.concat(F.lit("System."), F.col("p_size") % 12)})
    asked = p.select("project", "name", F.when(F.col("p_size") % 3 != 0, "framework").otherwise("file").alias("kind")).distinct()
    mapping = spark.createDataFrame([("SYSTEM.1", "package", "P1"), ("System.2", "compat-pack", "C"), ("System.4", "none", None), ("System.7", "builtin", None)], "name string, kind string, package string")
    usages = p.filter("p_size % 12 != 5").groupBy("project", "name").agg(F.count_if(F.col("p_type").contains("A")).alias("n"))
    types = p.filter("p_size % 12 = 1").groupBy("project", "name").agg(F.collect_set(F.concat(F.lit("T"), F.col("p_size") % 5)).alias("types"))
    better = spark.createDataFrame([("system.1", 1, ["T0", "T1", "T3"], "T1", "builtin", None)], "name string, place int, only array<string>, needs string, kind string, package string")
    return commands.gac_report(asked, mapping, usages, better, types)["references"]
