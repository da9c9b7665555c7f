"""Rules, joins, aggregates, windows, sets and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import relational as R
from tesserae.operators import reports, rules
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


CLASS = "CASE WHEN p_size > 44 THEN 'framework' WHEN p_size > 30 THEN 'dual' WHEN p_size > 15 THEN 'modern' ELSE 'standard' END"


def projects(spark, d: str) -> DataFrame:
    """Parts as projects: an id of path form, a class by size, lines by price."""
    p = table(spark, d, "part")
    return p.select(
        F.concat_ws("/", F.lower("p_type"), F.col("p_brand"), F.concat(F.lit("p"), F.col("p_partkey"))).alias("id"), F.expr(CLASS).alias("framework_class"),
        F.floor("p_retailprice").cast("int").alias("loc"), "p_partkey", "p_brand", "p_size",
    )


P = f"p AS (SELECT lower(p_type) || '/' || p_brand || '/p' || p_partkey AS id, {CLASS} AS framework_class, floor(p_retailprice)::BIGINT AS loc, p_partkey, p_brand, p_size, lower(p_type) AS area FROM part)"
CLASSES_SQL = "k(framework_class) AS (VALUES ('framework'), ('standard'), ('modern'), ('dual'))"


@query(f"WITH {P}, {CLASSES_SQL} SELECT k.framework_class, count(id) AS projects, coalesce(sum(loc), 0)::BIGINT AS loc FROM k LEFT JOIN p USING (framework_class) GROUP BY k.framework_class")
def class_totals(spark, d):
    return reports.totals(projects(spark, d))


@query(f"WITH {P}, {CLASSES_SQL}, a AS (SELECT DISTINCT area FROM p) SELECT a.area, k.framework_class, count(id) AS projects, coalesce(sum(loc), 0)::BIGINT AS loc FROM a CROSS JOIN k LEFT JOIN p ON p.area = a.area AND p.framework_class = k.framework_class GROUP BY ALL")
def area_class_totals(spark, d):
    return reports.areas(projects(spark, d))


@query(f"""WITH {P}, s AS (SELECT count(*) AS projects, sum(loc)::BIGINT AS loc, count(*) FILTER (framework_class = 'framework') AS framework_projects, coalesce(sum(loc) FILTER (framework_class = 'framework'), 0)::BIGINT AS framework_loc FROM p)
SELECT *, coalesce(round(100.0::DOUBLE * (loc - framework_loc) / nullif(loc, 0), 1), 0)::DOUBLE AS portable_percent FROM s""")
def headline(spark, d):
    return reports.headline(projects(spark, d))


# Words stand in for symbols: a small rule list over the words of documents.
RULE_KEYS = [("R1", "the", False), ("R1", "of", True), ("R2", "la", False), ("R3", "und", False), ("R2", "que", False)]
RULE_ROWS = ", ".join(f"('{r}', '{k}', {str(x).lower()})" for r, k, x in RULE_KEYS)
LINES = "l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS s FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
USES = LINES + r", u AS (SELECT doc_id, line, list_distinct(regexp_extract_all(lower(s), '[\p{L}\p{Nd}_]+')) AS keys FROM l)"


def uses(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "s"))
    return docs.select("doc_id", (F.col("at") + 1).alias("line"), F.array_distinct(F.expr(r"regexp_extract_all(lower(s), '[\\p{L}\\p{Nd}_]+', 0)")).alias("keys"))


def rule_keys(spark) -> DataFrame:
    return spark.createDataFrame(RULE_KEYS, "rule string, key string, is_exclude boolean")


@query(f"""WITH {USES}, rk(rule, key, x) AS (VALUES {RULE_ROWS}), h AS (SELECT DISTINCT doc_id, line, rule FROM u JOIN rk ON NOT x AND list_contains(keys, key))
SELECT doc_id, line::INTEGER AS line, rule FROM h WHERE NOT EXISTS (SELECT 1 FROM rk JOIN u ON list_contains(u.keys, rk.key) WHERE rk.x AND rk.rule = h.rule AND u.doc_id = h.doc_id AND u.line = h.line)""")
def rule_match(spark, d):
    return rules.match(uses(spark, d), rule_keys(spark)).select("doc_id", "line", "rule")


@query("""WITH f AS (SELECT event_id, event_type AS rule, user_id AS project, user_id % 7 AS file, (event_id % 5)::INTEGER AS line, (event_id % 3)::INTEGER AS col, event_id % 4 AS symbol FROM events),
s AS (SELECT * FROM f WHERE rule IN ('click', 'view'))
SELECT event_id FROM f WHERE rule != 'purchase' OR NOT EXISTS (SELECT 1 FROM s WHERE s.project = f.project AND s.file = f.file AND s.line = f.line AND (s.col = f.col OR s.symbol = f.symbol))""")
def suppression(spark, d):
    e = table(spark, d, "events")
    f = e.select("event_id", F.col("event_type").alias("rule"), F.col("user_id").alias("project"), (F.col("user_id") % 7).alias("file"), (F.col("event_id") % 5).alias("line"), (F.col("event_id") % 3).alias("column"), (F.col("event_id") % 4).alias("symbol"))
    return rules.suppress(f, "purchase", ["click", "view"]).select("event_id")


@query("SELECT rule, project, line, event_id FROM (SELECT event_type AS rule, user_id AS project, event_id % 5 AS line, event_id, row_number() OVER (PARTITION BY event_type, user_id, user_id % 7, event_id % 5 ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def one_per_line(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("event_type").alias("rule"), F.col("user_id").alias("project"), (F.col("user_id") % 7).alias("file"), (F.col("event_id") % 5).alias("line"), "ts", "event_id")
    return rules.one_per_line(f, ["ts", "event_id"]).select("rule", "project", "line", "event_id")


@query("""WITH r(rule, pack, severity, below, lower_severity) AS (VALUES ('click', 'api', 'warning', 8.0, 'info'), ('view', 'api', 'error', NULL, NULL), ('purchase', 'old', 'error', NULL, NULL), ('signup', 'api', 'info', NULL, NULL)),
o(rule, severity) AS (VALUES ('signup', 'none')), a AS (SELECT r.rule, coalesce(o.severity, CASE WHEN 6.0 < below THEN lower_severity ELSE r.severity END) AS severity FROM r LEFT JOIN o USING (rule) WHERE pack != 'old')
SELECT a.rule, a.severity, count(*) AS n FROM events JOIN a ON event_type = a.rule WHERE a.severity != 'none' GROUP BY ALL""")
def severity_override(spark, d):
    r = spark.createDataFrame(
        [("click", "api", "warning", 8.0, "info"), ("view", "api", "error", None, None), ("purchase", "old", "error", None, None), ("signup", "api", "info", None, None)],
        "rule string, pack string, severity string, below double, severity_below string",
    )
    force = rules.active(r, disabled=["old"], target="6.0", overrides=spark.createDataFrame([("signup", "none")], "rule string, severity string"))
    e = table(spark, d, "events")
    return e.join(rules.small(force), e.event_type == force.rule).groupBy("rule", "severity").agg(F.count("event_id").alias("n"))


@query("SELECT event_type AS rule, count(*) AS findings, count(DISTINCT user_id) AS projects FROM events GROUP BY event_type")
def rule_summary(spark, d):
    return rules.summary(table(spark, d, "events").select(F.col("event_type").alias("rule"), F.col("user_id").alias("project")))


@query("SELECT namespace, count(*) AS count FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS namespace FROM pages) GROUP BY namespace ORDER BY count DESC, namespace LIMIT 20")
def findings_sorted_topn(spark, d):
    return rules.top_namespaces(table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("namespace")))


@query("""SELECT lang, count(DISTINCT d.doc_id) AS files, count(DISTINCT l.doc_id) AS touched, coalesce(round_even((count(DISTINCT d.doc_id) - count(DISTINCT l.doc_id))::DOUBLE / nullif(count(DISTINCT d.doc_id), 0), 3), 1.0)::DOUBLE AS portability
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 0 GROUP BY lang""")
def portability_ledger(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "lang")
    return rules.portability(files, table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("file")), "lang")


PREFIXES = [("Brand#", 0, False), ("Brand#1", 1, False), ("Brand#17", 2, True), ("Brand#2", 3, True), ("Brand#1", 4, False)]
PREFIX_ROWS = ", ".join(f"('{p}', {s}, {str(x).lower()})" for p, s, x in PREFIXES)


@query(f"""WITH x(prefix, source, whole) AS (VALUES {PREFIX_ROWS})
SELECT p_partkey, prefix, source FROM (SELECT p_partkey, prefix, source, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_brand = prefix) DESC, length(prefix) DESC, source) AS n
FROM part LEFT JOIN x ON starts_with(p_brand, prefix) AND (NOT whole OR p_brand = prefix)) WHERE n = 1""")
def longest_prefix(spark, d):
    patterns = spark.createDataFrame(PREFIXES, "prefix string, source int, whole boolean")
    return R.longest_prefix(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", patterns, "prefix", "whole", "source").select("p_partkey", "prefix", "source")


PATHS = r"q AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
OWNERS = "o AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS folder FROM q, (SELECT unnest([1, 2]) AS k) WHERE len(string_split(path, '/')) > k AND (k = 1 OR length(path) % 2 = 0))"


@query(f"""WITH {PATHS}, {OWNERS} SELECT path, folder FROM (SELECT path, folder, row_number() OVER (PARTITION BY path ORDER BY len(string_split(folder, '/')) DESC, folder) AS n
FROM q JOIN o ON starts_with(path, folder || '/')) WHERE n = 1""")
def path_owner(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    cut = lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/").alias("folder")
    long = F.size(F.split("path", "/"))
    owners = paths.filter(long > 1).select(cut(1)).unionByName(paths.filter((long > 2) & (F.length("path") % 2 == 0)).select(cut(2))).distinct()
    return R.deepest_owner(paths, "path", owners, "folder").select("path", "folder")


SEGMENTS = [(None, "s"), (10, "m"), (25, "l"), (40, "xl")]


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'xl' WHEN p_size >= 25 THEN 'l' WHEN p_size >= 10 THEN 'm' ELSE 's' END AS label FROM part")
def asof_segments(spark, d):
    segments = spark.createDataFrame(SEGMENTS, "begins int, label string")
    return R.as_of(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", segments, "begins", "label", "label").select("p_partkey", "label")


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'xl' WHEN p_size >= 25 THEN 'l' WHEN p_size >= 10 THEN 'm' ELSE 's' END AS a, CASE WHEN p_size + 8 >= 40 THEN 'xl' WHEN p_size + 8 >= 25 THEN 'l' WHEN p_size + 8 >= 10 THEN 'm' ELSE 's' END AS b FROM part)
SELECT p_partkey, a, b FROM l WHERE a != b""")
def behaviour_differs(spark, d):
    segments = spark.createDataFrame(SEGMENTS, "begins int, label string")
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size") + 8).alias("target"))
    both = R.as_of(R.as_of(p, "p_size", segments, "begins", "label", "a"), "target", segments, "begins", "label", "b")
    return both.filter("a != b").select("p_partkey", "a", "b")


@query("""WITH r(p_brand, low, high) AS (VALUES ('Brand#11', 5, NULL), ('Brand#11', NULL, 40), ('Brand#12', 20, 30), ('Brand#13', 10, NULL), ('Brand#13', 12, 45))
SELECT p_brand, min(p_size) AS chosen FROM (SELECT DISTINCT p_brand, p_size FROM part) c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.p_brand = c.p_brand AND NOT (coalesce(p_size >= low, true) AND coalesce(p_size <= high, true))) GROUP BY p_brand""")
def range_satisfy_min(spark, d):
    ranges = spark.createDataFrame([("Brand#11", 5, None), ("Brand#11", None, 40), ("Brand#12", 20, 30), ("Brand#13", 10, None), ("Brand#13", 12, 45)], "p_brand string, low int, high int")
    found = R.satisfies_all(table(spark, d, "part").select("p_brand", "p_size").distinct(), ranges, "p_brand", "p_size", "low", "high")
    return found.groupBy("p_brand").agg(F.min("p_size").alias("chosen"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) FILTER (ts = m) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def series_last_per_key(spark, d):
    return R.first_per_key(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, n, event_id FROM (SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_with_size(spark, d):
    return R.first_with_count(table(spark, d, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_type", "n", "event_id")


@query("SELECT o_orderpriority, day, n - first_value(n) OVER (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS change FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL)")
def change_since_first(spark, d):
    points = table(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("o_orderkey").alias("n"))
    return reports.change_since_first(points, "day", "n", ["o_orderpriority"]).select("o_orderpriority", "day", "change")


@query("SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, g")
def line_islands(spark, d):
    return R.islands(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""WITH a AS (SELECT o_orderkey, sha256(o_orderstatus) AS h FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 3 != 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a.h IS DISTINCT FROM b.h""")
def diff_changed_added_removed(spark, d):
    o = table(spark, d, "orders")
    before = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.sha2("o_orderstatus", 256).alias("h"))
    after = o.filter("o_orderkey % 3 != 0").select("o_orderkey", F.sha2(F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")), 256).alias("h"))
    return R.difference(before, after, "o_orderkey", "h")


@query("""WITH a AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 3 = 0)
SELECT event_type, user_id, 'known' AS standing FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'new' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'fixed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def baseline_known_new_fixed(spark, d):
    e = table(spark, d, "events")
    return R.baseline(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"), ["event_type", "user_id"])


@query(r"""WITH w AS (SELECT doc_id, i - 1 AS place, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}_]+') AS words FROM documents)))
SELECT word, (min((doc_id, place))[1])::BIGINT AS doc_id, (min((doc_id, place))[2])::INTEGER AS place FROM w GROUP BY word""")
def word_first_mention(spark, d):
    return rules.word_index(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT 'both' AS side, c_custkey AS k FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'customer', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'any', c_custkey FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")
def set_ops(spark, d):
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    side = lambda name, df: df.select(F.lit(name).alias("side"), "k")
    return side("both", c.intersect(o)).unionByName(side("customer", c.subtract(o))).unionByName(side("any", c.unionByName(o).distinct()))


@query("SELECT p_brand AS id, p_size AS version, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS projects FROM part GROUP BY p_brand, p_size")
def version_users(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_size").alias("version"), F.col("p_partkey").cast("string").alias("project"))
    return reports.package_index(rows).select("id", "version", F.array_join("projects", ",").alias("projects"))


@query("SELECT conv_id, turn, before, role FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL AND before != role")
def conversation_adjacent(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "conversations").withColumn("before", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return rows.filter("before != role").select("conv_id", "turn", "before", "role")


@query("WITH v AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag) SELECT l_suppkey, l_returnflag AS l_shipmode, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS k FROM v) WHERE k = 1")
def majority_vote(spark, d):
    votes = table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("l_shipmode"))
    return R.majority(votes, "l_suppkey", "l_shipmode").select("l_suppkey", "l_shipmode", F.col("votes").alias("n"))


@query("SELECT event_type AS code, count(*) AS errors, count(DISTINCT user_id) AS projects FROM (SELECT DISTINCT event_type, user_id, event_id % 7 AS f, event_id % 5 AS l, floor(value) AS m FROM events) GROUP BY event_type")
def error_rollup(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("code"), F.col("user_id").alias("project"), (F.col("event_id") % 7).alias("file"), (F.col("event_id") % 5).alias("line"), F.floor("value").cast("string").alias("message"))
    return reports.error_rollup(rows)[0]


@query("""WITH a AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size < 30), b AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size > 20),
x AS (SELECT 'added' AS change, n FROM (SELECT n FROM b EXCEPT SELECT n FROM a) UNION ALL SELECT 'removed', n FROM (SELECT n FROM a EXCEPT SELECT n FROM b)),
k AS (SELECT lower(p_name) AS n, min(p_brand) AS package FROM part WHERE p_size % 5 = 0 GROUP BY 1), q AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size % 2 = 0)
SELECT change, CASE WHEN package IS NOT NULL THEN 'package ' || package WHEN q.n IS NOT NULL THEN 'declared' ELSE 'unexplained' END AS reason, count(*) AS n FROM x LEFT JOIN k USING (n) LEFT JOIN q USING (n) GROUP BY 1, 2""")
def explained_diff(spark, d):
    p = table(spark, d, "part")
    name = lambda cond: p.filter(cond).select(F.col("p_name").alias("name"))
    packages = p.filter("p_size % 5 = 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("package"))
    return reports.explained_difference(name("p_size < 30"), name("p_size > 20"), packages, name("p_size % 2 = 0")).select("change", "reason", "n")


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_size < 25 AND p_name IN (SELECT p_name FROM part WHERE p_size > 40) AND p_name NOT IN (SELECT p_name FROM part WHERE p_size BETWEEN 10 AND 12)")
def moved_types(spark, d):
    p = table(spark, d, "part")
    name = lambda cond: p.filter(cond).select(F.col("p_name").alias("name"))
    return reports.moved_types(name("p_size < 25"), name("p_size BETWEEN 10 AND 12"), name("p_size > 40"))


@query("SELECT p_brand AS assembly, id, version FROM (SELECT p_brand, CASE WHEN p_size % 9 = 0 THEN lower(p_brand) ELSE p_type END AS id, p_size AS version, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 9 = 0) DESC, lower(CASE WHEN p_size % 9 = 0 THEN p_brand ELSE p_type END), p_size) AS n FROM part) WHERE n = 1")
def assembly_index(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("assembly"), F.when(F.col("p_size") % 9 == 0, F.lower("p_brand")).otherwise(F.col("p_type")).alias("id"), F.col("p_size").alias("version"))
    return reports.assembly_index(rows)


@query("""WITH x AS (SELECT source AS project, doc_id % 50 AS file, doc_id AS region, n_chars % 10 AS lines FROM documents), r AS (SELECT * FROM x UNION SELECT 'shared', file, region, lines FROM x WHERE region % 3 = 0)
SELECT project, count(DISTINCT file) AS files, sum(lines)::BIGINT AS lines FROM r GROUP BY project UNION ALL SELECT NULL, count(DISTINCT file), sum(lines)::BIGINT FROM (SELECT DISTINCT file, region, lines FROM r)""")
def directive_totals(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("project"), (F.col("doc_id") % 50).alias("file"), F.col("doc_id").alias("region"), (F.col("n_chars") % 10).alias("lines"))
    return reports.directive_totals(rows.unionByName(rows.filter("region % 3 = 0").withColumn("project", F.lit("shared"))))


@query("SELECT p_brand, p_partkey, greatest(n - 3, 0) AS n_more FROM (SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def capped_listing(spark, d):
    return R.top_per_key(table(spark, d, "part"), ["p_brand"], [F.desc("p_size"), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "n_more")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 200)::BIGINT AS chunk FROM orders")
def chunked_orders(spark, d):
    return R.chunked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 200).select("o_orderkey", "chunk")


@query("SELECT p_partkey, (CASE WHEN p_size > 25 THEN true WHEN p_size < 10 THEN false END AND p_size % 2 = 0) OR NOT (p_size % 3 = 0 AND CAST(NULL AS BOOLEAN)) AS holds FROM part")
def three_valued(spark, d):
    known = {"A": F.when(F.col("p_size") > 25, True).when(F.col("p_size") < 10, False), "B": F.col("p_size") % 2 == 0, "C": F.col("p_size") % 3 == 0}
    tree = ("or", ("and", "A", "B"), ("not", ("and", "C", "UNKNOWN")))
    return table(spark, d, "part").select("p_partkey", scalars.condition(tree, known).alias("holds"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%NOMY' THEN 'web' WHEN p_size > 40 THEN 'service' WHEN p_brand = 'Brand#11' THEN 'console' ELSE 'library' END AS kind, CASE WHEN p_type LIKE '%NOMY' THEN 'type' WHEN p_size > 40 THEN 'size' WHEN p_brand = 'Brand#11' THEN 'brand' ELSE 'none' END AS evidence FROM part")
def kind_classification(spark, d):
    found = scalars.first_match((F.col("p_type").endswith("NOMY"), "web", "type"), (F.col("p_size") > 40, "service", "size"), (F.col("p_brand") == "Brand#11", "console", "brand"), otherwise=("library", "none"))
    return table(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.kind", "f.evidence")


TFMS = ["net48", "netstandard2.0", "net8.0", "netcoreapp3.1", "odd"]


@query("SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'framework' WHEN p_size % 5 IN (0, 4) THEN CASE WHEN p_size % 7 % 5 IN (0, 4) THEN 'framework' ELSE 'dual' END WHEN p_size % 7 % 5 IN (0, 4) THEN 'dual' WHEN p_size % 5 = 1 OR p_size % 7 % 5 = 1 THEN 'standard' ELSE 'modern' END AS class FROM part")
def framework_classes(spark, d):
    names = F.array(*map(F.lit, TFMS))
    tfms = F.when(F.col("p_size") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(names, F.col("p_size") % 5), F.get(names, F.col("p_size") % 7 % 5)))
    return table(spark, d, "part").select("p_partkey", scalars.framework_class(tfms).alias("class"))


@query(f"WITH {PATHS} SELECT path, CASE WHEN len(string_split(path, '/')) <= 2 THEN '.' ELSE array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 2], '/') END AS folder FROM q")
def directory_keys(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    return paths.select("path", scalars.directory_key(F.col("path")).alias("folder"))


@query(f"WITH {PATHS} SELECT path FROM q WHERE regexp_full_match(path, '(.*/)?[^/]*[02468][^/]*') AND NOT regexp_full_match(path, '[^/]*1[^/]*/.*')")
def glob_filter(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    return paths.filter(scalars.matches_globs(F.col("path"), [f"**/*{k}*" for k in "02468"], ["*1*/**"]))


@query("""SELECT p_partkey, coalesce(a, b, c) AS answer, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END AS answer_source
FROM part LEFT JOIN (SELECT l_partkey AS k, min(l_shipmode) AS a FROM (SELECT l_partkey, l_returnflag AS l_shipmode FROM lineitem WHERE l_quantity > 45) GROUP BY 1) x ON x.k = p_partkey
LEFT JOIN (SELECT l_partkey AS k, min(l_linestatus) AS b FROM lineitem WHERE l_quantity > 20 GROUP BY 1) y ON y.k = p_partkey LEFT JOIN (SELECT s_suppkey AS k, min(s_name) AS c FROM supplier GROUP BY 1) z ON z.k = p_partkey""")
def fallback_chain(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    a = li.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("answer"))
    b = li.filter("l_quantity > 20").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linestatus").alias("answer"))
    c = s.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("answer"))
    return R.first_answer(table(spark, d, "part").select("p_partkey"), "p_partkey", [a, b, c], "answer")


@query("""WITH n AS (SELECT n_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), q AS (SELECT s_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT r_name AS k, count(DISTINCT n_name) AS n, CASE WHEN (SELECT count(*) FROM (SELECT r_name, count(DISTINCT n_name) AS c FROM n GROUP BY 1) WHERE c = (SELECT max(c) FROM (SELECT count(DISTINCT n_name) AS c FROM n GROUP BY r_name))) > 1 THEN 'tie' WHEN count(DISTINCT n_name) = (SELECT count(DISTINCT n_name) FROM n) THEN 'covers' ELSE 'largest' END AS choice
FROM n GROUP BY r_name HAVING count(DISTINCT n_name) = (SELECT max(c) FROM (SELECT count(DISTINCT n_name) AS c FROM n GROUP BY r_name))""")
def superset_choice(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    sets = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("k"), "n_name")
    return R.covering(sets, "k", "n_name")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey DESC) AS k FROM customer) WHERE k = 1")
def first_with_ties(spark, d):
    return R.first_with_ties(table(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_nationkey")]).select("c_mktsegment", "c_custkey")


@query("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) = 0 AND (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS same")
def everything_selected(spark, d):
    a = table(spark, d, "nation").select(F.col("n_regionkey").alias("k")).distinct()
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    return spark.createDataFrame([(R.same_set(a, b),)], "same boolean")


@query(f"WITH {PATHS} SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM q")
def file_stems(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    return paths.select("path", scalars.file_stem(F.col("path")).alias("stem"))


@query(r"""SELECT doc_id, code, member FROM (SELECT DISTINCT doc_id, regexp_extract(l, '^([A-Z][a-z]+): (.*)$', 1) AS code, regexp_extract(l, '^([A-Z][a-z]+): (.*)$', 2) AS member
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE code != ''""")
def text_facts(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    part = lambda i: F.regexp_extract("l", "^([A-Z][a-z]+): (.*)$", i)
    return lines.select("doc_id", part(1).alias("code"), part(2).alias("member")).filter("code != ''").distinct()
