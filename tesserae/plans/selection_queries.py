"""Votes, fallbacks, folds and nearest matches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import selection as S
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


def paths(spark, d):
    return table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()


PATHS = r"q AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


@query("""WITH pr(target, framework, rank) AS (VALUES ('t', 'STANDARD', 2), ('t', 'PROMO', 1), ('t', 'SMALL', 3), ('u', 'SMALL', 1), ('u', 'LARGE', 1)), g AS (SELECT DISTINCT p_brand AS package, upper(split_part(p_type, ' ', 1)) AS framework FROM part WHERE p_size < 20)
SELECT package, target, framework FROM (SELECT package, target, framework, row_number() OVER (PARTITION BY package, target ORDER BY rank, framework) AS n FROM g JOIN pr USING (framework)) WHERE n = 1""")
def nearest_group(spark, d):
    p = spark.createDataFrame([("t", "STANDARD", 2), ("t", "PROMO", 1), ("t", "SMALL", 3), ("u", "SMALL", 1), ("u", "LARGE", 1)], "target string, framework string, rank int")
    groups = table(spark, d, "part").filter("p_size < 20").select(F.col("p_brand").alias("package"), F.upper(F.substring_index("p_type", " ", 1)).alias("framework")).distinct()
    wanted = groups.select("package").distinct().withColumn("target", F.explode(F.array(F.lit("t"), F.lit("u"))))
    return S.nearest_group(wanted, groups, p)


@query(rf"WITH {PATHS}, v AS (SELECT CASE WHEN length(path) % 3 = 0 THEN '/build/a' ELSE '/home/x' END AS prefix FROM q) SELECT prefix, count(*) AS votes FROM v GROUP BY prefix ORDER BY votes DESC, prefix LIMIT 1")
def path_prefix_vote(spark, d):
    files = paths(spark, d)
    logged = files.select(F.concat(F.when(F.length("path") % 3 == 0, "/build/a/").otherwise("/home/x/"), "path").alias("path"))
    return S.path_prefix(logged, files)


@query(rf"""WITH {PATHS}, f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') AS folder FROM q WHERE path LIKE '%/%'), m AS (SELECT folder FROM f WHERE length(folder) % 2 = 0 UNION SELECT split_part(folder, '/', 1) FROM f)
SELECT f.folder, arg_max(m.folder, length(m.folder)) AS mark FROM f JOIN m ON f.folder = m.folder OR starts_with(f.folder, m.folder || '/') GROUP BY f.folder""")
def governing_folder(spark, d):
    parts = F.split("path", "/")
    folders = paths(spark, d).filter("path LIKE '%/%'").select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder")).distinct()
    marks = folders.filter(F.length("folder") % 2 == 0).unionByName(folders.select(F.substring_index("folder", "/", 1).alias("folder"))).distinct()
    return S.governing(folders, marks)


@query(rf"""WITH {PATHS}, i AS (SELECT DISTINCT CASE WHEN length(path) % 3 = 0 THEN upper(x) ELSE x END AS id FROM (SELECT path, regexp_replace(path, '^[^/]*/', '') AS x FROM q))
SELECT id FROM i WHERE starts_with(lower(id), 'fr/') AND lower(id) NOT IN (SELECT lower(id) FROM i WHERE length(id) % 2 = 0)""")
def below_but_missing(spark, d):
    rest = F.regexp_replace("path", "^[^/]*/", "")
    on_disk = paths(spark, d).select(F.when(F.length("path") % 3 == 0, F.upper(rest)).otherwise(rest).alias("id")).distinct()
    return S.below_but_missing(on_disk, on_disk.filter(F.length("id") % 2 == 0), "fr")


@query("""SELECT DISTINCT p_brand AS source, target, origin FROM (SELECT DISTINCT p_brand, CASE WHEN p_brand = 'Brand#11' THEN 'one' WHEN p_brand LIKE 'Brand#2%' THEN p_brand || '.Modern' ELSE p_type END AS target, CASE WHEN p_brand = 'Brand#11' OR p_brand LIKE 'Brand#2%' THEN 'map' ELSE 'reference' END AS origin, p_type FROM part WHERE p_size > 10)
WHERE origin = 'map' OR p_type LIKE '%S%'""")
def priority_mapping(spark, d):
    p = table(spark, d, "part").filter("p_size > 10")
    sources = p.select(F.col("p_brand").alias("source")).distinct()
    references = p.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).distinct()
    return S.priority_mapping(sources, [("Brand#11", "one"), ("Brand#2*", "{name}.Modern")], references, references.filter("target LIKE '%S%'").select("target"))


@query("""WITH r AS (SELECT p_brand AS name, 0 AS level, p_size AS place, p_type AS id FROM part WHERE p_size < 6 UNION ALL SELECT p_brand, 1, p_size, upper(p_type) FROM part WHERE p_size BETWEEN 6 AND 12 UNION ALL SELECT DISTINCT p_brand, 2, 0, p_brand FROM part),
f AS (SELECT name, level, place, id, row_number() OVER (PARTITION BY name, lower(id) ORDER BY level, place, id) AS n FROM r)
SELECT name, (row_number() OVER (PARTITION BY name ORDER BY level, place, id) - 1)::INTEGER AS place, id FROM f WHERE n = 1""")
def ordered_candidates(spark, d):
    p = table(spark, d, "part")
    row = lambda cond, id_: p.filter(cond).select(F.col("p_brand").alias("name"), F.col("p_size").alias("place"), id_.alias("id"))
    return S.ordered_candidates(p.select(F.col("p_brand").alias("name")).distinct(), row("p_size < 6", F.col("p_type")), row("p_size BETWEEN 6 AND 12", F.upper("p_type")))


@query("SELECT p_brand AS project, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tfms, count(DISTINCT p_name) AS sources, count(DISTINCT p_size) AS refs FROM part GROUP BY p_brand")
def group_to_entity(spark, d):
    calls = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_type").alias("tfm"), F.col("p_name").alias("source"), F.col("p_size").alias("reference"))
    return S.entities(calls).select("project", F.array_join("tfms", ",").alias("tfms"), F.size("sources").cast("long").alias("sources"), F.size("references").cast("long").alias("refs"))


@query("""SELECT project, cause, file FROM (SELECT p_brand AS project, cause, p_name AS file, row_number() OVER (PARTITION BY p_brand ORDER BY rk, p_partkey) AS n FROM
(SELECT *, CASE WHEN p_size = 1 THEN 'none' WHEN p_size < 5 THEN 'late' WHEN p_type LIKE '%S%' THEN 'other' END AS cause, CASE WHEN p_size = 1 THEN 1 WHEN p_size < 5 THEN 2 ELSE 3 END AS rk FROM part) WHERE cause IS NOT NULL) WHERE n = 1""")
def first_cause(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("file"), F.col("p_partkey").alias("import_order"), "p_size", "p_type")
    return S.first_cause(rows, [("none", F.col("p_size") == 1), ("late", F.col("p_size") < 5), ("other", F.col("p_type").contains("S"))])


@query(rf"WITH {PATHS}, a AS (SELECT CASE WHEN length(path) % 2 = 0 THEN upper(path) ELSE path END AS p FROM q) SELECT p AS path, min(path) AS found FROM a JOIN q ON lower(p) = lower(path) WHERE p NOT IN (SELECT path FROM q) GROUP BY p")
def case_mismatch(spark, d):
    files = paths(spark, d)
    return S.case_mismatches(files.select(F.when(F.length("path") % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("path")), files)


@query("SELECT event_type AS assembly, count(*) AS uses, count(DISTINCT user_id) AS types FROM events GROUP BY event_type")
def assembly_usage(spark, d):
    found = S.assembly_usage(table(spark, d, "events").select(F.col("event_type").alias("assembly"), F.col("user_id").alias("type")))
    return found.select("assembly", "uses", F.size("types").cast("long").alias("types"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 = 0 AND l_linenumber BETWEEN 2 AND 2 + o_orderkey % 4)")
def findings_on_new_lines(spark, d):
    findings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "l_partkey")
    ranges = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file"), F.lit(2).alias("first"), (2 + F.col("o_orderkey") % 4).cast("int").alias("last"))
    return S.on_lines(findings, ranges).select(F.col("file").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "l_partkey")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'external' WHEN p_size % 5 = 0 THEN 'packable' WHEN p_size % 3 = 0 THEN 'nuspec beside' WHEN p_size % 11 = 0 THEN 'nuspec names it' WHEN p_partkey % 2 = 0 THEN 'no application' END AS reason FROM part
WHERE p_size % 7 = 0 OR p_size % 5 = 0 OR p_size % 3 = 0 OR p_size % 11 = 0 OR p_partkey % 2 = 0""")
def shipped_reasons(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    by = lambda n: p.filter(F.col("p_size") % n == 0).select("id")
    return S.shipped_reasons(p, by(7), by(5), by(3), by(11), p.filter("id % 2 = 1").select("id"))


D = "d AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0)"


@query(f"""WITH RECURSIVE {D}, r(src, dst) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 40 = 7 UNION SELECT r.src, d.dst FROM r JOIN d ON d.src = r.dst)
SELECT src AS library, count(*) AS projects, count(*) FILTER (dst >= 16 AND p_size > 44) AS remaining FROM r JOIN part ON p_partkey = dst GROUP BY src""")
def libraries(spark, d):
    from tesserae.plans.graph_queries import dag, parts

    p = parts(spark, d)
    return S.libraries(p, dag(spark, d), p.filter("id % 40 = 7").select("id"))


@query(f"""WITH RECURSIVE {D}, r(src, dst) AS (SELECT src, dst FROM d UNION SELECT r.src, d.dst FROM r JOIN d ON d.src = r.dst), x AS (SELECT p_partkey AS id, p_partkey AS because, 0 AS l FROM part WHERE p_partkey >= 16 AND p_size > 44 UNION SELECT src, dst, 1 FROM r JOIN part ON p_partkey = dst WHERE dst >= 16 AND p_size > 44 AND src != dst)
SELECT id, because FROM (SELECT id, because, row_number() OVER (PARTITION BY id ORDER BY l, because) AS n FROM x) WHERE n = 1""")
def partial_dependency(spark, d):
    from tesserae.plans.graph_queries import dag, parts

    return S.partial_dependency(parts(spark, d).withColumn("partial", F.col("framework_class") == "framework"), dag(spark, d))


@query(f"""WITH RECURSIVE {D}, c AS (SELECT p_partkey AS id, p_size FROM part WHERE p_partkey >= 10), s(id) AS (SELECT id FROM c WHERE p_size <= 4 UNION SELECT d.src FROM s JOIN d ON d.dst = s.id WHERE d.src IN (SELECT id FROM c))
SELECT id AS node FROM c WHERE id NOT IN (SELECT id FROM s)""")
def kept_move_set(spark, d):
    from tesserae.plans.graph_queries import dag

    c = table(spark, d, "part").filter("p_partkey >= 10")
    return S.kept_move_set(c.select("p_partkey"), dag(spark, d).select("src", "dst"), c.filter("p_size > 4").select("p_partkey"))


@query("""WITH e AS (SELECT l_orderkey, list({'s': l_linenumber, 'e': l_linenumber + 1 + l_partkey % 3} ORDER BY l_linenumber, l_partkey % 3 DESC) AS es FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey % 3 AS l_partkey FROM lineitem) GROUP BY l_orderkey)
SELECT l_orderkey, list_reduce(list_transform(es, lambda x: [x.e::BIGINT, 1::BIGINT, x.s::BIGINT]), lambda a, x: CASE WHEN x[3] >= a[1] THEN [x[1], a[2] + 1, a[3]] ELSE a END)[2] AS kept FROM e""")
def greedy_edits(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + 1 + F.col("l_partkey") % 3).cast("long").alias("end")).alias("e"))
    edits = rows.groupBy("l_orderkey").agg(F.collect_set("e").alias("es"))
    return edits.select("l_orderkey", F.size(S.greedy_edits(F.col("es"))).cast("long").alias("kept"))
