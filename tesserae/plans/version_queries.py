"""Version and package operators: parts stand in for packages, sizes for versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.scalars import version_key
from tesserae.operators import relational as R
from tesserae.operators import versions
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


def feed(spark, d: str) -> DataFrame:
    """(id, version, listed, supports): version 1.<size>.0, or a prerelease of it for every eleventh part."""
    version = F.concat(F.lit("1."), F.col("p_size"), F.lit(".0"), F.when(F.col("p_partkey") % 11 == 0, "-beta").otherwise(""))
    return table(spark, d, "part").select(F.col("p_brand").alias("id"), version.alias("version"), (F.col("p_partkey") % 7 != 0).alias("listed"), (F.col("p_size") % 3 != 0).alias("supports"), "p_partkey", "p_size")


FEED = "f AS (SELECT p_brand AS id, '1.' || p_size || '.0' || CASE WHEN p_partkey % 11 = 0 THEN '-beta' ELSE '' END AS version, p_partkey % 7 != 0 AS listed, p_size % 3 != 0 AS supports, p_size * 2 + CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS k, p_partkey, p_size FROM part)"


@query(f"WITH {FEED} SELECT DISTINCT id, version FROM f WHERE p_size = 17 OR (listed AND version NOT LIKE '%beta')")
def candidate_versions(spark, d):
    f = feed(spark, d)
    return versions.candidates(f, f.filter("p_size = 17"))


@query(f"WITH {FEED} SELECT id, arg_max(version, k) AS newest, arg_min(version, k) AS lowest FROM f WHERE supports GROUP BY id")
def supporting_versions(spark, d):
    return versions.supporting(feed(spark, d))


@query(f"""WITH {FEED}, u AS (SELECT id, bool_and(supports) AS ok, max(k) FILTER (NOT supports) AS bad, bool_and(p_size % 4 = 0) AS empty FROM f WHERE p_partkey % 20 = 3 GROUP BY id),
b AS (SELECT id, max(k) AS best FROM f WHERE supports AND listed GROUP BY id)
SELECT u.id, CASE WHEN u.id = 'Brand#11' THEN 'unknown' WHEN empty AND u.id LIKE '%2' THEN 'replace' WHEN ok THEN 'ok' WHEN best IS NOT NULL AND (bad IS NULL OR best > bad) THEN 'upgrade' WHEN u.id LIKE '%2' THEN 'replace' ELSE 'blocked' END AS status FROM u LEFT JOIN b USING (id)""")
def audit_status(spark, d):
    f = feed(spark, d)
    used = f.filter("p_partkey % 20 = 3").withColumn("empty", F.col("p_size") % 4 == 0)
    return versions.audit_status(used, f.filter("id != 'Brand#11'").select("id"), f.filter("listed"), f.filter("id LIKE '%2'").select("id"))


RANGES = [("Brand#11", "a", "direct", "[1.5, )"), ("Brand#11", "b", "direct", "[1.0, 1.40.0]"), ("Brand#12", "a", "direct", "(1.20.0, 1.30.0)"), ("Brand#13", "c", "transitive", "1.10"), ("Brand#13", "a", "direct", "[1.10.0, 2.0)")]


def constraints(spark) -> DataFrame:
    return spark.createDataFrame(RANGES, "id string, project string, kind string, range string")


CHOSEN = f"""{FEED}, r(id, low, high) AS (VALUES ('Brand#11', 11, NULL), ('Brand#11', NULL, 81), ('Brand#12', 42, 60), ('Brand#13', 21, NULL)),
c AS (SELECT id, arg_min(version, k) AS version, min(k) AS k FROM (SELECT DISTINCT id, version, k FROM f) f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = f.id AND NOT (coalesce(k >= low, true) AND coalesce(k <= high, true))) GROUP BY id)"""


@query(f"WITH {CHOSEN} SELECT id, version FROM c")
def chosen_versions(spark, d):
    return versions.choose(feed(spark, d), constraints(spark))


@query("SELECT * FROM (VALUES ('Brand#11', 'a', '[1.5, )'), ('Brand#12', 'a', '(1.20.0, 1.30.0)'), ('Brand#13', 'a', '[1.10.0, 2.0)')) t(id, project, range) WHERE id IN (SELECT p_brand FROM part)")
def deciding_constraint(spark, d):
    c = constraints(spark)
    return versions.deciding(c, versions.choose(feed(spark, d), c)).select("id", "project", "range")


@query(f"""WITH {CHOSEN}, g AS (SELECT id, version, k, substr(id, 1, 7) AS family FROM c), t AS (SELECT *, arg_max(version, k) OVER (PARTITION BY family) AS top FROM g)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.id = t.id AND f.version = t.top) THEN top ELSE version END AS version FROM t""")
def family_alignment(spark, d):
    f = feed(spark, d)
    families = f.select("id", F.substring("id", 1, 7).alias("family")).distinct()
    return versions.align_families(versions.choose(f, constraints(spark)), families, f)


@query(f"""WITH {CHOSEN}, asks AS (SELECT DISTINCT replace(f.id, '#1', '#2') AS id, f.p_size * 2 + 1 AS low FROM f JOIN c ON c.id = f.id AND c.version = f.version WHERE f.p_size % 10 = 5 AND f.id LIKE '%#1%'),
every AS (SELECT id, low, high FROM r UNION ALL SELECT id, low, NULL FROM asks)
SELECT id, arg_min(version, k) AS version FROM (SELECT DISTINCT id, version, k FROM f) f WHERE NOT EXISTS (SELECT 1 FROM every b WHERE b.id = f.id AND NOT (coalesce(k >= low, true) AND coalesce(k <= high, true))) GROUP BY id""")
def consolidated(spark, d):
    f = feed(spark, d)
    needs = f.filter("p_size % 10 = 5").select("id", "version", F.regexp_replace("id", "#1", "#2").alias("dep_id"), F.concat(F.lit("[1."), F.col("p_size"), F.lit(".0, )")).alias("range")).filter("dep_id != id")
    return versions.consolidate(constraints(spark), f, needs)[0]


NAMES = "n AS (SELECT lower(p_brand) || '.' || p_partkey % 90 AS name, p_partkey AS k, p_size AS v, '1.' || p_size || '.0.0' AS version FROM part)"


@query(f"""WITH {NAMES}, dep AS (SELECT name, max(v) AS v, arg_max(version, v) AS too, bool_or(v % 2 = 0) AS signed FROM n WHERE k % 3 = 0 GROUP BY name), ref AS (SELECT name, max(v) AS top, min(v) AS least FROM n WHERE k % 5 = 0 GROUP BY name),
old AS (SELECT name, arg_min('0.0.0.0-1.' || (v - v % 2) || '.0.0', k) AS old, arg_min(version, k) AS version FROM n WHERE k % 4 = 0 GROUP BY name),
j AS (SELECT coalesce(dep.name, old.name) AS name, too, '0.0.0.0-' || too AS wanted, old, version, coalesce(signed AND top > v, false) AS lower_, coalesce(signed AND top <= v AND least < v, false) AS needed, old.name IS NOT NULL AS has, dep.name IS NOT NULL AS ships
  FROM dep LEFT JOIN ref USING (name) FULL JOIN old ON old.name = dep.name)
SELECT name, 'lower' AS action, NULL AS old, too AS version, NULL AS was FROM j WHERE lower_
UNION ALL SELECT name, 'added', wanted, too, NULL FROM j WHERE needed AND NOT has
UNION ALL SELECT name, 'changed', wanted, too, version FROM j WHERE has AND ((needed AND (old != wanted OR version != too)) OR (NOT needed AND ships AND version != too))
UNION ALL SELECT name, 'unchanged', old, version, NULL FROM j WHERE has AND ((needed AND old = wanted AND version = too) OR (NOT needed AND ships AND version = too))
UNION ALL SELECT name, 'stale', old, version, NULL FROM j WHERE has AND NOT ships""")
def redirect_diff(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit("."), F.col("p_partkey") % 90)
    p = table(spark, d, "part").select(name.alias("name"), F.concat(F.lit("1."), F.col("p_size"), F.lit(".0.0")).alias("version"), (F.col("p_size") % 2 == 0).alias("signed"), F.col("p_partkey").alias("place"), "p_size")
    existing = p.filter("place % 4 = 0").withColumn("old", F.concat(F.lit("0.0.0.0-1."), F.col("p_size") - F.col("p_size") % 2, F.lit(".0.0")))
    return versions.redirects(p.filter("place % 5 = 0"), p.filter("place % 3 = 0"), existing)


@query(f"""WITH {FEED}, s AS (SELECT id, version, count(DISTINCT p_partkey % 2) AS n FROM f WHERE version NOT LIKE '%beta' AND p_size BETWEEN 10 AND 39 GROUP BY id, version HAVING n >= 2)
SELECT id, arg_max(version, split_part(version, '.', 2)::INTEGER) AS version FROM s GROUP BY id""")
def newest_in_range(spark, d):
    return versions.newest_in_range(feed(spark, d).withColumn("framework", F.col("p_partkey") % 2), "[1.10.0, 1.40.0)", 2)


@query(f"""WITH {FEED}, u AS (SELECT DISTINCT p_brand AS id, p_type AS tfm FROM part WHERE p_size = 7), w AS (SELECT DISTINCT p_brand AS id, p_size, p_type AS tfm FROM part)
SELECT DISTINCT f.id, f.p_size AS size FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = f.id AND NOT EXISTS (SELECT 1 FROM w WHERE w.id = f.id AND w.p_size = f.p_size AND w.tfm = u.tfm))""")
def supports_every_framework(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("id"), F.col("p_size").alias("version"), F.col("p_type").alias("tfm"))
    found = versions.supports_all(p.select("id", "version").distinct(), p.filter("version = 7"), p)
    return found.select("id", F.col("version").alias("size"))


IMPOSSIBLE = [("Brand#21", "a", "direct", "[1.20.0, 1.30.0]"), ("Brand#21", "b", "direct", "[1.40.0, )"), ("Brand#22", "a", "direct", "[9.0, )")]


@query("SELECT * FROM (VALUES ('Brand#21', '[1.20.0, 1.30.0];[1.40.0, )'), ('Brand#22', '[9.0, )')) t(id, ranges) WHERE EXISTS (SELECT 1 FROM part)")
def consolidation_conflicts(spark, d):
    asked = constraints(spark).unionByName(spark.createDataFrame(IMPOSSIBLE, "id string, project string, kind string, range string"))
    found = versions.unsatisfied(asked, versions.choose(feed(spark, d), asked))
    return found.select("id", F.array_join("ranges", ";").alias("ranges"))


@query(f"""WITH {CHOSEN}, p(id, project, pin, k2) AS (VALUES ('brand#11', 'x', '1.2.0', 5), ('BRAND#12', NULL, '1.49.0', 99), ('Brand#13', 'y', '1.1.0', 3))
SELECT c.id, project, pin, version FROM c JOIN p ON lower(c.id) = lower(p.id) WHERE k2 < k""")
def pins_below_choice(spark, d):
    pins = spark.createDataFrame([("brand#11", "x", "1.2.0"), ("BRAND#12", None, "1.49.0"), ("Brand#13", "y", "1.1.0")], "id string, project string, version string")
    found = versions.pins_below(versions.choose(feed(spark, d), constraints(spark)), pins)
    return found.select(F.initcap("id").alias("id"), "project", "pin", "version")


@query("""WITH m AS (SELECT p_brand AS file, p_name AS package, '1.' || p_size || '.0' AS version, p_size, ['path', 'identical', 'file version', 'informational version', 'assembly version', 'newer'][1 + (p_partkey % 5) + 1] AS match, 2 + p_partkey % 5 AS rk, p_partkey % 2 = 0 AS listed FROM part)
SELECT file, package, version, match FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rk, listed DESC, p_size, package) AS n FROM m WHERE listed OR match != 'newer') WHERE n = 1""")
def dll_ranking(spark, d):
    kinds = F.array(*map(F.lit, versions.MATCH_ORDER))
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("file"), F.col("p_name").alias("package"), F.concat(F.lit("1."), F.col("p_size"), F.lit(".0")).alias("version"), F.get(kinds, 1 + (F.col("p_partkey") % 5).cast("int")).alias("match"), (F.col("p_partkey") % 2 == 0).alias("listed"))
    return versions.best_match(rows).select("file", "package", "version", "match")


@query("""WITH a AS (SELECT p_brand AS package, p_size AS version, CASE WHEN p_size % 4 != 0 THEN p_type END AS framework FROM part), rel(target, framework) AS (SELECT 't1', p_type FROM part WHERE p_type LIKE '%S%' UNION SELECT 't2', p_type FROM part WHERE p_type LIKE '%E%')
SELECT DISTINCT package, version, target, CASE WHEN NOT EXISTS (SELECT 1 FROM a b WHERE b.package = a.package AND b.version = a.version AND b.framework IS NOT NULL) THEN true
  ELSE EXISTS (SELECT 1 FROM a b JOIN rel ON rel.framework = b.framework AND rel.target = t.target WHERE b.package = a.package AND b.version = a.version) END AS supports FROM a CROSS JOIN (VALUES ('t1'), ('t2')) t(target)""")
def target_support(spark, d):
    p = table(spark, d, "part")
    assets = p.select(F.col("p_brand").alias("package"), F.col("p_size").alias("version"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("framework"))
    types = p.select("p_type").distinct()
    relation = types.filter("p_type LIKE '%S%'").select(F.lit("t1").alias("target"), F.col("p_type").alias("framework")).unionByName(types.filter("p_type LIKE '%E%'").select(F.lit("t2").alias("target"), F.col("p_type").alias("framework")))
    return R.compatible(spark.createDataFrame([("t1",), ("t2",)], "target string"), assets, relation)


@query("""SELECT p_brand AS id, p_name AS version FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name DESC) AS n FROM part) WHERE n = 1""")
def newest_by_key(spark, d):
    p = table(spark, d, "part").withColumn("k", F.struct(version_key(F.concat(F.lit("1."), F.col("p_size"))), F.col("p_name")))
    return p.groupBy(F.col("p_brand").alias("id")).agg(F.max_by("p_name", "k").alias("version"))
