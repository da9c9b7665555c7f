"""Kinds, ledgers, differences, searches with reasons and hazards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import facts, fixpoints, graph, relational, reports, rules
from tesserae.operators import selection as S
from tesserae.plans.graph_queries import C, D, HOSTED, REACH_C, REACH_D, READY, cyclic, dag, hosting, parts
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


# ---- project kinds

TEST, WEB, WPF = scalars.TEST_GUID, scalars.WEB_GUIDS, scalars.WPF_GUID


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 13 AS g, p_partkey % 7 AS sdk, p_size % 5 AS o, p_partkey % 11 AS r FROM part),
f AS (SELECT *, o IN (2, 3) AS lib, CASE WHEN s % 17 = 0 THEN 'PackageReference xunit.core' WHEN s % 19 = 0 THEN 'packages.config NUnit' WHEN r = 4 AND o IN (2, 3) THEN 'Reference nunit.framework + OutputType=Library' END AS tests,
  CASE WHEN k % 23 = 0 THEN 'winforms|UseWindowsForms=true' WHEN r = 1 AND o = 1 THEN 'winforms|Reference System.Windows.Forms + OutputType=WinExe' WHEN k % 29 = 0 THEN 'wpf|UseWPF=true'
    WHEN sdk = 1 AND r = 2 THEN 'wpf|Sdk=Microsoft.NET.Sdk.WindowsDesktop + PresentationFramework' WHEN g = 2 THEN 'wpf|ProjectTypeGuids {{{WPF}}}' WHEN r = 3 AND o = 0 THEN 'service|Reference System.ServiceProcess + OutputType=Exe'
    WHEN s % 17 = 1 THEN 'service|PackageReference Topshelf' WHEN s % 19 = 1 AND o = 0 THEN 'service|packages.config Topshelf + OutputType=Exe' WHEN sdk = 2 THEN 'service|Sdk=Microsoft.NET.Sdk.Worker' END AS app FROM p),
x AS (SELECT k, CASE WHEN k % 101 = 0 THEN 'test|IsTestProject=true' WHEN g = 0 THEN 'test|ProjectTypeGuids {{{TEST}}}' WHEN sdk = 0 THEN 'web|Sdk=Microsoft.NET.Sdk.Web' WHEN g = 1 THEN 'web|ProjectTypeGuids {{{WEB[3]}}}'
  WHEN r = 0 AND lib AND k % 2 = 0 THEN 'web|Reference System.Web + OutputType=Library + web.config' WHEN tests IS NOT NULL AND NOT (o IN (0, 1) AND app IS NOT NULL) THEN 'test|' || tests WHEN app IS NOT NULL THEN app
  WHEN o = 0 THEN 'console|OutputType=Exe' WHEN lib THEN 'library|OutputType=Library' ELSE 'unknown|OutputType=' || CASE WHEN o = 1 THEN 'WinExe' ELSE 'Module' END END AS e FROM f)
SELECT k AS p_partkey, split_part(e, '|', 1) AS kind, split_part(e, '|', 2) AS evidence FROM x""")
def project_kinds(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")

    def one_of(place, *values):
        """The value at a place, each an array or a text; null beyond the last."""
        chain = F.when(place == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            chain = chain.when(place == i, v)
        return chain

    names = lambda *n: F.array(*map(F.lit, n))
    found = scalars.project_kind(
        guids=one_of(k % 13, f"{{{TEST.lower()}}}", f"{{AA}};{{{WEB[3]}}}", f"{{{WPF.lower()}}}"),
        sdk=one_of(k % 7, "Microsoft.NET.Sdk.Web", "Microsoft.NET.Sdk.WindowsDesktop", "Microsoft.NET.Sdk.Worker"),
        output_type=one_of(s % 5, "Exe", "WinExe", F.lit(None).cast("string"), "library", "Module"),
        references=one_of(k % 11, names("system.web"), names("System.Windows.Forms", "mscorlib"), names("PresentationFramework"), names("System.ServiceProcess"), names("NUnit.Framework")),
        packages=one_of(s % 17, names("mstest", "XUNIT.core"), names("topshelf")),
        config_packages=one_of(s % 19, names("NUnit"), names("Topshelf")),
        is_test=k % 101 == 0, web_config=k % 2 == 0, winforms=k % 23 == 0, wpf=k % 29 == 0,
    )
    return table(spark, d, "part").select(k, found.alias("f")).select("p_partkey", "f.kind", "f.evidence")


# ---- ledgers and word places


@query("""WITH f AS (SELECT p_brand AS project, CASE WHEN p_brand != 'Brand#11' THEN p_partkey END AS file FROM part), n AS (SELECT p_brand AS project, l_partkey AS file, CASE WHEN l_quantity > 49 THEN 'error' ELSE 'warning' END AS severity, l_returnflag AS category, nullif(l_linestatus, 'O') AS namespace FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT project, count(DISTINCT file) AS files, count(DISTINCT file) FILTER (NOT EXISTS (SELECT 1 FROM n WHERE n.project = f.project AND n.file = f.file AND severity = 'error')) AS portable_files FROM f GROUP BY project),
c AS (SELECT project, string_agg(category || '=' || n, ';' ORDER BY category) AS m FROM (SELECT project, category, count(*) AS n FROM n GROUP BY ALL) GROUP BY project),
w AS (SELECT project, string_agg(namespace || '=' || n, ';' ORDER BY namespace) AS m FROM (SELECT project, namespace, count(*) AS n FROM n WHERE namespace IS NOT NULL GROUP BY ALL) GROUP BY project)
SELECT project, files, portable_files, coalesce(round_even(portable_files::DOUBLE / nullif(files, 0), 3), 1.0)::DOUBLE AS portability, coalesce(c.m, '') AS categories, coalesce(w.m, '') AS namespaces FROM s LEFT JOIN c USING (project) LEFT JOIN w USING (project)""")
def ledger_maps(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("project"), "p_partkey")
    files = p.select("project", F.when(F.col("project") != "Brand#11", F.col("p_partkey")).alias("file"))
    found = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    found = found.select("project", F.col("l_partkey").alias("file"), F.when(F.col("l_quantity") > 49, "error").otherwise("warning").alias("severity"), F.col("l_returnflag").alias("category"), F.nullif("l_linestatus", F.lit("O")).alias("namespace"))
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    out = rules.ledger(files, found)
    return out.select("project", "files", "portable_files", "portability", told("by_category").alias("categories"), told("by_namespace").alias("namespaces"))


@query(r"""WITH w AS (SELECT doc_id, i - 1 AS place, lower(words[i]) AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}_]+') AS words FROM documents)))
SELECT word, (min((doc_id, place))[1])::BIGINT AS doc_id, (min((doc_id, place))[2])::INTEGER AS place FROM w GROUP BY word""")
def word_first_mention_any_case(spark, d):
    return rules.word_index(table(spark, d, "documents"), "doc_id", "text", ignore_case=True)


@query(r"""WITH l AS (SELECT p_brand AS project, 'CP' || lpad((p_partkey * 37 % 3000)::VARCHAR, 4, '0') AS code, p_size % 3 AS k, p_type FROM part),
m AS (SELECT project, code, CASE k WHEN 0 THEN 'Type ''' || p_type || ''' exists on old but not on new' WHEN 1 THEN 'Member ''' || p_type || '.X'' exists on new but not on old' ELSE 'Assembly new differs in ' || p_type END AS message,
  CASE k WHEN 0 THEN p_type WHEN 1 THEN p_type || '.X' ELSE 'Assembly new differs in ' || p_type END AS member, CASE k WHEN 0 THEN 'old' WHEN 1 THEN 'new' END AS only_on FROM l)
SELECT DISTINCT project, code, member, only_on, message FROM m WHERE code NOT LIKE 'CP1%'""")
def api_differences(spark, d):
    k, code = F.col("p_size") % 3, F.concat(F.lit("CP"), F.lpad((F.col("p_partkey") * 37 % 3000).cast("string"), 4, "0"))
    message = F.when(k == 0, F.concat(F.lit("Type '"), "p_type", F.lit("' exists on /out/old/Lib.dll but not on /out/new/LIB.dll"))).when(
        k == 1, F.concat(F.lit("Member '"), "p_type", F.lit(".X' exists on /out/new/lib.dll but not on /OUT/old/Lib.dll"))
    ).otherwise(F.concat(F.lit("Assembly /out/new/Lib.dll differs in "), "p_type"))
    lines = F.concat(F.lit("building\n  "), code, F.lit(":  "), message, F.lit("\r\nCP12: short\nxCP0001: inside\nCP0002:"))
    outputs = table(spark, d, "part").select(F.col("p_brand").alias("project"), lines.alias("text"))
    return facts.api_differences(outputs, "text", [("/out/old/Lib.dll", "old"), ("/out/new/Lib.dll", "new")], ("project",))


# ---- searches


@query(f"""WITH RECURSIVE {D}, v AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'hidden' ELSE 'late' END AS reason FROM part WHERE p_partkey % 13 != 5),
w(start, node, path, k) AS (SELECT p_partkey, p_partkey, [p_partkey], 0 FROM part UNION ALL SELECT start, d.src, list_append(path, d.src), k + 1 FROM w JOIN v USING (node) JOIN d ON d.dst = w.node WHERE k < 2),
b AS (SELECT start, node, path, k, reason FROM w JOIN v USING (node) QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY k, path) = 1),
f AS (SELECT start, node, path FROM b WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY start ORDER BY k, path) = 1),
o AS (SELECT DISTINCT start FROM b JOIN d ON d.dst = b.node WHERE k = 2),
c AS (SELECT start, string_agg(node || ':' || reason, ',' ORDER BY k, path) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY k, path) AS n FROM b) WHERE n <= 4 GROUP BY start)
SELECT p_partkey AS start, f.node AS entry, array_to_string(list_reverse(f.path), '>') AS path, CASE WHEN f.node IS NOT NULL THEN NULL WHEN o.start IS NOT NULL THEN 'depth exceeded' ELSE coalesce(s.reason, 'not accessible') END AS reason,
  CASE WHEN f.node IS NULL THEN coalesce(listed, '') END AS candidates FROM part LEFT JOIN f ON f.start = p_partkey LEFT JOIN o ON o.start = p_partkey LEFT JOIN c ON c.start = p_partkey LEFT JOIN v s ON s.node = p_partkey""")
def entry_points(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    verdicts = p.filter("node % 13 != 5").withColumn("reason", F.when(F.col("node") % 11 == 0, F.lit(None)).when(F.col("node") % 2 == 0, "hidden").otherwise("late"))
    found = fixpoints.entry_points(p, dag(spark, d), verdicts, 2, 4)
    told = F.array_join(F.transform("candidates", lambda e: F.concat_ws(":", e["node"].cast("string"), e["reason"])), ",")
    return found.select("start", "entry", F.array_join("path", ">").alias("path"), "reason", told.alias("candidates"))


@query(f"""WITH RECURSIVE {D}, w(start, node, path, k) AS (SELECT p_partkey, p_partkey, [p_partkey], 0 FROM part UNION ALL SELECT start, d.dst, list_append(path, d.dst), k + 1 FROM w JOIN d ON d.src = w.node WHERE k < 3)
SELECT start, node AS callee, array_to_string(path, '>') AS path FROM w WHERE k > 0 AND node % 9 = 4 QUALIFY row_number() OVER (PARTITION BY start ORDER BY k, path) = 1""")
def first_violations(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    found = fixpoints.first_violation(p, dag(spark, d), p.filter("node % 9 = 4"), 3)
    return found.select("start", "callee", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {D}, {C}, {REACH_C} SELECT min(src) AS node FROM r WHERE src = dst AND src > 40")
def first_self_reaching(spark, d):
    return fixpoints.first_self_reaching(cyclic(spark, d), table(spark, d, "part").filter("p_partkey > 40").select("p_partkey"))


# ---- paths, folders and packages

PATHS = r"q AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"


def paths(spark, d):
    return table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()


@query(rf"""WITH RECURSIVE {PATHS}, fl AS (SELECT CASE WHEN length(path) % 5 = 0 THEN upper(path[1]) || path[2:] ELSE path END AS path FROM q), ps AS (SELECT string_split(path, '/') AS a FROM fl),
e AS (SELECT DISTINCT array_to_string(a[1:i - 1], '/') AS folder, a[i] AS name FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM ps)), g AS (SELECT folder, lower(name) AS k, list(name ORDER BY name) AS names FROM e GROUP BY ALL),
asked AS (SELECT DISTINCT CASE length(path) % 4 WHEN 0 THEN upper(path) WHEN 1 THEN path || 'x' WHEN 2 THEN regexp_replace(path, '[^/]*$', '') || upper(regexp_extract(path, '[^/]*$')) ELSE path END AS path FROM q),
w(path, a, cur, i, seg, act) AS (SELECT path, string_split(path, '/'), '', 0, NULL::VARCHAR, NULL::VARCHAR FROM asked UNION ALL
  SELECT path, a, CASE WHEN i = 0 THEN t ELSE cur || '/' || t END, i + 1, CASE WHEN seg IS NULL AND t != s THEN s ELSE seg END, CASE WHEN seg IS NULL AND t != s THEN t ELSE act END
  FROM (SELECT w.*, a[i + 1] AS s, CASE WHEN list_contains(names, a[i + 1]) THEN a[i + 1] ELSE names[1] END AS t FROM w JOIN g ON g.folder = w.cur AND g.k = lower(a[i + 1]) WHERE i < len(a)))
SELECT path, cur AS found, seg AS segment, act AS actual FROM w WHERE i = len(a) AND seg IS NOT NULL""")
def case_paths(spark, d):
    q, n = paths(spark, d), F.length("path")
    files = q.select(F.when(n % 5 == 0, F.concat(F.upper(F.substring("path", 1, 1)), F.expr("substring(path, 2)"))).otherwise(F.col("path")).alias("path"))
    last = F.concat(F.regexp_replace("path", "[^/]*$", ""), F.upper(F.substring_index("path", "/", -1)))
    asked = q.select(F.when(n % 4 == 0, F.upper("path")).when(n % 4 == 1, F.concat("path", F.lit("x"))).when(n % 4 == 2, last).otherwise(F.col("path")).alias("path"))
    return S.case_paths(asked, files)


@query(rf"""WITH {PATHS}, f AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM q),
pr AS (SELECT folder, length(folder) % 4 = 0 AS imports FROM f WHERE length(folder) % 2 = 0 UNION SELECT DISTINCT split_part(folder, '/', 1), false FROM f WHERE contains(folder, '/') AND length(split_part(folder, '/', 1)) % 2 = 1),
pj AS (SELECT path AS id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM q), li AS (SELECT id FROM pj WHERE length(id) % 3 != 0),
o AS (SELECT pj.id AS path, arg_max(pr.folder, length(pr.folder)) AS folder FROM pj JOIN pr ON pj.folder = pr.folder OR starts_with(pj.folder, pr.folder || '/') WHERE lower(id) NOT IN (SELECT lower(id) FROM li) GROUP BY pj.id),
s AS (SELECT a.folder AS path, arg_max(b.folder, length(b.folder)) AS folder FROM pr a JOIN pr b ON starts_with(a.folder, b.folder || '/') WHERE NOT a.imports GROUP BY a.folder)
SELECT 'outside' AS hazard, path, folder FROM o UNION ALL SELECT 'shadows', path, folder FROM s UNION ALL SELECT 'old style', id, NULL FROM li WHERE length(id) % 5 = 0""")
def version_hazards(spark, d):
    projects = paths(spark, d).withColumnRenamed("path", "id")
    folder = F.when(F.col("id").contains("/"), F.regexp_replace("id", "/[^/]*$", "")).otherwise(".")
    folders = projects.select(folder.alias("folder")).distinct()
    top = folders.filter("contains(folder, '/')").select(F.substring_index("folder", "/", 1).alias("folder")).filter("length(folder) % 2 = 1").distinct()
    props = folders.filter("length(folder) % 2 = 0").withColumn("imports_parent", F.length("folder") % 4 == 0).unionByName(top.withColumn("imports_parent", F.lit(False)))
    listed = projects.filter("length(id) % 3 != 0")
    return S.version_hazards(props, projects, listed, listed.filter("length(id) % 5 = 0"))


@query("""WITH s AS (SELECT p_brand AS k, count(DISTINCT p_size) AS n FROM part WHERE p_brand NOT LIKE 'Brand#1%' AND (p_brand != 'Brand#55' OR p_size < 3) GROUP BY p_brand), t AS (SELECT k, n FROM s WHERE n = (SELECT max(n) FROM s))
SELECT k AS p_brand, n, CASE WHEN (SELECT count(*) FROM t) > 1 THEN 'tie' WHEN n = (SELECT count(DISTINCT p_size) FROM part WHERE p_brand NOT LIKE 'Brand#1%' AND (p_brand != 'Brand#55' OR p_size < 3)) THEN 'covers' ELSE 'largest' END AS choice FROM t""")
def superset_without_flawed(spark, d):
    p = table(spark, d, "part").filter("p_brand != 'Brand#55' OR p_size < 3").select("p_brand", "p_size")
    return relational.covering(p, "p_brand", "p_size", p.filter("p_brand LIKE 'Brand#1%'").select("p_brand"))


@query("""WITH pr(target, framework, rank) AS (VALUES ('t', 'STANDARD', 2), ('t', 'PROMO', 1), ('u', 'SMALL', 1), ('u', 'LARGE', 1)),
a AS (SELECT p_name || p_partkey % 200 AS package, CASE p_partkey % 3 WHEN 0 THEN 'lib/' WHEN 1 THEN 'REF/' ELSE 'runtimes/' || CASE WHEN p_size % 2 = 0 THEN 'win-x64' ELSE 'WIN' END || '/lib/' END || p_partkey || '.dll' AS path, split_part(p_type, ' ', 1) AS framework, CASE WHEN p_size % 3 = 0 THEN 'uses ' || p_size END AS marker FROM part),
r AS (SELECT *, CASE WHEN lower(path) LIKE 'lib/%' THEN 0 WHEN lower(path) LIKE 'ref/%' THEN 1 END AS root FROM a),
x AS (SELECT package, target, path, marker, rank() OVER (PARTITION BY package, target ORDER BY root, rank, framework) AS n FROM r JOIN pr USING (framework) WHERE root IS NOT NULL),
nat AS (SELECT p_name || p_partkey % 200 AS package, 'runtimes/' || CASE WHEN p_size % 4 = 0 THEN 'linux' ELSE 'win10' END || '/native/' || p_partkey || '.so' AS path FROM part WHERE p_size % 7 = 0),
rt AS (SELECT package, path, 0 AS kind FROM nat UNION ALL SELECT package, path, 1 FROM r WHERE path LIKE 'runtimes/%'),
w AS (SELECT package, min((kind, path)) AS m FROM rt WHERE package NOT IN (SELECT package FROM r WHERE root IS NOT NULL) GROUP BY package HAVING bool_and(lower(split_part(path, '/', 2)) LIKE 'win%'))
SELECT package, target, arg_min(path || ': ' || marker, path) AS evidence FROM x WHERE n = 1 AND marker IS NOT NULL GROUP BY package, target
UNION ALL SELECT package, target, m[2] || CASE WHEN m[1] = 0 THEN ': native code for Windows only' ELSE ': code for Windows only' END FROM w, (SELECT DISTINCT target FROM pr)""")
def windows_evidence(spark, d):
    precedence = spark.createDataFrame([("t", "STANDARD", 2), ("t", "PROMO", 1), ("u", "SMALL", 1), ("u", "LARGE", 1)], "target string, framework string, rank int")
    k, s, package = F.col("p_partkey"), F.col("p_size"), F.concat("p_name", F.col("p_partkey") % 200)
    root = F.when(k % 3 == 0, "lib/").when(k % 3 == 1, "REF/").otherwise(F.concat(F.lit("runtimes/"), F.when(s % 2 == 0, "win-x64").otherwise("WIN"), F.lit("/lib/")))
    p = table(spark, d, "part")
    assets = p.select(package.alias("package"), F.concat(root, k, F.lit(".dll")).alias("path"), F.substring_index("p_type", " ", 1).alias("framework"), F.when(s % 3 == 0, F.concat(F.lit("uses "), s)).alias("marker"))
    native = p.filter("p_size % 7 = 0").select(package.alias("package"), F.concat(F.lit("runtimes/"), F.when(s % 4 == 0, "linux").otherwise("win10"), F.lit("/native/"), k, F.lit(".so")).alias("path"))
    return S.windows_evidence(assets, precedence, native)


@query(f"""WITH RECURSIVE {D}, p AS (SELECT p_partkey AS id, 'n' || p_partkey AS name, p_size > 44 AND p_partkey >= 16 AS applies, CASE WHEN p_partkey % 17 = 3 THEN 'basic' ELSE 'csharp' END AS language, p_partkey % 19 = 4 AS excluded, p_partkey % 23 = 5 AS frozen,
  CASE WHEN p_size > 44 AND p_partkey >= 16 THEN 'framework' WHEN p_size % 7 = 0 THEN 'modern' WHEN p_size % 2 = 0 THEN 'dual' ELSE 'standard' END AS cls, p_partkey % 29 != 6 AS compiled, p_partkey % 5 = 0 AS test FROM part),
m AS (SELECT id AS project, 'n77' AS target FROM p WHERE applies AND name LIKE 'n7%' UNION SELECT id, CASE WHEN name = 'n31' THEN 'N31' ELSE name || '0' END FROM p WHERE applies AND (name LIKE 'n1%' OR name = 'n31')),
r0 AS (SELECT project, c.id AS counterpart, 'map' AS source FROM m JOIN p c ON lower(c.name) = lower(target) UNION SELECT a.id, c.id, 'references' FROM p a JOIN d ON d.src = a.id JOIN p c ON c.id = d.dst WHERE a.applies AND NOT a.test AND NOT c.test AND c.cls IN ('standard', 'dual') AND a.id NOT IN (SELECT project FROM m)),
b(s, node) AS (SELECT DISTINCT counterpart, d.dst FROM r0 JOIN d ON d.src = counterpart UNION SELECT s, d.dst FROM b JOIN d ON d.src = b.node),
r AS (SELECT project, counterpart, source, CASE WHEN project = counterpart THEN 'itself' WHEN language != 'csharp' THEN 'language' WHEN excluded THEN 'excluded' WHEN frozen THEN 'frozen' WHEN cls = 'framework' THEN 'framework only' WHEN cls = 'modern' THEN 'modern only' WHEN NOT compiled THEN 'not compiled'
  WHEN EXISTS (SELECT 1 FROM b WHERE b.s = counterpart AND b.node = project) THEN 'depends on it' WHEN project % 3 = 0 AND counterpart % 4 = 1 THEN 'no reference for net48' END AS problem FROM r0 JOIN p ON p.id = counterpart)
SELECT project, counterpart, source, problem FROM r WHERE source = 'map' OR problem IS NULL
UNION ALL SELECT id, NULL, CASE WHEN id IN (SELECT project FROM m) THEN 'map' ELSE 'none' END, NULL FROM p WHERE applies AND id NOT IN (SELECT project FROM r WHERE source = 'map' OR problem IS NULL)""")
def counterparts(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    old = (size > 44) & (k >= 16)
    p = table(spark, d, "part").select(
        k.alias("id"), F.concat(F.lit("n"), k).alias("name"), old.alias("applies"), F.when(k % 17 == 3, "basic").otherwise("csharp").alias("language"), (k % 19 == 4).alias("excluded"), (k % 23 == 5).alias("frozen"),
        F.when(old, "framework").when(size % 7 == 0, "modern").when(size % 2 == 0, "dual").otherwise("standard").alias("framework_class"), (k % 29 != 6).alias("compiled"), (k % 5 == 0).alias("test"),
    )
    e = dag(spark, d)
    pairs = e.select(F.col("src").alias("project"), F.col("dst").alias("counterpart")).unionByName(p.select(F.col("id").alias("project"), (F.col("id") * 10).alias("counterpart")))
    pairs = pairs.unionByName(p.select(F.col("id").alias("project"), F.lit(77).cast("long").alias("counterpart")))
    unsuited = pairs.filter("project % 3 = 0 AND counterpart % 4 = 1").withColumn("target", F.explode(F.array(F.lit("net8.0"), F.lit("net48"))))
    return S.counterparts(p, [("n7*", "n77"), ("n1*", "{name}0"), ("n31", "N31")], e, unsuited)


@query(f"""WITH RECURSIVE {D}, {REACH_D}, {READY}, {HOSTED}, sh AS (SELECT p_partkey AS id, 'packable' AS reason FROM part WHERE p_partkey % 6 = 1),
o AS (SELECT id AS project, reason AS shipped FROM sh WHERE id % 5 != 0 AND id NOT IN (SELECT id FROM h)), near AS (SELECT project, project AS node FROM o UNION SELECT project, dst FROM o JOIN r ON r.src = project),
x AS (SELECT n.project, n.node, n.node IN (SELECT id FROM fw) AS l, p_size, readiness FROM near n JOIN part ON p_partkey = n.node LEFT JOIN st ON st.id = n.node)
SELECT project, shipped, CASE WHEN count(*) FILTER (l) = 0 THEN 'done' WHEN count(*) FILTER (l) = 1 AND count(*) FILTER (l AND node = project) = 1 THEN 'ready' ELSE 'blocked' END AS status, count(*) AS closure, count(*) FILTER (l) AS remaining,
  coalesce(sum(p_size) FILTER (l), 0)::BIGINT AS remaining_loc, coalesce(string_agg(node::VARCHAR, ',' ORDER BY node) FILTER (l AND readiness = 'ready'), '') AS next FROM x JOIN o USING (project) GROUP BY project, shipped""")
def library_report(spark, d):
    p = parts(spark, d).join(graph.wide(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("loc"))), "id")
    shipped = p.filter("id % 6 = 1").select("id", F.lit("packable").alias("reason"))
    out = reports.library_report(p, dag(spark, d), shipped, hosting(spark, d))
    return out.select("project", "shipped", "status", "closure", "remaining", "remaining_loc", F.array_join("next", ",").alias("next"))


@query(f"""WITH RECURSIVE {D}, c AS (SELECT p_partkey AS id, p_size FROM part WHERE p_partkey >= 10), s(id) AS (SELECT id FROM c WHERE p_size <= 4 UNION SELECT d.src FROM s JOIN d ON d.dst = s.id WHERE d.src IN (SELECT id FROM c)),
k AS (SELECT id FROM c WHERE id NOT IN (SELECT id FROM s)), n(id) AS (SELECT id FROM k WHERE id % 3 = 0 UNION SELECT d.dst FROM n JOIN d ON d.src = n.id WHERE d.dst IN (SELECT id FROM k)) SELECT id AS node FROM n""")
def needed_move_set(spark, d):
    c = table(spark, d, "part").filter("p_partkey >= 10")
    return S.kept_move_set(c.select("p_partkey"), dag(spark, d).select("src", "dst"), c.filter("p_size > 4").select("p_partkey"), c.filter("p_partkey % 3 = 0").select("p_partkey"))


@query("""WITH b AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'source' ELSE 'resource' END AS kind, p_type || p_partkey % 300 AS name, p_size, p_partkey AS k FROM part),
x AS (SELECT kind, name FROM b WHERE p_size < 35), y AS (SELECT kind, CASE WHEN k % 2 = 0 THEN lower(name) ELSE name END AS name FROM b WHERE p_size > 15),
a AS (SELECT kind, CASE WHEN kind = 'reference' THEN lower(name) ELSE name END AS key, min(name) AS name FROM x GROUP BY ALL), z AS (SELECT kind, CASE WHEN kind = 'reference' THEN lower(name) ELSE name END AS key, min(name) AS name FROM y GROUP BY ALL),
t AS (SELECT 'added' AS change, * FROM z WHERE (kind, key) NOT IN (SELECT (kind, key) FROM a) UNION ALL SELECT 'removed', * FROM a WHERE (kind, key) NOT IN (SELECT (kind, key) FROM z)),
pk AS (SELECT lower(name) AS key, min('pack' || k % 5) AS package FROM b WHERE k % 7 = 0 GROUP BY ALL),
e AS (SELECT t.*, CASE WHEN kind != 'reference' THEN NULL WHEN package IS NOT NULL THEN 'package' WHEN key IN (SELECT lower(name) FROM b WHERE k % 8 = 0) THEN 'declaration' WHEN key IN (SELECT lower(name) FROM b WHERE k % 9 = 0) THEN 'facade' ELSE 'unexplained' END AS reason, CASE WHEN kind = 'reference' THEN package END AS source FROM t LEFT JOIN pk USING (key))
SELECT kind, change, reason, source, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM e GROUP BY ALL""")
def compile_differences(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "reference").when(k % 3 == 1, "source").otherwise("resource")
    rows = table(spark, d, "part").select(kind.alias("kind"), F.concat("p_type", k % 300).alias("name"), "p_size", "p_partkey")
    after = rows.filter("p_size > 15").select("kind", F.when(k % 2 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"))
    packages = rows.filter("p_partkey % 7 = 0").select("name", F.concat(F.lit("pack"), k % 5).alias("package"))
    found = reports.compile_differences(rows.filter("p_size < 35").select("kind", "name"), after, packages, rows.filter("p_partkey % 8 = 0"), rows.filter("p_partkey % 9 = 0"))
    return found.withColumn("names", F.array_join("names", ","))
