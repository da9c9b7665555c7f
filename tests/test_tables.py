"""Relational, rule, version and report operators, sources, sinks and the ledger stream."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import verify
from tesserae.functions import scalars
from tesserae.operators import relational as R
from tesserae.operators import reports, rules, versions
from tesserae.plans import catalog
from tesserae.sources import model, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


QUICK = sorted(set(catalog.ORACLES) - {"plan_without_tests", "plan_counts"})


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_their_sql(spark, duck, name):
    out = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(verify.key(r[i]) for i in order) for r in out.fetchall())
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert verify.rows(df) == want


def test_version_precedence(spark):
    # the published examples, in rising order
    names = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.0.1", "1.0.1", "1.2", "1.10", "2.0.0+build"]
    df = spark.createDataFrame([(v,) for v in names[::-1]], "v string")
    assert [r["v"] for r in df.orderBy(scalars.version_key(F.col("v"))).collect()] == names
    assert df.limit(1).select(scalars.version_key(F.lit("odd")).alias("k")).first()["k"] is None


@pytest.mark.parametrize("text, yes, no", [("1.0", "1.0.0 5.0", "0.9"), ("[1.0]", "1.0", "1.0.1"), ("[1.0, 2.0)", "1.0 1.9.9", "2.0 0.1"), ("(,2.0]", "0.1 2.0", "2.1"), ("(1.0, )", "1.0.1", "1.0 1.0-a")])
def test_ranges(spark, text, yes, no):
    asked = [(v, True) for v in yes.split()] + [(v, False) for v in no.split()]
    df = spark.createDataFrame(asked, "v string, want boolean")
    for r in df.select("v", "want", scalars.in_range(scalars.version_key(F.col("v")), scalars.version_range(F.lit(text))).alias("got")).collect():
        assert r["got"] == r["want"], r["v"]


def test_consolidation_takes_in_what_choices_ask_for(spark):
    direct = spark.createDataFrame([("A", "p", "direct", "[1.0, )"), ("B", "p", "direct", "[1.0, )")], "id string, project string, kind string, range string")
    options = spark.createDataFrame([("A", "1.0"), ("A", "2.0"), ("B", "1.0"), ("B", "1.5"), ("B", "2.0")], "id string, version string")
    needs = spark.createDataFrame([("A", "1.0", "B", "[1.5, )")], "id string, version string, dep_id string, range string")
    chosen, rounds = versions.consolidate(direct, options, needs)
    assert {tuple(r) for r in chosen.collect()} == {("A", "1.0"), ("B", "1.5")} and rounds == 2
    pins = spark.createDataFrame([("b", None, "2.0")], "id string, project string, version string")
    pinned, _ = versions.consolidate(direct, options, needs.limit(0), pins=pins.withColumn("id", F.upper("id")))
    assert {tuple(r) for r in pinned.collect()} == {("A", "1.0"), ("B", "2.0")}


def test_newest_in_range(spark):
    rows = spark.createDataFrame([("A", "1.0", "x"), ("A", "1.0", "y"), ("A", "1.5", "x"), ("A", "1.2-rc", "x"), ("A", "1.2-rc", "y")], "id string, version string, framework string")
    assert [tuple(r) for r in versions.newest_in_range(rows, "[1.0, 2.0)", 2).collect()] == [("A", "1.0")]


def test_rounding_modes(spark):
    r = spark.sql("SELECT round(2.25D, 1) a, bround(2.25D, 1) b").first()
    assert (r["a"], r["b"]) == (2.3, 2.2)
    empty = spark.createDataFrame([], "id string, framework_class string, loc int")
    assert reports.headline(empty).first()["portable_percent"] == 0.0


def test_symbol_keys(spark):
    keys = spark.range(1).select(rules.symbol_keys(F.lit("M:N.S.T`1.M``2(System.Int32)")).alias("k")).first()["k"]
    assert keys[:3] == ["M:N.S.T`1.M``2(System.Int32)", "M:N.S.T`1.M``2", "M:N.S.T.M"]
    assert {"T:N.S.T", "N:N.S", "N:N"} <= set(keys)


def test_dead_code(spark):
    decl = spark.createDataFrame([("T", None, "f", 0, 100, True), ("T.M", "T", "f", 10, 20, True), ("U", None, "f", 200, 300, True), ("U.M", "U", "f", 210, 220, True)], "symbol string, owner string, file string, begin long, end long, eligible boolean")
    use = spark.createDataFrame([("T", "f", 15), ("U", "f", 50), ("T.M", "f", 12)], "symbol string, file string, position long")
    assert {r["symbol"] for r in rules.dead_code(decl, use).collect()} == {"T", "U.M"}
    rows = spark.createDataFrame([("a", False, True, True, False, False), ("b", True, True, True, False, False), ("c", False, False, False, True, False), ("d", False, False, False, False, False)], "s string, low_evidence boolean, is_public boolean, shipped boolean, is_action boolean, is_friend boolean")
    assert {(r["s"], r["confidence"]) for r in rules.confidence(rows).collect()} == {("a", "medium"), ("b", "low"), ("c", "medium"), ("d", "high")}


def test_series_and_applications(spark):
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z", "s", "b.json"), ("2026-01-01T00:00:00Z", "s", "a.json"), ("2026-02-01T00:00:00Z", "s", "c.json"), ("2026-01-15T00:00:00Z", "t", "d.json"), ("2026-09-01T00:00:00Z", "s", "e.json")], "created_at string, solution string, file string")
    assert [r["file"] for r in reports.series(rows, "s", "2026-09-01T00:00:00Z").collect()] == ["b.json", "c.json"]
    assert [r["file"] for r in reports.series(rows, "s", "2026-09-01T00:00:00Z", "2026-02").collect()] == ["c.json"]
    projects = spark.createDataFrame([("app", "framework"), ("lib", "framework"), ("std", "standard")], "id string, framework_class string")
    edges = spark.createDataFrame([("app", "lib"), ("lib", "std")], "src string, dst string")
    hosted = spark.createDataFrame([], "id string, hosted_by string")
    row = reports.application(projects, edges, hosted, "app").first()
    assert (row["projects"], row["remaining"], row["status"], row["next"]) == (3, 2, "blocked", ["lib"])


def test_affected_projects(spark):
    projects = spark.createDataFrame([("src/A/A.csproj", "src/A"), ("src/B.csproj", "src"), ("src/C.csproj", "src")], "id string, folder string")
    compiles = spark.createDataFrame([("src/B.csproj", "shared/x.cs")], "project string, file string")
    paths = spark.createDataFrame([("src/A/A.csproj",), ("shared/x.cs",), ("src/A/deep/y.cs",), ("src/z.cs",)], "path string")
    got = {(r["path"], r["project"]) for r in reports.affected(paths, projects, compiles).collect()}
    assert got == {("src/A/A.csproj", "src/A/A.csproj"), ("shared/x.cs", "src/B.csproj"), ("src/A/deep/y.cs", "src/A/A.csproj"), ("src/z.cs", "src/B.csproj"), ("src/z.cs", "src/C.csproj")}


def test_numbers_are_global_and_total(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10)
    rows = R.numbered(df, [F.col("k"), F.desc("id")]).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001)) and [r["id"] for r in rows][:3] == [990, 980, 970]


def test_null_keys_match_in_baselines(spark):
    now = spark.createDataFrame([("E1", None), ("E2", "f")], "code string, file string")
    old = spark.createDataFrame([("E1", None), ("E3", "f")], "code string, file string")
    assert {tuple(r) for r in R.not_in(now, old, ["code", "file"]).collect()} == {("E2", "f")}
    assert {(r["code"], r["standing"]) for r in R.baseline(now, old, ["code", "file"]).collect()} == {("E1", "known"), ("E2", "new"), ("E3", "fixed")}


def test_workspace_tables(spark, tmp_path):
    doc = {
        "version": 1, "createdAt": "2026-01-01T00:00:00Z", "solution": "s.sln",
        "projects": [
            {"id": "a.csproj", "name": "a", "assemblyName": "a", "kind": "web", "frameworkClass": "dual", "loc": 5, "targetFrameworks": ["net48", "net8.0"], "projectReferences": ["b.csproj"], "modernProjectReferences": [],
             "packageReferences": [{"id": "P", "version": "1.0", "tfms": ["net48"]}], "resolved": {"net48": {"packages": [{"id": "P", "version": "1.0", "direct": True, "dependencies": [{"id": "Q", "range": "[1.0, )"}]}]}}},
            {"id": "b.csproj", "name": "b", "assemblyName": "b", "kind": "library", "frameworkClass": "framework", "loc": 7, "hostedBy": {"project": "a.csproj", "evidence": []}},
        ],
        "graph": {"edges": [{"from": "a.csproj", "to": "b.csproj", "kind": "project"}], "cycles": [], "topologicalOrder": []},
        "packages": {"P": {"versions": {"1.0": ["a.csproj"]}}}, "inputs": [{"path": "a.csproj", "sha256": "00"}],
    }
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=1))
    t = model.tables(model.read_workspace(spark, str(tmp_path / "w.json")))
    assert [r["hosted_by"] for r in t["project"].orderBy("id").collect()] == [None, "a.csproj"]
    assert t["modern_list"].count() == 1 and t["modern_ref"].count() == 0
    assert tuple(t["edge"].first()) == ("a.csproj", "b.csproj", "project")
    assert tuple(t["package_usage"].first()) == ("P", "1.0", "a.csproj")
    assert tuple(t["resolved_dependency"].first()) == ("a.csproj", "net48", "P", "1.0", "Q", "[1.0, )")


def test_file_sources(spark, tmp_path):
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger/b.json").write_text('{"createdAt": "2026-01-01", "solution": "s", "totals": {"projects": 1, "loc": 2}}')
    (tmp_path / "ledger/a.json").write_text('{"createdAt": "2026-01-01", "solution": "s"}')
    (tmp_path / "ledger/c.json").write_text('{"createdAt": ')
    good, bad = model.read_ledger(spark, str(tmp_path / "ledger"))
    assert [r["file"] for r in good.collect()] == ["a.json", "b.json"] and [r["file"] for r in bad.collect()] == ["c.json"]
    (tmp_path / "packages.config").write_text('<packages><package id="A" version="1.0" /><package id="a" version="1.0" targetFramework="net48" /><package id="B" version="2.0" developmentDependency="true" /></packages>')
    rows = model.read_packages_config(spark, str(tmp_path / "packages.config")).orderBy("id").collect()
    assert [(r["id"], r["version"], r["development_dependency"]) for r in rows] == [("A", "1.0", False), ("B", "2.0", True)]
    (tmp_path / "f.slnf").write_text(json.dumps({"solution": {"path": "x\\s.sln", "projects": ["src\\a.csproj"]}}))
    assert tuple(model.read_solution_filter(spark, str(tmp_path / "f.slnf")).first()) == ("x/s.sln", "src/a.csproj")
    (tmp_path / "s.sln").write_text('Project("{F}") = "A", "src\\A.csproj", "{G}"\nEndProject\n')
    assert tuple(model.read_solution(spark, str(tmp_path / "s.sln")).first()) == ("A", "src/A.csproj")
    (tmp_path / "tree/obj").mkdir(parents=True)
    (tmp_path / "tree/a.cs").write_text("x")
    (tmp_path / "tree/obj/b.cs").write_text("y")
    assert [r["path"] for r in model.read_inputs(spark, str(tmp_path / "tree"), "*.cs").collect()] == ["a.cs"]
    (tmp_path / "assets.json").write_text(json.dumps({"targets": {"net48": {"P/1.0": {"type": "package", "dependencies": {"Q": "2.0"}}, "R/1.0": {"type": "package"}}}}))
    assert {tuple(r) for r in model.read_assets(spark, str(tmp_path / "assets.json")).select("id", "dep_id").collect()} == {("P", "Q"), ("R", None)}
    pytest.importorskip("yaml")
    r, k = model.read_rules(spark, "rules:\n  X1:\n    pack: api\n    severity: error\n    symbols: ['T:A']\n    excludes: ['T:B']\n")
    assert r.first()["severity"] == "error" and k.count() == 2


def test_sinks(spark, tmp_path):
    findings = spark.createDataFrame([("R2", "warning", "p", "f.cs", 3, 1, "S", "m|x"), ("R1", "error", "p", "f.cs", 1, 1, "S", None)], "rule string, severity string, project string, file string, line int, column int, symbol string, message string")
    run = json.loads(sinks.sarif(findings, "tool", "1"))["runs"][0]
    assert [r["ruleIndex"] for r in run["results"]] == [0, 1] and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"]
    assert "m\\|x" in sinks.markdown(findings.select("message"), "T")
    assert "- 1 more" in sinks.grouped_markdown(spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c")], "g string, l string"), "g", "l", 2)
    nodes, edges = spark.createDataFrame([("a", "x"), ('b"', "y")], "id string, c string"), spark.createDataFrame([("a", 'b"')], "src string, dst string")
    assert '"a" -> "b\\"";' in sinks.dot(nodes, edges, "c") and "n0 --> n1" in sinks.mermaid(nodes, edges) and "<pre" in sinks.html(nodes, edges, "t")
    assert json.loads(sinks.envelope(nodes, "graph", "1").first()[0])["result"][0]["id"] == "a"
    assert [sinks.exit_code(), sinks.exit_code(findings=True), sinks.exit_code(findings=True, partial=True, usage=True)] == [0, 1, 2]
    told = spark.createDataFrame([("C1", "warning", "b", 1, 1, "m"), ("C2", "warning", None, None, None, "m"), ("C3", "error", "a", 1, 1, "m")], "code string, severity string, file string, line int, column int, message string")
    assert [r["code"] for r in sinks.ordered_diagnostics(told, {"C3": "none"}).collect()] == ["C2", "C1"]
    snap = spark.createDataFrame([("2026-01-01T00:00:00Z", "s", 3)], "created_at string, solution string, loc int")
    for _ in range(2):
        sinks.append_ledger(snap, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1


def test_ledger_stream(spark, tmp_path):
    from tesserae.streaming import ledger

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"createdAt": "2026-01-01T00:00:00Z", "solution": "s"}')
    for _ in range(2):
        ledger.follow(ledger.snapshots(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_wrong_answers_fail():
    assert verify.key(1.0) != verify.key(2.0) and verify.key(None) != verify.key("None")


def test_redirects_tell_cases_apart(spark):
    ref = spark.createDataFrame([("A", "1.9.0.0"), ("A", "1.10.0.0"), ("B", "3.0.0.0"), ("C", "1.0.0.0"), ("D", "1.0.0.0"), ("E", "1.0.0.0")], "name string, version string")
    dep = spark.createDataFrame([("a", "1.10.0.0", True), ("B", "2.0.0.0", True), ("C", "1.0.0.0", True), ("D", "2.0.0.0", False), ("E", "2.0.0.0", True)], "name string, version string, signed boolean")
    old = spark.createDataFrame([("A", "0.0.0.0-1.10.0.0", "1.10.0.0", 1), ("A", "0.0.0.0-9.0.0.0", "9.0.0.0", 2), ("B", "x", "2.0.0.0", 3), ("C", "x", "0.9.0.0", 4), ("Gone", "x", "1.0.0.0", 5)], "name string, old string, version string, place int")
    rows = {(r["name"], r["action"]): (r["old"], r["version"], r["was"]) for r in versions.redirects(ref, dep, old).collect()}
    assert rows == {
        ("a", "unchanged"): ("0.0.0.0-1.10.0.0", "1.10.0.0", None), ("b", "lower"): (None, "2.0.0.0", None), ("b", "unchanged"): ("x", "2.0.0.0", None), ("c", "changed"): ("0.0.0.0-1.0.0.0", "1.0.0.0", "0.9.0.0"),
        ("e", "added"): ("0.0.0.0-2.0.0.0", "2.0.0.0", None), ("gone", "stale"): ("x", "1.0.0.0", None),
    }
    assert ("gone", "pruned") in {(r["name"], r["action"]) for r in versions.redirects(ref, dep, old, prune=True).collect()}


def test_row_order_changes_nothing(spark):
    rows = [(i, f"pkg{i % 7}.name{i % 5}") for i in range(300)]
    patterns = spark.createDataFrame([("pkg1", 1), ("pkg1.name", 2), ("pkg2", 3)], "prefix string, source int")
    keys = spark.createDataFrame([("R", "pkg1", False), ("R", "name2", True), ("S", "name3", False)], "rule string, key string, is_exclude boolean")
    seen = set()
    for n in (1, 7):
        df = spark.createDataFrame(rows[:: 1 if n == 1 else -1], "id long, name string").repartition(n).distinct()
        got = R.longest_prefix(df, "name", patterns, "prefix", source="source").select("id", "prefix").collect()
        hit = rules.match(df.withColumn("keys", F.split("name", r"\.")), keys).select("id", "rule").collect()
        seen.add((tuple(sorted((r["id"], r["prefix"] or "") for r in got)), tuple(sorted(map(tuple, hit)))))
    assert len(seen) == 1 and len(next(iter(seen))[0]) == 300
    assert sorted(seen.pop()[1]) == sorted([(i, "R") for i in range(300) if i % 7 == 1 and i % 5 != 2] + [(i, "S") for i in range(300) if i % 5 == 3])


def test_many_targets_and_lengths_are_not_dropped(spark):
    assets = spark.createDataFrame([("p", "1", "f")], "package string, version string, framework string")
    relation = spark.createDataFrame([("t1", "f")], "target string, framework string")
    targets = spark.range(9_000).select(F.concat(F.lit("t"), "id").alias("target"))
    assert R.compatible(targets, assets, relation).count() == 9_000
    with pytest.raises(ValueError):
        R.compatible(spark.range(10_500).select(F.col("id").cast("string").alias("target")), assets, relation)


def test_consolidation_says_what_it_cannot_settle(spark):
    direct = spark.createDataFrame([("A", "p", "direct", "[1.0, 2.0)"), ("A", "q", "direct", "[3.0, )"), ("B", "p", "direct", "[1.0, 1.5]")], "id string, project string, kind string, range string")
    options = spark.createDataFrame([("A", "1.0"), ("A", "3.0"), ("B", "1.0"), ("B", "2.0"), ("C", "2.0")], "id string, version string")
    chosen = versions.choose(options, direct)
    assert {tuple(r) for r in versions.unsatisfied(direct, chosen).select("id", F.array_join("ranges", ";")).collect()} == {("A", "[1.0, 2.0);[3.0, )")}
    families = spark.createDataFrame([("B", "f"), ("C", "f")], "id string, family string")
    held = {tuple(r) for r in versions.align_families(chosen.filter("id != 'A'"), families, options, direct.select("id", "range")).collect()}
    assert ("B", "1.0") in held and ("C", "2.0") in held
    usage, support = spark.createDataFrame([("B", "x"), ("B", "y")], "id string, tfm string"), spark.createDataFrame([("B", "1.0", "x"), ("B", "2.0", "x"), ("B", "2.0", "y")], "id string, version string, tfm string")
    assert {tuple(r) for r in versions.supports_all(options, usage, support).collect()} == {("A", "1.0"), ("A", "3.0"), ("B", "2.0"), ("C", "2.0")}


def test_shortest_edit_scripts():
    import random

    from tesserae.operators.facts import edit_script

    random.seed(1)
    for _ in range(300):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        script, common = edit_script(a, b), [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
        gone, come = {i for o, i in script if o == "-"}, {i for o, i in script if o == "+"}
        assert [x for i, x in enumerate(a) if i not in gone] == [y for j, y in enumerate(b) if j not in come]
        assert len(script) == len(a) + len(b) - 2 * common[-1][-1]


def test_hosted_framework_project_blocks_its_application(spark):
    projects = spark.createDataFrame([("app", "standard"), ("area", "framework")], "id string, framework_class string")
    edges = spark.createDataFrame([("app", "x")], "src string, dst string")
    row = reports.application(projects, edges, spark.createDataFrame([("area", "app")], "id string, hosted_by string"), "app").first()
    assert (row["remaining"], row["status"], row["next"]) == (1, "blocked", ["area"])


def test_library_report_broadcasts_no_table(spark):
    """The sizes of parts are as many as the graph has nodes: they are shuffled, however small their files look."""
    assert "BroadcastHashJoin" not in catalog.QUERIES["library_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
