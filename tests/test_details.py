"""Kinds, ledgers, differences, searches with reasons, hazards: small cases by hand."""

import json

from pyspark.sql import functions as F

from tesserae.functions import scalars
from tesserae.operators import facts, fixpoints, relational, reports, rules, selection
from tesserae.plans import commands
from tesserae.sources import sinks


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_project_kinds(spark):
    fields = "id int, guids string, sdk string, out string, refs array<string>, packages array<string>, listed array<string>, test boolean, web boolean, forms boolean, wpf boolean"
    rows = [
        (1, None, None, None, None, None, None, None, None, None, None),
        (2, None, None, "Exe", None, ["NUnit"], None, False, False, False, False),
        (3, None, None, "Exe", ["System.ServiceProcess"], ["NUnit"], None, False, False, False, False),
        (4, None, "Microsoft.NET.Sdk.Web", "Exe", None, ["xunit"], None, None, None, None, None),
        (5, None, None, "Library", ["XUNIT"], None, None, None, None, None, None),
        (6, None, None, "Exe", ["xunit"], None, None, None, None, None, None),
        (7, None, None, "Library", ["System.Web"], None, None, None, True, None, None),
        (8, None, None, "Library", None, None, ["Topshelf"], None, None, None, None),
        (9, None, None, "Odd", None, None, None, None, None, None, None),
        (10, None, None, "WinExe", ["xunit"], ["TUnit", "MSTest"], None, None, None, True, None),
    ]
    found = scalars.project_kind(*[F.col(c) for c in ("guids", "sdk", "out", "refs", "packages", "listed", "test", "web", "forms", "wpf")])
    kinds = {r[0]: (r[1], r[2]) for r in spark.createDataFrame(rows, fields).select("id", found.alias("f")).select("id", "f.*").collect()}
    assert kinds == {
        1: ("library", "OutputType=Library"), 2: ("test", "PackageReference NUnit"), 3: ("service", "Reference System.ServiceProcess + OutputType=Exe"),
        4: ("web", "Sdk=Microsoft.NET.Sdk.Web"), 5: ("test", "Reference xunit + OutputType=Library"), 6: ("console", "OutputType=Exe"),
        7: ("web", "Reference System.Web + OutputType=Library + web.config"), 8: ("library", "OutputType=Library"), 9: ("unknown", "OutputType=Odd"),
        10: ("winforms", "UseWindowsForms=true"),
    }


def test_ledger_of_projects_without_files_and_findings(spark):
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", None), ("c", "x")], "project string, file string")
    found = spark.createDataFrame(
        [("a", "x", "error", "api", "N"), ("a", "x", "error", "api", None), ("a", "y", "warning", "io", "M"), ("c", "other", "error", "api", None)], "project string, file string, severity string, category string, namespace string"
    )
    rows = {r["project"]: r.asDict() for r in rules.ledger(files, found).collect()}
    assert [(r["files"], r["portable_files"], r["portability"]) for r in (rows["a"], rows["b"], rows["c"])] == [(3, 2, 0.667), (0, 0, 1.0), (1, 1, 1.0)]
    assert rows["a"]["by_category"] == {"api": 2, "io": 1} and rows["a"]["by_namespace"] == {"M": 1, "N": 1}
    assert rows["b"]["by_category"] == {} and rows["c"]["by_namespace"] == {}


def test_words_in_any_case(spark):
    texts = spark.createDataFrame([(2, "Go home"), (1, "HOME go Go")], "doc int, text string")
    assert got(rules.word_index(texts, "doc", "text", ignore_case=True), "word") == [("go", 1, 1), ("home", 1, 0)]
    assert got(rules.word_index(texts, "doc", "text"), "word") == [("Go", 1, 2), ("HOME", 1, 0), ("go", 1, 1), ("home", 2, 1)]


def test_api_differences(spark):
    text = "noise\n CP0002: Member 'A.B()' exists on /o/Left.dll but not on /o/r$.dll \r\nCP1001: left out\nCP0003:\nCP0004: in /O/R$.DLL only\nCP0005: '' exists on elsewhere"
    rows = got(facts.api_differences(spark.createDataFrame([(text,), (text,), (None,)], "t string"), "t", [("/o/left.dll", "one"), ("/o/r$.dll", "t$o")]), "code")
    assert rows == [("CP0002", "A.B()", "one", "Member 'A.B()' exists on one but not on t$o"), ("CP0004", "in t$o only", None, "in t$o only"), ("CP0005", "", None, "'' exists on elsewhere")]


def test_entry_points_and_reasons(spark):
    # e -> d -> c -> b -> a by calls; f calls x; y has no verdict
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "x"), ("a", "b")], "src string, dst string")
    verdicts = spark.createDataFrame([("a", "late"), ("b", "hidden"), ("c", None), ("d", "late"), ("e", "late"), ("x", "hidden"), ("f", "late")], "node string, reason string")
    starts = spark.createDataFrame([("a",), ("x",), ("y",), ("c",), ("d",)], "s string")
    rows = {r["start"]: r for r in fixpoints.entry_points(starts, calls, verdicts, depth=2).collect()}
    assert (rows["a"]["entry"], rows["a"]["path"], rows["a"]["reason"], rows["a"]["candidates"]) == ("c", ["c", "b", "a"], None, None)
    assert (rows["c"]["entry"], rows["c"]["path"]) == ("c", ["c"])
    assert (rows["x"]["entry"], rows["x"]["reason"], [tuple(c) for c in rows["x"]["candidates"]]) == (None, "hidden", [("x", "hidden"), ("f", "late")])
    assert (rows["y"]["reason"], rows["y"]["candidates"]) == ("not accessible", [])
    assert rows["d"]["reason"] == "late"
    short = {r["start"]: r for r in fixpoints.entry_points(starts, calls, verdicts, depth=1, listed=1).collect()}
    assert short["a"]["reason"] == "depth exceeded" and len(short["a"]["candidates"]) == 1
    assert fixpoints.entry_points(starts.limit(0), calls, verdicts).count() == 0


def test_first_violation_and_first_cycle(spark):
    calls = spark.createDataFrame([("s", "b"), ("s", "a"), ("a", "z"), ("b", "w"), ("w", "s"), ("t", "s")], "src string, dst string")
    bad = spark.createDataFrame([("z",), ("w",), ("s",)], "b string")
    starts = spark.createDataFrame([("s",), ("t",), ("z",), ("a",)], "n string")
    assert got(fixpoints.first_violation(starts, calls, bad), "start") == [("a", "z", ["a", "z"]), ("s", "z", ["s", "a", "z"]), ("t", "s", ["t", "s"])]
    assert got(fixpoints.first_violation(starts, calls, bad, depth=1), "start") == [("a", "z", ["a", "z"]), ("t", "s", ["t", "s"])]
    assert got(fixpoints.first_self_reaching(calls), "node") == [("b",)]
    assert fixpoints.first_self_reaching(calls.filter("src = 't'")).count() == 0


def test_case_paths_follow_segments(spark):
    files = spark.createDataFrame([("Src/a/X.cs",), ("src/A/y.cs",), ("Lib/z.cs",)], "path string")
    asked = spark.createDataFrame([("src/a/y.cs",), ("SRC/a/x.CS",), ("lib",), ("Lib/z.cs",), ("Lib/q.cs",), ("src/A",)], "path string")
    assert got(selection.case_paths(asked, files), "path") == [("SRC/a/x.CS", "Src/a/X.cs", "SRC", "Src"), ("lib", "Lib", "lib", "Lib"), ("src/a/y.cs", "src/A/y.cs", "a", "A")]
    assert selection.case_paths(asked.limit(0), files).count() == 0


def test_version_hazards(spark):
    props = spark.createDataFrame([(".", None), ("a", False), ("a/b", True)], "folder string, imports_parent boolean")
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    rows = got(selection.version_hazards(props, ids("a/b/p.csproj", "q.csproj", "C/r.csproj"), ids("c/R.csproj", "q.csproj"), ids("q.csproj")), "hazard", "path")
    assert rows == [("old style", "q.csproj", None), ("outside", "a/b/p.csproj", "a/b"), ("shadows", "a", ".")]


def test_covering_sets_flawed_ones_aside(spark):
    sets = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1)], "k string, m int")
    flawed = spark.createDataFrame([("b",)], "f string")
    assert got(relational.covering(sets, "k", "m"), "k") == [("b", 3, "covers")]
    assert got(relational.covering(sets, "k", "m", flawed), "k") == [("a", 2, "covers")]
    assert got(relational.covering(sets, "k", "m", sets.select("k")), "k") == [("b", 3, "covers")]


def test_windows_evidence(spark):
    assets = spark.createDataFrame(
        [("p", "lib/n/b.dll", "n", "registry"), ("p", "lib/n/a.dll", "n", None), ("q", "lib/o/a.dll", "o", "forms"), ("q", "ref/n/a.dll", "n", None), ("r", "runtimes/WIN-x64/lib/a.dll", "n", None), ("s", "runtimes/linux/lib/a.dll", "n", None)],
        "package string, path string, framework string, marker string",
    )
    native = spark.createDataFrame([("r", "runtimes/win10/native/z.dll"), ("s", "runtimes/win/native/a.dll"), ("p", "runtimes/win/native/a.dll")], "package string, path string")
    rank = spark.createDataFrame([("t", "n", 1)], "target string, framework string, rank int")
    assert got(selection.windows_evidence(assets, rank, native), "package") == [("p", "t", "lib/n/b.dll: registry"), ("r", "t", "runtimes/win10/native/z.dll: native code for Windows only")]


def test_dependency_audit_filters(spark):
    usage = spark.createDataFrame([("a", "A", "1.0"), ("a", "B", "1.0"), ("b", "B", "2.0"), ("b", "Skip", "1.0")], "project string, id string, version string")
    support = usage.select("id", "version").distinct().withColumns({"supports": F.lit(True), "empty": F.lit(False)})
    none = spark.createDataFrame([], "pattern string, replacement string, whole boolean")
    found = support.select("id", "version", "supports").limit(0)
    ids = lambda **k: [r["id"] for r in commands.deps_audit({"package_usage": usage}, support, found, none, **k).collect()]
    assert ids() == ["A", "B", "Skip"]
    assert ids(ignored=("SKIP",)) == ["A", "B"]
    assert ids(package="b") == ["B"] and ids(project="a") == ["A", "B"] and ids(project="b", ignored=("skip",)) == ["B"]


def test_sarif_lists_rules(spark):
    fields = "rule string, project string, file string, line int, column int, symbol string, severity string, message string"
    findings = spark.createDataFrame([("R2", "p", "f.cs", 3, 4, "s", "error", "m")], fields)
    rule = spark.createDataFrame([("R1", "No file access", "Use streams", None, "info", "io", "core"), ("R2", "x", None, "h", "error", None, None)], "rule string, title string, recommendation string, help_uri string, severity string, category string, pack string")
    run = json.loads(sinks.sarif(findings, "t", "1", rule))["runs"][0]
    first, second = run["tool"]["driver"]["rules"]
    assert first == {"id": "R1", "name": "NoFileAccess", "shortDescription": {"text": "No file access"}, "help": {"text": "Use streams"}, "defaultConfiguration": {"level": "note"}, "properties": {"category": "io", "tags": ["t", "core", "io"]}}
    assert second["helpUri"] == "h" and "help" not in second and run["results"][0]["ruleIndex"] == 1


def test_counterparts_and_their_problems(spark):
    fields = "id string, name string, applies boolean, language string, excluded boolean, frozen boolean, framework_class string, compiled boolean, test boolean"
    one = lambda id_, applies=False, cls="standard", language="csharp", test=False: (id_, id_.upper(), applies, language, False, False, cls, True, test)
    p = spark.createDataFrame([one("a", True, "framework"), one("b", True, "framework"), one("c", True, "framework"), one("d", True, "framework"), one("s"), one("m", cls="modern"), one("v", language="basic"), one("t", test=True)], fields)
    e = spark.createDataFrame([("b", "s"), ("b", "t"), ("b", "m"), ("s", "d")], "src string, dst string")
    unsuited = spark.createDataFrame([("b", "s", "net48")], "project string, counterpart string, target string").limit(0)
    entries = [("A", "s"), ("A", "V"), ("A", "nowhere"), ("D*", "s"), ("D*", "{name}"), ("C", "nowhere")]
    found = {(r[0], r[1]): (r[2], r[3]) for r in selection.counterparts(p, entries, e, unsuited).collect()}
    assert found == {
        ("a", "s"): ("map", None), ("a", "v"): ("map", "language"), ("b", "s"): ("references", None), ("c", None): ("map", None),
        ("d", "s"): ("map", "depends on it"), ("d", "d"): ("map", "itself"),
    }
    bad = spark.createDataFrame([("b", "s", "net48")], "project string, counterpart string, target string")
    found = {(r[0], r[1]): (r[2], r[3]) for r in selection.counterparts(p, [], e, bad).collect()}
    assert found == {(x, None): ("none", None) for x in "abcd"}


def test_library_report(spark):
    p = spark.createDataFrame([("l", "library", "framework", 5), ("k", "library", "standard", 2), ("w", "web", "framework", 1), ("x", "library", "framework", 7)], "id string, kind string, framework_class string, loc long")
    e = spark.createDataFrame([("k", "x")], "src string, dst string")
    shipped = p.select("id", F.lit("packable").alias("reason"))
    hosted = spark.createDataFrame([("x", "w")], "id string, hosted_by string")
    rows = [(r["project"], r["status"], r["closure"], r["remaining"], r["remaining_loc"], r["next"]) for r in reports.library_report(p, e, shipped, hosted).orderBy("project").collect()]
    assert rows == [("k", "blocked", 2, 1, 7, ["x"]), ("l", "ready", 1, 1, 5, ["l"])]


def test_marked_graph(spark):
    nodes = spark.createDataFrame([("a", "framework", "test"), ("b", "dual", "wpf"), ("c", None, "odd")], "id string, framework_class string, kind string")
    edges = spark.createDataFrame([("a", "b", "project"), ("b", "a", "assembly"), ("c", "a", "assembly")], "src string, dst string, kind string")
    text = sinks.marked_dot(nodes, edges, spark.createDataFrame([("a", ["a", "b"])], "component string, members array<string>"))
    assert '"a" [fillcolor=firebrick, shape=box, style="filled,dashed", color=red];' in text and '"b" [fillcolor=darkorange, shape=box, peripheries=2, color=red];' in text
    assert '"c" [fillcolor=gray, shape=ellipse];' in text and '"a" -> "b" [color=red];' in text and '"b" -> "a" [style=dashed, color=red];' in text and '"c" -> "a" [style=dashed];' in text


def test_compile_differences(spark):
    before = spark.createDataFrame([("reference", "Old"), ("reference", "Same"), ("source", "A.cs")], "kind string, name string")
    after = spark.createDataFrame([("reference", "same"), ("reference", "New"), ("reference", "Face"), ("source", "a.cs"), ("resource", "r")], "kind string, name string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    packages = spark.createDataFrame([("new", "P")], "name string, package string")
    found = {tuple(r)[:4]: r["names"] for r in reports.compile_differences(before, after, packages, names("NEW", "old"), names("old", "face")).collect()}
    assert found == {
        ("reference", "added", "package", "P"): ["New"], ("reference", "added", "facade", None): ["Face"], ("reference", "removed", "declaration", None): ["Old"],
        ("source", "added", None, None): ["a.cs"], ("source", "removed", None, None): ["A.cs"], ("resource", "added", None, None): ["r"],
    }


def test_move_set_drops_what_nothing_wanted_needs(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "n string")
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("a", "outside")], "src string, dst string")
    kept = selection.kept_move_set(names(*"abcdef"), needs, names(*"abcdf"), names("a", "d", "f"))
    assert got(kept, "node") == [("a",), ("b",), ("c",), ("f",)]
