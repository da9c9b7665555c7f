"""Documents, inputs by increments, settings in layers, gates by versions and the whole report."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tesserae.operators import gating, reports
from tesserae.plans import commands
from tesserae.sources import documents, feed, inputs, settings


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def states(df):
    return {r["path"]: (r["sha256"], r["was_read"]) for r in df.collect()}


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    root, kept = tmp_path / "work", str(tmp_path / "state")
    for name, at in (("a.proj", 1000), ("sub/b.proj", 2000), ("bin/c.proj", 3000), ("d.proj", 4000)):
        put(root / name, name, at)
    none = spark.createDataFrame([], inputs.STATE)
    first = inputs.refreshed(spark, str(root), none, "*.proj")
    assert {p: read for p, (_, read) in states(first).items()} == {"a.proj": True, "sub/b.proj": True, "d.proj": True}
    inputs.save_state(first, kept, 1)
    inputs.save_state(first, kept, 1)  # a run that is written again replaces itself
    before = inputs.last_state(spark, kept)
    assert before.count() == 3
    assert not any(read for _, read in states(inputs.refreshed(spark, str(root), before, "*.proj")).values())
    # another text of the same length and time: not seen, which shows that the file was not opened
    put(root / "a.proj", "A.PROJ", 1000)
    put(root / "sub/b.proj", "longer than before", 2000)
    put(root / "e.proj", "e", 1500)
    (root / "d.proj").unlink()
    now = inputs.refreshed(spark, str(root), before, "*.proj").checkpoint()
    assert {p: read for p, (_, read) in states(now).items()} == {"a.proj": False, "sub/b.proj": True, "e.proj": True}
    assert {r["path"]: r["change"] for r in inputs.staleness(before, now).collect()} == {"sub/b.proj": "changed", "d.proj": "removed", "e.proj": "added"}
    inputs.save_state(now, kept, 2)
    assert {r["path"] for r in inputs.last_state(spark, kept).collect()} == {"a.proj", "sub/b.proj", "e.proj"}


@pytest.mark.parametrize("one_file", [True, False])
def test_documents_are_one_object(spark, tmp_path, one_file):
    rows = spark.range(50).select((F.lit(50) - F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, 'a "quoted"\nline').alias("text")).repartition(7)
    told = spark.createDataFrame([("C2", "warning", "f", 1, None, "x"), ("C1", "error", None, None, None, "y"), ("C3", "info", "a", 1, 1, "z")], "code string, severity string, file string, line int, column int, message string")
    path = str(tmp_path / "out")
    documents.write_document(documents.envelope_lines(rows, [F.col("n")], {"command": "c", "version": "1", "exit": 0}, told, {"C3": "none", "C2": "error"}), path, one_file)
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    assert (len(names) == 1) or not one_file
    whole = json.loads("".join(open(f"{path}/{n}").read() for n in names))
    assert (whole["command"], whole["exit"]) == ("c", 0)
    assert [r["n"] for r in whole["result"]] == list(range(1, 51)) and {r.get("text") for r in whole["result"]} == {None, 'a "quoted"\nline'}
    assert [(r["code"], r["severity"]) for r in whole["diagnostics"]] == [("C1", "error"), ("C2", "error")]


def test_documents_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], "rule string, project string, file string, line int, column int, symbol string, severity string, message string")
    rules = spark.createDataFrame([("R1", "one rule", "do it", None, "error", "api", None)], "rule string, title string, recommendation string, help_uri string, severity string, category string, pack string")
    path = str(tmp_path / "s")
    documents.write_document(documents.sarif_lines(none, rules, "t", "1"), path)
    assert documents.read_sarif(spark, path).count() == 0
    (name,) = [n for n in os.listdir(path) if n.startswith("part-")]
    (run,) = json.load(open(f"{path}/{name}"))["runs"]
    assert run["results"] == []
    assert run["tool"]["driver"]["rules"] == [{"id": "R1", "name": "OneRule", "shortDescription": {"text": "one rule"}, "help": {"text": "do it"}, "defaultConfiguration": {"level": "error"}, "properties": {"category": "api", "tags": ["t", "api"]}}]
    documents.write_document(documents.envelope_lines(none, [F.col("rule")], {}), str(tmp_path / "e"))
    assert documents.read_envelope(spark, str(tmp_path / "e"), "rule string").select(F.size("result"), F.size("diagnostics")).first() == (0, 0)


def test_the_last_layer_that_sets_a_key_decides(spark):
    rows = lambda *xs: spark.createDataFrame(xs, "key string, value string")
    env = settings.environment(spark, {"TOOL_MAX_DEPTH": "7", "OTHER_MAX_DEPTH": "9", "TOOL_OUT": ""}, "TOOL_")
    layers = [("file", rows(("maxDepth", "3"), ("only", "x"), (None, "y"), ("nothing", None))), ("environment", env), ("flags", rows(("max-depth", None), ("only", "z")))]
    assert {tuple(r) for r in settings.effective(layers).collect()} == {("maxDepth", "7", "environment"), ("only", "z", "flags"), ("OUT", "", "environment")}


def test_gates_by_versions(spark):
    segments = spark.createDataFrame([("d", "c", None, "a"), ("d", "c", "9.0", "b"), ("d", "c", "10.0", "a"), ("d", "late", "9.0", "x")], "detector string, case string, begins string, label string")
    projects = spark.createDataFrame([("p", "8.0", "9.0"), ("q", "8.0", "10.0"), ("r", None, "9.0"), ("s", "9.0", "9.0"), ("t", "9.0", "8.0"), ("u", "9.0-rc", "9.0")], "project string, current string, target string")
    got = {tuple(r) for r in gating.gated(projects, segments).select("project", "case", "was", "becomes").collect()}
    assert got == {("p", "c", "a", "b"), ("q", "late", None, "x"), ("p", "late", None, "x"), ("u", "c", "a", "b"), ("u", "late", None, "x")}
    assert gating.gated(projects, segments.limit(0)).count() == 0
    assert gating.gated(projects.limit(0), segments).count() == 0


def test_a_scan_without_sites(spark):
    empty = spark.createDataFrame([], "shape string, name string, project string, file string, line int, column int, symbol string")
    detectors = spark.createDataFrame([("d", "call", "%")], "detector string, shape string, pattern string")
    projects = spark.createDataFrame([("p", "1.0", "2.0")], "project string, current string, target string")
    segments = spark.createDataFrame([("d", "c", "2.0", "x")], "detector string, case string, begins string, label string")
    calls, verdicts = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "node string, reason string")
    out = commands.serializer_scan(empty, detectors, projects, segments, calls, verdicts)
    assert [out[k].count() for k in ("sites", "findings", "summary")] == [0, 0, 0]


def test_what_becomes_of_framework_assemblies(spark):
    asked = spark.createDataFrame([("p", "Web", "framework"), ("q", "web", "framework"), ("q", "Odd", "framework"), ("q", "File", "file")], "project string, name string, kind string")
    mapping = spark.createDataFrame([("WEB", "none", None)], "name string, kind string, package string")
    usages = spark.createDataFrame([("p", "web", 3), ("q", "Odd", 0)], "project string, name string, n long")
    better = spark.createDataFrame([("web", 2, ["A", "B"], None, "package", "Late"), ("Web", 1, ["A"], None, "builtin", None)], "name string, place int, only array<string>, needs string, kind string, package string")
    types = spark.createDataFrame([("p", "Web", ["A", "A"]), ("q", "Web", [])], "project string, name string, types array<string>")
    out = commands.gac_report(asked, mapping, usages, better, types)
    assert [tuple(r) for r in out["references"].collect()] == [("p", "Web", "builtin", None, 3), ("q", "Odd", "unknown", None, 0), ("q", "web", "none", None, None)]
    assert out["summary"].first().asDict() == {"builtin": 1, "package": 0, "compat_pack": 0, "none": 1, "unknown": 1, "unused": 1}
    assert commands.gac_report(asked, mapping, usages, project="P")["references"].count() == 1


def test_the_whole_report(spark):
    p = spark.createDataFrame([("w", "web", "framework", 10, None), ("h", "console", "modern", 5, "w"), ("l", "library", "framework", 7, None), ("m", "library", "standard", 3, None)], "id string, kind string, framework_class string, loc long, hosted_by string")
    e = spark.createDataFrame([("w", "m", "project"), ("h", "l", "project")], "src string, dst string, kind string")
    t = {"project": p, "edge": e, "modern_list": spark.createDataFrame([], "project string"), "modern_ref": spark.createDataFrame([], "project string, target string")}
    old = spark.createDataFrame([("2020", "s", "f1", 4, 25, 20), ("2021", "other", "f2", 9, 9, 9), ("2023", "s", "f3", 1, 1, 1)], "created_at string, solution string, file string, projects long, loc long, framework_loc long")
    out = commands.report(t, old, "s", "2022", shipped=spark.createDataFrame([("m", "packable")], "id string, reason string"))
    # the hosted project is no application of its own, and brings what it needs
    assert [tuple(r) for r in out["applications"].select("application", "projects", "remaining", "status").collect()] == [("w", 4, 2, "blocked")]
    assert [(r["project"], r["status"]) for r in out["libraries"].collect()] == [("m", "done")]
    assert [tuple(r) for r in out["series"].select("created_at", "framework_loc", "change").collect()] == [("2020", 20, 0), ("2022", 17, -3)]
    assert {tuple(r) for r in out["done"].collect()} == {("applications", 1, 0), ("libraries", 1, 1)}
    assert reports.application_report(p, e, p.filter("hosted_by IS NOT NULL").select("id", "hosted_by"), p.limit(0).select("id")).count() == 0


def test_recorded_feed(spark, tmp_path):
    need = [("net1", [("B", "[1.0, )"), ("C<&>", None)]), (None, [])]
    rows = [("A", "1.0", ["lib/net1/A.dll", "ref/net2/A.dll", "lib/loose.dll", "x.txt"], need), ("E", "2.0-rc", None, None), (None, "1", [], []), ("F", None, [], [])]
    told = spark.createDataFrame(rows, f"id string, version string, files array<string>, groups {feed.GROUPS}")
    made = {r["path"]: bytes(r["content"]) for r in feed.recorded(told).collect()}
    assert sorted(made) == ["a.1.0.nupkg", "e.2.0-rc.nupkg"]
    # the same rows make the same bytes, whatever the order of their files
    again = told.withColumn("files", F.reverse("files")).repartition(3)
    assert {r["path"]: bytes(r["content"]) for r in feed.recorded(again).collect()} == made
    old = "<package xmlns='urn:x'><metadata><id>O</id><version>1</version><dependencies><dependency id='B' version='2'/></dependencies></metadata></package>"
    for name, content in {**made, "old.nupkg": feed.archive({"O.nuspec": old.encode()}), "bad.nupkg": b"PK", "none.nupkg": feed.archive({"a": b""}), "two.nupkg": feed.archive({"a.nuspec": b"", "b.nuspec": b""}), "broken.nupkg": feed.archive({"a.nuspec": b"<a"}), "note.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    read = feed.packages(feed.feed_files(spark, str(tmp_path)))
    known = {r["path"].rsplit("/", 1)[1]: r for r in read.collect()}
    assert {k: r["problem"] for k, r in known.items()} == {"a.1.0.nupkg": None, "e.2.0-rc.nupkg": None, "old.nupkg": None, "bad.nupkg": "BadZipFile", "none.nupkg": "no specification", "two.nupkg": "several specifications", "broken.nupkg": "ParseError"}
    assert (known["e.2.0-rc.nupkg"]["files"], known["e.2.0-rc.nupkg"]["groups"]) == ([], [])
    assert {tuple(r) for r in feed.dependencies(read).collect()} == {("A", "1.0", "net1", "B", "[1.0, )"), ("A", "1.0", "net1", "C<&>", None), ("O", "1", None, "B", "2")}
    assert {tuple(r)[2:] for r in feed.assets(read).collect()} == {("net1", "lib/net1/A.dll"), ("net2", "ref/net2/A.dll")}
