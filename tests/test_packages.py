"""Consolidation with its reasons, frameworks, wire shapes and line differences."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import consolidation as C
from tesserae.operators import facts, frameworks, rules, versions, wire
from tesserae.plans import commands


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- consolidation

USAGE = [("A", "1.0", "p"), ("A", "2.0", "q"), ("B", "1.0", "p")]


def world(spark, usage=USAGE, resolved=(), needs=(), options=(), asks=()):
    return (
        {
            "package_usage": spark.createDataFrame(list(usage), "id string, version string, project string"),
            "resolved_package": spark.createDataFrame(list(resolved), "project string, tfm string, id string, version string, direct boolean"),
            "resolved_dependency": spark.createDataFrame(list(needs), "project string, tfm string, id string, version string, dep_id string, `range` string"),
            "project": spark.createDataFrame([("p", ["net8.0"]), ("q", ["net48", "net8.0"])], "id string, tfms array<string>"),
        },
        spark.createDataFrame(list(options), "id string, version string"),
        spark.createDataFrame(list(asks), "id string, version string, dep_id string, `range` string"),
    )


OPTIONS = [(i, v) for i in "AB" for v in ("1.0", "2.0", "3.0")]


def pins_of(spark, *pins):
    return spark.createDataFrame(list(pins), "id string, version string, project string")


def test_a_projects_pin_takes_its_own_constraint_away(spark):
    t, options, asks = world(spark, [("A", "1.0", "p"), ("A", "2.0", "q")], options=OPTIONS)
    out = commands.deps_consolidate(t, options, asks, pins=pins_of(spark, ("a", "1.0", "p")))
    assert rows(out["chosen"], "id", "version") == [("A", "2.0")] and out["conflicts"].count() == 0
    assert rows(out["pins"], "id", "project", "pin", "standing", "version") == [("A", "p", "1.0", "below", "2.0")]
    assert rows(out["constraints"], "project", "range") == [("q", "[2.0, )")]


def test_a_pin_for_all_stands_beside_the_others(spark):
    t, options, asks = world(spark, [("A", "1.0", "p"), ("A", "2.0", "q")], options=OPTIONS)
    out = commands.deps_consolidate(t, options, asks, pins=pins_of(spark, ("A", "1.0", None)))
    assert out["chosen"].count() == 0
    assert rows(out["conflicts"], "id", "code", "project", "range", "chain") == [("A", "pin conflict", "q", "[2.0, )", ["q references A 2.0"])]
    out = commands.deps_consolidate(t, options, asks, pins=pins_of(spark, ("A", "3.0", None)))
    assert rows(out["chosen"], "id", "version", "kind", "reason") == [("A", "3.0", "pin", "pinned: A 3.0.0.")]


def test_transitive_and_selected_constraints_carry_their_chain(spark):
    resolved = [("p", "t", "Top", "1.0", True), ("p", "t", "Mid", "2.0", False), ("p", "t", "Also", "1.0", True), ("p", "t", "A", "1.0", True), ("p", "t", "Lost", "1.0", False)]
    needs = [("p", "t", "Top", "1.0", "mid", "[1.0, )"), ("p", "t", "Also", "1.0", "Mid", "[1.0, )"), ("p", "t", "Mid", "2.0", "a", "[1.5.0, )"), ("p", "t", "Lost", "1.0", "A", "(, 9.0)")]
    t, options, asks = world(spark, resolved=resolved, needs=needs, options=[*OPTIONS, ("A", "1.7")], asks=[("A", "2.0", "B", "[2.0, 4.0)")])
    out = commands.deps_consolidate(t, options, asks)
    # of two ways of two steps, Also comes before Top
    assert ("A", "transitive", "p", ["Also 1.0", "Mid 2.0", "A >= 1.5.0"]) in rows(out["constraints"], "id", "kind", "project", "chain")
    assert ("A", "transitive", "p", ["Lost 1.0", "A (< 9.0.0)"]) in rows(out["constraints"], "id", "kind", "project", "chain")
    assert rows(out["chosen"], "id", "version", "kind", "reason") == [("A", "2.0", "direct", "q references A 2.0."), ("B", "2.0", "selected", "A 2.0.0 → B (>= 2.0.0 && < 4.0.0).")]
    # without q, what Mid asks decides, and no option has just that version
    t["package_usage"] = t["package_usage"].filter("project = 'p'")
    out = commands.deps_consolidate(t, options, asks)
    assert rows(out["chosen"].filter("id = 'A'"), "version", "reason") == [("1.7", "The lowest version from 1.5.0 (p: Also 1.0 → Mid 2.0 → A >= 1.5.0).")]
    bad = commands.deps_consolidate(t, options, asks, pins=pins_of(spark, ("A", "1.0", "p")))
    assert rows(bad["pins"], "project", "pin", "standing", "chain") == [("p", "1.0", "conflict", ["Also 1.0", "Mid 2.0", "A >= 1.5.0"])]


def test_no_version_tells_the_highest_floor(spark):
    t, options, asks = world(spark, [("A", "1.0", "p"), ("A", "9.0", "q")], options=OPTIONS)
    out = commands.deps_consolidate(t, options, asks)
    assert rows(out["conflicts"], "id", "code", "project", "chain") == [("A", "no version", "q", ["q references A 9.0"])]


def test_families_move_together_and_tell_their_leader(spark):
    families = spark.createDataFrame([("a", "Fam"), ("B", "Fam"), ("C", None)], "id string, family string")
    usage = [("A", "2.0", "p"), ("B", "1.0", "p"), ("C", "1.0", "p"), ("D", "1.0", "p")]
    t, options, asks = world(spark, usage, options=[*OPTIONS, ("C", "1.0"), ("D", "1.0")])
    out = commands.deps_consolidate(t, options, asks, families=families)
    assert rows(out["chosen"], "id", "version") == [("A", "2.0"), ("B", "2.0"), ("C", "1.0"), ("D", "1.0")]
    assert rows(out["chosen"].filter("id = 'B'"), "reason") == [("Aligned with the Fam family at 2.0.0, which A needs: p references A 2.0.",)]
    out = commands.deps_consolidate(t, options.filter("NOT (id = 'B' AND version = '2.0')"), asks, families=families, package="a")
    assert rows(out["chosen"], "id", "version") == [("A", "2.0"), ("B", "1.0")] and rows(out["missing"], "id", "missing") == [("B", "2.0")]


def test_options_must_suit_the_frameworks_of_all_projects(spark):
    support = spark.createDataFrame([("A", "1.0", "net8.0"), ("A", "2.0", "net8.0"), ("A", "3.0", "net8.0"), ("A", "3.0", "net48")], "id string, version string, tfm string")
    t, options, asks = world(spark, [("A", "1.0", "p"), ("A", "2.0", "q")], options=[("A", v) for v in ("1.0", "2.0", "3.0")])
    assert rows(commands.deps_consolidate(t, options, asks, support)["chosen"], "version") == [("3.0",)]
    assert rows(commands.deps_consolidate(t, options, asks, support, pins=pins_of(spark, ("A", "2.0", "q")))["chosen"], "version") == [("1.0",)]


def test_null_families_are_no_group(spark):
    chosen = spark.createDataFrame([("A", "1.0"), ("B", "3.0"), ("C", "2.0")], "id string, version string")
    families = spark.createDataFrame([("A", None), ("B", None)], "id string, family string")
    assert rows(versions.align_families(chosen, families, chosen), "id", "version") == [("A", "1.0"), ("B", "3.0"), ("C", "2.0")]


@pytest.mark.parametrize("text,want", [("[1.0, )", ">= 1.0.0"), ("1.0-rc.1", ">= 1.0.0-rc.1"), ("[1.0.0.2]", "(= 1.0.0.2)"), ("(1.0, 2.0]", "(> 1.0.0 && <= 2.0.0)"), ("(, 2.0)", "(< 2.0.0)")])
def test_ranges_in_words(spark, text, want):
    assert spark.range(1).select(C.described(F.lit(text)).alias("x")).first()["x"] == want


# ---- verdicts


def test_all_new_codes_are_told(spark):
    now = spark.range(12_000).select(F.format_string("C%05d", "id").alias("code"), F.lit("f").alias("file"))
    row = commands.verdict(now, now.limit(0), ["code", "file"]).first()
    assert len(row["new_codes"]) == 12_000 == row["new"] and row["new_codes"][:2] == ["C00000", "C00001"] and not row["passes"]
    assert commands.verdict(now.limit(0), now, ["code", "file"]).first()["new_codes"] == []


# ---- frameworks


def serving(spark, pairs):
    df = spark.createDataFrame(pairs, "t string, o string")
    return [r["x"] for r in df.select(frameworks.serves(frameworks.framework(F.col("t")), frameworks.framework(F.col("o"))).alias("x")).collect()]


def test_which_framework_serves_which(spark):
    yes = "net48 net45;net472 net4.7.2;net472 netstandard2.0;net461 netstandard2.0;net45 netstandard1.1;net8.0 netstandard2.1;net5.0 netcoreapp3.1;netcoreapp2.1 netstandard2.0;net8.0-windows net8.0;net8.0-windows10.0.19041 net6.0-windows7.0;net48 any;netstandard2.1 netstandard1.0;net10.0 net8.0;net8.0 any;net45 portable-net40+win8;NET48 net40;net50 netstandard2.1;xamarinios xamarinios"
    no = "net45 net48;net46 netstandard2.0;net8.0 net48;netstandard2.0 net48;net8.0 net8.0-windows;net8.0-android net8.0-windows;netcoreapp2.1 netstandard2.1;net40 netstandard1.0;net8.0 portable-net45+win8;net8.0 xamarinios;netstandard2.0 netstandard2.1;net6.0-windows7.0 net6.0-windows10.0;net451 netstandard1.3"
    for text, want in ((yes, True), (no, False)):
        pairs = [tuple(p.split()) for p in text.split(";")]
        assert [p for p, got in zip(pairs, serving(spark, pairs)) if got != want] == []
    assert serving(spark, [(".NETFramework,Version=v4.8", "net472"), (".NETCoreApp,Version=v8.0", "netstandard2.0"), (".NETStandard,Version=v2.0", "net45")]) == [True, True, False]


def test_precedence_and_nearest_groups(spark):
    names = ["net45", "net472", "netstandard1.3", "netstandard2.0", "net6.0", "net8.0", "net8.0-windows7.0", "net6.0-windows7.0", "any", None]
    order = frameworks.precedence(spark.createDataFrame([("net48",), ("net8.0-windows10.0",)], "t string"), spark.createDataFrame([(n,) for n in names], "f string"))
    of = lambda t: [r["framework"] for r in order.filter(F.col("target") == t).orderBy("rank").collect()]
    assert of("net48") == ["net472", "net45", "netstandard2.0", "netstandard1.3", "any"]
    assert of("net8.0-windows10.0") == ["net8.0-windows7.0", "net8.0", "net6.0-windows7.0", "net6.0", "netstandard2.0", "netstandard1.3", "any"]
    groups = spark.createDataFrame([("A", "1", "net45"), ("A", "1", "netstandard2.0"), ("B", "1", "net472")], "package string, version string, framework string")
    wanted = spark.createDataFrame([(p, "1", t) for p in "AB" for t in ("net8.0", "net48", "net45")], "package string, version string, target string")
    assert rows(frameworks.nearest_dependencies(wanted, groups), "package", "target", "framework") == [("A", "net45", "net45"), ("A", "net48", "net45"), ("A", "net8.0", "netstandard2.0"), ("B", "net48", "net472")]


def test_target_support_falls_back_to_dependency_groups(spark):
    assets = spark.createDataFrame([("A", "1", "net45"), ("B", "1", None), ("C", "1", None), ("D", "1", "any")], "package string, version string, framework string")
    groups = spark.createDataFrame([("A", "1", "net8.0"), ("B", "1", "netstandard2.0")], "package string, version string, framework string")
    found = frameworks.target_support(spark.createDataFrame([("net8.0",), ("net45",)], "target string"), assets, groups)
    assert rows(found, "package", "target", "supports") == [("A", "net45", True), ("A", "net8.0", False), ("B", "net45", False), ("B", "net8.0", True), ("C", "net45", True), ("C", "net8.0", True), ("D", "net45", True), ("D", "net8.0", True)]


# ---- wire shapes


def test_wire_problems(spark):
    types = [("M.Dto", "class", False), ("M.Bad", "class", False), ("M.Ring", "class", False), ("M.RingB", "struct", False), ("M.Empty", "class", False), ("M.Loud", "class", True), ("M.Color", "enum", False), ("M.IThing", "interface", False), ("M.Del", "delegate", False), ("M.Abs", "abstract", False), ("M.Deep", "class", False), ("M.Fixed", "class", False), ("M.RingBad", "class", False), ("M.RingC", "class", False)]
    g = "System.Collections.Generic."
    properties = [
        ("M.Dto", 1, "Id", "int", True), ("M.Dto", 2, "Tags", f"{g}List<{g}Dictionary<string, System.Guid?[]>>", True), ("M.Dto", 3, "Color", "M.Color", True),
        ("M.Bad", 1, "Ok", "M.Dto", True), ("M.Bad", 2, "Stream", "System.IO.Stream", True), ("M.Bad", 3, "Thing", "M.IThing", True),
        ("M.Ring", 1, "Next", "M.RingB", True), ("M.RingB", 1, "Back", f"{g}IList<M.Ring>", True), ("M.Loud", 1, "Id", "int", True),
        ("M.Deep", 1, "Inner", f"System.Threading.Tasks.Task<M.Bad>", True), ("M.Fixed", 1, "A", "int", True), ("M.Fixed", 2, "B", "int", False),
        ("M.RingBad", 1, "C", "M.RingC", True), ("M.RingBad", 2, "X", "object", True), ("M.RingC", 1, "Back", "M.RingBad", True),
    ]
    t, p = spark.createDataFrame(types, "type string, kind string, has_events boolean"), spark.createDataFrame(properties, "type string, place int, property string, of string, settable boolean")
    assert dict(rows(wire.type_problems(t, p), "type", "why")) == {
        "M.Bad": "M.Bad.Stream: System.IO.Stream is a stream or file handle", "M.Empty": "M.Empty has no public properties", "M.Loud": "M.Loud has events", "M.Fixed": "M.Fixed.B has no public setter",
        "M.Deep": "M.Deep.Inner: M.Bad.Stream: System.IO.Stream is a stream or file handle", "M.RingBad": "M.RingBad.X: object has no wire shape", "M.RingC": "M.RingC.Back: M.RingBad.X: object has no wire shape",
    }
    members = [
        ("m1", 1, "parameter", "a", f"{g}Dictionary<int, string>", None), ("m1", 2, "parameter", "b", "M.Dto", "Ref"), ("m1", 3, "parameter", "c", "System.Threading.CancellationToken", None), ("m1", 4, "return", None, f"System.Threading.Tasks.Task<{g}IEnumerable<M.Deep>>", None),
        ("m2", 1, "return", None, "System.Threading.Tasks.Task", None), ("m3", 1, "event", None, "M.Del", None), ("m4", 1, "property", None, "M.Del[]", None), ("m5", 1, "field", None, "int*", None), ("m6", 1, "parameter", "x", "M.Unknown<int>", None), ("m7", 1, "property", None, f"{g}IDictionary<string, {g}List<nint>>", None), ("m8", 1, "property", None, "M.Ring", None),
    ]
    found = {r["member"]: r["problems"] for r in wire.wire_problems(spark.createDataFrame(members, "member string, place int, part string, name string, type string, `by` string"), t, p).collect()}
    assert found == {
        "m1": ["'a': dictionaries need string keys", "'b' is passed by ref", "return: M.Deep.Inner: M.Bad.Stream: System.IO.Stream is a stream or file handle"], "m2": [], "m3": ["events cannot cross the wire"], "m4": ["M.Del is a delegate"],
        "m5": ["pointers cannot cross the wire"], "m6": ["'x': M.Unknown<int> has no wire shape"], "m7": ["nint is a native handle"], "m8": [],
    }
    assert wire.type_problems(t.limit(0), p.limit(0)).count() == 0


# ---- line differences


def greedy(a, b):
    """The search with every frontier kept."""
    n, m = len(a), len(b)
    v, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(v))
        for k in range(-d, d + 1, 2):
            x = v[k + 1] if k == -d or (k != d and v[k - 1] < v[k + 1]) else v[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            v[k] = x
            if x >= n and x - k >= m:
                out, x, y = [], n, m
                for e in range(d, 0, -1):
                    w, k = trail[e], x - y
                    down = k == -e or (k != e and w[k - 1] < w[k + 1])
                    x = w[k + 1] if down else w[k - 1]
                    y = x - (k + 1 if down else k - 1)
                    out.append(("+", y) if down else ("-", x))
                return out[::-1]


@pytest.mark.parametrize("every", [1, 2, 5, 64])
def test_scripts_do_not_depend_on_kept_frontiers(monkeypatch, every):
    monkeypatch.setattr(facts, "KEPT_EVERY", every)
    random.seed(every)
    for _ in range(300):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 14))] for _ in range(2))
        low = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = next((i for i, (x, y) in enumerate(zip(a[low:][::-1], b[low:][::-1])) if x != y), min(len(a), len(b)) - low)
        want = [(o, i + low) for o, i in greedy(a[low : len(a) - tail], b[low : len(b) - tail])]
        assert facts.edit_script(a, b) == want


def test_long_texts_are_compared_in_bounded_memory():
    import tracemalloc

    a, b = [f"a{i}" for i in range(3000)], [f"b{i}" for i in range(3000)]
    tracemalloc.start()
    script = facts.edit_script(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(script) == 6000 and peak < 30_000_000
    far = facts.edit_script(["x", *a, *a], ["x", *(f"c{i}" for i in range(6000)), "y"])
    assert far == [("-", i) for i in range(1, 6001)] + [("+", i) for i in range(1, 6002)]


def test_lines_of_texts():
    assert facts.lines_of("a\r\nb\n") == ["a", "b"] and facts.lines_of("\n") == [""] and facts.lines_of("") == [] == facts.lines_of(None) and facts.lines_of("a\rb") == ["a\rb"]


# ---- rules


def test_rules_match_alike_in_slots_and_by_joins(spark, monkeypatch):
    random.seed(3)
    keys = [f"k{i}" for i in range(30)]
    table = spark.createDataFrame([(f"r{random.randrange(12)}", random.choice(keys), random.random() < 0.2) for _ in range(60)], "rule string, key string, is_exclude boolean")
    uses = spark.createDataFrame([(i, random.choices(keys, k=4)) for i in range(200)], "place int, keys array<string>")
    small = rows(rules.match(uses, table), "place", "rule")
    assert small == rows(rules.match_by_joins(uses, table), "place", "rule") and small
    assert "Exchange" not in rules.match(uses, table)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert rules.match(uses, table.limit(0)).count() == 0
