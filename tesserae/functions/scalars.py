"""Column functions: paths, globs, three-valued conditions, framework classes, versions and ranges.

All are built-in expressions, so that they stay in generated code and are pushed down where a source allows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- paths


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def directory_key(path: Column) -> Column:
    """The folder two levels up; "." for a path of one or two segments."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 2, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/"))


def file_stem(path: Column) -> Column:
    name = F.substring_index(unix_path(path), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def ancestors(path: Column) -> Column:
    """Folders of a path, nearest last, "." first: the keys of a containment join."""
    parts = F.split(path, "/")
    inner = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0)
    return F.concat(F.array(F.lit(".")), F.transform(inner, lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def glob_regex(glob: str) -> str:
    """** crosses folders, * and ? don't; the pattern covers the whole path."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def matches_globs(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Included, or no includes at all, and not excluded."""
    path = unix_path(path)
    any_of = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs])
    include, exclude = list(include), list(exclude)
    kept = any_of(include) if include else F.lit(True)
    return kept & ~any_of(exclude) if exclude else kept


def is_generated(path: Column) -> Column:
    """Build output and generated sources."""
    p = F.lower(unix_path(path))
    return p.contains("/obj/") | p.contains("/bin/") | p.endswith(".g.cs")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


# ---- conditions: null is unknown; SQL's AND, OR and NOT are already three-valued


def condition(tree, known: dict[str, Column]) -> Column:
    """A condition with some symbols known: ("not", x), ("and", x, y), ("or", x, y), ("eq", x, y), a name, or a boolean."""
    if isinstance(tree, bool):
        return F.lit(tree)
    if isinstance(tree, str):
        return known.get(tree, F.lit(None).cast("boolean"))
    op, *args = tree
    a = [condition(x, known) for x in args]
    return {"not": lambda: ~a[0], "and": lambda: a[0] & a[1], "or": lambda: a[0] | a[1], "eq": lambda: a[0] == a[1]}[op]()


# ---- frameworks


def framework_kind(tfm: Column) -> Column:
    """framework, standard, modern or unknown, by the shape of a target framework's short name."""
    t = F.lower(tfm)
    return (
        F.when(t.rlike(r"^netstandard\d"), "standard")
        .when(t.rlike(r"^netcoreapp\d") | t.rlike(r"^net([5-9]|\d\d)\.\d"), "modern")
        .when(t.rlike(r"^net[1-4]\d*(\.\d+)*($|-)"), "framework")
        .otherwise("unknown")
    )


def framework_class(tfms: Column) -> Column:
    """Class of a project by all its targets; none or unknown ones count as framework."""
    kinds = F.transform(F.coalesce(tfms, F.array().cast("array<string>")), framework_kind)
    has = lambda *names: F.exists(kinds, lambda k: k.isin(*names))
    framework, standard, modern = has("framework", "unknown"), has("standard"), has("modern")
    return (
        F.when(F.size(kinds) == 0, "framework").when(framework & (standard | modern), "dual").when(framework, "framework").when(standard, "standard").otherwise("modern")
    )


def first_match(*cases: tuple[Column, str, str | Column], otherwise: tuple[str, str | Column]) -> Column:
    """struct(kind, evidence) of the first case that holds."""
    made = lambda kind, evidence: F.struct(F.lit(kind).alias("kind"), F.lit(evidence).alias("evidence"))
    chain = None
    for holds, kind, evidence in cases:
        chain = F.when(holds, made(kind, evidence)) if chain is None else chain.when(holds, made(kind, evidence))
    return made(*otherwise) if chain is None else chain.otherwise(made(*otherwise))


# Project type identifiers, test frameworks and service packages.
TEST_GUID = "3AC096D0-A1C2-E12C-1390-A8335801FDAB"
WEB_GUIDS = [
    "349C5851-65DF-11DA-9384-00065B846F21",
    "E24C65DC-7377-472B-9ABA-BC803B73C61A",
    "603C0E0B-DB56-11DC-BE95-000D561079B0",
    "F85E285D-A4E0-4152-9332-AB1D724D3325",
    "E53F8FEA-EAE0-44A6-8774-FFD645390401",
    "E3E379DF-F4C6-4180-9B81-6769533ABE47",
]
WPF_GUID = "60DC8134-EBA5-43B8-BCC9-BB4BC16C2548"
TEST_PACKAGES = "xunit xunit.core xunit.v3 xunit.v3.core xunit.runner.visualstudio NUnit NUnit3TestAdapter NUnit4TestAdapter MSTest MSTest.TestFramework MSTest.TestAdapter TUnit TUnit.Core TUnit.Engine".split()
TEST_ASSEMBLIES = "Microsoft.VisualStudio.QualityTools.UnitTestFramework Microsoft.VisualStudio.TestPlatform.TestFramework nunit.framework TUnit.Core xunit xunit.core xunit.v3.core MbUnit.Framework".split()
SERVICE_PACKAGES = ["Topshelf", "Microsoft.Extensions.Hosting.WindowsServices"]


def project_kind(guids: Column, sdk: Column, output_type: Column, references: Column, packages: Column, config_packages: Column, is_test: Column, web_config: Column, winforms: Column, wpf: Column) -> Column:
    """struct(kind, evidence) of a project by its facts; the first rule that holds decides, and unknown facts don't hold.

    Names and output types ignore case, an SDK does not; no output type is a library. A test framework is no evidence
    in an executable that is a desktop or service application by a later rule.
    """
    names = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), F.lower)
    refs, direct, listed = names(references), names(packages), names(config_packages)
    has = lambda a, name: F.array_contains(a, name.lower())
    typed = lambda g: F.coalesce(F.upper(guids).contains(g), F.lit(False))
    sdk_is = lambda name: F.coalesce(sdk == name, F.lit(False))
    out = F.coalesce(output_type, F.lit("Library"))
    exe, windowed, library = F.lower(out) == "exe", F.lower(out) == "winexe", F.lower(out) == "library"

    application = [
        (winforms, "winforms", "UseWindowsForms=true"),
        (has(refs, "System.Windows.Forms") & windowed, "winforms", "Reference System.Windows.Forms + OutputType=WinExe"),
        (wpf, "wpf", "UseWPF=true"),
        (sdk_is("Microsoft.NET.Sdk.WindowsDesktop") & has(refs, "PresentationFramework"), "wpf", "Sdk=Microsoft.NET.Sdk.WindowsDesktop + PresentationFramework"),
        (typed(WPF_GUID), "wpf", f"ProjectTypeGuids {{{WPF_GUID}}}"),
        (has(refs, "System.ServiceProcess") & exe, "service", "Reference System.ServiceProcess + OutputType=Exe"),
    ]
    for p in SERVICE_PACKAGES:
        application += [(has(direct, p), "service", f"PackageReference {p}"), (has(listed, p) & exe, "service", f"packages.config {p} + OutputType=Exe")]
    application.append((sdk_is("Microsoft.NET.Sdk.Worker"), "service", "Sdk=Microsoft.NET.Sdk.Worker"))
    runs = (exe | windowed) & F.greatest(*[F.coalesce(holds, F.lit(False)) for holds, _, _ in application])

    def first_of(fixed: list[str], held: Column) -> Column:
        """The first of the fixed names that is held, as it is spelled there."""
        low = F.array(*[F.lit(n.lower()) for n in fixed])
        return F.get(F.array(*map(F.lit, fixed)), F.array_position(low, F.get(F.array_intersect(low, held), F.lit(0))).cast("int") - 1)

    tested = [("PackageReference ", first_of(TEST_PACKAGES, direct), ""), ("packages.config ", first_of(TEST_PACKAGES, listed), "")]
    tested.append(("Reference ", F.when(library, first_of(TEST_ASSEMBLIES, refs)), " + OutputType=Library"))
    return first_match(
        (is_test, "test", "IsTestProject=true"),
        (typed(TEST_GUID), "test", f"ProjectTypeGuids {{{TEST_GUID}}}"),
        (sdk_is("Microsoft.NET.Sdk.Web"), "web", "Sdk=Microsoft.NET.Sdk.Web"),
        *[(typed(g), "web", f"ProjectTypeGuids {{{g}}}") for g in WEB_GUIDS],
        (has(refs, "System.Web") & library & web_config, "web", "Reference System.Web + OutputType=Library + web.config"),
        *[(name.isNotNull() & ~runs, "test", F.concat(F.lit(before), name, F.lit(after))) for before, name, after in tested],
        *application,
        (exe, "console", "OutputType=Exe"),
        (library, "library", "OutputType=Library"),
        otherwise=("unknown", F.concat(F.lit("OutputType="), out)),
    )


# ---- versions


def version_key(version: Column) -> Column:
    """A struct whose order is the precedence of semantic versions, with an optional fourth number; build data is ignored.

    (major, minor, patch, revision, stable, labels): a release beats its prereleases; labels compare as numbers where
    both are numbers, numbers come before words, and fewer labels before more.
    """
    core = F.regexp_extract(version, r"^\s*[vV]?(\d+(?:\.\d+){0,3})", 1)
    parts = F.split(core, r"\.")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("long"), F.lit(0))
    pre = F.regexp_extract(version, r"^\s*[vV]?\d+(?:\.\d+){0,3}-([0-9A-Za-z.-]+)", 1)
    label = lambda x: F.struct(
        F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("kind"),
        F.when(x.rlike(r"^\d+$"), x.try_cast("long")).otherwise(F.lit(0)).alias("number"),
        F.when(x.rlike(r"^\d+$"), F.lit("")).otherwise(F.lower(x)).alias("word"),
    )
    labels = F.when(pre == "", F.array().cast("array<struct<kind:int,number:bigint,word:string>>")).otherwise(F.transform(F.split(pre, r"\."), label))
    return F.when(
        core != "",
        F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), number(4).alias("revision"), F.when(pre == "", 1).otherwise(0).alias("stable"), labels.alias("labels")),
    )


def version_range(text: Column) -> Column:
    """struct(low, low_in, high, high_in) of "1.0", "[1.0]", "[1.0, 2.0)", "(,2.0]"; a null bound is open."""
    t = F.trim(text)
    bracketed = t.rlike(r"^[\[(]")
    body = F.regexp_replace(t, r"^[\[(]|[\])]$", "")
    parts = F.split(body, ",")
    low, high = F.nullif(F.trim(F.get(parts, F.lit(0))), F.lit("")), F.nullif(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit(""))
    exact = bracketed & (F.size(parts) == 1)
    return F.struct(
        F.when(bracketed, low).otherwise(t).alias("low"),
        F.when(bracketed, t.startswith("[")).otherwise(True).alias("low_in"),
        F.when(exact, low).when(bracketed, high).alias("high"),
        F.when(exact, F.lit(True)).when(bracketed, t.endswith("]")).otherwise(False).alias("high_in"),
    )


def in_range(key: Column, bounds: Column) -> Column:
    low, high = version_key(bounds["low"]), version_key(bounds["high"])
    above = low.isNull() | (key > low) | (bounds["low_in"] & (key == low))
    below = high.isNull() | (key < high) | (bounds["high_in"] & (key == high))
    return above & below
