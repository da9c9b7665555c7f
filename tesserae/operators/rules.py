"""Rules over symbol facts: keys, matching, exclusion, suppression, severity and ledgers.

Facts come from an extractor outside this library: symbol_use (symbol_id, project, file, line, position, ...). A
symbol answers to several keys. Rules are a dimension written by hand: their number is checked before they go to
every task, and more of them are joined on exploded keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.relational import SMALL_ROWS, first_per_key, not_in
from tesserae.session import checkpoint_ready


def small(df: DataFrame) -> DataFrame:
    """Broadcast a dimension whose size was checked; a larger one is joined by shuffling."""
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(SMALL_ROWS + 1).collect()) <= SMALL_ROWS else df


def symbol_keys(symbol: Column) -> Column:
    """Keys of a documentation id such as M:N.S.T`1.M(System.Int32): itself, without parameters, without arity, its types and namespaces."""
    bare = F.regexp_replace(symbol, r"\(.*$", "")
    plain = F.regexp_replace(bare, r"`+\d+", "")
    path = F.regexp_replace(plain, r"^[A-Z]:", "")
    parts = F.split(path, r"\.")
    outer = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    held = F.flatten(F.array(F.transform(outer, lambda x: F.concat(F.lit("T:"), x)), F.transform(outer, lambda x: F.concat(F.lit("N:"), x))))
    return F.array_distinct(F.concat(F.array(symbol, bare, plain), held))


#: Slots of the table that rules are looked up in.
SLOTS = 1024


def match(uses: DataFrame, rule_keys: DataFrame, keys: str = "keys") -> DataFrame:
    """Uses with each rule that names one of their keys and excludes none: rule_keys (rule, key, is_exclude).

    Rules are counted; up to SMALL_ROWS of their keys become one table of slots that goes to every task, so that uses
    neither move nor are numbered. More are joined by key.
    """
    held = rule_keys.filter("rule IS NOT NULL AND key IS NOT NULL").select("rule", "key", F.coalesce("is_exclude", F.lit(False)).alias("bars")).distinct()
    if len(held.select(F.lit(1)).limit(SMALL_ROWS + 1).collect()) > SMALL_ROWS:
        return match_by_joins(uses, rule_keys, keys)
    slots = held.groupBy(F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")).agg(F.collect_list(F.struct("key", "rule", "bars")).alias("rules"))
    table = slots.agg(F.map_from_entries(F.collect_list(F.struct("slot", "rules"))).alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.array().cast("array<struct<key:string,rule:string,bars:boolean>>"))).alias("t"))
    found = F.flatten(F.transform(F.array_distinct(keys), lambda k: F.filter(F.element_at("__t", (F.pmod(F.xxhash64(k), F.lit(SLOTS)) + 1).cast("int")), lambda e: e["key"] == k)))
    names = lambda bars: F.transform(F.filter("__f", lambda e: e["bars"] == F.lit(bars)), lambda e: e["rule"])
    rows = uses.withColumn("__t", table.scalar()).withColumn("__f", found).drop("__t")
    return rows.withColumn("rule", F.explode(F.array_except(names(False), names(True)))).drop("__f")


def match_by_joins(uses: DataFrame, rule_keys: DataFrame, keys: str = "keys") -> DataFrame:
    """The same for any number of rules."""
    # numbered once and kept: a number given anew might go to another row
    checkpoint_ready(uses.sparkSession)
    rows = uses.withColumn("__use", F.monotonically_increasing_id()).checkpoint()
    tried = rows.select("__use", F.explode(F.array_distinct(keys)).alias("__key"))
    wanted = rule_keys.filter("NOT is_exclude").select("rule", F.col("key").alias("__k")).distinct()
    barred = rule_keys.filter("is_exclude").select(F.col("rule").alias("__r"), F.col("key").alias("__k")).distinct()
    hits = tried.join(wanted, F.col("__key") == F.col("__k")).select("__use", "rule").distinct()
    out = tried.join(barred, F.col("__key") == F.col("__k")).select(F.col("__use").alias("__u"), "__r").distinct()
    kept = hits.join(out, (F.col("__use") == F.col("__u")) & (F.col("rule") == F.col("__r")), "left_anti")
    return rows.join(kept, "__use").drop("__use")


def active(rules: DataFrame, packs: list[str] | None = None, disabled: list[str] = (), target: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(rule, severity) of rules in force: by pack, lowered below a target version, overridden, and not `none`.

    rules (rule, pack, severity, below, severity_below): below is a number the target is compared with.
    """
    asked = rules if not packs else rules.filter(F.col("pack").isin(*packs))
    asked = asked.filter(~F.col("pack").isin(*disabled)) if disabled else asked
    severity = F.when(F.lit(target).cast("double") < F.col("below"), F.col("severity_below")).otherwise(F.col("severity")) if target is not None else F.col("severity")
    out = asked.select("rule", severity.alias("severity"))
    if overrides is not None:
        over = overrides.select(F.col("rule").alias("__r"), F.col("severity").alias("__s"))
        out = out.join(small(over), F.col("rule") == F.col("__r"), "left").select("rule", F.coalesce("__s", "severity").alias("severity"))
    return out.filter("severity != 'none'")


def suppress(findings: DataFrame, weak: str, strong: list[str]) -> DataFrame:
    """Drop findings of the weak rule where a strong one has the same place, or the same line and symbol."""
    by = findings.filter(F.col("rule").isin(*strong))
    weaker, rest = findings.filter(F.col("rule") == weak), findings.filter(F.col("rule") != weak)
    weaker = not_in(weaker, by, ["project", "file", "line", "column"])
    return rest.unionByName(not_in(weaker, by, ["project", "file", "line", "symbol"]))


def one_per_line(findings: DataFrame, order: list[str]) -> DataFrame:
    return first_per_key(findings, ["rule", "project", "file", "line"], [F.col(c) for c in order])


def portability(files: DataFrame, findings: DataFrame, by: str) -> DataFrame:
    """(by, files, touched, portability): the share of files without a finding, half to even, 1.0 for no files."""
    touched = findings.select("file").distinct().withColumn("__hit", F.lit(1))
    joined = files.select("file", by).distinct().join(touched, "file", "left")
    n, bad = F.count("file"), F.count("__hit")
    return joined.groupBy(by).agg(n.alias("files"), bad.alias("touched"), F.coalesce(F.bround(F.try_divide(n - bad, n), 3), F.lit(1.0)).alias("portability"))


def ledger(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(project, files, portable_files, portability, by_category, by_namespace): a row for each project of `files`.

    files (project, file), a null file for a project without any; findings (project, file, severity, category,
    namespace). A file with an error is not portable; the share rounds half to even, 1.0 for no files. The maps count
    all findings of a project by key, keys in order; a null namespace is in none.
    """
    blocked = findings.filter("severity = 'error'").select(F.col("project").alias("__p"), F.col("file").alias("__f")).distinct().withColumn("__hit", F.lit(1))
    each = files.select("project", "file").distinct().join(blocked, (F.col("project") == F.col("__p")) & (F.col("file") == F.col("__f")), "left")
    n = F.count("file")
    out = each.groupBy("project").agg(n.alias("files"), (n - F.count("__hit")).alias("portable_files"))
    out = out.withColumn("portability", F.coalesce(F.bround(F.try_divide("portable_files", "files"), 3), F.lit(1.0)))
    empty = F.create_map().cast("map<string,bigint>")
    for key in ("category", "namespace"):
        # counted by key first, so that a project with most findings is no group of its own size
        counted = findings.filter(F.col(key).isNotNull()).groupBy(F.col("project").alias("__p"), key).count()
        counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("count")))))
        out = out.join(counted.groupBy("__p").agg(counts.alias("__m")), F.col("project") == F.col("__p"), "left").withColumn(f"by_{key}", F.coalesce("__m", empty)).drop("__p", "__m")
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("project").alias("projects")).orderBy(F.desc("findings"), "rule")


def top_namespaces(findings: DataFrame, k: int = 20) -> DataFrame:
    return findings.filter("namespace IS NOT NULL").groupBy("namespace").count().orderBy(F.desc("count"), "namespace").limit(k)


def word_index(texts: DataFrame, doc: str, text: str, ignore_case: bool = False) -> DataFrame:
    """The first (doc, place) at which each word appears; words are runs of letters, decimal digits and underscores.

    ignore_case: words that differ in case alone are one, in lower case.
    """
    words = texts.select(doc, F.posexplode(F.expr(rf"regexp_extract_all({text}, '[\\p{{L}}\\p{{Nd}}_]+', 0)")).alias("place", "word"))
    words = words.withColumn("word", F.lower("word")) if ignore_case else words
    return words.groupBy("word").agg(F.min(F.struct(doc, "place")).alias("at")).select("word", F.col(f"at.{doc}").alias(doc), F.col("at.place").alias("place"))


def dead_code(declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """Eligible declarations without a use outside themselves; members of a dead type are left out.

    declarations (symbol, owner, file, begin, end, eligible), uses (symbol, file, position).
    """
    u = uses.select(F.col("symbol").alias("__s"), F.col("file").alias("__f"), "position")
    inside = (F.col("__f") == F.col("file")) & F.col("position").between(F.col("begin"), F.col("end"))
    dead = declarations.filter("eligible").join(u, (F.col("symbol") == F.col("__s")) & ~F.coalesce(inside, F.lit(False)), "left_anti")
    return dead.join(dead.select(F.col("symbol").alias("__o")), F.col("owner") == F.col("__o"), "left_anti")


def confidence(candidates: DataFrame) -> DataFrame:
    """high, medium or low by evidence columns: any low evidence first, then what may be used from outside."""
    level = F.when(F.col("low_evidence"), "low").when(F.col("is_public") & F.col("shipped"), "medium").when(F.col("is_action") | F.col("is_friend"), "medium").otherwise("high")
    return candidates.withColumn("confidence", level)
