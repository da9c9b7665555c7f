"""Analyses over fact tables that an extractor outside this library fills: matchers, detectors, wire shapes, line differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import reached_set, reverse
from tesserae.operators.relational import not_in
from tesserae.operators.rules import small


def looked_up(key: Column, values: dict, default) -> Column:
    """The value of a key in a small map, or a default; a null key takes the default."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)


def matched(facts: DataFrame, matchers: list[tuple[str, Column]]) -> DataFrame:
    """Facts with each rule whose condition holds, in one pass however many matchers there are; unknown conditions don't hold."""
    held = F.array(*[F.when(holds, F.lit(rule)) for rule, holds in matchers])
    return facts.withColumn("rule", F.explode(F.filter(held, lambda r: r.isNotNull())))


def unless_in_project(findings: DataFrame, rule: str, others: DataFrame) -> DataFrame:
    """The pass after matching: findings of a rule go where their project has one of the other facts."""
    mine, rest = findings.filter(F.col("rule") == rule), findings.filter(F.col("rule") != rule)
    return rest.unionByName(not_in(mine, others, ["project"]))


def detected(facts: DataFrame, detectors: DataFrame) -> DataFrame:
    """Facts (shape, name, ...) with each detector (detector, shape, pattern) of their shape whose LIKE pattern the name fits."""
    asked = detectors.select("detector", F.col("shape").alias("__shape"), "pattern")
    # shapes are a handful of hot keys: detectors, few by nature and counted, go to the facts
    return facts.join(small(asked), (F.col("shape") == F.col("__shape")) & F.expr("name LIKE pattern")).drop("__shape", "pattern")


# Kinds of type that cross a wire as they are, and that cross it if all their members do.
SIMPLE, DATA = "simple", "data"


def wire_friendly(types: DataFrame, members: DataFrame) -> DataFrame:
    """(type, kind, friendly): whether a type can cross a wire as data. types (type, kind), members (type, of).

    A simple type can; a data type can if all its members' types can, and a type that holds itself counts as if it
    could; any other kind, and a member type that isn't known, can't.
    """
    held = members.join(types.filter(F.col("kind") == DATA).select(F.col("type").alias("__t")), F.col("type") == F.col("__t"), "left_semi").select(F.col("type").alias("src"), F.col("of").alias("dst"))
    known = types.select(F.col("type").alias("__k"))
    bad = types.filter(~F.coalesce(F.col("kind").isin(SIMPLE, DATA), F.lit(False))).select(F.col("type").alias("node"))
    bad = bad.unionByName(held.join(known, F.col("dst") == F.col("__k"), "left_anti").select(F.col("dst").alias("node")))
    out = reached_set(reverse(held), bad).select(F.col("node").alias("__b"))
    return types.join(out, F.col("type") == F.col("__b"), "left").withColumn("friendly", F.col("__b").isNull()).drop("__b")


def api_differences(outputs: DataFrame, text: str, sides: list[tuple[str, str]], by: tuple = ()) -> DataFrame:
    """(*by, code, member, only_on, message), distinct: the `CPnnnn: message` lines of comparison outputs, but for CP1nnn.

    sides: two (path, label); paths in messages become labels, whatever their case. member: the first quoted name, else the
    message; only_on: the label that follows "exists on", if one does. A null text has no lines.
    """
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = outputs.select(*by, F.explode(F.split(text, "\n")).alias("line")).withColumn("line", line).filter(F.col("line").rlike(r"^CP(?!1)[0-9]{4}:."))
    message = F.regexp_replace(F.substring("line", 8, 2**31 - 1), r"^\s+", "")
    for path, label in sides:
        message = F.regexp_replace(message, F.lit("(?iu)\\Q" + path.replace("\\E", "\\E\\\\E\\Q") + "\\E"), F.lit(label.replace("\\", "\\\\").replace("$", "\\$")))
    rows = rows.select(*by, F.substring("line", 1, 6).alias("code"), message.alias("message"))
    member = F.when(F.col("message").rlike("'[^']*'"), F.regexp_extract("message", "'([^']*)'", 1)).otherwise(F.col("message"))
    rest, only = F.regexp_extract("message", "exists on (.*)$", 1), None
    for _, label in sides:
        only = F.when(rest.startswith(label), label) if only is None else only.when(rest.startswith(label), label)
    # a text without the words has an empty rest, which no label starts
    return rows.select(*by, "code", member.alias("member"), only.alias("only_on"), "message").distinct()


#: Lines on a side, without what both sides begin and end with, beyond which all of them count as changed.
MOST_LINES = 5000
#: Levels of the search between frontiers that are kept; the way back makes those between anew.
KEPT_EVERY = 64


def edit_script(a: list, b: list) -> list[tuple[str, int]]:
    """("-", place in a) and ("+", place in b) of a shortest edit script: the greedy search of furthest ends by diagonals.

    Of the frontiers one in KEPT_EVERY is kept, so that memory stays within MOST_LINES² / KEPT_EVERY numbers. Sides that
    differ in more than MOST_LINES lines count as changed throughout: all of one go, all of the other come.
    """
    code: dict = {}
    left, right = (np.fromiter((code.setdefault(x, len(code)) for x in side), np.int64, len(side)) for side in (a, b))
    most = min(len(left), len(right))
    differ = np.flatnonzero(left[:most] != right[:most])
    low = int(differ[0]) if len(differ) else most
    differ = np.flatnonzero(left[::-1][: most - low] != right[::-1][: most - low])
    tail = int(differ[0]) if len(differ) else most - low
    left, right = left[low : len(left) - tail], right[low : len(right) - tail]
    n, m = len(left), len(right)
    if not n or not m or max(n, m) > MOST_LINES:
        return [("-", low + i) for i in range(n)] + [("+", low + j) for j in range(m)]
    off = n + m + 1
    furthest = np.zeros(2 * off + 1, np.int32)
    kept, d = [], 0
    while True:
        if d % KEPT_EVERY == 0:
            kept.append(furthest[off - d - 1 : off + d + 2].copy())
        next_level(furthest, off, d, left, right)
        if furthest[off + n - m] >= n and abs(n - m) <= d and (n - m - d) % 2 == 0:
            break
        d += 1
    out, x, y = [], n, m
    while d > 0:
        begin = (d // KEPT_EVERY) * KEPT_EVERY
        trail = [kept[begin // KEPT_EVERY]]
        now = np.zeros_like(furthest)
        now[off - begin - 1 : off + begin + 2] = trail[0]
        for e in range(begin, d):
            next_level(now, off, e, left, right)
            trail.append(now[off - e - 2 : off + e + 3].copy())
        for e in range(d, max(begin, 1) - 1, -1):
            before, k = trail[e - begin], x - y
            at = k + e + 1
            down = k == -e or (k != e and before[at - 1] < before[at + 1])
            x = int(before[at + 1] if down else before[at - 1])
            y = x - (k + 1 if down else k - 1)
            out.append(("+", low + y) if down else ("-", low + x))
        d = begin - 1
    return out[::-1]


def next_level(furthest: np.ndarray, off: int, d: int, left: np.ndarray, right: np.ndarray) -> None:
    """The furthest ends of scripts of d edits, of those of d - 1, on every second diagonal at once."""
    n, m = len(left), len(right)
    k = np.arange(-d, d + 1, 2)
    before, after = furthest[off + k - 1], furthest[off + k + 1]
    x = np.where((k == -d) | ((k != d) & (before < after)), after, before + 1)
    if d == 0:
        x = np.zeros(1, x.dtype)
    live = np.arange(len(k))
    while len(live):
        live = live[(x[live] < n) & (x[live] - k[live] < m)]
        live = live[left[x[live]] == right[x[live] - k[live]]]
        x[live] += 1
    furthest[off + k] = x


def lines_of(text: str | None) -> list[str]:
    """The lines of a text; a line feed at its end begins no line, and a carriage return before one is part of it."""
    if not text:
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if text.endswith("\n") else lines


def line_differences(pairs: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """(key, removed, added, edits) of two texts, line by line; edits (op, line): lines are numbered from 1 in their own text.

    A null text has no lines (`lines_of` tells what a line is). Rows are compared one by one, in bounded memory beside the
    texts; where more than MOST_LINES lines differ on a side, all of them count as changed.
    """
    edit = pa.list_(pa.struct([("op", pa.string()), ("line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scripts = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                scripts.append(edit_script(lines_of(a), lines_of(b)))
            count = lambda op: pa.array([sum(o == op for o, _ in s) for s in scripts], pa.int64())  # noqa: B023, E731
            edits = pa.array([[{"op": o, "line": i + 1} for o, i in s] for s in scripts], edit)
            yield pa.RecordBatch.from_arrays([batch.column(0), count("-"), count("+"), edits], ["key", "removed", "added", "edits"])

    kind = pairs.schema[key].dataType.simpleString()
    out = pairs.select(key, before, after).mapInArrow(run, f"key {kind}, removed long, added long, edits array<struct<op:string,line:int>>")
    return out.withColumnRenamed("key", key)
