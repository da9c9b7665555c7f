"""Documents of one JSON object, made, written and committed by Spark: a command's envelope, and findings as SARIF.

A document is a frame of lines (part, place, value): parts follow each other, and the lines of a part go by place. Rows
become lines where they are, so that a result of any size is written without passing through the driver. A writer that
fails leaves nothing behind but the folder's unfinished files, which readers skip.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.relational import numbered
from tesserae.operators.rules import small
from tesserae.sources.sinks import LEVELS, ordered_diagnostics

LINES = "part int, place long, value string"


def text_line(spark: SparkSession, part: int, text: str) -> DataFrame:
    return spark.createDataFrame([(part, 0, text)], LINES)


def array_lines(rows: DataFrame, order: list[Column], part: int) -> DataFrame:
    """The elements of a JSON array, a row each, in order; rows that the order leaves equal go by their text. Nulls are left out."""
    told = rows.withColumn("__value", F.to_json(F.struct(*rows.columns)))
    placed = numbered(told, [*order, F.col("__value")], "__place", 0)
    comma = F.when(F.col("__place") > 0, ",").otherwise("")
    return placed.select(F.lit(part).alias("part"), F.col("__place").cast("long").alias("place"), F.concat(comma, "__value").alias("value"))


def joined(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def envelope_lines(result: DataFrame, order: list[Column], header: dict, diagnostics: DataFrame | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """A document with the header's fields, the result's rows in order, and diagnostics in theirs (`sinks.ordered_diagnostics`)."""
    spark = result.sparkSession
    begin = json.dumps(header, ensure_ascii=False)[:-1] + (", " if header else "") + '"result": ['
    out = [text_line(spark, 0, begin), array_lines(result, order, 1), text_line(spark, 2, '], "diagnostics": [')]
    if diagnostics is not None:
        sort = [F.col(c).asc_nulls_first() for c in ("file", "line", "column")] + [F.col("code"), F.col("message")]
        out.append(array_lines(ordered_diagnostics(diagnostics, overrides), sort, 3))
    return joined([*out, text_line(spark, 4, "]}")])


def rule_lines(rules: DataFrame, tool: str, part: int) -> DataFrame:
    """Descriptions of rules (rule, title, recommendation, help_uri, severity, category, pack) by name; what is null is left out."""
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text")))
    words = F.expr(r"regexp_extract_all(title, '[\\p{L}\\p{N}]+', 0)")
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), "")
    tags = F.filter(F.array(F.lit(tool), F.col("pack"), F.col("category")), lambda x: x.isNotNull())
    rows = rules.select(
        F.col("rule").alias("id"), F.nullif(name, F.lit("")).alias("name"), text("title").alias("shortDescription"), F.col("help_uri").alias("helpUri"), text("recommendation").alias("help"),
        F.struct(level_of("severity").alias("level")).alias("defaultConfiguration"), F.struct("category", tags.alias("tags")).alias("properties"),
    )
    return array_lines(rows, [F.col("id")], part)


def level_of(severity: str) -> Column:
    pairs = [F.lit(x) for kv in LEVELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(severity)), F.lit("note"))


def sarif_lines(findings: DataFrame, rules: DataFrame, tool: str, version: str) -> DataFrame:
    """Findings (rule, project, file, line, column, symbol, severity, message) and all rules, each finding with its rule's place.

    rules are those that ran, one row each; a finding of another rule has no place.
    """
    spark = findings.sparkSession
    place = small(numbered(rules.select(F.col("rule").alias("__r")).distinct(), [F.col("__r")], "__n", 0))
    keys = ["rule", "project", "file", "line", "column", "symbol"]
    rows = findings.join(place, F.col("rule") == F.col("__r"), "left")
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    told = F.struct(F.coalesce("message", F.lit("")).alias("text"))
    shown = F.struct(F.col("rule").alias("ruleId"), F.col("__n").cast("int").alias("ruleIndex"), level_of("severity").alias("level"), told.alias("message"), F.array(where).alias("locations"), F.struct("project", "symbol").alias("properties"))
    rows = rows.select(*keys, shown.alias("x"))
    # the sort keys order the lines and are no part of them
    placed = numbered(rows.withColumn("__value", F.to_json("x")), [*map(F.col, keys), F.col("__value")], "__place", 0)
    results = placed.select(F.lit(3).alias("part"), F.col("__place").cast("long").alias("place"), F.concat(F.when(F.col("__place") > 0, ",").otherwise(""), "__value").alias("value"))
    head = f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {{"name": {json.dumps(tool)}, "version": {json.dumps(version)}, "rules": ['
    return joined([text_line(spark, 0, head), rule_lines(rules, tool, 1), text_line(spark, 2, ']}}, "results": ['), results, text_line(spark, 4, "]}]}")])


def write_document(lines: DataFrame, path: str, one_file: bool = True) -> None:
    """Write the lines in order: one file, sorted by its one task with spilling, or files whose names go in order."""
    if one_file:
        lines.repartition(1).sortWithinPartitions("part", "place").select("value").write.text(path)
    else:
        lines.orderBy("part", "place").select("value").write.text(path)


def read_envelope(spark: SparkSession, path: str, result: str, diagnostics: str = "code string, severity string, file string, line int, column int, message string") -> DataFrame:
    """(command, version, result, diagnostics) of a document in one file; `result` and `diagnostics` are the fields of their rows."""
    schema = f"command string, version string, result array<struct<{fields(result)}>>, diagnostics array<struct<{fields(diagnostics)}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def fields(columns: str) -> str:
    return ", ".join(f"`{name}`: {kind}" for name, kind in (c.strip().split(" ", 1) for c in columns.split(",")))


SARIF = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,version:string,rules:array<struct<id:string,name:string,helpUri:string,"
    "defaultConfiguration:struct<level:string>,properties:struct<category:string,tags:array<string>>>>>>,results:array<struct<ruleId:string,ruleIndex:int,level:string,"
    "message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>,properties:struct<project:string,symbol:string>>>>>"
)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """(place, rule, level, project, file, line, column, symbol, message, index) of a document's findings, in its order."""
    runs = spark.read.schema(SARIF).option("multiLine", True).json(path).select(F.explode("runs").alias("r"))
    rows = runs.select(F.posexplode("r.results").alias("place", "x"))
    at = F.col("x.locations")[0]["physicalLocation"]
    return rows.select(
        "place", F.col("x.ruleId").alias("rule"), "x.level", "x.properties.project", at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line"),
        at["region"]["startColumn"].alias("column"), "x.properties.symbol", F.col("x.message.text").alias("message"), F.col("x.ruleIndex").alias("index"),
    )
