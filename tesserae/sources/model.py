"""Readers: workspace documents, ledgers, package files, solutions, inputs and rule packs, as normalised tables.

Schemas are explicit: maps keyed by package id would be inferred as structs, one field for each package. Fields that a
document leaves out are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOST = "struct<project:string,evidence:array<string>>"
PACKAGE_REF = "struct<id:string,version:string,versionOverride:string,privateAssets:string,tfms:array<string>>"
CONFIG_REF = "struct<id:string,version:string,targetFramework:string,developmentDependency:boolean>"
RESOLVED = "map<string,struct<packages:array<struct<id:string,version:string,direct:boolean,dependencies:array<struct<id:string,`range`:string>>>>>>"
PROJECT = (
    "struct<id:string,name:string,assemblyName:string,language:string,kind:string,kindEvidence:string,frameworkClass:string,outputType:string,outputPath:string,"
    "isTestProject:boolean,packagesConfig:boolean,loc:int,partial:boolean,sdkStyle:boolean,excluded:boolean,frozen:boolean,targetFrameworks:array<string>,compile:array<string>,"
    f"projectReferences:array<string>,modernProjectReferences:array<string>,packageReferences:array<{PACKAGE_REF}>,packagesConfigPackages:array<{CONFIG_REF}>,"
    f"assemblyReferences:array<struct<name:string,hintPath:string,kind:string>>,resolved:{RESOLVED},hostedBy:{HOST}>"
)
WORKSPACE = (
    f"version int, createdAt string, solution string, projects array<{PROJECT}>, graph struct<edges:array<struct<`from`:string,`to`:string,kind:string>>,cycles:array<array<string>>,"
    "topologicalOrder:array<string>>, packages map<string,struct<versions:map<string,array<string>>>>, inputs array<struct<path:string,sha256:string>>"
)
CLASS_TOTALS = "struct<projects:int,loc:int>"
LEDGER = (
    f"createdAt string, solution string, totals struct<projects:int,loc:int,byFrameworkClass:map<string,{CLASS_TOTALS}>,byKind:map<string,int>>, "
    "projects array<struct<id:string,kind:string,frameworkClass:string,loc:int,packages:int>>"
)


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    """The document as it is, one row; version 1 only."""
    return spark.read.schema(WORKSPACE).option("multiLine", True).json(path).filter("version = 1")


def tables(model: DataFrame) -> dict[str, DataFrame]:
    """The normalised tables of a workspace document."""
    p = model.select(F.explode("projects").alias("p"))
    each = lambda column, *cols: p.select(F.col("p.id").alias("project"), F.explode(column).alias("x")).select("project", *cols)
    resolved = p.select(F.col("p.id").alias("project"), F.explode("p.resolved").alias("tfm", "r")).select("project", "tfm", F.explode("r.packages").alias("x"))
    return {
        "project": p.select(
            "p.id", "p.name", F.col("p.assemblyName").alias("assembly_name"), "p.language", "p.kind", F.col("p.kindEvidence").alias("kind_evidence"), F.col("p.frameworkClass").alias("framework_class"),
            F.col("p.outputType").alias("output_type"), F.col("p.outputPath").alias("output_path"), F.coalesce("p.isTestProject", F.lit(False)).alias("is_test"), F.col("p.packagesConfig").alias("packages_config"),
            "p.loc", "p.partial", F.col("p.sdkStyle").alias("sdk_style"), F.col("p.hostedBy.project").alias("hosted_by"), "p.excluded", "p.frozen", F.col("p.targetFrameworks").alias("tfms"),
        ),
        "project_ref": each("p.projectReferences", F.col("x").alias("target")),
        "modern_list": p.filter("p.modernProjectReferences IS NOT NULL").select(F.col("p.id").alias("project")),
        "modern_ref": each("p.modernProjectReferences", F.col("x").alias("target")),
        "compile_item": each("p.compile", F.col("x").alias("file")),
        "package_ref": each("p.packageReferences", "x.id", "x.version", F.col("x.versionOverride").alias("version_override"), F.col("x.privateAssets").alias("private_assets"), "x.tfms"),
        "packages_config": each("p.packagesConfigPackages", "x.id", "x.version", F.col("x.targetFramework").alias("target_framework"), F.col("x.developmentDependency").alias("development_dependency")),
        "assembly_ref": each("p.assemblyReferences", "x.name", F.col("x.hintPath").alias("hint_path"), "x.kind"),
        "resolved_package": resolved.select("project", "tfm", "x.id", "x.version", "x.direct"),
        "resolved_dependency": resolved.select("project", "tfm", "x.id", "x.version", F.explode("x.dependencies").alias("d")).select("project", "tfm", "id", "version", F.col("d.id").alias("dep_id"), F.col("d.range").alias("range")),
        "edge": model.select(F.explode("graph.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind"),
        "package_usage": model.select(F.explode("packages").alias("id", "v")).select("id", F.explode("v.versions").alias("version", "ps")).select("id", "version", F.explode("ps").alias("project")),
        "input_file": model.select(F.explode("inputs").alias("i")).select("i.path", "i.sha256"),
    }


def read_ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, unreadable files): one row for each file, in the order of time and file name."""
    schema = T._parse_datatype_string(LEDGER).add("unreadable", "string")
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "unreadable").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("file", F.col("_metadata.file_name"))
    # asked together with another column: a reader refuses queries for the unreadable text alone
    rows = rows.withColumn("bad", F.col("unreadable").isNotNull() & F.col("createdAt").isNull())
    good = rows.filter("NOT bad").drop("unreadable", "bad").withColumnRenamed("createdAt", "created_at")
    return good.orderBy("created_at", "file"), rows.filter("bad").select("file")


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(tfm, id, version, kind, dep_id, range) of a resolved package graph; packages without dependencies have nulls."""
    schema = "targets map<string,map<string,struct<type:string,dependencies:map<string,string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("targets").alias("tfm", "ps")).select("tfm", F.explode("ps").alias("key", "x"))
    parts = F.split("key", "/")
    return rows.select("tfm", parts[0].alias("id"), parts[1].alias("version"), F.col("x.type").alias("kind"), F.explode_outer("x.dependencies").alias("dep_id", "range"))


def read_solution_filter(spark: SparkSession, path: str) -> DataFrame:
    """(solution, project): paths with forward slashes."""
    rows = spark.read.schema("solution struct<path:string,projects:array<string>>").option("multiLine", True).json(path)
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return rows.select(slashed(F.col("solution.path")).alias("solution"), F.explode("solution.projects").alias("p")).select("solution", slashed(F.col("p")).alias("project"))


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """(name, project) of a classic solution's project lines."""
    pattern = r'^Project\("\{[^}]*\}"\)\s*=\s*"([^"]*)",\s*"([^"]*\.\w+proj)"'
    rows = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("name"), F.replace(F.regexp_extract("value", pattern, 2), F.lit("\\"), F.lit("/")).alias("project"))


def read_packages_config(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, version, target_framework, development_dependency), the first of those equal but for case."""
    schema = "_id string, _version string, _targetFramework string, _developmentDependency boolean"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "package").load(path).withColumn("file", F.input_file_name())
    keyed = rows.withColumns({"k": F.lower("_id"), "v": F.lower("_version"), "at": F.monotonically_increasing_id()})
    first = keyed.groupBy("file", "k", "v").agg(F.min_by(F.struct("_id", "_version", "_targetFramework", "_developmentDependency"), "at").alias("x"))
    return first.select("file", F.col("x._id").alias("id"), F.col("x._version").alias("version"), F.col("x._targetFramework").alias("target_framework"), F.coalesce("x._developmentDependency", F.lit(False)).alias("development_dependency"))


def read_nuspec(spark: SparkSession, path: str) -> DataFrame:
    """(nuspec, source, target) of files that a package specification packs."""
    rows = spark.read.format("xml").schema("_src string, _target string").option("rowTag", "file").option("pathGlobFilter", "*.nuspec").option("recursiveFileLookup", True).load(path)
    return rows.select(F.input_file_name().alias("nuspec"), F.replace("_src", F.lit("\\"), F.lit("/")).alias("source"), F.replace("_target", F.lit("\\"), F.lit("/")).alias("target"))


# Folders that hold no inputs.
SKIPPED = ("bin", "obj", ".git", "node_modules", "packages")


def kept_paths(rows: DataFrame, folder: str, skip: tuple, columns: list) -> DataFrame:
    """(path, *columns) of files below a folder, paths relative to it, without those in skipped folders."""
    relative = F.regexp_replace(F.substring_index("path", folder.rstrip("/") + "/", -1), "^/+", "")
    parts = F.split(relative, "/")
    skipped = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, skip))) if skip else F.lit(False)
    return rows.select(relative.alias("path"), *columns, skipped.alias("s")).filter("NOT s").drop("s")


def read_inputs(spark: SparkSession, folder: str, glob: str = "*", skip: tuple = SKIPPED) -> DataFrame:
    """(path, sha256) of the files below a folder by name, without skipped folders; bytes are hashed where they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return kept_paths(rows, folder, skip, [F.sha2("content", 256).alias("sha256")])


def read_rules(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(rules, rule_keys) of a YAML rule pack; needs PyYAML."""
    import yaml

    rules, keys = [], []
    for name, r in (yaml.safe_load(text) or {}).get("rules", {}).items():
        below = r.get("severityBelow") or {}
        rules.append((name, r.get("pack"), r.get("severity"), float(below["target"]) if below else None, below.get("severity"), r.get("category"), r.get("title"), r.get("matcher")))
        keys += [(name, k, False) for k in r.get("symbols", [])] + [(name, k, True) for k in r.get("excludes", [])]
    return (
        spark.createDataFrame(rules, "rule string, pack string, severity string, below double, severity_below string, category string, title string, matcher string"),
        spark.createDataFrame(keys, "rule string, key string, is_exclude boolean"),
    )
