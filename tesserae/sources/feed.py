"""A recorded feed: package files with the structure of real ones, made from a table and read back as tables.

The same row always makes the same bytes: entries are stored in the order of their names, with one fixed time. Files are
rows (path, content), as Spark's `binaryFile` reader gives them, so that a feed may lie in any store that Spark can read.
Each package is a file of its own and is opened where it is read; a package must fit in a task's memory.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import reachable

GROUPS = "array<struct<framework:string,dependencies:array<struct<id:string,`range`:string>>>>"
# Fixed value: the first time that an archive can hold.
EPOCH = (1980, 1, 1, 0, 0, 0)


def specification(name: str, version: str, groups: list[dict] | None) -> str:
    """The package's own description, as XML."""
    body = "".join(
        f"<group{'' if g['framework'] is None else ' targetFramework=' + quoteattr(g['framework'])}>"
        + "".join(f"<dependency id={quoteattr(d['id'])}{'' if d['range'] is None else ' version=' + quoteattr(d['range'])}/>" for d in g["dependencies"] or ())
        + "</group>"
        for g in groups or ()
    )
    return f'<?xml version="1.0" encoding="utf-8"?><package><metadata><id>{escape(name)}</id><version>{escape(version)}</version><dependencies>{body}</dependencies></metadata></package>'


def archive(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(entries):
            z.writestr(zipfile.ZipInfo(name, EPOCH), entries[name])
    return out.getvalue()


def recorded(packages: DataFrame) -> DataFrame:
    """(path, content) of packages (id, version, files, groups); files are paths of empty stubs, a null list has none.

    Rows without id or version make no package.
    """
    reachable(packages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():  # one at a time, since a file may be large
                entries = {f: b"" for f in p["files"] or () if f is not None}
                entries[f"{p['id']}.nuspec"] = specification(p["id"], p["version"], p["groups"]).encode()
                name = f"{p['id']}.{p['version']}.nupkg".lower()
                yield pa.record_batch([pa.array([name]), pa.array([archive(entries)], pa.binary())], ["path", "content"])

    rows = packages.filter("id IS NOT NULL AND version IS NOT NULL").select("id", "version", "files", F.col("groups").cast(GROUPS).alias("groups"))
    return rows.mapInArrow(run, "path string, content binary")


def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the package files in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.nupkg").option("recursiveFileLookup", True).load(folder).select("path", "content")


def local(tag: str) -> str:
    """An element's name without its namespace."""
    return tag.rsplit("}", 1)[-1]


def described(content: bytes) -> dict:
    """{id, version, files, groups, problem} of a package's bytes; what can't be read has a problem and nothing else."""
    out = {"id": None, "version": None, "files": None, "groups": None, "problem": None}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(n for n in z.namelist() if not n.endswith("/"))
            own = [n for n in names if "/" not in n and n.lower().endswith(".nuspec")]
            if len(own) != 1:
                return out | {"problem": "no specification" if not own else "several specifications"}
            root = ElementTree.fromstring(z.read(own[0]))
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        return out | {"problem": type(e).__name__}
    told = {local(e.tag): e for m in root if local(m.tag) == "metadata" for e in m}
    groups = []
    for g in told.get("dependencies", ()):
        if local(g.tag) == "group":
            groups.append({"framework": g.get("targetFramework"), "dependencies": [{"id": d.get("id"), "range": d.get("version")} for d in g]})
        else:  # the older form: dependencies without groups hold for every framework
            groups.append({"framework": None, "dependencies": [{"id": g.get("id"), "range": g.get("version")}]})
    text = lambda n: told[n].text if n in told else None
    return out | {"id": text("id"), "version": text("version"), "files": [n for n in names if n != own[0]], "groups": groups}


def packages(files: DataFrame) -> DataFrame:
    """(path, id, version, files, groups, problem) of package files (path, content)."""
    reachable(files.sparkSession)
    group = pa.struct([("framework", pa.string()), ("dependencies", pa.list_(pa.struct([("id", pa.string()), ("range", pa.string())])))])
    kinds = {"id": pa.string(), "version": pa.string(), "files": pa.list_(pa.string()), "groups": pa.list_(group), "problem": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(content.as_py() or b"") for content in batch.column(1)]
            yield pa.record_batch([batch.column(0), *[pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()]], ["path", *kinds])

    return files.select("path", "content").mapInArrow(run, f"path string, id string, version string, files array<string>, groups {GROUPS}, problem string")


def dependencies(read: DataFrame) -> DataFrame:
    """(id, version, framework, dep_id, range) of what packages say they need; a group without any has no row."""
    each = read.select("id", "version", F.explode("groups").alias("g"))
    return each.select("id", "version", "g.framework", F.explode("g.dependencies").alias("d")).select("id", "version", "framework", F.col("d.id").alias("dep_id"), F.col("d.range").alias("range"))


def assets(read: DataFrame) -> DataFrame:
    """(id, version, framework, file): files below lib/ or ref/ by the folder that names their framework."""
    each = read.select("id", "version", F.explode("files").alias("file")).filter(r"file RLIKE '^(lib|ref)/[^/]+/.'")
    return each.select("id", "version", F.split("file", "/")[1].alias("framework"), "file")
