"""Writers: envelopes, ledger entries, findings as SARIF, graphs as DOT and Mermaid, tables as Markdown, solution filters.

JSON is made by Spark. Text forms are made on the driver from results that are small by nature; each of them states
its bound and refuses more.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a result that is written as one text.
TEXT_ROWS = 100_000
# Exit codes by precedence.
EXIT_CODES = [("usage", 2), ("environment", 3), ("partial", 4), ("findings", 1)]
# Severities as SARIF levels.
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def rows_of(df: DataFrame) -> list:
    rows = df.limit(TEXT_ROWS + 1).collect()
    if len(rows) > TEXT_ROWS:
        raise ValueError(f"more than {TEXT_ROWS} rows; write the table instead")
    return rows


def exit_code(**found: bool) -> int:
    """0, or the code of the first condition that holds, by precedence."""
    return next((code for name, code in EXIT_CODES if found.get(name)), 0)


def ordered_diagnostics(diagnostics: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Overrides first (`none` drops), then the order: file, line and column with nulls first, code, message."""
    severity = F.col("severity")
    for code, level in (overrides or {}).items():
        severity = F.when(F.col("code") == code, level).otherwise(severity)
    rows = diagnostics.withColumn("severity", severity).filter("severity != 'none'")
    return rows.orderBy(*[F.col(c).asc_nulls_first() for c in ("file", "line", "column")], "code", "message")


def envelope(result: DataFrame, command: str, version: str, diagnostics: DataFrame | None = None) -> DataFrame:
    """(json): one document with header, result rows in their order, and diagnostics; for small results."""
    spark = result.sparkSession
    rows = [json.loads(r[0]) for r in rows_of(result.select(F.to_json(F.struct("*"))))]
    told = [json.loads(r[0]) for r in rows_of(ordered_diagnostics(diagnostics).select(F.to_json(F.struct("*"))))] if diagnostics is not None else []
    return spark.createDataFrame([(json.dumps({"command": command, "version": version, "result": rows, "diagnostics": told}, ensure_ascii=False),)], "json string")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object to a line, in as many files as the table has partitions."""
    df.write.mode(mode).json(path)


def append_ledger(snapshot: DataFrame, folder: str) -> None:
    """One partition for each day and content hash: writing a snapshot again replaces it by itself."""
    rows = snapshot.withColumns({"day": F.substring("created_at", 1, 10), "hash": F.substring(F.sha2(F.to_json(F.struct(*snapshot.columns)), 256), 1, 8)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hash").parquet(folder)


def markdown(df: DataFrame, title: str | None = None) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows_of(df))]) + "\n"


def grouped_markdown(df: DataFrame, group: str, line: str, k: int) -> str:
    """Lines under a heading for each group, k at most, then how many more there are."""
    from tesserae.operators.relational import top_per_key

    shown, out, last = rows_of(top_per_key(df.select(group, line), [group], [F.col(line)], k).orderBy(group, line)), [], object()
    for i, r in enumerate(shown):
        if r[group] != last:
            out += ["", f"### {r[group]}", ""] if out else [f"### {r[group]}", ""]
            last = r[group]
        out.append(f"- {r[line]}")
        if r["n_more"] and (i + 1 == len(shown) or shown[i + 1][group] != last):
            out.append(f"- {r['n_more']} more")
    return "\n".join(out) + "\n"


def rule_entry(r: dict, tool: str) -> dict:
    """A rule's description: (rule, title, recommendation, help_uri, severity, category, pack); what is null is left out."""
    text = lambda v: {"text": v} if v is not None else None
    name = "".join(w[:1].upper() + w[1:] for w in re.findall(r"[^\W_]+", r["title"] or ""))
    held = {
        "id": r["rule"], "name": name or None, "shortDescription": text(r["title"]), "helpUri": r["help_uri"], "help": text(r["recommendation"]),
        "defaultConfiguration": {"level": LEVELS.get(r["severity"], "note")}, "properties": {"category": r["category"], "tags": [x for x in (tool, r["pack"], r["category"]) if x is not None]},
    }
    return {k: v for k, v in held.items() if v is not None}


def sarif(findings: DataFrame, tool: str, version: str, rules: DataFrame | None = None) -> str:
    """Findings in order; rules, if given, are listed whole, those without a finding too."""
    rows = rows_of(findings.orderBy("rule", "project", "file", "line", "column", "symbol"))
    told = {r["rule"]: rule_entry(r.asDict(), tool) for r in rows_of(rules)} if rules is not None else {}
    names = sorted({r["rule"] for r in rows} | set(told))
    place = {n: i for i, n in enumerate(names)}
    results = [
        {
            "ruleId": r["rule"], "ruleIndex": place[r["rule"]], "level": LEVELS.get(r["severity"], "note"), "message": {"text": r["message"] or ""},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": {"startLine": r["line"], "startColumn": r["column"]}}}],
        }
        for r in rows
    ]
    driver = {"name": tool, "version": version, "rules": [told.get(n, {"id": n}) for n in names]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=1, ensure_ascii=False)


def quoted(text) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"') + '"'


# How marks of a graph are drawn, by class, by kind, and for cycles and references to files.
FILLS = {"framework": "firebrick", "standard": "seagreen", "modern": "steelblue", "dual": "darkorange"}
SHAPES = {"library": "box", "console": "box", "service": "hexagon", "web": "tab", "test": "box", "winforms": "box", "wpf": "box"}
CYCLE, FILE_EDGE = "red", "assembly"


def marked_dot(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> str:
    """A directed graph with its marks: fill for the class, shape for the kind, cycles in red, references to files dashed.

    nodes (id, framework_class, kind), edges (src, dst, kind), cycles (component, members).
    """
    of = {m: r["component"] for r in rows_of(cycles.select("component", "members")) for m in r["members"]}
    out = ["digraph g {", "  node [style=filled, fontcolor=white];"]
    for r in rows_of(nodes.select("id", "framework_class", "kind").orderBy("id")):
        held = {"fillcolor": FILLS.get(r["framework_class"], "gray"), "shape": SHAPES.get(r["kind"], "ellipse")}
        held |= {"style": quoted("filled,dashed")} if r["kind"] == "test" else {"peripheries": 2} if r["kind"] in ("winforms", "wpf") else {}
        held |= {"color": CYCLE} if r["id"] in of else {}
        out.append(f"  {quoted(r['id'])} [{', '.join(f'{k}={v}' for k, v in held.items())}];")
    for r in rows_of(edges.select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind")):
        held = ["style=dashed"] * (r["kind"] == FILE_EDGE) + [f"color={CYCLE}"] * (r["src"] in of and of[r["src"]] == of.get(r["dst"]))
        out.append(f"  {quoted(r['src'])} -> {quoted(r['dst'])}" + (f" [{', '.join(held)}];" if held else ";"))
    return "\n".join([*out, "}"]) + "\n"


def dot(nodes: DataFrame, edges: DataFrame, cluster: str | None = None) -> str:
    """A directed graph, nodes (id, ...) and edges (src, dst) in order, in a cluster for each value of a column."""
    rows, out, last = rows_of(nodes.orderBy(*([cluster] if cluster else []), "id")), ["digraph g {"], None
    for r in rows:
        if cluster and r[cluster] != last:
            out += ["  }"] * (last is not None) + [f"  subgraph {quoted('cluster_' + str(r[cluster]))} {{", f"    label={quoted(r[cluster])};"]
            last = r[cluster]
        out.append(f"  {'  ' * bool(cluster)}{quoted(r['id'])};")
    out += ["  }"] * (last is not None)
    out += [f"  {quoted(r['src'])} -> {quoted(r['dst'])};" for r in rows_of(edges.select("src", "dst").distinct().orderBy("src", "dst"))]
    return "\n".join([*out, "}"]) + "\n"


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    rows = rows_of(nodes.select("id").orderBy("id"))
    name = {r["id"]: f"n{i}" for i, r in enumerate(rows)}
    out = ["graph TD", *(f'  {name[r["id"]]}["{str(r["id"]).replace(chr(34), "#quot;")}"]' for r in rows)]
    out += [f"  {name[r['src']]} --> {name[r['dst']]}" for r in rows_of(edges.select("src", "dst").distinct().orderBy("src", "dst")) if r["src"] in name and r["dst"] in name]
    return "\n".join(out) + "\n"


def html(nodes: DataFrame, edges: DataFrame, title: str) -> str:
    import html as h

    body = h.escape(mermaid(nodes, edges))
    return f'<!doctype html><meta charset="utf-8"><title>{h.escape(title)}</title><h1>{h.escape(title)}</h1><pre class="mermaid">{body}</pre>\n'


def solution_filter(solution: str, projects: DataFrame, column: str = "node") -> str:
    names = [str(r[0]).replace("/", "\\") for r in rows_of(projects.select(column).distinct().orderBy(column))]
    return json.dumps({"solution": {"path": solution.replace("/", "\\"), "projects": names}}, indent=2)
