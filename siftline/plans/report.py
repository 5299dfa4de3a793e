"""Reports of a scan: terminal text, JSON, SARIF and HTML.

A report is a table of pieces of text in sections: what comes before the
findings, a piece for each finding in triage order, what comes after.  Spark
builds and sorts the pieces and writes them as files whose order is that of the
report; a single file or a terminal gets them as a stream, so the driver never
holds a report.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import findings as O
from siftline.plans.scan import ScanResult
from siftline.session import Scratch, new_path, written
from siftline.sources.packs import ENGINE_VERSION

#: Columns of a finding in JSON reports, and what they are called there.
VIEW = {
    "rule_id": "rule_id", "rule_name": "rule_name", "severity": "severity", "confidence": "confidence", "message": "message", "description": "description",
    "recommendation": "recommendation", "path": "file", "start_line": "line", "start_column": "column", "fingerprint": "fingerprint", "category": "category",
    "cwe": "cwe", "owasp": "owasp", "code_snippet": "code_snippet",
}

#: Sections of a report in order: its beginning, issues, what stands between, findings, its end.
HEAD, ISSUES, MIDDLE, FINDINGS, TAIL = range(5)


def timestamp(seconds: float | None = None) -> str:
    when = datetime.now(UTC) if seconds is None else datetime.fromtimestamp(seconds, UTC)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def _summary(findings: DataFrame) -> dict[str, int]:
    return O.severity_summary(findings).first().asDict()


def _categories(result: ScanResult) -> list[Row]:
    return result.categories.orderBy("category").collect()  # as many as the rules' categories


def _dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _pieces(result: ScanResult, finding: Column, issue: Column | None = None, head: str = "", middle: str = "", tail: str = "", between: str = "") -> DataFrame:
    """(section, rank, path, line, column, rule, text): the pieces of a report; ``between`` stands between those of one section."""
    place = F.split("path", "/")
    none = F.array().cast("array<string>")
    found = result.findings.select(F.lit(FINDINGS).alias("section"), (-F.col("severity_rank")).cast("int").alias("rank"), place.alias("at"), F.col("start_line").alias("line"), F.col("start_column").alias("column"), F.col("rule_id").alias("rule"), finding.alias("text"))
    zero = [F.lit(0).alias("rank"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("column"), F.lit("").alias("rule")]
    spark = found.sparkSession
    fixed = spark.createDataFrame([(HEAD, head), (MIDDLE, middle), (TAIL, tail)], "section int, text string").select("*", none.alias("at"), *zero)
    parts = [fixed, found]
    if issue is not None:
        parts.append(result.issues.select(F.lit(ISSUES).alias("section"), place.alias("at"), *zero, issue.alias("text")))
    every = reduce(DataFrame.unionByName, parts)
    order = ["section", "rank", "at", "line", "column", "rule", "text"]
    if not between:
        return every.orderBy(*order)
    # Written once in order, so that the first piece of each section is known: all others follow a separator.
    numbered = written(every.orderBy(*order).withColumn("n", F.monotonically_increasing_id()), "report")
    first = [r[0] for r in numbered.filter(F.col("section").isin(ISSUES, FINDINGS)).groupBy("section").agg(F.min("n").alias("n")).select("n").collect()]  # two numbers
    later = F.col("section").isin(ISSUES, FINDINGS) & ~F.col("n").isin(first)
    return numbered.withColumn("text", F.when(later, F.concat(F.lit(between), "text")).otherwise(F.col("text"))).orderBy("n")


def json_pieces(result: ScanResult) -> DataFrame:
    finding = _json(*[(F.upper(c) if c == "severity" else F.col(c)).alias(name) for c, name in VIEW.items()])
    counters = {k: result.counters.get(k, 0) for k in ("files_scanned", "files_skipped", "suppressed_inline")}
    metadata = {"engine_version": ENGINE_VERSION, "timestamp": timestamp(), "rule_packs": result.rule_packs, "rule_count": result.rule_count, **counters, "duration_ms": result.duration_ms}
    head = f'{{"version": "1.0",\n"severity_summary": {_dumps(_summary(result.findings))},\n"categories": {_dumps([c.asDict() for c in _categories(result)])},\n"issues": ['
    return _pieces(result, finding, _json("kind", F.col("path").alias("file"), "message"), head, '],\n"findings": [', f'],\n"metadata": {_dumps(metadata)}}}', ",")


def sarif_pieces(result: ScanResult) -> DataFrame:
    rank = F.col("severity_rank")
    uri = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "")
    region = F.struct("start_line", "start_column", "end_line", "end_column").alias("region")
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifact_location"), region).alias("physical_location"))
    finding = _json(
        F.col("rule_id").alias("ruleId"), X.sarif_level(rank).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.col("fingerprint").alias("siftlineFingerprint/v1")).alias("partialFingerprints"),
    )
    rules = []
    for f in O.triage(O.first_per_rule(result.findings)).collect():  # as many as rules
        level = "error" if f.severity_rank >= 3 else "warning" if f.severity_rank == 2 else "note"
        tags = [x for x in (f.category, f.cwe, f.owasp) if x]
        rules.append({"id": f.rule_id, "name": f.rule_name, "short_description": {"text": f.rule_name}, "full_description": {"text": f.description or f.rule_name}, "default_configuration": {"level": level}, "help": {"text": f.recommendation or ""}, "properties": {"tags": tags}})
    driver = {"name": "siftline", "version": ENGINE_VERSION, "rules": rules}
    head = f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {{"driver": {_dumps(driver)}}},\n"results": ['
    return _pieces(result, finding, head=head, tail="]}]}", between=",")


def terminal_pieces(result: ScanResult) -> DataFrame:
    cwe = F.when(F.col("cwe").isNotNull(), F.concat(F.lit(" ("), "cwe", F.lit(")"))).otherwise("")
    at = F.concat_ws(":", "path", "start_line", "start_column")
    finding = F.concat(F.upper("severity"), F.lit(" "), at, F.lit("\n  "), "rule_id", cwe, F.lit("\n  "), "message", F.lit("\n"))
    issue = F.concat(F.lit("warning: "), "kind", F.lit(" error in "), "path", F.lit(": "), "message")
    files = result.counters.get("files_discovered", result.counters.get("files_scanned", 0))
    out = [f"{result.findings.count()} finding(s) in {files} file(s)" + (" (degraded: results are incomplete)" if result.degraded else "")]
    if result.counters.get("files_skipped"):
        out.append(f"{result.counters['files_skipped']} file(s) skipped (unsupported language)")
    if result.counters.get("suppressed_inline"):
        out.append(f"{result.counters['suppressed_inline']} finding(s) suppressed inline")
    out.append("Categories:")
    out += [f"  {c.category:<30}{c.rules:>7} rule(s)  " + (f"{c.findings} finding(s)" if c.findings else "no findings") for c in _categories(result)]
    return _pieces(result, finding, issue, tail="\n".join(out))


def html_pieces(result: ScanResult) -> DataFrame:
    e = lambda c: X.html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    summary = "".join(f"<li>{s.upper()}: {n}</li>" for s, n in _summary(result.findings).items())
    escape = lambda v: str(v or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    categories = "".join(f"<tr><td>{escape(c.category)}</td><td>{c.rules}</td><td>{c.findings}</td></tr>" for c in _categories(result))
    finding = F.concat(
        F.lit("<article class='"), e("severity"), F.lit("'><h3>"), e("rule_name"), F.lit("</h3><p>"), F.upper(e("severity")), F.lit(" "), e("path"), F.lit(":"), e("start_line"), F.lit(":"), e("start_column"), F.lit(" "),
        e("rule_id"), F.lit("</p><p>"), e("message"), F.lit("</p><pre>"), e("code_snippet"), F.lit("</pre></article>"),
    )
    style = "body{font:14px sans-serif;max-width:60em;margin:auto}pre{background:#eee;padding:.5em}"
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Scan report</title><style>{style}</style></head><body><h1>Scan report</h1><ul>{summary}</ul><table>{categories}</table>"
    return _pieces(result, finding, head=head, tail="</body></html>")


FORMATS = {"auto": terminal_pieces, "terminal": terminal_pieces, "text": terminal_pieces, "json": json_pieces, "sarif": sarif_pieces, "html": html_pieces}


def pieces(result: ScanResult, kind: str = "auto") -> DataFrame:
    """The pieces of a report in order; each is followed by a line end."""
    if kind not in FORMATS:
        raise ValueError(f"unknown report format '{kind}'; known: {', '.join(FORMATS)}")
    return FORMATS[kind](result).filter("text != ''").select("text")


def _stream(result: ScanResult, kind: str) -> Iterator[str]:
    with Scratch(result.findings.sparkSession):
        for r in pieces(result, kind).toLocalIterator():
            yield r["text"] + "\n"


def render(result: ScanResult, kind: str = "auto") -> str:
    """A whole report as one text, for small ones."""
    if kind not in FORMATS:
        raise ValueError(f"unknown report format '{kind}'; known: {', '.join(FORMATS)}")
    return "".join(_stream(result, kind))


def json_report(result: ScanResult) -> str:
    return render(result, "json")


def sarif_report(result: ScanResult) -> str:
    return render(result, "sarif")


def terminal_report(result: ScanResult) -> str:
    return render(result, "terminal")


def html_report(result: ScanResult) -> str:
    return render(result, "html")


def write_parts(result: ScanResult, kind: str, folder: str) -> None:
    """A report as text files in a folder of any store; read in the order of their names, they are the report."""
    with Scratch(result.findings.sparkSession):
        pieces(result, kind).write.mode("overwrite").text(folder)


def write(result: ScanResult, kind: str, output: str | None) -> None:
    """A report to a file, or to the terminal, joined from parts that executors have written."""
    if kind not in FORMATS:
        raise ValueError(f"unknown report format '{kind}'; known: {', '.join(FORMATS)}")
    if not output:
        for text in _stream(result, kind):
            sys.stdout.write(text)
        return
    spark = result.findings.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    with Scratch(spark):
        folder = new_path(spark, "report-parts")
        write_parts(result, kind, folder)
        target = jvm.org.apache.hadoop.fs.Path(output if "://" in output else Path(output).absolute().as_uri())
        source = jvm.org.apache.hadoop.fs.Path(folder)
        fs, to = source.getFileSystem(conf), target.getFileSystem(conf)
        parts = sorted((p.getPath() for p in fs.globStatus(jvm.org.apache.hadoop.fs.Path(source, "part-*"))), key=lambda p: p.getName())
        whole = to.create(target, True)
        try:
            for p in parts:
                part = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, whole, 1 << 20, False)
                part.close()
        finally:
            whole.close()
