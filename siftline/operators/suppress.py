"""Inline suppression markers, fixture annotations, and their interval joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Markers that silence findings; the first that a line has in a comment counts.
MARKERS = ("siftline:ignore", "nosec")
# What opens a comment.
OPENERS = ("//", "#", "/*", "*", "--")


def lines(corpus: DataFrame) -> DataFrame:
    """(file_id, line, source): 1-based lines of each text, native."""
    text = F.regexp_replace("text", r"\r?\n$", "")
    rows = corpus.select("file_id", F.posexplode(F.split(text, r"\r?\n", -1)).alias("p", "source"))
    return rows.select("file_id", (F.col("p") + 1).cast("long").alias("line"), "source")


def suppressions(corpus: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(file_id, line, rules): markers behind a comment opener; null rules silence every rule."""
    opener = "(?:" + "|".join(re.escape(o) for o in OPENERS) + r")(?U:\s)*"
    rest = F.lit(None).cast("string")
    for m in reversed(markers):
        found = F.regexp_extract("source", f"{opener}{re.escape(m)}(.*)$", 1)
        rest = F.when(F.col("source").rlike(opener + re.escape(m)), found).otherwise(rest)
    has = lines(corpus.filter(F.col("text").rlike("|".join(map(re.escape, markers))))).withColumn("rest", rest).filter("rest IS NOT NULL")
    names = F.regexp_replace(F.trim("rest"), "^:", "")
    ids = F.array_distinct(F.filter(F.transform(F.split(names, "[, \t]"), F.trim), lambda x: x.rlike(r"^[A-Za-z0-9._-]+$")))
    return has.select("file_id", "line", F.when(F.size(ids) > 0, ids).alias("rules"))


def suppressed(findings: DataFrame, marks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Findings that a marker silences (or, with ``left_anti``, that none does).

    A marker covers its own line and the next: two equi-joined rows, no range join.
    """
    own = F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("start_line")
    keys = marks.select("file_id", own, F.explode(F.coalesce("rules", F.array(F.lit("*")))).alias("rule"))
    hit = findings.select("file_id", "start_line", "rule_id").distinct().withColumn("rule", F.explode(F.array("rule_id", F.lit("*"))))
    silent = hit.join(keys.distinct(), ["file_id", "start_line", "rule"], "left_semi").drop("rule").distinct()
    return findings.join(silent, ["file_id", "start_line", "rule_id"], how).select(*findings.columns)


def annotations(corpus: DataFrame) -> DataFrame:
    """(file_id, line, kind, rule_id): 'ruleid:' says a finding is due on this line or the next, 'ok:' that none is."""
    found = None
    for kind, mark in (("ruleid", "ruleid:"), ("ok", "ok:")):
        name = F.regexp_extract("source", rf"{mark}(?U:\s)*((?U:\S)+)", 1)
        own = lines(corpus.filter(F.col("text").contains(mark))).select("file_id", "line", F.lit(kind).alias("kind"), name.alias("rule_id")).filter("rule_id != ''")
        found = own if found is None else found.unionByName(own)
    return found


def verdicts(annotated: DataFrame, findings: DataFrame, known: list[str]) -> DataFrame:
    """(file_id, kind, rule_id, line): expected, unexpected and unknown; no row is a pass."""
    spread = annotated.withColumn("start_line", F.explode(F.array(F.col("line"), F.col("line") + 1)))
    seen = findings.select("file_id", "rule_id", "start_line")
    met = spread.join(seen, ["file_id", "rule_id", "start_line"])
    due = annotated.filter("kind = 'ruleid'").join(met, ["file_id", "rule_id", "line"], "left_anti")
    missing = due.select("file_id", F.lit("expected").alias("kind"), "rule_id", "line")
    wrong = met.filter("kind = 'ok'").select("file_id", F.lit("unexpected").alias("kind"), "rule_id", F.col("start_line").alias("line"))
    unknown = annotated.filter(~F.col("rule_id").isin(known)).select("file_id", F.lit("unknown").alias("kind"), "rule_id", "line")
    return missing.unionByName(wrong).unionByName(unknown)


def verdict_line(kind: str, rule_id: str, line: int | None) -> str:
    if kind == "expected":
        return f"- no finding of '{rule_id}' at line {line}, where one is due"
    if kind == "unexpected":
        return f"+ finding of '{rule_id}' at line {line}, where none may be"
    return f"? rule '{rule_id}' is not known here"
