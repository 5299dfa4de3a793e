"""Order, roll-ups, windows and baselines over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources.packs import SEVERITIES


def triage(findings: DataFrame) -> DataFrame:
    """Most severe first, then by path (segment by segment), line, column and rule."""
    return findings.orderBy(F.desc("severity_rank"), F.split("path", "/"), "start_line", "start_column", "rule_id")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity_rank") >= SEVERITIES.index(severity))


def category_rollup(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, rules, findings) of every category that has either, zeros filled in."""
    name = F.coalesce("category", F.lit("uncategorized")).alias("category")
    loaded = rules.groupBy(name).agg(F.count(F.lit(1)).alias("rules"))
    found = findings.groupBy(name).agg(F.count(F.lit(1)).alias("findings"))
    both = loaded.join(found, "category", "full")
    return both.select("category", F.coalesce("rules", F.lit(0)).cast("long").alias("rules"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row with a count for each severity."""
    return findings.agg(*[F.count_if(F.col("severity_rank") == i).alias(s) for i, s in enumerate(SEVERITIES)])


def exit_code(findings: DataFrame, degraded: bool, fail_on: str | None) -> int:
    """3 if any file could not be analysed, 2 if findings (at or above ``fail_on``) remain, else 0."""
    if degraded:
        return 3
    return 2 if not (at_least(findings, fail_on) if fail_on else findings).isEmpty() else 0


def first_per_rule(findings: DataFrame) -> DataFrame:
    """The first finding of each rule in triage order.  A minimum, so nothing is sorted or gathered."""
    order = F.struct(F.split("path", "/"), "start_line", "start_column", F.struct(*findings.columns).alias("row"))
    return findings.groupBy("rule_id").agg(F.min(order).alias("m")).select("m.row.*")


#: Bytes of a file whose spans are looked at together.
BIN = 1 << 16


def innermost(findings: DataFrame) -> DataFrame:
    """Drops findings whose span strictly holds another of the same rule and file; equal spans all stay.

    Needs start_byte and end_byte.  What a span holds begins in its own bin, where a window finds it, or in a later one, of
    which only the least end matters; so the spans of one rule and file are spread over the bins of the file.
    """
    group = ["rule_id", "path", "bin"]
    spans = findings.select("rule_id", "path", "start_byte", "end_byte").distinct().withColumn("bin", F.expr(f"start_byte DIV {BIN}"))
    least = F.min(F.struct("end_byte", "start_byte"))
    after = Window.partitionBy(*group).orderBy("start_byte", F.desc("end_byte")).rowsBetween(1, Window.unboundedFollowing)
    bins = spans.groupBy(*group).agg(least.alias("m"))
    later = bins.select(*group, F.min("m").over(Window.partitionBy("rule_id", "path").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    inner = spans.withColumn("own", least.over(after)).join(later, group).withColumn("in", F.least("own", "later"))
    keep = inner.filter("in IS NULL OR in.end_byte > end_byte OR in.start_byte >= end_byte").select("rule_id", "path", "start_byte", "end_byte")
    return findings.join(keep, ["rule_id", "path", "start_byte", "end_byte"], "left_semi").select(*findings.columns)


def new_against(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*findings.columns)


def existing_in(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi").select(*findings.columns)


def fixed_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Fingerprints of the baseline that no finding has."""
    return baseline.select("fingerprint").distinct().join(findings, "fingerprint", "left_anti")


def baseline_counts(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: existing, new, fixed."""
    known = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    status = findings.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).join(known, "fingerprint", "full")
    sum_ = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0)).cast("long")
    has, was = F.col("n").isNotNull(), F.col("known").isNotNull()
    return status.agg(sum_(has & was, F.col("n")).alias("existing"), sum_(has & ~was, F.col("n")).alias("new"), sum_(~has, F.lit(1)).alias("fixed"))


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")
