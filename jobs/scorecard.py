"""Scorecards: how each owner of text stands, by category of rule.

Every text of the configured tables is scanned with the pattern rules of the
packs; inline markers silence findings.  A card is a row for each owner and
each category of the rules, zeros included: files, files with findings,
findings by severity, where the first one is, and a grade.  Each corpus is a
folder of the output, partitioned by category, and is replaced as a whole, so a
run that is repeated, or was broken off, ends in the same output.  A corpus that
leaves the configuration keeps its last cards.

    python -m jobs.scorecard --tables DIR --output DIR [--config FILE]

Exit codes: 0 no finding at or above ``fail_on``, 2 some.

Defined results: null texts count as files without findings; a null owner is
the empty string; a null key is the empty string in paths.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import ConfigError, load_config, pattern_rules, session, severity
from siftline.operators import findings as O
from siftline.operators import match, suppress
from siftline.session import Scratch, table, written
from siftline.sources.packs import SEVERITIES, Rule

log = logging.getLogger("jobs.scorecard")

SCHEMA = (
    "owner string, files long, files_hit long, findings long, info long, low long, medium long, high long, critical long, "
    "first_rule string, first_path string, first_line long, score long, grade string, corpus string, category string"
)


def corpus(spark: SparkSession, tables: str, spec: dict) -> DataFrame:
    """(file_id, path, language, text) of a table; ``file_id`` carries the owner, so findings need no join to learn it."""
    text = lambda e: F.coalesce(F.expr(e).cast("string"), F.lit(""))
    rows = table(spark, tables, spec["name"])
    return rows.select(
        F.struct(text(spec["owner"]).alias("owner"), text(spec["key"]).alias("key")).alias("file_id"),
        F.concat(F.lit(spec["name"] + "/"), text(spec["key"])).alias("path"),
        F.lit("text").alias("language"),
        F.expr(spec["text"]).alias("text"),
    )


def grade(score: Column, grades: list, worst: str) -> Column:
    out = F.lit(worst)
    for letter, bound in reversed(grades):
        out = F.when(score <= bound, letter).otherwise(out)
    return out


def cards(files: DataFrame, rules: list[Rule], config: dict) -> DataFrame:
    """The cards of one corpus: an aggregate of its findings, joined to the owners' numbers of files."""
    found = written(O.at_least(match.findings(files, rules, unicode_classes=False), severity(config, "min_severity", "low")))  # a small part of the texts, scanned once
    loud = suppress.suppressed(found, suppress.suppressions(files), "left_anti")
    place = F.min(F.struct(F.split("path", "/").alias("at"), "start_line", "start_column", "rule_id", "path")).alias("first")
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    # By file first, then by owner: no task gathers the findings of a large owner.
    category = F.coalesce("category", F.lit("uncategorized")).alias("category")
    by_file = loud.groupBy("file_id", category).agg(place, *counts)
    sums = [F.sum(s).alias(s) for s in SEVERITIES]
    hits = by_file.groupBy(F.col("file_id.owner").alias("owner"), "category").agg(F.count(F.lit(1)).alias("files_hit"), F.min("first").alias("first"), *sums)
    categories = sorted({r.category or "uncategorized" for r in rules})
    owners = files.groupBy(F.col("file_id.owner").alias("owner")).agg(F.count(F.lit(1)).alias("files"))
    every = owners.withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    full = every.join(hits, ["owner", "category"], "left").fillna(0, ["files_hit", *SEVERITIES])
    weighted = sum((F.col(s) * config["weights"].get(s, 0) for s in SEVERITIES), F.lit(0))
    scored = full.withColumn("weighted", weighted.cast("long")).withColumn("score", F.expr("1000 * weighted DIV files"))
    return scored.select(
        "owner", "files", "files_hit", sum((F.col(s) for s in SEVERITIES), F.lit(0)).cast("long").alias("findings"), *[F.col(s).cast("long") for s in SEVERITIES],
        F.col("first.rule_id").alias("first_rule"), F.col("first.path").alias("first_path"), F.col("first.start_line").alias("first_line"),
        "score", grade(F.col("score"), config["grades"], config["worst"]).alias("grade"), "category",
    )


def run(spark: SparkSession, tables: str, output: str, config: dict) -> dict[str, int]:
    """Writes the cards of every configured corpus; what each severity counts over all of them."""
    if not config.get("corpora"):
        raise ConfigError("no corpora are configured")
    rules = pattern_rules(config["packs"])
    for spec in config["corpora"]:
        where = f"{output}/corpus={spec['name']}"
        log.info("reading %s/%s.parquet, %d rules", tables, spec["name"], len(rules))
        with Scratch(spark):
            cards(corpus(spark, tables, spec), rules, config).write.mode("overwrite").partitionBy("category").parquet(where)
    names = [c["name"] for c in config["corpora"]]
    one = F.col("category") == min(r.category or "uncategorized" for r in rules)  # each owner has a card of it, so its files count once
    wrote = read(spark, output).filter(F.col("corpus").isin(names)).groupBy("corpus").agg(F.sum(F.when(one, F.col("files"))).alias("files"), F.count(F.lit(1)).alias("cards"), F.sum("findings").alias("findings"), *[F.sum(s).alias(s) for s in SEVERITIES])
    totals = dict.fromkeys(SEVERITIES, 0)
    for r in wrote.toLocalIterator():  # a row for each configured corpus
        log.info("read %d files of %s, wrote %d cards with %d findings to %s/corpus=%s", r["files"], r["corpus"], r["cards"], r["findings"], output, r["corpus"])
        totals = {s: n + r[s] for s, n in totals.items()}
    return totals


def read(spark: SparkSession, output: str) -> DataFrame:
    """All cards of an output folder."""
    return spark.read.schema(SCHEMA).parquet(output)


def failing(totals: dict[str, int], fail_on: str) -> bool:
    return any(totals[s] for s in SEVERITIES[SEVERITIES.index(fail_on) :])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Scorecards of the owners of texts.")
    parser.add_argument("--tables", required=True, help="folder of the Parquet tables")
    parser.add_argument("--output", required=True, help="folder of the cards")
    parser.add_argument("--config", help="a TOML file; by default the one beside this job")
    args = parser.parse_args(argv)
    config = load_config(__file__, args.config)
    spark = session("scorecard")
    try:
        return 2 if failing(run(spark, args.tables, args.output, config), severity(config, "fail_on", "critical")) else 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
