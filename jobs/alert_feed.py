"""Alert feed: what newly arrived texts hold that no earlier text has shown.

A file stream takes the files that have come to a folder since the last run,
scans their texts with the pattern rules of the packs and appends a row for
each new fingerprint (rule, path, line of text).  A text that comes again
unchanged, or moved within its file, gives no alert; an edited one gives alerts
for its new lines only.

    python -m jobs.alert_feed --source DIR --output DIR [--config FILE]

The output folder holds the stream's checkpoint and the alerts, partitioned by
batch and severity.  A batch is written under its number and asks only earlier
ones what is known, so a batch that is run again after a failure replaces
itself with the same rows.  A run without new files changes nothing.

Defined results: null texts give no alerts; a null key is the empty string in
paths; rows that share a key are one path, their equal lines one alert.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import load_config, pattern_rules, session, severity
from siftline.operators import findings as O
from siftline.operators import match, suppress
from siftline.session import Scratch, ship, written
from siftline.sources.packs import Rule

log = logging.getLogger("jobs.alert_feed")

SCHEMA = "fingerprint string, rule_id string, category string, path string, start_line long, start_column long, code_snippet string, places long, batch int, severity string"


def alerts(files: DataFrame, rules: list[Rule], least: str) -> DataFrame:
    """A row for each fingerprint of the files' findings: its first place, and how many there are."""
    found = written(O.at_least(match.findings(files, rules, unicode_classes=False), least))  # a small part of the texts, scanned once
    loud = suppress.suppressed(found, suppress.suppressions(files), "left_anti")
    first = F.min(F.struct("start_line", "start_column", "rule_id", "category", "severity", "path", "code_snippet")).alias("first")
    grouped = loud.groupBy("fingerprint").agg(first, F.count(F.lit(1)).alias("places"))
    return grouped.select("fingerprint", *[f"first.{c}" for c in ("rule_id", "category", "path", "start_line", "start_column", "code_snippet")], "places", "first.severity")


def read(spark: SparkSession, output: str) -> DataFrame:
    """All alerts of an output folder."""
    return spark.read.schema(SCHEMA).parquet(f"{output}/alerts")


def run(spark: SparkSession, source: str, output: str, config: dict) -> int:
    """Takes what is new in ``source`` and ends; the number of alerts that this run has added."""
    ship(spark)
    rules, least = pattern_rules(config["packs"]), severity(config, "min_severity", "low")
    rows = added = 0

    def one(batch: DataFrame, number: int) -> None:
        nonlocal rows, added
        key = F.coalesce(F.expr(config["key"]).cast("string"), F.lit(""))
        path = F.concat(F.lit(config.get("prefix", "")), key)
        files = batch.select(key.alias("file_id"), path.alias("path"), F.lit("text").alias("language"), F.expr(config["text"]).alias("text"))
        where = f"{output}/alerts/batch={number}"
        with Scratch(batch.sparkSession):
            fresh = alerts(files, rules, least)
            if number:
                known = read(batch.sparkSession, output).filter(F.col("batch") < number).select("fingerprint")
                fresh = fresh.join(known, "fingerprint", "left_anti")
            fresh.write.mode("overwrite").partitionBy("severity").parquet(where)
        taken, wrote = batch.count(), read(batch.sparkSession, output).filter(F.col("batch") == number).count()
        rows, added = rows + taken, added + wrote
        log.info("batch %d: read %d rows, wrote %d alerts to %s", number, taken, wrote, where)

    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if config.get("files_per_batch"):
        stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
    log.info("reading what is new in %s, %d rules", source, len(rules))
    query = stream.parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows, wrote %d new alerts", rows, added)
    return added


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Alerts for what newly arrived texts hold.")
    parser.add_argument("--source", required=True, help="folder to which Parquet files of texts come")
    parser.add_argument("--output", required=True, help="folder of the alerts and the stream's checkpoint")
    parser.add_argument("--config", help="a TOML file; by default the one beside this job")
    args = parser.parse_args(argv)
    config = load_config(__file__, args.config)
    spark = session("alert-feed")
    try:
        run(spark, args.source, args.output, config)
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
