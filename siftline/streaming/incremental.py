"""Continuous scans: new files of a landing folder, scanned as they come.

The engine's data has no event time, so a stream is a sequence of batches of
new files; each is scanned whole and its findings are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators import match
from siftline.plans.scan import Scanner


def scan_stream(scanner: Scanner, corpus: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends findings of each batch of a streaming corpus (file_id, path, language, text) to Parquet.

    Batches are written under their number, so one that is run again replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        scanner.scan(batch.persist()).findings.write.mode("overwrite").parquet(f"{output}/batch={number}")
        batch.unpersist()

    writer = corpus.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def pattern_stream(scanner: Scanner, corpus: DataFrame) -> DataFrame:
    """Pattern findings as a streaming table: the native branch is a projection, so it streams as it is."""
    return match.findings(corpus, [r for r in scanner.registry.rules if r.capability == "pattern"], scanner.unicode)


def category_counts(findings: DataFrame) -> DataFrame:
    """Running counts by category and severity."""
    return findings.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category"), "severity").agg(F.count(F.lit(1)).alias("findings"))
