"""A whole scan: files and rules in, findings and their roll-ups out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import findings as O
from siftline.operators import match, query, suppress, taint
from siftline.operators.graph import facts
from siftline.session import ship, written
from siftline.sources import listing, tree
from siftline.sources.packs import BUILT_IN, Registry, load_pack, rules_table
from siftline.sources.state import FindingsCache, GraphSnapshot


@dataclass
class ScanResult:
    """Findings in no order (see ``operators.findings.triage``), roll-ups and counters."""

    findings: DataFrame
    categories: DataFrame
    issues: DataFrame
    counters: dict[str, int] = field(default_factory=dict)
    rule_packs: list[str] = field(default_factory=list)
    rule_count: int = 0
    duration_ms: int = 0

    @property
    def degraded(self) -> bool:
        return not self.issues.isEmpty()


class Scanner:
    """Rules of a registry against corpora."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, unicode_classes: bool = True):
        self.spark, self.registry, self.unicode = ship(spark), registry or Registry.built_in(), unicode_classes

    @classmethod
    def for_packs(cls, spark: SparkSession, packs: list[str] | None = None, pack_dirs: list[str] | None = None) -> Scanner:
        """Built-in packs, then those of folders, then only the names asked for."""
        registry = Registry.built_in()
        if packs and "corpus" in packs:
            registry.add(load_pack(BUILT_IN / "corpus"))
        for d in pack_dirs or []:
            registry.add(load_pack(d))
        return cls(spark, registry.select(packs) if packs else registry)

    def findings(self, corpus: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Findings of all three capabilities over (file_id, path, language, text), before suppression; ``known``: the graph's facts."""
        rules = self.registry.rules
        out = match.findings(corpus, rules, self.unicode).withColumn("source_line", F.lit(None).cast("long"))
        if any(r.capability == "query" for r in rules):
            out = out.unionByName(query.findings(corpus, rules).withColumn("source_line", F.lit(None).cast("long")))
        if any(r.capability == "taint" for r in rules):
            out = out.unionByName(taint.taint_findings(corpus, rules, known))
        return out

    def scan(self, corpus: DataFrame, snapshot: GraphSnapshot | None = None) -> ScanResult:
        """A scan of a corpus table; with a snapshot (``corpus`` has source_hash, too) only changed files are parsed for the graph."""
        began = time.time()
        known = written(snapshot.refresh(corpus) if snapshot else facts(corpus))
        every = written(self.findings(corpus, known))
        marks = written(suppress.suppressions(corpus))
        kept = suppress.suppressed(every, marks, "left_anti")
        parsed = known.filter("kind = 'issue'").select(F.lit("parse").alias("kind"), "path", F.col("detail").alias("message"))
        return self._result(kept, parsed, suppress.suppressed(every, marks).count(), corpus.count(), began)

    def _result(self, kept: DataFrame, issues: DataFrame, suppressed: int, files: int, began: float | None = None) -> ScanResult:
        categories = O.category_rollup(kept, rules_table(self.spark, self.registry.rules))
        counters = {"files_scanned": files, "files_skipped": 0, "suppressed_inline": suppressed}
        took = int(1000 * (time.time() - began)) if began else 0
        return ScanResult(kept, categories, issues, counters, [p.name for p in self.registry.packs], len(self.registry.rules), took)

    def scan_paths(self, paths: list[str], excludes: list[str] | None = None, files: list[str] | None = None, cache: FindingsCache | None = None, snapshot: GraphSnapshot | None = None) -> ScanResult:
        """A scan of files and folders; ``files`` narrows it to a list of them, as changed ones.

        Paths that name their store (``hdfs://``, ``file://``) are listed and read by executors, plain ones lie on the driver's disk.

        With a cache, the very same set of files is not scanned again; with a snapshot, unchanged files are not parsed again for the graph.
        """
        if files is None and any(map(listing.remote, paths)):
            rows = listing.read(listing.listing(self.spark, paths, excludes))
        else:
            rows = tree.read_files(self.spark, tree.discover(tree.resolve(paths), excludes) if files is None else files)
        prepared = written(tree.prepare(rows))
        scope = tree.scope_id(prepared) if cache else ""
        corpus = prepared.filter("status = 'analysed'").select("file_id", "path", "language", "text", "source_hash")
        if cache and (known := cache.get(scope)):
            result = self._result(*known, corpus.count())
        else:
            result = self.scan(corpus, snapshot)
            if cache:
                cache.put(scope, result.findings, result.issues, result.counters["suppressed_inline"])
        unread = prepared.filter("status = 'read'").select(F.lit("read").alias("kind"), "path", "message")
        result.issues = result.issues.unionByName(unread)
        result.counters |= {"files_discovered": prepared.count(), "files_skipped": prepared.filter("status = 'skipped'").count()}
        return result
