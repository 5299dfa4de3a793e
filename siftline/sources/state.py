"""What a project keeps between scans: baseline, cached findings, graph snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.session import drop_path, parts, spread, written

SCHEMA = 1
#: Days that cached findings are kept.
KEEP_DAYS = 30


def write_baseline(findings: DataFrame, path: str) -> None:
    """Fingerprints as lines of JSON; repeated ones stay."""
    findings.select("fingerprint").write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of a baseline folder, or of one JSON file {"fingerprints": [...]}."""
    raw = spark.read.option("multiLine", path.endswith(".json")).json(path)
    return raw.select(F.explode("fingerprints").alias("fingerprint")) if "fingerprints" in raw.columns else raw.select("fingerprint")


class FindingsCache:
    """Findings by (scope, path, source hash), a Parquet table partitioned by namespace and scope.

    A scope is a whole set of files, so a change to any of them misses.  Issues
    and suppression counts are cached with the findings, so a hit tells all.
    """

    def __init__(self, spark: SparkSession, path: str, namespace: str):
        self.spark, self.path, self.namespace = spark, path.rstrip("/"), f"{namespace}-{SCHEMA}"

    def _at(self, scope: str) -> str:
        return f"{self.path}/namespace={self.namespace}/scope={scope}"

    def get(self, scope: str) -> tuple[DataFrame, DataFrame, int] | None:
        """(findings, issues, number suppressed) of a scope, if it was put whole."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self._at(scope)}/counts/_SUCCESS")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        read = lambda what: self.spark.read.parquet(f"{self._at(scope)}/{what}")
        return read("findings"), read("issues"), read("counts").first()["suppressed"]

    def put(self, scope: str, findings: DataFrame, issues: DataFrame, suppressed: int) -> None:
        """Counts go last: a scope without them is not there."""
        findings.write.mode("overwrite").parquet(f"{self._at(scope)}/findings")
        issues.write.mode("overwrite").parquet(f"{self._at(scope)}/issues")
        self.spark.createDataFrame([(suppressed,)], "suppressed long").write.mode("overwrite").parquet(f"{self._at(scope)}/counts")

    def prune(self, days: int = KEEP_DAYS) -> int:
        """Deletes scopes last written over ``days`` ago; how many."""
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/namespace={self.namespace}")
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        oldest = sc._jvm.System.currentTimeMillis() - days * 86_400_000
        old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() < oldest]
        for p in old:
            fs.delete(p, True)
        return len(old)


#: Files that a snapshot is brought down to when it is written anew, at most.
BUCKETS = 64


class GraphSnapshot:
    """The facts of the code graph with the hashes of the files that they are from, a row a file.

    A scan asks for the facts of its files: those of unchanged files are taken over where they lie, only changed ones are
    parsed, and their rows are added as one more part of the store.  Rows of files that are gone, or that a later part has another
    row of, are never used; once they outnumber the others the store is written anew.  A row holds all facts of its file,
    so what a broken-off run has left is whole or not there.

    Files and rows meet by digests, and only digests of what differs are written, so neither texts nor facts
    move unless very many files have changed.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.parsed = 0  # files that the last refresh has parsed

    def _store(self) -> str:
        return f"{self.path}/schema={SCHEMA}/store"

    def _known(self) -> DataFrame | None:
        """All rows of the store, if there is one that can be read."""
        from pyspark.errors import PySparkException

        try:
            found = self.spark.read.parquet(self._store())
        except PySparkException:
            return None
        wanted = ["file_id", "path", "source_hash", "language", "facts", "part"]
        return found.select(*wanted) if set(wanted) <= set(found.columns) else None

    def _add(self, rows: DataFrame, number: int = 0) -> DataFrame:
        """Writes a part of the store, and gives it back; the first one is the store anew."""
        if not number:
            drop_path(self.spark, self._store())
        part = f"{self._store()}/part=p{number:09d}-{uuid.uuid4().hex}"
        # Stored rows are mostly names and hashes, which this makes smaller than the default does.
        rows.write.option("compression", "zstd").parquet(part)
        return self.spark.read.schema(rows.schema).parquet(part)

    def _apart(self, own: DataFrame, known: DataFrame) -> DataFrame:
        """(key, new): files to parse, by digest of their path, and stored rows not to be used, by digest of path and part."""
        digest = lambda c: F.unhex(F.md5(c))
        now = own.select(digest("path").alias("at"), digest("source_hash").alias("print"), F.lit(True).alias("asked"))
        last = F.max("part").over(Window.partitionBy("at"))
        was = known.select(digest("path").alias("at"), digest("source_hash").alias("had"), "part").withColumn("last", F.col("part") == last)
        # A file without a hash is like no stored one.
        met = now.join(was, "at", "full").withColumn("same", F.coalesce(F.col("last") & (F.col("print") == F.col("had")), F.lit(False))).filter("NOT same")
        told = F.array(
            F.when(F.col("asked") & F.coalesce("last", F.lit(True)), F.struct(F.col("at").alias("key"), F.lit(True).alias("new"))),
            F.when(F.col("part").isNotNull(), F.struct(digest(F.concat(F.lower(F.hex("at")), "part")).alias("key"), F.lit(False).alias("new"))),
        )
        return met.select(F.inline(F.array_compact(told)))

    def refresh(self, files: DataFrame) -> DataFrame:
        """The facts of ``files`` (file_id, path, language, text, source_hash), as a full build would give them; the store follows."""
        from siftline.operators.graph import each, parsed

        own = files.select("file_id", "path", "language", "text", "source_hash")
        known = self._known()
        if known is None:
            made = self._add(parsed(spread(own), "source_hash"))
            self.parsed = made.count()
            return each(made)
        apart = written(self._apart(own, known))
        new, gone = (apart.filter(F.col("new") == x).select("key") for x in (True, False))
        self.parsed, left = new.count(), gone.count()
        stay, number = known, int((known.agg(F.max("part")).first()[0] or "p0").partition("-")[0][1:]) + 1
        if left:
            stay = known.join(gone, F.unhex(F.md5(F.concat(F.md5("path"), "part"))) == F.col("key"), "left_anti")
        stay = stay.drop("part")
        if 2 * left > known.count():
            stay, number = self._add(written(stay).coalesce(self.buckets)), 1
        if not self.parsed:
            return each(stay)
        fresh = own.join(new, F.unhex(F.md5("path")) == F.col("key"), "left_semi").repartition(parts(self.spark, self.parsed))
        return each(stay.unionByName(self._add(parsed(fresh, "source_hash"), number)))

    def save(self, facts: DataFrame, files: DataFrame) -> None:
        facts.write.mode("overwrite").parquet(f"{self.path}/facts")
        files.select("path", "source_hash").write.mode("overwrite").parquet(f"{self.path}/files")

    def load(self, files: DataFrame) -> DataFrame | None:
        """The facts, or None where there are none, they can't be read, or the files differ."""
        from pyspark.errors import PySparkException

        from siftline.operators.graph import same_files

        try:
            known = self.spark.read.parquet(f"{self.path}/files")
            return self.spark.read.parquet(f"{self.path}/facts") if same_files(files, known) else None
        except PySparkException:
            return None
