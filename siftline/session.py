"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import re
import shutil
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 2 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on the executors; once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_siftline_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="siftline-")
        context.addPyFile(shutil.make_archive(f"{folder}/siftline-package", "zip", package.parent, package.name))
        context._siftline_shipped = True
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) in (None, "67108864b", "-1"):  # where no one has chosen: less memory for each worker
        spark.conf.set(limit, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read through Spark so that any store works."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task is given at most, about, where a step costs far more than moving them.
TASK_ROWS = 20_000


def parts(spark: SparkSession, rows: int) -> int:
    """Parts of a table of so many rows that use all cores and keep a task's work bounded."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, and over as many parts as keep a task's work bounded, for steps that cost far more than moving their rows."""
    n = parts(df.sparkSession, df.count())
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is set up only where it is unset and all tasks run in this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Blocks(threading.local):
    """Blocks open in a thread of the driver, the innermost last."""

    def __init__(self):
        self.open: list[Scratch] = []


_BLOCKS = _Blocks()


class Scratch:
    """Tables that this thread writes inside the block go at its end, but for those given to :meth:`keep`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Scratch:
        _BLOCKS.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes a result that outlives the block; an enclosing block may drop it in turn."""
        out = written(df, "kept")
        self.paths.discard(out.scratch_path)
        if len(_BLOCKS.open) > 1:
            _BLOCKS.open[-2].paths.add(out.scratch_path)
        return out

    def __exit__(self, *_) -> None:
        _BLOCKS.open.pop()
        for path in self.paths:
            drop_path(self.spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no one else uses; an open block drops what comes to stand there."""
    path = f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"
    if _BLOCKS.open:
        _BLOCKS.open[-1].paths.add(path)
    return path


def written(df: DataFrame, name: str = "engine", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and lost executors lose nothing.

    ``by``: columns of few values that readers choose rows by, who then read no others.
    """
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


class Rounds:
    """A table that grows by what each round of a loop adds; reading it is one scan, whatever the number of rounds."""

    def __init__(self, spark: SparkSession, name: str = "rounds"):
        self.spark, self.path, self.n = spark, new_path(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes what a round has found, and gives it back as a table."""
        at = f"{self.path}/round={self.n}"
        df.write.parquet(at)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(at)

    def all(self) -> DataFrame:
        """What all rounds have added."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={i}" for i in range(self.n)])


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the shared place."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
