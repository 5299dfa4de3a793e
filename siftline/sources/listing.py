"""Source trees on any store: folders are listed and files read by executors, and no path comes to the driver but the targets.

A task takes folders and lists below each breadth first, up to a number of them; what it has not come to goes back as work of
the next round, dealt over all tasks.  So a small tree takes one round, a wide one spreads at once, and a chain of folders takes
its depth over that number.  Ignored and excluded folders are never listed.  Rounds are tables in the shared folder.

Defined results
    target that isn't there   fatal, before anything is listed
    target that is a file     taken whatever its name, unless it is a link
    links                     never followed below a target; stores other than local ones show none
    targets that overlap      a path is given once
    file gone before reading  no content; :func:`siftline.sources.tree.prepare` makes it an issue
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import Rounds, ship
from siftline.sources.tree import IGNORED, MAX_BYTES, ScopeError, excluded

#: Folders that a task lists below one that it was given.
FOLDERS = 64
#: Bytes of contents in an Arrow batch, and of files that one task reads.
BATCH_BYTES, TASK_BYTES = 4 << 20, 64 << 20
# Schemes that have other names here than in Hadoop.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def remote(path: str) -> bool:
    """Whether a path names its store."""
    return "://" in path


def _place(target: str) -> str:
    """A target as a whole address."""
    return target.rstrip("/") or target if remote(target) else f"file://{os.path.abspath(target)}"


class Store:
    """The store of an address; a path of it is the address's path and what comes below."""

    def __init__(self, target: str):
        from pyarrow import fs

        address = _place(target)
        scheme = urlsplit(address).scheme
        self.local = scheme == "file"
        if self.local:
            self.fs, self.root = fs.LocalFileSystem(), address.removeprefix("file://")
        else:
            self.fs, root = fs.FileSystem.from_uri(quote(address.replace(scheme, SCHEMES.get(scheme, scheme), 1), safe="/:@?=&"))
            self.root = unquote(root)

    def path(self, relative: str) -> str:
        return f"{self.root}/{relative}" if relative else self.root

    def is_folder(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info([self.root])[0].type == fs.FileType.Directory

    def is_file(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info([self.root])[0].is_file and not (self.local and os.path.islink(self.root))

    def size(self) -> int:
        return self.fs.get_file_info([self.root])[0].size

    def entries(self, relative: str) -> Iterator[tuple[str, bool, int]]:
        """(name, whether it is a folder, bytes) of what lies in a folder, without links and special files."""
        if self.local:
            with os.scandir(self.path(relative)) as found:
                for e in found:
                    if not e.is_symlink() and (e.is_dir() or e.is_file()):
                        yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
            return
        from pyarrow import fs

        for info in self.fs.get_file_info(fs.FileSelector(self.path(relative))):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0

    def read(self, relative: str) -> bytes | None:
        """At most one byte more than is taken; None if it can't be read."""
        try:
            with self.fs.open_input_file(self.path(relative)) as f:
                return f.read(MAX_BYTES + 1)
        except OSError:
            return None


def _check(spark: SparkSession, targets: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in targets:
        where = jvm.org.apache.hadoop.fs.Path(_place(t))
        if not where.getFileSystem(conf).exists(where):
            raise ScopeError(f"path does not exist: {t}")


def _below(store: Store, relative: str, excludes: list[str]) -> Iterator[tuple[bool, str, int]]:
    """(whether still to be listed, relative path, bytes) of files below a folder, and of folders that are left for others."""
    waiting, left = deque([relative]), FOLDERS
    while waiting and left:
        folder, left = waiting.popleft(), left - 1
        for name, is_folder, size in store.entries(folder):
            path = f"{folder}/{name}" if folder else name
            if excluded(path, excludes):
                continue
            if not is_folder:
                yield False, path, size
            elif name not in IGNORED:
                waiting.append(path)
    for folder in waiting:
        yield True, folder, 0


_FOUND = "folder boolean, target string, relative string, length long"


def listing(spark: SparkSession, targets: list[str], excludes: list[str] | None = None) -> DataFrame:
    """(path, target, relative, length) of regular files below targets, those of ``tree.discover``; the table is in the shared folder."""
    ship(spark)
    _check(spark, targets)
    globs, cores = list(excludes or []), spark.sparkContext.defaultParallelism

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, Store] = {}
        for batch in batches:
            for target, relative in zip(*(batch.column(c).to_pylist() for c in ("target", "relative")), strict=True):
                store = stores.get(target) or stores.setdefault(target, Store(target))
                if relative or store.is_folder():
                    yield from _packed(target, _below(store, relative, globs))
                elif store.is_file():
                    yield from _packed(target, [(False, "", store.size())])

    rounds = Rounds(spark, "listing")
    work = spark.createDataFrame([(t, "") for t in dict.fromkeys(targets)], "target string, relative string")
    while True:
        found = rounds.add(work.repartition(cores).mapInArrow(step, _FOUND))
        work = found.filter("folder").select("target", "relative")
        if work.isEmpty():
            break
    base = F.when(F.col("target").rlike("^/+$"), "/").otherwise(F.regexp_replace("target", "/+$", ""))
    path = F.when(F.col("relative") == "", F.col("target")).otherwise(F.concat(base, F.when(base == "/", "").otherwise("/"), F.col("relative")))
    files = rounds.all().filter("NOT folder").select(path.alias("path"), "target", "relative", "length")
    return files if len(set(targets)) == 1 else files.dropDuplicates(["path"])


def _packed(target: str, rows) -> Iterator[pa.RecordBatch]:
    """Rows of a target as batches of bounded length."""
    flags, names, sizes = [], [], []
    for flag, name, size in rows:
        flags.append(flag)
        names.append(name)
        sizes.append(size)
        if len(names) == 4096:
            yield _batch(target, flags, names, sizes)
            flags, names, sizes = [], [], []
    if names:
        yield _batch(target, flags, names, sizes)


def _batch(target: str, flags: list, names: list, sizes: list) -> pa.RecordBatch:
    columns = [pa.array(flags, pa.bool_()), pa.array([target] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["folder", "target", "relative", "length"])


def read(files: DataFrame) -> DataFrame:
    """(path, length, content) of a :func:`listing`; files over the limit are listed, not read."""
    spark = files.sparkSession
    total = files.agg(F.sum(F.least("length", F.lit(MAX_BYTES)))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, Store] = {}
        for batch in batches:
            out, held = [], 0
            for path, target, relative, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store = stores.get(target) or stores.setdefault(target, Store(target))
                content = store.read(relative) if length <= MAX_BYTES else None
                if content is not None:
                    length = max(length, len(content)) if len(content) > MAX_BYTES else len(content)
                    content = content if length <= MAX_BYTES else None
                out.append((path, length, content))
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield _contents(out)
                    out, held = [], 0
            if out:
                yield _contents(out)

    return files.select("path", "target", "relative", "length").repartition(tasks, "path").mapInArrow(step, "path string, length long, content binary")


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    path, length, content = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(content, pa.binary())], ["path", "length", "content"])
