"""Places that driver and executors share, and the batches that operators work on."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.session import Scratch, drop_path, new_path, written

__all__ = ["Scratch", "drop_path", "new_path"]

#: Bytes of text handled at once inside a task; bounds the memory of array work.
SLICE_BYTES = 2 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and lost executors lose nothing."""
    return written(df, name)


#: Bytes of text after which a worker gives free memory back; more often costs page faults.
RELEASE_BYTES = 8 << 20
_unreleased = 0

try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc has it; elsewhere nothing is done
except (OSError, AttributeError):
    _TRIM = None


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES, release_bytes: int = RELEASE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    yield batch.slice(begin)
    global _unreleased
    _unreleased += int(sizes.sum())
    if _unreleased > release_bytes:
        _unreleased = 0
        release()


#: What a worker process keeps from task to task: the operator (a module) last using it, and how to let it go.
_held: dict[object, tuple[str, Callable[[], None]]] = {}
_operator = ""


def hold(key: object, let_go: Callable[[], None]) -> None:
    """Notes that the operator now running uses something that this process keeps between tasks."""
    _held[key] = (_operator, let_go)


def enter(operator: str) -> None:
    """Begins a task of an operator; what others kept in this process goes."""
    global _operator
    _operator = operator
    for key in [k for k, (owner, _) in _held.items() if owner != operator]:
        _held.pop(key)[1]()


def tidy(step: Callable) -> Callable:
    """A step over Arrow batches that leaves its worker process small when it ends.

    What steps of the same operator keep stays for its next task; what another operator kept goes.
    """
    operator = step.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(operator)
        yield from step(batches)
        release()

    return run


def release() -> None:
    """Gives memory that is free inside this process back, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def store(uri: str):
    """(file system, path) of a folder that every executor sees; any scheme pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bytes of keys that may be broadcast.
BROADCAST_BYTES = 8 << 20


def without(docs: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows of the keys; a few keys, once measured, go to the texts rather than the texts to them."""
    n, size = keys.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(f"`{id_col}`").cast("string")))).first()
    if not n:
        return docs
    small = F.broadcast(keys) if 8 * n + (size or 0) <= BROADCAST_BYTES else keys
    return docs.join(small, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their number from 0 in the order of some columns, null last; ranges are numbered on their own and then moved up."""
    by = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(ranges, *by).withColumn("__range", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(*by)))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # as many rows as ranges
    before = counts.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(before, "__range").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__own") - 1).alias("idx"))


def told_apart(docs: DataFrame, id_col: str, text_col: str, whole_numbers: bool = False) -> tuple[DataFrame, str, DataFrame | None]:
    """``docs``, the column that names a row's text, and the ids (key, name) of the names where they are new.

    The id names the text unless rows of one id have several texts, or, where ``whole_numbers`` are asked for, the id is none.
    Then each text of an id gets a number, in the order of ids; a null id keeps none.
    """
    key, digest = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    fits = not whole_numbers or isinstance(docs.schema[id_col].dataType, T.IntegralType)
    known = docs.filter(key.isNotNull())
    if fits and known.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs, id_col, None
    texts = materialise(known.select(key.alias("key"), digest.alias("digest")).distinct(), "texts")
    if fits and texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs, id_col, None
    k, d, name = (fresh(c, docs.columns) for c in ("__key", "__digest", "__name"))
    names = materialise(numbered(texts, "key", "digest"), "names")
    found = names.select(F.col("key").alias(k), F.col("digest").alias(d), F.col("idx").alias(name))
    own = fresh("__own", docs.columns)
    out = docs.withColumn(own, digest).join(found, (key == F.col(k)) & (F.col(own) == F.col(d)), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name), name, names.select("key", F.col("idx").alias("name"))
