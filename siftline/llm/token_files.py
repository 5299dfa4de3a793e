"""Token-id files with keyed access through a minimal perfect hash.

Layout, all in one folder of the shared store:

``shard-00007.ids``    raw little-endian ids of consecutive documents; shards
                       follow one another in ascending key order
``index-00003.mph``    the keys of one hash bucket: header, displacements, then
                       one slot per key with fingerprint, shard, offset, length

A key is hashed to a bucket, its displacement gives the slot, and the stored
fingerprint tells an absent key (with error 2**-32).  A lookup costs one hash
and two array reads whatever the number of keys.  Files are written under a
temporary name and renamed, so a task that is run again replaces its own file.

Defined results
    null or empty text   only the end id
    very long text       whole; ids are written in one run
    repeated keys        each row gets its own entry, as the key's next occurrence,
                         rows of one key in order of their texts
    null key             its own key, before all others
    empty table          no shards and an empty result
    clashing columns     only key and text are read; other columns don't matter
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import materialise, new_path, slices, store, tidy
from siftline.llm.units import UNIT_SLICE, ByteBpe, coder

#: Keys of one index bucket on average.
BUCKET_KEYS = 16_384
_MAGIC = b"SLMPH2\0\0"
_HEADER = struct.Struct("<8sQQQ")  # magic, keys, groups, seed
_SLOT = np.dtype([("finger", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
_MASK = (1 << 64) - 1


def write_whole(uri: str, name: str, chunks) -> None:
    """Writes a file under a temporary name, then puts it in place."""
    where, path = store(uri)
    where.create_dir(path, recursive=True)
    context = TaskContext.get()
    temporary = f"{path}/.{name}.{context.taskAttemptId() if context else 0}"
    with where.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    where.move(temporary, f"{path}/{name}")


def mix(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit mix of hashes and seeds."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: displacements of groups, and the slot of each of the distinct hashes.

    A displacement >= 0 is a seed; one below is the slot itself of a group with
    a single key, as -slot - 1.
    """
    n = len(hashes)
    groups = max(1, (n + 3) // 4)
    group = (mix(hashes, 1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    sizes = np.diff(bounds)
    displacement = np.zeros(groups, np.int64)
    slot = np.full(n, -1, np.int64)
    taken = np.zeros(n, bool)
    for g in np.argsort(-sizes, kind="stable").tolist():
        keys = order[bounds[g] : bounds[g + 1]]
        if len(keys) < 2:
            break
        h, seed = hashes[keys], 2
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            at = (mix(h[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            ordered = np.sort(at, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            hit = np.flatnonzero(good)
            if len(hit):
                displacement[g] = seed + int(hit[0])
                slot[keys] = at[hit[0]]
                taken[at[hit[0]]] = True
                break
            seed += 64
    singles = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    displacement[singles] = -free - 1
    slot[order[bounds[singles]]] = free
    return displacement, slot


def slots_of(hashes: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """The slot that each hash leads to; keys that the index lacks lead to some slot, too."""
    group = (mix(hashes, 1) % np.uint64(len(displacement))).astype(np.int64)
    d = displacement[group]
    by_seed = (mix(hashes, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -d - 1, by_seed)


def _finger(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 0) >> np.uint64(32)).astype(np.uint32)


def seeded(hashes: np.ndarray, others: np.ndarray, seed: int) -> np.ndarray:
    """What an index hashes: ``hashes`` themselves, or with a seed, sums with independent hashes that set clashing ones apart."""
    with np.errstate(over="ignore"):
        return hashes + others * np.uint64(seed)


def distinct_hashes(hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, int]:
    """(distinct hashes, the least seed that gives them); two keys of which both hashes are equal are an error."""
    for seed in range(8):
        out = seeded(hashes, others, seed)
        if len(np.unique(out)) == len(out):
            return out, seed
    raise ValueError("two keys have the same 128 bits of hashes")


def pack_index(hashes: np.ndarray, seed: int, displacement: np.ndarray, slot: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> list[bytes]:
    slots = np.zeros(len(hashes), _SLOT)
    for name, values in (("finger", _finger(hashes)), ("shard", shard), ("offset", offset), ("length", length)):
        slots[name][slot] = values
    return [_HEADER.pack(_MAGIC, len(hashes), len(displacement), seed), displacement.astype("<i8").tobytes(), slots.tobytes()]


def unpack_index(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slots) of an index file."""
    magic, n, groups, seed = _HEADER.unpack_from(raw)
    if magic != _MAGIC:
        raise ValueError("not an index file")
    return seed, np.frombuffer(raw, "<i8", groups, _HEADER.size), np.frombuffer(raw, _SLOT, n, _HEADER.size + 8 * groups)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each bucket of a partition that holds whole buckets in order."""
    kept, now = [], None
    for batch in batches:
        buckets = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if kept and buckets[a] != now:
                yield now, pa.Table.from_batches(kept)
                kept = []
            now = int(buckets[a])
            kept.append(batch.slice(a, b - a))
    if kept:
        yield now, pa.Table.from_batches(kept)


class TokenFiles:
    """A folder of shards and its index; :func:`write` makes one."""

    def __init__(self, uri: str, entries: DataFrame, buckets: int, dtype: str):
        self.uri, self.entries, self.buckets, self.dtype = uri, entries, buckets, dtype

    def locate(self, keys: DataFrame) -> DataFrame:
        """Looks keys (columns key, occurrence) up in the index: key, occurrence, shard, offset, n_tokens.

        Keys that the index lacks have no row.
        """
        uri = self.uri

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, path = store(uri)
            for bucket, rows in _by_bucket(batches):
                with where.open_input_stream(f"{path}/index-{bucket:05d}.mph") as f:
                    raw = f.read()
                seed, displacement, slots = unpack_index(raw)
                hashes = seeded(rows["hash"].to_numpy().view(np.uint64), rows["other"].to_numpy().view(np.uint64), seed)
                found = slots[slots_of(hashes, displacement, len(slots))]
                ok = pa.array(found["finger"] == _finger(hashes))
                table = pa.table(
                    {
                        "key": rows["key"],
                        "occurrence": rows["occurrence"],
                        "shard": pa.array(found["shard"].astype(np.int64)),
                        "offset": pa.array(found["offset"].astype(np.int64)),
                        "n_tokens": pa.array(found["length"].astype(np.int64)),
                    }
                )
                yield from table.filter(ok).to_batches()

        return self._bucketed(keys).mapInArrow(tidy(run), "key long, occurrence long, shard long, offset long, n_tokens long")

    def _bucketed(self, keys: DataFrame, *more: str) -> DataFrame:
        return _bucketed(keys, self.buckets, *more)

    def read(self, keys: DataFrame) -> DataFrame:
        """Rows of :meth:`locate` with ``ids``, the packed ids read from the shard."""
        uri, width = self.uri, np.dtype(self.dtype).itemsize
        located = self.locate(keys).repartition("shard").sortWithinPartitions("shard", "offset")
        schema = "key long, occurrence long, shard long, offset long, n_tokens long, ids binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, path = store(uri)
            now, f = None, None
            for batch in batches:
                ids, size, begin = [], 0, 0
                for i, (shard, offset, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                    if shard != now:
                        now, f = shard, where.open_input_file(f"{path}/shard-{shard:05d}.ids")
                    f.seek(offset * width)
                    ids.append(f.read(n * width))
                    size += n * width
                    if size > 16 << 20:
                        yield _with(batch.slice(begin, i + 1 - begin), "ids", ids)
                        ids, size, begin = [], 0, i + 1
                if ids:
                    yield _with(batch.slice(begin), "ids", ids)

        return located.mapInArrow(tidy(run), schema)

    def starts(self) -> DataFrame:
        """For each shard, the number of ids in the shards before it.  One row a shard."""
        totals = sorted((r.shard, r.n) for r in self.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
        rows, total = [], 0
        for shard, n in totals:
            rows.append((shard, total))
            total += n
        return self.entries.sparkSession.createDataFrame(rows, "shard long, before long")


def _with(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], [*batch.schema.names, name])


def _bucketed(keys: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Keys with hash and bucket; a partition holds whole buckets, in order."""
    other = F.xxhash64("occurrence", "key", F.lit("other")).alias("other")
    hashed = keys.select("key", "occurrence", *more, F.xxhash64("key", "occurrence").alias("hash"), other)
    hashed = hashed.withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(buckets)).cast("long"))
    return hashed.repartition("bucket").sortWithinPartitions("bucket")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, key_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes whole texts, each followed by ``end_id``, into shards in ascending key order, and indexes them."""
    spark = docs.sparkSession
    uri = new_path(spark, "tokens")
    rows = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    dtype = coder(ByteBpe, tokenizer_path).dtype.str

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(ByteBpe, tokenizer_path)
        end, shard, done, out = np.array([end_id], tokens.dtype).tobytes(), TaskContext.get().partitionId(), 0, []

        def chunks():
            nonlocal done
            last, nth = object(), 0
            for batch in batches:
                for part in slices(batch, most=UNIT_SLICE):
                    packed = tokens.encode(pc.fill_null(part.column(1), ""), end)
                    n = np.array([len(p) for p in packed], np.int64) // tokens.dtype.itemsize
                    keys, seen = part.column(0).to_pylist(), []
                    for k in keys:
                        nth = nth + 1 if k == last else 0
                        last = k
                        seen.append(nth)
                    offsets = done + np.cumsum(n) - n
                    out.append((keys, seen, offsets, n))
                    done += int(n.sum())
                    yield b"".join(packed)

        write_whole(uri, f"shard-{shard:05d}.ids", chunks())
        for keys, seen, offsets, n in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(keys), shard)), pa.array(offsets), pa.array(n)],
                ["key", "occurrence", "shard", "offset", "n_tokens"],
            )

    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    entries = materialise(ordered.mapInArrow(tidy(encode), "key long, occurrence long, shard long, offset long, n_tokens long"), "entries")
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _by_bucket(batches):
            hashes, seed = distinct_hashes(table["hash"].to_numpy().view(np.uint64), table["other"].to_numpy().view(np.uint64))
            displacement, slot = build_index(hashes)
            places = [table[c].to_numpy() for c in ("shard", "offset", "n_tokens")]
            write_whole(uri, f"index-{bucket:05d}.mph", pack_index(hashes, seed, displacement, slot, *places))
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([len(hashes)])], ["bucket", "keys"])

    keys = _bucketed(entries, buckets, "shard", "offset", "n_tokens")
    keys.mapInArrow(tidy(index), "bucket long, keys long").agg(F.sum("keys")).collect()
    return TokenFiles(uri, entries, buckets, dtype)


def digest(ids: DataFrame, dtype: str) -> DataFrame:
    """``ids`` with the unsigned crc32 of each row's ids as 32-bit integers in place of them."""
    fields = [f for f in ids.schema.fields if f.name != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), dtype).astype("<u4")) for x in batch.column(at)]
            rest = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(crc, pa.int64())], [*(f.name for f in fields), "ids_crc32"])

    return ids.mapInArrow(tidy(run), schema)
