"""Mixing sources to target weights by blocks of words.

The words of a source, document after document, are packed into blocks of one
length.  A source's target says how many blocks the mix takes of it; a draw
deals these over the output shards.  The slots that a source has in the shards
are numbered, and a pseudorandom permutation of the source's block indices, a
new one for each pass, says which block each slot takes; so no block is taken
a second time before all of its source have been taken once.  Slots and blocks
are joined by index.

Counts of shards are multinomial draws of each source over the shards, not of
each shard over the sources: given the sources' totals they are spread alike,
but each source ends at its target, none is taken more often than allowed, and
no task needs the table of all sources.  The last block that a source gives is
cut where its target ends.

Defined results
    null or empty text   no words: size and taken are 0
    very long text       whole text, over as many blocks as it fills
    repeated rows, ties  each row stands for itself; rows of equal id and text may change places,
                         which no result shows
    null id              a row as any other
    null source          a source of its own, the last one
    empty table          empty result; without any words all targets are 0
    clashing columns     only the named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftline.llm.shared import materialise, numbered, slices, tidy
from siftline.session import ship

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and blocks of an output shard on average.
BLOCK, SHARD = 1024, 4096
#: Slots that a task fills, about.
SLOTS = 1 << 20
#: Weights of the sources in turn, words of the mix in percent of all, passes over a source at most.
WEIGHTS, PERCENT, PASSES = (5, 2, 1), 150, 2
SEED = 12


# The permutation: a Feistel network over the least even number of bits, walked until it lands inside.


def _round(x: np.ndarray, key: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)


def permuted(at: np.ndarray, n: int, key: np.ndarray | int, inverse: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) takes each of ``at``; ``key`` (one, or one for each) names it."""
    out = np.asarray(at).astype(np.uint64)
    keys = np.broadcast_to(np.asarray(key).astype(np.uint64), out.shape)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        left, right, k = out[todo] >> half, out[todo] & mask, keys[todo]
        for i in range(4):
            if inverse:
                left, right = right ^ (_round(left, k, 3 - i) & mask), left
            else:
                left, right = right, left ^ (_round(right, k, i) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def pass_key(source: np.ndarray | int, turn: np.ndarray | int, seed: int = SEED) -> np.ndarray:
    """The key of a source's permutation in one pass."""
    return (np.asarray(source, np.int64) * 1_000_003 + np.asarray(turn, np.int64) * 7919 + seed).astype(np.uint64)


def slots_for(target: int, size: int, block: int, source: int, seed: int = SEED) -> tuple[int, int]:
    """(slots, words of the last one) that give a source of ``size`` words ``target`` of them."""
    n = -(-size // block)
    short = size - (n - 1) * block
    turn, rest = divmod(target, size)
    if not rest:
        return turn * n, 0
    slots = -(-rest // block)
    at = int(permuted(np.array([n - 1]), n, pass_key(source, turn, seed), inverse=True)[0])
    if at < slots:  # the short block is among them
        slots = max(at + 1, -(-(rest + block - short) // block))
    words = lambda k: k * block - (block - short) * (at < k)
    return turn * n + slots, rest - words(slots - 1)


# Sources and their targets.


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, source, tie, size): the words of each text, and a hash of it that orders rows of one id; a pass over the texts."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(text).alias("tie"), text.alias("text"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = pc.count_substring_regex(pc.fill_null(part.column(3), ""), WORD).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], n], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, passes: int = PASSES) -> DataFrame:
    """``sources`` (source, source_size) with idx, their number by code point, and target: shares by weight, none over ``passes`` times its size.

    Rounds stop sources that are above and reshare what is left by weight, until none is; each is one aggregate of the table of sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    known = materialise(numbered(sources, "source").withColumns({"weight": weight, "most": (F.col("source_size") * passes).cast("double")}), "sources")
    total = (known.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    unit, stopped = 0.0, -1
    while True:
        above = F.col("most") < F.col("weight") * unit
        n, taken, left = known.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == stopped or not left:
            break
        stopped, unit = n, (total - taken) / left
    return known.withColumn("target", F.least("most", F.col("weight") * unit)).drop("weight", "most")


# Blocks, slots and what is taken.


class Mix:
    """The mix of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED):
        self.block, self.shard, self.seed = block, shard, seed
        self.id_col, self.text_col, self.docs = id_col, text_col, docs
        rows = materialise(sizes(docs, id_col, text_col, source_col), "sizes")
        # Documents lie in buckets and buckets in sources, about as many of one as of the other, so that no window holds a whole source's rows.
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "tie"), F.lit(isqrt(rows.count()) + 1)))
        sums = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
        self.sources = materialise(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
        #: (key, tie, size, idx, source_size, target, start): each document, and where it begins in the row of its source's words.
        self.placed = materialise(self._placed(rows, sums), "placed")

    def _placed(self, rows: DataFrame, sums: DataFrame) -> DataFrame:
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        begun = sums.withColumn("before", F.coalesce(before, F.lit(0))).withColumnRenamed("source", "s")
        begun = begun.join(self.sources, F.col("s").eqNullSafe(F.col("source"))).select("s", F.col("bucket").alias("b"), "before", "idx", "source_size", "target")
        joined = rows.join(begun, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        earlier = F.sum("size").over(Window.partitionBy("s", "b").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1))
        return joined.select("key", "tie", "size", "idx", "source_size", "target", (F.col("before") + F.coalesce(earlier, F.lit(0))).alias("start"))

    def pieces(self) -> DataFrame:
        """What documents have in each block: ``placed`` with block, at (words of the block before it), first (word of the document) and words."""
        end = F.col("start") + F.col("size")
        cut = self.placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start DIV {self.block}"), F.expr(f"(start + size - 1) DIV {self.block}"))))
        begin = F.greatest(F.col("start"), F.col("block") * self.block)
        return cut.withColumns({"at": begin - F.col("block") * self.block, "first": begin - F.col("start"), "words": F.least(end, (F.col("block") + 1) * self.block) - begin})

    def slots(self) -> DataFrame:
        """(idx, block, turn, shard, place, words): the slots of the mix; ``words`` are the first so many of the block."""
        block, shard, seed = self.block, self.shard, self.seed
        asked = self.sources.filter("source_size > 0").select("idx", "source_size", F.round("target").cast("long").alias("target"))
        total = asked.agg(F.sum("target")).first()[0] or 0
        shards = max(1, -(-total // (block * shard)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, size, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n, last = slots_for(target, size, block, source, seed)
                    rng = np.random.default_rng([seed, source])
                    if n < shards:
                        where, count = np.unique(rng.integers(0, shards, n), return_counts=True)
                    else:
                        count = rng.multinomial(n, np.full(shards, 1 / shards))
                        where = np.flatnonzero(count)
                        count = count[where]
                    one = np.ones(len(where), np.int64)
                    columns = (one * source, where, np.cumsum(count) - count, count, one * size, one * n, one * last)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["idx", "shard", "first", "count", "size", "slots", "last"])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, where, first, count, size, slots, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n, k = -(-size // block), first + np.arange(count)
                    turn = k // n
                    at = permuted(k % n, n, pass_key(source, turn, seed))
                    words = np.where(at == n - 1, size - (n - 1) * block, block)
                    words[(k == slots - 1) & (last > 0)] = last
                    place = permuted(k, slots, pass_key(source, 99, seed))
                    columns = (np.full(count, source), at, turn, np.full(count, where), place, words)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["idx", "block", "turn", "shard", "place", "words"])

        dealt = asked.mapInArrow(tidy(deal), "idx long, shard long, first long, count long, size long, slots long, last long")
        # By number, which Spark doesn't merge: rows are few and small, but each fills a part of a shard.
        tasks = max(self.docs.sparkSession.sparkContext.defaultParallelism, -(-total // (block * SLOTS)))
        return dealt.repartition(tasks, "idx", "shard").mapInArrow(tidy(fill), "idx long, block long, turn long, shard long, place long, words long")

    def spans(self) -> DataFrame:
        """(shard, place, idx, block, turn, key, tie, start, at, first, words): the documents' words in each slot of the mix."""
        pieces = self.pieces().select("key", "tie", "start", "idx", "block", "at", "first", F.col("words").alias("own"))
        joined = self.slots().join(pieces, ["idx", "block"])
        cut = joined.withColumn("words", F.least("own", F.greatest(F.col("words") - F.col("at"), F.lit(0)))).drop("own")
        return cut.filter("words > 0")

    def taken(self) -> DataFrame:
        """(key, size, source_size, target, taken) of each document: how many words the mix takes of it, repeats counted."""
        asked = self.slots().groupBy("idx", "block").agg(F.collect_list("words").alias("slots"))
        joined = self.pieces().join(asked, ["idx", "block"], "left")
        own = F.aggregate("slots", F.lit(0).cast("long"), lambda n, words: n + F.least("words", F.greatest(words - F.col("at"), F.lit(0))))
        some = joined.groupBy("idx", "start", "key", "size", "source_size", "target").agg(F.sum(F.coalesce(own, F.lit(0))).alias("taken"))
        none = self.placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return some.select("key", "size", "source_size", "target", "taken").unionByName(none.select("key", "size", "source_size", "target", "taken"))

    def texts(self) -> DataFrame:
        """(shard, place, source, text): the mix itself; words of a slot are joined by a space."""
        text = self.docs.select(F.col(f"`{self.id_col}`").alias("key"), F.xxhash64(F.col(f"`{self.text_col}`")).alias("tie"), F.col(f"`{self.text_col}`").alias("text")).dropDuplicates(["key", "tie"])
        spans = self.spans().withColumnsRenamed({"key": "k", "tie": "t"})
        words = spans.join(text, F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")))
        own = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
        parts = words.select("shard", "place", "idx", "at", own.alias("text"))
        filled = parts.groupBy("shard", "place", "idx").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
        named = filled.join(self.sources.select("idx", "source"), "idx")
        return named.select("shard", "place", "source", F.array_join("parts.text", " ").alias("text"))
