"""Audit of how filters interact: what each removes, wherever it stands in the order.

Whether a row fails each filter is one number of a bit a filter.  A table made
beforehand holds, for each such number and each order of the filters, the step
at which the row leaves (32 numbers by 120 orders for five filters), so a task
looks rows up, counts them by part, order, step and label, and hands on partial
arrays, which are summed.  All other figures follow from the removals.

Defined results
    null or empty text   no words, no characters: fails A only (and E, if an earlier text is empty too)
    very long text       whole text; words are cut in pieces of 1 MB
    repeated rows, ties  rows are counted one by one; E asks for a smaller id, so rows that share
                         an id and a text don't make each other fail
    null id              fails no E and makes none fail; has no label
    null part            the part of the empty string
    repeated labels      a row has a label if any row of its id has it; null labels count as 0
    empty table          empty result; a part without removals has zeros
    clashing columns     only the named columns are read
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftline.llm.shared import Scratch, materialise, slices, tidy
from siftline.session import ship

#: Filters by letter; a row that fails the k-th has bit k of its number.
FILTERS = "ABCDE"
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Rows looked up at once, and parts whose arrays a task holds at once.
ROWS, PARTS = 1024, 1024

_SPACE = re.compile(rb"[ \t-\r]")
_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """Bounds of the filters on one text: A words, B share of distinct words, C share of capitals, D symbols."""

    words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    symbols: bytes = b"#$%&*|"


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words) of UTF-8 text; words are runs of anything but ASCII white space."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.start() if space else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failed(text: bytes, limits: Limits) -> int:
    """The bits of the filters A to D that a text fails."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _FOLLOWING))
    symbols = len(text.translate(None, limits.symbols)) < len(text)
    return (
        (words < limits.words)
        | (100 * distinct < limits.distinct_percent * words) << 1
        | (100 * capitals > limits.capital_percent * points) << 2
        | symbols << 3
    )


def first_failures(n: int = len(FILTERS)) -> np.ndarray:
    """By number of failed filters and order: the step (from 0) at which a row leaves; n for one that stays."""
    orders = np.array(list(permutations(range(n))))
    fails = np.arange(1 << n)[:, None, None] >> orders[None] & 1
    return np.where(fails.any(2), fails.argmax(2), n)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(key, part, digest, fails) of each row: its id, the digest of its text and the bits of A to D; a pass over the texts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("digest", T.BinaryType()), T.StructField("fails", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column(2), "").cast(pa.binary()).to_pylist()
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], digests, pa.array([failed(t, limits) for t in texts], pa.int32())], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def with_repeats(judged: DataFrame, bit: int = 4) -> DataFrame:
    """(key, part, fails, n): rows in equal groups, with the bit of filter E where a smaller id has the same text.

    Texts meet their least id by digest and id together, so a text that holds a large share of all rows is no hot key.
    """
    counted = judged.filter("key IS NOT NULL").groupBy("key", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    least = judged.groupBy("digest").agg(F.min("key").alias("key")).select("digest", "key", F.lit(0).alias("again"))
    known = counted.join(least, ["digest", "key"], "left").select("key", "part", (F.col("fails") + F.coalesce("again", F.lit(1 << bit))).alias("fails"), "n")
    nameless = judged.filter("key IS NULL").groupBy("key", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(nameless)


def removals(rows: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """(part, cell, removed, good_lost, toxic_lost) of (part, fails, n, good, toxic); cell is order * (n + 1) + step.

    The step after the last holds what stays.
    """
    table = first_failures(n)
    cells = table.shape[1] * (n + 1)
    places = table + np.arange(table.shape[1]) * (n + 1)

    def counts(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        """Arrays of a batch by its parts: removals of all rows, good ones and toxic ones."""
        part = batch.column(0).dictionary_encode()
        fails, weight, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
        at = part.indices.to_numpy()[:, None] * cells + places[fails]
        own = [np.bincount(at.ravel(), np.repeat(w, at.shape[1]), len(part.dictionary) * cells) for w in (weight, weight * good, weight * toxic)]
        return part.dictionary.to_pylist(), np.stack(own, 1).reshape(len(part.dictionary), cells, 3).astype(np.int64)

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, a in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * cells), pa.array(np.arange(cells, dtype=np.int32)), *map(pa.array, a.T.copy())], ["part", "cell", "removed", "good_lost", "toxic_lost"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                for part, a in zip(*counts(batch.slice(begin, ROWS)), strict=True):
                    held[part] = held[part] + a if part in held else a
                if len(held) > PARTS:
                    yield from flush(held)
        yield from flush(held)

    partial = rows.select("part", "fails", "n", "good", "toxic").mapInArrow(tidy(run), "part string, cell int, removed long, good_lost long, toxic_lost long")
    return partial.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")])


def figures(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report: a row for each part, order and step, with what follows from the removals.

    What a filter removes when it stands first is all that fails it; when it stands last, what fails nothing else.
    """
    n = len(filters)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    named = sums.withColumns({"filter_order": F.element_at(orders, F.expr(f"cell DIV {n + 1} + 1").cast("int")), "step": (F.col("cell") % (n + 1) + 1).cast("int")})
    lettered = named.withColumn("letter", F.substr("filter_order", "step", F.lit(1)))
    whole, row, own = Window.partitionBy("part"), Window.partitionBy("part", "filter_order").orderBy("step"), Window.partitionBy("part", "letter")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(own)
    seen = lettered.withColumn("total", F.sum(F.when(F.col("cell") <= n, F.col("removed"))).over(whole))
    told = seen.withColumns({"kept": F.col("total") - F.sum("removed").over(row), "redundant": at(1) - F.col("removed"), "unique_fails": at(n), "shapley": F.sum("removed").over(own)})
    return told.filter(F.col("step") <= n).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The report on the filters A to E over ``docs``; ``labels`` has the ids, and quality and toxic as 0 or 1."""
    with Scratch(docs.sparkSession) as block:
        judged = materialise(failures(docs, id_col, text_col, part_col, limits), "audit")
        flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
        marks = labels.groupBy(F.col(f"`{id_col}`").alias("key")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).filter("key IS NOT NULL AND good + toxic > 0")
        rows = with_repeats(judged)
        nameless = rows.filter("key IS NULL").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
        labelled = rows.filter("key IS NOT NULL").join(marks, "key", "left").unionByName(nameless).fillna(0, ["good", "toxic"])
        return block.keep(figures(removals(labelled)))
