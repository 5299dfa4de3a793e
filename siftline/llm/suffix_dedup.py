"""Removal of repeated byte strings by distributed prefix doubling.

Two positions are equal up to the threshold when their first bytes are, and the
bytes at a growing offset are.  Each round ranks positions by a pair (rank so
far, rank further on); Spark sorts the pairs, windows over the sorted rows
rerank them, and positions whose rank is unique, or settled, leave.

To keep the rounds short, they start at 32 bytes and run over a synchronising
set: each string of ``length`` bytes names as its anchor the position of its
least hashed 32-byte string, so equal strings name equal anchors and an anchor
stands for the run of consecutive strings that name it (about 35 of them).

round 1  rank by the anchor's 32 bytes; anchors of unique rank leave
round 2  pairs with the bytes of all strings the anchor stands for: where the
         pair came earlier, every one of them is a repeat
round 3  pairs with the bytes up to an offset of half the rest, to the left and
         to the right: each string covers one of the two, so strings on a side
         that is unique leave
round 4  pairs of both halves of each string that is left: all but the first
         of a pair are repeats

Ranks are 64-bit hashes of content, so partner ranks are at hand without a
join, and what is removed rests on 128 bits.  A task sends on only the earliest
of the equal pairs that it has gathered and settles the others, and it sends one
row of each rank to the rank's own key; so a group of copies, or a passage in
any number of surroundings, meets in one task only as often as tasks have sent.
Sorts are Spark's own and spill.  Repeats never cross documents.

Defined results
    null or empty text   0 bytes; nothing is removed
    shorter than length  nothing is removed
    very long text       whole, in overlapping pieces of bounded memory
    repeated rows        rows of one doc_id and text are one document: they get equal
                         results and don't count as one another's repeats
    several texts of     each is a document of its own, in an order by their hashes; their
    one doc_id           rows are told apart by numbers made for them, which costs a shuffle
    ids of other types   numbered in their order, at the same cost
    null doc_id          left as it is, and nothing is a repeat of it
    empty table          empty result
    clashing columns     only id and text are read; :func:`dedup` passes the others through
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.shared import Scratch, fresh, materialise, slices, tidy, told_apart
from siftline.llm.shingle_join import node_filter, passing
from siftline.llm.wordarrays import Prefix, buffer_of, mix64
from siftline.session import ship

#: Bytes of the strings that are compared, and of the first round's.
LENGTH = 100
FIRST = 32
#: Bytes handled at once; a longer text is cut into overlapping pieces.
PIECE = 1 << 18
#: Anchors or strings that a task gathers before it sends them on, and rows of a batch that it sends.
FLUSH = 125_000
SENT_ROWS = 20_000
_PLACE = 23  # bits of a position in a piece


def pieces(column: pa.Array, ids: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, ids, base) of groups of texts; base is where each stands in its document."""
    data, offsets = buffer_of(column)
    begin = 0
    for i in range(len(ids)):
        if offsets[i + 1] - offsets[begin] > PIECE and i > begin:
            yield data[offsets[begin] : offsets[i]], offsets[begin : i + 1] - offsets[begin], ids[begin:i], np.zeros(i - begin, np.int64)
            begin = i
        if offsets[i + 1] - offsets[i] > PIECE:
            for a in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, PIECE):
                b = min(int(offsets[i + 1]), a + PIECE + length - 1)
                yield data[a:b], np.array([0, b - a]), ids[i : i + 1], np.array([a - int(offsets[i])])
            begin = i + 1
    if begin < len(ids):
        yield data[offsets[begin] :], offsets[begin:] - offsets[begin], ids[begin:], np.zeros(len(ids) - begin, np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, first: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: rank of its first bytes, rank of all it stands for, ranks up to both sides, first and last string, place before it, text."""
    none = *(np.zeros(0, np.uint64),) * 3, *(np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    prefix = Prefix(data)
    rank = prefix.all_of(first)
    least = rank >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(rank), dtype=np.uint64)
    width, span = length - first + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    inside = np.zeros(len(data), bool)  # strings that end in their text
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[a : max(a, b - length + 1)] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    anchor = (least[at] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    low, high, anchor = at[start], at[np.append(start[1:], len(at)) - 1], anchor[start]
    shape = ((anchor - low) << 32 | (high - low)).astype(np.uint64)
    around = mix64(prefix.ranges(low, high + length) + mix64(shape))
    half = (length - first) // 2
    left = prefix.ranges(np.maximum(anchor - half, 0), anchor + first) >> np.uint64(32)
    right = prefix.ranges(anchor, np.minimum(anchor + first + half, len(data))) >> np.uint64(32) << np.uint64(32)
    return rank[anchor], around, left | right, low, high, anchor - low, np.searchsorted(offsets, low, side="right") - 1


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents as maximal runs, in order."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    reach = np.zeros(len(doc), np.int64)
    group = runs(doc)
    top = int(last.max(initial=0)) + 1
    if len(doc):
        reach = np.maximum.accumulate(last + group * top) - group * top
    new = np.ones(len(doc), bool)
    new[1:] = (group[1:] != group[:-1]) | (first[1:] > reach[:-1])
    start = np.flatnonzero(new)
    return doc[start], first[start], reach[np.append(start[1:], len(doc))[: len(start)] - 1]


def runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row of sorted columns is in."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


#: Kinds of rows that are sent: a rank's one row, the same where the task has other pairs of the rank, those others, a settled range.
ALONE, OPEN, OTHER, SETTLED = range(4)
_SENT = "rank long, next long, sides long, doc_id long, low long, shape int, kind int"


class Sender:
    """Gathers rows (rank, next, sides, document, place, shape) and sends them on pre-aggregated.

    Of rows of one pair (rank, next) only the earliest goes on; the others are
    repeats, whose merged ranges go on as settled: (hash, end, 0, document, begin).
    """

    def __init__(self, length: int):
        self.length, self.parts, self.count = length, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.count += len(columns[0])
        if self.count > FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        rank, after, sides, doc, low, shape = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.count = [], 0
        order = np.lexsort((low, doc, after, rank))
        rank, after, sides, doc, low, shape = (c[order] for c in (rank, after, sides, doc, low, shape))
        pair = runs(rank, after)
        first = np.searchsorted(pair, pair)
        head = first == np.arange(len(pair))
        late = (doc != doc[first]) | (low != low[first])  # not a repeated row
        gone, begin, end = merged(doc[late], low[late], (low + (shape & 0xFFFF) + self.length)[late])
        of_rank = runs(rank[head])
        own = np.searchsorted(of_rank, of_rank) == np.arange(len(of_rank))
        several = np.bincount(of_rank)[of_rank] > 1
        kind = np.where(own, np.where(several, OPEN, ALONE), OTHER)
        columns = [
            np.concatenate([rank[head], mix64(gone.view(np.uint64))]).view(np.int64),
            np.concatenate([after[head].view(np.int64), end]),
            np.concatenate([sides[head], np.zeros(len(gone), np.uint64)]).view(np.int64),
            np.concatenate([doc[head], gone]),
            np.concatenate([low[head], begin]),
            np.concatenate([shape[head], np.zeros(len(gone), np.int64)]).astype(np.int32),
            np.concatenate([kind, np.full(len(gone), SETTLED)]).astype(np.int32),
        ]
        for a in range(0, len(columns[0]), SENT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + SENT_ROWS]) for c in columns], _SENT.replace(" long", "").replace(" int", "").split(", "))


_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def _earliest(rows: DataFrame) -> DataFrame:
    """``rows`` with ``gone``: settled, or not the earliest of its pair (rank, next)."""
    pair = Window.partitionBy("rank", "next", "settled").orderBy("doc_id", "low").rowsBetween(*_WHOLE)
    first = F.first(F.struct("doc_id", "low")).over(pair)
    return rows.withColumn("settled", F.col("kind") == SETTLED).withColumn("gone", F.col("settled") | (F.struct("doc_id", "low") != first))


class SuffixDedup:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, apart: bool = True):
        if length < 2 * FIRST or length > 255 + FIRST:
            raise ValueError("length must be 64 to 287 bytes")
        self.spark, self.length = ship(docs.sparkSession), length
        apart, name, self.names = told_apart(docs, id_col, text_col, True) if apart else (docs, id_col, None)
        self.rows = apart.select(F.col(f"`{name}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def _anchored(self) -> DataFrame:
        """Rows (rank, next, ...) of all anchors."""
        length = self.length

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sender = Sender(length)
            for batch in batches:
                for part in slices(batch, most=PIECE):
                    part = part.filter(pc.is_valid(part.column(0)))
                    for data, offsets, ids, base in pieces(part.column(1), part.column(0).to_numpy(), length):
                        rank, around, sides, low, high, before, text = anchors(data, offsets, length, FIRST)
                        yield from sender.add(rank, around, sides, ids[text], low - offsets[text] + base[text], before << 16 | (high - low))
            yield from sender.rest()

        return self.rows.mapInArrow(tidy(send), _SENT)

    def _paired(self) -> DataFrame:
        """Rounds 1 and 2: (doc_id, low, end, gone, rank, sides, before): ranges that are gone, and anchors that stay open."""
        # All of a rank's own rows are on its key; others of it are known to be open and go elsewhere.
        key = F.when(F.col("kind") == OTHER, F.xxhash64("rank", "next")).otherwise(F.col("rank"))
        same = Window.partitionBy("key").orderBy("next").rowsBetween(*_WHOLE)
        ranked = self._anchored().withColumn("key", key).select(
            "*",
            F.count(F.lit(1)).over(same).alias("n"),
            ((F.first("next").over(same) != F.last("next").over(same)) | F.max(F.col("kind").isin(OPEN, OTHER)).over(same)).alias("open"),
        )
        left = _earliest(ranked.filter((F.col("kind") == SETTLED) | (F.col("n") > 1) | F.col("open")).drop("key", "n"))
        end = F.when(F.col("kind") == SETTLED, F.col("next")).otherwise(F.col("low") + F.col("shape").bitwiseAND(0xFFFF) + self.length)
        return left.filter("gone OR open").select("doc_id", "low", end.alias("end"), "gone", "rank", "sides", F.shiftright("shape", 16).alias("before"))

    def _open(self, paired: DataFrame) -> DataFrame:
        """Round 3: (doc_id, first, last): strings, by their first bytes' places, of which the side they cover is no unique one."""
        half, high = (self.length - FIRST) // 2, F.col("end") - self.length
        cut = F.col("low") + F.col("before") - half  # strings up to here cover the left side, others the right one
        sides = F.array(
            F.struct(F.col("low").alias("first"), (F.least(high, cut) + 1).alias("last"), F.xxhash64("rank", F.shiftleft("sides", 32), F.lit(0)).alias("side")),
            F.struct(F.greatest(F.col("low"), cut + 1).alias("first"), (high + 1).alias("last"), F.xxhash64("rank", F.shiftright("sides", 32), F.lit(1)).alias("side")),
        )
        parts = paired.filter("NOT gone").select("doc_id", F.explode(sides).alias("s")).select("doc_id", "s.*").filter("first < last")
        # Written, so that a join may split a side that many rows have.
        again = materialise(parts.groupBy("side").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("side"), "sides")
        return parts.join(again, "side", "left_semi").select("doc_id", "first", "last")

    def _strings(self, opened: DataFrame) -> DataFrame:
        """Rows (rank, next, ...) of the open strings: their halves."""
        length = self.length
        bits = self.spark.sparkContext.broadcast(node_filter(opened.select("doc_id").distinct()))

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column(0)))
                yield batch.filter(pa.array(passing(bits.value, batch.column(0).to_numpy())))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sender = Sender(length)
            for batch in batches:
                for part in slices(batch, most=PIECE):
                    data, offsets = buffer_of(part.column(1))
                    ids = part.column(0).to_numpy()
                    for i, opened in enumerate(part.column(2)):
                        spans = opened.values
                        low = spans.field(0).to_numpy()
                        count = spans.field(1).to_numpy() - low
                        at = np.unique(np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum()))
                        for a in range(0, max(1, int(offsets[i + 1] - offsets[i])), PIECE):
                            own = at[np.searchsorted(at, a) : np.searchsorted(at, a + PIECE)] - a
                            if len(own):
                                prefix = Prefix(data[offsets[i] + a : min(offsets[i + 1], offsets[i] + a + PIECE + length)])
                                one, two = prefix.ranges(own, own + length // 2), prefix.ranges(own + length // 2, own + length)
                                none = np.zeros(len(own), np.int64)
                                yield from sender.add(one, two, none.view(np.uint64), np.full(len(own), ids[i]), own + a, none)
            yield from sender.rest()

        listed = opened.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("open"))
        texts = self.rows.mapInArrow(tidy(likely), self.rows.schema).join(listed, "doc_id")
        return texts.mapInArrow(tidy(send), _SENT)

    def ranges(self) -> DataFrame:
        """(doc_id, first, last): byte ranges that are repeats; they may overlap."""
        paired = materialise(self._paired(), "pairs")
        opened = materialise(self._open(paired), "open")
        whole = _earliest(self._strings(opened)).filter("gone")
        end = F.when(F.col("kind") == SETTLED, F.col("next")).otherwise(F.col("low") + self.length)
        gone = paired.filter("gone").select("doc_id", F.col("low").alias("first"), F.col("end").alias("last"))
        return gone.unionByName(whole.select("doc_id", F.col("low").alias("first"), end.alias("last")))

    def found(self) -> DataFrame:
        """:meth:`ranges`, written."""
        with Scratch(self.spark) as scratch:
            return scratch.keep(self.ranges())

    def kept(self) -> DataFrame:
        """(doc_id, n_bytes, n_removed, n_spans, kept): kept has the bytes that are left."""
        found = self.found().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
        joined = self.rows.join(found, "doc_id", "left")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield cut_out(part)

        return joined.mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

    def digests(self) -> DataFrame:
        """:meth:`kept` with the sha256 of the bytes left in their place, and the rows' own ids."""
        out = self.kept().withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
        if self.names is None:
            return out
        return out.join(self.names, F.col("doc_id") == F.col("name"), "left").select(F.col("key").alias("doc_id"), *out.columns[1:])


def cut_out(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = buffer_of(part.column(1))
    removed, spans, left = [], [], []
    for i, found in enumerate(part.column(2)):
        own = data[offsets[i] : offsets[i + 1]]
        if not found.is_valid or not len(own):
            removed.append(0)
            spans.append(0)
            left.append(own.tobytes())
            continue
        first, last = (np.minimum(found.values.field(k).to_numpy(), len(own)) for k in (0, 1))
        _, first, last = merged(np.zeros(len(first), np.int64), first, last)
        removed.append(int((last - first).sum()))
        spans.append(len(first))
        left.append(b"".join(own[a:b].tobytes() for a, b in zip([0, *last.tolist()], [*first.tolist(), len(own)])))
    n = np.diff(offsets)
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of their texts; a text that is all repeats leaves with its row.

    Bytes of a character of which a cut has taken a part go with it.
    """
    apart, name, _ = told_apart(docs, id_col, text_col, True)
    job = SuffixDedup(apart, name, text_col, length, apart=False)
    ident, spans, kept = (fresh(c, apart.columns) for c in ("__id", "__ranges", "__left"))
    found = job.found().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias(spans))
    names = docs.columns
    keyed = apart.withColumn(ident, F.col(f"`{name}`").cast("long")).join(found.withColumnRenamed("doc_id", ident), ident, "left")
    schema = T.StructType([*docs.schema.fields, T.StructField(kept, T.BooleanType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                ranges = part.column(part.schema.get_field_index(spans))
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                done = cut_out(pa.RecordBatch.from_arrays([columns[0], columns[names.index(text_col)], ranges], ["i", "t", "r"]))
                raw, gone = done.column(4).to_pylist(), done.column(2).to_pylist()
                old = part.column(at).to_pylist()
                columns[names.index(text_col)] = pa.array([x.decode("utf-8", "ignore") if g else o for x, g, o in zip(raw, gone, old)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([not g or bool(x) for x, g in zip(raw, gone)])], schema.fieldNames())

    return keyed.mapInArrow(tidy(cut), schema).filter(F.col(kept)).drop(kept)
