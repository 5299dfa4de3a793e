"""N-gram Jaccard join as a blocked sparse matrix product.

The documents' incidence over word n-grams is a sparse matrix; the join asks
for the pairs of rows whose product (overlap) is large for their sizes.

1. Rows with equal sets are one node, known by a hash of the set.
2. Size bounds discard columns first: a pair that meets the threshold shares at
   least num/den of each row, so it shares a column among the first few of both
   in any order of the columns.  Columns are ordered by how often they occur, in
   a table of counts of fixed size over all rows, rare ones first; so rows meet
   on a column of those first ones, and passages that many texts hold make few
   meet.  The order only costs time: whatever the counts, no link is lost.
3. A row's columns are also folded into a bitmap of parities.  Bitmaps differ in
   no more bits than rows do in columns, which bounds the overlap from above and
   discards nearly all pairs that meet by chance, at an eightieth of the bytes.
4. Of nodes that meet on a column each is multiplied with the least one, where
   sizes and bitmaps allow a link (a star, so the work is in proportion to the
   nodes).  Links give components.
5. Columns on which several components still meet are searched for pairs of
   different components that sizes and bitmaps allow; these join nodes to clusters.
   Columns of one least node are searched as one set where that makes fewer pairs.
6. A cluster is cut into tiles of bounded rows and n-grams of one size class;
   tiles of classes too far apart are never paired, nor are classes that all
   lie in one component, nor tiles of the cluster's largest one.  A task multiplies two tiles, adds overlaps up over
   blocks of columns, discards pairs below their size bound, and returns only
   links that join components.

Steps 5 and 6 deal rows alike: a group (a column, a cluster) that is too large for
one task is cut into tiles, and a task gets two of them.

Components need no more.  :meth:`ShingleJoin.pairs` multiplies all columns' nodes
in tiles instead and gives every link; its rows and work grow with the links and
with the square of clusters.

For components no pair list is ever made from a group, and every pair that could link is
either multiplied or already in one component.  N-grams are 64-bit hashes; nodes
are told apart by 128 bits.

Defined results
    null, empty or blank text  an empty set: linked with nothing, itself its component
    fewer words than n         the whole sequence is the one n-gram
    very long text             whole
    repeated rows, ties        equal sets are linked; the least doc_id names a component
    null doc_id                takes part; a component of such rows only has none
    empty table                empty result
    clashing columns           only id and text are read
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.components import components, forest
from siftline.llm.shared import Scratch, materialise, slices, tidy, told_apart, without
from siftline.llm.wordarrays import NOT_SPACE, Words, mix64
from siftline.session import ship

#: Bytes of text turned into n-grams at once.
SLICE = 1 << 19
#: Rows, and n-grams, of a tile of the product at most; those of a small cluster are smaller, so that it makes many.
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1 << 20
#: Tiles that a cluster is cut into where they don't get smaller than these rows and n-grams.
TILES, LEAST_ROWS, LEAST_GRAMS = 24, 128, 1 << 15
#: Columns that are multiplied at once, and pairs of entries of rare columns.
BLOCK_COLUMNS = 4096
_ENTRIES = 1 << 20
#: Entries that a task gathers before it sends them on, and rows of a batch that it sends.
FLUSH = 400_000
SENT_ROWS = 20_000
#: Cells of the table of column counts, 4 bytes each, and cells that travel together.
CELLS, SEGMENT = 1 << 21, 1 << 16
#: Sets that may share 64 bits of their hash with another (none, below billions of sets).
MOST_CLASHES = 100_000
#: Most bits of the filter of nodes that met; 8 MB whatever the input.
FILTER_BITS = 1 << 26
_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def incidence(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns of each text's row, in order; bounds of the rows): the distinct n-gram hashes of the texts."""
    words = Words(column, NOT_SPACE)
    h, size = words.hash, np.diff(words.bounds)
    every = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        every = mix64(every + h[k : k + len(every)] * np.uint64(2 * k + 1))
    text = np.repeat(np.arange(len(size)), size)
    inside = np.flatnonzero(text[: len(every)] == text[n - 1 :]) if len(every) else np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    count = np.where(size >= n, size - n + 1, size > 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    grams = np.empty(int(bounds[-1]), np.uint64)
    long = np.repeat(size >= n, count)
    grams[long] = every[inside]
    whole = []
    for t in short.tolist():  # the sequence as one
        total = np.array([size[t]], np.uint64)
        for k in range(int(words.bounds[t]), int(words.bounds[t + 1])):
            total = mix64(h[k : k + 1] + total * np.uint64(0x9E3779B97F4A7C15))
        whole.append(total[0])
    grams[~long] = whole
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[bounds[:-1][count > 0]] = True
    return grams[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def fingerprints(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit hashes of each row's set."""
    out = []
    for salt, odd in ((0xA5A5A5A5A5A5A5A5, 1), (0x3C6EF372FE94F82B, 0x9E3779B97F4A7C15)):
        sums = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix64((grams ^ np.uint64(salt)) * np.uint64(odd)), out=sums[1:])
        out.append(mix64(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(odd)).view(np.int64))
    return out[0], out[1]


def first_columns(grams: np.ndarray, bounds: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, row of each): the first of each row, of which two rows that link share one.

    A row shares at least ceil(num / den * size) columns with any it links to, so it is enough to leave out one less.
    Rows too small to link with a different one have none.
    """
    size = np.diff(bounds)
    first = np.where(size * (den - num) >= num, size - (num * size + den - 1) // den + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    often = np.minimum(counts[(grams & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.int64), (1 << 40) - 1)
    order = np.argsort(row << 40 | often, kind="stable")  # equal counts: by hash, as rows are sorted
    take = order[np.arange(len(grams)) - bounds[:-1][row] < first[row]]
    return grams[take], row[take]


def bitmaps(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each row the parity of its columns by a hash, in a power of two of 64-bit words, about as many bits as columns."""
    size = np.diff(bounds)
    words = np.left_shift(1, np.ceil(np.log2(np.maximum(1, -(-size // 64)))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(words)])
    row = np.repeat(np.arange(len(size)), size)
    bit = (mix64(grams ^ np.uint64(0x6A09E667F3BCC908)) & (64 * words - 1).astype(np.uint64)[row]).astype(np.int64) + 64 * begin[row]
    raw = np.packbits((np.bincount(bit, minlength=64 * int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[8 * a : 8 * b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def differing(maps: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of pairs (x, y) differ; the longer ones are folded to the shorter ones' length."""
    words = np.array([len(m) // 8 for m in maps], np.int64)
    begin, flat = np.cumsum(words) - words, np.frombuffer(b"".join(maps), np.uint64)
    out = np.zeros(len(x), np.int64)
    for a, b in sorted(set(zip(words[x].tolist(), words[y].tolist()))):
        which = np.flatnonzero((words[x] == a) & (words[y] == b))
        w = min(a, b)
        for low in range(0, len(which), max(1, _ENTRIES // max(a, b))):
            k = which[low : low + max(1, _ENTRIES // max(a, b))]
            sides = [np.bitwise_xor.reduce(flat[begin[i][:, None] + np.arange(n)].reshape(len(k), n // w, w), axis=1) for i, n in ((x[k], a), (y[k], b))]
            out[k] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def possible(maps: list[bytes], n: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and bitmaps leave it open that pairs (x, y) link."""
    out = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
    fit = np.flatnonzero(out)
    out[fit] = (den + num) * differing(maps, x[fit], y[fit]) <= (den - num) * (n[x[fit]] + n[y[fit]])
    return out


def size_class(n, num: int, den: int):
    """A Spark column: sizes of two rows that link lie in one class or in neighbouring ones."""
    return F.floor(F.log(n) / (math.log(den / num) * (1 + 1e-6)) if num < den else F.log(n) * 1e6).cast("long")


def linked(overlap, a, b, num: int, den: int):
    """Whether overlap / union >= num / den."""
    return den * overlap >= num * (a + b - overlap)


class ShingleJoin:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100):
        self.rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        self.n, self.num, self.den = n, num, den
        self.spark = docs.sparkSession
        self._described: DataFrame | None = None

    def _describe(self) -> None:
        """One pass over the texts: sizes, hashes and bitmaps of the sets, and how often columns occur."""
        if self._described is not None:
            return
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, seen = np.zeros(CELLS, np.uint32), set()
            for batch in batches:
                for part in slices(batch, most=SLICE):
                    grams, bounds = incidence(part.column(1), n)
                    one, two = fingerprints(grams, bounds)
                    new = np.zeros(len(one), bool)
                    for i, key in enumerate(zip(one.tolist(), two.tolist())):
                        if key not in seen:
                            seen.add(key)
                            new[i] = True
                    cells = (grams[np.repeat(new, np.diff(bounds))] & np.uint64(CELLS - 1)).astype(np.int64)
                    cells, times = np.unique(cells, return_counts=True)
                    counts[cells] += times.astype(np.uint32)
                    # A bitmap for a set's first row in this task; so those of a group of copies are as many as tasks.
                    bits = [m if first else None for m, first in zip(bitmaps(grams, bounds), new.tolist())]
                    yield _rows(part.column(0), np.diff(bounds), one, two, bits, None)
            for k, raw in _segments(counts):
                yield _rows(pa.nulls(1, pa.int64()), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), [raw], k)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found[k] = _added(raw.as_py(), found.get(k))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["segment", "counts"])

        schema = "doc_id long, n_shingles long, h1 long, h2 long, bits binary, segment int"
        described = materialise(self.rows.mapInArrow(tidy(run), schema), "described")
        counts = np.zeros(CELLS, np.uint32)
        for r in described.filter("segment IS NOT NULL").select("segment", "bits").repartition("segment").mapInArrow(tidy(add), "segment int, counts binary").collect():
            counts[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(r.counts, np.uint32)
        docs = described.filter("segment IS NULL").drop("segment")
        least = docs.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        sets = materialise(least, "sets")
        # Different sets of one first hash get names of their own; the rest is named by it.
        clash = sets.groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).filter("low != high").select("h1", "low")
        named = sets.join(clash, "h1").filter("h2 != low").select("h1", "h2").limit(MOST_CLASHES + 1).collect()
        if len(named) > MOST_CLASHES:
            raise ValueError(f"more than {MOST_CLASHES} sets share 64 bits of their hash")
        other = {(r.h1, r.h2): int(mix64(np.array([r.h1], np.int64).view(np.uint64) ^ mix64(np.array([r.h2], np.int64).view(np.uint64))).view(np.int64)[0]) for r in named}
        self._counts, self._names = (self.spark.sparkContext.broadcast(x) for x in (counts, other))
        self._described, self._sets = (_named(df, other) for df in (docs, sets))

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, node): node is the set's name, a hash of it."""
        self._describe()
        return self._described.select("doc_id", "n_shingles", "node")

    def meetings(self) -> DataFrame:
        """(place, pivot, m, node, n): nodes that meet the least one on a first column, and the sizes of both."""
        self._describe()
        n, num, den, counts, names = self.n, self.num, self.den, self._counts, self._names

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, gathered, total = set(), [], 0
            for batch in batches:
                for part in slices(batch, most=SLICE):
                    grams, bounds = incidence(part.column(1), n)
                    nodes = _nodes(grams, bounds, names.value)
                    column, row = first_columns(grams, bounds, counts.value, num, den)
                    new = np.zeros(len(nodes), bool)
                    for i, key in enumerate(nodes.tolist()):
                        if key not in seen:
                            seen.add(key)
                            new[i] = True
                    column, row = column[new[row]], row[new[row]]
                    gathered.append((column, nodes[row], np.diff(bounds)[row]))
                    total += len(column)
                    if total > FLUSH:
                        yield from _packed(gathered)
                        gathered, total = [], 0
            if total:
                yield from _packed(gathered)

        sent = self.rows.mapInArrow(tidy(send), _SENT)
        same = Window.partitionBy("key", "late").orderBy("node").rowsBetween(*_WHOLE)
        met = sent.select("*", F.first(F.struct("node", "n")).over(same).alias("least"), F.last("node").over(same).alias("last"))
        met = met.filter("late OR least.node != last").select(
            F.when(F.col("late"), F.col("place")).otherwise(F.col("key")).alias("place"),
            F.when(F.col("late"), F.col("pivot")).otherwise(F.col("least.node")).alias("pivot"),
            F.when(F.col("late"), F.col("m")).otherwise(F.col("least.n")).alias("m"),
            "node",
            "n",
        )
        return met.filter("node != pivot")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, grams): the sets of at least the nodes given; others are mostly left out by a filter."""
        self._describe()
        n, names = self.n, self._names
        shared = self.spark.sparkContext.broadcast(node_filter(nodes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                for part in slices(batch, most=SLICE):
                    grams, bounds = incidence(part.column(1), n)
                    nodes = _nodes(grams, bounds, names.value)
                    likely = passing(shared.value, nodes) & (np.diff(bounds) > 0)
                    out, sets = [], []
                    for i in np.flatnonzero(likely).tolist():
                        if (node := int(nodes[i])) not in seen:
                            seen.add(node)
                            out.append(node)
                            sets.append(grams[bounds[i] : bounds[i + 1]].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(sets, pa.binary())], ["node", "grams"])

        found = self.rows.mapInArrow(tidy(run), "node long, grams binary")
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def bits_of(self, nodes: DataFrame) -> DataFrame:
        """(node, bits): the bitmaps of the nodes given."""
        self._describe()
        return self._described.filter("bits IS NOT NULL").select("node", "bits").join(nodes, "node", "left_semi").dropDuplicates(["node"])

    def _fit(self):
        return F.lit(self.den) * F.least("n", "m") >= F.lit(self.num) * F.greatest("n", "m")

    def links(self) -> DataFrame:
        """(a, b): links between nodes; enough of them that components are whole."""
        num, den = self.num, self.den
        none = self.spark.createDataFrame([], "a long, b long")
        met = materialise(self.meetings(), "meetings")
        if met.isEmpty():
            return none
        bits = materialise(self.bits_of(met.select("node").union(met.select("pivot")).distinct()), "bits")
        pairs = met.filter(self._fit()).select("pivot", "m", "node", "n").distinct()
        pairs = pairs.join(bits, "node").join(bits.select(F.col("node").alias("pivot"), F.col("bits").alias("other")), "pivot").select("pivot", "node", "m", "n", "bits", "other")

        def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = np.arange(batch.num_rows)
                n = np.concatenate([batch.column(3).to_numpy(), batch.column(2).to_numpy()])
                maps = [*batch.column(4).to_pylist(), *batch.column(5).to_pylist()]
                yield batch.select(["pivot", "node"]).filter(pa.array(possible(maps, n, k, k + len(k), num, den)))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.searchsorted(y, x)
                    overlap = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                    keep.append(linked(overlap, len(x), len(y), num, den))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

        pairs = materialise(pairs.mapInArrow(tidy(allowed), "pivot long, node long"), "stars")
        if pairs.isEmpty():
            sets, first, of = None, none, none.select(F.col("a").alias("node"), F.col("b").alias("component"))
        else:
            sets = materialise(self.sets_of(pairs.select("node").union(pairs.select("pivot")).distinct()), "rows")
            star = pairs.join(sets, "node").join(sets.select(F.col("node").alias("pivot"), F.col("grams").alias("other")), "pivot").select("pivot", "node", "grams", "other")
            first = materialise(star.mapInArrow(tidy(multiply), "a long, b long"), "links")
            of = components(first)
        rest = self._open(met, of, bits)
        more = self._multiplied(rest, of, sets)
        return first if more is None else first.unionByName(more)

    def _open(self, met: DataFrame, of: DataFrame, bits: DataFrame) -> DataFrame:
        """(a, b): forests of the pairs of different components that meet on a column and that sizes and bitmaps allow."""
        num, den = self.num, self.den
        named = met.join(of, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        named = named.join(of.withColumnRenamed("node", "pivot"), "pivot", "left").withColumn("d", F.coalesce("component", "pivot")).drop("component")
        # Columns that hold several components, of which some were not multiplied.
        held = named.groupBy("place").agg(
            F.min(F.least("c", "d")).alias("x"), F.max(F.greatest("c", "d")).alias("y"), F.count(F.lit(1)).alias("others"), (F.min("pivot") != F.max("pivot")).alias("several"), F.min("pivot").alias("least")
        )
        held = held.filter("x != y AND others > 1").select("place", "several", "least")
        left = materialise(named.join(held, "place"), "unsettled")
        if left.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        # A column's only pivot is multiplied with all others already.
        rows = left.select("place", "least", "node", "n", F.col("c").alias("component")).union(left.filter("several").select("place", "least", "pivot", "m", "d")).distinct()
        work = _shared(materialise(rows, "unsettled")).withColumn("class", size_class(F.col("n"), num, den))
        dealt, names = _dealt(materialise(_undecided(work), "candidates"), bits, "bits", min(LEAST_ROWS, BLOCK_ROWS), BLOCK_GRAMS, TILES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, begin, end in _partners(batches, names):
                node, n, part = (rows[k].to_numpy() for k in ("node", "n", "component"))
                maps = rows["bits"].to_pylist()
                for x, y in _pairs_between(begin, end):
                    apart = part[x] != part[y]
                    x, y = x[apart], y[apart]
                    good = possible(maps, n, x, y, num, den)
                    a, b = forest(node[x[good]], node[y[good]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return dealt.mapInArrow(tidy(run), "a long, b long").distinct()

    def pairs(self) -> DataFrame:
        """(a, b): every link between two different sets once, a the lesser node."""
        met = materialise(self.meetings(), "meetings")
        found = self._multiplied(met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), None, None)
        return self.spark.createDataFrame([], "a long, b long") if found is None else found

    def link_counts(self) -> DataFrame:
        """(doc_id, n_links) for every row: the number of other rows that it is linked with, copies among them."""
        docs = self.documents()
        found = materialise(self.pairs(), "pairs")
        copies = self._sets.select("node", "copies")
        both = found.union(found.select("b", "a"))
        others = both.join(copies.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
        full = docs.filter("n_shingles > 0").join(copies, "node").join(others, "node", "left")
        linked = full.select("doc_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return linked.unionByName(docs.filter("n_shingles = 0").select("doc_id", F.lit(0).cast("long").alias("n_links")))

    def _multiplied(self, rest: DataFrame, of: DataFrame | None, sets: DataFrame | None) -> DataFrame | None:
        """Links among nodes that ``rest`` (a, b) joins to clusters, by products of tiles; None if there is nothing to multiply.

        With components ``of`` so far only links that join components, as forests; without them every link once.
        """
        num, den, every_link = self.num, self.den, of is None
        rest = materialise(rest, "rest")
        if rest.isEmpty():
            return None
        sizes = self._described.select("node", F.col("n_shingles").alias("n")).distinct().withColumn("class", size_class(F.col("n"), num, den))
        members = components(rest).withColumnRenamed("component", "cluster").join(sizes, "node")
        if every_link:
            members = members.withColumn("component", F.col("node"))
        else:
            members = members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        work = materialise(_undecided(materialise(members, "members")), "work")
        if work.isEmpty():
            return None
        wanted = work.select("node").distinct()
        if sets is None or not wanted.join(sets, "node", "left_anti").isEmpty():
            sets = materialise(self.sets_of(wanted), "rows")
        dealt, names = _dealt(work, sets, "grams", min(LEAST_ROWS, BLOCK_ROWS), LEAST_GRAMS, TILES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _groups(batches, names):
                side, node, part = (group[k].to_numpy() for k in ("side", "node", "component"))
                low, high = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                same = _one_tile(group)
                if not same and not (len(low) and len(high)) or not every_link and (part == part[0]).all():
                    continue
                grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in group["grams"]]
                x, y = product_pairs([grams[i] for i in low], [grams[i] for i in high] if not same else None, num, den)
                x, y = node[low][x], node[low if same else high][y]
                a, b = (np.minimum(x, y), np.maximum(x, y)) if every_link else forest(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        # Written, so that no task runs two Python workers, one on top of the other.
        return materialise(dealt.mapInArrow(tidy(run), "a long, b long"), "links")

    def component_ids(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row."""
        docs = self.documents()
        with Scratch(self.spark) as scratch:
            of = scratch.keep(components(self.links()))
        named = self._sets.select("node", "first").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
        by_node = named.join(ids, "component").select("node", "component_id")
        full = docs.filter("n_shingles > 0").join(by_node, "node").select("doc_id", "n_shingles", "component_id")
        return full.unionByName(docs.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _rows(ids: pa.Array, sizes: np.ndarray, one: np.ndarray, two: np.ndarray, bits: list[bytes], segment: int | None) -> pa.RecordBatch:
    """Descriptions of texts, or a part of the table of counts."""
    columns = [ids, pa.array(sizes), pa.array(one), pa.array(two), pa.array(bits, pa.binary()), pa.array([segment] * len(sizes), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "bits", "segment"])


def _segments(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Parts of the table of counts that are not empty: all cells of a part, or (cell, count) of a few."""
    for k, part in enumerate(counts.reshape(-1, SEGMENT)):
        at = np.flatnonzero(part)
        if 6 * len(at) >= part.nbytes:
            yield k, part.tobytes()
        elif len(at):
            yield k, at.astype(np.uint16).tobytes() + part[at].tobytes()


def _added(raw: bytes, to: np.ndarray | None) -> np.ndarray:
    """A part of the table with what one task has counted added; counts stop at their limit."""
    out = np.zeros(SEGMENT, np.uint32) if to is None else to
    if len(raw) == 4 * SEGMENT:
        at, more = slice(None), np.frombuffer(raw, np.uint32)
    else:
        n = len(raw) // 6
        at, more = np.frombuffer(raw, np.uint16, n).astype(np.int64), np.frombuffer(raw[2 * n :], np.uint32)
    out[at] = np.minimum(out[at].astype(np.uint64) + more, (1 << 32) - 1).astype(np.uint32)
    return out


def _named(df: DataFrame, other: dict) -> DataFrame:
    """``df`` (h1, h2) with ``node``."""
    if not other:
        return df.withColumn("node", F.col("h1"))
    names = df.sparkSession.createDataFrame([(a, b, node) for (a, b), node in other.items()], "h1 long, h2 long, name long")
    return df.join(F.broadcast(names), ["h1", "h2"], "left").withColumn("node", F.coalesce("name", "h1")).drop("name")


def _nodes(grams: np.ndarray, bounds: np.ndarray, other: dict) -> np.ndarray:
    """Names of the rows' sets."""
    one, two = fingerprints(grams, bounds)
    if not other:
        return one
    return np.array([other.get(k, k[0]) for k in zip(one.tolist(), two.tolist())], np.int64)


_SENT = "key long, node long, n long, late boolean, place long, pivot long, m long"


def _packed(gathered: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Entries, pre-aggregated: of nodes that share a column only the least goes to the column's key.

    That the others met it goes to keys of their own, so that a column meets in one task only as often as tasks have sent.
    """
    column, node, n = (np.concatenate(c) for c in zip(*gathered, strict=True))
    order = np.lexsort((node, column))
    column, node, n = column[order], node[order], n[order]
    first = np.searchsorted(column, column)
    late = first != np.arange(len(first))
    key = np.where(late, mix64(node.view(np.uint64)), column).view(np.int64)
    columns = [key, node, n, late, np.where(late, column, 0).view(np.int64), np.where(late, node[first], 0), np.where(late, n[first], 0)]
    for a in range(0, len(key), SENT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + SENT_ROWS]) for c in columns], ["key", "node", "n", "late", "place", "pivot", "m"])


def _shared(rows: DataFrame) -> DataFrame:
    """(cluster, node, n, component): the nodes of columns (place, least, node, n, component), a cluster being a column or all columns of one least node.

    Near copies meet on many columns, mostly of one least node; columns that make more pairs one by one than as one set are one cluster, so that
    a pair is looked at once.
    """
    one = rows.groupBy("least", "place").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("least").agg(F.sum(F.col("k") * F.col("k")).alias("apart"))
    every = rows.select("least", "node").distinct().groupBy("least").agg(F.count(F.lit(1)).cast("double").alias("k"))
    joint = one.join(every, "least").filter("k * k <= apart").select("least", F.lit(True).alias("joint"))
    cluster = F.when(F.col("joint"), F.col("least")).otherwise(F.col("place")).alias("cluster")
    return rows.join(joint, "least", "left").select(cluster, "node", "n", "component").distinct()


def _undecided(members: DataFrame) -> DataFrame:
    """Rows (cluster, class, component, ...) of classes that, with their neighbours, hold several components of a cluster."""
    near = members.select("cluster", "component", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"))
    near = near.groupBy("cluster", "class").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("cluster", "class")
    return members.join(near, ["cluster", "class"], "left_semi")


def _dealt(work: DataFrame, payload: DataFrame, name: str, whole_rows: int, whole_grams: int, tiles: int) -> tuple[DataFrame, list[str]]:
    """Rows of ``work`` (cluster, class, node, n, component) with their ``payload`` (node, name), dealt to pairs of tiles, and the names of the key.

    A cluster of up to ``whole_rows`` rows and ``whole_grams`` n-grams is one tile.  A larger one's classes are cut into tiles of as much, or more
    if that gives over ``tiles``, up to BLOCK_ROWS and BLOCK_GRAMS; each is paired with those of its own and of the neighbouring class.  Side 0 or 1
    tells a pair's tiles apart; rows of one tile alone have side 0.  Where one component has over ``whole_rows`` rows of a cluster, the largest one's
    have tiles of their own (the first ``alike``), which are not paired with each other.
    """
    main = work.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > whole_rows)
    main = main.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    work = work.join(main, "cluster", "left").withColumn("main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    of_class = work.groupBy("cluster", "class", "main").agg(F.count("node").alias("rows"), F.sum("n").alias("grams"))
    total = of_class.groupBy("cluster").agg(F.sum("rows").alias("all_rows"), F.sum("grams").alias("all_grams"))
    rows = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(whole_rows), F.ceil(F.col("all_rows") / tiles)))
    grams = F.least(F.lit(BLOCK_GRAMS), F.greatest(F.lit(whole_grams), F.ceil(F.col("all_grams") / tiles)))
    parts = F.greatest(F.ceil(F.col("rows") / rows), F.ceil(F.col("grams") / grams)).cast("int")
    small = (F.col("all_rows") <= whole_rows) & (F.col("all_grams") <= whole_grams)
    cut = of_class.join(total, "cluster").withColumn("tiles", F.when(~small, parts)).groupBy("cluster", "class")
    cut = materialise(cut.agg(F.sum("tiles").cast("int").alias("tiles"), F.coalesce(F.sum(F.when(F.col("main"), F.col("tiles"))), F.lit(0)).cast("int").alias("alike")), "tiles")
    near = lambda k, name: cut.select("cluster", (F.col("class") + k).alias("class"), F.col("tiles").alias(name), F.col("alike").alias(f"{name}_alike"))
    placed = work.join(cut, ["cluster", "class"]).join(near(-1, "above"), ["cluster", "class"], "left").join(near(1, "below"), ["cluster", "class"], "left")
    mine = F.greatest(F.when(F.col("main"), F.col("alike")).otherwise(F.col("tiles") - F.col("alike")), F.lit(1))
    placed = placed.withColumn("own", (F.pmod(F.xxhash64("node"), mine) + F.when(F.col("main"), 0).otherwise(F.col("alike"))).cast("int"))
    key = lambda low, p, up, q, side: F.struct(low.alias("low"), p.alias("p"), F.lit(up).alias("up"), q.alias("q"), side.alias("side"))
    own, c = F.col("own"), F.col("class")

    def every(name: str, alike: str, f):
        first = F.when(F.col("main"), F.coalesce(F.col(alike), F.lit(0))).otherwise(0)
        return F.when(F.coalesce(F.col(name), F.lit(0)) > first, F.transform(F.sequence(first, F.col(name) - 1), f)).otherwise(F.array())

    keys = F.concat(
        every("tiles", "alike", lambda j: key(c, F.least(own, j), 0, F.greatest(own, j), (own > j).cast("int"))),
        every("above", "above_alike", lambda j: key(c, own, 1, j, F.lit(0))),
        every("below", "below_alike", lambda j: key(c - 1, j, 1, own, F.lit(1))),
    )
    alone = F.array(key(F.lit(0).cast("long"), F.lit(0), 0, F.lit(0), F.lit(0)))
    names, kept = ["cluster", "low", "p", "up", "q"], ["cluster", "node", "n", "component"]
    spread = placed.select(*kept, F.explode(F.when(F.col("tiles").isNull(), alone).otherwise(keys)).alias("k")).select(*kept, "k.*")
    return spread.join(payload, "node").repartition(*names).sortWithinPartitions(*names, "side").select(*names, "side", "node", "n", "component", name), names


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows of each key of a sorted partition."""
    for rows, start in _whole_groups(batches, names):
        for a, b in zip(start.tolist(), [*start[1:].tolist(), rows.num_rows]):
            yield rows.slice(a, b - a)


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of a sorted partition, cut between keys only, and where each key begins."""
    kept: list[pa.RecordBatch] = []
    keys = lambda rows: np.stack([rows[k].to_numpy() for k in names], axis=1)
    starts = lambda rows: np.concatenate([[0], np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1]) if len(rows) else np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        start = starts(keys(batch))
        last = int(start[-1])
        if last or (kept and (keys(kept[-1])[-1] != keys(batch)[0]).any()):  # a key has ended
            rows = pa.Table.from_batches([*kept, batch.slice(0, last)])
            if rows.num_rows:
                yield rows, starts(keys(rows))
            kept = []
        kept.append(batch.slice(last))
    if kept:
        rows = pa.Table.from_batches(kept)
        yield rows, starts(keys(rows))


def _one_tile(group) -> bool:
    return group["up"][0].as_py() == 0 and group["p"][0].as_py() == group["q"][0].as_py()


def _partners(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows of whole keys, and the range of rows that each row makes pairs with."""
    for rows, start in _whole_groups(batches, names):
        end = np.append(start[1:], rows.num_rows)
        up, p, q, side = (rows[k].to_numpy() for k in ("up", "p", "q", "side"))
        same = ((up == 0) & (p == q))[start]
        high = np.add.reduceat(side == 0, start) + start  # side 1 stands behind side 0
        group = np.repeat(np.arange(len(start)), end - start)
        begin = np.where(same[group], np.arange(rows.num_rows) + 1, np.where(side == 0, high[group], end[group]))
        yield rows, begin, end[group]


def _pairs_between(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each row with the rows from begin to end, so many at once."""
    count = np.maximum(end - begin, 0)
    low, total = 0, np.cumsum(count)
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(total, _ENTRIES + (total[low - 1] if low else 0), side="right")))
        n = count[low:high]
        x = np.repeat(np.arange(low, high), n)
        yield x, np.repeat(begin[low:high] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        low = high


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The product of two tiles: numbers of columns that rows share, added up over blocks of columns."""
    out = np.zeros((len(a), len(b)), np.int64)
    both = []
    common = np.intersect1d(np.concatenate(a), np.concatenate(b)) if len(a) and len(b) else np.zeros(0, np.uint64)
    if not len(common):
        return out
    for rows in (a, b):
        gram, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(common, gram), len(common) - 1)
        shared = common[at] == gram
        order = np.argsort(at[shared], kind="stable")
        both.append((at[shared][order], row[shared][order], np.bincount(at[shared], minlength=len(common))))
    (ca, ra, na), (cb, rb, nb) = both
    full = na * nb * 32 > out.size  # columns with many entries, as dense blocks
    place = np.cumsum(full) - 1
    da, db = full[ca], full[cb]
    for low in range(0, int(full.sum()), BLOCK_COLUMNS):
        parts = []
        for c, r, dense, n in ((ca, ra, da, len(a)), (cb, rb, db, len(b))):
            c, r = place[c[dense]], r[dense]
            i, j = np.searchsorted(c, [low, low + BLOCK_COLUMNS])
            block = np.zeros((n, BLOCK_COLUMNS), np.float32)
            block[r[i:j], c[i:j] - low] = 1
            parts.append(block)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    ca, ra = ca[~da], ra[~da]  # the others entry by entry
    begin, times = (np.cumsum(nb) - nb)[ca], nb[ca]
    ends = np.cumsum(times)
    for low in range(0, int(ends[-1]) if len(ends) else 0, _ENTRIES):
        i, j = np.searchsorted(ends, [low, low + _ENTRIES], side="right")
        i, j = int(i), min(int(j) + 1, len(ca))
        reach = np.clip(ends[i:j], low, low + _ENTRIES) - np.clip(ends[i:j] - times[i:j], low, low + _ENTRIES)
        skip = np.clip(low - (ends[i:j] - times[i:j]), 0, None)
        at = np.repeat(begin[i:j] + skip - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
        np.add.at(out, (np.repeat(ra[i:j], reach), rb[at]), 1)
    return out


def product_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of two tiles, or (``b``: None) within one, by their numbers."""
    other = a if b is None else b
    sizes = [np.array([len(s) for s in x], np.int64) for x in (a, other)]
    good = linked(overlaps(a, other), sizes[0][:, None], sizes[1][None, :], num, den)
    return np.nonzero(np.triu(good, 1) if b is None else good)


def _places(nodes: np.ndarray, bits: int) -> np.ndarray:
    """Three bit positions of each node in a filter."""
    h = mix64(np.asarray(nodes, np.int64).view(np.uint64))
    return np.stack([((h >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 19, 38)], axis=-1)


def passing(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether each node may be in a filter."""
    at = _places(nodes, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=-1)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of nodes of at most ``FILTER_BITS`` bits, put together from the tasks' parts."""
    segment = 1 << 20
    bits = min(FILTER_BITS, max(segment, 1 << int(16 * max(1, nodes.count())).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = [(k, p.tobytes()) for k, p in enumerate(mine.reshape(-1, segment // 8)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["segment", "bits"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(raw.as_buffer(), np.uint8)
                found[k] = found[k] | raw if k in found else raw.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["segment", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    schema = "segment int, bits binary"
    for row in nodes.mapInArrow(tidy(part), schema).repartition("segment").mapInArrow(tidy(whole), schema).collect():
        out[row.segment * segment // 8 : (row.segment + 1) * segment // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id.

    Rows are rejected by id; where several texts share an id, each is a document of its own.
    """
    apart, name, _ = told_apart(docs, id_col, text_col, True)
    with Scratch(ship(docs.sparkSession)) as scratch:
        ids = ShingleJoin(apart, name, text_col, **options).component_ids()
        leave = scratch.keep(ids.filter("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct())
    return without(apart, leave, name).select(*[F.col(f"`{c}`") for c in docs.columns])
