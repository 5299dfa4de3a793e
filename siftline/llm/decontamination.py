"""Benchmark decontamination by suffix arrays over the training text.

The corpus is cut into shards, slices of a task's rows that fit in memory.  For
each shard a suffix array over its words is built, refining ties by words ever
further on, and every test suffix (every word position of every benchmark item)
is binary-searched in it.  The neighbours of its place give its longest verbatim
match in the shard and where that lies (:func:`longest_matches`); the run of
suffixes that share its window gives all occurrences of the window.  Those that
follow each other in text and item are one longer verbatim match: :func:`scan`
gives each document its longest one and where it lies, and :func:`remove` drops
the documents that have any.

Suffixes whose first words occur nowhere in the benchmark can't take part in a
match of that many words; they are left out of the array (``head`` words: two,
or one where the benchmark has an item of one word).  Words are compared by the
numbers that the benchmark's own vocabulary gives them; a training word enters
that vocabulary by hash and then by its bytes, so matches are verbatim.

A benchmark of bounded bytes is broadcast.  A larger one is written to the shared
folder in blocks, dealt by hash (a longer item makes its block longer); a task keeps
a group of its rows and reads the blocks one by one for it.  The corpus is read once
either way, without a shuffle, and nothing but the result is written.

Defined results
    null or empty text       no words; nothing is hit
    null or empty item text  no windows; never occurs
    null item_id             its windows count; it is listed as an empty string
    very long text           whole; a shard then holds that text alone
    equal longest matches    the first in the text, then that of the least item_id
    repeated rows, ties      each row is searched alone; repeated items count once
                             for each distinct item_id
    empty tables             no rows, or no hits
    clashing columns         input columns pass through; the one added column
                             (``contamination``) replaces one of that name
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftline.llm.shared import fresh, new_path, slices, store, tidy
from siftline.llm.wordarrays import ALNUM, Words
from siftline.session import ship

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that a task holds at once, and of its own rows' text while it reads block after block.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 32 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.StructType([T.StructField("n_words", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("item_id", T.StringType())])),
    ]
)


def _words_at(numbers: np.ndarray, end: np.ndarray, at: np.ndarray, level: int, per: int) -> np.ndarray:
    """The ``per`` words of a level of suffixes that begin ``at``; 0 from their text's end on."""
    place = at[:, None] + np.arange(level * per, (level + 1) * per)
    inside = place < end[at][:, None]
    return np.where(inside, numbers[np.where(inside, place, 0)], 0)


class Benchmark:
    """Test suffixes of a block of items, as numbers of the block's vocabulary; a suffix is known by its first word's index.

    ``whole``: suffixes are told apart to their ends, not only within windows.  Memory is in proportion to the words.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, whole: bool = False):
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.ids = [i or "" for i, _ in items]
        self.hashes, first, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.texts = [words.data[words.begin[k] : words.end[k]].tobytes() for k in first]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        n = np.diff(words.bounds)
        self.bits = max(1, int(len(self.hashes)).bit_length())
        self.number = number.astype(np.int64) + 1
        self.item = np.repeat(np.arange(len(n)), n)
        self.end = words.bounds[1:][self.item]
        self.at = np.arange(len(self.item)) - words.bounds[:-1][self.item]
        left = self.end - np.arange(len(self.item))
        #: Words of the window that a test suffix begins; 0 if it is too short for one.
        width = np.minimum(n, window)[self.item]
        self.width = np.where(left >= width, width, 0)
        #: Words in one sort key, and keys that any comparison may need.
        longest = int(n.max(initial=1))
        self.per = 62 // self.bits
        self.keys = max(1, -(-(longest if whole else min(longest, window)) // self.per))
        self.head = int(min(2, np.minimum(n[n > 0], window).min(initial=2)))
        begins = np.flatnonzero(left >= self.head)
        code = self.number[begins] << self.bits
        self.heads = np.unique(code | self.number[begins + 1] if self.head == 2 else code)
        #: A first test of training words by the low bits of their hashes.
        self.low = np.uint64((1 << 20) - 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & self.low).astype(np.int64)] = True

    def pack(self, words: np.ndarray) -> np.ndarray:
        key = np.zeros(words.shape[0], np.int64)
        for k in range(self.per):
            key = key << self.bits | words[:, k]
        return key

    def key(self, which: np.ndarray, level: int) -> np.ndarray:
        """Sort keys of a level of test suffixes."""
        return self.pack(_words_at(self.number, self.end, which, level, self.per))

    def numbers(self, words: Words) -> np.ndarray:
        """Training words as numbers of the vocabulary; 0 for words outside it."""
        out = np.zeros(len(words), np.int64)
        if not len(self.hashes):
            return out
        likely = np.flatnonzero(self.maybe[(words.hash & self.low).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words.hash[likely]), len(self.hashes) - 1)
        same = (self.hashes[at] == words.hash[likely]) & (self.lengths[at] == words.end[likely] - words.begin[likely])
        out[likely[same]] = at[same] + 1
        return out


class Shard:
    """A suffix array over the words of a slice of the corpus; a place is a word's index."""

    def __init__(self, column: pa.Array, bench: Benchmark):
        self.words = words = Words(column, ALNUM)
        self.bench = bench
        self.end = np.repeat(words.bounds[1:], np.diff(words.bounds))
        self.number = bench.numbers(words)
        self._sort()

    def _key(self, at: np.ndarray, level: int) -> np.ndarray:
        return self.bench.pack(_words_at(self.number, self.end, at, level, self.bench.per))

    def _sort(self) -> None:
        bench = self.bench
        at = np.flatnonzero(self.number)
        code = self.number[at] << bench.bits
        if bench.head == 2:
            code |= np.where(at + 1 < self.end[at], self.number[np.minimum(at + 1, len(self.number) - 1)], 0)
        if len(bench.heads):
            at = at[bench.heads[np.minimum(np.searchsorted(bench.heads, code), len(bench.heads) - 1)] == code]
        key = self._key(at, 0)
        order = np.argsort(key, kind="stable")
        self.at, self.first = at[order], key[order]
        group = np.searchsorted(self.first, self.first)  # where the run of equals begins
        for level in range(1, bench.keys):
            tied = np.zeros(len(at), bool)
            same = group[1:] == group[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            tied = np.flatnonzero(tied)
            if not len(tied):
                break
            key = self._key(self.at[tied], level)
            order = np.lexsort((key, group[tied]))
            self.at[tied], key, old = self.at[tied][order], key[order], group[tied]
            new = np.ones(len(tied), bool)
            new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
            group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]

    def _bound(self, low: np.ndarray, high: np.ndarray, level: int, want: np.ndarray) -> np.ndarray:
        """For each range of the array, the first place whose key of a level is ``want`` or more."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            less = self._key(self.at[middle], level) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]

    def search(self, which: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: for test suffixes, the range of the array that shares their first ``width`` words.

        Where the range is empty, it lies at the suffix's place in the order.
        """
        bench = self.bench
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.at))
        for level in range(bench.keys):
            going = np.flatnonzero((low < high) & (width > level * bench.per))
            if not len(going):
                break
            missing = np.maximum(0, (level + 1) * bench.per - width[going]) * bench.bits
            want = bench.key(which[going], level) >> missing << missing
            beyond = want + (np.int64(1) << missing)
            if level == 0:
                low[going], high[going] = np.searchsorted(self.first, want), np.searchsorted(self.first, beyond)
            else:
                a = self._bound(low[going], high[going], level, want)
                high[going] = self._bound(a, high[going], level, beyond)
                low[going] = a
        return low, high

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of a window: index of its first word, its width, the test suffix that it begins."""
        bench = self.bench
        which = np.flatnonzero(bench.width)
        low, high = self.search(which, bench.width[which])
        count = np.maximum(high - low, 0)
        test = np.repeat(which, count)
        place = self.at[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        return place, bench.width[test], test

    def verified(self, first: np.ndarray, width: np.ndarray) -> bool:
        """Compares the words of occurrences byte by byte; takes words out that only share a hash."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + width, -1)
        good = True
        for w in np.flatnonzero(np.cumsum(edge)[:-1] > 0).tolist():
            if self.words.data[self.words.begin[w] : self.words.end[w]].tobytes() != self.bench.texts[self.number[w] - 1]:
                self.number[w], good = 0, False
        return good

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the words of its longest match here, and the place of one such match."""
        bench = self.bench
        n = len(bench.item)
        best, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(self.at):
            return best, where
        low, _ = self.search(np.arange(n), bench.end - np.arange(n))
        for neighbour in (low - 1, low):
            length = self._common(np.arange(n), self.at[np.clip(neighbour, 0, len(self.at) - 1)])
            length[(neighbour < 0) | (neighbour >= len(self.at))] = 0
            where = np.where(length > best, self.at[np.clip(neighbour, 0, len(self.at) - 1)], where)
            best = np.maximum(best, length)
        return best, where

    def _common(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that test suffixes and the suffixes of places begin with alike."""
        bench, out = self.bench, np.zeros(len(which), np.int64)
        room = np.minimum(bench.end[which] - which, self.end[place] - place)
        going = np.flatnonzero(room > 0)
        while len(going):
            k = out[going]
            going = going[bench.number[which[going] + k] == self.number[place[going] + k]]
            out[going] += 1
            going = going[out[going] < room[going]]
        return out


class Blocks:
    """The benchmark's distinct items in blocks of bounded size: broadcast if one holds them all, else a table in the shared folder."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str):
        items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).dropDuplicates()
        total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.n = max(1, -(-total // BLOCK_BYTES))
        if self.n == 1:
            self.shared = benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
        else:
            self.shared, self.path = None, new_path(benchmark.sparkSession, "benchmark")
            dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(self.n)))
            dealt.repartition("block").write.partitionBy("block").parquet(self.path)

    def each(self) -> Iterator[list[tuple[str | None, str | None]]]:
        """The items of each block, in order; inside a task."""
        for k in range(self.n):
            yield sorted(self.shared.value if self.shared else self._read(k), key=lambda r: (r[0] or "", r[1] or ""))

    def _read(self, k: int) -> list[tuple]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        where, path = store(f"{self.path}/block={k}")
        files = [f.path for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = [pq.ParquetFile(where.open_input_file(f)).read() for f in files]
        return [r for t in tables for r in zip(*(t.column(c).to_pylist() for c in ("i", "t")), strict=True)]


def _groups(batches: Iterator[pa.RecordBatch], column: str, whole: bool) -> Iterator[list[pa.RecordBatch]]:
    """Slices of a task's rows: one by one, or as many as it keeps while blocks pass."""
    group, size = [], 0
    for batch in batches:
        for part in slices(batch, column):
            if whole:
                yield [part]
                continue
            group.append(part)
            size += part.column(part.schema.get_field_index(column)).nbytes
            if size >= GROUP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def _runs(mask: np.ndarray, base: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"first": int(a) - base, "last": int(b) - 1 - base} for a, b in zip(edge[::2], edge[1::2])]


def scan(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column: n_words, hits (runs of hit words, counted from 0), items (ids) and longest.

    ``longest``: words, first word and item of the longest verbatim match of a window or more; null where there is none.
    """
    ship(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    schema = T.StructType([*kept.schema.fields, T.StructField(out, RESULT)])
    blocks = Blocks(benchmark, item_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Benchmark(next(blocks.each()), window) if blocks.n == 1 else None
        for group in _groups(batches, text_col, one is not None):
            texts = [part.column(part.schema.get_field_index(text_col)) for part in group]
            found: list[list[dict]] = [[] for _ in group]
            for bench in [one] if one else (Benchmark(items, window) for items in blocks.each()):
                found = [_scanned(t, bench, before) for t, before in zip(texts, found)]
            for part, rows in zip(group, found):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _RESULT)], schema.fieldNames())

    return kept.mapInArrow(tidy(run), schema)


_RESULT = to_arrow_type(RESULT)


def _longest(text: np.ndarray, first: np.ndarray, width: np.ndarray, test: np.ndarray, item: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """For each text that occurrences lie in, (words, first word, item) of its longest verbatim match.

    Occurrences one word apart in both the text and the item are one match.
    """
    order = np.lexsort((first, first - test, item))
    first, width, test, item, text = (x[order] for x in (first, width, test, item, text))
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) != 1) | (np.diff(test) != 1) | (np.diff(item) != 0) | (np.diff(text) != 0)
    begin = np.flatnonzero(new)
    words = np.diff(np.append(begin, len(first))) + width[begin] - 1
    best = np.lexsort((item[begin], first[begin], -words, text[begin]))
    which, at = np.unique(text[begin][best], return_index=True)
    return {int(t): (int(words[k]), int(first[begin[k]]), int(item[begin[k]])) for t, k in zip(which, best[at])}


def _scanned(column: pa.Array, bench: Benchmark, before: list[dict]) -> list[dict]:
    """The result of each text, with what earlier blocks have found in it."""
    shard = Shard(column, bench)
    while True:
        first, width, test = shard.occurrences()
        if shard.verified(first, width):
            break
        shard._sort()
    item = bench.item[test]
    bounds = shard.words.bounds
    edge = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + width, -1)
    mask = np.cumsum(edge)[:-1] > 0
    text = np.searchsorted(bounds, first, side="right") - 1
    items: dict[int, set] = {}
    for t, i in zip(*np.divmod(np.unique(text * max(1, len(bench.ids)) + item), max(1, len(bench.ids)))):
        items.setdefault(int(t), set()).add(bench.ids[i])
    longest = _longest(text, first, width, test, item)
    out = []
    for t in range(len(bounds) - 1):
        a, b = int(bounds[t]), int(bounds[t + 1])
        own, best = items.get(t, set()), None
        hit = mask[a:b]
        if t in longest:
            words, at, which = longest[t]
            best = {"n_words": words, "first": at - a, "item_id": bench.ids[which]}
        if before and (was := before[t])["items"]:
            hit = hit.copy()
            for run in was["hits"]:
                hit[run["first"] : run["last"] + 1] = True
            own = own | set(was["items"])
            best = min((x for x in (best, was["longest"]) if x), key=lambda x: (-x["n_words"], x["first"], x["item_id"]))
        out.append({"n_words": b - a, "hits": _runs(hit, 0) if own else [], "items": sorted(own), "longest": best})
    return out


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that have a verbatim match with the benchmark as long as a window."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = fresh("__contamination", docs.columns)
    return scan(docs, benchmark, out=out, **options).filter(F.col(out)["longest"].isNull()).select(*columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """For every test suffix its longest verbatim match of ``least`` words or more over all shards.

    Rows (item_id, item_word, n_words, doc_id, doc_word): the match begins at
    those words, counted from 0; of equal lengths the least (doc_id, doc_word)
    of those that the shards name.  Results are as many as the benchmark's words at most.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "item_id string, item_word long, n_words long, doc_id long, doc_word long"
    blocks = Blocks(benchmark, item_col, "text")
    names = ["item_id", "item_word", "n_words", "doc_id", "doc_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Benchmark(next(blocks.each()), whole=True) if blocks.n == 1 else None
        for group in _groups(batches, "text", one is not None):
            for bench in [one] if one else (Benchmark(items, whole=True) for items in blocks.each()):
                for part in group:
                    shard = Shard(part.column(1), bench)
                    best, place = shard.longest()
                    k = np.flatnonzero(best >= least)
                    text = np.searchsorted(shard.words.bounds, place[k], side="right") - 1
                    item = pa.array([bench.ids[i] for i in bench.item[k]], pa.string())
                    yield pa.RecordBatch.from_arrays([item, pa.array(bench.at[k]), pa.array(best[k]), part.column(0).take(pa.array(text)), pa.array(place[k] - shard.words.bounds[text])], names)

    out = rows.mapInArrow(tidy(run), schema)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("b")
    return out.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_word")
