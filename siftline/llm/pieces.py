"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is cut into units at its space marks, which no piece holds inside, and
each distinct unit is encoded once by an agenda: of all adjacent symbol pairs
whose join is a piece, the one of the highest score is merged first, the
leftmost one of equals, until no pair is left.  Short units run through the
agenda together as rows of a matrix; long ones keep a heap of pairs and a
linked list of symbols.  Symbols outside the vocabulary fall back to bytes.

Every Arrow batch is checked against the sentencepiece library: ``agrees`` says
whether the ids are the library's; where they were not, the library's are kept.

Defined results
    null or empty text   begin and end ids only, decoded to an empty text
    very long text       encoded whole
    repeated rows, ties  each row is encoded alone
    empty table          empty result
    clashing columns     input columns pass through; the added ones replace
                         those of their names
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.shared import fresh, slices, tidy
from siftline.llm.units import MARKS, Cut, UnitCache, coder, concatenated

MARK = "▁"
#: Bytes of text encoded at once, and checked in halves: the library's lists take forty times as much.
SLICE = 2 << 20
#: Entries of a worker's cache of units.
CACHE = 1_000_000
#: Units up to these lengths share a matrix; longer ones take the heap.
WIDTHS = (8, 16, 32)
_NONE = np.iinfo(np.int32).max
_RUN = re.compile(" +[^ ]*").findall


class MergeVocabulary:
    """Symbols, pair ranks and fallback bytes of a merge-type (BPE) model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(m.is_unused(i) for i in plain):
            raise ValueError("vocabularies with unused pieces are not supported")
        pieces = {m.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space mark inside; texts can't be cut at space marks")
        if m.encode(" a")[:1] == m.encode("a")[:1] and m.encode(" a") == m.encode("a"):
            raise ValueError("models that drop white space are not supported")
        # Symbols are pieces by id, then characters that only occur inside pieces.
        symbols = dict(pieces)
        for p in pieces:
            for ch in p:
                symbols.setdefault(ch, size + len(symbols))
        #: Unknown characters are symbols from here on, by code point.
        self.unknown = max(symbols.values()) + 1
        self.char = np.arange(0x110000, dtype=np.int32) + self.unknown
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        scores = sorted({m.get_score(i) for i in plain}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank[m.get_score(i)], i)
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([v[0] for v in pairs.values()], np.int32)[order], _NONE)
        self.joins = np.append(np.array([v[1] for v in pairs.values()], np.int32)[order], -1)
        self.text = {i: s for s, i in symbols.items()}
        self.byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_piece = np.zeros(self.unknown + 1, bool)
        self.is_piece[plain] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the rank table; the last index where it is none."""
        want = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, at, len(self.keys) - 1)

    def ids(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            if s < self.unknown and self.is_piece[s]:
                out.append(s)
            else:
                text = chr(s - self.unknown) if s >= self.unknown else self.text[s]
                out.extend(self.byte[b] for b in text.encode())
        return out

    def agenda(self, unit: str) -> list[int]:
        """Symbols of one unit of any length, by a heap."""
        sym = self.char[np.frombuffer(unit.encode("utf-32-le"), "<u4")].tolist()
        n, pairs = len(sym), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[sym[i], sym[i + 1]][0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (sym[i], sym[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = pairs[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (got := pairs.get((sym[x], sym[y]))):
                    heapq.heappush(heap, (got[0], x, sym[x], sym[y]))
        return [s for s in sym if s >= 0]

    def packed(self, units: list[str]) -> list[bytes]:
        """Packed ids of units; short ones go through the agenda together, as rows of matrices."""
        out: list = [b""] * len(units)
        lengths = np.array([len(u) for u in units])
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows):
                self._matrix([units[i] for i in rows], lengths[rows], width, rows, out)
        for i in np.flatnonzero(lengths > low).tolist():
            out[i] = np.array(self.ids(self.agenda(units[i])), "<u4").tobytes()
        return out

    def _finish(self, where: np.ndarray, sym: np.ndarray, out: list) -> None:
        """Packs rows of symbols; those with a symbol outside the vocabulary byte by byte."""
        full = sym >= 0
        flat = sym[full]
        size = full.sum(axis=1)
        end = np.cumsum(size)
        odd = np.add.reduceat(~self.is_piece[np.minimum(flat, self.unknown)], end - size) > 0
        raw = flat.astype("<u4").tobytes()
        for i, a, b, o in zip(where.tolist(), ((end - size) * 4).tolist(), (end * 4).tolist(), odd.tolist()):
            out[i] = raw[a:b] if not o else np.array(self.ids(flat[a // 4 : b // 4].tolist()), "<u4").tobytes()

    def _matrix(self, units: list[str], n: np.ndarray, width: int, where: np.ndarray, out: list) -> None:
        column = np.arange(width)
        inside = column < n[:, None]
        sym = np.full((len(units), width + 1), -1, np.int32)
        sym[:, :-1][inside] = self.char[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        at = self.find(sym[:, :-2], np.maximum(sym[:, 1:-1], 0))
        rank = np.full((len(units), width), _NONE, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.ranks[at], _NONE)
        while len(where):
            j = rank.argmin(axis=1)
            row = np.arange(len(where))
            going = rank[row, j] != _NONE
            if not going.all():
                self._finish(where[~going], sym[~going], out)
                where, sym, rank, j = where[going], sym[going], rank[going], j[going]
                row = np.arange(len(where))
                if not len(where):
                    return
            sym[row, j] = self.joins[self.find(sym[row, j], sym[row, j + 1])]
            moved = column[None, :] > j[:, None]
            np.copyto(sym[:, :-1], sym[:, 1:].copy(), where=moved)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=moved[:, :-1])
            for off in (-1, 0):  # the pairs left and right of the new symbol
                k = j + off
                ok = k >= 0
                r, k = row[ok], k[ok]
                b = sym[r, k + 1]
                rank[r, k] = np.where(b >= 0, self.ranks[self.find(sym[r, k], np.maximum(b, 0))], _NONE)


class PieceEncoder:
    """Encodes texts with begin and end ids; packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.vocabulary = v = MergeVocabulary(path)
        # A line end is in no piece, so it is cut off from what stands before it.
        self.lines = not any("\n" in p for p in v.text.values())
        # So is a mark that no piece holds after a letter.
        after = {b for p in v.text.values() for a, b in zip(p, p[1:]) if a.isalpha()}
        self.marks = "".join(m for m in MARKS if m not in after)
        self.units = UnitCache(lambda units: self._fill([u if u[:1] == "\n" and self.lines else u[1:] if u[:1] == "\x01" else " " + u for u in units]), CACHE)
        self.runs = UnitCache(self._fill, CACHE // 8)
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (v.model.bos_id(), v.model.eos_id()))

    def _fill(self, units: list[str]) -> list[bytes]:
        return self.vocabulary.packed([u.replace(" ", MARK) for u in units])

    def encode(self, column: pa.Array) -> list[bytes]:
        """Packed ids of each text."""
        if not len(column):
            return []
        column = pc.replace_substring(column, MARK, " ")
        cut = Cut(column, "^$|^ |  |\x01", self.lines, self.marks)
        out = concatenated(self.units.look_up(cut.units), cut.at, cut.bounds, np.dtype("<u4"))
        for i in cut.odd.tolist():
            text = column[i].as_py()
            out[i] = b"".join(self.runs.look_up(_RUN(" " + text))) if text else b""
        return [self.bos + ids + self.eos for ids in out]


#: Columns that :func:`encode` adds.
ADDED = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("agrees", T.BooleanType()),
    ]
)


def encode(docs: DataFrame, path: str, text_col: str = "text", check: bool = True, cache_units: int = CACHE, slice_bytes: int = SLICE) -> DataFrame:
    """``docs`` with ids (packed), n_tokens, decoded text and whether the library agrees.

    ``path`` is a model file present at that path on every executor.
    ``cache_units``: units a worker keeps ids of, about 200 bytes each, and
    ``slice_bytes``: bytes of text encoded at once; less of either costs time only.
    """
    # Where room is short, free memory is given back after every slice.
    release_bytes = 16 * slice_bytes if slice_bytes >= SLICE else slice_bytes
    own = [f.name for f in ADDED]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own or c == text_col])
    schema = T.StructType(kept.schema.fields + [T.StructField(fresh("__" + f.name, docs.columns), f.dataType) for f in ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(PieceEncoder, path)
        encoder.units.most, encoder.runs.most = cache_units, cache_units // 8
        for batch in batches:
            for whole in slices(batch, text_col, slice_bytes, release_bytes):
                at = whole.schema.get_field_index(text_col)
                ids = encoder.encode(pc.fill_null(whole.column(at), ""))
                yield from checked(whole, ids, at)

    def checked(whole: pa.RecordBatch, ids: list[bytes], at: int) -> Iterator[pa.RecordBatch]:
        """Parts of a batch, decoded and held against the library."""
        model, done = coder(PieceEncoder, path).vocabulary.model, 0
        for part in slices(whole, text_col, slice_bytes // 2, release_bytes):
            texts = [t or "" for t in part.column(at).to_pylist()]
            packed, done = ids[done : done + len(texts)], done + len(texts)
            lists = [np.frombuffer(p, "<u4").tolist() for p in packed]
            agrees = [True] * len(texts)
            if check:
                theirs = model.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                for i, (a, b) in enumerate(zip(lists, theirs, strict=True)):
                    if a != b:
                        agrees[i], lists[i], packed[i] = False, b, np.array(b, "<u4").tobytes()
            decoded = model.decode(lists, num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(decoded, pa.string()), pa.array(agrees)],
                schema.fieldNames(),
            )

    out = kept.mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"`{c}`") for c in kept.columns if c not in own], *[F.col(fresh("__" + c, docs.columns)).alias(c) for c in own])
