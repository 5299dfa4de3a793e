"""Cutting texts into units that a tokenizer treats independently, and caching their ids.

Byte-level BPE never merges across a space that follows a character other than
white space, and SentencePiece pieces hold their space mark in front only.  So
a text is the sequence of its space-separated units, and as units repeat, each
distinct one is encoded once and looked up afterwards.  The caches are bounded
and drop what was not used for longest; results never depend on them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftline.llm.shared import hold

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text cut at once.
UNIT_SLICE = 4 << 20
#: Entries that a worker's cache may hold (about 200 bytes each).
CACHE_UNITS = 1_000_000
#: Texts with other white space than single spaces and line ends are cut with care.
_ODD = "[ \n][ \n]|[\x01\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_CUT = re.compile(r"(?<=\S)(?= )")


#: Marks that a unit may end before, where a letter stands before them.
MARKS = ".,;:!?"


class Cut:
    """The units of a column's texts: distinct units, and which stand where in each text.

    A unit that begins with a line end stands for itself, one that begins with
    \\x01 for what follows that, any other for a space and itself.  ``odd`` texts
    (of a pattern) have no units here.
    """

    def __init__(self, column: pa.Array, odd: str, lines: bool = True, marks: str = ""):
        odd_ = pc.match_substring_regex(column, odd)
        self.odd = np.flatnonzero(odd_.to_numpy(zero_copy_only=False))
        column = pc.if_else(odd_, "", column) if len(self.odd) else column
        if lines:
            column = pc.replace_substring(column, "\n", " \n")
        if marks:
            column = pc.replace_substring_regex(column, rf"(\pL)([{re.escape(marks)}])", "\\1 \x01\\2")
        lists = pc.split_pattern(column, " ")
        self.bounds = lists.offsets.to_numpy().astype(np.int64)
        self.bounds -= self.bounds[0]
        flat = lists.flatten()
        self.firsts = flat.take(pa.array(self.bounds[:-1])).to_pylist() if len(flat) else []
        coded = flat.dictionary_encode()
        self.at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.units = coded.dictionary.to_pylist()


def cut_with_care(text: str) -> list[str]:
    """Units of a text, each standing for itself."""
    return _CUT.split(text)


def concatenated(values: list[bytes], at: np.ndarray, bounds: np.ndarray, dtype: np.dtype) -> list[bytes]:
    """For each text (its range of ``at``) the joined values that ``at`` points to."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // dtype.itemsize
    source = np.frombuffer(b"".join(values), dtype)
    start = (np.cumsum(size) - size)[at]
    size = size[at]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    ids = source[np.repeat(start - end + size, size) + np.arange(total)]
    cuts = np.concatenate([[0], end])[bounds]
    return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class UnitCache:
    """Maps a unit (with its space left out) to a value; ``fill`` computes values of new units.

    Entries stand in two halves; when the one in use is full, it becomes the old
    one, and what the old one held unused since then goes.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], most: int = CACHE_UNITS):
        self.fill, self.most, self.known, self.old = fill, most, {}, {}

    def look_up(self, units: list[str]) -> list:
        """The values of units."""
        if 2 * len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = list(map(known.get, units))
        if None in found:
            new = []
            for i, v in enumerate(found):
                if v is None:
                    u = units[i]
                    if (v := old.get(u)) is None:
                        new.append(u)
                    else:
                        known[u] = found[i] = v
            if new:
                new = list(dict.fromkeys(new))
                known.update(zip(new, self.fill(new), strict=True))
                found = [known[u] if v is None else v for u, v in zip(units, found)]
        return found


#: Up to this character (Latin scripts) letter classes are the same in every Unicode version.
STABLE = "\u024f"
#: Plain words that are merged in one call of the library.
_TOGETHER = 500


def plain(unit: str) -> bool:
    """Whether a unit is a space and letters of stable classes, hence one pre-token."""
    return unit[:1] == " " and unit[1:].isalpha() and (unit.isascii() or max(unit) <= STABLE)


class ByteBpe:
    """Values of texts under a byte-level BPE of the tokenizers library, by units.

    Units end before a space, a line end, or a mark after a letter: places that
    no pre-token crosses.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        how, model, added = t.pre_tokenizer, t.model, t.get_added_tokens_decoder().values()
        if type(how).__name__ != "ByteLevel" or not how.use_regex or how.add_prefix_space or t.normalizer is not None:
            raise ValueError(f"{path}: texts can be cut into units only for byte-level pre-tokens without a normalizer or prefix space")
        if type(model).__name__ != "BPE" or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
            raise ValueError(f"{path}: not a plain BPE model")
        if any(a.lstrip or a.rstrip or a.single_word or a.normalized or any(c.isspace() for c in a.content) for a in added):
            raise ValueError(f"{path}: an added token reaches beyond its own characters or holds white space")
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.heads = UnitCache(self.fill, CACHE_UNITS // 8)
        self.tails = UnitCache(lambda units: self.fill([u if u[:1] == "\n" else u[1:] if u[:1] == "\x01" else " " + u for u in units]))

    def values_of(self, ids: list[int], bounds: list[int]) -> list:
        """What is kept of the ids of each unit of several: here the packed ids."""
        raw, width = np.array(ids, self.dtype).tobytes(), self.dtype.itemsize
        return [raw[a * width : b * width] for a, b in zip(bounds, bounds[1:])]

    def fill(self, units: list[str]) -> list:
        """Merges units: plain words many at a time, others alone."""
        out: list = [None] * len(units)
        words = [i for i, u in enumerate(units) if plain(u)]
        groups = [words[k : k + _TOGETHER] for k in range(0, len(words), _TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join([units[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            cuts = [0, *(np.flatnonzero(np.diff(np.array(e.word_ids, np.int64))) + 1).tolist(), len(ids)]
            if len(cuts) == len(group) + 1:
                for i, value in zip(group, self.values_of(ids, cuts)):
                    out[i] = value
        rest = [i for i, v in enumerate(out) if v is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            ids = e.ids
            out[i] = self.values_of(ids, [0, len(ids)])[0]
        return out

    def values(self, column: pa.Array) -> tuple[list, np.ndarray, Cut, dict[int, list]]:
        """Values of distinct units, those of each text by place, the cut, and the values of odd texts' units."""
        cut = Cut(column, _ODD, marks=MARKS)
        values, at = self.tails.look_up(cut.units), cut.at.copy()
        at[cut.bounds[:-1]] = len(values) + np.arange(len(cut.firsts))
        values = values + self.heads.look_up(cut.firsts)
        odd = {int(i): self.heads.look_up(cut_with_care(column[int(i)].as_py())) for i in cut.odd}
        return values, at, cut, odd

    def encode(self, column: pa.Array, end: bytes = b"") -> list[bytes]:
        """Packed ids of each text, followed by ``end``."""
        if not len(column):
            return []
        values, at, cut, odd = self.values(column)
        out = [ids + end for ids in concatenated(values, at, cut.bounds, self.dtype)]
        for i, own in odd.items():
            out[i] = b"".join(own) + end
        return out


_coders: dict = {}


def coder(kind: type, path: str):
    """The one coder of a worker process for a file: its caches serve all tasks of this kind that the worker runs in a row."""
    key = (kind, path)
    if key not in _coders:
        _coders[key] = kind(path)
    hold(key, lambda: _coders.pop(key, None))
    return _coders[key]
