"""Token counts with a whole-token shortcut.

Most pre-tokens of ordinary text are themselves entries of the vocabulary.
:func:`whole_tokens` proves, once per tokenizer and worker, which vocabulary
strings the library encodes alone as exactly one id.  Counting a text is then: cut it into
units, cut new units into pre-tokens, count each proven pre-token as one, and
merge only the rest with the library.

Defined results
    null or empty text   0 bytes, 0 tokens
    very long text       counted whole, in memory proportional to the text
    repeated rows, ties  each row is counted alone
    empty table          empty result
    clashing columns     input columns pass through; the added columns replace
                         ones of their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.shared import fresh, slices, tidy
from siftline.llm.units import STABLE, UNIT_SLICE, ByteBpe, coder, plain

def whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that the library encodes alone as one id that is not an added token."""
    added = set(tokenizer.get_added_tokens_decoder())
    ids = [i for i in range(tokenizer.get_vocab_size()) if i not in added]
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    proven = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for i, t, e in zip(ids, texts, proven, strict=True) if e.ids == [i])


# Fixed value: the pre-token pattern of the library's byte-level pre-tokenizer, the only one that is accepted.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpeCounter(ByteBpe):
    """Numbers of tokens of texts under a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        super().__init__(path)
        self.whole = whole_tokens(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PRE_TOKEN).findall

    def values_of(self, ids: list[int], bounds: list[int]) -> list[int]:
        return [b - a for a, b in zip(bounds, bounds[1:])]

    def fill(self, units: list[str]) -> list[int]:
        """Counts whole tokens as one each; merges the other pre-tokens.

        Units of other scripts, or with an added token, are merged whole.
        """
        counts, where = [0] * len(units), {}
        for k, unit in enumerate(units):
            if unit in self.whole:
                counts[k] = 1
            elif plain(unit) or not unit.isascii() and max(unit) > STABLE or any(s in unit for s in self.special):
                where.setdefault(unit, []).append(k)
            else:
                for p in self.cut(unit):
                    if p in self.whole:
                        counts[k] += 1
                    else:
                        where.setdefault(p, []).append(k)
        for places, n in zip(where.values(), super().fill(list(where)), strict=True):
            for k in places:
                counts[k] += n
        return counts

    def count(self, column: pa.Array) -> list[int]:
        if not len(column):
            return []
        values, at, cut, odd = self.values(column)
        counts = np.add.reduceat(np.array(values, np.int64)[at], cut.bounds[:-1])
        for i, own in odd.items():
            counts[i] = sum(own)
        return counts.tolist()


class PieceCounter:
    """Numbers of tokens of texts under a sentencepiece model, by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, column: pa.Array) -> list[int]:
        return [len(ids) for ids in self.model.encode(column.to_pylist(), num_threads=1)]


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit for each whole text.

    ``path`` is a .json file of the tokenizers library or a .model file of
    sentencepiece, present at that path on every executor.
    """
    own = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own or c == text_col])
    names = [fresh("__n_bytes", docs.columns), fresh("__n_tokens", docs.columns)]
    counts = T.StructType([T.StructField(c, T.LongType()) for c in names])
    schema = T.StructType(kept.schema.fields + counts.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = coder(PieceCounter if path.endswith(".model") else ByteBpeCounter, path)
        for batch in batches:
            for part in slices(batch, text_col, UNIT_SLICE):
                col = part.column(part.schema.get_field_index(text_col))
                n_bytes = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
                n_tokens = pa.array(counter.count(pc.fill_null(col, "")), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n_bytes, n_tokens], [*part.schema.names, *names])

    out = kept.mapInArrow(tidy(run), schema)
    return out.select(
        *[F.col(f"`{c}`") for c in kept.columns if c not in own],
        F.col(names[0]).alias("n_bytes"),
        F.col(names[1]).alias("n_tokens"),
        (F.col(names[1]) > limit).alias("over_limit"),
    )
