"""Language identification by Bayesian fusion of evidence.

For every document four pieces of evidence are combined: the likelihood of its
text under byte-trigram models of the languages, the language its markup
declares, the country suffix of its address, and a prior of its host.  Host
priors are counts of languages that text and declaration favour, from grouped
aggregation, smoothed towards the host's domain, that towards its suffix, and
that towards the whole corpus.

The text models are fitted on about ``SAMPLE`` labelled rows a language at most;
everything else covers all rows and all labels.  Text runs through numpy once,
in Arrow batches, where evidence is added up; priors are native.

The languages are a closed set, so one of them is always the likeliest.  A text
counts as evidence only where its best language exceeds a background model: the
same letters in no order, or any trigram as likely as any other, whichever is
the more likely for each trigram.

Defined results
    null or empty text, or one     no text evidence; rejected unless markup or address
    without letters                names a known language
    text in no known language      rejected unless its markup declares a known one
    more labels than MOST_LABELS   an error; no label is left out
    very long text                 whole
    null address or label          no such evidence; null labels are not sampled
    repeated rows, ties            each row is judged alone; equal posteriors: the
                                   language that sorts first
    empty table, or no labels      empty result, or every row rejected
    clashing columns               only id, text, label and address are read
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import Scratch, materialise, slices, tidy, told_apart, without
from siftline.llm.wordarrays import LOWER, buffer_of
from siftline.session import ship

#: Labelled rows a language that the text models are fitted on, on average at most.
SAMPLE = 1_000
#: Classes that byte trigrams are hashed into.
GRAMS = 1 << 15
#: Trigrams overlap and repeat; their joint weight is that of this share of them, up to a limit.
SHARE, LIMIT = 0.2, 60.0
#: Chance that declared markup, or a country suffix, names the true language.
DECLARED, SUFFIX = 0.9, 0.6
#: Observations that a parent's prior is worth.
SMOOTHING = 10.0
LEAST = 0.4
#: Most languages; the models of a worker take 128 KB each.
MOST_LABELS = 512

# Languages by country suffix.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}

_DECLARED = r"""(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})"""


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each trigram with a letter in it, as one number; number of those in each text)."""
    raw, offsets = buffer_of(column)
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    data = np.where(letter[LOWER[raw]], LOWER[raw], np.uint8(32)).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    use = code != 0x202020
    for end in offsets[1:-1].tolist():  # not across texts
        use[max(0, end - 2) : end] = False
    run = np.concatenate([[0], np.cumsum(use)])
    count = np.diff(run[np.minimum(offsets, len(use))])
    return code[use], count


def _classes(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def background(count: np.ndarray) -> np.ndarray:
    """Log likelihoods [GRAMS] that a language's must exceed: of letters in no order, by bytes' ``count``, or of any class as likely as any other."""
    share = count / max(1, count.sum())
    rest = np.arange(1 << 16, dtype=np.uint32)
    pairs = np.outer(share, share).ravel()
    total = np.zeros(GRAMS)
    for first in np.flatnonzero(share).tolist():
        total += np.bincount(_classes(np.uint32(first << 16) | rest), weights=share[first] * pairs, minlength=GRAMS)
    return np.log(np.maximum(total, 1 / GRAMS))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods [languages and the background, GRAMS]) from rows (key, text, label); every label is a language."""
    known = labelled.filter("label IS NOT NULL AND label != ''")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("label").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels; models of so many languages don't fit into a worker")
    if not counts:
        return [], np.zeros((0, GRAMS), np.float32)
    languages = sorted(counts)
    number = {x: k for k, x in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / counts[k]))])[F.col("label")]
    chosen = known.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < share * 1_000_003).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                code, n = _codes(part.column(1))
                who = np.repeat([number[x] for x in part.column(0).to_pylist()], n)
                key, times = np.unique(who * GRAMS + _classes(code), return_counts=True)
                byte, again = np.unique(code >> 8 & 255, return_counts=True)
                who, gram = np.divmod(np.concatenate([key, -GRAMS + byte.astype(np.int64)]), GRAMS)  # -1: bytes of them all
                yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(np.concatenate([times, again]))], ["who", "gram", "n"])

    found = chosen.mapInArrow(tidy(count), "who int, gram int, n long").groupBy("who", "gram").agg(F.sum("n").alias("n")).toArrow()
    who, gram, n = (found.column(k).to_numpy() for k in ("who", "gram", "n"))
    table = np.empty((len(languages) + 1, GRAMS), np.float32)
    order = np.argsort(who, kind="stable")
    cut = np.searchsorted(who[order], np.arange(-1, len(languages) + 1))
    for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        row = np.full(GRAMS, 0.5 if k else 0.0)
        row[gram[order[a:b]]] += n[order[a:b]]
        table[k - 1] = np.log(row / row.sum()) if k else background(row[:256])
    return languages, table


def _scores(column: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihoods [texts, languages]; whether a text has trigrams; whether its best language exceeds the background)."""
    code, count = _codes(column)
    gram = _classes(code)
    total = np.zeros((len(count), len(model)))
    some = np.flatnonzero(count)
    if len(some):
        begin = (np.cumsum(count) - count)[some]
        for k, row in enumerate(model):  # one language at once: memory doesn't grow with their number
            total[some, k] = np.add.reduceat(row[gram], begin, dtype=np.float64)
    bar, total = total[:, -1], total[:, :-1]
    best = total.max(axis=1)
    weight = np.minimum(SHARE, LIMIT / np.maximum(count, 1))[:, None]
    return np.where(count[:, None] > 0, (total - best[:, None]) * weight, 0.0), count > 0, (count > 0) & (best > bar)


def _sharp(named: list[str | None], languages: list[str], trust: float) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods of named languages: ``trust`` on each, the rest on all others, flat if it is none of them; whether it is one)."""
    number = {x: k for k, x in enumerate(languages)}
    at = np.array([number.get(x, -1) for x in named], np.int64)
    out = np.where(at[:, None] >= 0, math.log((1 - trust) / max(1, len(languages) - 1)), np.zeros((1, len(languages))))
    known = np.flatnonzero(at >= 0)
    out[known, at[known]] = math.log(trust)
    return out, at >= 0


def _array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _best(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str | None = "lang", address_col: str | None = "source", model: tuple[list[str], np.ndarray] | None = None, least: float = LEAST) -> DataFrame:
    """(id, language, confidence, declared, host, kept) for every row; without evidence it is the corpus's main one, at its share, and not kept.

    A row is kept where its confidence reaches ``least`` and it shows a language itself: its text exceeds the background
    model, or its markup declares a known language, or there is no text to judge and its address has a country's suffix.

    ``model``: what :func:`fit` returned; fitted on ``label_col`` of the rows themselves by default.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("key"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        (F.col(f"`{label_col}`") if label_col else F.lit(None).cast("string")).alias("label"),
        (F.col(f"`{address_col}`") if address_col else F.lit(None).cast("string")).alias("address"),
    )
    languages, table = model or fit(rows)
    if not languages:
        return rows.select(F.col("key").alias(id_col), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit("").alias("declared"), F.lit("").alias("host"), F.lit(False).alias("kept"))
    n = len(languages)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    key_type = rows.schema["key"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("address", F.lit("")), r"^(?:[^:/?#]+://)?([^/?#:]*)", 1))
    named = rows.select("key", host.alias("host"), F.lower(F.regexp_extract("text", _DECLARED, 1)).alias("declared"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                own, some, fits = _scores(part.column(3), shared.value)
                by_markup, declared = _sharp(part.column(2).to_pylist(), languages, DECLARED)
                ends = [SUFFIXES.get(x.rpartition(".")[2]) if "." in x else None for x in part.column(1).to_pylist()]
                by_address, suffixed = _sharp(ends, languages, SUFFIX)
                own += by_markup + by_address
                shown = fits | declared | (suffixed & ~some)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * n, pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], flat, pa.array(own.argmax(axis=1), pa.int32()), pa.array(shown)], ["key", "host", "declared", "own", "best", "shown"])

    fused = materialise(named.mapInArrow(tidy(score), f"key {key_type}, host string, declared string, own array<double>, best int, shown boolean"), "scores")
    seen = fused.filter("shown").groupBy("host").agg(*[F.count_if(F.col("best") == k).alias(f"n{k}") for k in range(n)])
    priors = host_priors(seen, n)
    joined = fused.join(priors, "host", "left")
    everywhere = F.coalesce("prior", _array([-math.log(n)] * n))
    final = joined.select("key", "host", "declared", "shown", _add(F.col("own"), everywhere).alias("post")).withColumn("top", F.array_max("post"))
    mass = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = final.select(
        F.col("key").alias(id_col),
        F.element_at(F.array(*[F.lit(x) for x in languages]), _best(F.col("post")) + 1).alias("language"),
        F.round(1.0 / mass, 6).alias("confidence"),
        "declared",
        "host",
        "shown",
    )
    return out.withColumn("kept", F.col("shown") & (F.col("confidence") >= least)).drop("shown")


def host_priors(counts: DataFrame, n: int) -> DataFrame:
    """(host, prior: log priors) from language counts (host, n0, n1, ...), smoothed host < domain < suffix < corpus."""
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(n)]
    named = counts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    named = materialise(named, "hosts")
    corpus = named.agg(*sums).first()
    total = sum(x or 0 for x in corpus)
    top = [((x or 0) + SMOOTHING / n) / (total + SMOOTHING) for x in corpus]

    def smooth(prefix: str, parent: Column) -> Column:
        own = F.array(*[F.col(f"{prefix}{k}") for k in range(n)])
        return F.zip_with(own, parent, lambda x, p: (x + SMOOTHING * p) / (F.col(f"{prefix}_size") + SMOOTHING))

    def size(prefix: str) -> Column:
        return F.aggregate(F.array(*[F.col(f"{prefix}{k}") for k in range(n)]), F.lit(0).cast("long"), lambda a, x: a + x).alias(f"{prefix}_size")

    by_suffix = named.groupBy("suffix").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in range(n)])
    by_domain = named.groupBy("domain").agg(*[F.sum(f"n{k}").alias(f"d{k}") for k in range(n)])
    full = named.join(by_domain.select("*", size("d")), "domain").join(by_suffix.select("*", size("s")), "suffix").select("*", size("n"))
    own = smooth("n", smooth("d", smooth("s", _array(top))))
    return full.select("host", F.transform(own, lambda x: F.log(x)).alias("prior"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose language stays unknown.

    Rows are rejected by id; where several texts share an id, each by its own text.
    """
    apart, name, _ = told_apart(docs, id_col, text_col)
    with Scratch(ship(docs.sparkSession)) as scratch:
        rejected = scratch.keep(identify(apart, name, text_col, **options).filter("NOT kept").select(name).distinct())
    return without(apart, rejected, name).select(*[F.col(f"`{c}`") for c in docs.columns])
