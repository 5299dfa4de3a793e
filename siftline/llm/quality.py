"""Quality rules compiled into one Spark projection.

A rule is a row of a threshold table: a measure, a comparison and a bound.  The
table is compiled into column expressions over one set of per-row measures, so
a corpus is judged in a single narrow projection: no user function, no shuffle,
no second pass.

Defined results
    null or empty text   no words: every measure is 0, ``base_failed`` is true
    very long text       whole text is measured; all work is O(n log n) in it
    repeated rows, ties  each row is judged alone, so equal rows get equal results
    empty table          empty result
    clashing columns     the input's columns pass through; the one added column
                         (``quality`` by default) replaces one of that name
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, \n, \v, \f and \r.
WORD = r"[^ \t-\r]+"
#: Everything but the symbols #*$%&|<> .
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8

# Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the of and to in a is that for it was on with by at from an are be this or as "
    "der die und zu den mit von das ist ein nicht sich auf für im "
    "le la de et les des un une que est pour dans du en qui sur par pas "
    "el los las y por con para no se del una como"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a row whose ``measure`` is below ``low`` or above ``high``."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Measures at or inside the bounds pass.  Ratios of a text without words are 0.
RULES = (
    Rule("length", "n_words", low=20, high=1_000_000),
    Rule("word_length", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
    Rule("repeated_words", "repeat_word_ratio", high=0.3),
)


def _repeat_words(hashes: str) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Equal windows are neighbours once (hash, start) pairs are sorted; as all
    windows have one length, the words they cover follow from the gaps between
    their sorted starts.
    """
    return F.expr(f"""
        IF(size(array_distinct({hashes})) = size({hashes}), 0L,
           aggregate(
             transform(
               array(array_sort(transform(filter(
                 transform(array(array_sort(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))),
                           z -> transform(z, (s, k) -> named_struct(
                             'i', s.i,
                             'twice', (k > 0 AND s.h = z[IF(k > 0, k - 1, 0)].h)
                                   OR (k < size(z) - 1 AND s.h = z[IF(k < size(z) - 1, k + 1, k)].h))))[0],
                 s -> s.twice), s -> s.i))),
               p -> aggregate(
                 transform(p, (x, k) -> IF(k = 0, {WINDOW}, least({WINDOW}, x - p[IF(k > 0, k - 1, 0)]))),
                 0L, (a, x) -> a + x)),
             0L, (a, x) -> a + x))
    """)


def measure(docs: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column of measures of each whole text."""
    keep = [c for c in docs.columns if c != out]
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"),  # so that no name of theirs clashes
        text.alias("__t"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("__l"),
    )
    hashed = split.withColumn(
        "__h",
        F.expr(f"""IF(size(__w) < {WINDOW}, CAST(array() AS array<bigint>),
                   transform(sequence(1, greatest(1, size(__w) - {WINDOW - 1})), i -> xxhash64(slice(__w, i, {WINDOW}))))"""),
    )
    stops = F.filter(F.col("__w"), lambda x: F.lower(x).isin(*STOP_WORDS))
    counted = hashed.select(
        "__row",
        F.size("__w").cast("long").alias("__n"),
        F.length(F.concat_ws("", "__w")).cast("long").alias("__c"),
        F.length(F.regexp_replace("__t", NOT_SYMBOL, "")).cast("long").alias("__s"),
        F.size(stops).cast("long").alias("__k"),
        F.size("__l").cast("long").alias("__ln"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__d"),
        _repeat_words("__h").alias("__r"),
    )
    n, c, s, k, ln, d, r = (F.col(x) for x in ("__n", "__c", "__s", "__k", "__ln", "__d", "__r"))
    return counted.select(
        *[F.col("__row").getField(x).alias(x) for x in keep],
        F.struct(
            n.alias("n_words"),
            c.alias("word_chars"),
            s.alias("n_symbols"),
            d.alias("n_dup_lines"),
            r.alias("n_repeat_words"),
            ratio(c, n).alias("mean_word_chars"),
            ratio(s, n).alias("symbol_ratio"),
            ratio(k, n).alias("stop_word_ratio"),
            ratio(d, ln).alias("dup_line_ratio"),
            ratio(r, n).alias("repeat_word_ratio"),
            ((n < 20) | (100 * r > 30 * n)).alias("base_failed"),
        ).alias(out),
    )


def failed_rules(rules: tuple[Rule, ...] = RULES, out: str = "quality") -> Column:
    """The threshold table as one expression: the names of the rules a row fails."""
    tests = []
    for rule in rules:
        m = F.col(f"`{out}`.`{rule.measure}`")
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (m < rule.low)
        if rule.high is not None:
            bad = bad | (m > rule.high)
        tests.append(F.when(bad, F.lit(rule.name)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """``docs`` with measures, ``failed`` (rule names) and ``kept`` in the struct ``out``."""
    measured = measure(docs, text_col, out)
    struct = F.col(f"`{out}`")
    failed = measured.withColumn(out, struct.withField("failed", failed_rules(rules, out)))
    return failed.withColumn(
        out, struct.withField("kept", ~struct["base_failed"] & (F.size(struct["failed"]) == 0))
    )
