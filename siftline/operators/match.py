"""Pattern rules as one native projection.

Each rule becomes literal expressions over the text: all matches, with offsets
rebuilt from the pieces between them, so a text is read once whatever the
number of rules, without a join or a user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.sources.packs import Rule, rules_table

#: Columns of findings, in order.
FINDING = (
    "rule_id rule_name severity severity_rank confidence message description recommendation category language framework cwe owasp "
    "code_snippet fingerprint path start_char start_byte start_line start_column end_line end_column ord match_text"
).split()


def unicode(pattern: str) -> str:
    """Classes of a pattern as Unicode ones, as in the rules' own dialect."""
    return "(?U)" + pattern


#: Matches that are numbered together; lists grow by copies, so whole texts are not done at once.
CHUNK = 64

_MATCH = "rule_ord int, ord int, start_char int, match_text string, start_byte long, start_line long, start_column long, code_snippet string"


def _type(fields: str) -> str:
    """The type of an array of structs of some fields."""
    return "array<struct<" + ",".join(f.strip().replace(" ", ":") for f in fields.split(",")) + ">>"


# The walk along a text's matches, as SQL: characters (n), bytes (b) and line ends (k) up to a place, and characters of its line before it (t).
_EXTENT = "named_struct('n', length({0}), 'b', octet_length({0}), 'k', length({0}) - length(replace({0}, char(10), '')), 't', length(substring_index({0}, char(10), -1)))"
_BOTH = "named_struct('n', x.g.n + x.m.n, 'b', x.g.b + x.m.b, 'k', x.g.k + x.m.k, 't', IF(x.m.k > 0, x.m.t, x.g.t + x.m.n))"
_AFTER = "named_struct('n', {0}.n + {1}.n, 'b', {0}.b + {1}.b, 'k', {0}.k + {1}.k, 't', IF({1}.k > 0, {1}.t, {0}.t + {1}.n))"


def _walk(read: str, rule_ord: int, around: bool) -> str:
    """SQL for the array of matches of a rule, from a column with the pieces that :func:`_read` has cut a text into.

    Extents of the pieces between matches are added up chunk by chunk, and lines are cut once, so the work is in proportion to
    the text and its matches.  What several expressions use is bound by a transform of an array of one.
    """
    pieces = f"""zip_with(slice(r.gaps, 1, size(r.found)), r.found, (g, m) -> named_struct('g', {_EXTENT.format('g')}, 'm', {_EXTENT.format('m')}, 'text', m))"""
    parts = f"""transform({read}, r -> named_struct('lines', r.lines, 'parts', transform({pieces}, x -> named_struct('g', x.g, 'both', {_BOTH}, 'ends', x.m.k, 'text', x.text))))"""
    chunks = f"""transform({parts}, r -> named_struct('lines', r.lines, 'chunks', transform(sequence(0, greatest(CAST(floor((size(r.parts) - 1) / {CHUNK}) AS INT), 0)), c -> named_struct('first', c * {CHUNK}, 'parts', slice(r.parts, c * {CHUNK} + 1, {CHUNK})))))"""
    starts = f"""aggregate(r.chunks, named_struct('at', named_struct('n', 0, 'b', 0, 'k', 0, 't', 0), 'out', CAST(array() AS {_type('n int, b int, k int, t int')})),
                 (a, c) -> named_struct('at', aggregate(c.parts, a.at, (s, x) -> {_AFTER.format('s', 'x.both')}), 'out', concat(a.out, array(a.at))), a -> a.out)"""
    lines = ", 'around', array_join(slice(r.lines, a.at.k + x.g.k + 1, x.ends + 1), char(10))" if around else ""
    row = f"""named_struct('rule_ord', {rule_ord}, 'ord', c.first + size(a.out), 'start_char', a.at.n + x.g.n, 'match_text', x.text, 'start_byte', CAST(a.at.b + x.g.b AS BIGINT), 'start_line', CAST(a.at.k + x.g.k + 1 AS BIGINT),
              'start_column', CAST(IF(x.g.k > 0, x.g.t, a.at.t + x.g.n) + 1 AS BIGINT), 'code_snippet', element_at(r.lines, a.at.k + x.g.k + 1){lines})"""
    rows = f"""aggregate(c.parts, named_struct('at', at, 'out', CAST(array() AS {_type(_MATCH + (', around string' if around else ''))})),
               (a, x) -> named_struct('at', {_AFTER.format('a.at', 'x.both')}, 'out', concat(a.out, array({row}))), a -> a.out)"""
    return f"flatten(transform({chunks}, r -> flatten(zip_with(r.chunks, {starts}, (c, at) -> {rows}))))"


def _read(rule: Rule, classes) -> Column:
    """An array of one with all matches of a rule in a row's text, the pieces between them, and the text's lines; empty if it has none."""
    text, pattern = F.col("text"), classes(rule.regex)
    applies = F.col("language").isin([x for x in {*rule.languages, "tsx"} if rule.applies(x)])
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"), F.split(text, "\n", -1).alias("lines"))
    return F.when(applies & text.rlike(pattern), F.array(cut)).otherwise(F.array().cast("array<struct<found:array<string>,gaps:array<string>,lines:array<string>>>"))


def matches(corpus: DataFrame, rules: list[Rule], unicode_classes: bool = True) -> DataFrame:
    """(file_id, path, language, rule_ord, ord, start_char, match_text, start_byte, start_line, start_column, code_snippet) of every match of every applicable rule.

    ``corpus``: file_id, path, language, text; null texts have no matches.  Patterns don't match empty text.  Places are known
    before matches become rows, so no row carries a text; ``code_snippet`` is the line that a match begins on.
    """
    classes = unicode if unicode_classes else str
    own = [(i, r) for i, r in enumerate(rules) if r.capability == "pattern"]
    read = corpus.select("file_id", "path", "language", *[_read(r, classes).alias(f"read_{i}") for i, r in own])
    found = []
    for i, r in own:
        rows = F.expr(_walk(f"read_{i}", i, r.not_regex is not None))
        if r.not_regex is not None:  # not where the lines that a match touches hold it
            unwanted = classes(r.not_regex)
            rows = F.filter(rows, lambda m: ~m["around"].rlike(unwanted))
            rows = F.transform(rows, lambda m: F.struct(*[m[f.split()[0]].alias(f.split()[0]) for f in _MATCH.split(", ")]))
        found.append(rows)
    all_ = F.flatten(F.array(*found)) if found else F.array().cast(_type(_MATCH))
    return read.select("file_id", "path", "language", F.explode(all_).alias("m")).select("file_id", "path", "language", "m.*")


def locate(found: DataFrame) -> DataFrame:
    """Adds end_line and end_column, and trims the snippets.

    The end is on the start's line, at its column plus the match's bytes.
    """
    return found.withColumns(
        {
            "end_line": F.col("start_line"),
            "end_column": F.col("start_column") + F.octet_length("match_text"),
            "code_snippet": F.regexp_replace("code_snippet", r"^(?U:\s)+|(?U:\s)+$", ""),
        }
    )


def findings(corpus: DataFrame, rules: list[Rule], unicode_classes: bool = True) -> DataFrame:
    """Findings of the pattern rules; ``file_id`` and then the columns of FINDING."""
    located = locate(matches(corpus, rules, unicode_classes))
    return describe(located.withColumn("message", F.lit(None).cast("string")), rules)


def describe(located: DataFrame, rules: list[Rule]) -> DataFrame:
    """Joins what rules say onto located matches (with rule_ord), and fingerprints them."""
    return fingerprinted(described(located, rules))


def described(located: DataFrame, rules: list[Rule], *more: str) -> DataFrame:
    """:func:`describe` without fingerprints, and with further columns."""
    table = rules_table(located.sparkSession, rules).drop("languages", "capability", "pack")
    joined = located.join(F.broadcast(table), "rule_ord")
    first = {r.id: r.languages[0] for r in rules}
    language = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("rule_id")] if first else F.lit(None)
    full = joined.withColumns(
        {
            "message": F.coalesce("message", "rule_name"),
            "language": language,
        }
    )
    return full.select("file_id", *[c for c in FINDING if c != "fingerprint"], *more)


def fingerprinted(found: DataFrame, *more: str) -> DataFrame:
    """``found`` with fingerprints: ``file_id``, the columns of FINDING, and further ones."""
    identity = X.fingerprint(F.col("rule_id"), F.col("path"), F.col("code_snippet"), F.col("start_line"), F.col("start_column"))
    return found.withColumn("fingerprint", identity).select("file_id", *FINDING, *more)
