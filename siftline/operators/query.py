"""Syntax-tree queries: a pattern of nested node kinds with captures and text predicates.

The pattern is compiled once; files are parsed in Arrow batches.  Supported are
nested kinds, ``field:`` prefixes, ``!field``, ``@captures``, the supertype
``(expression)``, the wildcards ``(_)`` and ``_``, alternations ``[...]``, the
quantifiers ``? * +``, the anchor ``.`` (first, last or next named child) and the
predicates ``#eq? #not-eq? #match? #not-match? #any-of? #not-any-of?``.  Children
are matched in order; quantifiers take as many as they can.  A broken query is never silent: it gives a finding
``<rule>:query-error`` at 1:1 of each file it is for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import match
from siftline.session import ship
from siftline.sources import syntax as S
from siftline.sources.packs import Rule


@dataclass
class Pattern:
    kind: str = "_"
    captures: list[str] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    last: bool = False  # an anchor stands behind the last part
    choices: list[Pattern] = field(default_factory=list)


@dataclass
class Part:
    """A child's pattern: its field, how often it may occur, and whether nothing may stand before it."""

    pattern: Pattern
    name: str | None = None
    times: str = ""
    next: bool = False


class QueryError(ValueError):
    pass


_PART = re.compile(r'\s+|;[^\n]*|(?P<t>[()\[\]?*+]|@[\w.-]+|#[\w-]+\?|![\w]+|[\w]+:|"(?:\\.|[^"\\])*"|\.(?!\w)|[\w][\w.]*)')


@lru_cache(maxsize=1024)
def compile_query(text: str) -> tuple[list[Pattern], list[tuple[str, list[str]]]]:
    """(patterns, predicates) of a query's text."""
    tokens, i = [], 0
    while i < len(text):
        m = _PART.match(text, i)
        if not m:
            raise QueryError(f"unexpected character at {i}")
        if m["t"]:
            tokens.append(m["t"])
        i = m.end()
    patterns, predicates, at = [], [], 0
    token = lambda k: tokens[k] if k < len(tokens) else ""

    def node(k: int) -> tuple[int, Pattern, str]:
        """(place behind, pattern, quantifier) of the element at a place."""
        if token(k) == "_":
            k, p = k + 1, Pattern()
        elif token(k) == "[":
            k, p = k + 1, Pattern()
            while token(k) not in ("]", ""):
                k, choice, times = node(k)
                if times:
                    raise QueryError("a quantifier inside an alternation")
                p.choices.append(choice)
            if not token(k) or not p.choices:
                raise QueryError("a bracket is not closed, or empty")
            k += 1
        elif token(k) == "(" and re.match(r"\w", token(k + 1)):
            k, p = inner(k + 2, Pattern(token(k + 1)))
        else:
            raise QueryError("a node is needed")
        times = token(k) if token(k) in ("?", "*", "+") else ""
        k += bool(times)
        while token(k).startswith("@"):
            p.captures.append(token(k)[1:])
            k += 1
        return k, p, times

    def inner(k: int, p: Pattern) -> tuple[int, Pattern]:
        anchor = False
        while token(k) != ")":
            if not token(k):
                raise QueryError("a parenthesis is not closed")
            if token(k).startswith("#"):
                k = predicate(k - 1)
            elif token(k) == "(" and token(k + 1).startswith("#"):
                k = predicate(k)
            elif token(k).startswith("!"):
                p.absent.append(token(k)[1:])
                k += 1
            elif token(k) == ".":
                anchor, k = True, k + 1
            else:
                name = token(k)[:-1] if token(k).endswith(":") else None
                k, child, times = node(k + (name is not None))
                p.parts.append(Part(child, name, times, anchor))
                anchor = False
        p.last = anchor
        return k + 1, p

    def predicate(k: int) -> int:
        if ")" not in tokens[k:]:
            raise QueryError("a parenthesis is not closed")
        end = tokens.index(")", k)
        predicates.append((tokens[k + 1][1:-1], [t[1:-1] if t.startswith('"') else t for t in tokens[k + 2 : end]]))
        return end + 1

    while at < len(tokens):
        if tokens[at] == "(" and tokens[at + 1 : at + 2] and tokens[at + 1].startswith("#"):
            at = predicate(at)
        else:
            at, p, _ = node(at)
            patterns.append(p)
    if not patterns:
        raise QueryError("no pattern")
    for name, args in predicates:
        if name in ("match", "not-match"):
            re.compile(args[1])
    return patterns, predicates


def _is(n: S.Node, kind: str) -> bool:
    return kind in (n.kind, "_") or kind == "expression" and not n.kind.endswith(("statement", "definition", "declaration", "block"))


Captures = dict[str, tuple[S.Node, ...]]


def _joined(a: Captures, b: Captures) -> Captures:
    return a | {k: a.get(k, ()) + v for k, v in b.items()}


def _matches(n: S.Node, p: Pattern) -> Iterator[Captures]:
    """Captures of each way that a node and its children fit a pattern."""
    own = {c: (n,) for c in p.captures}
    if p.choices:
        yield from (_joined(own, c) for choice in p.choices for c in _matches(n, choice))
    elif _is(n, p.kind) and not any(f in n.fields for f in p.absent):
        yield from (_joined(own, c) for c in _children(n, p, 0, 0))


def _children(n: S.Node, p: Pattern, k: int, at: int) -> Iterator[Captures]:
    """Captures of the parts from the k-th on, in the children from a place on."""
    if k == len(p.parts):
        if not (p.last and at < len(n.children)):
            yield {}
        return
    part = p.parts[k]
    if part.name:  # a field has its own place
        held = n.fields.get(part.name)
        place = next((i for i, c in enumerate(n.children) if c is held), at - 1)
        ways = list(_matches(held, part.pattern)) if held is not None and not (part.next and place != at) else []
        for c in ways:
            yield from (_joined(c, rest) for rest in _children(n, p, k + 1, max(at, place + 1)))
        if not ways and part.times in ("?", "*"):
            yield from _children(n, p, k + 1, at)
        return
    some = False
    for i in range(at, at + 1 if part.next else len(n.children)):
        for c in _matches(n.children[i], part.pattern) if i < len(n.children) else ():
            some, j = True, i + 1
            if part.times in ("*", "+"):  # as many of the next children as fit
                while j < len(n.children) and (more := next(_matches(n.children[j], part.pattern), None)) is not None:
                    c, j = _joined(c, more), j + 1
            yield from (_joined(c, rest) for rest in _children(n, p, k + 1, j))
        if some and part.times in ("*", "+"):
            break
    if not some and part.times in ("?", "*"):
        yield from _children(n, p, k + 1, at)


def _passes(tree: S.Tree, captures: Captures, predicates: list[tuple[str, list[str]]]) -> bool:
    """Predicates on captured text, of every node that a capture holds; one on an absent capture fails, its negative form passes; unknown ones pass."""
    for name, args in predicates:
        if name.removeprefix("not-") not in ("eq", "match", "any-of"):
            continue
        nodes = captures.get(args[0][1:], ())
        if not nodes and not name.startswith("not-"):
            return False
        values = [tree.text(captures[a[1:]][0]) if a.startswith("@") and captures.get(a[1:]) else a for a in args[1:]]
        for text in map(tree.text, nodes):
            ok = re.search(values[0], text) is not None if name.endswith("match") else text in values
            if ok == name.startswith("not-"):
                return False
    return True


def sites(tree: S.Tree, rule: Rule) -> Iterator[S.Node]:
    """Nodes that a query rule reports: its anchor, or every capture; each span once."""
    patterns, predicates = compile_query(rule.query)
    seen = set()
    for n in tree.root.walk():
        for p in patterns:
            for captures in _matches(n, p):
                if not _passes(tree, captures, predicates):
                    continue
                for x in captures.get(rule.anchor, ()) if rule.anchor else [x for held in captures.values() for x in held]:
                    if (x.start, x.end) not in seen and not (rule.query_not_regex and re.search(rule.query_not_regex, tree.text(x))):
                        seen.add((x.start, x.end))
                        yield x


_LOCATED = "file_id long, rule_ord int, path string, language string, start_char long, start_byte long, start_line long, start_column long, end_line long, end_column long, ord int, match_text string, code_snippet string, message string"


def findings(corpus: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of query rules; ``file_id`` and then the columns of FINDING."""
    ship(corpus.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _LOCATED.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in _LOCATED.split(", ")]
        for batch in batches:
            rows = []
            for file_id, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = [(i, r) for i, r in enumerate(rules) if r.capability == "query" and r.applies(language)]
                if not own or text is None:
                    continue
                tree = S.Tree(text, language)
                for i, r in own:
                    try:
                        for k, n in enumerate(sites(tree, r)):
                            (at, line, column), (_, end_line, end_column) = tree.position(n.start), tree.position(n.end)
                            rows.append((file_id, i, path, language, n.start, at, line, column, end_line, end_column, k, tree.text(n), tree.line_text(n.start), None))
                    except (QueryError, re.error) as e:
                        rows.append((file_id, i, path, language, 0, 0, 1, 1, 1, 1, 0, "", "", f"query error: {e}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    described = match.describe(corpus.select("file_id", "path", "language", "text").mapInArrow(run, _LOCATED), rules)
    broken = F.coalesce(F.col("message").startswith("query error: "), F.lit(False))
    return described.withColumn("rule_id", F.when(broken, F.concat("rule_id", F.lit(":query-error"))).otherwise(F.col("rule_id")))
