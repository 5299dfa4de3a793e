"""What values are made of: a table of definitions, uses, calls and returns, without any rule.

A pass over the files notes, for each expression that data flow may ask about,
its text and the definitions that reach the variables in it.  Branches join by
union, a loop's body is read once and joined with what was before it, inner
functions see what is around them.  Rules, and all flow from row to row, are
joins over this table (``operators.taint``).  The code graph's facts may come
from the same pass, so that a file is parsed once for both.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import graph
from siftline.session import ship
from siftline.sources import syntax as S

#: Kinds of rows: a function, a parameter, a value given to a variable, a returned value, a call, one of its arguments, an assignment as a whole; a file, with facts.
FUNCTION, PARAM, DEF, OUT, CALL, ARG, ASSIGN, FILE = range(8)
SCHEMA = (
    "file_id long, path string, language string, node int, kind int, fn long, name string, other string, pos int, of int, start long, end long, line long, "
    "source_text string, sink_text string, uses array<struct<var:string,def:int,counts:boolean,kind:int,fn:long,pos:int>>, calls array<string>, away array<string>, "
    + graph.FACTS
)
_USES = pa.list_(pa.struct([("var", pa.string()), ("def", pa.int32()), ("counts", pa.bool_()), ("kind", pa.int32()), ("fn", pa.int64()), ("pos", pa.int32())]))
_ARROW = pa.schema([
    ("file_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("node", pa.int32()), ("kind", pa.int32()), ("fn", pa.int64()), ("name", pa.string()), ("other", pa.string()),
    ("pos", pa.int32()), ("of", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("line", pa.int64()), ("source_text", pa.string()), ("sink_text", pa.string()),
    ("uses", _USES), ("calls", pa.list_(pa.string())), ("away", pa.list_(pa.string())),
    ("facts", graph._ARROW),
])

#: Copies of a file are read once a worker, and so is what its short expressions say: files and characters of a file, expressions and characters of one.
KEPT_FILES, KEPT_FILE, KEPT_TEXTS, KEPT_TEXT = 128, 4096, 4096, 256
#: Pieces of Python files that are kept: statements outside others, read once a worker as long as they come again.
KEPT_PIECES = 512

_WORD = re.compile(r"[A-Za-z0-9_]+")
_TOP = re.compile(r"^(?!(?:else|elif|except|finally)\b)[A-Za-z_@]", re.M)
Scope = dict[str, frozenset[int]]


def joined(a: Scope, b: Scope) -> Scope:
    """Definitions that reach a place that two ways lead to."""
    return {v: a.get(v, frozenset()) | b.get(v, frozenset()) for v in a.keys() | b.keys()}


def bound_query(args: list[str]) -> bool:
    """Whether the first argument is one quoted literal with placeholders: values are bound, not spliced."""
    first = args[0] if args else ""
    return len(first) > 1 and first[0] in "\"'" and first[-1] == first[0] and first[0] not in first[1:-1] and X.has_placeholder(first)



def _short(read: Callable, text: str):
    """What a cached function gives for a text; long ones aren't kept."""
    return read(text) if len(text) <= KEPT_TEXT else read.__wrapped__(text)


@lru_cache(KEPT_TEXTS)
def _words(text: str) -> tuple[str, frozenset[str]]:
    """A text without its literals, and the words in it."""
    bare = X.strip_string_literals(text) if '"' in text or "'" in text or "`" in text else text
    return bare, frozenset(_WORD.findall(bare))


@lru_cache(KEPT_TEXTS)
def _parsed(text: str) -> tuple[str, list[str]] | None:
    return X.parse_call(text)


@lru_cache(KEPT_TEXTS)
def _called(text: str) -> tuple[str, ...]:
    """Names of the functions that are called in a text and in its arguments."""
    call = _short(_parsed, text) if "(" in text else None
    return () if call is None else (call[0], *(x for a in call[1] for x in _short(_called, a)))


@lru_cache(KEPT_TEXTS)
def _is_word(name: str) -> bool:
    return _WORD.fullmatch(name) is not None


class Values:
    """The rows of one file."""

    def __init__(self, tree: S.Tree):
        self.tree, self.rows = tree, []
        self.scope: Scope = {}
        f = tree.family
        self.methods, self.call_kinds, self.assigns = S.METHODS[f], S.CALLS[f], S.ASSIGNMENTS[f]
        self.declares = (*S.DECLARATIONS[f], "variable_declaration") if f == "javascript" else S.DECLARATIONS[f]
        imports = [n.name.partition("=") for n in tree.root.walk() if n.kind == "import_specifier"] if "import" in tree.source else []
        self.alias = {local: original for local, _, original in imports if original != local}
        self.told = {*self.methods, "if_statement", *S.LOOPS, *self.declares, *self.assigns, "return_statement", *self.call_kinds}
        self.walk(tree.root, None, 0)

    def told_of(self) -> list[tuple]:
        """The rows, with what each use's definition is."""
        rows = self.rows
        return [(*r[:12], [(v, d, k, rows[d][1], rows[d][2], rows[d][5]) for v, d, k in r[12]], r[13]) for r in rows]

    def whole(self) -> Iterator[tuple]:
        """The rows with uses by name, and the names of calls that no function of the file has."""
        rows = self.told_of()
        names = [f.name for f in _USES.value_type]
        for r, away in zip(rows, _away(rows), strict=True):
            yield *r[:12], [dict(zip(names, u, strict=True)) for u in r[12]], r[13], away

    def add(self, kind: str, fn: int | None, n: S.Node, name: str | None = None, text: str = "", *, pos: int | None = None, of: int | None = None, sink: str | None = None, uses: list | None = None, value: S.Node | None = None) -> int:
        row = len(self.rows)
        line = self.tree.line((value or n).start)
        self.rows.append((row, kind, fn, name, self.alias.get(name), pos, of, n.start, n.end, line, text, sink, self.uses(text) if uses is None else uses, self.calls(text)))
        return row

    def uses(self, text: str, counts: bool = True) -> list[tuple[str, int, bool]]:
        """(variable, definition, counts) of the variables outside a text's literals."""
        if not self.scope or not text:
            return []
        bare, words = _short(_words, text)
        held = [v for v in self.scope if v in words or not _short(_is_word, v) and X.contains_identifier(bare, v)]
        return [(v, d, counts) for v in sorted(held) for d in sorted(self.scope[v])]

    def calls(self, text: str) -> list[str]:
        """Names of the functions whose results a text may hold, an import's original name included."""
        names = _short(_called, text) if "(" in text else ()
        return sorted({*names, *(self.alias[x] for x in names if x in self.alias)}) if names else []

    def give(self, fn: int | None, n: S.Node, target: str, value: S.Node | None) -> None:
        self.scope[target] = frozenset([self.add(DEF, fn, n, target, self.tree.text(value) if value is not None else "", value=value)])

    def call(self, fn: int | None, n: S.Node) -> None:
        """A call and its arguments; of one that binds its values, only the query itself counts."""
        text = self.tree.text(n)
        name, args = _short(_parsed, text) or (None, [])
        if bound_query(args):
            own = {(v, d) for v, d, _ in self.uses(args[0])}
            row = self.add(CALL, fn, n, name, args[0], sink=text, uses=[(v, d, (v, d) in own) for v, d, _ in self.uses(text)])
        else:
            row = self.add(CALL, fn, n, name, text, sink=text)
        for i, a in enumerate(args if name else []):
            self.add(ARG, fn, n, name, a, pos=i, of=row, sink=text)

    def walk(self, n: S.Node, fn: int | None, depth: int) -> None:
        if depth > S.DEPTH:
            return
        if n.kind not in self.told:
            self.inside(n, fn, depth)
        elif n.kind in self.methods:
            around = dict(self.scope)
            if n.name:
                self.add(FUNCTION, n.start, n, n.name)
            for i, p in enumerate(n.fields["parameters"].children if "parameters" in n.fields else []):
                if p.name:
                    self.scope[p.name] = frozenset([self.add(PARAM, n.start, p, p.name, self.tree.text(p) if self.tree.family == "java" else "", pos=i, uses=[])])
            if n.fields.get("body") is not None and n.fields["body"].kind == "expression":
                self.add(OUT, n.start, n, text=self.tree.text(n.fields["body"]))
            self.inside(n, n.start, depth)
            self.scope = around
        elif n.kind == "if_statement":
            entry, ways = self.scope, []
            for part in ("consequence", "alternative"):
                self.scope = dict(entry)
                if part in n.fields:
                    self.walk(n.fields[part], fn, depth + 1)
                ways.append(self.scope)
            self.scope = joined(*ways)
        elif n.kind in S.LOOPS:
            before = dict(self.scope)
            self.inside(n, fn, depth)
            self.scope = joined(before, self.scope)
        else:
            if n.kind in self.declares:
                self.give(fn, n, n.name, n.fields.get("value"))
            elif n.kind in self.assigns and "left" in n.fields:
                right = n.fields.get("right")
                self.give(fn, n, self.tree.text(n.fields["left"]).strip(), right)
                text, whole = self.tree.text(right) if right is not None else "", self.tree.text(n)
                own = {(v, d) for v, d, _ in self.uses(text)}
                self.add(ASSIGN, fn, n, text=text, sink=whole, uses=[(v, d, (v, d) in own) for v, d, _ in self.uses(whole)])
            elif n.kind == "return_statement":
                self.add(OUT, fn, n, text=self.tree.text(n).removeprefix("return"))
            elif n.kind in self.call_kinds:
                self.call(fn, n)
            self.inside(n, fn, depth)

    def inside(self, n: S.Node, fn: int | None, depth: int) -> None:
        for c in n.children:
            self.walk(c, fn, depth + 1)


Read = tuple[list[tuple], list[tuple]]


def _away(rows: list[tuple]) -> list[list[str]]:
    """Of each row the names of its call that no function of the file has."""
    here = {r[3] for r in rows if r[1] == FUNCTION}
    return [[n for n in dict.fromkeys((r[3], r[4])) if n and n not in here] if r[1] == CALL else [] for r in rows]


@lru_cache(KEPT_PIECES)
def _piece(text: str, valued: bool, told: bool) -> Read | None:
    """The rows and facts of a piece of a Python file, or None where they depend on what is around it, or it is no whole statement."""
    tree = S.Tree(text, "python")
    if tree.error:
        return None
    values, found = Values(tree) if valued else None, graph.told(tree) if told else []
    if values and (values.alias or values.scope) or any(f[0] == "issue" for f in found):
        return None
    return values.told_of() if values else [], found


def _pieces(text: str) -> list[tuple[int, str]]:
    """Where the lines begin that may begin a statement of a Python file, and what is from one to the next; decorators stay with what they are of."""
    starts, held = [0], True
    for m in _TOP.finditer(text):
        if not held:
            starts.append(m.start())
        held = m[0] == "@"
    return [(a, text[a:b]) for a, b in pairwise((*starts, len(text)))]


def _joined(text: str, valued: bool, told: bool) -> Read | None:
    """The rows and facts of a Python file from those of its pieces, or None where they don't give them.

    A text that is cut into whole statements has the statements of its parts; pieces that import under another name, or
    give a value to a variable outside functions, have a say in what follows.
    """
    if not text.isascii() or "\r" in text or "\f" in text or len(cut := _pieces(text)) < 2:
        return None
    rows, facts, line = [], [], 0
    for at, piece in cut:
        read = _piece(piece, valued, told)
        if read is None:
            return None
        base = len(rows)
        for row, kind, fn, name, other, pos, of, start, end, on, source, sink, uses, calls in read[0]:
            moved = [(v, d + base, k, of_kind, f if f is None else f + at, p) for v, d, k, of_kind, f, p in uses]
            rows.append((row + base, kind, fn if fn is None else fn + at, name, other, pos, of if of is None else of + base, start + at, end + at, on + line, source, sink, moved, calls))
        facts += [(*f[:4], f[4] + line, f[5] + at, *f[6:8], f[8] if f[8] is None else f[8] + line, f[9]) for f in read[1]]
        line += piece.count("\n")
    return rows, facts


def _whole(text: str, language: str, valued: bool, told: bool) -> Read:
    tree = S.Tree(text, language)
    return Values(tree).told_of() if valued else [], graph.told(tree) if told else []


def _read(text: str, language: str, valued: bool, told: bool) -> list[tuple]:
    """The rows of a file without its own columns: its values, with the names of calls that no function of the file has, and one with its facts."""
    rows, facts = language == "python" and _joined(text, valued, told) or _whole(text, language, valued, told)
    out = [(*r, away, ()) for r, away in zip(rows, _away(rows), strict=True)]
    return [*out, (-1, FILE, *[None] * 10, (), (), (), facts)] if told else out


@lru_cache(KEPT_FILES)
def _kept(text: str, language: str, valued: bool, told: bool) -> list[tuple]:
    return _read(text, language, valued, told)


def values(files: DataFrame, languages: list[str], told: bool = False) -> DataFrame:
    """The rows of all files (file_id, path, language, text) in the given languages; each is parsed once, and a piece of it that has come before not at all.

    ``told``: with a row of kind FILE for each file of any language, with its facts (:func:`facts`).
    """
    ship(files.sparkSession)
    known = set(S.EXTENSIONS.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, graph.PART) for b in batches for at in range(0, b.num_rows, graph.PART)):
            rows = []
            for file_id, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                valued = language in languages
                if text is not None and (valued or told and language in known):
                    read = _kept if len(text) <= KEPT_FILE else _read
                    # Uses know their parameters: only those whose own text may be a source are rows.  Paths are asked for only of functions and files.
                    rows += [(file_id, path if r[1] in (FUNCTION, FILE) else None, language, *r) for r in read(text, language, valued, told) if r[1] != PARAM or r[10]]
            *columns, uses, calls, away, facts = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
            nested = [graph.listed(uses, _USES), *(pa.array(c, pa.list_(pa.string())) for c in (calls, away)), graph.listed(facts)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _ARROW.types[:-4], strict=True)), *nested], schema=_ARROW)

    return files.select("file_id", "path", "language", "text").mapInArrow(run, SCHEMA)


def facts(rows: DataFrame) -> DataFrame:
    """The code graph's facts, as ``graph.facts`` gives them, of rows that were read with them."""
    return graph.each(rows.filter(F.col("kind") == FILE))
