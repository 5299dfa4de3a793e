"""Scalar functions over text: positions, lines, fingerprints, escapes.

Column functions are native; the plain Python ones beside them serve the driver
and the parsers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of FNV-1a, 64 bits.
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211


def fnv1a64(value: str | bytes) -> str:
    """FNV-1a of a text's UTF-8, as 16 lower-case hex digits."""
    h = FNV_BASIS
    for b in value.encode() if isinstance(value, str) else value:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return f"{h:016x}"


def fnv1a64_col(value: Column) -> Column:
    """:func:`fnv1a64` of a string column, natively.

    The state is two 32-bit halves in longs, which no step overflows: the prime
    is 2**40 + 435, so the high half gains the low one shifted by 8.
    """
    bytes_ = F.split(F.decode(F.encode(value, "UTF-8"), "ISO-8859-1"), "")
    start = F.struct(F.lit(FNV_BASIS >> 32).alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).alias("lo"))
    mask = F.lit(0xFFFFFFFF)

    def step(acc: Column, ch: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(F.ascii(ch).cast("long"))
        product = lo * 435
        hi = (acc["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(lo, 8)).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    hashed = F.aggregate(bytes_, start, step, lambda a: F.concat(digits(a["hi"]), digits(a["lo"])))
    return F.when(F.length(value) == 0, F.lit(f"{FNV_BASIS:016x}")).otherwise(hashed)


def normalize_path(path: Column) -> Column:
    """Forward slashes, without one leading ./ or else one leading dot, then without one leading slash."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(slashed, r"^(?:\./|\.)", ""), "^/", "")


def normalize_snippet(text: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?U:\s)+|(?U:\s)+$", ""), r"(?U:\s)+", " ")


def fingerprint(rule_id: Column, path: Column, snippet: Column, line: Column, column: Column) -> Column:
    """Identity of a finding: rule, path, and its line of code; only without that its position."""
    head = F.concat(rule_id, F.lit("\0"), normalize_path(path), F.lit("\0"))
    short = normalize_snippet(F.coalesce(snippet, F.lit("")))
    place = F.concat(F.lit("\0"), line.cast("string"), F.lit("\0"), column.cast("string"))
    return fnv1a64_col(F.concat(head, F.when(short != "", short).otherwise(place)))


def line_of(prefix: Column) -> Column:
    """1-based line of what follows ``prefix``."""
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of(prefix: Column) -> Column:
    """1-based column in characters of what follows ``prefix``."""
    return (F.length(F.substring_index(prefix, "\n", -1)) + 1).cast("long")


def html_escape(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def sarif_level(severity_rank: Column) -> Column:
    return F.when(severity_rank >= 3, "error").when(severity_rank == 2, "warning").otherwise("note")


def glob_regex(glob: str) -> str:
    """A regex for one path segment: * is any run, ? any one character."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)


# The helpers of the data-flow walker, on plain strings.


def contains_identifier(text: str, name: str) -> bool:
    """Whether a name stands in a text with no ASCII word character on either side."""
    return bool(name) and re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text) is not None


def strip_string_literals(text: str) -> str:
    """A text with its quoted literals blanked; ${...} inside backticks stays."""
    out, quote, i = [], "", 0
    while i < len(text):
        c = text[i]
        if not quote:
            quote = c if c in "\"'`" else ""
            out.append(" " if quote else c)
        elif c == "\\":
            i += 1
            out.append("  ")
        elif c == quote:
            quote = ""
            out.append(" ")
        elif quote == "`" and text.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            out.append(text[i:j])
            i = j - 1
        else:
            out.append(" ")
        i += 1
    return "".join(out)


_SEPARATORS = re.compile(r"[(),]")


def parse_call(text: str) -> tuple[str, list[str]] | None:
    """(last identifier before the first parenthesis, arguments split at top-level commas), if parentheses balance."""
    begin = text.find("(")
    if begin < 0:
        return None
    name = re.search(r"([A-Za-z_$][\w$]*)\s*$", text[:begin])
    if not name:
        return None
    depth, args, last = 0, [], begin + 1
    for m in _SEPARATORS.finditer(text, begin):
        i = m.start()
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if not depth:
                rest = text[last:i].strip()
                return name[1], [*args, rest] if rest or args else []
        elif depth == 1:
            args.append(text[last:i].strip())
            last = i + 1
    return None


def has_placeholder(text: str) -> bool:
    """Whether a query text holds a bind placeholder."""
    return re.search(r"\?|%s|%d|#\{|\$[1-9]", text) is not None
