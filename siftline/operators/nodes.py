"""Syntax trees as a table, and navigation over it by joins.

Node numbers are in pre-order, so "below" is a range of numbers and parents,
fields and children are equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.session import ship
from siftline.sources import syntax as S

SCHEMA = "file_id long, node_id int, parent_id int, last_id int, field string, kind string, name string, start long, end long, line long, depth int"
# Kinds of the lightweight symbol table.
_NAMED = {
    "class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "record_declaration": "class", "class_definition": "class",
    "method_declaration": "method", "constructor_declaration": "constructor", "method_definition": "method", "function_declaration": "function",
    "function_definition": "function", "local_variable_declaration": "local", "lexical_declaration": "local", "variable_declaration": "local",
    "var_spec": "local",
}


def _rows(tree: S.Tree) -> Iterator[tuple]:
    count = 0

    def walk(n: S.Node, parent: int | None, field: str | None, depth: int) -> Iterator[tuple]:
        nonlocal count
        own = count
        count += 1
        below = []
        if depth < S.DEPTH:
            names = {id(c): k for k, c in n.fields.items()}
            seen = {id(c) for c in n.children}
            for c in sorted([*n.children, *(c for c in n.fields.values() if id(c) not in seen and c.end > c.start)], key=lambda c: (c.start, -c.end)):
                below += walk(c, own, names.get(id(c)), depth + 1)
        yield own, parent, count - 1, field, n.kind, n.name or None, n.start, n.end, tree.line(n.start), depth
        yield from below

    yield from walk(tree.root, None, None, 0)


def ast_nodes(corpus: DataFrame) -> DataFrame:
    """Nodes of every file of (file_id, path, language, text) in a known language; offsets count characters."""
    ship(corpus.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for file_id, language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is not None and language in S.EXTENSIONS.values():
                    rows += [(file_id, *r) for r in _rows(S.Tree(text, language))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return corpus.select("file_id", "language", "text").mapInArrow(run, SCHEMA)


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Child nodes of ``of`` (file_id, node_id)."""
    return nodes.join(of.select("file_id", F.col("node_id").alias("parent_id")), ["file_id", "parent_id"], "left_semi")


def field(nodes: DataFrame, of: DataFrame, name: str) -> DataFrame:
    return children(nodes, of).filter(F.col("field") == name)


def below(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(top_id, and the node's columns) of all nodes below those of ``of``: a range of pre-order numbers within the file."""
    top = of.select(F.col("file_id").alias("f"), F.col("node_id").alias("top_id"), F.col("last_id").alias("top_last"))
    return nodes.join(top, (F.col("file_id") == F.col("f")) & (F.col("node_id") > F.col("top_id")) & (F.col("node_id") <= F.col("top_last"))).drop("f", "top_last")


def enclosing(points: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """``points`` (file_id, at) with the ``columns`` of the innermost span (file_id, start, end) that holds each; nulls if none does.

    A span is cut into aligned cells whose sizes are powers of two, at most two of a size; a cell keeps the shortest of its
    spans, and a point asks the one cell of each size that it lies in.  So no point meets all spans that hold it, and a
    file of any number of either is many keys.
    """
    longest = spans.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    levels = F.sequence(F.lit(0), F.lit(max(0, int(longest or 0).bit_length() - 1)))
    one = F.lit(1).cast("long")
    sized = spans.withColumn("level", F.explode(levels))
    first = F.expr("shiftright(start + shiftleft(1L, level) - 1, level)")
    last = F.expr("shiftright(end, level)") - 1
    # A cell counts where the one twice as large around it lies not wholly in the span.
    own = F.array_distinct(F.array_compact(F.array(F.when(first.bitwiseAND(one) == 1, first), F.when(last.bitwiseAND(one) == 0, last))))
    cells = sized.filter(first <= last).withColumn("cell", F.explode(own))
    best = cells.groupBy("file_id", "level", "cell").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), *columns)).alias("b"))
    places = points.select("file_id", "at").distinct().withColumn("level", F.explode(levels)).withColumn("cell", F.expr("shiftright(CAST(at AS BIGINT), level)"))
    held = places.join(best, ["file_id", "level", "cell"]).groupBy("file_id", "at").agg(F.min("b").alias("b"))
    return points.join(held, ["file_id", "at"], "left").select(*points.columns, *[F.col(f"b.{c}").alias(c) for c in columns])


def symbol_table(nodes: DataFrame) -> DataFrame:
    """(file_id, name, kind, line, start): what files declare."""
    kinds = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])
    return nodes.filter(F.col("name").isNotNull() & F.col("kind").isin(list(_NAMED))).select("file_id", "name", kinds[F.col("kind")].alias("kind"), "line", "start")


def declared_before(table: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses`` (file_id, name, line) with whether the name is declared on an earlier line of its file."""
    first = table.groupBy("file_id", "name").agg(F.min("line").alias("first"))
    return uses.join(first, ["file_id", "name"], "left").select(*uses.columns, F.coalesce(F.col("first") < F.col("line"), F.lit(False)).alias("declared"))
