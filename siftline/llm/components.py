"""Connected components of a link table, by alternating star contraction.

Each round points every neighbour of a node, first the larger then the smaller
ones, to the least node around it; the table shrinks to stars in a number of
rounds that grows with the logarithm of its size.  Minima are pre-aggregated,
every round's table is written to the shared folder, and nothing but two
numbers a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import drop_path, materialise, tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the links of one batch, without the roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: Edges from which on the least neighbours are written before they are joined: a join of two tables may split a hub's rows.
WRITE_FROM = 1_000_000


def _nearest(edges: DataFrame, write: bool) -> DataFrame:
    """Edges with the least b of each a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(materialise(least, "nearest") if write else least, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b: long, not null) the least node it reaches."""
    spark = links.sparkSession
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").mapInArrow(tidy(_contract), "a long, b long").distinct()
    before, last = None, None
    while True:
        edges = materialise(edges, "stars")
        if last:
            drop_path(spark, last)
        last = edges.scratch_path
        now = edges.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
        write = now[0] > WRITE_FROM
        both = edges.union(edges.select("b", "a"))
        large = _nearest(both, write).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _nearest(large, write)
        edges = small.select("a", F.col("m").alias("b")).union(small.filter("b != m").select("b", "m")).distinct()
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())
