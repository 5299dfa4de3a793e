"""Ancestors by doubled depth against a search from each class, and the number of rounds."""

import random

import pytest

from siftline.operators import graph


def facts_of(spark, above):
    rows = [("class", t, ",".join(a[:1]) or None, ",".join(a[1:]) or None) for t, a in above.items()]
    return spark.createDataFrame(rows, "kind string, name string, detail string, other string")


def expected(above):
    out = set()
    for t in above:
        depth, level = {t: 0}, [t]
        while level:
            level = sorted({a for x in level for a in above.get(x, ()) if a not in depth})
            depth |= {a: max(depth.values()) + 1 for a in level}
        out |= {(t, a, d) for a, d in depth.items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ancestors_with_diamonds_cycles_and_unknown_types(spark, seed):
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(40)]
    above = {t: rng.sample([*names, "Gone", "Other"], rng.choice([0, 1, 1, 1, 2, 3])) for t in names}
    got = [tuple(r) for r in graph.ancestors(facts_of(spark, above)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(above)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    above = {f"T{i}": [f"T{i - 1}"] if i else [] for i in range(60)}
    writes = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a: writes.append(1) or kept(df, *a))
    add = graph.Rounds.add
    monkeypatch.setattr(graph.Rounds, "add", lambda self, df: writes.append(1) or add(self, df))
    got = {tuple(r) for r in graph.ancestors(facts_of(spark, above)).collect()}
    assert got == expected(above) and len(writes) < 12
