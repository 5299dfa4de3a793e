"""The filter audit and the mix against brute-force versions, on awkward rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import filter_audit, mixing
from tests.llm import helpers as H

LABELS = "doc_id long, quality int, toxic int, text string"
ROWS = [
    *[(i, t, "s%d" % (i % 3) if i % 7 else None) for i, t in enumerate(H.TEXTS)],
    *[(100 + i, " ".join("w%d" % j for j in range(250)), "hot") for i in range(40)],  # copies
    (100, " ".join("w%d" % j for j in range(250)), "hot"), (100, "an OTHER text of one id", ""), (None, None, "s0"), (None, "a # B", None), (None, "a # B", None),
    (500, "é" * 10 + "A", "é"), (501, " ".join("w%d" % j for j in range(30_000)), "long"), (502, "same " * 300, "long"),
]
MARKS = [(i, i % 2, int(i % 5 == 0), "x") for i in range(0, 140, 2)] + [(0, 1, None, "x"), (None, 1, 1, "x"), (4, None, 1, "x"), (999, 1, 1, "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "'p' AS part", "2 AS fails", "3 AS n", "4 AS size", "5 AS idx", "6 AS tie")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def audited(rows, marks):
    """Every row through every order, one filter after the other."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({m[0] for m in marks if m[0] is not None and m[k] == 1} for k in (1, 2))

    def fails(i, t):
        t = t or ""
        w = words(t)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        return out + "E" * (i is not None and i > least[t])

    parts = defaultdict(list)
    for i, t, s in rows:
        parts[s or ""].append((i, fails(i, t)))
    out = {}
    for part, own in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == f for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[f])
    return out


@pytest.mark.parametrize("bounds", [(filter_audit.ROWS, filter_audit.PARTS), (3, 1)])
def test_filter_audit(spark, monkeypatch, bounds):
    monkeypatch.setattr(filter_audit, "PIECE", 64)
    monkeypatch.setattr(filter_audit, "ROWS", bounds[0])
    monkeypatch.setattr(filter_audit, "PARTS", bounds[1])
    got = filter_audit.audit(frame(spark).repartition(5), spark.createDataFrame(MARKS, LABELS)).collect()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == audited(ROWS, MARKS)
    assert len(got) == 600 * len({r[2] or "" for r in ROWS})


def test_filter_audit_of_nothing(spark):
    marks = spark.createDataFrame(MARKS, LABELS)
    assert filter_audit.audit(frame(spark).limit(0), marks).count() == 0
    got = filter_audit.audit(frame(spark, [(1, " ".join(map(str, range(300))), "s")]), marks.limit(0)).collect()
    assert len(got) == 600 and all(list(r[3:]) == [1, *[0] * 6] for r in got)


def test_words_in_pieces(monkeypatch):
    text = b"a bb  ccc\td\n" * 40 + b"end"
    whole = filter_audit.word_counts(text)
    for piece in (1, 2, 5, 7, 100):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        assert filter_audit.word_counts(text) == whole == (161, 5)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    for key in (0, 5, 2**63):
        at = mixing.permuted(np.arange(n), n, key)
        assert sorted(at) == list(range(n)) and (mixing.permuted(at, n, key, inverse=True) == np.arange(n)).all()
    keys = mixing.pass_key(3, np.arange(2 * n) // n)
    both = mixing.permuted(np.arange(2 * n) % n, n, keys)
    assert sorted(both[:n]) == sorted(both[n:]) == list(range(n))
    if n > 500:
        assert (both[:n] != both[n:]).mean() > 0.9 and abs(np.corrcoef(np.arange(n), both[:n])[0, 1]) < 0.15


def test_slots_give_the_target():
    for size in (1, 5, 7, 8, 15, 16, 33, 100):
        for target in range(2 * size + 1):
            n, last = mixing.slots_for(target, size, 8, source=2)
            blocks = -(-size // 8)
            k = np.arange(n)
            at = mixing.permuted(k % blocks, blocks, mixing.pass_key(2, k // blocks))
            words = np.where(at == blocks - 1, size - 8 * (blocks - 1), 8)
            if n and last:
                assert 0 < last <= words[-1]
                words[-1] = last
            assert words.sum() == target


def shares(rows):
    """Targets by the rule as it is told: fill by weight, stop those above, share again."""
    total = Counter()
    for _, t, s in rows:
        total[s] += len(words(t))
    order = sorted(total, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    mix, stopped = 1.5 * sum(total.values()), set()
    while True:
        left = sum(weight[s] for s in order if s not in stopped)
        unit = (mix - sum(2 * total[s] for s in stopped)) / left
        above = {s for s in order if s not in stopped and weight[s] * unit > 2 * total[s]}
        if not above:
            return total, {s: 2.0 * total[s] if s in stopped else weight[s] * unit for s in order}
        stopped |= above


@pytest.mark.parametrize("block,shard", [(mixing.BLOCK, mixing.SHARD), (7, 3)])
def test_mixing(spark, block, shard):
    mix = mixing.Mix(frame(spark), block=block, shard=shard)
    got = mix.taken().collect()
    size, target = shares(ROWS)
    assert sorted((r.key if r.key is not None else -1, r.size) for r in got) == sorted((i if i is not None else -1, len(words(t))) for i, t, _ in ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for r in mix.sources.collect():
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    joined = mix.spans().groupBy("idx").agg(F.sum("words").alias("n")).join(mix.sources, "idx").collect()
    assert all(abs(r.n - r.target) <= 0.5 for r in joined) and len(joined) == sum(n > 0 for n in size.values())
    by_source = Counter()
    for r in got:
        by_source[r.source_size, round(r.target, 6)] += r.taken
    assert sum(by_source.values()) == sum(r.n for r in joined)
    again = mixing.Mix(frame(spark, ROWS[::-1]).repartition(3), block=block, shard=shard).taken().collect()
    plain = lambda rows: sorted(map(str, rows))
    assert plain(again) == plain(got)


def test_mixed_texts(spark):
    """Every slot holds its block's words in order; whole passes hold every word; a shard holds its slots."""
    rows = [(i, " ".join("d%d.%d" % (i, j) for j in range(i % 23)), "s%d" % (i % 2)) for i in range(60)] + [(90, " ".join("x%d" % j for j in range(50)), None)]
    mix = mixing.Mix(frame(spark, rows), block=10, shard=4)
    texts, spans = mix.texts().collect(), mix.taken().collect()
    assert len({r.shard for r in texts}) > 3
    seen = Counter(w for r in texts for w in r.text.split(" "))
    by_doc = Counter()
    for w, n in seen.items():
        by_doc[90 if w[0] == "x" else int(w[1:].split(".")[0])] += n
    assert max(seen.values()) <= 2 and by_doc == Counter({r.key: r.taken for r in spans if r.taken})
    for r in texts:  # words of one document follow each other
        assert len(r.text.split(" ")) <= 10 and all(b == a + 1 or b == 0 for a, b in zip(*[[int(re.split("[x.]", w)[1]) for w in r.text.split(" ")][k:] for k in (0, 1)]))


def test_mixing_of_nothing(spark):
    assert mixing.Mix(frame(spark).limit(0)).taken().count() == 0
    got = mixing.Mix(frame(spark, [(1, None, "a"), (2, "  ", None)])).taken().collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2
