"""Chat, URLs, near copies, repeated strings and the pipeline against brute force."""

import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import chat, components, language, shingle_join, suffix_dedup, url_filter
from siftline.session import ship
from tests.llm import helpers as H


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = list(H.TEXTS)
    for size in (9, 10, 11, 30, 60, 150):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 30))):
                copy[rng.randrange(size)] = word()
            if rng.random() < 0.3:
                copy = copy[: -rng.randint(1, max(1, size // 20))]
            out.append(" ".join(copy))
    shared = " ".join(word() for _ in range(25))
    out += [shared + " " + " ".join(word() for _ in range(40)) for _ in range(20)]
    rng.shuffle(out)
    return out


#: The contract of the query op9; the operator's own default is 5 words and 0.8.
OP9 = {"n": 3, "num": 90, "den": 100}


@pytest.mark.parametrize("rows,seed", [(256, 5), (4, 6)])
def test_jaccard_join(spark, monkeypatch, rows, seed):
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", rows)
    texts = near_copies(seed)
    got = shingle_join.ShingleJoin(H.docs(ship(spark), texts), **OP9).component_ids().orderBy("doc_id").collect()
    want = H.jaccard_components(texts)
    assert [(r.n_shingles, r.component_id) for r in got] == want
    left = shingle_join.representatives(H.docs(spark, texts), **OP9)
    assert sorted(r.doc_id for r in left.collect()) == [i for i, w in enumerate(want) if w[1] == i] and left.columns == H.docs(spark).columns


@pytest.mark.parametrize("rows", [32, 4096])
def test_near_copies_that_do_not_all_link_meet_once(spark, monkeypatch, rows):
    """A group of near copies meets on many columns; its rows are not dealt once a column, nor are linked ones paired with each other."""
    monkeypatch.setattr(shingle_join, "LEAST_ROWS", rows)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(240):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(0, 1) if k % 3 else rng.randint(3, 5)):
            copy[at] = f"x{k}-{at}"
        texts.append(" ".join(copy))
    dealt, counts = shingle_join._dealt, {}

    def counted(work, payload, name, *more):
        out = dealt(work, payload, name, *more)
        counts[name] = (work.select("node").distinct().count(), out[0].count())
        return out

    monkeypatch.setattr(shingle_join, "_dealt", counted)
    got = shingle_join.ShingleJoin(H.docs(ship(spark), texts), **OP9).component_ids().orderBy("doc_id").collect()
    want = H.jaccard_components(texts)
    assert [(r.n_shingles, r.component_id) for r in got] == want and 60 < len({w[1] for w in want}) < 100
    nodes, sent = counts["bits"]
    assert nodes > 100 and sent <= nodes * (2 if rows > nodes else 10)


def test_jaccard_join_edges(spark):
    assert shingle_join.ShingleJoin(H.docs(ship(spark)).limit(0)).component_ids().count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "A  B\tc d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in shingle_join.ShingleJoin(rows, **OP9).component_ids().collect()} == {(None, 3), (7, 3), (3, 3)}


@pytest.mark.parametrize("num", [80, 90])
def test_rows_that_link_share_a_first_column(spark, num):
    """Whatever the counts of columns, two rows that meet the threshold share one of their first columns, and their size classes are neighbours."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, shingle_join.CELLS).astype(np.uint32)
    linked = 0
    for _ in range(1500):
        base = rng.integers(0, 1 << 62, int(rng.integers(1, 60))).astype(np.uint64)
        pair = [np.unique(np.concatenate([base, rng.integers(0, 1 << 62, int(rng.integers(0, 1 + len(base) // 6))).astype(np.uint64)])) for _ in range(2)]
        size = [len(x) for x in pair]
        if not shingle_join.linked(len(np.intersect1d(*pair)), *size, num, 100) or (pair[0].tolist() == pair[1].tolist()):
            continue
        linked += 1
        column, row = shingle_join.first_columns(np.concatenate(pair), np.cumsum([0, *size]), counts, num, 100)
        assert set(column[row == 0].tolist()) & set(column[row == 1].tolist())
    assert linked > 50
    classes = [r[0] for r in ship(spark).range(1, 3000).select(shingle_join.size_class(F.col("id"), num, 100)).collect()]
    assert all(abs(classes[b - 1] - classes[a - 1]) <= 1 for a in range(1, 2000) for b in (a, a * 100 // num) if b < 3000)


def test_product_of_tiles(monkeypatch):
    """Overlaps by dense blocks and entry by entry, in small pieces, against sets."""
    monkeypatch.setattr(shingle_join, "BLOCK_COLUMNS", 7)
    monkeypatch.setattr(shingle_join, "_ENTRIES", 5)
    rng = np.random.default_rng(8)
    tile = lambda n: [np.unique(np.concatenate([rng.choice(40, 12), rng.choice(2000, 30)])).astype(np.uint64) for _ in range(n)]
    a, b = tile(50), tile(35)
    assert shingle_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert not shingle_join.overlaps(a[:1], [np.array([5000], np.uint64)]).any()


def test_bitmaps_bound_differences():
    """Bitmaps never differ in more bits than sets do in columns, whatever their lengths, and far sets differ in many."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (0, 1, 5, 63, 64, 65, 130, 500, 900, 3000):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: size - size // 20], rng.integers(0, 1 << 62, size // 15).astype(np.uint64)]))]
    maps = shingle_join.bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    x, y = (k.ravel() for k in np.indices((len(sets), len(sets))))
    apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    got = shingle_join.differing(maps, x, y)
    assert (got <= apart).all() and (got[(x == y)] == 0).all()
    n = np.array([len(s) for s in sets])
    some = (n[x] > 0) & (n[y] > 0)
    links = np.array([shingle_join.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j], 80, 100) for i, j in zip(x, y)])
    assert not (links & some & ~shingle_join.possible(maps, n, x, y, 80, 100)).any()
    assert shingle_join.possible(maps, n, x, y, 80, 100)[some].sum() <= links[some].sum() + 4


def test_sets_that_share_a_hash_stay_apart(spark, monkeypatch):
    """Names of sets, in tasks and in tables, where first hashes are cut to three bits: the second tells them apart."""
    whole = shingle_join.fingerprints
    monkeypatch.setattr(shingle_join, "fingerprints", lambda g, b: (whole(g, b)[0] & 7, whole(g, b)[1]))
    grams, bounds = shingle_join.incidence(pa.array(near_copies(11)[:60], pa.string()), 3)
    keys = list(zip(*(h.tolist() for h in shingle_join.fingerprints(grams, bounds)), strict=True))
    names = {k: 1000 + i for i, k in enumerate(dict.fromkeys(keys)) if k != keys[0]}
    nodes = shingle_join._nodes(grams, bounds, names).tolist()
    sets = [grams[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    assert len(set(nodes)) == len(set(sets)) == len(set(zip(nodes, sets)))
    named = shingle_join._named(ship(spark).createDataFrame(keys, "h1 long, h2 long"), names)
    assert {((r.h1, r.h2), r.node) for r in named.collect()} == set(zip(keys, nodes))


@pytest.mark.parametrize("write", [components.WRITE_FROM, 0])
def test_components(spark, monkeypatch, write):
    monkeypatch.setattr(components, "WRITE_FROM", write)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (300, 100), (5, 5), (-3, 7), (60, 61)]
    got = {r.node: r.component for r in components.components(ship(spark).createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {i: -3 for i in [*range(1, 41), -3]} | {100: 100, 200: 100, 300: 100, 60: 60, 61: 60}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeated_texts(seed=9):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400)]
    out = list(H.TEXTS)
    for _ in range(60):
        out.append("".join(rng.choice([text(rng.randint(0, 120)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(1, 5))))
    return out + ["=" * 1000, "=" * 350, "ab" * 400, out[-1], out[-2]]


@pytest.mark.parametrize("piece", [suffix_dedup.PIECE, 256])
def test_suffix_dedup(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    texts = repeated_texts()
    got = suffix_dedup.SuffixDedup(H.docs(ship(spark), texts)).kept().orderBy("doc_id").collect()
    want = H.removed(texts)
    assert [(r.n_bytes, bytes(r.kept), r.n_spans) for r in got] == want and all(r.n_removed == r.n_bytes - len(r.kept) for r in got)
    left = suffix_dedup.dedup(H.docs(spark, texts)).orderBy("doc_id").collect()
    assert {r.doc_id: r.text for r in left} == {i: t if n == len(k) else k.decode("utf-8", "ignore") for i, (t, (n, k, _)) in enumerate(zip(texts, want)) if k or not n}


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.SuffixDedup(H.docs(ship(spark)).limit(0)).kept().count() == 0
    rows = spark.createDataFrame([(None, "k" * 300), (1, "m" * 10 + "n" * 120), (1, "m" * 10 + "n" * 120)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.SuffixDedup(rows).kept().collect())
    assert got[0] == (0, 300, 0) and got[1] == got[2] == (1, 130, 119)


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
URLS = [
    ("http://Example.NET/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://a.example.net/fr?x#y", "a.example.net", "/fr", "net/", "block"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("http://w.example.com/de/#/", "w.example.com", "/de/", "example.com/de/", "block"),
    ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://x.net", "x.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http://a://b/c", "a:", "//b/c", None, "allow"),
]


@pytest.mark.parametrize("inline", [url_filter.INLINE_RULES, 0])
def test_url_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    pages = ship(spark).createDataFrame([(i, u[0], "<a href='/x'>") for i, u in enumerate(URLS)] + [(99, URLS[0][0], None)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, RULES).collect()}
    assert [got[i] for i in range(len(URLS))] == [u[1:] for u in URLS] and got[99] == URLS[0][1:]
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_trust_and_distrust_follow_links(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="http://{h}/">' for h in hosts)
    rows = [(1, "http://good.org/fr/", link("friend.com")), (2, "http://bad.net/", ""), (3, "http://feeder.com/", link("bad.net", "bad.net")), (4, "http://friend.com/", link("bad.net", "good.org")), (5, "http://far.com/", link("feeder.com")), (6, "http://alone.com/", link("alone.com"))]
    pages = ship(spark).createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in url_filter.judge(pages, {"net/": "block", "org/fr/": "allow"}).collect()}
    assert got == {"good.org": "allow", "bad.net": "block", "feeder.com": "block", "far.com": "block", "friend.com": "allow", "alone.com": "allow"}


def test_pagerank_against_brute_force(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3)]
    rank, seeds = {}, {"a": url_filter.UNITS}
    for _ in range(21):
        new = {h: 0.15 * w for h, w in seeds.items()}
        for s, d, n in links:
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * n / sum(x[2] for x in links if x[0] == s)
        rank = new
    got = url_filter.propagate(ship(spark).createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame([("a", url_filter.UNITS)], "host string, weight long"))
    assert all(abs(r["rank"] - rank[r.host]) < url_filter.UNITS * 1e-3 for r in got.collect())


TOOLS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}, "y": {"type": ["string", "number"]}}, "additionalProperties": False}, "get": {"type": "object"}}


def test_chat(spark):
    call = lambda *cs: json.dumps({"content": None, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    rows = [
        (1, 0, "user", 'Hi "é"'), (1, 1, "assistant", call(("c2", "add", {"y": "$c1", "x": 1}), ("c1", "get", '{"b": 1, "a": [2]}'), ("c3", "add", {"z": 0}))),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": {"k": 1}})), (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "late"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})), (2, 0, "assistant", call(("c1", "get", {"q": "$c9"}), ("c9", "get", {"q": "$c1"}))),
        (2, 1, None, None), (3, 0, "user", "{not json"), (None, 0, "user", ""), (3, 0, "user", "{not json"),
    ]
    turns = ship(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chat(turns, TOOLS).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows) and by[1, 0].message == '{"content":"Hi \\"é\\"","role":"user"}'
    r = by[1, 1]
    assert (r.n_calls, r.n_linked, r.n_invalid, r.n_cyclic) == (3, 1, 1, 0)
    assert r.message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":[2],"b":1},"id":"c1","name":"get","result":"{\\"k\\":1}"},{"arguments":{"z":0},"errors":["/x: missing","/z: not allowed"],"id":"c3","name":"add"},{"arguments":{"x":1,"y":"$c1"},"id":"c2","name":"add"}]}'
    assert by[1, 4].orphan and not by[1, 2].orphan and by[2, 0].n_cyclic == 2 and by[2, 1].message == '{"content":null,"role":""}' and by[3, 0].message == '{"content":"{not json","role":"user"}'
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_chat_of_odd_json(spark):
    """Halves of surrogate pairs, deep nesting, NaN and long texts are serialised, none ends the job; other columns don't matter."""
    call = '{"content": "c", "tool_calls": [{"id": "a", "name": "get", "arguments": %s}]}'
    texts = [
        '{"content": "\\ud800", "tool_call_id": "x"}', call % '{"q": "\\udc00"}', call % ("[" * 3000 + "]" * 3000), call % json.dumps("[" * 3000 + "]" * 3000), call % "NaN", call % "1e999",
        call % json.dumps("NaN"), call % ("[" * 200 + "]" * 200), call % '"' + "[" * 5000, "{" * 100_000, '{"content": "' + "long [ " * 200_000 + '", "tool_call_id": "a"}', call % json.dumps({"k": "[" * 300}),
    ]
    rows = ship(spark).createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = chat.format_chat(rows.selectExpr("*", "1 AS level", "'x' AS id", "2 AS calls")).orderBy("turn").collect()
    kinds = [r.n_calls for r in got]
    assert kinds == [0, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 1]
    for r, t in zip(got, texts):
        message = json.loads(r.message, parse_constant=lambda x: pytest.fail(x))
        if r.turn in (0, 1, 2, 4, 5, 8, 9):
            assert message == {"content": t, "role": "user"}
    assert json.loads(got[6].message)["tool_calls"][0]["arguments"] == "NaN" and len(json.loads(got[10].message)["content"]) == 1_400_000


def test_chat_levels_against_brute_force(spark):
    """Levels of random references, with chains, cycles and references to nothing."""
    rng = random.Random(12)
    calls = [(c, f"c{k}", [f"c{rng.randrange(30)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))]) for c in range(12) for k in range(25)]
    calls += [(99, f"d{k}", [f"d{k - 1}"] if k else []) for k in range(40)]
    want = {}
    for conv in {c for c, _, _ in calls}:
        own = {i: {r for r in refs if any(x[:2] == (conv, r) for x in calls)} for c, i, refs in calls if c == conv}
        while ready := [i for i in own if (conv, i) not in want and all((conv, r) in want for r in own[i])]:
            for i, n in [(i, 1 + max((want[conv, r] for r in own[i]), default=-1)) for i in ready]:
                want[conv, i] = n
    got = chat.levels(ship(spark).createDataFrame(calls, "conv_id long, id string, refs array<string>")).collect()
    assert {(r.conv_id, r.id): r.level for r in got} == want and want[99, "d39"] == 39 and len(want) < len(calls)


def test_pipeline_stages(spark):
    """Each stage on its own input against brute force; small rows with planted cases."""
    ship(spark)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_dedup", "decontamination", "sentencepiece"]
    items = [tuple(map(str, r)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        order = sorted(rows)
        out = stage(spark, docs, sf)
        got = {r.doc_id: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "language_id":
            assert len(got) >= len(rows) - 1
        elif name == "ngram_jaccard":
            want = H.jaccard_components([rows[i].text for i in order], 5, 80, 100)
            assert sorted(got) == [order[k] for k, w in enumerate(want) if w[1] == k]
        elif name == "suffix_dedup":
            want = H.removed([rows[i].text for i in order])
            assert all(got[i].text == (rows[i].text if n == len(k) else k.decode("utf-8", "ignore")) and got[i].n_chars == len(got[i].text) for i, (n, k, _) in zip(order, want) if i in got)
            assert sorted(got) == [i for i, (n, k, _) in zip(order, want) if k or not n]
        elif name == "decontamination":
            assert sorted(got) == [i for i, w in zip(order, H.contaminated([rows[i].text for i in order], items)) if not w[2]]
        else:
            assert sorted(got) == order and all(len(r.ids) == 4 * r.n_tokens for r in got.values())
        docs = spark.createDataFrame(list(got.values()), out.schema) if name != "sentencepiece" else out


def test_pipeline_run(spark):
    """All stages in a row on whole tables, against brute force from the language stage on."""
    import hashlib

    import sentencepiece
    from siftline.llm.registry import vocabulary

    sf = "/root/testdata/sf0.001"
    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, sf).collect())
    rows = [x for x, w in zip(rows, H.jaccard_components([t for _, t in rows], 5, 80, 100)) if rows[w[1]][0] == x[0]]
    cut = H.removed([t for _, t in rows])
    rows = [(i, t if n == len(k) else k.decode("utf-8", "ignore")) for (i, t), (n, k, _) in zip(rows, cut) if k or not n]
    items = [tuple(map(str, r)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [x for x, w in zip(rows, H.contaminated([t for _, t in rows], items)) if not w[2]]
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    ids = [model.encode(t or "", add_bos=True, add_eos=True) for _, t in rows]
    want = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(x).encode()).hexdigest()) for (i, _), x in zip(rows, ids)]
    got = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want and len(want) > 100


def test_pipeline_near_copies_share_runs_of_five_words(spark):
    """The stage's own 5 words and 0.8 against brute force; some pairs link under these and not under 3 words and 0.9."""
    base = [f"w{k}" for k in range(100)]
    copy = ["other" if k in (30, 60) else w for k, w in enumerate(base)]  # 5 words: 86 / 106; 3 words: 92 / 104
    texts = [*near_copies(7), " ".join(base), " ".join(copy)]
    want = H.jaccard_components(texts, 5, 80, 100)
    assert want[-1][1] == len(texts) - 2 and want != H.jaccard_components(texts)
    left = corpus_pipeline.ngram_jaccard(ship(spark), H.docs(spark, texts), "")
    assert sorted(r.doc_id for r in left.collect()) == [i for i, w in enumerate(want) if w[1] == i]


def link(*hosts):
    return "".join(f'<a href="http://{h}/">' for h in hosts)


def test_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    """A blocked host, what links to it, and a cycle, alone and among a hundred more blocked hosts."""
    rows = [("a0.net", ""), ("feeder.com", link("a0.net")), ("ring1.com", link("ring2.com", "a0.net")), ("ring2.com", link("ring1.com")), ("alone.com", link("feeder.com"))]
    others = [(f"b{k}.net", "") for k in range(100)]
    for hosts in (rows, rows + others):
        pages = ship(spark).createDataFrame([(i, f"http://{h}/x", t) for i, (h, t) in enumerate(hosts)], "page_id long, url string, html string")
        bad = {r.host: r.distrust for r in url_filter.blocked_hosts(url_filter.apply_rules(pages.select("page_id", "html", url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path")), {"net/": "block"}), {"net/": "block"}, 0.01).collect()}
        ring = 0.15 * 0.85 / 2 / (1 - 0.85**2)  # a0.net sends to two hosts against its links; ring1 and ring2 send to each other
        assert abs(bad["a0.net"] - 0.15) < 1e-6 and abs(bad["ring1.com"] - ring) < 1e-4 and abs(bad["feeder.com"] - 0.15 * 0.85 / 2) < 1e-6
        assert {h for h in bad if not h.startswith("b")} == {h for h, _ in rows}


def test_distrust_reaches_beyond_twenty_links(spark):
    rows = [(0, "http://h0.net/", "")] + [(k, f"http://h{k}.com/", link(f"h{k - 1}.{'com' if k > 1 else 'net'}")) for k in range(1, 31)]
    pages = ship(spark).createDataFrame(rows, "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge(pages, {"net/": "block"}).collect()} == {"block"}


@pytest.mark.parametrize("rows", [256, 4])
def test_jaccard_join_gives_every_link(spark, monkeypatch, rows):
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", rows)
    texts = near_copies(8)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", H.lower(t))
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)
    join = shingle_join.ShingleJoin(H.docs(ship(spark), texts), **OP9)
    distinct = sorted(set(sets), key=sorted)
    found = join.pairs().collect()
    assert len(found) == len({(r.a, r.b) for r in found}) == sum(link(a, b) for k, a in enumerate(distinct) for b in distinct[:k])
    got = {r.doc_id: r.n_links for r in join.link_counts().collect()}
    assert got == {i: sum(link(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}


# Several texts of one id, and identifiers of other kinds.

TWO = [(1, "the cat and the dog are in the house of the king and they are happy with it. " * 4), (1, ""), (2, "x" * 160), (2, "y" * 40 + "x" * 160 + "z" * 30), (3, "q" * 20), (None, "x" * 160), (2, "y" * 40 + "x" * 160 + "z" * 30)]


def test_texts_of_one_id_in_suffix_dedup(spark):
    """Each text of an id is a document of its own: nothing is cut by another one's ranges, and shorter ones don't stop the job."""
    docs = H.docs(spark, ["one"]).limit(0).select("doc_id", "text").unionByName(spark.createDataFrame(TWO, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_bytes) for r in suffix_dedup.SuffixDedup(docs).digests().collect())
    assert got == Counter((i, len(t)) for i, t in TWO)
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.SuffixDedup(docs).digests().collect()}
    assert cut[1, 0] == cut[3, 20] == cut[None, 160] == 0 and cut[1, len(TWO[0][1])] > 0  # the first repeats itself
    assert sorted([cut[2, 160] > 0, cut[2, 230] > 0]) == [True, True]  # x repeats inside the one, and all of it in the other
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in suffix_dedup.dedup(docs).collect())
    assert (1, "") in kept and (3, "q" * 20) in kept and (-1, "x" * 160) in kept
    rng = random.Random(2)
    clean = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1400))
    rows = suffix_dedup.SuffixDedup(spark.createDataFrame([(5, clean), (5, "b" * 300), (6, "short")], "doc_id long, text string")).digests().collect()
    assert {(r.doc_id, r.n_bytes): r.n_removed for r in rows} == {(5, 1400): 0, (5, 300): 299, (6, 5): 0}


def test_texts_of_one_id_in_stages(spark):
    english = "The quick brown fox jumps over the lazy dog while the cat sleeps in the sun and the bird sings in the tree near the river. " * 3
    rows = [(1, english, "en"), (1, "", "en"), (2, english + "and more of it", "en"), (3, "der Hund und die Katze sind in dem Haus mit dem Garten und der Mauer " * 4, "de"), (3, english + "and more of it", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    left = language.keep(docs)
    assert left.columns == docs.columns and (1, english) in {(r.doc_id, r.text) for r in left.collect()} and (1, "") not in {(r.doc_id, r.text) for r in left.collect()}
    kept = {(r.doc_id, r.text[:3]) for r in shingle_join.representatives(docs).collect()}
    assert (3, "der") in kept and (3, "The") not in kept  # a copy leaves, the other text of its id stays
    named = docs.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    assert {(r.doc_id, r.text[:3]) for r in shingle_join.representatives(named).collect()} == {("id-" + str(i), t) for i, t in kept}
    assert suffix_dedup.SuffixDedup(named).digests().filter("doc_id LIKE 'id-%'").count() == len(rows)


def test_calls_without_identifier(spark):
    turns = [
        (1, 0, "a", '{"tool_calls":[{"id":null,"name":"f","arguments":{}},{"name":"f","arguments":{"x":"$k"}},{"id":"k","name":"f","arguments":{}}]}'),
        (1, 1, "t", '{"tool_call_id":null,"content":"none"}'), (1, 2, "t", '{"tool_call_id":"None","content":"text"}'), (1, 3, "t", '{"tool_call_id":"k","content":"v"}'),
    ]
    got = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.n_calls, r.n_linked, r.n_cyclic, r.orphan) for r in got] == [(3, 1, 0, False), (0, 0, 0, True), (0, 0, 0, True), (0, 0, 0, False)]
    made = json.loads(got[0].message)["tool_calls"]
    assert [(c["id"], c.get("result")) for c in made] == [(None, None), ("k", "v"), (None, None)] and json.loads(got[1].message)["tool_call_id"] is None


def brute_errors(value, schema, known, at=""):
    """What breaks a schema of type, bounds, required, properties and items, unless a known call stands there."""
    if isinstance(value, str) and value[:1] == "$" and value[1:] in known:
        return 0
    kinds = {"integer": lambda v: type(v) is int, "string": lambda v: type(v) is str, "object": lambda v: type(v) is dict, "array": lambda v: type(v) is list}
    if not kinds[schema["type"]](value):
        return 1
    n = int("minimum" in schema and value < schema["minimum"]) + int("maxLength" in schema and len(value) > schema["maxLength"])
    if type(value) is dict:
        n += sum(k not in value for k in schema.get("required", [])) + sum(brute_errors(v, schema["properties"][k], known) for k, v in value.items() if k in schema["properties"])
    if type(value) is list:
        n += sum(brute_errors(v, schema["items"], known) for v in value)
    return n


def test_chat_over_random_calls(spark):
    """Random calls, references, identifiers and results against brute force: links, levels, errors, orphans."""
    rng = random.Random(5)
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"type": "array", "items": {"type": "string", "maxLength": 4}}}}
    value = lambda: rng.choice([1, 5, "x", "longer", "$c0", "$c1", "$c2", "$none", ["ab", "$c1"], ["toolong"], [7]])
    turns, want = [], []
    for conv in range(25):
        calls, results = [], {}
        for turn in range(rng.randint(1, 6)):
            if rng.random() < 0.6:
                own = [{"id": rng.choice([None, "c0", "c1", "c2", "c3"]), "name": "f", "arguments": {k: value() for k in rng.sample(["a", "b", "z"], rng.randint(0, 3))}} for _ in range(rng.randint(1, 3))]
                calls.append((turn, own))
                turns.append((conv, turn, "a", json.dumps({"tool_calls": own})))
            else:
                ident = rng.choice([None, "c0", "c1", "c9"])
                results.setdefault(ident, turn)
                calls.append((turn, ident))
                turns.append((conv, turn, "t", json.dumps({"tool_call_id": ident, "content": "r"})))
        known = {c["id"] for _, own in calls if isinstance(own, list) for c in own if c["id"] is not None}
        for turn, own in calls:
            if isinstance(own, list):
                bad = sum(brute_errors(c["arguments"], schema, known) > 0 for c in own)
                want.append((conv, turn, len(own), sum(c["id"] is not None and c["id"] in results for c in own), bad, False))
            else:
                want.append((conv, turn, 0, 0, 0, own not in known))
    got = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), {"f": schema}).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.n_calls, r.n_linked, r.n_invalid, r.orphan) for r in got] == want


@pytest.mark.parametrize(
    "schema,good,bad",
    [
        ({"minimum": 3, "exclusiveMaximum": 5}, [3, 4.5, "x"], [2, 5]), ({"multipleOf": 0.1}, [0.3, 2], [0.25]), ({"minLength": 2, "pattern": "^a"}, ["ab", 1], ["a", "ba"]),
        ({"uniqueItems": True, "maxItems": 2}, [[1, True], []], [[1, 1], [1, 2, 3]]), ({"const": 1}, [1], [True, "1"]), ({"enum": [1, None]}, [1, None], [True, 0]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 5], [4]), ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [4, 5.5], [5, 4.5]), ({"not": {"type": "null"}}, [0], [None]),
        ({"properties": {"a": False}, "additionalProperties": {"type": "integer"}}, [{"b": 1}], [{"a": 1}, {"b": "x"}]), ({"minProperties": 1}, [{"a": 1}], [{}]), (True, [1], []), (False, [], [1]),
    ],
)
def test_schema_keywords(schema, good, bad):
    chat.check_schema(schema)
    assert not any(chat.violations(v, schema) for v in good) and all(chat.violations(v, schema) for v in bad)


def test_schemas_that_cannot_be_checked(spark):
    turns = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    for schema in ({"if": {}}, {"properties": {"a": {"dependentRequired": {}}}}, {"items": 3}):
        with pytest.raises(ValueError, match="unknown keyword|a schema is"):
            chat.format_chat(turns, {"f": schema})


def test_url_columns_keep_their_order(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.org/fr/x", "h", "e")], "page_id long, url string, html string, extra string")
    few = url_filter.judge(pages, {"org/fr/": "allow"})
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    many = url_filter.judge(pages, {"org/fr/": "allow"})
    assert few.columns == many.columns and few.collect() == many.collect()
