"""Decontamination, language, quality, encoders and token files against brute force and the libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftline.llm import decontamination, language, pieces, quality, token_counts, token_files
from siftline.llm.units import ByteBpe
from siftline.session import Scratch, ship
from tests.llm import helpers as H

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ITEMS = [("9", H.PASSAGE), ("10", "lorem ipsum dolor"), ("2", "!!"), ("3", None), ("4", "quick brown fox jumps over the lazy dog while the cat"), ("4", "nothing of the kind is in any text at all here")]


def bench(spark, items=ITEMS):
    return ship(spark).createDataFrame(items, "item_id string, text string")


def noise(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab  \n\té日😀▁'s12.,!<|>\x00\r\u2003") for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    got = decontamination.scan(H.docs(spark), bench(spark)).orderBy("doc_id").select("contamination.*", "key").collect()
    want = H.contaminated(H.TEXTS, ITEMS)
    assert [(r.n_words, sum(h.last - h.first + 1 for h in r.hits), r["items"]) for r in got] == want
    left = decontamination.remove(H.docs(spark), bench(spark))
    assert left.columns == H.docs(spark).columns and left.count() == sum(not w[2] for w in want)


def test_decontamination_of_nothing(spark):
    assert decontamination.scan(H.docs(spark).limit(0), bench(spark)).count() == 0
    assert decontamination.remove(H.docs(spark), bench(spark, ITEMS[:0])).count() == len(H.TEXTS)


def test_longest_matches(spark):
    texts = ["a b c d", "x b c d e y", "b c"]
    got = decontamination.longest_matches(H.docs(spark, texts), bench(spark, [("i", "b c d e f")])).orderBy("item_word").collect()
    assert [(r.item_word, r.n_words, r.doc_id, r.doc_word) for r in got] == [(0, 4, 1, 1), (1, 3, 1, 2), (2, 2, 1, 3)]


def longest(text, items, window):
    """(words, first word, item) of the longest match of a window or more; the first, then that of the least item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.lower(t))
    found, w = [], words(text)
    for k, t in items:
        v = words(t)
        for i, j in ((i, j) for i in range(len(w)) for j in range(len(v))):
            n = next((n for n in range(min(len(w) - i, len(v) - j)) if w[i + n] != v[j + n]), min(len(w) - i, len(v) - j))
            if n >= min(window, len(v)):
                found.append((-n, i, k or ""))
    n, i, k = min(found, default=(0, 0, None))
    return (-n, i, k) if found else None


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 60])
def test_longest_match_of_each_document(spark, monkeypatch, block):
    """Repetitive texts, so matches overlap, tie and follow each other; every block gives its own, the best one stays."""
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(8)
    words = ["a", "B", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "a " * 50]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 6, 8, 9, 20])))) for i in range(12)] + [("t", "a " * 30), (None, "é é é é é é é"), ("n", None)]
    docs = H.docs(spark, texts)
    got = [r.longest for r in decontamination.scan(docs, bench(spark, items), window=7).orderBy("doc_id").select("contamination.*").collect()]
    want = [longest(t, items, 7) for t in texts]
    assert [x and (x.n_words, x.first, x.item_id) for x in got] == want and len({x and x[0] for x in want}) > 4
    assert decontamination.remove(docs, bench(spark, items), window=7).count() == sum(x is None for x in want)


def test_benchmark_of_many_blocks(spark, monkeypatch):
    """The same rows from one block and from many, and nothing of the corpus is written on the way."""
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(n))
    items = [(str(i), line(40)) for i in range(500)]
    texts = [line(60) if i % 3 else line(20) + " " + items[i][1][5:120] + " " + line(20) for i in range(300)]
    rows = lambda: decontamination.scan(H.docs(spark, texts), bench(spark, items)).orderBy("doc_id").collect()
    one = rows()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    with Scratch(spark) as block:
        many = rows()
        assert len(block.paths) == 1 and next(iter(block.paths)).rsplit("/", 1)[1].startswith("benchmark-")
    assert one == many and sum(bool(r.contamination["items"]) for r in one) >= 100
    best = lambda: sorted(tuple(r) for r in decontamination.longest_matches(H.docs(spark, texts), bench(spark, items), least=8).collect())
    several = best()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 8 << 20)
    assert several == best() and several


def test_decontamination_random(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(6)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(30)]
    got = decontamination.scan(H.docs(spark, texts), bench(spark, items), window=4).orderBy("doc_id").select("contamination.*").collect()
    assert [(r.n_words, sum(h.last - h.first + 1 for h in r.hits), r["items"]) for r in got] == H.contaminated(texts, items, 4)


def test_quality(spark):
    texts = [*H.TEXTS, *noise(60)]
    got = quality.judge(H.docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r.quality[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got] == [H.quality(t) for t in texts]
    by = {texts[r.doc_id]: r.quality for r in got}
    assert by[H.TEXTS[31]].kept and not by["word " * 30].kept and by["# $ % & | < > * " * 5].failed[0:1] and not any(r.quality.kept and r.quality.base_failed for r in got)
    plan = quality.judge(H.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_rules_are_data(spark):
    rules = (quality.Rule("short", "n_words", low=3), quality.Rule("wide", "mean_word_chars", high=10))
    got = quality.judge(H.docs(spark, ["a b", "a b c", "x" * 40 + " b c"]), rules=rules).orderBy("doc_id").collect()
    assert [r.quality.failed for r in got] == [["short"], [], ["wide"]]


@pytest.mark.parametrize("texts", [[t or "" for t in H.TEXTS], noise()])
def test_encoders_equal_their_libraries(texts):
    column = pa.array(texts)
    encoder = pieces.PieceEncoder(PIECE)
    theirs = encoder.vocabulary.model.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(column)] == theirs
    bpe = ByteBpe(BPE)
    ids = [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, bpe.dtype).tolist() for x in bpe.encode(column)] == ids
    assert token_counts.ByteBpeCounter(BPE).count(column) == [len(x) for x in ids]
    assert token_counts.PieceCounter(PIECE).count(column) == [len(x) - 2 for x in theirs]


def test_caches_do_not_change_results():
    encoder, bpe = pieces.PieceEncoder(PIECE), ByteBpe(BPE)
    encoder.units.most = bpe.tails.most = bpe.heads.most = 3
    for t in noise(50, 2):
        assert encoder.encode(pa.array([t])) == pieces.coder(pieces.PieceEncoder, PIECE).encode(pa.array([t]))
        assert np.frombuffer(bpe.encode(pa.array([t]))[0], bpe.dtype).tolist() == bpe.tokenizer.encode(t, add_special_tokens=False).ids


def test_long_units_take_the_heap():
    v = pieces.MergeVocabulary(PIECE)
    for unit in ("▁" + "internationalization" * 9, "▁" * 50 + "x", "▁" + "ab" * 100):
        assert v.ids(v.agenda(unit)) == v.model.encode(unit[1:].replace("▁", " "))
        assert v.ids(v.agenda(unit[:30])) == np.frombuffer(v.packed([unit[:30]])[0], "<u4").tolist()


def test_pieces_column(spark):
    got = pieces.encode(H.docs(ship(spark)), PIECE).orderBy("doc_id").collect()
    model = pieces.coder(pieces.PieceEncoder, PIECE).vocabulary.model
    assert all(r.agrees for r in got)
    assert [(r.n_tokens, r.decoded) for r in got] == [(len(model.encode(t or "")) + 2, model.decode(model.encode(t or ""))) for t in H.TEXTS]
    assert pieces.encode(H.docs(spark).limit(0), PIECE).count() == 0


def test_token_counts_column(spark):
    got = token_counts.with_token_counts(H.docs(ship(spark)).withColumn("n_tokens", F.lit("clash")), BPE, limit=100).orderBy("doc_id").collect()
    bpe = ByteBpe(BPE).tokenizer
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len((t or "").encode()), n := len(bpe.encode(t or "", add_special_tokens=False)), n > 100) for t in H.TEXTS]


def test_token_files(spark):
    rows = H.docs(ship(spark), extra=False).select("doc_id", "text").unionByName(spark.createDataFrame([(3, "again"), (None, "no id"), (3, "\n\n")], "doc_id long, text string"))
    files = token_files.write(rows, BPE, 2)
    got = token_files.digest(files.read(files.entries.select("key", "occurrence")), files.dtype).join(files.starts(), "shard").collect()
    tokens, at = ByteBpe(BPE).tokenizer, 0
    want = []
    for k, t in sorted(((r.doc_id, r.text) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert sorted(((r.key, r.before + r.offset, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    absent = spark.range(1000, 1200).selectExpr("id AS key", "0L AS occurrence")
    assert files.locate(absent).count() == 0
    empty = token_files.write(rows.limit(0), BPE, 2)
    assert empty.read(empty.entries.select("key", "occurrence")).count() == 0


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 100, 5000):
        hashes = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
        displacement, slot = token_files.build_index(hashes)
        assert sorted(slot.tolist()) == list(range(n)) and (token_files.slots_of(hashes, displacement, n) == slot).all()


def test_long_benchmark_items_take_little_memory(spark):
    """An item of 100,000 words beside short ones: arrays in proportion to the words, windows and longest matches as ever; a null item_id is an empty string."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(5000)]
    long = [rng.choice(vocabulary) for _ in range(100_000)]
    items = [("long", " ".join(long)), *((f"s{k}", " ".join(rng.choices(vocabulary, k=3))) for k in range(500)), (None, "null item here")]
    held = decontamination.Benchmark(items)
    assert sum(v.nbytes for v in vars(held).values() if isinstance(v, np.ndarray)) < 100 * len(held.item) + (4 << 20)
    texts = ["x " + " ".join(long[70_000:70_500]) + " y", " ".join(long[99_995:]), "a null item here", "none"]
    got = decontamination.scan(H.docs(spark, texts), bench(spark, items)).orderBy("doc_id").select("contamination.*").collect()
    want = H.contaminated(texts, [(k or "", t) for k, t in items])
    assert [(r.n_words, sum(x["last"] - x["first"] + 1 for x in r.hits), sorted(r["items"])) for r in got] == want and want[0][1] >= 500 and want[2][2] == [""]
    best = decontamination.longest_matches(H.docs(spark, texts), bench(spark, items[:1])).filter("item_word = 70000").first()
    assert (best.n_words, best.doc_id, best.doc_word) == (500, 0, 1)


def test_other_kinds_of_tokenizers_are_refused():
    """Texts are cut for byte-level pre-tokens only; a vocabulary with others is an error, not a wrong count."""
    import public_tokenizers

    with pytest.raises(ValueError, match="word_bpe"):
        ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_clashing_hashes_are_set_apart():
    """Two keys of one 64-bit hash get a seed that tells them apart; the index file keeps it."""
    hashes, others = np.array([7, 7, 9, 11], np.uint64), np.array([1, 2, 1, 5], np.uint64)
    own, seed = token_files.distinct_hashes(hashes, others)
    assert seed == 1 and len(set(own.tolist())) == 4
    displacement, slot = token_files.build_index(own)
    raw = b"".join(token_files.pack_index(own, seed, displacement, slot, *[np.arange(4)] * 3))
    got, displacement, slots = token_files.unpack_index(raw)
    found = slots[token_files.slots_of(token_files.seeded(hashes, others, got), displacement, 4)]
    assert found["offset"].tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        token_files.distinct_hashes(np.array([7, 7], np.uint64), np.array([1, 1], np.uint64))


def test_language(spark):
    held = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id >= 200").selectExpr("doc_id AS key", "text", "lang AS label"))
    got = language.identify(held, model=model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.98 * len(got) and sum(not r.kept for r in got) <= 1
    rows = spark.createDataFrame(
        [(1, "", None, None), (2, None, "de", "x.de"), (3, '<html lang="fr-CA"><p>the</p>', None, "a.b.fr"), (4, "und die der das ist nicht ein Haus mit dem Garten", None, "a.com")],
        "doc_id long, text string, lang string, source string",
    )
    got = {r.doc_id: r for r in language.identify(rows, model=model).collect()}
    assert got[4].language == "de" and got[3].language == "fr" and got[3].declared == "fr" and got[2].language == "de" and len(got) == 4
    assert language.identify(rows.limit(0), model=model).count() == 0 and language.identify(rows.withColumn("lang", F.lit(None).cast("string"))).filter("kept").count() == 0


def test_host_priors_are_smoothed(spark):
    counts = ship(spark).createDataFrame([("a.x.com", 90, 10), ("b.x.com", 0, 1), ("c.y.org", 0, 50)], "host string, n0 long, n1 long")
    p = {r.host: np.exp(r.prior) for r in language.host_priors(counts, 2).collect()}
    assert all(abs(x.sum() - 1) < 1e-9 for x in p.values())
    assert p["a.x.com"][0] > 0.8 and p["b.x.com"][0] > 0.6 and p["c.y.org"][1] > 0.9  # b follows its domain


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.", "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
]


def test_language_rejects_rows_that_show_none(spark):
    """Blank, symbol-only and foreign rows in a corpus that one language leads are rejected; so are the rows of a label left out of the models."""
    blank = [None, "", " \n\t", "12 345, 6.7", "# $ % & | < > * " * 5, "?!"]
    held = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    planted = spark.createDataFrame([(1000 + i, t, None, "src1") for i, t in enumerate(blank + FOREIGN)], held.schema)
    known = [(2000, "", None, "x.de"), (2001, '<html lang="fr">', None, None), (2002, FOREIGN[0], None, "x.de"), (2003, '<html lang="fi">' + FOREIGN[0], None, None)]
    rows = held.unionByName(planted).unionByName(spark.createDataFrame(known, held.schema))
    left = {r.doc_id for r in language.keep(rows).collect()}
    assert not left & set(range(1000, 2000)) and left & set(range(2000, 2010)) == {2000, 2001} and len([i for i in left if i < 1000]) >= 199
    model = language.fit(held.filter("lang != 'de'").selectExpr("doc_id AS key", "text", "lang AS label"))
    out = language.identify(held, model=model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.kept for r in out if r.lang == "de") == 0 and sum(not r.kept for r in out if r.lang != "de") <= 1


def test_language_models_every_label(spark):
    """Seventy labels, each with an alphabet of its own; the rarest has one row."""
    alphabet = lambda k: [chr(0x4E00 + 20 * k + j) for j in range(20)]
    rng = random.Random(4)
    texts = [(k, " ".join("".join(rng.choices(alphabet(k), k=4)) for _ in range(60))) for k in range(70) for _ in range(1 if k == 69 else 2)]
    rows = ship(spark).createDataFrame([(i, t, f"l{k:02}", "src") for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(rows).collect()}
    assert all(got[i].language == f"l{k:02}" and got[i].kept for i, (k, _) in enumerate(texts))
    many = spark.range(language.MOST_LABELS + 1).selectExpr("id AS key", "'abc' AS text", "concat('l', id) AS label")
    with pytest.raises(ValueError, match="labels"):
        language.fit(many)


def posteriors(rows, languages, table, least=language.LEAST):
    """Brute force over rows (key, text, address): (language, confidence, kept), from the model's table and the module's constants."""
    import math
    import re
    from collections import Counter

    n, seen, own = len(languages), [], {}
    letter = lambda b: b + 32 if 65 <= b <= 90 else b
    for key, text, address in rows:
        data = [letter(b) for b in (text or "").encode()]
        data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in data]
        grams = [(a << 16 | b << 8 | c) for a, b, c in zip(data, data[1:], data[2:]) if (a, b, c) != (32, 32, 32)]
        classes = [((g * 0x9E3779B97F4A7C15) % (1 << 64)) >> 49 for g in grams]
        total = [math.fsum(float(table[k][g]) for g in classes) for k in range(n + 1)]
        weight = min(language.SHARE, language.LIMIT / max(1, len(grams)))
        score = [(t - max(total[:n])) * weight for t in total[:n]]
        declared = (re.search(r"""(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})""", text or "") or [None, ""])[1].lower()
        host = re.match(r"^(?:[^:/?#]+://)?([^/?#:]*)", address or "")[1].lower()
        suffix = language.SUFFIXES.get(host.rpartition(".")[2]) if "." in host else None
        for named, trust in ((declared, language.DECLARED), (suffix, language.SUFFIX)):
            if named in languages:
                score = [s + math.log(trust if x == named else (1 - trust) / max(1, n - 1)) for s, x in zip(score, languages)]
        fits = bool(grams) and max(total[:n]) > total[n]
        shown = fits or declared in languages or (suffix in languages and not grams)
        own[key] = score, host, shown
        if shown:
            seen.append((host, max(range(n), key=lambda k: score[k])))
    part = lambda host, size: ".".join(host.split(".")[-size:])
    counts = [Counter((level(h), k) for h, k in seen) for level in (lambda h: "", lambda h: part(h, 1), lambda h: part(h, 2), lambda h: h)]
    hosts, out = {h for h, _ in seen}, {}
    for key, (score, host, shown) in own.items():
        prior = [1 / n] * n
        if host in hosts:
            for count, name in zip(counts, ("", part(host, 1), part(host, 2), host)):
                size = sum(count[name, k] for k in range(n))
                prior = [(count[name, k] + language.SMOOTHING * prior[k]) / (size + language.SMOOTHING) for k in range(n)]
        post = [s + math.log(p) for s, p in zip(score, prior)]
        best = max(range(n), key=lambda k: post[k])
        confidence = 1 / math.fsum(math.exp(x - post[best]) for x in post)
        out[key] = languages[best], confidence, shown and round(confidence, 6) >= least
    return out


def test_posteriors_against_brute_force(spark):
    """Documents with odd rows, and pages with markup and addresses: every language, confidence and verdict."""
    from siftline.llm import registry

    sf = "/root/testdata/sf0.001"
    docs = ship(spark).read.parquet(f"{sf}/documents.parquet")
    odd = [(5000, None, None, "x.de"), (5001, "", None, None), (5002, '<html lang="fr"> the', None, "http://a.b.fr:80/x"), (5003, "the " * 3000, None, "a.b.fr"), (5004, "12", None, "c.at"), (5004, "12", None, "c.at")]
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    models = language.fit(rows.selectExpr("doc_id AS key", "text", "lang AS label")), language.fit(docs.selectExpr("doc_id AS key", "text", "lang AS label"))
    for (languages, table), held, found, key in (
        (models[0], [tuple(r) for r in rows.select("doc_id", "text", "source").collect()], language.identify(rows.selectExpr("*", "1 AS host", "'x' AS key"), model=models[0]), "doc_id"),
        (models[1], [tuple(r) for r in pages.select("page_id", "html", "url").collect()], registry.llm_page_languages(spark, sf), "page_id"),
    ):
        want, got = posteriors([*{r[0]: r for r in held}.values()] if key == "page_id" else held, languages, table), found.collect()
        assert len(got) == len(held) and {r[key] for r in got} == set(want)
        for r in got:
            name, confidence, kept = want[r[key]]
            assert abs(r.confidence - confidence) < 1e-4 and r.kept == kept and (r.language == name or abs(confidence - 0.5) < 1e-3)


def test_empty_tables_and_clashing_columns(spark):
    """Operators that add columns to a table: nothing for no rows, other columns pass through, those of the added names are replaced."""
    rows = H.docs(ship(spark), extra=False).select("doc_id", "text")
    adding = {
        "quality": (lambda d: quality.judge(d), ["quality"]),
        "counts": (lambda d: token_counts.with_token_counts(d, BPE), ["n_bytes", "n_tokens", "over_limit"]),
        "pieces": (lambda d: pieces.encode(d, PIECE), ["ids", "n_tokens", "decoded", "agrees"]),
        "benchmark": (lambda d: decontamination.scan(d, bench(spark)), ["contamination"]),
    }
    for run, added in adding.values():
        assert run(rows.limit(0)).count() == 0
        plain = run(rows).orderBy("doc_id").collect()
        clash = run(rows.selectExpr("*", *[f"'old' AS {c}" for c in added], "'kept' AS `__t`", "7 AS `other name`", "'kept' AS `__n_tokens`")).orderBy("doc_id")
        assert sorted(clash.columns) == sorted([*rows.columns, *added, "__t", "other name", "__n_tokens"])
        got = clash.collect()
        assert [tuple(r[c] for c in ("doc_id", "text", *added)) for r in got] == [tuple(r[c] for c in ("doc_id", "text", *added)) for r in plain]
        assert all(r["__t"] == r["__n_tokens"] == "kept" and r["other name"] == 7 for r in got)
