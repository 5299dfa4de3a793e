"""Brute-force versions that the operators are held against, and awkward rows."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
#: Texts that are empty, blank, tiny, repeated, long, odd in their spaces, of other scripts, or share passages.
TEXTS = [
    None, "", " ", "\n\n", "a", "A b", "the end", "x  y", " lead", "trail ", "tab\there", "line\nline\nline", "nbsp\u00a0here", "日本語 テキスト", "é è ü ß", "😀 emoji",
    "\x00nul \x01one", "▁mark ▁▁", "<|endoftext|> inside <|endoftext|>", "don't we'll I'm", "1,000.50 and 3.14", "a" * 400, "ab " * 900, "word " * 30,
    f"before {PASSAGE} after", f"{PASSAGE.upper()}!", PASSAGE, PASSAGE, PASSAGE + " thirteen", "lorem ipsum dolor sit amet " * 12, "lorem ipsum dolor sit amet " * 12 + "x",
    "The quick brown fox jumps over the lazy dog while the cat sleeps in the sun and the bird sings in the tree near the river bank of the old town.",
    "# $ % & | < > * " * 5, "\r\nwindows\r\nlines\r\n", "z" * 150 + "unique one" + "z" * 150, "q w e r t y u i o p " * 3,
]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i, t, "en" if t and "the " in t else None, "src%d" % (i % 3), len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS key", "'c' AS component", "2 AS node") if extra else df


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contaminated(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for k, t in items:
        w = word.findall(lower(t))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(k)
    out = []
    for t in texts:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c, hit = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def removed(texts, length=100):
    """Per text (bytes, kept bytes, spans) with repeated strings out; texts in order of their ids."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(b[i : i + length])
        out.append((len(b), bytes(x for x, g in zip(b, gone) if not g), len(re.findall(rb"\x01+", bytes(gone)))))
    return out


def jaccard_components(texts, n=3, num=90, den=100):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    name = list(range(len(texts)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]
