"""URL rules, and trust propagated over the links between hosts.

Rules name a host and the beginning of a path and fit that host and all its
subdomains; the longest that fits decides.  Pages that no rule fits are judged
by their host: trust flows along links from hosts whose pages rules mostly
allow (personalised PageRank), distrust flows against the links from hosts
whose pages rules mostly block, and a host is blocked where its distrust
exceeds both its trust and a threshold.  Both are in units of one seed's
weight, so that verdicts don't depend on how many seeds the table has.

Everything is native.  Links are counted by pair of hosts before anything else
moves, ranks are whole numbers (so sums don't depend on their order), and each
round is written to the shared folder.

Defined results
    null url, or one without ://   empty host and path: no rule fits, allowed
    null or empty html             no links
    very long html                 scanned whole
    repeated rows, ties            each row is judged alone; equally long rules: the
                                   first by name
    empty table                    empty result
    clashing columns               input columns pass through; host, path, rule and
                                   verdict replace those of their names
"""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import drop_path, fresh, materialise

#: Whole-number weight of all seeds together; ranks are parts of it.
UNITS = 10**15
#: Rules up to this number are one expression; more are joined by host suffix.
INLINE_RULES = 200
_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^"'\s>]+)"""
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def apply_rules(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``pages`` (host, path) with ``rule``, the longest that fits, else null.  ``rules``: like {"net/": "block"}."""
    order = sorted(rules, key=lambda r: (-len(r), r))
    if len(order) <= INLINE_RULES:
        rule = F.lit(None).cast("string")
        for r in reversed(order):
            rule = F.when(_fits(r, F.col("host"), F.col("path")), F.lit(r)).otherwise(rule)
        return pages.withColumn("rule", rule)
    table = pages.sparkSession.createDataFrame([(r.partition("/")[0], r) for r in order], "suffix string, r string")
    keys = pages.select("host", "path").distinct()
    suffix = F.expr("explode(transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 10000), '.')))")
    fits = keys.withColumn("suffix", suffix).join(table, "suffix").filter(F.expr("startswith(path, substr(r, length(suffix) + 1))"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct(-F.length("r"), "r")).alias("b")).select("host", "path", F.col("b.r").alias("rule"))
    return pages.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in pages.columns], "rule")


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n): numbers of links between different hosts.  Relative links stay on their host."""
    found = pages.select("host", F.explode(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(_LINK), F.lit(1))).alias("url"))
    named = found.select(F.col("host").alias("src"), host_of(F.col("url")).alias("dst"))
    return named.filter("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.count("dst").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = 20, tolerance: int = UNITS // 10**6) -> DataFrame:
    """(host, rank): PageRank personalised on ``seeds`` (host, weight: shares of UNITS) over ``links``.

    Rounds end when less than ``tolerance`` is added to all ranks together, or after ``rounds``.  Without that limit
    they end in any case: ranks only grow, in whole numbers, by ``damping`` of what the round before has added.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    shares = materialise(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    base = seeds.select("host", (F.col("weight") * (1 - damping)).cast("long").alias("rank"))
    ranks, before = materialise(base, "ranks"), -1
    for _ in range(rounds) if rounds is not None else count():
        sent = ranks.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).cast("long").alias("rank"))
        last, ranks = ranks, materialise(base.unionByName(sent).groupBy("host").agg(F.sum("rank").alias("rank")).filter("rank > 0"), "ranks")
        drop_path(links.sparkSession, last.scratch_path)
        now = ranks.agg(F.sum("rank")).first()[0] or 0
        if abs(now - before) < max(1, tolerance):
            break
        before = now
    return ranks


def blocked_hosts(pages: DataFrame, rules: dict[str, str], threshold: float = 1e-6, html_col: str = "html") -> DataFrame:
    """(host, trust, distrust) of the hosts that the link graph blocks; ``pages`` have host and rule.

    Trust, distrust and ``threshold`` count in weights of one seed.
    """
    is_ = lambda what: F.col("rule").isin([r for r, v in rules.items() if v == what])
    counts = pages.filter("host != ''").groupBy("host").agg(F.count("host").alias("n"), F.count_if(is_("allow")).alias("good"), F.count_if(is_("block")).alias("bad"))
    counts = materialise(counts, "hosts")
    n_good, n_bad = counts.agg(F.count_if(F.expr("2 * good > n")), F.count_if(F.expr("2 * bad > n"))).first()
    trusted = counts.filter("2 * good > n").select("host", F.lit(UNITS // max(1, n_good)).alias("weight"))
    spoiled = counts.filter("2 * bad > n").select("host", F.lit(UNITS // max(1, n_bad)).alias("weight"))
    links = materialise(host_links(pages, html_col), "links")
    if links.isEmpty():
        good, bad = (s.select("host", F.col("weight").alias("rank")) for s in (trusted, spoiled))
    else:
        # What all later rounds would add is less than a hundredth of the threshold.
        enough = lambda n: int(threshold / 1000 * UNITS / max(1, n))
        good = propagate(links, trusted, rounds=None, tolerance=enough(n_good))
        bad = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), spoiled, rounds=None, tolerance=enough(n_bad))
    both = bad.select("host", F.col("rank").alias("distrust")).join(good.select("host", F.col("rank").alias("trust")), "host", "left")
    seeds = lambda name, n: (F.col(name) / (UNITS // max(1, n))).alias(name)
    both = both.fillna({"trust": 0}).select("host", seeds("trust", n_good), seeds("distrust", n_bad))
    return both.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold))


def judge(pages: DataFrame, rules: dict[str, str], url_col: str = "url", html_col: str = "html", threshold: float = 1e-6) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c in (url_col, html_col)]
    url = F.col(f"`{url_col}`")
    ruled = apply_rules(pages.select(*rest, host_of(url).alias("host"), path_of(url).alias("path")), rules)
    mark = fresh("__blocked", ruled.columns)
    graph = materialise(blocked_hosts(ruled, rules, threshold, html_col).select("host", F.lit(True).alias(mark)), "blocked")
    verdict = F.when(F.col(mark), F.lit("block")).otherwise(F.lit("allow"))
    for what in ("allow", "block"):
        verdict = F.when(F.col("rule").isin([r for r, v in rules.items() if v == what]), F.lit(what)).otherwise(verdict)
    bare = ruled.drop(*[c for c in (html_col,) if c in ruled.columns])
    if graph.isEmpty():
        return bare.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit("allow")).otherwise(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])[F.col("rule")]))
    return bare.join(graph, "host", "left").withColumn("verdict", verdict).drop(mark)
