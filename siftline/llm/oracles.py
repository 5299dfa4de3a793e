"""DuckDB SQL for the queries of this package that it can express over whole tables."""

from __future__ import annotations

from itertools import permutations

from siftline.llm import quality

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def decontamination(window: int = 10) -> str:
    """Windows of items joined with those of documents, by their words; every document word inside one is hit."""
    return f"""
    WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w FROM documents),
    items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w FROM benchmark),
    begun AS (SELECT item_id, w, least(len(w), {window}) AS n, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM begun),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
    hits AS (SELECT p.doc_id, p.i, p.n, s.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places) p JOIN windows s ON s.n = p.n AND s.g = p.g),
    words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, ids IS NOT NULL AS contaminated
    FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)"""


def quality_rules() -> str:
    """The measures, and the threshold table as one condition."""
    bounds = [f"{r.measure} {sign} {limit}" for r in quality.RULES for sign, limit in (("<", r.low), (">", r.high)) if limit is not None]
    stops = ", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
    begun AS (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM docs WHERE len(w) >= {quality.WINDOW}),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g FROM begun) QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    again AS (SELECT doc_id, count(DISTINCT pos) AS r FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS pos FROM twice) GROUP BY doc_id),
    counted AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                       len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop
                FROM docs LEFT JOIN again USING (doc_id)),
    measured AS (SELECT *, {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'n_words')} AS symbol_ratio, {ratio('n_stop', 'n_words')} AS stop_word_ratio,
                        {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('n_repeat_words', 'n_words')} AS repeat_word_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {' OR '.join(bounds)}) AS kept FROM measured"""


def ngram_jaccard(n: int = 3, num: int = 90, den: int = 100) -> str:
    """Overlaps counted over all shared shingles; components by the least document that links reach."""
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
    -- Equal sets are one class, known by its least document.
    classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2),
    grams AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
    pairs AS (SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
    same AS (SELECT x.doc_id AS a, y.doc_id AS b FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) x JOIN (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 2) y ON x.s = y.s),
    links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, b FROM same UNION SELECT b, a FROM same),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.b AS component_id FROM sets s JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = s.doc_id"""


def url_filter(rules: dict[str, str]) -> str:
    """Hosts, paths and rules of all pages; verdicts where no page links to another host.

    Ranks have no SQL.  Without links between hosts a host's distrust is its own, so it is blocked where rules block
    most of its pages; with any such link the verdict is null and the comparison fails.
    """
    values = ", ".join("('{}', '{}', '{}', '{}')".format(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in rules.items())
    return rf"""
    WITH cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM (SELECT page_id, html, coalesce(url, '') AS url FROM pages)),
    named AS (SELECT page_id, html, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
    rules(site, start, rule, verdict) AS (VALUES {values}),
    fit AS (SELECT n.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
            FROM named n JOIN rules r ON (n.host = r.site OR ends_with(n.host, '.' || r.site)) AND starts_with(n.path, r.start) GROUP BY n.page_id),
    judged AS (SELECT n.page_id, host, path, rule, verdict FROM named n LEFT JOIN fit f USING (page_id)),
    linked AS (SELECT count(*) AS n FROM named WHERE regexp_matches(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*[a-z][a-z0-9+.-]*://')),
    spoiled AS (SELECT host FROM judged WHERE host <> '' GROUP BY host HAVING 2 * count(*) FILTER (verdict = 'block') > count(*))
    SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN (SELECT n FROM linked) > 0 THEN NULL WHEN host IN (FROM spoiled) THEN 'block' ELSE 'allow' END AS verdict FROM judged"""


def filter_audit() -> str:
    """Each document is taken through each order; a filter removes what fails it and none before it."""
    orders = ", ".join("('{}')".format("".join(p)) for p in permutations("ABCDE"))
    fails = """(CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END)"""
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    judged AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM docs LEFT JOIN marks USING (doc_id)),
    kinds AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
    steps AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM (VALUES {orders}) v(o)),
    met AS (SELECT k.*, filter_order, step, substr(filter_order, step, 1) AS f, (strpos(filter_order[1:step - 1], 'A') > 0 AND a) OR (strpos(filter_order[1:step - 1], 'B') > 0 AND b)
              OR (strpos(filter_order[1:step - 1], 'C') > 0 AND c) OR (strpos(filter_order[1:step - 1], 'D') > 0 AND d) OR (strpos(filter_order[1:step - 1], 'E') > 0 AND e) AS gone,
              CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) + CAST(d AS INT) + CAST(e AS INT) AS n_fails FROM kinds k, steps),
    told AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, f, sum(n) FILTER (NOT gone AND NOT {fails}) AS kept, sum(n) FILTER (NOT gone AND {fails}) AS removed, sum(n) FILTER (gone AND {fails}) AS redundant,
                    sum(n) FILTER ({fails} AND n_fails = 1) AS unique_fails, sum(good) FILTER (NOT gone AND {fails}) AS good_lost, sum(toxic) FILTER (NOT gone AND {fails}) AS toxic_lost FROM met GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM told"""


def oracle_sql(url_rules: dict[str, str]) -> dict[str, str]:
    return {
        "op11_filter_audit": filter_audit(),
        "op1_decontamination": decontamination(),
        "op3_quality_rules": quality_rules(),
        "op6_url_filter": url_filter(url_rules),
        "op9_ngram_jaccard": ngram_jaccard(),
    }
