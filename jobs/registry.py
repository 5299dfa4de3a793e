"""The jobs as registered queries, run twice over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import alert_feed, scorecard
from jobs.common import load_config, new_folder
from siftline.operators.suppress import MARKERS, OPENERS
from siftline.plans.registry import FNV_SQL, prose_rules, sql_found
from siftline.sources.packs import SEVERITIES


def job1_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = new_folder(spark, "scorecard"), load_config(scorecard.__file__)
    for _ in range(2):
        scorecard.run(spark, sf_dir, output, config)
    return scorecard.read(spark, output)


def job2_alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = new_folder(spark, "alert-feed"), load_config(alert_feed.__file__)
    source = f"{sf_dir}/documents.parque[t]"  # a pattern: as such a file stream takes a single file, too
    for _ in range(2):
        alert_feed.run(spark, source, output, config)
    return alert_feed.read(spark, output)


def queries() -> dict:
    return {"job1_scorecard": job1_scorecard, "job2_alert_feed": job2_alert_feed}


def _loud(name: str) -> str:
    """Findings without those that a marker on their line, or the one before, silences."""
    opened = "(?:" + "|".join(f"\\{o[0]}\\{o[1]}" if o in ("/*",) else "\\*" if o == "*" else o for o in OPENERS) + ")"
    marks = "|".join(MARKERS)
    line = "string_split(t, chr(10))[start_line - {0}]"
    names = f"list_filter(regexp_split_to_array(regexp_extract({line}, '{opened}\\s*(?:{marks})(.*)$', 1), '[:, \\t]'), lambda x: regexp_full_match(x, '[A-Za-z0-9._-]+'))"
    silent = " OR ".join(f"(start_line > {k} AND regexp_matches({line.format(k)}, '{opened}\\s*(?:{marks})') AND (len({names.format(k)}) = 0 OR list_contains({names.format(k)}, rule_id)))" for k in (0, 1))
    return f"SELECT * FROM {name} WHERE severity_rank >= 1 AND NOT coalesce({silent}, false)"


def _scorecard_sql() -> str:
    corpora = {
        "documents": ("coalesce(source, '')", "CAST(doc_id AS VARCHAR)", "text"),
        "pages": ("lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1))", "CAST(page_id AS VARCHAR)", "html"),
        "conversations": ("coalesce(role, '')", "conv_id || '/' || turn", "text"),
    }
    categories = ", ".join(f"('{c}')" for c in sorted({r.category for r in prose_rules()}))
    parts = []
    for name, (owner, key, text) in corpora.items():
        found = sql_found(f"(SELECT {owner} AS owner, {key} AS id, {text} AS body FROM {name})", "owner || chr(1) || id", "body", "", prose_rules())
        parts.append(f"""SELECT * FROM (WITH {found}, loud AS ({_loud("found")}),
            owned AS (SELECT *, split_part(k, chr(1), 1) AS owner, '{name}/' || split_part(k, chr(1), 2) AS spot FROM loud),
            hits AS (SELECT owner, category, count(DISTINCT k) AS files_hit, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)},
                     arg_min([rule_id, spot, CAST(start_line AS VARCHAR)], (string_split(spot, '/'), start_line, start_column, rule_id)) AS f FROM owned GROUP BY owner, category),
            owners AS (SELECT {owner} AS owner, count(*) AS files FROM {name} GROUP BY 1),
            filled AS (SELECT o.owner, o.files, v.category, coalesce(files_hit, 0) AS files_hit, {", ".join(f"coalesce({s}, 0) AS {s}" for s in SEVERITIES)}, f
                       FROM owners o CROSS JOIN (VALUES {categories}) v(category) LEFT JOIN hits h ON h.owner = o.owner AND h.category = v.category)
            SELECT owner, files, files_hit, info + low + medium + high + critical AS findings, info, low, medium, high, critical, f[1] AS first_rule, f[2] AS first_path, CAST(f[3] AS BIGINT) AS first_line,
                   1000 * (low + 3 * medium + 7 * high + 10 * critical) // files AS score, '{name}' AS corpus, category FROM filled)""")
    return "SELECT *, CASE WHEN score <= 0 THEN 'A' WHEN score <= 25 THEN 'B' WHEN score <= 100 THEN 'C' WHEN score <= 400 THEN 'D' ELSE 'F' END AS grade FROM (" + " UNION ALL ".join(parts) + ")"


def _alert_feed_sql() -> str:
    snippet = ", trim(string_split(t, chr(10))[len(string_split(t[1:CAST(off AS BIGINT)], chr(10)))], ' ' || chr(9) || chr(13)) AS code_snippet"
    found = sql_found("documents", "doc_id", "text", "documents/", prose_rules(), snippet)
    return f"""WITH {found}, loud AS ({_loud("found")}),
        named AS (SELECT *, rule_id || chr(0) || path || chr(0) || regexp_replace(code_snippet, '\\s+', ' ', 'g') AS print FROM loud),
        first AS (SELECT print, arg_min((rule_id, category, path, start_line, start_column, code_snippet, severity), (start_line, start_column)) AS f, count(*) AS places FROM named GROUP BY print),
        hexed AS (SELECT *, hex(encode(print)) AS hx FROM first)
        SELECT {FNV_SQL.format("hx")} AS fingerprint, f[1] AS rule_id, f[2] AS category, f[3] AS path, CAST(f[4] AS BIGINT) AS start_line, CAST(f[5] AS BIGINT) AS start_column, f[6] AS code_snippet,
               places, 0 AS batch, f[7] AS severity FROM hexed"""


def oracle_sql() -> dict[str, str]:
    return {"job1_scorecard": _scorecard_sql(), "job2_alert_feed": _alert_feed_sql()}
