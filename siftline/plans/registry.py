"""Queries of the engine's own operators over the driver's tables, and their SQL oracles.

Corpora are ``documents``, ``pages`` and ``conversations`` under the prose pack,
and source files made from ``events`` by a template, since the tables hold no
code.  Every query runs over whole tables and texts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import findings as O
from siftline.operators import graph, match, nodes, query, suppress, taint
from siftline.operators.graph import changed
from siftline.sources import listing, tree
from siftline.sources.packs import BUILT_IN, SEVERITIES, Registry, Rule, load_pack, rules_table
from siftline.sources.state import GraphSnapshot
from siftline.session import Scratch, new_path, spread, table, written


def prose_rules() -> list[Rule]:
    return list(load_pack(BUILT_IN / "corpus").rules)


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = table(spark, sf_dir, name)
    return rows.select(F.col(key).alias("file_id"), F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("path"), F.lit("text").alias("language"), F.col(text).alias("text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.findings(corpus(spark, sf_dir), prose_rules(), unicode_classes=False)


_SHOWN = ("rule_id", "severity", "path", "start_char", "start_byte", "start_line", "start_column", "end_column", "ord", "match_text")


def scan_pattern_findings(spark, sf_dir):
    return found(spark, sf_dir).select(*_SHOWN)


_INLINE = Rule(id="page.inline-script", name="Inline script", severity="low", languages=("text",), regex=r"<script>[^<]*", capability="pattern")
_NO_TRACK = Rule(id="page.quiet-script", name="Script without tracking", severity="info", languages=("text",), regex=r"<style>[^<]*", not_regex=r"track\([0-9]*[05]\)", capability="pattern")


_ACCENTED = Rule(id="text.accented", name="Word from an accented letter on", severity="info", languages=("text",), regex=r"[éèñü]\w+", capability="pattern")


def scan_unicode_words(spark, sf_dir):
    """Classes as Unicode ones, the default of scans."""
    return match.findings(corpus(spark, sf_dir), [_ACCENTED]).select("path", "ord", "start_char", "start_byte", "start_line", "match_text")


def scan_pages(spark, sf_dir):
    return match.findings(corpus(spark, sf_dir, "pages", "page_id", "html"), [_INLINE], False).select("rule_id", "path", "start_line", "start_column", "match_text")


def scan_not_regex(spark, sf_dir):
    return match.findings(corpus(spark, sf_dir, "pages", "page_id", "html"), [_NO_TRACK], False).select("rule_id", "path", "start_line", "start_column")


def scan_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    files = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("file_id"), F.concat_ws("/", F.lit("conversations"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.lit("text").alias("language"), "text")
    rule = Rule(id="chat.repeat", name="Doubled syllable", severity="info", languages=("text",), regex=r"(?:the the|la la|die die|und und|of of) [a-z]+", capability="pattern")
    return match.findings(files, [rule], False).select("path", "ord", "start_char", "start_line", "match_text")


def findings_snippet_line(spark, sf_dir):
    return found(spark, sf_dir).select("rule_id", "path", "ord", "start_line", "code_snippet")


_FOR_LANGUAGE = [
    Rule(id="only.en", languages=("en",), regex="x"),
    Rule(id="only.romance", languages=("fr", "es"), regex="x"),
    Rule(id="any", languages=("en", "fr", "es", "de"), regex="x"),
    Rule(id="only.typescript", languages=("typescript",), regex="x"),
]


def language_rule_applicability(spark, sf_dir):
    """Files that each rule is for; TSX files take TypeScript rules."""
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "tsx").otherwise(F.col("lang")).alias("lang"))
    counts = docs.filter("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    own = [F.when(F.col("lang").isin([x for x in ("en", "fr", "es", "de", "tsx", "typescript") if r.applies(x)]), F.lit(r.id)) for r in _FOR_LANGUAGE]
    return counts.select(F.explode(F.array_compact(F.array(*own))).alias("rule_id"), "lang", "files")


def category_rollup_zero_fill(spark, sf_dir):
    return O.category_rollup(found(spark, sf_dir), rules_table(spark, prose_rules()))


def severity_summary(spark, sf_dir):
    return O.severity_summary(found(spark, sf_dir))


def triage_topk(spark, sf_dir):
    return O.triage(found(spark, sf_dir)).limit(10).select("rule_id", "severity", "path", "start_line", "start_column")


def min_severity_floor(spark, sf_dir):
    return O.at_least(found(spark, sf_dir), "high").groupBy("rule_id", "severity").agg(F.count("path").alias("findings"))


def exit_policy(spark, sf_dir):
    """The exit code under each severity that may fail a scan, and of a degraded scan."""
    rows = written(found(spark, sf_dir))
    codes = [(s, O.exit_code(rows, False, s)) for s in SEVERITIES] + [("none", O.exit_code(rows, False, None)), ("degraded", O.exit_code(rows, True, None))]
    return spark.createDataFrame(codes, "fail_on string, exit_code int")


def _baseline(spark, rows):
    """What findings of even documents were known by, and two fingerprints of findings that are gone."""
    known = rows.filter("file_id % 2 = 0").select("fingerprint")
    return known.unionByName(spark.createDataFrame([("ghost-a",), ("ghost-b",)], "fingerprint string"))


def baseline_new(spark, sf_dir):
    rows = written(found(spark, sf_dir))
    return O.new_against(rows, _baseline(spark, rows)).select("rule_id", "path", "ord", "start_line")


def baseline_existing(spark, sf_dir):
    rows = written(found(spark, sf_dir))
    return O.existing_in(rows, _baseline(spark, rows)).select("rule_id", "path", "ord", "start_line")


def baseline_fixed(spark, sf_dir):
    rows = written(found(spark, sf_dir))
    return O.fixed_since(rows, _baseline(spark, rows))


def baseline_counts(spark, sf_dir):
    rows = written(found(spark, sf_dir))
    return O.baseline_counts(rows, _baseline(spark, rows))


def first_finding_per_rule(spark, sf_dir):
    return O.first_per_rule(found(spark, sf_dir)).select("rule_id", "path", "start_line", "start_column")


_NESTED = [
    Rule(id="span", languages=("text",), regex=r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"),
    Rule(id="span", languages=("text",), regex=r"@[A-Za-z0-9-]+"),
]


def innermost_spans(spark, sf_dir):
    """Two nested patterns reported under one rule; the outer ones go."""
    located = match.locate(match.matches(corpus(spark, sf_dir), _NESTED, False))
    spans = located.select(F.lit("span").alias("rule_id"), "path", "start_byte", (F.col("start_byte") + F.octet_length("match_text")).alias("end_byte"))
    return O.innermost(spans)


def fingerprint_fnv1a(spark, sf_dir):
    return found(spark, sf_dir).select("rule_id", "path", "ord", X.fnv1a64_col(F.col("match_text")).alias("hash"), X.fnv1a64_col(F.lit("")).alias("empty_hash"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source file for each event: a call that a rule finds, at times behind a marker."""
    e = table(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(5))
    body = (
        F.when(kind == 0, "import os\nos.system(cmd)\n")
        .when(kind == 1, "import os\n# nosec\nos.system(cmd)\n")
        .when(kind == 2, "import os\nos.system(cmd)  # nosec: py.other\n")
        .when(kind == 3, "# nosec py.os-system\n\nos.system('x')\n")
        .otherwise("x = 'nosec'; os.system(x)\n")
    )
    return e.select(F.col("event_id").alias("file_id"), F.concat(F.lit("src/"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), body.alias("text"))


_SYSTEM = Rule(id="py.os-system", name="Shell command", severity="high", languages=("python",), regex=r"os\.system\s*\(", capability="pattern")


def suppressed_findings(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = match.findings(files, [_SYSTEM], False)
    silent = suppress.suppressed(rows, suppress.suppressions(files))
    return silent.select("rule_id", "path", "start_line")


def unsuppressed_findings(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = match.findings(files, [_SYSTEM], False)
    return suppress.suppressed(rows, suppress.suppressions(files), "left_anti").select("rule_id", "path", "start_line")


def fixture_verdicts(spark, sf_dir):
    """Half of the files promise a finding on their second line, half promise none."""
    e = code_files(spark, sf_dir)
    mark = F.when(F.col("file_id") % 2 == 0, "# ruleid: py.os-system\n").otherwise("# ok: py.os-system\n")
    files = e.withColumn("text", F.concat(mark, F.when(F.col("file_id") % 3 == 0, "os.system(c)\n").otherwise("pass\n")))
    rows = match.findings(files, [_SYSTEM], False)
    return suppress.verdicts(suppress.annotations(files), rows, ["py.os-system"])


def snapshot_changed_files(spark, sf_dir):
    """Files whose hash a snapshot lacks: every document, against one in which every tenth text was longer."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    was = docs.select("path", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("source_hash"))
    return changed(docs.select("path", F.sha2("text", 256).alias("source_hash")), was).select(F.col("path").cast("long").alias("doc_id"))


def tree_documents(spark, sf_dir):
    """Documents written as a tree of text files by source and language, found and read again from it by executors.

    Folders of one language are excluded, and a copy of the tree lies in a folder that discovery ignores.
    """
    docs = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes")))
    rows = docs.select("source", F.col("lang").alias("language"), line.alias("value"))
    with Scratch(spark) as block:
        root = new_path(spark, "tree")
        for where in (f"{root}/src", f"{root}/src/node_modules/copy"):
            rows.write.option("maxRecordsPerFile", 5000).partitionBy("source", "language").text(where)
        files = listing.read(listing.listing(spark, [root], ["language=de", "_SUCCESS", ".*"]))
        lines = files.select(F.explode(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("line"))
        return block.keep(lines.select(F.from_json("line", "doc_id long, text_md5 string, n_bytes long").alias("row")).select("row.*"))


def graph_snapshot(spark, sf_dir):
    """Facts of modules from a snapshot, after every tenth module has changed: as a full build gives them, and which files were parsed for it."""
    modules = project(spark, sf_dir)
    edited = F.when(F.col("file_id") % 10 == 0, F.concat("text", F.lit("\ndef more(x):\n    return x\n"))).otherwise(F.col("text"))
    hashed = lambda rows: rows.withColumn("source_hash", F.sha2("text", 256))
    snapshot = GraphSnapshot(spark, new_path(spark, "snapshot"))
    snapshot.refresh(hashed(modules))
    known = snapshot.refresh(hashed(modules.withColumn("text", edited)))
    symbols = graph.symbols(known).groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.max("line").alias("last_line"))
    return symbols.withColumn("parsed_files", F.lit(snapshot.parsed).cast("long"))


def _event_paths(spark, sf_dir):
    """A path for each event, with folders and extensions of every sort."""
    e = table(spark, sf_dir, "events")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "gen/deep", "node_modules/x", "./lib", ".github", "a.b")]), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("m.py", "m.java", "m.TS", "m.tsx", "m.jsx", "m", "m.go", "m.test.js")]), (F.pmod("event_id", F.lit(8)) + 1).cast("int"))
    return e.select("event_id", F.concat(folder, F.lit("/"), name).alias("path"))


def language_detection(spark, sf_dir):
    rows = _event_paths(spark, sf_dir).select(tree.language_col(F.col("path")).alias("language"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def exclude_globs(spark, sf_dir):
    rows = _event_paths(spark, sf_dir)
    return rows.filter(~tree.exclude_col(F.col("path"), ["gen", "m.t*", "node_modules/?"])).select("event_id", "path")


def normalized_paths(spark, sf_dir):
    return _event_paths(spark, sf_dir).select("event_id", X.normalize_path(F.col("path")).alias("path"))


def escaped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("escaped_md5"))


def sarif_levels(spark, sf_dir):
    return found(spark, sf_dir).groupBy(X.sarif_level(F.col("severity_rank")).alias("level")).agg(F.count(F.lit(1)).alias("findings"))


def enclosing_spans(spark, sf_dir):
    """The shortest order span (by key range) that holds each supplier key: an interval join by customers' nations."""
    points = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("file_id"), F.col("s_suppkey").alias("at"))
    c = table(spark, sf_dir, "customer")
    spans = c.select(F.col("c_nationkey").cast("long").alias("file_id"), (F.col("c_custkey") % 50).alias("start"), (F.col("c_custkey") % 50 + F.col("c_custkey") % 97 + 1).alias("end"), F.col("c_custkey").alias("span"))
    return nodes.enclosing(points, spans, ["span"]).fillna(-1, ["span"])


def call_graph_closure(spark, sf_dir):
    """What each function reaches: functions are nations, each calls two others of higher number."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    calls = n.select(F.col("k").alias("caller"), F.explode(F.array(F.col("k") * 2 + 1, F.col("k") + 7)).alias("callee")).filter("callee < 25")
    return graph.closure(calls)


def taint_findings(spark, sf_dir):
    """Request parameters that reach a shell, through calls between the functions of one file."""
    e = table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 2 == 0, F.lit("name = request.args.get('n')\n    return send(name)")).otherwise(F.lit("name = clean()\n    return send(name)"))
    text = F.concat(F.lit("def send(url):\n    return requests.get(url)\n\ndef view(request):\n    "), body, F.lit("\n"))
    files = e.select(F.col("event_id").alias("file_id"), F.concat(F.lit("src/"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("text"))
    rules = [r for r in Registry.built_in().rules if r.id == "python.security.ssrf"]
    return taint.taint_findings(files, rules).select("rule_id", "path", "start_line", "source_line", "message")


def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module for each event: it hashes its argument and hands the digest to the module of half its number."""
    e = spread(table(spark, sf_dir, "events").select("event_id"))
    half = F.expr("CAST(event_id DIV 2 AS STRING)")
    algorithm = F.element_at(F.array(*[F.lit(x) for x in ("md5", "sha1", "sha256", "blake2b")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    text = F.concat(
        F.lit("import hashlib\nfrom m"), half, F.lit(" import run_"), half, F.lit("\n\ndef run_"), F.col("event_id").cast("string"),
        F.lit("(value):\n    digest = hashlib."), algorithm, F.lit("(value)\n    return run_"), half, F.lit("(digest)\n"),
    )
    return e.select(F.col("event_id").cast("long").alias("file_id"), F.concat(F.lit("src/m"), F.col("event_id").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), text.alias("text"))


def code_symbols(spark, sf_dir):
    return graph.symbols(graph.facts(project(spark, sf_dir))).select("path", "name", "kind", "line", "has_body")


def code_imports(spark, sf_dir):
    """What each import of a name binds, and the stem of the file it means."""
    return graph.imports(graph.facts(project(spark, sf_dir))).filter("original != '*'").select("file_id", "local", "original", "target")


def code_call_edges(spark, sf_dir):
    """Calls with the file of the function that they resolve to, and how."""
    facts = written(graph.facts(project(spark, sf_dir)))
    syms = graph.symbols(facts).select(F.col("symbol_id").alias("callee_symbol"), F.col("path").alias("callee_path"))
    edges = graph.edges(project(spark, sf_dir), facts)
    return edges.join(syms, "callee_symbol", "left").select("file_id", "line", "callee_text", "how", "callee_path")


def import_targets(spark, sf_dir):
    """The file that an import without extension means, among files of all extensions and index files beside the importing one."""
    e = table(spark, sf_dir, "events")
    places = [x for i, ext in enumerate(graph.IMPORTED) for x in ((2 * i, f"x.{ext}"), (2 * i + 1, f"x/index.{ext}"))] + [(23, "x.go")]
    have = [F.when(F.expr(f"event_id DIV {i + 1} % {len(places)} = {(5 * i) % len(places)}"), F.lit(name)) for i, name in places]
    names = F.concat(F.array(F.lit("main.ts")), F.array_compact(F.array(*have)))
    own = e.select("event_id", F.explode(names).alias("name")).select("event_id", "name", F.concat(F.lit("d"), F.col("event_id").cast("string"), F.lit("/"), F.col("name")).alias("path"))
    text = F.when(F.col("name") == "main.ts", 'import { run } from "./x";\n').otherwise("")
    files = written(own.select(F.xxhash64("path").alias("file_id"), "path", tree.language_col(F.col("path")).alias("language"), text.alias("text"), "event_id"))
    found = graph.import_files(graph.facts(spread(files.filter("text != ''"))), files.select("file_id", "path"))
    return found.join(files.select("file_id", "event_id"), "file_id").select("event_id", "local", "target_path", "rank")


def typed_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript module for each event, which calls the module of half its number by name, namespace and type, and a function that every seventh module has."""
    e = spread(table(spark, sf_dir, "events").select("event_id"))
    k, half = F.col("event_id").cast("string"), F.expr("CAST(event_id DIV 2 AS STRING)")
    text = F.concat(
        F.lit('import * as ns from "./m'), half, F.lit('";\nimport { run_'), half, F.lit(' as go } from "./m'), half, F.lit('";\nclass Svc'), k, F.lit(" {\n  work() { return 1; }\n}\nfunction run_"), k, F.lit("(s: Svc"), half,
        F.lit(") {\n  ns.run_"), half, F.lit("();\n  go();\n  s.work();\n  other();\n}\n"), F.when(F.col("event_id") % 7 == 0, "function other() { }\n").otherwise(""),
    )
    return e.select(F.col("event_id").cast("long").alias("file_id"), F.concat(F.lit("src/m"), k, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("text"))


def resolved_calls(spark, sf_dir):
    """Calls by namespace, import, type and name alone, and where they lead."""
    files = typed_project(spark, sf_dir)
    facts = written(graph.facts(files))
    syms = graph.symbols(facts).select(F.col("symbol_id").alias("callee_symbol"), F.col("path").alias("callee_path"), "qualified_name")
    return graph.edges(files, facts).join(syms, "callee_symbol", "left").select("file_id", "line", "callee_text", "how", "callee_path", "qualified_name")


def taint_same_names(spark, sf_dir):
    """Every second file hands a request parameter to a function named run, of which each other file has its own, with a sink of its own."""
    e = table(spark, sf_dir, "events")
    half = F.expr("CAST(event_id DIV 2 AS STRING)")
    sink = F.when(F.col("event_id") % 3 == 0, "requests.get").otherwise("requests.post")
    lib = F.concat(F.lit("def run(value):\n    return "), sink, F.lit("(value)\n"))
    app = F.concat(F.lit("from lib"), half, F.lit(" import run\n\ndef view(request):\n    name = request.args.get('n')\n    return run(name)\n"))
    even = F.col("event_id") % 2 == 0
    path = F.concat(F.when(even, "src/lib").otherwise("src/app"), half, F.lit(".py"))
    files = e.select(F.col("event_id").cast("long").alias("file_id"), path.alias("path"), F.lit("python").alias("language"), F.when(even, lib).otherwise(app).alias("text"))
    rules = [r for r in Registry.built_in().rules if r.id == "python.security.ssrf"]
    return taint.taint_findings(files, rules).select("rule_id", "path", "start_line", "source_line", "message")


def ast_query_findings(spark, sf_dir):
    """A rule over syntax trees, with predicates, an anchor and a not-regex."""
    rules = [r for r in Registry.built_in().rules if r.id == "korea.py.unsalted-hash"]
    return query.findings(project(spark, sf_dir), rules).select("rule_id", "path", "start_line", "start_column", "match_text")


def class_ancestors(spark, sf_dir):
    """All types above each class; a class for each event, which extends that of half its number."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("class C"), F.col("event_id").cast("string"), F.when(F.col("event_id") > 1, F.concat(F.lit(" extends C"), F.expr("CAST(event_id DIV 2 AS STRING)"))).otherwise(F.lit("")), F.lit(" { }\n"))
    files = e.select(F.col("event_id").cast("long").alias("file_id"), F.concat(F.lit("C"), F.col("event_id").cast("string"), F.lit(".java")).alias("path"), F.lit("java").alias("language"), text.alias("text"))
    return graph.ancestors(written(graph.facts(spread(files)))).select("type", "ancestor", F.col("depth").cast("long").alias("depth"))


def queries() -> dict:
    own = [
        scan_unicode_words, code_symbols, code_imports, code_call_edges, ast_query_findings, class_ancestors,
        scan_pattern_findings, scan_pages, scan_not_regex, scan_conversations, findings_snippet_line, language_rule_applicability,
        category_rollup_zero_fill, severity_summary, triage_topk, min_severity_floor, exit_policy, baseline_new, baseline_existing,
        baseline_fixed, baseline_counts, first_finding_per_rule, innermost_spans, fingerprint_fnv1a, suppressed_findings,
        unsuppressed_findings, fixture_verdicts, snapshot_changed_files, language_detection, exclude_globs, normalized_paths,
        escaped_pages, sarif_levels, enclosing_spans, call_graph_closure, taint_findings, import_targets, resolved_calls, taint_same_names, graph_snapshot, tree_documents,
    ]
    return {f.__name__: f for f in own}


def sql_found(source: str, key: str, text: str, prefix: str, rules: list[Rule], extra: str = "") -> str:
    """A CTE ``found`` that finds the rules' matches with offsets, in DuckDB."""
    values = ", ".join("('{}', '{}', {}, '{}', '{}')".format(r.id, r.severity, r.severity_rank, r.category or "uncategorized", r.regex.replace("'", "''")) for r in rules)
    return f"""
    rules(rule_id, severity, severity_rank, category, rx) AS (VALUES {values}),
    pairs AS (SELECT {key} AS k, '{prefix}' || CAST({key} AS VARCHAR) AS path, {text} AS t, r.*, regexp_extract_all({text}, r.rx) AS m, regexp_split_to_array({text}, r.rx) AS p
              FROM {source}, rules r WHERE regexp_matches({text}, r.rx)),
    spread AS (SELECT *, unnest(range(len(m))) AS i FROM pairs),
    placed AS (SELECT *, list_sum(list_transform(p[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS off FROM spread),
    found AS (SELECT k, rule_id, severity, severity_rank, category, path, t, CAST(off AS INTEGER) AS start_char, strlen(t[1:CAST(off AS BIGINT)]) AS start_byte,
                     len(string_split(t[1:CAST(off AS BIGINT)], chr(10))) AS start_line,
                     length(string_split(t[1:CAST(off AS BIGINT)], chr(10))[-1]) + 1 AS start_column, CAST(i AS INTEGER) AS ord, m[i + 1] AS match_text{extra} FROM placed)"""


#: FNV-1a in DuckDB, over the hexadecimal digits of a text's bytes.
FNV_SQL = (
    "(SELECT lpad(lower(printf('%x', CAST(h // 4294967296 AS BIGINT))), 8, '0') || lpad(lower(printf('%x', CAST(h % 4294967296 AS BIGINT))), 8, '0') FROM (SELECT "
    "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(length({0}) // 2), lambda i: ((strpos('0123456789ABCDEF', {0}[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', {0}[2 * i + 2]) - 1)::UHUGEINT)), "
    "lambda h, x: ((h - h % 256 + xor(h % 256, x)) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h))"
)


def oracle_sql() -> dict[str, str]:
    docs = "WITH " + sql_found("documents", "doc_id", "text", "documents/", prose_rules(), ", trim(string_split(t, chr(10))[len(string_split(t[1:CAST(off AS BIGINT)], chr(10)))], ' ' || chr(9) || chr(13)) AS code_snippet")
    pages = lambda rule: "WITH " + sql_found("pages", "page_id", "html", "pages/", [rule])
    nested = "WITH " + sql_found("documents", "doc_id", "text", "documents/", _NESTED)
    byte = "list_transform(range(octet_length(encode({0}))), lambda i: ((strpos('0123456789ABCDEF', hex(encode({0}))[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode({0}))[2 * i + 2]) - 1)::UHUGEINT)"
    fold = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, " + byte + "), lambda h, x: ((h - h % 256 + xor(h % 256, x)) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
    known = docs + ", print AS (SELECT *, rule_id || chr(0) || path || chr(0) || regexp_replace(code_snippet, '\\s+', ' ', 'g') AS fp FROM found), base AS (SELECT DISTINCT fp FROM print WHERE k % 2 = 0)"
    numbered = """lines AS (SELECT k, path, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM files)"""
    body = """CASE event_id % 5 WHEN 0 THEN 'import os' || chr(10) || 'os.system(cmd)' || chr(10) WHEN 1 THEN 'import os' || chr(10) || '# nosec' || chr(10) || 'os.system(cmd)' || chr(10)
              WHEN 2 THEN 'import os' || chr(10) || 'os.system(cmd)  # nosec: py.other' || chr(10) WHEN 3 THEN '# nosec py.os-system' || chr(10) || chr(10) || 'os.system(''x'')' || chr(10)
              ELSE 'x = ''nosec''; os.system(x)' || chr(10) END"""
    code = f"""WITH files AS (SELECT event_id AS k, 'src/' || event_id || '.py' AS path, {body} AS t FROM events), {numbered},
              hits AS (SELECT k, path, n FROM lines WHERE regexp_matches(l, 'os\\.system\\s*\\(')),
              marks AS (SELECT k, n, regexp_extract(l, '(//|#|/\\*|\\*|--)\\s*nosec(.*)$', 2) AS names FROM lines WHERE regexp_matches(l, '(//|#|/\\*|\\*|--)\\s*nosec')),
              silent AS (SELECT DISTINCT h.k, h.n FROM hits h JOIN marks m ON m.k = h.k AND h.n IN (m.n, m.n + 1) WHERE NOT regexp_matches(names, '[A-Za-z0-9]') OR list_contains(regexp_split_to_array(names, '[, :\t]+'), 'py.os-system'))"""
    noted = f"""WITH files AS (SELECT event_id AS k, '' AS path, CASE WHEN event_id % 2 = 0 THEN '# ruleid: py.os-system' ELSE '# ok: py.os-system' END || chr(10) || CASE WHEN event_id % 3 = 0 THEN 'os.system(c)' ELSE 'pass' END || chr(10) AS t FROM events), {numbered},
              hits AS (SELECT k, n FROM lines WHERE regexp_matches(l, 'os\\.system\\s*\\(')),
              notes AS (SELECT k, n, regexp_extract(l, '(ruleid|ok):\\s*(\\S+)', 1) AS kind, regexp_extract(l, '(ruleid|ok):\\s*(\\S+)', 2) AS rule_id FROM lines WHERE regexp_matches(l, '(ruleid|ok):'))"""
    module = """'import hashlib' || chr(10) || 'from m' || event_id // 2 || ' import run_' || event_id // 2 || chr(10) || chr(10) || 'def run_' || event_id || '(value):' || chr(10) || '    digest = hashlib.' ||
              ['md5', 'sha1', 'sha256', 'blake2b'][event_id % 4 + 1] || '(value)' || chr(10) || '    return run_' || event_id // 2 || '(digest)' || chr(10)"""
    modules = f"WITH files AS (SELECT CAST(event_id AS BIGINT) AS k, 'src/m' || event_id || '.py' AS path, {module} AS t FROM events), {numbered}"
    bound = ", bound AS (SELECT k, regexp_extract(l, 'import (\\w+)$', 1) AS local, 'src/' || regexp_extract(l, '^from (\\w+)', 1) AS target FROM lines WHERE l LIKE 'from %')"
    defined = ", defined AS (SELECT k, path, n, regexp_extract(l, 'def (\\w+)', 1) AS name FROM lines WHERE l LIKE 'def %')"
    called = ", called AS (SELECT k, n, regexp_extract(l, '([\\w.]+)\\(', 1) AS callee FROM lines WHERE l LIKE ' %')"
    flow = f"""WITH files AS (SELECT event_id AS k, 'src/' || event_id || '.py' AS path, 'def send(url):' || chr(10) || '    return requests.get(url)' || chr(10) || chr(10) || 'def view(request):' || chr(10) || '    ' ||
              CASE WHEN event_id % 2 = 0 THEN 'name = request.args.get(''n'')' ELSE 'name = clean()' END || chr(10) || '    return send(name)' || chr(10) AS t FROM events), {numbered},
              bodies AS (SELECT k, path, n, l, max(CASE WHEN l LIKE 'def %' THEN n END) OVER (PARTITION BY k ORDER BY n) AS f FROM lines),
              params AS (SELECT k, n AS f, regexp_extract(l, 'def (\\w+)', 1) AS name, regexp_extract(l, '\\((\\w+)\\)', 1) AS p FROM bodies WHERE l LIKE 'def %'),
              sinks AS (SELECT p.k, p.name FROM params p JOIN bodies b ON b.k = p.k AND b.f = p.f WHERE contains(b.l, 'requests.get(' || p.p || ')')),
              given AS (SELECT k, f, n, regexp_extract(l, '^ +(\\w+) = ', 1) AS v FROM bodies WHERE contains(l, ' = request.args')),
              calls AS (SELECT k, path, f, n, regexp_extract(l, '(\\w+)\\((\\w*)\\)$', 1) AS name, regexp_extract(l, '(\\w+)\\((\\w*)\\)$', 2) AS a FROM bodies WHERE l NOT LIKE 'def %')"""
    values = ", ".join(f"('{r.id}', '{x}')" for r in _FOR_LANGUAGE for x in r.languages)
    zero = ", ".join(f"('{r.category or 'uncategorized'}')" for r in prose_rules())
    paths = """WITH paths AS (SELECT event_id, ['src', 'gen/deep', 'node_modules/x', './lib', '.github', 'a.b'][event_id % 6 + 1] || '/' ||
               ['m.py', 'm.java', 'm.TS', 'm.tsx', 'm.jsx', 'm', 'm.go', 'm.test.js'][event_id % 8 + 1] AS path FROM events)"""
    places = [(x, name) for i, ext in enumerate(graph.IMPORTED) for x, name in ((2 * i, f"x.{ext}"), (2 * i + 1, f"x/index.{ext}"))] + [(23, "x.go")]
    kept = ", ".join(f"({i}, '{name}', {i + 1}, {5 * i % len(places)})" for i, name in places)
    return {
        "import_targets": f"WITH have AS (SELECT event_id, least(p.r, 20) AS r, 'd' || event_id || '/' || p.name AS path FROM events JOIN (VALUES {kept}) p(r, name, n, x) ON event_id // p.n % {len(places)} = p.x) SELECT event_id, 'run' AS local, arg_min(path, (r, path)) AS target_path, CAST(min(r) AS INTEGER) AS rank FROM have GROUP BY event_id",
        "resolved_calls": """WITH m AS (SELECT event_id AS k, event_id // 2 AS h FROM events), there AS (SELECT m.*, o.k IS NOT NULL AS has, 'src/m' || m.h || '.ts' AS to_path FROM m LEFT JOIN m o ON o.k = m.h),
            others AS (SELECT min('src/m' || k || '.ts') AS p FROM m WHERE k % 7 = 0)
            SELECT k AS file_id, CAST(7 AS BIGINT) AS line, 'ns.run_' || h AS callee_text, CASE WHEN has THEN 'namespace' END AS how, CASE WHEN has THEN to_path END AS callee_path, CASE WHEN has THEN 'run_' || h END AS qualified_name FROM there
            UNION ALL SELECT k, 8, 'go', CASE WHEN has THEN 'import' END, CASE WHEN has THEN to_path END, CASE WHEN has THEN 'run_' || h END FROM there
            UNION ALL SELECT k, 9, 's.work', CASE WHEN has THEN 'type' ELSE 'name' END, CASE WHEN has THEN to_path ELSE 'src/m' || k || '.ts' END, 'Svc' || CASE WHEN has THEN h ELSE k END || '.work' FROM there
            UNION ALL SELECT k, 10, 'other', 'name', CASE WHEN k % 7 = 0 THEN 'src/m' || k || '.ts' ELSE (FROM others) END, 'other' FROM there""",
        "tree_documents": "SELECT doc_id, md5(text) AS text_md5, strlen(text) AS n_bytes FROM documents WHERE lang IS DISTINCT FROM 'de'",
        "graph_snapshot": "SELECT 'src/m' || event_id || '.py' AS path, CASE WHEN event_id % 10 = 0 THEN 2 ELSE 1 END::BIGINT AS symbols, CASE WHEN event_id % 10 = 0 THEN 8 ELSE 4 END::BIGINT AS last_line, (SELECT count(*) FROM events WHERE event_id % 10 = 0) AS parsed_files FROM events",
        "taint_same_names": "SELECT 'python.security.ssrf' AS rule_id, 'src/app' || a.event_id // 2 || '.py' AS path, CAST(5 AS BIGINT) AS start_line, CAST(4 AS BIGINT) AS source_line, 'Tainted data from name (source at line 4) reached run(...) reaches sink ' || CASE WHEN l.event_id % 3 = 0 THEN 'requests.get(' ELSE 'requests.post(' END || '.' AS message FROM events a JOIN events l ON l.event_id = a.event_id - 1 WHERE a.event_id % 2 = 1",
        "language_detection": paths + " SELECT CASE regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'tsx' THEN 'tsx' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' ELSE 'unknown' END AS language, count(*) AS files FROM paths GROUP BY 1",
        "exclude_globs": paths + " SELECT event_id, path FROM paths WHERE NOT list_contains(string_split(path, '/'), 'gen') AND NOT starts_with(string_split(path, '/')[-1], 'm.t') AND path NOT LIKE 'node_modules/x/%'",
        "normalized_paths": paths + " SELECT event_id, CASE WHEN path LIKE './%' THEN path[3:] WHEN path LIKE '.%' THEN path[2:] ELSE path END AS path FROM paths",
        "escaped_pages": "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM pages",
        "sarif_levels": docs + " SELECT CASE WHEN severity_rank >= 3 THEN 'error' WHEN severity_rank = 2 THEN 'warning' ELSE 'note' END AS level, count(*) AS findings FROM found GROUP BY 1",
        "enclosing_spans": "WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS f, c_custkey % 50 AS a, c_custkey % 97 + 1 AS n, c_custkey AS span FROM customer) SELECT CAST(s_nationkey AS BIGINT) AS file_id, s_suppkey AS at, coalesce((SELECT span FROM s WHERE f = s_nationkey AND a <= s_suppkey AND s_suppkey < a + n ORDER BY n, span LIMIT 1), -1) AS span FROM supplier",
        "scan_pattern_findings": docs + " SELECT rule_id, severity, path, start_char, start_byte, start_line, start_column, start_column + strlen(match_text) AS end_column, ord, match_text FROM found",
        "scan_unicode_words": "WITH " + sql_found("documents", "doc_id", "text", "documents/", [replace(_ACCENTED, regex=r"[éèñü][\pL\pM\p{Nd}\p{Pc}]+")]) + " SELECT path, ord, start_char, start_byte, start_line, match_text FROM found",
        "code_symbols": modules + defined + " SELECT path, name, 'function' AS kind, CAST(n AS BIGINT) AS line, true AS has_body FROM defined",
        "code_imports": modules + bound + " SELECT k AS file_id, local, local AS original, target FROM bound",
        "code_call_edges": modules + bound + defined + called + " SELECT c.k AS file_id, CAST(c.n AS BIGINT) AS line, callee AS callee_text, CASE WHEN d.name IS NOT NULL THEN 'import' END AS how, d.path AS callee_path FROM called c LEFT JOIN bound b ON b.k = c.k AND b.local = c.callee LEFT JOIN defined d ON d.name = b.local AND d.path = b.target || '.py'",
        "ast_query_findings": modules + " SELECT 'korea.py.unsalted-hash' AS rule_id, path, CAST(n AS BIGINT) AS start_line, CAST(strpos(l, 'hashlib') AS BIGINT) AS start_column, regexp_extract(l, 'hashlib[.]\\w+\\([^)]*\\)') AS match_text FROM lines WHERE regexp_matches(l, 'hashlib[.](sha256|sha224|sha384|sha512|sha3_256|sha3_384|sha3_512|blake2b|blake2s)\\(') AND NOT contains(l, '+')",
        "class_ancestors": "WITH RECURSIVE files AS (SELECT 'class C' || event_id || CASE WHEN event_id > 1 THEN ' extends C' || event_id // 2 ELSE '' END || ' { }' AS t FROM events), types AS (SELECT regexp_extract(t, 'class (\\w+)', 1) AS type, regexp_extract(t, 'extends (\\w+)', 1) AS above FROM files), up AS (SELECT type, type AS ancestor, CAST(0 AS BIGINT) AS depth FROM types UNION ALL SELECT u.type, t.above, u.depth + 1 FROM up u JOIN types t ON t.type = u.ancestor WHERE t.above <> '') SELECT * FROM up",
        "taint_findings": flow + " SELECT 'python.security.ssrf' AS rule_id, c.path, CAST(c.n AS BIGINT) AS start_line, CAST(g.n AS BIGINT) AS source_line, 'Tainted data from ' || g.v || ' (source at line ' || g.n || ') reached ' || c.name || '(...) reaches sink requests.get(.' AS message FROM calls c JOIN given g ON g.k = c.k AND g.f = c.f AND g.v = c.a AND g.n < c.n JOIN sinks s ON s.k = c.k AND s.name = c.name",
        "scan_pages": pages(_INLINE) + " SELECT rule_id, path, start_line, start_column, match_text FROM found",
        "scan_not_regex": pages(_NO_TRACK) + " SELECT rule_id, path, start_line, start_column FROM found WHERE NOT regexp_matches(string_split(t, chr(10))[start_line], 'track\\([0-9]*[05]\\)')",
        "scan_conversations": "WITH " + sql_found("conversations", "conv_id || '/' || turn", "text", "conversations/", [Rule(id="chat.repeat", severity="info", languages=("text",), regex=r"(?:the the|la la|die die|und und|of of) [a-z]+")]) + " SELECT path, ord, start_char, start_line, match_text FROM found",
        "findings_snippet_line": docs + " SELECT rule_id, path, ord, start_line, code_snippet FROM found",
        "language_rule_applicability": f"SELECT rule_id, d.lang AS lang, count(*) AS files FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'tsx' ELSE lang END AS lang FROM documents) d JOIN (VALUES {values}, ('only.typescript', 'tsx')) r(rule_id, lang) ON d.lang = r.lang GROUP BY ALL",
        "category_rollup_zero_fill": docs + f", loaded AS (SELECT category, count(*) AS rules FROM (VALUES {zero}) v(category) GROUP BY 1), hit AS (SELECT category, count(*) AS findings FROM found GROUP BY 1) SELECT coalesce(l.category, h.category) AS category, coalesce(rules, 0) AS rules, coalesce(findings, 0) AS findings FROM loaded l FULL JOIN hit h ON l.category = h.category",
        "severity_summary": docs + " SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + " FROM found",
        "triage_topk": docs + " SELECT rule_id, severity, path, start_line, start_column FROM found ORDER BY severity_rank DESC, path, start_line, start_column, rule_id LIMIT 10",
        "min_severity_floor": docs + " SELECT rule_id, severity, count(*) AS findings FROM found WHERE severity_rank >= 3 GROUP BY ALL",
        "exit_policy": docs + " SELECT s AS fail_on, CAST(CASE WHEN EXISTS (FROM found WHERE severity_rank >= i) THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate([*SEVERITIES])) + ", ('none', 0)) v(s, i) UNION ALL SELECT 'degraded', 3",
        "baseline_new": known + " SELECT rule_id, path, ord, start_line FROM print WHERE fp NOT IN (FROM base)",
        "baseline_existing": known + " SELECT rule_id, path, ord, start_line FROM print WHERE fp IN (FROM base)",
        "baseline_fixed": known + " SELECT unnest(['ghost-a', 'ghost-b']) AS fingerprint UNION ALL SELECT fp FROM base WHERE fp NOT IN (SELECT fp FROM print)",
        "baseline_counts": known + " SELECT count(*) FILTER (fp IN (FROM base)) AS existing, count(*) FILTER (fp NOT IN (FROM base)) AS \"new\", CAST(2 AS BIGINT) AS fixed FROM print",
        "first_finding_per_rule": docs + " SELECT rule_id, path, start_line, start_column FROM found QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY path, start_line, start_column) = 1",
        "innermost_spans": nested + ", spans AS (SELECT rule_id, path, start_byte, start_byte + strlen(match_text) AS end_byte FROM found) SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans t WHERE t.path = s.path AND t.start_byte >= s.start_byte AND t.end_byte <= s.end_byte AND t.end_byte - t.start_byte < s.end_byte - s.start_byte)",
        "fingerprint_fnv1a": docs + f" SELECT rule_id, path, ord, lpad(lower(printf('%x', CAST({fold.format('match_text')} // 4294967296 AS BIGINT))), 8, '0') || lpad(lower(printf('%x', CAST({fold.format('match_text')} % 4294967296 AS BIGINT))), 8, '0') AS hash, 'cbf29ce484222325' AS empty_hash FROM found",
        "suppressed_findings": code + " SELECT 'py.os-system' AS rule_id, path, CAST(n AS BIGINT) AS start_line FROM hits SEMI JOIN silent USING (k, n)",
        "unsuppressed_findings": code + " SELECT 'py.os-system' AS rule_id, path, CAST(n AS BIGINT) AS start_line FROM hits ANTI JOIN silent USING (k, n)",
        "fixture_verdicts": noted + " SELECT k AS file_id, 'expected' AS kind, rule_id, CAST(n AS BIGINT) AS line FROM notes s WHERE kind = 'ruleid' AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.k = s.k AND h.n IN (s.n, s.n + 1)) UNION ALL SELECT h.k, 'unexpected', s.rule_id, CAST(h.n AS BIGINT) FROM notes s JOIN hits h ON h.k = s.k AND h.n IN (s.n, s.n + 1) WHERE kind = 'ok'",
        "snapshot_changed_files": "SELECT doc_id FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END)",
        "call_graph_closure": "WITH RECURSIVE c AS (SELECT CAST(n_nationkey AS BIGINT) AS caller, unnest([2 * n_nationkey + 1, n_nationkey + 7])::BIGINT AS callee FROM nation), e AS (SELECT * FROM c WHERE callee < 25), r AS (SELECT caller, callee FROM e UNION SELECT r.caller, e.callee FROM r JOIN e ON r.callee = e.caller) SELECT caller, callee FROM r",
    }
