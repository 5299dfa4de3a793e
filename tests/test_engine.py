"""The engine's own operators on small inputs."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from siftline import cli
from siftline.functions import text as X
from siftline.operators import findings as O
from siftline.operators import graph, match, nodes, query, suppress, taint
from siftline.plans import report
from siftline.plans.scan import Scanner
from siftline.sources import config, state, tree
from siftline.sources.packs import PackError, Registry, Rule, load_pack, parse_rule, version_above
from siftline.sources.syntax import Tree
from siftline.streaming.incremental import scan_stream

LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "ts": "typescript", "go": "go", "txt": "text"}


def corpus(spark, files):
    rows = [(i, path, LANGUAGES.get(path.rpartition(".")[2], "typescript"), text) for i, (path, text) in enumerate(files.items())]
    return spark.createDataFrame(rows, "file_id long, path string, language string, text string")


def lines(df):
    return sorted((r.rule_id, r.path, r.start_line) for r in df.collect())


def test_positions_snippets_and_fingerprints(spark):
    rule = Rule(id="r", name="n", severity="high", languages=("text",), regex=r"ab+")
    rows = O.triage(match.findings(corpus(spark, {"a.txt": "é ab\n  xabbb y\r\nab", "b.txt": "", "c.txt": "abab"}), [rule])).collect()
    assert [(r.path, r.start_char, r.start_byte, r.start_line, r.start_column, r.end_column, r.code_snippet) for r in rows] == [
        ("a.txt", 2, 3, 1, 3, 5, "é ab"),
        ("a.txt", 8, 9, 2, 4, 8, "xabbb y"),
        ("a.txt", 16, 17, 3, 1, 3, "ab"),
        ("c.txt", 0, 0, 1, 1, 3, "abab"),
        ("c.txt", 2, 2, 1, 3, 5, "abab"),
    ]
    assert rows[0].fingerprint == X.fnv1a64("r\0a.txt\0é ab") and rows[0].message == "n"


def test_fnv_native_equals_python(spark):
    values = ["", "a", "héllo", "x" * 300, "日本"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(X.fnv1a64_col(F.col("v"))).collect()] == [X.fnv1a64(v) for v in values]


def test_paths_and_globs(spark):
    df = spark.createDataFrame([("./a/b",), (".github/x",), ("/r/s",), ("a\\b",)], "p string")
    assert [r[0] for r in df.select(X.normalize_path(F.col("p"))).collect()] == ["a/b", "github/x", "r/s", "a/b"]
    assert tree.excluded("a/gen/b.py", ["gen"]) and tree.excluded("a/b/c.py", ["a/*"]) and tree.excluded("x/t1.py", ["t?.py"]) and not tree.excluded("a/b.py", ["b"])


def test_not_regex_sees_whole_lines(spark):
    rule = Rule(id="r", languages=("text",), regex=r"load\([^)]*\)", not_regex=r"Safe")
    assert lines(match.findings(corpus(spark, {"a.txt": "load(a) Safe\nload(b)\nload(\nc) # Safe"}), [rule])) == [("r", "a.txt", 2)]


BAD = [
    ({}, "no id"),
    ({"id": "a", "severity": "high", "languages": ["go"]}, "exactly one"),
    ({"id": "a", "severity": "dire", "languages": ["go"], "pattern": {"regex": "x"}}, "unknown severity"),
    ({"id": "a", "severity": "low", "confidence": "sure", "languages": ["go"], "pattern": {"regex": "x"}}, "unknown confidence"),
    ({"id": "a", "severity": "low", "languages": [], "pattern": {"regex": "x"}}, "no languages"),
    ({"id": "a", "severity": "low", "languages": ["cobol"], "pattern": {"regex": "x"}}, "unknown language"),
    ({"id": "a", "severity": "low", "languages": ["go"], "pattern": {"regex": "("}}, "invalid regex"),
    ({"id": "a", "severity": "low", "languages": ["go"], "pattern": {"regex": "a(?=b)"}}, "look-around"),
    ({"id": "a", "severity": "low", "languages": ["go"], "pattern": {"regex": "a*"}}, "empty text"),
]


@pytest.mark.parametrize("raw,why", BAD)
def test_rules_are_checked(raw, why):
    with pytest.raises(PackError, match=why):
        parse_rule(raw)


def test_packs(tmp_path):
    r = Registry.built_in()
    assert len(r.rules) == 80 and len({x.id for x in r.rules}) == 80
    assert {p.name for p in r.packs} == {"go", "java", "javascript", "korea-secure-coding", "python"}
    assert r.namespace() == Registry.built_in().namespace() and Registry.built_in().select(["go", "nothing"]).rules[0].id.startswith("go.")
    (tmp_path / "rules").mkdir()
    (tmp_path / "pack.toml").write_text('name = "p"\nversion = "1"\n')
    with pytest.raises(PackError, match="no rules"):
        load_pack(tmp_path)
    (tmp_path / "rules" / "a.toml").write_text('id = "go.security.weak-crypto"\nseverity = "low"\nlanguages = ["go"]\npattern.regex = "x"\npattern.fix = "do y"\n')
    assert load_pack(tmp_path).rules[0].recommendation == "Suggested fix: do y"
    with pytest.raises(PackError, match="duplicate"):
        r.add(load_pack(tmp_path))
    assert version_above("0.10.0", "0.9.9") and not version_above("1.x", "1.0.0")


def test_suppression(spark):
    text = "run()  # nosec\nrun()\nrun()\n# nosec: other.rule\nrun()\n# siftline:ignore r, s\nrun()\nx = 'nosec'; run()\n"
    files = corpus(spark, {"a.py": text})
    rows = match.findings(files, [Rule(id="r", languages=("python",), regex=r"run\(\)")])
    marks = suppress.suppressions(files)
    assert [(m.line, m.rules) for m in marks.orderBy("line").collect()] == [(1, None), (4, ["other.rule"]), (6, ["r", "s"])]
    assert [x[2] for x in lines(suppress.suppressed(rows, marks))] == [1, 2, 7]
    assert [x[2] for x in lines(suppress.suppressed(rows, marks, "left_anti"))] == [3, 5, 8]


def test_fixture_verdicts(spark):
    files = corpus(spark, {"a.py": "# ruleid: r\nrun()\n# ok: r\nrun()\n# ruleid: r\npass\n# ruleid: zz\n"})
    rows = match.findings(files, [Rule(id="r", languages=("python",), regex=r"run\(\)")])
    got = sorted((v.kind, v.rule_id, v.line) for v in suppress.verdicts(suppress.annotations(files), rows, ["r"]).collect())
    assert got == [("expected", "r", 5), ("expected", "zz", 7), ("unexpected", "r", 4), ("unknown", "zz", 7)]


def test_rollups_baseline_and_order(spark):
    rules = [Rule(id="a", category="c1", severity="low", languages=("text",), regex="aa"), Rule(id="b", severity="critical", languages=("text",), regex="bb"), Rule(id="c", category="c3", severity="info", languages=("text",), regex="zz")]
    from siftline.sources.packs import rules_table

    rows = match.findings(corpus(spark, {"x.txt": "aa bb\naa", "w/x.txt": "bb"}), rules)
    assert sorted(map(tuple, O.category_rollup(rows, rules_table(spark, rules)).collect())) == [("c1", 1, 2), ("c3", 1, 0), ("uncategorized", 1, 2)]
    assert O.severity_summary(rows).first().asDict() == {"info": 0, "low": 2, "medium": 0, "high": 0, "critical": 2}
    assert [(r.rule_id, r.path) for r in O.triage(rows).collect()] == [("b", "w/x.txt"), ("b", "x.txt"), ("a", "x.txt"), ("a", "x.txt")]
    base = rows.filter("rule_id = 'a'").select("fingerprint").union(spark.createDataFrame([("gone",)], "fingerprint string"))
    assert O.baseline_counts(rows, base).first().asDict() == {"existing": 2, "new": 2, "fixed": 1}
    assert [r[0] for r in O.fixed_since(rows, base).collect()] == ["gone"] and O.new_against(rows, base).count() == 2 == O.existing_in(rows, base).count()
    assert (O.exit_code(rows, False, "high"), O.exit_code(rows.filter("false"), False, None), O.exit_code(rows, True, None)) == (2, 0, 3)
    assert sorted(r.start_line for r in O.first_per_rule(rows).collect()) == [1, 1]


def test_innermost(spark):
    rows = spark.createDataFrame([("r", "p", 0, 10), ("r", "p", 2, 5), ("r", "p", 2, 5), ("r", "p", 6, 12), ("q", "p", 0, 10)], "rule_id string, path string, start_byte long, end_byte long")
    assert sorted(map(tuple, O.innermost(rows).collect())) == [("q", "p", 0, 10), ("r", "p", 2, 5), ("r", "p", 2, 5), ("r", "p", 6, 12)]


TAINTED = {
    "a/view.py": "def view(request):\n    n = request.args.get('n')\n    return requests.get(n)\n",
    "b/clean.py": "def view(request):\n    n = urlparse(request.args.get('n'))\n    return requests.get(n)\n",
    "c/branch.py": "def v(request):\n    if x:\n        u = 'a'\n    else:\n        u = request.form\n    requests.post(u)\n",
    "d/both.py": "def v(request):\n    u = request.form\n    if x:\n        u = 'a'\n    else:\n        u = 'b'\n    requests.post(u)\n",
    "e/loop.py": "def v(request):\n    for i in y:\n        u = request.form\n    requests.post(u)\n",
    "f/string.py": "def v(request):\n    u = request.form\n    requests.post('u is fine')\n",
    "g/prefix.py": "def v(request):\n    user = request.form\n    requests.post(user_name)\n",
    "h/direct.py": "requests.get(request.args['x'])\n",
}


def ssrf():
    return [r for r in Registry.built_in().rules if r.id == "python.security.ssrf"]


def test_taint_within_functions(spark):
    got = taint.taint_findings(corpus(spark, TAINTED), ssrf())
    assert lines(got) == [("python.security.ssrf", p, n) for p, n in (("a/view.py", 3), ("c/branch.py", 6), ("e/loop.py", 4), ("h/direct.py", 1))]
    first = got.filter("path = 'a/view.py'").first()
    assert first.source_line == 2 and first.message == "Tainted data from n (source at line 2) reached sink requests.get(."


def test_taint_across_files(spark):
    files = {
        "util.py": "def get_id(r):\n    return request.args.get('id')\n\ndef send(a):\n    return fetch(a)\n",
        "net.py": "def fetch(url):\n    return requests.get(url)\n\ndef loop(x):\n    return loop(x)\n",
        "app.py": "from util import get_id, send as push\ndef go():\n    i = get_id(1)\n    push(i)\n    send('safe')\n    loop(i)\n",
    }
    got = taint.taint_findings(corpus(spark, files), ssrf()).collect()
    assert [(r.path, r.start_line) for r in got] == [("app.py", 4)] and "push(...) reaches sink requests.get(" in got[0].message


def test_taint_java(spark):
    rules = [r for r in Registry.built_in().rules if r.id == "java.security.sql-injection"]
    java = """class A {
  void one(HttpServletRequest req) { String q = req.getParameter("id"); st.executeQuery("select " + q); }
  void two(@RequestParam String id) { st.executeQuery("select " + id); }
  void three(String id) { st.executeQuery("select " + id); }
  void four(HttpServletRequest req) { String q = escapeSql(req.getParameter("id")); st.executeQuery(q); }
  void five(HttpServletRequest req) { String q = req.getParameter("id"); st.executeQuery("select ?", q); }
}
"""
    assert [x[2] for x in lines(taint.taint_findings(corpus(spark, {"A.java": java}), rules))] == [2, 3]


def test_taint_javascript_and_go(spark):
    every = Registry.built_in().rules
    js = "app.get('/', (req, res) => {\n  const v = req.query.id\n  const s = escapeHtml(v)\n  res.write(v)\n  res.write(s)\n  el.outerHTML = v;\n})\n"
    go = 'package m\nfunc h(w W, r *R) {\n\tid := r.FormValue("id")\n\tdb.Query("x" + id)\n\tdb.Query("x = ?", id)\n}\n'
    got = taint.taint_findings(corpus(spark, {"a.js": js, "b.go": go}), [r for r in every if r.id in ("korea.js.xss", "go.security.sql-injection")])
    assert [x[1:] for x in lines(got)] == [("b.go", 4), ("a.js", 4), ("a.js", 6)]


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("(call function: (identifier) @f)", ["f", "g", "h", "k"]),
        ("(call arguments: (argument_list . (identifier) @a .))", ["x"]),
        ("(call arguments: (argument_list . (identifier) @a))", ["x", "y", "p"]),
        ("(call arguments: (argument_list (identifier) @a .))", ["x", "z", "p"]),
        ("(call arguments: (argument_list (identifier) @a . (identifier) @b))", ["y", "z"]),
        ("(call arguments: (argument_list (identifier)+ @a))", ["x", "y", "z", "p"]),
        ("(call function: (identifier) @f arguments: (argument_list (string)? @s))", ["f", "g", "h", "k", "'s'"]),
        ("(call arguments: (argument_list [(string) (integer)] @a))", ["'s'", "1"]),
        ("(call arguments: (argument_list . _ @a))", ["x", "y", "'s'", "p"]),
        ("(call function: [(identifier) (attribute)] @f) (#any-of? @f \"g\" \"m.n\")", ["g", "m.n"]),
        ("(call !function)", []),
    ],
)
def test_query_language(pattern, want):
    """Alternations, quantifiers, anchors and wildcards, over a few calls."""
    from siftline.sources.syntax import Tree

    tree = Tree("f(x)\ng(y, z)\nh('s', 1)\nk(p, 1, p)\nm.n()\n", "python")
    got = [tree.text(n) for n in query.sites(tree, Rule(id="q", languages=("python",), query=pattern, capability="query"))]
    assert sorted(set(got)) == sorted(want)


def test_query_rules(spark):
    files = corpus(spark, {"a.py": "import hashlib\nhashlib.sha256(p)\nhashlib.sha256(p + salt)\nhashlib.md5(p)\n", "B.java": 'class B { void f() { Class.forName(n); Class.forName("x"); } }\n'})
    rules = [r for r in Registry.built_in().rules if r.capability == "query"]
    assert lines(query.findings(files, rules)) == [("korea.java.reflection", "B.java", 1), ("korea.py.unsalted-hash", "a.py", 2)]
    broken = Rule(id="q", languages=("python",), query="(call", capability="query")
    assert [(r.rule_id, r.start_line) for r in query.findings(files, [broken]).collect()] == [("q:query-error", 1)]


def test_graph_resolution(spark):
    files = {
        "src/a.ts": 'import { run as go } from "./lib/b";\nimport * as ns from "./lib/b";\nfunction main() { go(); ns.run(); other(); }\n',
        "src/lib/b.ts": "export function run() { return 1; }\n",
        "src/z.ts": "function run() { return 2; }\nfunction other() { run(); }\n",
        "A.java": "class A { void f(Sub s, Svc t) { s.work(); t.work(); } }\nclass Base { void work() { } }\nclass Sub extends Base { }\ninterface Svc { void work(); }\nclass Impl implements Svc { void work() { } }\n",
    }
    all_ = graph.facts(corpus(spark, files))
    names = {r.symbol_id: (r.path, r.qualified_name) for r in graph.symbols(all_).collect()}
    got = {(r.callee_text, r.line, names[r.caller_symbol][1]): (names.get(r.callee_symbol), r.how) for r in graph.edges(corpus(spark, files)).collect()}
    assert got["go", 3, "main"] == (("src/lib/b.ts", "run"), "import")
    assert got["ns.run", 3, "main"] == (("src/lib/b.ts", "run"), "namespace")
    assert got["other", 3, "main"] == (("src/z.ts", "other"), "name")
    assert got["run", 2, "other"] == (("src/z.ts", "run"), "name")
    assert got["s.work", 1, "A.f"] == (("A.java", "Base.work"), "type")
    assert got["t.work", 1, "A.f"][1] == "type"


def test_nodes(spark):
    files = corpus(spark, {"A.java": "class A {\n  void f(int p) {\n    int x = g(1);\n    h(x);\n  }\n}\n", "b.py": "y = 1\ndef f():\n    return y\n"})
    table = nodes.ast_nodes(files).cache()
    f = table.filter("kind = 'method_declaration'")
    assert [r.kind for r in nodes.field(table, f, "body").collect()] == ["block"]
    assert {r.name for r in nodes.below(table, f).filter("kind = 'method_invocation'").collect()} == {"g", "h"}
    assert sorted((r.name, r.kind) for r in nodes.symbol_table(table).filter("file_id = 0").collect()) == [("A", "class"), ("f", "method"), ("x", "local")]
    spans = table.filter("kind IN ('class_declaration', 'method_declaration')").select("file_id", "start", "end", "name")
    points = spark.createDataFrame([(0, 2), (0, 45), (1, 0)], "file_id long, at long")
    assert sorted((r.file_id, r.at, r.name) for r in nodes.enclosing(points, spans, ["name"]).collect()) == [(0, 2, "A"), (0, 45, "f"), (1, 0, None)]
    uses = spark.createDataFrame([(0, "x", 4), (0, "x", 3), (0, "zz", 9)], "file_id long, name string, line long")
    assert {(r.name, r.line): r.declared for r in nodes.declared_before(nodes.symbol_table(table), uses).collect()} == {("x", 4): True, ("x", 3): False, ("zz", 9): False}


def test_parser_reports_errors():
    assert Tree("def f(:\n", "python").error and Tree("class A { void f( { }", "java").error and not Tree("class A { }", "java").error


@pytest.fixture
def project(tmp_path, monkeypatch):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "gen").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nos.system(x)\nos.system(y)  # nosec\n")
    (tmp_path / "src" / "gen" / "b.py").write_text("os.system(z)\n")
    (tmp_path / "src" / "node_modules" / "c.py").write_text("os.system(z)\n")
    (tmp_path / "src" / "d.txt").write_text("os.system(z)\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "_spark", lambda: __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession())
    return tmp_path


def test_scan_of_a_tree_and_reports(spark, project):
    result = Scanner.for_packs(spark, ["python"]).scan_paths(["src"], ["gen"])
    assert [x[1:] for x in lines(result.findings)] == [("src/a.py", 2)]
    assert result.counters["files_discovered"] == 2 and result.counters["files_skipped"] == 1 and result.counters["suppressed_inline"] == 1 and not result.degraded
    data = json.loads(report.json_report(result))
    assert data["severity_summary"]["high"] == 1 and data["findings"][0]["file"] == "src/a.py" and data["findings"][0]["severity"] == "HIGH"
    sarif = json.loads(report.sarif_report(result))
    assert sarif["runs"][0]["results"][0]["locations"][0]["physical_location"]["region"]["start_line"] == 2
    assert "HIGH src/a.py:2:1" in report.terminal_report(result) and "1 finding(s) in 2 file(s)" in report.terminal_report(result)
    assert "<pre>os.system(x)</pre>" in report.html_report(result) and report.timestamp(0) == "1970-01-01T00:00:00Z"


def test_unreadable_files_degrade(spark, project):
    (project / "src" / "bad.py").write_bytes(b"x = '\xff'\n")
    (project / "src" / "big.py").write_bytes(b"#" * (tree.MAX_BYTES + 1))
    (project / "src" / "wrong.py").write_text("def f(:\n    os.system(q)\n")
    result = Scanner.for_packs(spark, ["python"]).scan_paths(["src"], ["gen"])
    assert sorted((i.kind, i.path) for i in result.issues.collect()) == [("parse", "src/wrong.py"), ("read", "src/bad.py"), ("read", "src/big.py")]
    assert ("python.security.os-system", "src/wrong.py", 2) in lines(result.findings)


def test_command_line(spark, project, capsys):
    (project / config.FILE).write_text('include = ["src"]\nexclude = ["gen"]\npacks = ["python"]\n[policy]\nexit-on-severity = "Critical"\n')
    assert cli.main(["scan", "--format", "json", "-o", "out/r.json"]) == 0 and json.loads((project / "out" / "r.json").read_text())["findings"]
    assert cli.main(["scan", "--fail-on-severity", "low"]) == 2 and cli.main(["scan", "--no-cache", "--fail-on-severity", "low"]) == 2
    assert cli.main(["scan", "missing"]) == 1
    assert cli.main(["baseline", "create"]) == 0 and cli.main(["scan", "--baseline", "--fail-on-severity", "low"]) == 0
    assert "existing, 0 new" in capsys.readouterr().err
    (project / "src" / "e.py").write_text("os.system(new)\n")
    assert cli.main(["baseline", "status"]) == 2
    (project / "r.toml").write_text('id = "t"\nseverity = "low"\nlanguages = ["python"]\npattern.regex = "os.system"\n')
    (project / "f.py").write_text("# ruleid: t\nos.system(a)\n")
    assert cli.main(["rule", "test", "r.toml", "f.py"]) == 0 and cli.main(["rule", "test", "r.toml", "f.py", "--expected", "3"]) == 1
    assert cli.main(["rule", "validate", "r.toml"]) == 0 and cli.main(["rule", "explain", "go.security.ssrf"]) == 0 and cli.main(["rule", "list"]) == 0
    assert cli.main(["rule", "test", "r.toml", "src/d.txt"]) == 1 and cli.main(["config"]) == 0


def test_git_scopes(spark, project):
    git = lambda *a: subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *a], cwd=project, check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    (project / "src" / "a.py").write_text("changed\n")
    (project / "src" / "n.py").write_text("new\n")
    (project / "src" / "d.txt").unlink()
    assert tree.changed_files(".") == ["./src/a.py", "./src/n.py"] and tree.staged_files(".") == []
    git("add", "src/n.py")
    assert tree.staged_files(".") == ["./src/n.py"] and tree.under(tree.changed_files("."), ["src/gen"]) == []


def test_state_and_stream(spark, tmp_path):
    files = corpus(spark, {"a.py": "os.system(x)\n"})
    scanner = Scanner.for_packs(spark, ["python"])
    found = scanner.scan(files).findings
    cache = state.FindingsCache(spark, str(tmp_path / "cache"), scanner.registry.namespace())
    assert cache.get("s") is None
    cache.put("s", found, scanner.scan(files).issues, 3)
    assert cache.get("s")[0].count() == 1 and cache.get("s")[2] == 3 and cache.prune() == 0 and cache.prune(-1) == 1 and cache.get("s") is None
    snapshot = state.GraphSnapshot(spark, str(tmp_path / "graph"))
    hashed = spark.createDataFrame([("a.py", "h")], "path string, source_hash string")
    assert snapshot.load(hashed) is None
    snapshot.save(graph.facts(files), hashed)
    assert snapshot.load(hashed) is not None and snapshot.load(hashed.withColumn("source_hash", F.lit("g"))) is None
    landing = tmp_path / "in"
    files.write.parquet(str(landing))
    stream = spark.readStream.schema(files.schema).parquet(str(landing))
    scan_stream(scanner, stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_snapshot_parses_only_what_has_changed(spark, tmp_path):
    """After edits, new files and deletions the facts are those of a full build; nothing else is parsed; a broken store is built anew."""
    texts = {f"m{i}.py": f"from m{i // 2} import f{i // 2}\ndef f{i}(x):\n    return f{i // 2}(x)\n" for i in range(12)} | {"bad.py": "def f(:\n", "empty.py": ""}
    files = lambda t: corpus(spark, t).withColumn("file_id", F.xxhash64("path")).withColumn("source_hash", F.sha2("text", 256))
    plain = lambda rows: sorted(map(str, rows.select(*sorted(rows.columns)).collect()))
    snapshot = state.GraphSnapshot(spark, str(tmp_path / "graph"), buckets=4)
    for now, parsed in (
        (texts, 14), (texts, 0), (texts | {"m3.py": "def f3():\n    pass\n"}, 1), ({k: v for k, v in texts.items() if k not in ("m1.py", "bad.py")}, 1),
        (texts | {"new.py": "import os\n"}, 3), ({"m0.py": "", "empty.py": ""}, 1), (texts, 14),
    ):
        got = snapshot.refresh(files(now))
        # What was dropped may be kept in buckets that no change has touched, so at most so many files are parsed.
        assert plain(got) == plain(graph.facts(files(now))) and snapshot.parsed <= parsed and (parsed != 1 or snapshot.parsed == 1)
    spark.createDataFrame([(1,)], "other int").write.mode("overwrite").parquet(str(tmp_path / "graph" / f"schema={state.SCHEMA}" / "store"))
    assert plain(snapshot.refresh(files(texts))) == plain(graph.facts(files(texts))) and snapshot.parsed == 14
    assert snapshot.refresh(files(texts).limit(0)).count() == 0


def test_scan_with_a_snapshot(spark, project):
    (project / "src" / "lib.py").write_text("def run(value):\n    return requests.get(value)\n")
    (project / "src" / "app.py").write_text("from lib import run as go\ndef view(request):\n    name = request.args.get('n')\n    return go(name)\n")
    snapshot = state.GraphSnapshot(spark, str(project / "graph"))
    scanner = Scanner.for_packs(spark, ["python"])
    first = lines(scanner.scan_paths(["src"], ["gen"], snapshot=snapshot).findings)
    assert snapshot.parsed == 3 and ("python.security.ssrf", "src/app.py", 4) in first
    (project / "src" / "app.py").write_text("from lib import run as go\n\ndef view(request):\n    name = request.args.get('n')\n    return go(name)\n")
    second = lines(scanner.scan_paths(["src"], ["gen"], snapshot=snapshot).findings)
    assert snapshot.parsed == 1 and second == lines(scanner.scan_paths(["src"], ["gen"]).findings) and ("python.security.ssrf", "src/app.py", 5) in second


def test_taint_of_clashing_names(spark):
    """Functions of one name in several files: the caller's own file first, then what the graph resolves, then any; each names its own sink."""
    files = {
        "a/lib.py": "def run(v):\n    return requests.get(v)\n", "b/lib.py": "def run(v):\n    return requests.post(v)\n", "c/lib.py": "def run(v):\n    return v\n",
        **{f"{d}/app.py": "from lib import run\ndef view():\n    q = request.args.get('n')\n    return run(q)\n" for d in "abc"},
        "d/app.py": "def run(v, w):\n    return requests.put(w)\ndef view():\n    q = request.args.get('n')\n    run('x', q)\n    run(q, 'x')\n",
        "e/app.py": "import lib\ndef view():\n    q = request.args.get('n')\n    return helper(q)\ndef helper(u):\n    return step(u)\ndef step(u):\n    w = u\n    return helper(w) if u else requests.get(w)\n",
        "f/app.py": "def own(x):\n    y = request.args.get('k')\n    requests.get(y)\ndef view():\n    q = request.args.get('n')\n    own(q)\n    own('safe')\n",
        "g/app.py": "def clean(v):\n    v = urlparse(v)\n    return requests.get(v)\ndef view():\n    clean(request.args.get('n'))\n",
    }
    got = {(r.path, r.start_line): r.message for r in taint.taint_findings(corpus(spark, files), ssrf()).collect()}
    said = lambda path, line: got[path, line].rsplit(" ", 1)[-1]
    assert said("a/app.py", 4) == "requests.get(." and said("b/app.py", 4) == "requests.post(."
    assert ("c/app.py", 4) in got  # its own lib is harmless, but the name is known to reach a sink elsewhere
    assert said("d/app.py", 5) == "requests.put(." and said("d/app.py", 6) == "requests.get(."  # the first parameter of another run leads there
    assert ("e/app.py", 4) in got and {("f/app.py", 3), ("f/app.py", 6)} <= got.keys() and ("f/app.py", 7) not in got
    assert not [k for k in got if k[0] == "g/app.py"]


def test_import_targets(spark):
    """Extensions in order, a file before its folder's index, an exact name first, at last a namesake beside."""
    paths = ["x/main.ts", "x/b.js", "x/b.ts", "x/c/index.tsx", "x/c.py", "x/d.go", "x/e.js", "x/e.ts", "x/sub/f.ts", "y/b.ts"]
    text = 'import { b } from "./b";\nimport { c } from "./c";\nimport { d } from "./d";\nimport { e } from "./e.js";\nimport { f } from "./sub/f";\nimport { g } from "../y/b";\nimport { h } from "./none";\n'
    files = corpus(spark, {p: text if p == "x/main.ts" else "" for p in paths})
    got = {r.local: r.target_path for r in graph.import_files(graph.facts(files), files).collect()}
    assert got == {"b": "x/b.ts", "c": "x/c/index.tsx", "d": "x/d.go", "e": "x/e.js", "f": "x/sub/f.ts", "g": "y/b.ts"}


def test_call_by_name_brings_no_pairs(spark):
    """Every file has a function of one name and calls it and another that it has not: as many edges as calls, the first of the others."""
    files = {f"m{i:03}.py": f"def get():\n    return other()\n" + ("def other():\n    pass\n" if i in (7, 9) else "") + "def main():\n    get()\n" for i in range(60)}
    got = graph.edges(corpus(spark, files)).filter("how = 'name'").join(graph.symbols(graph.facts(corpus(spark, files))).select(F.col("symbol_id").alias("callee_symbol"), "path"), "callee_symbol").select("file_id", "callee_text", "path").collect()
    assert len(got) == 120 and all(r.path == (f"m{r.file_id:03}.py" if r.callee_text == "get" or r.file_id in (7, 9) else "m007.py") for r in got)


def test_enclosing_against_brute_force(spark):
    """Random spans that nest, overlap, touch and repeat, and points on their ends, in a few files."""
    rng = random.Random(4)
    spans = [(rng.randrange(3), a, a + rng.choice([0, 1, 2, 7, 64, 100, 511, 3000]), i) for i, a in enumerate(rng.randrange(4000) for _ in range(300))]
    points = [(rng.randrange(4), rng.randrange(4200)) for _ in range(300)] + [(f, x) for f, a, b, _ in spans[:60] for x in (a, b - 1, b)]
    want = sorted((f, at, min(((b - a, i) for g, a, b, i in spans if g == f and a <= at < b), default=(0, -1))[1]) for f, at in points)
    frame = spark.createDataFrame(spans, "file_id long, start long, end long, span long")
    got = nodes.enclosing(spark.createDataFrame(points, "file_id long, at long"), frame, ["span"]).fillna(-1, ["span"])
    assert sorted(map(tuple, got.collect())) == want
    assert nodes.enclosing(spark.createDataFrame(points, "file_id long, at long"), frame.limit(0), ["span"]).filter("span IS NOT NULL").isEmpty()


def test_innermost_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "BIN", 16)
    rng = random.Random(6)
    spans = [(rng.choice("rq"), rng.choice("pt"), a, a + rng.choice([1, 3, 10, 40, 150])) for a in (rng.randrange(300) for _ in range(200))]
    spans += spans[:20]
    inside = lambda t, s: t[:2] == s[:2] and s[2] <= t[2] and t[3] <= s[3] and t[2:] != s[2:]
    want = sorted(s for s in spans if not any(inside(t, s) for t in spans))
    assert sorted(map(tuple, O.innermost(spark.createDataFrame(spans, "rule_id string, path string, start_byte long, end_byte long")).collect())) == want


def test_scope_identity(spark):
    rows = [(f"d{i % 7}/f{i}.py", f"h{i}") for i in range(200)]
    ident = lambda r, n=3: tree.scope_id(spark.createDataFrame(r, "path string, source_hash string").repartition(n))
    same = ident(rows)
    assert same == ident(rows[::-1], 8) == ident(rows, 1) and len(same) == 64
    swapped = [(rows[0][0], rows[1][1]), (rows[1][0], rows[0][1]), *rows[2:]]
    assert len({same, ident(swapped), ident(rows[1:]), ident([*rows, ("z", None)]), ident([*rows, rows[0]])}) == 5


def test_results_do_not_depend_on_partitions(spark):
    from siftline.plans import registry

    rows = registry.corpus(spark, "/root/testdata/sf0.001")
    one, many = (match.findings(rows.repartition(n), registry.prose_rules()).select("rule_id", "path", "start_char", "fingerprint") for n in (1, 8))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() > 0


def test_reports_as_parts(spark, tmp_path):
    """Every format from many partitions: whole, in triage order, the same in parts as in one text, with odd characters and no findings."""
    files = corpus(spark, {f"d{i % 3}/f{i}.txt": f'{i} <&> "é" aa\n' * (i % 4) for i in range(40)} | {"a\\b.txt": "bb"})
    rules = [Rule(id="a", name='A "quoted" <rule>', category="c", severity="low", languages=("text",), regex="aa"), Rule(id="b", severity="critical", cwe="CWE-1", languages=("text",), regex="bb")]
    from siftline.sources.packs import Pack

    scanner = Scanner(spark, Registry([Pack("p", "1", rules=tuple(rules))]))
    result = scanner.scan(files.repartition(5))
    order = [(r.rule_id, r.path, r.start_line) for r in O.triage(result.findings).collect()]
    for kind in ("json", "sarif", "html", "terminal"):
        report.write_parts(result, kind, f"file://{tmp_path}/{kind}")
        parts = "".join(p.read_text("utf-8") for p in sorted((tmp_path / kind).glob("part-*")))
        report.write(result, kind, str(tmp_path / f"{kind}.out"))
        assert (tmp_path / f"{kind}.out").read_text("utf-8").splitlines()[3:-9] == parts.splitlines()[3:-9]
    data = json.loads((tmp_path / "json.out").read_text("utf-8"))
    assert [(f["rule_id"], f["file"], f["line"]) for f in data["findings"]] == order and len(order) == 61 and data["findings"][1]["cwe"] is None
    sarif = json.loads((tmp_path / "sarif.out").read_text("utf-8"))["runs"][0]
    assert [r["ruleId"] for r in sarif["results"]] == [o[0] for o in order] and [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["b", "a"]
    assert sarif["results"][0]["locations"][0]["physical_location"]["artifact_location"]["uri"] == "a/b.txt" and sarif["results"][0]["level"] == "error"
    html = (tmp_path / "html.out").read_text("utf-8")
    assert html.count("<article") == 61 and "A &quot;quoted&quot; &lt;rule&gt;" in html and "&lt;&amp;&gt; &quot;é&quot;" in html and html.endswith("</body></html>\n")
    text = (tmp_path / "terminal.out").read_text("utf-8")
    assert text.startswith("CRITICAL a\\b.txt:1:1\n  b (CWE-1)\n") and "61 finding(s)" in text
    none = Scanner(spark, Registry([Pack("p", "1", rules=(rules[1],))])).scan(files.limit(1))
    assert json.loads(report.json_report(none))["findings"] == [] and json.loads(report.sarif_report(none))["runs"][0]["results"] == []
    with pytest.raises(ValueError, match="unknown report"):
        report.render(none, "pdf")
