"""Data flow and the code graph come from one parse of a file, copies of a file from one in all."""

from siftline.operators import flow, graph, taint
from siftline.session import ship
from siftline.sources.packs import Registry, load_pack, BUILT_IN, rules_table

LIB = "def run(value):\n    return requests.get(value)\n"
APP = "from lib import run as go\n\ndef view(request):\n    name = request.args.get('n')\n    return go(name)\n"
FILES = [
    (1, "a/lib.py", "python", LIB), (2, "a/app.py", "python", APP), (3, "a/bad.py", "python", "def (:\n"), (4, "a/x.ts", "typescript", "import { y } from './y';\nclass A { f(b: B) { y(b); } }\n"),
    (5, "a/none.py", "python", None), (6, "a/notes.txt", "text", "run(1)"), (7, "a/empty.py", "python", ""), (8, "b/lib.py", "python", LIB),
]


def test_values_bring_the_facts_of_the_graph(spark):
    files = ship(spark).createDataFrame(FILES, "file_id long, path string, language string, text string")
    both = flow.values(files, ["python"], told=True)
    shown = lambda rows: sorted(map(tuple, rows.collect()), key=repr)
    assert flow.facts(both).schema == graph.facts(files).schema and shown(flow.facts(both)) == shown(graph.facts(files))
    alone = flow.values(files, ["python"])
    assert shown(both.filter(both["kind"] != flow.FILE)) == shown(alone) and {r.file_id for r in alone.select("file_id").collect()} == {1, 2, 8}


def test_a_file_is_parsed_once_and_its_copies_not_at_all(monkeypatch):
    trees, tree = [], flow.S.Tree
    monkeypatch.setattr(flow.S, "Tree", lambda *a: trees.append(a) or tree(*a))
    flow._kept.cache_clear()
    first, second = (flow._kept(LIB, "python", True, True) for _ in range(2))
    assert first == second and len(trees) == 1
    assert {r[1] for r in first} == {flow.FUNCTION, flow.PARAM, flow.OUT, flow.CALL, flow.ARG, flow.FILE} and [f[0] for f in first[-1][-1]] == ["symbol", "call"]


def test_taint_takes_the_graph_from_its_own_pass(spark, monkeypatch):
    """Several files have the function, so the graph is asked; it is not read from the texts again."""
    monkeypatch.setattr(graph, "facts", lambda *_: (_ for _ in ()).throw(AssertionError("parsed again")))
    files = ship(spark).createDataFrame([f for f in FILES if f[0] in (1, 2, 8)], "file_id long, path string, language string, text string")
    rules = [r for r in Registry.built_in().rules if r.id == "python.security.ssrf"]
    found = taint.taint_findings(files, rules)
    shown = found.select("path", "start_line", "message")
    assert [(r.path, r.start_line, r.message) for r in shown.collect()] == [("a/app.py", 5, "Tainted data from name (source at line 4) reached go(...) reaches sink requests.get(.")]
    # Fingerprints are made only for who asks for them.
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan(shown) and "aggregate(" in plan(found) and len(found.first().fingerprint) == 16


def test_rules_are_a_local_table(spark):
    rules = list(load_pack(BUILT_IN / "corpus").rules)
    table = rules_table(ship(spark), rules)
    assert "LocalRelation" in table._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.rule_id, list(r.languages), r.cwe) for r in table.orderBy("rule_ord").collect()] == [(r.id, list(r.languages), r.cwe) for r in rules] and rules_table(spark, []).count() == 0


def test_pieces_of_a_file_are_read_once_and_give_its_rows(monkeypatch):
    """Functions that come again in other files aren't parsed again; what pieces give is what the whole file gives, or they aren't used."""
    view = "@app.route('/x')\ndef view(request):\n    name = request.args.get('n')\n    def inner(a):\n        return name + a\n    return run(name, inner)\n"
    tops = ["from lib1 import run\n\n", view, "class A(B):\n    def m(self, q):\n        return run(q.get('n'))\n", "# note\nprint(run(1))\n"]
    texts = ["".join(tops), "".join(reversed(tops)), view + "\n\n" + view]
    for text in texts:
        rows, facts = flow._joined(text, True, True)
        whole, told = flow._whole(text, "python", True, True)
        assert rows == whole and facts == told and len(facts) > 4
    # Other names, variables of the module, broken statements, other line ends and letters: the whole file is read.
    for odd in ("from a import b as c\n", "x = 1\n", "f(\na,\nb)\n", "def (:\n", "s = 'a\\\nb'\n", "if a:\n    f()\nelse:\n    g()\nif b:\n    x = 2\n", "y()\r\n", "é()\n", "'''doc\nline at left\n'''\n"):
        for text in (odd + view, view + odd):
            joined, (whole, told) = flow._joined(text, True, True), flow._whole(text, "python", True, True)
            assert joined is None or joined == (whole, told)
            away = [r[13] for r in flow._read(text, "python", True, True) if r[1] == flow.CALL and r[3] == "run"]
            assert away == [["run"]] * (1 if whole else 0)
    trees, tree = [], flow.S.Tree
    monkeypatch.setattr(flow.S, "Tree", lambda *a: trees.append(a) or tree(*a))
    flow._piece.cache_clear()
    for i in range(50):
        flow._read(f"from lib{i} import run\n\n{view}", "python", True, True)
    assert len(trees) == 51


def test_kinds_are_read_apart(spark):
    """A reader of one kind of rows reads no others."""
    files = ship(spark).createDataFrame([f for f in FILES if f[0] in (1, 2, 8)], "file_id long, path string, language string, text string")
    rules = [r for r in Registry.built_in().rules if r.id == "python.security.ssrf"]
    found = taint.Flow(files, rules)
    assert "PartitionFilters: [isnotnull(kind" in found.functions._jdf.queryExecution().toString()
    kinds = {r.kind for r in found.rows.select("kind").distinct().collect()}
    assert kinds == {flow.FUNCTION, flow.DEF, flow.OUT, flow.CALL, flow.ARG, flow.FILE}


def test_rules_are_told_by_small_code(spark):
    """What a text holds is asked by one pattern a rule, whatever its strings are made of; the first sink in a rule's order is told."""
    from pyspark.sql import functions as F

    strings = ("a.b(", "\\E[x]", "c|d", "a.b")
    texts = ["a.b(1)", "axb(", "\\E[x]", "[x]", "c|d a.b", "c", "", None]
    rows = ship(spark).createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", taint._holds(F.col("t"), strings).alias("h"), taint._first(F.col("t"), strings, sorted(strings)).alias("f")).orderBy("i").collect()
    assert [r.h for r in got] == [t is not None and any(s in t for s in strings) for t in texts]
    assert [r.f for r in got] == [next((sorted(strings).index(s) for s in strings if t is not None and s in t), None) for t in texts]
    files = spark.createDataFrame([f for f in FILES if f[0] in (1, 2, 8)], "file_id long, path string, language string, text string")
    many = taint.Flow(files, [r for r in Registry.built_in().rules if r.capability == "taint"])
    plan = many._judged()._jdf.queryExecution().optimizedPlan().toString()
    chained = sum(len(r.sources) + len(r.sinks) + len(r.sanitizers) for _, r in many.rules)
    assert plan.count("RLIKE") <= 8 * len(many.rules) and plan.count("Contains(") <= 2 * len(many.rules) < chained
