"""Uses know their definitions, and calls whether their file has the function, so neither takes a join."""

from siftline.operators import flow, graph
from siftline.sources.syntax import Tree


def test_rows_know_definitions_and_functions_of_their_own_file():
    text = "from lib import run as go\n\ndef own(a):\n    b = a\n    own(b)\n    return go(b)\n"
    rows = list(flow.Values(Tree(text, "python")).whole())
    uses = [u for r in rows for u in r[12]]
    assert uses and all((u["kind"], u["fn"], u["pos"]) == (rows[u["def"]][1], rows[u["def"]][2], rows[u["def"]][5]) for u in uses)
    assert [(r[3], r[14]) for r in rows if r[1] == flow.CALL] == [("own", []), ("go", ["go", "run"])]


def test_imports_are_read_once(spark):
    """The two joins that look for an import's file don't parse each for itself."""
    files = spark.createDataFrame([(1, "a/main.ts", "typescript", 'import { run } from "./x";\n'), (2, "a/x.ts", "typescript", "")], "file_id long, path string, language string, text string")
    found = graph.import_files(graph.facts(files), files.select("file_id", "path"))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert [(r.file_id, r.local, r.target_path, r.rank) for r in found.collect()] == [(1, "run", "a/x.ts", 0)]
