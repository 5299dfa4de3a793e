"""Trees that executors list and read, against the driver's walk."""

import os
import random

import pytest

from siftline.plans.scan import Scanner
from siftline.sources import listing, tree


def shown(df, root):
    return sorted(r.path.removeprefix(f"file://{root}/") for r in df.collect())


@pytest.fixture
def forest(tmp_path):
    """Folders of random names and depths, with a chain deeper and a folder wider than a task lists."""
    names, rng = ["src", "gen", "node_modules", "build", "a b", "é%20", "lib+x", ".hidden", "deep"], random.Random(3)
    for i in range(300):
        folder = tmp_path.joinpath(*rng.choices(names, k=rng.randrange(6)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / rng.choice(["m.py", "n.java", f"f{i}.txt", "t1.py"])).write_text(f"x = {i}\n")
    chain = tmp_path.joinpath(*["c"] * (listing.FOLDERS + 9))
    chain.mkdir(parents=True)
    (chain / "end.py").write_text("end\n")
    for i in range(listing.FOLDERS * 3):
        (tmp_path / "wide" / f"w{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"w{i}" / "m.py").write_text(f"{i}\n")
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "wide", tmp_path / "src" / "linked")
    os.symlink(tmp_path / "wide" / "w0" / "m.py", tmp_path / "src" / "link.py")
    os.mkfifo(tmp_path / "src" / "pipe.py")
    return tmp_path


@pytest.mark.parametrize("excludes", [[], ["gen", "t?.py", "src/lib*", "é*"]])
def test_listing_is_the_drivers_walk(spark, forest, excludes):
    want = sorted(os.path.relpath(p, forest) for p in tree.discover([str(forest)], excludes))
    found = listing.listing(spark, [f"file://{forest}"], excludes)
    assert shown(found, forest) == want and len(want) > 200 and any(w.endswith("end.py") for w in want)
    read = {r.path: (r.length, r.content) for r in listing.read(found).collect()}
    assert len(read) == len(want)
    for w in want:
        data = (forest / w).read_bytes()
        assert read[f"file://{forest}/{w}"] == (len(data), bytearray(data))


def test_targets(spark, forest):
    """A target file is taken whatever its name, an ignored target folder too; overlaps give a path once; links to files don't count."""
    (forest / "node_modules").mkdir(exist_ok=True)
    (forest / "node_modules" / "own.py").write_text("1\n")
    at = f"file://{forest}"
    found = listing.listing(spark, [f"{at}/node_modules/", f"{at}/node_modules/own.py", f"{at}/wide/w1/m.py", f"{at}/src/link.py"], ["m.py"])
    assert [p for p in shown(found, forest) if p.endswith(("own.py", "w1/m.py", "link.py"))] == ["node_modules/own.py", "wide/w1/m.py"]
    assert shown(listing.listing(spark, [f"{at}/empty"]), forest) == [] and listing.read(listing.listing(spark, [f"{at}/empty"])).count() == 0
    with pytest.raises(tree.ScopeError):
        listing.listing(spark, [f"{at}/missing"])
    plain = listing.listing(spark, [str(forest / "wide" / "w2")])
    assert [r.path for r in plain.collect()] == [str(forest / "wide" / "w2" / "m.py")]


def test_files_that_go_or_grow(spark, forest):
    found = listing.listing(spark, [f"file://{forest}/wide"])
    (forest / "wide" / "w0" / "m.py").unlink()
    (forest / "wide" / "w1" / "m.py").write_bytes(b"#" * (tree.MAX_BYTES + 1))
    rows = {r.path.rsplit("/", 2)[1]: r for r in tree.prepare(listing.read(found)).collect()}
    assert rows["w0"].status == "read" and rows["w0"].message == "file could not be read"
    assert rows["w1"].status == "read" and "limit" in rows["w1"].message and rows["w2"].status == "analysed"
    (forest / "wide" / "w3" / "m.py").write_bytes(b"#" * (tree.MAX_BYTES + 5))
    again = {r.path.rsplit("/", 2)[1]: r for r in tree.prepare(listing.read(listing.listing(spark, [f"file://{forest}/wide"]))).collect()}
    assert again["w3"].status == "read" and again["w3"].length == tree.MAX_BYTES + 5 and "w0" not in again


def test_scan_of_an_address(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("import os\nos.system(x)\n")
    (tmp_path / "src" / "node_modules" / "b.py").write_text("os.system(x)\n")
    (tmp_path / "src" / "d.txt").write_text("x\n")
    result = Scanner.for_packs(spark, ["python"]).scan_paths([f"file://{tmp_path}/src"])
    assert [(r.path, r.start_line) for r in result.findings.collect()] == [(f"file://{tmp_path}/src/a.py", 2)]
    assert result.counters["files_discovered"] == 2 and result.counters["files_skipped"] == 1
