"""The jobs over copies of the tables: repeated runs, growing input, broken-off batches, awkward rows, command lines."""

import logging
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import alert_feed, scorecard
from jobs.common import ConfigError, load_config, pattern_rules
from siftline.session import table

SF = "/root/testdata/sf0.001"
FEED, CARDS = load_config(alert_feed.__file__), load_config(scorecard.__file__)
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def land(spark, folder, rows, name):
    """One more Parquet file in a landing folder."""
    spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], DOC).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def plain(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


def by_hand(rows):
    """{(rule, path, line of text)} of the prose rules, without silenced lines, over (id, text)."""
    out = Counter()
    for i, text, _ in rows:
        for r in pattern_rules(["corpus"]):
            for m in re.finditer(r.regex, text or ""):
                begin = text.rfind("\n", 0, m.start()) + 1
                line = text[begin:].split("\n", 1)[0]
                before = text[:begin].split("\n")[-2] if begin else ""
                if "# nosec" not in line and "# nosec" not in before:
                    out[r.id, f"documents/{'' if i is None else i}", " ".join(line.split())] += 1
    return out


FIRST = [(1, 'a\npassword = "x1"\nmail me@here.org', "s"), (2, "nothing", "s"), (3, None, None), (None, "ip 10.0.0.1", "t"), (4, 'token = "t"  # nosec\nCopyright by no one', ""), (5, 'secret = "a"\n' * 3, "t"), (6, "", "u")]
SECOND = [(1, 'moved\n\na\npassword  =  "x1"\npassword = "x1"\nmail me@here.org', "s"), (2, "now from 192.168.1.1 here", "s"), (7, 'api_key = "é"\n-----BEGIN RSA PRIVATE KEY-----', "s"), (2, "nothing", "s")]


def test_feed_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs.alert_feed")
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    land(spark, folder, FIRST, "a")
    first = alert_feed.run(spark, f"{folder}/*", out, FEED)
    got = {(r.rule_id, r.path, " ".join(r.code_snippet.split())): r.places for r in alert_feed.read(spark, out).collect()}
    assert got == by_hand(FIRST) and first == len(got)
    before = plain(alert_feed.read(spark, out))
    assert alert_feed.run(spark, f"{folder}/*", out, FEED) == 0 and plain(alert_feed.read(spark, out)) == before  # nothing new
    land(spark, folder, SECOND, "b")
    second = alert_feed.run(spark, f"{folder}/*", out, FEED)
    fresh = {(r.rule_id, r.path, " ".join(r.code_snippet.split())) for r in alert_feed.read(spark, out).filter("batch > 0").collect()}
    assert fresh == set(by_hand(SECOND)) - set(by_hand(FIRST)) and second == len(fresh) > 0
    assert [r for r in plain(alert_feed.read(spark, out).filter("batch = 0"))] == before
    assert "read 4 new rows, wrote 3 new alerts" in caplog.text and "read 0 new rows" in caplog.text
    assert alert_feed.read(spark, out).groupBy("fingerprint").count().filter("count > 1").isEmpty()


def test_feed_repeats_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    land(spark, folder, FIRST, "a")
    alert_feed.run(spark, f"{folder}/*", out, FEED)
    land(spark, folder, SECOND, "b")
    alert_feed.run(spark, f"{folder}/*", out, FEED)
    whole = plain(alert_feed.read(spark, out))
    commits = Path(tmp_path, "out/checkpoint/commits")
    for f in commits.iterdir():  # the second batch was written but not yet committed
        if f.name.strip(".").split(".")[0] == "1":
            os.remove(f)
    alert_feed.run(spark, f"{folder}/*", out, FEED)
    assert plain(alert_feed.read(spark, out)) == whole


def test_feed_in_small_batches(spark, tmp_path):
    """Files of the given table one by one: the same fingerprints as all at once, each once."""
    folder, one, many = f"file://{tmp_path}/in", f"file://{tmp_path}/one", f"file://{tmp_path}/many"
    table(spark, SF, "documents").repartition(3).write.parquet(folder)
    alert_feed.run(spark, folder, one, FEED)
    alert_feed.run(spark, folder, many, FEED | {"files_per_batch": 1})
    assert alert_feed.read(spark, many).select("batch").distinct().count() > 1
    assert plain(alert_feed.read(spark, one), "batch") == plain(alert_feed.read(spark, many), "batch") != []


def test_feed_of_nothing(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    land(spark, folder, [(1, "clean", "s")], "a")
    assert alert_feed.run(spark, f"{folder}/*", out, FEED) == 0 and alert_feed.read(spark, out).count() == 0
    land(spark, folder, FIRST, "b")
    assert alert_feed.run(spark, f"{folder}/*", out, FEED) == len(by_hand(FIRST))


def copy_tables(spark, tmp_path, rows):
    """The job's tables in a folder: these documents, and the given pages and conversations."""
    where = f"file://{tmp_path}/tables"
    spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOC).write.mode("overwrite").parquet(f"{where}/documents.parquet")
    for name in ("pages", "conversations"):
        table(spark, SF, name).write.mode("overwrite").parquet(f"{where}/{name}.parquet")
    return where


def test_scorecard(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs.scorecard")
    where, out = copy_tables(spark, tmp_path, FIRST), f"file://{tmp_path}/out"
    totals = scorecard.run(spark, where, out, CARDS)
    cards = scorecard.read(spark, out)
    docs = {(r.owner, r.category): r for r in cards.filter("corpus = 'documents'").collect()}
    assert {o for o, _ in docs} == {"", "s", "t", "u"} and len(docs) == 4 * len({c for _, c in docs})
    s = docs["s", "hardcoded-credentials"]
    assert (s.files, s.files_hit, s.findings, s.critical, s.first_path, s.first_line, s.score, s.grade) == (2, 1, 1, 1, "documents/1", 2, 5000, "F")
    t = docs["t", "hardcoded-credentials"]
    assert (t.files, t.files_hit, t.findings, t.first_rule) == (2, 1, 3, "corpus.credential-assignment")
    assert (docs["", "hardcoded-credentials"].findings, docs["", "licensing"].findings) == (0, 0)  # both lines lie under the marker
    assert (docs["u", "licensing"].grade, docs["u", "licensing"].first_path, docs["u", "licensing"].score) == ("A", None, 0)
    assert totals["critical"] == cards.agg(F.sum("critical")).first()[0] > 0 and scorecard.failing(totals, "critical")
    assert "read 7 files of documents" in caplog.text
    before = plain(cards)
    scorecard.run(spark, where, out, CARDS)
    assert plain(scorecard.read(spark, out)) == before
    copy_tables(spark, tmp_path, [(9, "all is well", "new")])  # owners that are gone leave their cards behind nowhere
    scorecard.run(spark, where, out, CARDS | {"corpora": CARDS["corpora"][:1]})
    now = scorecard.read(spark, out)
    assert {r.owner for r in now.filter("corpus = 'documents'").collect()} == {"new"} and plain(now.filter("corpus != 'documents'")) == [r for r in before if "corpus='documents'" not in r]


def test_scorecard_of_an_empty_table(spark, tmp_path):
    where, out = copy_tables(spark, tmp_path, []), f"file://{tmp_path}/out"
    totals = scorecard.run(spark, where, out, CARDS)
    assert scorecard.read(spark, out).filter("corpus = 'documents'").count() == 0 and sum(totals.values()) >= 0


def test_wrong_configurations(spark):
    with pytest.raises(ConfigError, match="unknown severity"):
        alert_feed.run(spark, SF, "unused", FEED | {"min_severity": "dire"})
    with pytest.raises(ConfigError, match="no corpora"):
        scorecard.run(spark, SF, "unused", CARDS | {"corpora": []})


def test_command_lines(tmp_path):
    root = Path(__file__).resolve().parents[1]
    run = lambda job, *args: subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=root, capture_output=True, text=True, timeout=300)
    feed = run("alert_feed", "--source", f"{SF}/documents.parque[t]", "--output", f"{tmp_path}/feed")
    assert feed.returncode == 0 and re.search(r"wrote [1-9]\d* new alerts", feed.stderr), feed.stderr[-2000:]
    strict = tmp_path / "strict.toml"
    strict.write_text((root / "jobs/scorecard.toml").read_text("utf-8").replace('fail_on = "critical"', 'fail_on = "low"'), "utf-8")
    cards = run("scorecard", "--tables", SF, "--output", f"{tmp_path}/cards", "--config", str(strict))
    assert cards.returncode == 2 and "files of pages" in cards.stderr, cards.stderr[-2000:]
    assert sorted(p.name for p in Path(tmp_path, "cards").iterdir()) == ["corpus=conversations", "corpus=documents", "corpus=pages"]
