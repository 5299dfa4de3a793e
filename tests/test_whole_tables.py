"""Registered queries over whole tables, against Python."""

import re

from siftline.functions import text as X
from siftline.plans import registry


def test_fingerprints_of_every_finding(spark, tmp_path):
    """Lines and matches with other letters than ASCII are fingerprinted too, by their UTF-8."""
    texts = ['plain token = "abc"', 'été token = "abc" über', 'token = "clé secrète" 日本', "Copyright Ägidius 2020\nfür x@y.org", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r.id, f"documents/{i}", k, X.fnv1a64(m.group()), X.fnv1a64("")) for r in registry.prose_rules() for i, t in enumerate(texts) for k, m in enumerate(re.finditer(r.regex, t)))
    got = sorted(tuple(r) for r in registry.fingerprint_fnv1a(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 5 and X.fnv1a64('token = "clé secrète"') in {r[3] for r in got}


def test_enclosing_spans_of_every_customer(spark, tmp_path):
    """Some suppliers lie only, or most closely, in spans of customers whose keys leave 5 or 6 over by 7."""
    suppliers, customers = [(k, k % 3) for k in range(80)], [(k, k % 3) for k in range(1, 60)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    hold = lambda at, n, c: c[1] == n and c[0] % 50 <= at < c[0] % 50 + c[0] % 97 + 1
    want = sorted((n, at, min(((c[0] % 97 + 1, c[0]) for c in customers if hold(at, n, c)), default=(0, -1))[1]) for at, n in suppliers)
    assert sorted(tuple(r) for r in registry.enclosing_spans(spark, str(tmp_path)).collect()) == want
    assert any(span % 7 >= 5 for _, _, span in want if span > 0)
