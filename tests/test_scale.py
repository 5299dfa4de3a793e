"""Work of a task and of a round stays bounded as tables grow."""

from siftline import session
from siftline.operators import query


def test_query_is_compiled_once_for_all_files():
    text = '(call function: (identifier) @f (#eq? @f "once"))'
    assert query.compile_query(text) is query.compile_query(text)


def test_parts_grow_with_rows(spark):
    rows = 10 * session.TASK_ROWS
    assert session.spread(spark.range(0, rows, 1, 1)).rdd.getNumPartitions() >= 10
    assert session.spread(spark.range(0, 2 * rows, 1, 1)).rdd.getNumPartitions() >= 20
    assert session.spread(spark.range(0, 8, 1, 1)).count() == 8


def test_snapshot_writes_few_files_a_bucket(spark, tmp_path):
    from pyspark.sql import functions as F

    from siftline.sources.state import GraphSnapshot

    rows = spark.range(0, 300, 1, 30).select(F.col("id").alias("file_id"), F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("def f"), "id", F.lit("():\n    pass\n")).alias("text"))
    snapshot = GraphSnapshot(spark, f"file://{tmp_path}/snapshot", buckets=4)
    got = snapshot.refresh(rows.withColumn("source_hash", F.sha2("text", 256)))
    assert got.filter("kind = 'symbol'").count() == 300 and snapshot.parsed == 300
    assert len(list(tmp_path.rglob("bucket=*/*.parquet"))) <= 4 + spark.sparkContext.defaultParallelism


def test_snapshot_adds_only_what_has_changed(spark, tmp_path):
    """Neither stored facts nor texts are written again for a few changes; what no file has any more goes once it is the greater part."""
    from pyspark.sql import functions as F

    from siftline.sources.state import GraphSnapshot

    n = F.col("id").cast("string")
    rows = lambda least, more: spark.range(least, 200, 1, 8).select(F.col("id").alias("file_id"), F.concat(F.lit("m"), n, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.concat(F.lit("def f"), n, F.lit("():\n    pass\n"), F.when(F.col("id") < more, "x = 1\n").otherwise("")).alias("text")).withColumn("source_hash", F.when(F.col("file_id") != 7, F.sha2("text", 256)))
    snapshot = GraphSnapshot(spark, f"file://{tmp_path}/snapshot", buckets=2)
    stored = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    names = lambda got: sorted(r[0] for r in got.filter("kind = 'symbol'").select("name").collect())
    want = sorted(f"f{i}" for i in range(200))
    assert names(snapshot.refresh(rows(0, 0))) == want and snapshot.parsed == 200
    first = stored()
    assert names(snapshot.refresh(rows(0, 20))) == want and snapshot.parsed == 20
    second = stored()
    assert first.items() <= second.items()
    added = [p for p in second if p not in first]
    assert sum(spark.read.parquet(f"file://{p}").count() for p in added) == 20
    # A file without a hash is parsed each time.
    assert names(snapshot.refresh(rows(0, 20))) == want and snapshot.parsed == 1
    assert names(snapshot.refresh(rows(150, 20))) == sorted(f"f{i}" for i in range(150, 200)) and snapshot.parsed == 0
    left = stored()
    assert not first.keys() & left.keys() and len(left) <= 2 and sum(spark.read.parquet(f"file://{p}").count() for p in left) == 50
