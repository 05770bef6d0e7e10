"""Output that appears whole or not at all, budgets that stop reading."""

import random

import pytest
from pyspark.sql import functions as F

from linepack.sources import corpus, items, published
from linepack.streaming import ingest as S


def test_killed_run_publishes_nothing(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    docs = spark.createDataFrame([("a", 1, "x."), ("a", 2, None), ("b", 3, "y"), (None, 4, "z.")], "shard string, id int, text string")
    fix = lambda d: d.withColumn("text", F.replace("text", F.lit("."), F.lit("")))
    with monkeypatch.context() as m:
        m.setattr(published, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            corpus.rewrite_shards(spark, docs, "shard", out, fix, "id")
    assert published.read_published(spark, out) is None and published.committed(spark, out).count() == 0
    first = corpus.rewrite_shards(spark, docs.where("shard = 'a'"), "shard", out, fix, "id")
    assert [tuple(r) for r in first.collect()] == [("a", 2, 1, 0.5)]
    second = corpus.rewrite_shards(spark, docs, "shard", out, fix, "id")
    assert sorted(map(tuple, second.collect()), key=str) == [("b", 1, 0, 0.0), (None, 1, 1, 1.0)]
    assert corpus.rewrite_shards(spark, docs, "shard", out, fix, "id").collect() == []
    assert sorted((r.id, r.text, r.modified) for r in published.read_published(spark, out).collect()) == [(1, "x", True), (2, None, False), (3, "y", False), (4, "z", True)]


def test_batch_that_fails_before_its_commit_counts_once(spark, tmp_path, monkeypatch):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    work = lambda d: d.groupBy("text").agg(F.count("*").alias("n"))
    spark.createDataFrame([("a",), ("a",), ("b",)], "text string").coalesce(1).write.parquet(src)
    commit = published.commit
    with monkeypatch.context() as m:
        m.setattr(published, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            S.ingest_batches(S.stream_corpus(spark, src), out, cp, work).awaitTermination()
    assert published.read_published(spark, out) is None

    def twice(*a):  # committed, and lost before the stream knows
        commit(*a)
        raise RuntimeError("late")

    with monkeypatch.context() as m:
        m.setattr(published, "commit", twice)
        with pytest.raises(Exception, match="late"):
            S.ingest_batches(S.stream_corpus(spark, src), out, cp, work).awaitTermination()
    for _ in range(2):
        S.ingest_batches(S.stream_corpus(spark, src), out, cp, work).awaitTermination()
    assert sorted(map(tuple, published.read_published(spark, out).collect())) == [("a", 2), ("b", 1)]
    spark.createDataFrame([("a",)], "text string").coalesce(1).write.mode("append").parquet(src)
    S.ingest_batches(S.stream_corpus(spark, src), out, cp, work).awaitTermination()
    assert sorted(map(tuple, published.read_published(spark, out).collect())) == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_budgets_equal_running_sums(spark, inclusive):
    rnd = random.Random(inclusive)
    rows = [(f"s{i % 7}", i, rnd.choice([None, 0, 1, 5, 40])) for i in range(300)]
    df = spark.createDataFrame(rows, "shard string, ord int, size int").repartition(5).cache()
    for budget in (0, 1, 77, 900, 2000, 10**6):
        want, total = set(), 0
        for s, o, n in sorted(rows, key=lambda x: x[:2]):
            if total <= budget if inclusive else total < budget:
                want.add(o)
            total += n or 0
        got = corpus.take_budget(df, F.col("size"), budget, "shard", "ord", inclusive)
        assert {r.ord for r in got.collect()} == want and got.columns == df.columns
    assert corpus.take_budget(df.limit(0), F.col("size"), 5, "shard", "ord").count() == 0


def test_budget_reads_no_later_shard(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    spark.range(100).select((F.col("id") % 5).cast("int").alias("shard"), "id", F.lit(10).alias("size")).write.partitionBy("shard").parquet(path)
    kept = corpus.take_budget(spark.read.parquet(path).select("shard", "id", "size"), F.col("size"), 300, "shard", "id")
    for later in (2, 3, 4):  # files that are gone cannot be read
        for f in (tmp_path / "c" / f"shard={later}").glob("*.parquet"):
            f.unlink()
    assert kept.count() == 31


def test_partial_scores(spark, tmp_path):
    scores = spark.createDataFrame([("x", 0.5, 0.25), ("y", None, None)], "task string, accuracy double, centered double")
    for expected, label in ((None, "CORE"), (1, "CORE"), (2, "CORE_PARTIAL")):
        rows = items.read_scores(spark, items.write_scores(scores, f"file://{tmp_path}", f"r{expected}", expected=expected)).collect()
        assert [tuple(r) for r in rows] == [("x", 0.5, 0.25), ("y", None, None), (label, None, 0.25)]
