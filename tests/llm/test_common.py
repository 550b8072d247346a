import os

from pyspark.sql import functions as F

from consensa.llm import common


def shuffled(path):
    return sum(name.startswith("shuffle_") and name.endswith(".data") for _, _, names in os.walk(path) for name in names)


def test_written_leaves_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()
    before = spark.conf.get(common.SHUFFLE_CLEANUP)
    df = spark.range(1000).select(F.col("id"), F.xxhash64("id").alias("x")).repartition(5, "x")
    had = shuffled(local)
    out = common.written(df, "test")
    for _ in range(50):  # files go in the background
        if shuffled(local) <= had:
            break
        __import__("time").sleep(0.2)
    assert shuffled(local) <= had
    assert sorted(r.id for r in out.collect()) == list(range(1000))
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == before


def test_freed_and_narrowed(spark, monkeypatch):
    rows = common.written(spark.range(5000).select("id", F.col("id").cast("string").alias("x")), "test")
    assert os.path.isdir(rows.written_to.removeprefix("file:"))
    wanted = spark.createDataFrame([(k,) for k in [3, 77, 77, 4999]], "id long")
    few = common.narrowed(rows, wanted, ["id"])
    assert few.columns == rows.columns
    assert {3, 77, 4999} <= {r.id for r in few.collect()} and few.count() < 10
    assert common.narrowed(rows, wanted.limit(0), ["id"]).count() == 0
    monkeypatch.setattr(common, "MAP_BITS", 64)  # most bits are set: rows are kept that no one wants, never the other way round
    many = common.narrowed(rows, rows.where("id % 10 = 0"), ["id"])
    assert {r.id for r in many.collect()} >= set(range(0, 5000, 10))
    common.freed(rows)
    assert not os.path.exists(rows.written_to.removeprefix("file:"))
