import pytest
from pyspark.sql import functions as F

from nestgrain import session


def test_broadcast_is_measured(spark):
    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(session.small(spark.range(10)))
    spark.conf.set("nestgrain.broadcastRows", "5")
    try:
        assert not hinted(session.small(spark.range(10)))
    finally:
        spark.conf.unset("nestgrain.broadcastRows")
    heavy = spark.range(9).select(F.array_repeat(F.lit(1.0), 1_000_000).alias("v"))
    assert not hinted(session.small(heavy))
    mixed = spark.range(3).select(F.lit("ab").alias("s"), F.struct(F.lit(1).alias("a")).alias("t"), F.lit(None).cast("string").alias("n"))
    assert hinted(session.small(mixed))


def test_checkpoint_folder(spark):
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert session.materialise(spark.range(5)).count() == 5


def test_sizes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "g string")
    assert session.largest_group(df, ["g"]) == 2 and session.largest_group(df, []) == 3
    assert session.is_at_most(df, 3) and not session.is_at_most(df, 2)
    spread, tasks = session.spread(df)
    assert tasks >= 8 and spread.count() == 3


def test_size_checks_use_no_limit(spark):
    """A limit under an aggregate would send rows to one task."""
    import inspect

    assert ".limit(" not in inspect.getsource(session)
