import pytest

from tapeloom.llm import common


def test_spread_join_is_the_plain_join(spark):
    """A hot key, rare keys, keys of one side alone and null keys."""
    many = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, i) for i in range(5)] + [(3, 7)] + [(None, i) for i in range(40)], "k long, v long")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, w string")
    for how in ("inner", "left"):
        got, want = common.spread_join(many, one, "k", "v", how=how), many.join(one, "k", how)
        assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, want.select("k", "v", "w").collect()))
    known = many.groupBy("k").count().where(f"count >= {common.HOT_ROWS}").withColumnRenamed("count", "rows")
    assert common.spread_join(many, one, "k", "v", known).count() == 3005


def test_session_settings_are_left_to_the_queries(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "777")
        common.small_batches(spark)
        assert spark.conf.get(key) == "777"
        spark.conf.set(key, "10000")
        common.small_batches(spark)
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, before)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([(1, 2)], "_k int, _K_ int")
    assert common.unused(df, "_k") == "_k__" and [f.name for f in common.others(df, "_K")] == ["_K_"]
