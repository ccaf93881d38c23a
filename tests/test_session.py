import pytest
from pyspark.sql import functions as F

from lectern import session


def test_lookup(spark):
    d = spark.createDataFrame([(1, "a")] * 40 + [(2, "b"), (3, None), (None, "c")], "k int, x string")
    t = spark.createDataFrame([(1, "one"), (3, "three"), (9, "nine")], "k int, name string")
    for how in ("inner", "left"):
        plain, spread = (sorted(map(tuple, session.lookup(d, t, "k", how, bound=b).select("k", "x", "name").collect()), key=str) for b in (100, 0))
        assert plain == spread and len(plain) == (41 if how == "inner" else 43)


def test_keep_matching(spark):
    d, k = spark.range(100), spark.range(0, 200, 7)
    for bound in (1000, 3):
        assert [r[0] for r in session.keep_matching(d, k.union(k), "id", bound).orderBy("id").collect()] == list(range(0, 100, 7))


def test_spread(spark):
    small = spark.range(10, numPartitions=1)
    assert session.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10, numPartitions=16)).rdd.getNumPartitions() == 16


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.shared_dir(Session())


def test_cut_keeps_rows(spark):
    d = session.cut(spark.range(50).withColumn("r", F.rand()))
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, d.collect()))
    assert session.scratch(spark, "x") != session.scratch(spark, "x")
