"""Complements and inverses with nulls, repeated rows and empty inputs."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import relational as R
from tidemill.operators import reverse as V

from .conftest import rows

DATA = [(1, "a", None), (2, None, 2.0), (2, None, 2.0), (3, "b", 5.0), (4, "b", -1.0), (None, None, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(DATA, "k int, s string, x double")


def test_split_keeps_nulls_on_the_other_side(df):
    yes, no = V.split(df, F.col("x") > 0)
    assert yes.count() == 3 and no.count() == 3
    assert rows(V.unsplit(yes, no)) == rows(df)


def test_limit_needs_a_key_and_round_trips(df):
    with pytest.raises(ValueError):
        V.split_limit(df, [F.col("x").desc()], [], 2)
    one = df.dropDuplicates(["k"])
    for n in (0, 2, 99):
        first, rest = V.split_limit(one, [F.col("x").desc()], ["k"], n)
        assert first.count() == min(n, 5)
        assert rows(V.unlimit(first, rest)) == rows(one)


def test_project_round_trip_with_a_null_key(df):
    one = df.dropDuplicates(["k"])
    proj, rest = V.split_project(one, {"y": F.col("x") * 2}, {"x"}, ["k"])
    assert rest.columns == ["k", "s"]
    assert rows(V.unproject(proj, rest, ["k"], {"x": F.col("y") / 2}, one.columns)) == rows(one)


def test_join_outputs_and_unjoin(spark):
    # 1000 matching rows and 10 more on the right
    a = spark.range(1000).select(F.col("id").alias("a1"), F.col("id").alias("a2"))
    b = spark.range(1010).select((1009 - F.col("id")).alias("b1"), F.col("id").alias("b2"))
    j = V.join3(a, b, F.col("a1") == F.col("b1"))
    assert (j.join.count(), j.left_anti.count(), j.right_anti.count()) == (1000, 0, 10)
    assert rows(V.unjoin(j.join, j.left_anti, a.columns, ["a1"])) == rows(a)
    assert rows(V.unjoin(j.join, j.right_anti, b.columns, ["b1"])) == rows(b)
    with pytest.raises(ValueError):
        V.unjoin(j.join, j.left_anti, a.columns, [])


def test_bag_join_with_duplicates_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "a int, n string")
    b = spark.createDataFrame([(1,), (1,), (None,)], "b int")
    j = V.join3(a, b, F.col("a") == F.col("b"))
    assert j.join.count() == 4
    assert rows(j.left_anti) == [(None, "z")] and rows(j.right_anti) == [(None,)]


def test_union_pads_with_defaults(spark):
    left = spark.createDataFrame([(1, 2, 0.5, "s", True)], "i int, l long, d double, s string, b boolean")
    right = spark.createDataFrame([(7,)], "i int")
    assert sorted(tuple(r) for r in R.union(left, right).collect()) == [(1, 2, 0.5, "s", True), (7, -1, 0.0, "", False)]


def test_group_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, x int")
    assert [tuple(r) for r in R.group(empty, [], {"n": F.count(F.lit(1)), "s": F.sum("x")}).collect()] == [(0, None)]
    assert R.group(empty, [F.col("k")], {"k": F.col("k"), "n": F.count(F.lit(1))}, ["k"]).count() == 0


def test_limit_and_drop(spark):
    df = spark.range(10).orderBy("id")
    assert [r.id for r in R.limit(df, 3).collect()] == [0, 1, 2]
    assert [r.id for r in R.drop(df, 7).collect()] == [7, 8, 9]
    assert R.limit(df, -1).count() == 10
