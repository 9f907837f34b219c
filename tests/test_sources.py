import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import extract, like_column, prefix, suffix
from tidemill.sources import import_tbl, import_tbl_dir

SCHEMA = "k int, name string, d date, ok boolean, x double"


def test_tbl_import(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    (tmp_path / "t.tbl").write_text("1|abc  |1998-03-01|1|2.5|\n2||1999-12-31|0|-1|\n")
    got = [tuple(r) for r in import_tbl(spark, str(tmp_path / "t.tbl"), schema).orderBy("k").collect()]
    assert got == [(1, "abc", datetime.date(1998, 3, 1), True, 2.5), (2, "", datetime.date(1999, 12, 31), False, -1.0)]
    assert import_tbl_dir(spark, str(tmp_path), str(tmp_path), {"t": schema}) == ["t"]
    assert import_tbl_dir(spark, str(tmp_path), str(tmp_path), {"t": schema}) == []
    (tmp_path / "bad.tbl").write_text("x|abc|1998-03-01|1|2.5|\n")
    with pytest.raises(Exception):
        import_tbl(spark, str(tmp_path / "bad.tbl"), schema).collect()


@pytest.mark.parametrize("pattern", ["a%", "%a", "%a%", "abc", "a%c", "a_c", "%", "%%"])
def test_like_is_sql_like(spark, pattern):
    df = spark.createDataFrame([("abc",), ("a",), ("",), ("cba",), ("aXc",), (None,)], "s string")
    got = df.select(like_column(F.col("s"), pattern).alias("g"), F.col("s").like(pattern).alias("w"))
    assert got.filter(~F.col("g").eqNullSafe(F.col("w"))).count() == 0


def test_scalars(spark):
    df = spark.sql("SELECT 'abcd' AS s, DATE '2001-12-31' AS d")
    r = df.select(prefix(F.col("s"), 2), suffix(F.col("s"), 3), *(extract(p, F.col("d")) for p in ("year", "month", "day"))).first()
    assert tuple(r) == ("ab", "bcd", 2001, 12, 31)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_command(spark, tmp_path, capsys):
    import json

    from tidemill.sources.__main__ import main

    df = spark.createDataFrame([(1, "a b"), (2, "c")], "k int, t string")
    (tmp_path / "pairs.tbl").write_text("1|a b|\n2|c|\n")
    (tmp_path / "schemas.json").write_text(json.dumps({"pairs": df.schema.jsonValue()}))
    args = [str(tmp_path), str(tmp_path / "out"), str(tmp_path / "schemas.json")]
    assert main(args) == ["pairs"] and main(args) == []
    assert "nothing" in capsys.readouterr().out
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "pairs.parquet")).collect())) == [(1, "a b"), (2, "c")]
