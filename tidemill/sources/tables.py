"""Sources and sinks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: under ``spark.checkpoint.dir``, or a temporary one if all runs in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidemill-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table; filters and columns are pushed down to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def import_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-delimited text with a bar at the end of each line.

    Dates are ``yyyy-mm-dd``, booleans 0 or 1, padded strings lose their
    padding (blanks and NULs at the end). A line with other fields fails.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.BooleanType, T.StringType)) else f.dataType) for f in schema.fields])
    raw = raw.add("_end", T.StringType())
    df = spark.read.option("sep", "|").option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").schema(raw).csv(path)
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.when(c == "1", True).when(c == "0", False)
        elif isinstance(f.dataType, T.StringType):
            c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00 ]+$", "")
        out.append(c.alias(f.name))
    return df.select(*out)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def import_tbl_dir(spark: SparkSession, tbl_dir: str, out_dir: str, schemas: dict[str, T.StructType]) -> list[str]:
    """Import ``name.tbl`` of each schema as ``name.parquet``; tables that are there already are passed over."""
    done = []
    for name, schema in schemas.items():
        out = f"{out_dir}/{name}.parquet"
        if not exists(spark, f"{out}/_SUCCESS"):
            write(import_tbl(spark, f"{tbl_dir}/{name}.tbl", schema), out)
            done.append(name)
    return done


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def print_records(df: DataFrame, n: int = 10) -> None:
    df.show(n, truncate=False)
