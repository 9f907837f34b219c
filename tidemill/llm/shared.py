"""Folders, tables and column names: what the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one aggregated bitmap; bytes of bitmaps of rows that may be broadcast, beyond which rows are joined.
BITMAP_BITS, MAX_BITMAP_BYTES = 32768, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where unset, a new one if all runs in this process, else an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it.

    It cuts the lineage: lost executors cost no more than a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_table(*written: DataFrame) -> None:
    """Delete the files of tables of ``write_table`` that nothing reads any more."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(df.written_at)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hide(docs: DataFrame, replaced: Iterable[str] = (), *asked: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``docs`` under column names that clash with nothing, the names of those that are not replaced, and what the asked columns are called.

    Names are compared as Spark compares them, without case unless the session
    says otherwise; a column that is asked for and replaced is in the frame,
    but not among those shown.
    """
    fold = str if docs.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    names = {f"__{i}": c for i, c in enumerate(docs.columns)}
    gone = {fold(c) for c in replaced}
    found = []
    for name in asked:
        same = [h for h, c in names.items() if c == name] or [h for h, c in names.items() if fold(c) == fold(name)]
        if not same:
            raise ValueError(f"no column {name} among {docs.columns}")
        found.append(same[0])
    return docs.toDF(*names), {h: c for h, c in names.items() if fold(c) not in gone}, found


def shown(names: dict[str, str]) -> list[Column]:
    """The columns that ``hide`` has hidden, under their names."""
    return [F.col(h).alias(c) for h, c in names.items()]


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` from files with a number for each row, the same each time they are read.

    How files are split may depend on the cores of the moment; the session
    keeps those of now, so that a lost executor renumbers nothing.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs.withColumn(name, F.monotonically_increasing_id())


def is_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of an aggregated bitmap is set; null if there is no bitmap."""
    byte = F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), bit.bitwiseAND(7).cast("int")) == 1


def marked(docs: DataFrame, rows: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """``docs`` with a column that says whether its row number is in ``rows`` (column of the same name).

    The numbers go as bitmaps, a bit for each row of a block that has any; up
    to MAX_BITMAP_BYTES these are broadcast and no row of ``docs`` moves.
    Beyond that both sides are joined by a shuffle.
    """
    block, bit = F.shiftright(row, 15), F.col(row).bitwiseAND(BITMAP_BITS - 1)
    bitmaps = write_table(rows.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "rows")
    if bitmaps.count() * (BITMAP_BITS // 8) <= MAX_BITMAP_BYTES:
        joined = docs.withColumn("_block", block).join(F.broadcast(bitmaps), "_block", "left")
        return joined.withColumn(name, F.coalesce(is_set(F.col("_bits"), bit), F.lit(False))).drop("_block", "_bits")
    some = rows.select(F.col(row)).distinct().withColumn("_is", F.lit(True))
    return docs.join(some, row, "left").withColumn(name, F.coalesce("_is", F.lit(False))).drop("_is")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
