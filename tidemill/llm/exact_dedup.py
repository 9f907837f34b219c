"""Exact dedup: a two-pass Bloom filter picks the rows that may repeat.

Pass one posts two bits of every row's text hash in a blocked Bloom filter
and keeps the bits that were posted more than once.  Pass two tests each row
against the kept bits: a row with a clear bit is the only one with its text
and passes straight through; the others shuffle, and a digest settles which
of them really repeat.  Everything is a DataFrame function; no Python runs
on the executors.

Texts are read once, for a table of digests that both passes work on, so no
text shuffles.  The filter is cut in blocks of hash ranges.  Blocks up to
``MAX_FILTER_BYTES`` are broadcast; beyond that digests meet their block by a
shuffle, and the filter works as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BITMAP_BITS, hide, is_set, marked, numbered, shown, table, write_table

#: Bits for each row; with two bits a row, about 1.4 % of unique rows test positive.
BITS_PER_ROW = 16
#: Most bytes of filter blocks that are broadcast; beyond, digests are dealt to their blocks.
MAX_FILTER_BYTES = 64 << 20

_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_NEW = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, id, len, h, sha) of each row, written: what dedup needs instead of the text. len: code points of the original text."""
    text = rows.select("_row", F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("len"), normalised(F.col(text_col)).alias("t"))
    return write_table(text.select("_row", "id", "len", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "digests")


def _bits() -> tuple[Column, Column]:
    return F.col("h").bitwiseAND(BITMAP_BITS - 1), F.shiftright("h", 15).bitwiseAND(BITMAP_BITS - 1)


def may_repeat(digest: DataFrame) -> DataFrame:
    """``digest`` with may: whether the filter has another row with its bits."""
    blocks = max(1, -(-digest.count() * BITS_PER_ROW // BITMAP_BITS))
    block = F.pmod(F.shiftright("h", 30), F.lit(blocks)).cast("int")
    bits = digest.select(block.alias("block"), F.explode(F.array_distinct(F.array(*_bits()))).alias("bit"))
    twice = bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bitmaps = write_table(twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "repeat-filter")
    if bitmaps.count() * (BITMAP_BITS // 8) <= MAX_FILTER_BYTES:
        bitmaps = F.broadcast(bitmaps)
    one, two = _bits()
    met = digest.withColumn("block", block).join(bitmaps, "block", "left")
    return met.withColumn("may", F.coalesce(is_set(F.col("bits"), one) & is_set(F.col("bits"), two), F.lit(False))).drop("block", "bits")


def copies(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, id, keep_id, group_size, kept, text_sha256) of each of ``rows``, which are numbered by _row."""
    digest = may_repeat(digests(rows, id_col, text_col))
    out = ["_row", "id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    unique = digest.filter(~F.col("may")).withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    may = digest.filter("may")
    order = F.struct((-F.col("len")).alias("l"), F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("_row").alias("r"))
    best = may.groupBy(F.col("sha").alias("key")).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # written, so that both sides of the join are plain shuffles and Spark splits a text that holds many rows
    best = write_table(best, "groups")
    repeated = may.join(best, F.col("sha") == F.col("key")).withColumns({"keep_id": F.col("best.i"), "kept": F.col("best.r") == F.col("_row")})
    return unique.select(*out).unionByName(repeated.select(*out))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without white space (null counts as empty, so
    all empty texts are one group).  Of equal texts the row with the most code
    points in its original text stays, then the smallest id (a null id comes
    last); of rows that repeat id and length too, the first in the input's
    files.  An empty table gives an empty table.  Columns of ``docs`` with the
    names of the new ones are replaced; any other names may occur.

    ``docs`` should come from files.  The other columns are joined by row
    number, a shuffle of them; ``drop_copies`` needs none.  A text that holds a
    third of all rows is counted map-side and joined back as a skewed join
    that Spark splits.
    """
    plain, names, (i, t) = hide(docs, _NEW, id_col, text_col)
    rows = numbered(plain)
    return rows.join(copies(rows, i, t).drop("id"), "_row").select(*shown(names), *_NEW)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with the columns of ``docs``, whatever their names; no text moves."""
    plain, names, (i, t) = hide(docs, (), id_col, text_col)
    rows = numbered(plain)
    gone = copies(rows, i, t).filter(~F.col("kept")).select("_row")
    return marked(rows, gone, "_gone").filter(~F.col("_gone")).select(*shown(names))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``; texts as in ``exact_dedup``, of which it takes the columns that the digests have."""
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return copies(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), *_NEW)


QUERIES = {"op5_exact_dedup": op5_exact_dedup}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
}
