"""Benchmark decontamination over a positional inverted index.

``store_postings`` writes (document, term, position) for the test terms, sharded
as the documents are, so that building it shuffles nothing.  A query phrase is
found by intersecting the offset-adjusted lists of its rarest terms, and what
is left is checked word by word.  Only these lists and the texts of documents
with candidates shuffle.  All of it is DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_table, hide, marked, numbered, shown, table, write_table

#: Words of a window.
WINDOW = 10
#: Vocabularies and phrase tables up to this many rows and bytes are broadcast; larger ones join by a shuffle.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20

_NEW = ("n_words", "hits", "n_hit", "items", "n_items", "contaminated")
#: Runs of anything but [\x00-\x2F\x3A-\x60\x7B-\x7F], and of that or A-Z; Java looks single characters up in a table, but tries ranges one by one.
_WORD = rf"[{string.ascii_lowercase}{string.digits}\x80-\x{{10FFFF}}]+"
_WORD_ANY_CASE = rf"[{string.ascii_letters}{string.digits}\x80-\x{{10FFFF}}]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(_WORD), F.lit(0))


def _raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD_ANY_CASE), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, as counted, are within the bounds."""
    size = F.length(F.to_json(F.struct(*df.columns)))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= MAX_BROADCAST_ROWS and b <= MAX_BROADCAST_BYTES else df


def phrase_windows(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(wid, w, items), written: distinct windows of ``width`` words, each an array of words, with the sorted ids that have it."""
    w = words(F.col(text_col))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (width - 1)))
    found = (
        items.select(F.col(id_col).cast("string").alias("_id"), w.alias("_w"))
        .filter(F.size("_w") > 0)
        .select("_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i, width))).alias("w"))
        .groupBy("w")
        .agg(F.array_sort(F.collect_set("_id")).alias("items"))
    )
    return write_table(found.select(F.monotonically_increasing_id().alias("wid"), "w", "items"), "windows")


def vocabulary(windows: DataFrame) -> DataFrame:
    """(term_id, term, key, ascii), written: the distinct words of the windows; key joins words whatever their case, ascii says whether all bytes are below 128."""
    terms = windows.select(F.explode("w").alias("term")).distinct()
    return write_table(terms.select(F.monotonically_increasing_id().alias("term_id"), "term", F.lower("term").alias("key"), (F.length("term") == F.octet_length("term")).alias("ascii")), "vocabulary")


def store_postings(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """The positional index: (doc, term_id, pos) for each word of ``rows`` (_row, text) in ``vocab``, written in the shared folder.

    doc is the row's number, so that rows that share an id stay apart.
    """
    tokens = rows.select(F.col("_row").alias("doc"), F.posexplode(_raw_words(F.col("text"))).alias("pos", "word"))
    # other characters that are lower-cased to A-Z (the Kelvin sign) are of more bytes
    same = F.when(F.col("ascii"), F.octet_length("word") == F.octet_length("term")).otherwise(ascii_lower(F.col("word")) == F.col("term"))
    hit = tokens.withColumn("key", F.lower("word")).join(_small(vocab), "key").filter(same)
    return write_table(hit.select("doc", "term_id", "pos"), "postings")


def term_counts(postings: DataFrame) -> DataFrame:
    """(term_id, n), written: the length of each list; a row for each term, whatever the corpus."""
    return write_table(postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), "lengths")


def rarest_pairs(windows: DataFrame, vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair, a, b, delta, windows), written: for each two rarest terms and their distance, the windows that they open.

    A window of one word has b null.  windows: array of (off, len, w, items),
    off the place of the rarest term.
    """
    known = write_table(vocab.join(_small(counts), "term_id", "left").select("term", "term_id", F.coalesce("n", F.lit(0)).alias("n")), "terms")
    terms = windows.select("wid", F.posexplode("w").alias("off", "term")).join(_small(known), "term")
    ranked = terms.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term_id"))).alias("r"))
    a, b = F.col("r")[0], F.get("r", F.lit(1))
    chosen = ranked.select("wid", a["term_id"].alias("a"), a["off"].alias("off"), b["term_id"].alias("b"), (b["off"] - a["off"]).alias("delta"))
    opened = (
        windows.join(chosen, "wid")
        .groupBy("a", "b", "delta")
        .agg(F.collect_list(F.struct("off", F.size("w").alias("len"), F.array_join("w", " ").alias("w"), "items")).alias("windows"))
    )
    return write_table(opened.select(F.monotonically_increasing_id().alias("pair"), "*"), "pairs")


def phrase_candidates(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc, cands), written: the places where both rarest terms of a pair stand at their distance.

    The lists of the two terms, moved to the place of the first, are
    intersected by (document, pair, place); nothing else is sent with them.
    cands: array of (pos, windows).
    """
    small = _small(pairs.drop("windows"))
    first = postings.withColumnRenamed("term_id", "a").join(small, "a").select("doc", "pair", "pos", F.when(F.col("b").isNull(), 3).otherwise(1).alias("side"))
    second = (
        postings.withColumnRenamed("term_id", "b")
        .join(small, "b")
        .select("doc", "pair", (F.col("pos") - F.col("delta")).alias("pos"), F.lit(2).alias("side"))
    )
    both = first.unionByName(second).groupBy("doc", "pair", "pos").agg(F.bit_or("side").alias("side")).filter("side = 3")
    opened = both.join(_small(pairs.select("pair", "windows")), "pair")
    return write_table(opened.groupBy("doc").agg(F.collect_list(F.struct("pos", "windows")).alias("cands")), "candidates")


def _hits(tokens: Column, cands: Column) -> Column:
    """The occurrences among the candidates, checked word by word: sorted array of (start, len, items)."""
    def at(c):
        def there(w):
            start = c["pos"] - w["off"]
            return (start >= 0) & (F.array_join(F.slice(tokens, F.greatest(start, F.lit(0)) + 1, w["len"]), " ") == w["w"])

        return F.transform(F.filter(c["windows"], there), lambda w: F.struct((c["pos"] - w["off"]).alias("start"), w["len"].alias("len"), w["items"].alias("items")))

    return F.array_sort(F.flatten(F.transform(cands, at)))


def _covered(hits: Column) -> Column:
    """The number of words in the union of the occurrences."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus n_words, hits, n_hit, items, n_items, contaminated.

    hits: the occurrences of windows as (start, len, items), by place; items:
    the ids, as strings, sorted.  An item of fewer than ``width`` words, but
    not none, is one window; an item without words matches nothing.  Null and
    empty texts have no words and no hits.  Items that repeat a text all
    count.  Rows that repeat an id are told apart by their number, so ``docs``
    should come from files.  Empty tables on either side give no hits.
    Columns of ``docs`` with the names of the new ones are replaced.
    """
    plain, names, (t,) = hide(docs, _NEW, text_col)
    rows = numbered(plain)
    windows = phrase_windows(items, item_id, item_text, width)
    vocab = vocabulary(windows)
    postings = store_postings(rows.select("_row", F.col(t).alias("text")), vocab)
    pairs = rarest_pairs(windows, vocab, term_counts(postings))
    cands = phrase_candidates(pairs, postings)
    drop_table(windows, vocab, postings, pairs)
    met = marked(rows, cands.select(F.col("doc").alias("_row")), "_met")
    n_words = F.size(_raw_words(F.col(t))).cast("long").alias("n_words")
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,len:int,items:array<string>>>")
    none = met.filter(~F.col("_met")).select(*names, n_words, empty.alias("hits"))
    # one evaluation of the words for all candidates of a row
    found = F.transform(F.array(words(F.col(t))), lambda x: _hits(x, F.col("cands")))[0]
    some = met.filter("_met").join(cands, F.col("_row") == F.col("doc")).select(*names, n_words, found.alias("hits"))
    out = none.union(some).select(*shown(names), "n_words", "hits")
    out = out.withColumn("n_hit", _covered(F.col("hits"))).withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"])))))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """The rows of ``docs`` without any window of ``items``, with the columns of ``docs``, whatever their names; nulls and empty tables as above."""
    plain, names, (i, t) = hide(docs, (), id_col, text_col)
    clean = decontaminate(plain, items, i, t, **named).filter(~F.col("contaminated"))
    return clean.select(*shown(names))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item): ids of documents where all distinct words of an item stand within ``slop`` consecutive words, in any order.

    Starts from the postings of the item's rarest word: around each, the
    words within ``slop`` places on either side are gathered (at most
    2 * slop + 1, whatever the input) and a span that has all is looked for.
    Null and empty texts have no words; items without words match nothing; a
    null id stays null; an id or item that several rows repeat is given once.
    Empty tables give no rows; other columns do not matter.  ``docs`` should
    come from files.
    """
    plain, _, (i, t) = hide(docs, (), id_col, text_col)
    rows = numbered(plain).select("_row", F.col(i).alias("id"), F.col(t).alias("text"))
    w = items.select(F.col(item_id).alias("item"), F.array_distinct(words(F.col(item_text))).alias("w")).filter(F.size("w") > 0)
    vocab = vocabulary(w)
    postings = store_postings(rows, vocab)
    need = w.select(F.monotonically_increasing_id().alias("wid"), "item", "w")
    terms = write_table(need.select("wid", "item", F.size("w").alias("need"), F.explode("w").alias("term")).join(vocab, "term").select("wid", "item", "need", "term_id"), "terms")
    rare = terms.join(term_counts(postings), "term_id").groupBy("wid", "need").agg(F.min(F.struct("n", "term_id"))["term_id"].alias("term_id"))
    anchors = postings.join(_small(rare), "term_id").select("doc", "wid", "need", F.col("pos").alias("at"))
    width = F.lit(slop)
    lists = postings.join(_small(terms.select("wid", "term_id")), "term_id").select("doc", "wid", "term_id", "pos", F.floor(F.col("pos") / width).alias("c"))
    cell = F.floor(F.col("at") / width)
    wanted = anchors.select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias("c"))
    around = wanted.join(lists, ["doc", "wid", "c"]).filter(F.abs(F.col("pos") - F.col("at")) < slop)
    span = around.groupBy("doc", "wid", "need", "at").agg(F.array_sort(F.collect_set(F.struct("pos", "term_id"))).alias("p"))
    ok = F.exists("p", lambda s: F.size(F.array_distinct(F.transform(F.filter("p", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + slop)), lambda x: x["term_id"]))) == F.col("need"))
    hit = write_table(span.filter(ok).select("doc", "wid").distinct(), "near")
    ids = marked(rows.select("_row", "id"), hit.select(F.col("doc").alias("_row")), "_hit").filter("_hit").select(F.col("_row").alias("doc"), "id")
    return hit.join(terms.select("wid", "item").distinct(), "wid").join(ids, "doc").select(F.col("id").alias("doc"), "item").distinct()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``, as ``decontaminate`` gives them for ``benchmark``."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op1_decontaminate": op1_decontaminate}

_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, spots.n FROM spots JOIN win USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
}
