"""Language identification: a linear-chain conditional random field over words.

Affix, n-gram and lexicon features score each word for each language,
transitions score what follows what, and forward-backward gives each word's
marginals, so that text that switches language is labelled word by word.  A
document's language is the one with the largest mean marginal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linear import bounded, held_out
from .shared import drop_table, hide, numbered, shown, table, write_table
from .vectors import LETTERS, LOWER, Words, blocks, column, span_hash, texts, words

#: Buckets of the hashed features: a model is one float32 for each and each language.
BUCKETS = 1 << 18
#: The sample that a model is fitted on: most rows of each language, most languages (those with the most rows), most bytes of text in all.
ROWS_PER_LANG, MOST_LANGS, SAMPLE_BYTES = 250, 100, 32 << 20
#: Frequent words of a language that make its lexicon.
LEXICON = 300
#: Words of a training sequence, share of sequences that switch language, passes, step size, ridge.
LENGTH, SWITCHED, EPOCHS, RATE, RIDGE = 32, 0.4, 3, 0.5, 1e-6
#: Bytes of text whose rows go through forward-backward together.
CHUNK_BYTES = 8 << 20
UNDETERMINED = "und"


@dataclass
class Crf:
    langs: list[str]
    emit: np.ndarray  # BUCKETS x languages
    trans: np.ndarray  # log scores of language after language
    lexicon: np.ndarray  # sorted word hashes, one for each language that has the word
    lexicon_of: np.ndarray  # that language


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of a-z and of the two-byte Latin letters from U+00C0 to U+00DE."""
    out = LOWER[data]
    if len(out) > 1:
        second = out[1:]
        second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def _words(data: np.ndarray, off: np.ndarray) -> Words:
    return words(_fold(data), off, LETTERS)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, model_lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): whole word, affixes of up to 4 bytes, n-grams of 2 and 3 bytes, lexicons; ordered by word."""
    n, size = len(start), end - start
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(start, size)
    data = data[place]  # only the words, one after another
    start, end = at[:-1], at[1:]
    every = np.arange(n)
    hs, ws = [hashes], [every]
    for k in (1, 2, 3, 4):
        ok = every[size >= k]
        hs += [span_hash(data, start[ok], start[ok] + k) ^ np.uint64(2 * k), span_hash(data, end[ok] - k, end[ok]) ^ np.uint64(2 * k + 1)]
        ws += [ok, ok]
    owner = np.repeat(every, size)
    for k in (2, 3):
        if len(data) >= k:
            s = np.arange(len(data) - k + 1)
            s = s[owner[: len(s)] == owner[k - 1 :]]
            hs.append(span_hash(data, s, s + k) ^ np.uint64(64 + k))
            ws.append(owner[s])
    known, of = model_lexicon
    if len(known):
        a, b = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
        times = b - a
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)
        hs.append((of[at].astype(np.uint64) + np.uint64(1)) << np.uint64(46))
        ws.append(np.repeat(every, times))
    h, w = np.concatenate(hs), np.concatenate(ws)
    order = np.argsort(w, kind="stable")
    return (h[order] >> np.uint64(46)).astype(np.int64), w[order]


def emissions(w: Words, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each distinct word, the place of each word among them)."""
    h, first, place = np.unique(w.hash, return_index=True, return_inverse=True)
    idx, of = features(w.data, w.start[first], w.end[first], h, (model.lexicon, model.lexicon_of))
    at = np.searchsorted(of, np.arange(len(h)))
    return np.add.reduceat(model.emit[idx], at, axis=0) if len(h) else np.zeros((0, len(model.langs)), np.float32), place


def marginals(score: np.ndarray, place: np.ndarray, size: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Each word's probability of each language; ``size``: words of each row, rows one after another.

    All rows step together, the longest first; a step costs what rows are
    still that long.
    """
    e = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    begin = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest + 1), "left")  # rows with more words than the step
    alpha = np.empty((len(place), score.shape[1]), e.dtype)
    for s in range(longest):
        at = begin[: active[s]] + s
        now = e[place[at]]
        if s:
            now = now * (last[: active[s]] @ t)
        now = now / now.sum(axis=1, keepdims=True)
        alpha[at] = last = now
    beta = np.ones((len(begin), score.shape[1]), e.dtype)
    for s in range(longest - 2, -1, -1):
        k = active[s + 1]
        at = begin[:k] + s
        b = (e[place[at + 1]] * beta[:k]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:k] = b
        alpha[at] *= b
    return alpha / alpha.sum(axis=1, keepdims=True)


def fit(sample: list[tuple[str, str]], seed: int = 5) -> Crf:
    """A model from (language, text) rows, in an order that does not depend on how they came."""
    langs = sorted({g for g, t in sample if t})
    n_lang = len(langs)
    if not langs:
        return Crf([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sample = sorted((g, t) for g, t in sample if t)
    data, off = texts(pa.array([t for _, t in sample], pa.string()))
    w = _words(data, off)
    lang_of = np.array([langs.index(g) for g, _ in sample])[w.row]
    vocab, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
    tops = []
    for g in range(n_lang):
        n = np.bincount(word[lang_of == g], minlength=len(vocab))
        top = np.argsort(-n, kind="stable")[:LEXICON]
        tops.append(top[n[top] > 1])
    owner, tops = np.repeat(np.arange(n_lang), [len(t) for t in tops]), np.concatenate(tops)
    order = np.argsort(tops, kind="stable")  # the vocabulary is sorted by hash
    lexicon = (vocab[tops[order]], owner[order])
    idx, of = features(w.data, w.start[first], w.end[first], vocab, lexicon)
    at = np.searchsorted(of, np.arange(len(vocab) + 1))
    emit, g2 = np.zeros((BUCKETS, n_lang), np.float32), np.full((BUCKETS, n_lang), 1e-2, np.float32)
    trans, t2 = np.zeros((n_lang, n_lang)), np.full((n_lang, n_lang), 1e-2)
    rng = np.random.default_rng(seed)
    by = [word[lang_of == g] for g in range(n_lang)]
    present = [g for g in range(n_lang) if len(by[g])]
    if not present:
        return Crf(langs, emit, trans, *lexicon)
    batch = 96
    steps = max(20, EPOCHS * len(word) // (LENGTH * batch))
    for _ in range(steps):
        x, y = np.empty((batch, LENGTH), np.int64), np.empty((batch, LENGTH), np.int64)
        for i in range(batch):
            cuts = np.sort(rng.integers(1, LENGTH, rng.integers(1, 3))) if rng.random() < SWITCHED else []
            for a, b in zip([0, *cuts], [*cuts, LENGTH], strict=True):
                g = present[rng.integers(len(present))]
                s = rng.integers(max(1, len(by[g]) - (b - a)))
                take = by[g][s : s + b - a]
                x[i, a:b], y[i, a:b] = np.resize(take, b - a), g
        used, place = np.unique(x.ravel(), return_inverse=True)
        count = at[used + 1] - at[used]
        local = np.repeat(np.arange(len(used)), count)
        f = idx[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[used], count)]
        score = np.add.reduceat(emit[f], np.cumsum(count) - count, axis=0)
        gamma, xi = _expected(score[place].reshape(batch, LENGTH, n_lang), trans)
        gold = np.zeros_like(gamma)
        np.put_along_axis(gold, y[..., None], 1.0, axis=2)
        d = (gold - gamma).reshape(-1, n_lang)
        dw = np.column_stack([np.bincount(place, weights=d[:, g], minlength=len(used)) for g in range(n_lang)])
        buckets, inv = np.unique(f, return_inverse=True)
        grad = np.column_stack([np.bincount(inv, weights=dw[local, g], minlength=len(buckets)) for g in range(n_lang)]) / batch - RIDGE * emit[buckets]
        g2[buckets] += grad**2
        emit[buckets] += RATE * grad / np.sqrt(g2[buckets]) * 0.5
        pairs = np.zeros_like(trans)
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        gt = (pairs - xi) / batch
        t2 += gt**2
        trans += RATE * gt / np.sqrt(t2)
    return Crf(langs, emit, trans, *lexicon)


def _expected(score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of equally long sequences (batch, length, languages) and expected counts of transitions."""
    e = np.exp(score - score.max(axis=2, keepdims=True))
    t = np.exp(trans)
    n = e.shape[1]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for s in range(1, n):
        a = (alpha[:, s - 1] @ t) * e[:, s]
        alpha[:, s] = a / a.sum(axis=1, keepdims=True)
    xi = np.zeros_like(trans)
    for s in range(n - 2, -1, -1):
        eb = e[:, s + 1] * beta[:, s + 1]
        pair = alpha[:, s][:, :, None] * t[None] * eb[:, None, :]
        xi += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = eb @ t.T
        beta[:, s] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=2, keepdims=True), xi


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = ROWS_PER_LANG, langs: int = MOST_LANGS, most_bytes: int = SAMPLE_BYTES) -> Crf:
    """A model from at most ``most`` ids of each language, a row each, those whose hash is smallest.

    Of more than ``langs`` languages those with the most rows are learned; of
    more than ``most_bytes`` of text, the rows of the smallest hashes.  Of
    several rows with an id and a language the first in the input's files
    counts; rows with a null id or language are left out.  Rows are counted
    and ranked map-side before they shuffle, so a language with most rows
    costs no more than any other.
    """
    plain, _, (t, g, i) = hide(docs, (), text_col, lang_col, id_col)
    rows = numbered(plain).select("_row", F.col(g).alias("g"), F.col(i).alias("id"), F.col(t).alias("text"))
    own = rows.filter(F.col("g").isNotNull() & F.col("id").isNotNull()).groupBy("g", "id").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("n"))
    own = write_table(own, "language-ids")
    chosen = own.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(langs).select("g")
    w = Window.partitionBy("g").orderBy(F.xxhash64("id"), "id")
    few = own.join(F.broadcast(chosen), "g", "left_semi").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    few = write_table(few.select("_row", "g", "_k"), "sampled")  # at most langs * most rows
    sample = write_table(rows.select("_row", "text").join(F.broadcast(few), "_row"), "sample")
    got = bounded(sample, langs * most, most_bytes, "_k", "g").select("g", "text").toArrow()
    drop_table(own, few, sample)
    return fit(list(zip(got.column("g").to_pylist(), got.column("text").to_pylist(), strict=True)))


def _has_letter(batch_text: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = LETTERS[data] & (data < 0x80)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~has & (off[1:] > off[:-1])):
        has[i] = any(map(str.isalpha, batch_text[int(i)].as_py()))
    return has


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score, the mean marginal of the language.

    Null and empty texts and texts without a letter are ``und`` with score 0,
    as all are where nothing was learned; equal texts get equal results; an
    empty table stays empty; columns of those names are replaced.
    """
    rows, hidden, (text_col,) = hide(docs, ("lang_pred", "score"), text_col)
    names = list(hidden)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language
    langs = [*model.langs, UNDETERMINED]

    def label(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in blocks(batches, text_col, CHUNK_BYTES):
            col = column(batch, text_col)
            data, off = texts(col)
            n = batch.num_rows
            best, mean = np.full(n, len(langs) - 1), np.zeros(n)
            if len(langs) > 1:
                w = _words(data, off)
                size = np.bincount(w.row, minlength=n)
                score, place = emissions(w, m)
                if len(place):
                    p = marginals(score, place, size, m.trans.astype(np.float32))
                    share = np.column_stack([np.bincount(w.row, weights=p[:, g], minlength=n) for g in range(p.shape[1])]) / np.maximum(1, size)[:, None]
                    ok = _has_letter(col, data, off) & (size > 0)
                    best[ok] = share[ok].argmax(axis=1)
                    mean[ok] = share[ok].max(axis=1)
            names_of = pa.DictionaryArray.from_arrays(pa.array(best, pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), names_of, pa.array(np.clip(mean, 0, 1))], [*names, "lang_pred", "score"])

    schema = rows.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(label, schema).select(*shown(hidden), "lang_pred", "score")


def word_languages(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, lang, score) of each word, places in UTF-8 bytes.

    Null and empty texts and texts without words give no rows, as an empty
    table and a model that learned nothing; a null id stays null; rows that
    repeat an id all count; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = model.langs

    def label(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in blocks(batches, "text"):
            data, off = texts(column(batch, "text"))
            w = _words(data, off)
            if not len(w.hash) or not langs:
                continue
            p = marginals(*emissions(w, m), np.bincount(w.row, minlength=batch.num_rows), m.trans.astype(np.float32))
            best = pa.DictionaryArray.from_arrays(pa.array(p.argmax(axis=1), pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(w.row)), pa.array(w.start - off[w.row]), pa.array(w.end - off[w.row]), best, pa.array(p.max(axis=1).astype(float))], ["id", "start", "end", "lang", "score"])

    plain, _, (i, t) = hide(docs, (), id_col, text_col)
    rows = plain.select(F.col(i).alias("id"), F.col(t).alias("text"))
    return rows.mapInArrow(label, f"id {rows.schema['id'].dataType.simpleString()}, start long, end long, lang string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of ``documents``, as ``identify`` gives them; two thirds by id's hash are learned from."""
    docs = table(spark, sf_dir, "documents")
    out_of = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~out_of))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out_of.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
