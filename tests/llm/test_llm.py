"""Operators against brute force, on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat_format, decontaminate, exact_dedup, language_id, near_dedup, quality, sentencepiece_sampling, substring_dedup, token_counts, toxicity
from tidemill.llm import components as graph
from tidemill.llm.vectors import NOT_SPACE, mix, texts, words

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, kept boolean, keep_id long, _row int, h int, doc int, score string, n_words int, `a.b` int"


def file_frame(spark, tmp_path, data, schema="doc_id long, text string"):
    spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def odd_docs(spark, tmp_path):
    """Null and empty texts, null ids, repeats, a long text, and columns with the operators' own names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    body = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one two"), (6, "One  two"), (6, "One  two"), (None, "one two"), (None, None), (7, long), (8, long + " "), (9, "é ÇA \U0001f600 !!"), (10, "x" * 20_000)]
    data = [(i, t, None, True, 7, 1, 2, 3, "s", 5, 6) for i, t in body]
    return file_frame(spark, tmp_path, data, CLASH), body


def words_of(t, sep=r"[^\x20\x09-\x0D]+"):
    return re.findall(sep, "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))


# vectors
def test_words_are_what_a_pattern_finds():
    ts = [None, "", "  a\tBc\n", "ç é", "x" * 50, "a b a", " "]
    data, off = texts(pa.array(ts, pa.string()))
    w = words(data, off, NOT_SPACE)
    got = defaultdict(list)
    for r, s, e in zip(w.row, w.start, w.end):
        got[int(r)].append(bytes(w.data[s:e]).decode())
    assert [got[i] for i in range(len(ts))] == [words_of(t) for t in ts]
    by = defaultdict(set)
    for h, s, e in zip(w.hash, w.start, w.end):
        by[int(h)].add(bytes(w.data[s:e]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({x for g in got.values() for x in g})


# 5 exact dedup
def brute_exact(body):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in body]
    groups = defaultdict(list)
    for k, n in enumerate(norm):
        groups[n].append(k)
    out = []
    for k, (i, _) in enumerate(body):
        g = groups[norm[k]]
        best = min(g, key=lambda j: (-len(body[j][1] or ""), body[j][0] is None, body[j][0] or 0))
        out.append((i, body[best][0], len(g), hashlib.sha256(norm[k].encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [exact_dedup.MAX_FILTER_BYTES, 0])
def test_exact_dedup(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "MAX_FILTER_BYTES", limit)
    docs, body = odd_docs(spark, tmp_path)
    out = exact_dedup.exact_dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"group_size", "text_sha256"}
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_exact(body), key=repr)
    assert out.filter("kept").count() == len({x[3] for x in got})
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({x[3] for x in got})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_of_one_large_group(spark, tmp_path):
    docs = file_frame(spark, tmp_path, [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    out = exact_dedup.exact_dedup(docs)
    assert out.filter("group_size = 1000").count() == 1000 and out.filter("kept").count() == 2001


# 1 decontamination
ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(docs, items):
    win = defaultdict(set)
    for i, t in items:
        w = words_of(t, ITEM)
        for k in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[k : k + 10])].add(str(i))
    out = []
    for i, t in docs:
        w = words_of(t, ITEM)
        hit, ids = set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if x := win.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= x
        out.append((i, len(w), len(hit), ",".join(sorted(ids))))
    return sorted(out, key=repr)


def test_decontaminate(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["the", "of", "Éa", "éa", "zq", "K", "x9", "rare1", "rare2", "ha"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(1, docs[3][1]), (2, "The  OF, the"), (3, None), (4, ""), (5, "!!!"), (6, docs[3][1].upper()), (7, "nowhere to be found"), (8, "ha"), (9, docs[7][1] + " tail zq")]
    docs += [(100, None), (101, ""), (3, docs[5][1]), (102, "ha " * 300), (None, docs[3][1])]
    d = file_frame(spark, tmp_path, [(i, t, 1, 2, "p", "q") for i, t in docs], "doc_id long, text string, h int, doc int, hits string, cands string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()), key=repr) == brute_hits(docs, items)
    clean = decontaminate.drop_contaminated(d, b)
    assert clean.columns == d.columns and clean.count() == got.filter("n_hit = 0").count()
    assert decontaminate.decontaminate(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_words_of_all_characters_and_their_cost(spark):
    line = " ".join(f"{chr(c)}a{chr(c)}B{chr(c)}" for c in [*range(1, 0xD800, 7), *range(0x180), *range(0xE000, 0x110000, 997), 0x212A, 0x10FFFF])
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    df = spark.createDataFrame([(line,)], "text string").select(decontaminate.words(F.col("text")), F.size(decontaminate._raw_words(F.col("text")))).first()
    assert df[0] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) and df[1] == len(df[0])
    text, took = F.repeat(F.concat(F.lit("Many words, some of THEM long; "), F.col("id").cast("string")), 200), {}
    for name, pattern in (("one range", "[a-z]+"), ("words", decontaminate._WORD_ANY_CASE)):
        for _ in range(3):
            began = time.perf_counter()
            spark.range(0, 2000, 1, 1).select(F.sum(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))).collect()
            took[name] = min(took.get(name, 99.0), time.perf_counter() - began)
    assert took["words"] < 4 * took["one range"]


def test_decontaminate_without_broadcasts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_ROWS", 0)
    docs = [(1, "a b c d e f g h i j k"), (2, "c d e f g h i j k l"), (3, "a b")]
    d, b = file_frame(spark, tmp_path, docs), spark.createDataFrame([(1, docs[0][1])], "item_id long, text string")
    got = decontaminate.decontaminate(d, b)
    assert sorted((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()) == brute_hits(docs, [(1, docs[0][1])])


def test_proximity(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(30))) for i in range(40)]
    items = [(1, "a b c"), (2, "g"), (3, "f e d c"), (4, ""), (5, "zz a")]
    for slop in (3, 5):
        want = set()
        for (i, t), (j, q) in itertools.product(docs, items):
            w, need = t.split(), set(q.split())
            if need and any(need <= set(w[k : k + slop]) for k in range(len(w))):
                want.add((i, j))
        got = decontaminate.proximity_matches(file_frame(spark, tmp_path, docs), spark.createDataFrame(items, "item_id long, text string"), slop)
        assert {tuple(r) for r in got.collect()} == want


# 4 near dedup
def brute_near(docs, width, percent=80):
    sets = {}
    for i, t in docs:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def near_docs():
    rng = random.Random(11)
    docs = []
    for g in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 9, 40])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
            docs.append((len(docs), " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "solo"), (903, "Solo"), (904, "a b"), (905, "a  b ")]


@pytest.mark.parametrize("width, tile, rows", [(2, 512, 4096), (5, 512, 4096), (2, 8, 6)])
def test_near_groups(spark, tmp_path, monkeypatch, width, tile, rows):
    monkeypatch.setattr(near_dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(near_dedup, "LIST_ROWS", rows)
    docs = near_docs()
    d = file_frame(spark, tmp_path, docs)
    got = near_dedup.near_groups(d, near_dedup.Setup(width=width))
    want = brute_near(docs, width)
    assert sorted((r.id, r.n, r.component) for r in got.collect()) == want
    kept = near_dedup.near_dedup(d, near_dedup.Setup(width=width))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in want if i == c)


def test_near_dedup_edges(spark, tmp_path):
    docs, body = odd_docs(spark, tmp_path)
    got = {(r.id, r.n, r.component) for r in near_dedup.near_groups(docs).collect()}
    assert (1, 0, 1) in got and (None, 1, 5) in got and (6, 1, 5) in got and (None, 0, None) in got and (4, 1, 4) in got
    assert (8, next(n for i, n, _ in got if i == 7), 7) in got
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, None, 7, 9, 10])
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_near_dedup_of_repeated_and_null_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    body = [(1, a), (1, b), (2, b + " more"), (3, c), (None, d), (None, d + " more"), (None, d)]
    spark.createDataFrame(body, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "ids"))
    docs = spark.read.parquet(str(tmp_path / "ids"))
    got = sorted(((r.id, r.component) for r in near_dedup.near_groups(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (None, None), (None, None), (None, None)], key=repr)
    kept = [tuple(r) for r in near_dedup.near_dedup(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (1, b), (3, c), (None, d)], key=repr)


def test_thresholds():
    s = near_dedup.Setup()
    assert 28 <= s.matches <= 36 and s.prefix == 64 - s.matches + 1
    assert near_dedup.Setup(percent=100).matches == 64


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((40, 30), (60, 90), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)]
        label = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(200):
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
        got = graph.components(spark.createDataFrame(edges, "a long, b long"))
        assert {tuple(r) for r in got.collect()} == set(label.items())
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 substring dedup
def test_compact_windows_partition_all_subsequences():
    rng = np.random.default_rng(1)
    for n, least in ((1, 1), (30, 1), (60, 7), (5, 9)):
        v = (rng.integers(0, 1 << 39, n, dtype=np.uint64) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        lo, c, hi = substring_dedup.compact_windows(v, np.array([0, n // 3, n // 3, n]), least)
        for a, b in ((0, n // 3), (n // 3, n)):
            for i in range(a, b):
                for j in range(i + least, b + 1):
                    m = i + int(np.argmin(v[i:j]))
                    own = [(x, y, z) for x, y, z in zip(lo, c, hi) if x <= i and j <= z and i <= y < j]
                    assert len(own) == 1 and own[0][1] == m


def test_windows_of_texts_that_repeat_themselves(spark, tmp_path):
    """No step for each repeat; windows at one distance are joined to one row."""
    n, least = 1 << 14, 46
    v, calls = np.arange(n, dtype=np.uint64), []
    trace = lambda frame, event, arg: calls.append(event) if event == "c_call" else None
    sys.setprofile(trace)
    try:
        lo, c, hi = substring_dedup.compact_windows(v, np.array([0, n]), least)
    finally:
        sys.setprofile(None)
    assert len(calls) < n // 4
    assert lo.tolist() == c.tolist() == list(range(n - least + 1)) and set(hi.tolist()) == {n}
    s = substring_dedup.Setup()
    rows = spark.createDataFrame([(0, "la " * 300), (1, "la " * 200)], "row long, text string")
    joined = substring_dedup.join_windows(substring_dedup.post_windows(rows, s).selectExpr("*", "-1L as tile"), s).filter("kind = 0").collect()
    assert joined and len({(r["key"], r["a"], r["b"], r["a_from"] - r["b_from"]) for r in joined}) == len(joined)


def test_repeated_passages(spark, tmp_path):
    rng = random.Random(9)
    say = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    shared, near = say(70), say(120)
    changed = [w if k % 60 else "new" for k, w in enumerate(near)]
    docs = [(i, " ".join(say(80) + shared + say(90))) for i in range(30)]
    docs += [(100, " ".join(say(60) + near + say(60))), (101, " ".join(say(33) + changed))]
    docs += [(200 + i, " ".join(say(150))) for i in range(30)] + [(300, None), (301, ""), (302, " ".join(shared[:40])), (303, "For " * 200), (304, "For " * 90)]
    got = [tuple(r) for r in substring_dedup.repeated_passages(file_frame(spark, tmp_path, docs)).collect()]
    text = {i: words_of(t) for i, t in docs}
    for i, f, t, j, g, h in got:
        a, b = text[i][f : t + 1], text[j][g : h + 1]
        one, two = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert len(a) >= 50 and len(b) >= 50 and len(one & two) >= 0.8 * len(one | two)
    linked = {frozenset((i, j)) for i, _, _, j, _, _ in got}
    assert {x for p in linked for x in p} == {*range(30), 100, 101, 303, 304}
    assert frozenset((100, 101)) in linked and frozenset((303, 304)) in linked
    spans = [(f, t) for i, f, t, *_ in got if i < 30]
    assert len(spans) >= 29 and all(abs(f - 80) <= 12 and abs(t - 149) <= 12 for f, t in spans)
    assert substring_dedup.repeated_passages(file_frame(spark, tmp_path, docs[:1])).count() == 0


def test_passages_behind_cut_versions(spark, tmp_path):
    """Earlier documents hold cut and edited versions, alike with nothing, of what later ones share."""
    rng = random.Random(4)
    say = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    docs, pairs = [], []
    for g in range(20):
        p = say(60)
        edited = [w if k % 7 else "new" for k, w in enumerate(p)]
        cuts = (p[:40], p[20:], p[10:50], edited)
        docs += [(1000 + 10 * g + k, " ".join(say(50) + c + say(50))) for k, c in enumerate(cuts)]
        pairs.append((2000 + 10 * g, 2001 + 10 * g, 2002 + 10 * g))
        changed = [w if k != 30 else "other" for k, w in enumerate(p)]
        docs += [(i, " ".join(say(50) + q + say(50))) for i, q in zip(pairs[-1], (p, p, changed), strict=True)]
    spark.createDataFrame(sorted(docs), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in_order"))
    got = substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / "in_order"))).collect()
    linked = defaultdict(set)
    for r in got:
        linked[r["id"]].add(r["other_id"])
    for a, b, c in pairs:
        assert a in linked[b] and linked[c] & {a, b}
    assert {x for x in linked} == {x for p in pairs for x in p[1:]}


@pytest.mark.parametrize("changed", [(2,), (47,), (0,), (1, 48)])
def test_passages_with_changed_words_at_their_ends(changed):
    s = substring_dedup.Setup()
    one = [f"w{k}" for k in range(50)]
    two = [w if k not in changed else f"new{k}" for k, w in enumerate(one)]
    x, y = (substring_dedup._shingles(*texts(pa.array([" ".join(w)])), s.width)[0] for w in (one, two))
    alike = 100 * len({*x} & {*y}) >= s.percent * len({*x} | {*y})
    assert substring_dedup.passages(x, y, (0, 45, 0, 45), [0], s) == ([(0, 45, 0, 45)] if alike else [])
    assert substring_dedup.passages(x, y, (0, 45, 0, 45), [], s) == ([(0, 45, 0, 45)] if alike else [])


def test_classes_with_partners_of_their_own_are_linked(spark, tmp_path):
    rng, docs, links = random.Random(7), [], []
    for c in range(60):  # each version is alike with the next one only
        chain = [[f"c{c}w{i}" for i in range(50)]]
        for k in range(5):
            chain.append(list(chain[-1]))
            chain[-1][rng.randrange(6, 44)] = f"c{c}n{k}"
        docs += [(c * 10 + k, " ".join(x)) for k, x in enumerate(chain)]
        links += [(c * 10 + k, c * 10 + k + 1) for k in range(5)]
    rng.shuffle(docs)
    got = substring_dedup.repeated_passages(file_frame(spark, tmp_path, docs), substring_dedup.Setup(meet=2)).collect()
    root = list(range(600))
    p, q = (np.array(x) for x in zip(*((r["id"], r["other_id"]) for r in got), strict=True))
    substring_dedup.forest(root, p, q)
    p, q = (np.array(x) for x in zip(*links, strict=True))
    assert not len(substring_dedup.forest(root, p, q))


def test_pairs_that_may_be_alike_are_given_beside_a_failing_one():
    s, rng = substring_dedup.Setup(), np.random.default_rng(3)
    x = rng.integers(1, 1 << 32, 91, dtype=np.uint32)
    y = np.concatenate([x[:40], rng.integers(1, 1 << 32, 1, dtype=np.uint32), x[40:90]])  # one shingle more: at no place the same on both sides
    y[45] = x[45]
    near = np.array([x, y, np.where(np.arange(91) == 3, 7, y)], np.uint32)
    pairs = substring_dedup.pairs_of_list(near, np.zeros(3, int), np.arange(3), np.arange(3), lambda p, q: np.arange(len(p)), s)
    assert {frozenset(x) for p, q in pairs for x in zip(p.tolist(), q.tolist(), strict=True)} >= {frozenset((1, 2))}
    assert substring_dedup.sure_passages(near[[1, 1]], near[[2, 1]], s).all()
    few = x.copy()
    few[[20, 25, 30, 50, 60, 70, 80]] = np.arange(1, 8)
    brute = [any(len(a & b) * 100 >= 80 * len(a | b) for i in range(46) for a, b in [(set(x[i : i + 46]), set(few[i : i + 46]))])]
    assert substring_dedup.sure_passages(x[None], few[None], s).tolist() == brute


def test_a_shingle_that_repeats_itself_counts_once():
    """Texts of repeated words, as junk is: all windows of alike passages are given, few others."""
    s, rng = substring_dedup.Setup(words=12, width=3), random.Random(11)
    k = s.least
    given = alike = tried = 0
    for _ in range(12):
        docs = []
        for _ in range(6):
            x = [n + 1 for n in rng.sample(range(9), 3) for _ in range(rng.choice((3, 4, 14)))]
            x[len(x) // 2] = 1
            docs.append(np.array(x, np.uint32) * np.uint32(0x10624DD3) | np.uint32(1))
        at = np.array([len(x) // 2 for x in docs])
        right = np.array([len(x) for x in docs]) - 1 - at
        flat, first = np.concatenate(docs), np.cumsum([0, *map(len, docs[:-1])])
        step = np.arange(1 - k, k)
        near = flat[np.clip((first + at)[:, None] + step, 0, len(flat) - 1)]
        near[(step < -at[:, None]) | (step > right[:, None])] = 0
        far = substring_dedup.beyond(flat, first + at, at, right, near, k - 1)
        n = len(docs)
        pairs = substring_dedup.like_surroundings(near, far, np.zeros(n, int), np.arange(n), np.ones(n, bool), np.arange(n), lambda p, q: np.arange(len(p)), s)
        got = {x for p, q in pairs for x in zip(p.tolist(), q.tolist(), strict=True)}
        runs = [{frozenset(x[f:t].tolist()) for f in range(c + 1) for t in range(max(c + 1, f + k), len(x) + 1)} for x, c in zip(docs, at, strict=True)]
        fits = [(i, j) for i in range(n) for j in range(i) if min(at[i], at[j]) + min(right[i], right[j]) + 1 >= k]
        want = {(j, i) for i, j in fits if any(100 * len(a & b) >= s.percent * len(a | b) for a in runs[i] for b in runs[j])}
        assert got >= want
        given, alike, tried = given + len(got & {(j, i) for i, j in fits}), alike + len(want), tried + len(fits)
    assert alike >= 10 and given <= alike + tried // 10


def test_one_function_that_joins_is_enough(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    s, docs = substring_dedup.Setup(hashes=2), []
    assert s.miss == pytest.approx(0.04) and substring_dedup.Setup().miss == pytest.approx(6.4e-5)
    for g in range(100):
        p = say(50)
        docs += [(2 * g, " ".join(say(30) + p + say(30))), (2 * g + 1, " ".join(say(30) + [w if k != 25 else "new" for k, w in enumerate(p)] + say(30)))]
    linked = {frozenset((r["id"], r["other_id"])) for r in substring_dedup.repeated_passages(file_frame(spark, tmp_path, docs), s).collect()}
    assert linked <= {frozenset((2 * g, 2 * g + 1)) for g in range(100)} and len(linked) >= 90


# 2 SentencePiece
TOY = [b"a", b"b", b"ab", b"ba", b" ", b" a", b"aa"]


def toy():
    spelled = TOY + [bytes([i]) for i in range(256)]
    return sentencepiece_sampling.make_pieces(spelled, {x: i for i, x in enumerate(TOY)}, np.arange(len(TOY), len(TOY) + 256))


def segmentations(p, t):
    if not t:
        return [((), 0.0)]
    return [((i, *r), p.logp[i] + s) for i, x in enumerate(TOY) if t.startswith(x) for r, s in segmentations(p, t[len(x) :])]


def test_draws_are_without_replacement_and_fair():
    p, n, t = toy(), 6000, "aab ab"
    every = segmentations(p, t.encode())
    z = np.log(sum(np.exp(s) for _, s in every))
    prob = {k: float(np.exp(s - z)) for k, s in every}
    data, off = texts(pa.array([t] * n))
    lat = sentencepiece_sampling.Lattices(p)
    draws = sentencepiece_sampling.sample_block(lat, data, off, mix(np.arange(n, dtype=np.uint64) * np.uint64(77)), 3)
    first, pair, total = Counter(), Counter(), Counter()
    for d in draws:
        ids = [tuple(sentencepiece_sampling.piece_ids(lat, x.edges, data[: off[1]]).tolist()) for x in d]
        assert len(set(ids)) == 3
        first[ids[0]] += 1
        pair[ids[0], ids[1]] += 1
        for x, i in zip(d, ids):
            assert abs(x.logp - np.log(prob[i])) < 1e-9
            total[i] += 1 / x.inclusion
    assert max(abs(first[k] / n - v) for k, v in prob.items()) < 0.03
    assert max(abs(pair[a, b] / n - prob[a] * prob[b] / (1 - prob[a])) for a in prob for b in prob if a != b) < 0.03
    assert abs(sum(total[k] * v for k, v in {k: 1 for k in prob}.items()) / n - sum(1 for _ in prob)) < 2.5  # each counts 1 on average


def test_pieces_of_several_spaces_are_drawn():
    spelled = [b"", b"a", b" ", b" a", b"  ", b"   ", b"  a"]
    p = sentencepiece_sampling.make_pieces(spelled, {w: i for i, w in enumerate(spelled) if w}, np.full(256, sentencepiece_sampling.NONE, np.int64))
    for text in (b"a   a", b"  a  ", b"a a"):
        ways = [1]
        for e in range(1, len(text) + 1):
            ways.append(sum(ways[e - len(w)] for w in spelled if w and text[:e].endswith(w)))
        data = np.frombuffer(text, np.uint8)
        draws = sentencepiece_sampling.sample_block(sentencepiece_sampling.Lattices(p), data, np.array([0, len(data)]), np.array([5], np.uint64), 40)[0]
        assert len(draws) == ways[-1]
    real = sentencepiece_sampling.load_pieces()
    spaces = {i for i, x in enumerate(real.spelled) if b" " in x[1:]}
    assert spaces and spaces <= set(real.piece_of.tolist())


def test_pieces_with_a_space_inside_are_drawn(tmp_path):
    spelled = [b"", b"a", b" ", b"b", b"a b", b"b ", b" a", b"b  a b"]
    p = sentencepiece_sampling.make_pieces(spelled, {w: i for i, w in enumerate(spelled) if w}, np.full(256, sentencepiece_sampling.NONE, np.int64))
    lines = [b"a", b" ba b  a b", b"", b"b a a b", b"ab b", b" b"]
    data, off = np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)])
    draws = sentencepiece_sampling.sample_block(sentencepiece_sampling.Lattices(p), data, off, np.arange(len(lines), dtype=np.uint64), 200)
    for text, drawn in zip(lines, draws, strict=True):
        ways = [1]
        for e in range(1, len(text) + 1):
            ways.append(sum(ways[e - len(w)] for w in spelled if w and text[:e].endswith(w)))
        assert len(drawn) == ways[-1] and abs(sum(np.exp(d.logp) for d in drawn) - 1) < 1e-9
    import sentencepiece

    (tmp_path / "text").write_text("the man of the house and the man of the hill\n" * 50)
    sentencepiece.SentencePieceTrainer.train(input=str(tmp_path / "text"), model_prefix=str(tmp_path / "m"), model_type="bpe", vocab_size=300, byte_fallback=True, split_by_whitespace=False, hard_vocab_limit=False, minloglevel=2)
    real = sentencepiece_sampling.load_pieces(str(tmp_path / "m.model"))
    inner = {i for i, x in enumerate(real.spelled) if b" " in x.lstrip(b" ")}
    assert inner and inner <= set(real.piece_of.tolist())


def test_encode_and_decode(spark, tmp_path):
    docs, body = odd_docs(spark, tmp_path)
    pieces = sentencepiece_sampling.load_pieces()
    enc = sentencepiece_sampling.encode(docs.filter("doc_id <> 7 and doc_id <> 8"), pieces, 3)
    dec = sentencepiece_sampling.decode(enc, pieces).collect()
    want = {i: t or "" for i, t in body}
    assert all(r.text == want[r.doc_id if "doc_id" in r else r.id] for r in dec)
    by = defaultdict(list)
    for r in dec:
        by[r.id].append((r.sample, tuple(r.ids)))
    assert by[1] == [(0, ())] and len({x for _, x in by[5]}) == 3
    again = sentencepiece_sampling.encode(docs.filter("doc_id <> 7 and doc_id <> 8").repartition(3), pieces, 3)
    key = lambda df: sorted(((r.id, r.sample, tuple(r.ids)) for r in df.collect()), key=repr)
    assert key(again) == key(enc)
    assert sentencepiece_sampling.encode(docs.limit(0), pieces).count() == 0


def test_whole_table_round_trips(spark):
    out = sentencepiece_sampling.op2_sentencepiece(spark, SF)
    assert out.filter("not round_trip").count() == 0
    assert out.select("doc_id").distinct().count() == 200
    assert out.groupBy("doc_id").agg(F.count_distinct("ids_sha256").alias("d"), F.count("*").alias("n")).filter("d <> n").count() == 0


# 6 chat formatting
def test_chat_template_is_reversible():
    rng = random.Random(1)
    for _ in range(300):
        turns = [("".join(rng.choice("\\#<:/ax\n ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("\\#<:/>turn\n ") for _ in range(rng.randint(0, 30)))) for _ in range(rng.randint(0, 5))]
        text = "".join(f"### {chat_format.escape_role(r)}: {chat_format.escape(t)}</turn>\n" for r, t in turns)
        assert chat_format.read_turns(text) == turns


def test_chat_examples(spark):
    rows = [(1, 2, "assistant", "B"), (1, 1, "user", "A"), (1, 3, "user", None), (2, 1, "user", "only"), (3, 1, "assistant", ""), (3, 2, "assistant", "x"), (3, 2, "assistant", "x"), (None, None, None, None)]
    ex = chat_format.format_chats(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, example int"))
    got = defaultdict(list)
    for r in ex.collect():
        got[r.conv_id].append((r.example, chat_format.read_turns(r.text), r.text[r.loss_start : r.loss_end] if r.loss_start >= 0 else None))
    assert got[1] == [(0, [("user", "A"), ("assistant", "B")], "B"), (1, [("user", "A"), ("assistant", "B"), ("user", "")], None)]
    assert got[2] == [(0, [("user", "only")], None)]
    assert [x[2] for x in got[3]] == ["", "x", "x"] and len(got[3][2][1]) == 3
    assert got[None] == [(0, [("", "")], None)]
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 8 token counts
def greedy(pieces, w):
    n = i = 0
    while i < len(w):
        j = next((j for j in range(len(w), i, -1) if w[i:j] in pieces), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_longest_match_counts():
    rng = random.Random(4)
    for k in range(150):
        pieces = {bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        if k % 2:
            pieces |= {b"a", b"b", b"c", b" "}
        ws = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(15)]
        end = np.cumsum([len(w) for w in ws])
        got = token_counts.lengths(token_counts.build(sorted(pieces)), np.frombuffer(b"".join(ws), np.uint8), end - [len(w) for w in ws], end, b" ")
        assert got.tolist() == [greedy(pieces, b" " + w) for w in ws]


def test_count_tokens(spark, tmp_path):
    docs, body = odd_docs(spark, tmp_path)
    vocab = token_counts.vocabulary()
    pieces = set(vocab)
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, vocab).collect()}
    want = {(i, len((t or "").split()), sum(greedy(pieces, b" " + w.encode()) for w in (t or "").split())) for i, t in body if i not in (7, 8)}
    assert want <= got and token_counts.count_tokens(docs.limit(0), vocab).count() == 0


# 7, 9 classifiers
def accuracy(spark, out, label):
    x = out.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    return (x.predicted == x[label]).mean()


def test_quality_held_out(spark):
    out = quality.op9_quality(spark, SF.replace("0.001", "0.01")).persist()
    assert out.count() == 1000 and out.filter("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(spark, out, "quality") > 0.9


def test_toxicity_held_out(spark):
    out = toxicity.op7_toxicity(spark, SF.replace("0.001", "0.01")).persist()
    assert out.count() == 1000 and out.filter("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(spark, out, "toxic") > 0.85


def test_classifiers_on_odd_input(spark, tmp_path):
    docs, body = odd_docs(spark, tmp_path)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, None), (4, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for out in (quality.score_quality(docs, quality.train(docs, labels)), toxicity.score_toxicity(docs, toxicity.train(docs, labels))):
            r = out.collect()
            assert len(r) == len(body) and all(0 <= x.score <= 1 for x in r) and set(out.columns) == set(docs.columns)
    assert quality.score_quality(docs.limit(0), quality.train(docs, none)).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    y = (np.arange(200) % 2).astype(np.int64)
    x = np.stack([np.where(y == 1, 5, 9), rng.integers(20, 60, 200)], 1).ravel()
    w = quality.dual_coordinate_descent(y, np.arange(0, 401, 2), x, np.ones(400))
    assert w[5] > 0.5 and w[9] < -0.5


def test_counterfactuals_lower_the_weight_of_group_names():
    assert toxicity.swapped("Muslim women, and MEN") == "Christian men, and Women" and toxicity.swapped("nothing here") is None and toxicity.swapped(None) is None
    names = ["the muslim baker smiled", "a muslim doctor read", "the christian baker smiled", "a christian doctor read"]
    bad = [f"{n} muslim idiot" for n in names] * 12
    good = [f"{n.replace('muslim', 'christian')} today" for n in names] * 12
    rows = [(1, t) for t in bad] + [(0, t) for t in good]
    random.Random(1).shuffle(rows)
    y = np.array([v for v, _ in rows])

    def csr(ts):
        idx, row = toxicity.indicators(*texts(pa.array(ts, pa.string())))
        return np.searchsorted(row, np.arange(len(ts) + 1)), idx

    at, x = csr([t for _, t in rows])
    twins = [toxicity.swapped(t) for _, t in rows]
    of = np.array([i for i, t in enumerate(twins) if t])
    t_at, t_x = csr([t for t in twins if t])
    gap = []
    for penalty in (0.0, 3.0):
        w, a, b = toxicity.fit(y, at, x, of, t_at, t_x, penalty)
        p_at, p_x = csr(["a muslim walked", "a christian walked"])
        gap.append(abs(w[p_x[: p_at[1]]].sum() - w[p_x[p_at[1] :]].sum()))
    assert gap[1] < 0.5 * gap[0]


# 10 language identification
def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    score, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    place, size = np.array([0, 1, 2, 3, 4, 5, 6, 2, 1]), np.array([4, 0, 1, 4])
    got = language_id.marginals(score, place, size, trans)
    at = 0
    for n in size:
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = sum(score[place[at + k], g] for k, g in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            for k, g in enumerate(path):
                p[k, g] += np.exp(s)
        if n:
            assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


def test_language_held_out_and_code_switching(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.9
    model = language_id.train(docs)
    mixed = "the and that with for was " * 3 + "der die und das nicht ist " * 3
    got = language_id.word_languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("start").collect()
    assert [r.lang for r in got[2:16]] == ["en"] * 14 and [r.lang for r in got[20:]] == ["de"] * 16


def test_language_of_odd_input(spark, tmp_path):
    docs, body = odd_docs(spark, tmp_path)
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs.filter("doc_id is not null"), model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[9] != "und" and got[5] != "und"
    signs = spark.createDataFrame([(1, "\u2014 \U0001f600 12"), (2, "\u4f60")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.identify(signs, model).collect()} == {1: True, 2: False}
    nothing = language_id.train(docs)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
