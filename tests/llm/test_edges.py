"""Bounds that hold, names of any kind, brute-force optima, and the pipeline as a whole."""

import random
import types
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import chat_format, decontaminate, exact_dedup, language_id, linear, near_dedup, quality, sentencepiece_sampling, shared, substring_dedup, token_counts, toxicity
from tidemill.llm.vectors import texts

from .test_llm import brute_exact, brute_hits, brute_near, file_frame, words_of


# names and folders
ODD = "DOC_ID long, Score string, HITS string, Kept int, SCORE_ int, N_TOKENS int, LANG_PRED string, N_HIT int, Row int, Tile int, `a.b` int, KEEP_ID long"


def odd_names(spark, tmp_path):
    rows = [(i, t, "h", 1, 2, 3, "l", 4, 5, 6, 7, 8) for i, t in [(1, "one two three"), (2, "one  two three"), (3, None), (4, ""), (None, "a b"), (1, "x y z")]]
    return file_frame(spark, tmp_path, rows, ODD)


def test_every_operator_takes_columns_named_like_its_own(spark, tmp_path):
    """The text column is called Score, ids DOC_ID; other columns clash with outputs but for their case."""
    d = odd_names(spark, tmp_path)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    names = {"id_col": "doc_id", "text_col": "score"}
    fold = lambda df: [c.lower() for c in df.columns]
    out = decontaminate.decontaminate(d, items, **names)
    assert fold(out).count("hits") == 1 and sorted(r["n_hit"] for r in out.collect()) == [0, 0, 0, 0, 3, 3]
    assert decontaminate.drop_contaminated(d, items, **names).columns == d.columns
    out = exact_dedup.exact_dedup(d, **names)
    assert fold(out).count("kept") == 1 and fold(out).count("keep_id") == 1 and out.count() == 6
    assert exact_dedup.drop_copies(d, **names).columns == d.columns and exact_dedup.drop_copies(d, **names).count() == 4
    assert near_dedup.near_dedup(d, **names).columns == d.columns
    assert decontaminate.proximity_matches(d, items, 4, **names).count() == 2
    assert substring_dedup.repeated_passages(d, **names).count() == 0
    assert sentencepiece_sampling.encode(d, sentencepiece_sampling.load_pieces(), 1, **names).count() == 6
    assert sorted(r["n_tokens"] > 0 for r in token_counts.count_tokens(d, token_counts.vocabulary(), text_col="SCORE").collect()) == [False, False, True, True, True, True]
    model = (np.zeros(linear.BUCKETS), 1.0, 0.0)
    for score in (quality.score_quality, lambda *a: toxicity.score_toxicity(a[0], toxicity.Model(*model, 0, 0), a[2])):
        out = score(d, model, "score")
        assert fold(out).count("score") == 1 and {r["score"] for r in out.collect()} == {0.5}
    crf = language_id.fit([("en", "one two three and the of " * 9), ("de", "eins zwei drei und der die " * 9)])
    out = language_id.identify(d, crf, "score")
    assert fold(out).count("lang_pred") == 1 and fold(out).count("score") == 1 and out.count() == 6
    assert language_id.word_languages(d, crf, **names).count() == 11
    with pytest.raises(ValueError, match="no column"):
        near_dedup.near_dedup(d, text_col="none")


def test_without_a_shared_folder_only_local_runs_go_on(spark):
    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

        def set(self, k, v):
            self[k] = v

    def session(master):
        return types.SimpleNamespace(conf=Conf(), sparkContext=types.SimpleNamespace(master=master))

    assert shared.shared_dir(session("local[4]")) and shared.shared_dir(session("local"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(session(master))


def test_tables_are_dropped(spark, tmp_path):
    t = shared.write_table(spark.range(5), "gone")
    assert t.count() == 5
    shared.drop_table(t)
    with pytest.raises(Exception):
        spark.read.parquet(t.written_at).count()


@pytest.mark.parametrize("limit", [shared.MAX_BITMAP_BYTES, 0])
def test_marked_rows(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(shared, "MAX_BITMAP_BYTES", limit)
    rows = shared.numbered(file_frame(spark, tmp_path, [(i, "t") for i in range(900)]))
    some = rows.filter(F.col("doc_id") % 7 == 0).select("_row")
    out = shared.marked(rows, some.unionByName(some), "in")
    assert out.count() == 900 and {r.doc_id for r in out.filter("in").collect()} == set(range(0, 900, 7))


# bounds
def test_samples_keep_their_bounds_whatever_repeats(spark, tmp_path):
    docs = file_frame(spark, tmp_path, [(1, f"same id {i}") for i in range(500)] + [(i, f"text {i}") for i in range(2, 40)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)] * 30 + [(i, i % 2) for i in range(2, 40)] + [(3, None)], "doc_id long, quality int")
    got = linear.labelled_sample(docs, labels, "quality", 10).collect()
    assert len(got) == 10 and len({r.id for r in got}) == 10
    every = linear.labelled_sample(docs, labels, "quality", 100).collect()
    assert len(every) == 39 and {r.id: r.y for r in every}[1] == 1
    few = linear.labelled_sample(docs, labels, "quality", 100, most_bytes=70).collect()
    assert 0 < sum(len(r.text) for r in few) <= 70 and {r.id for r in few} <= {r.id for r in every}


def test_language_samples_keep_their_bounds(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda sample: seen.append(sample))
    docs = [(1, f"w{i}", "en") for i in range(500)] + [(i, f"v{i}", "de" if i % 3 else "fr") for i in range(2, 60)] + [(7, "x", None), (None, "y", "en")]
    d = file_frame(spark, tmp_path, docs, "doc_id long, text string, lang string")
    language_id.train(d, most=10)
    assert Counter(g for g, _ in seen[0]) == {"en": 1, "de": 10, "fr": 10}
    language_id.train(d, most=10, langs=2)
    assert set(g for g, _ in seen[1]) == {"en", "de"}  # those with the most rows
    language_id.train(d, most=10, most_bytes=12)
    assert 0 < sum(len(t) for _, t in seen[2]) <= 12


def test_more_languages_than_bits(spark):
    rng = random.Random(1)
    words = {g: [f"{chr(97 + g % 26)}{chr(97 + g // 26)}{k}q" for k in range(4)] for g in range(70)}
    m = language_id.fit([(f"l{g:02}", " ".join(rng.choice(words[g]) for _ in range(60))) for g in range(70)])
    assert len(m.langs) == 70 and set(m.lexicon_of.tolist()) == set(range(70))


@pytest.mark.parametrize("docs", [15_000_000, 500_000_000])
def test_short_lists_are_posted_once_however_large_the_corpus(spark, tmp_path, docs):
    """Counters as full as such a corpus makes them: no list here is long, so none is cut."""
    d = file_frame(spark, tmp_path, [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(200)])
    s = near_dedup.Setup()
    rows = shared.numbered(d, "row").select(F.col("doc_id").alias("id"), "row", "text")
    reps = near_dedup.sign(rows, s).select(F.col("row").alias("id"), "n", "sig")
    counts = np.full(1 << near_dedup.COUNTER_BITS, docs * 64 >> near_dedup.COUNTER_BITS, np.int64)
    assert counts[0] > near_dedup.LIST_ROWS / 2
    assert near_dedup.postings(reps, s, counts + near_dedup.LIST_ROWS).count() == 200 * s.prefix


def test_near_groups_of_string_ids(spark, tmp_path):
    docs = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other words altogether, all of them"), (None, "one two three four five six")]
    got = near_dedup.near_groups(file_frame(spark, tmp_path, docs, "doc_id string, text string"))
    assert sorted(((r.id, r.component) for r in got.collect()), key=repr) == sorted([("a", "a"), ("b", "a"), ("c", "c"), (None, "a")], key=repr)


def test_near_dedup_where_long_lists_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIST_ROWS", 5)
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_LISTS", 0)
    base = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(w if k != i else "new" for k, w in enumerate(base))) for i in range(40)]
    got = near_dedup.near_groups(file_frame(spark, tmp_path, docs), near_dedup.Setup(width=2))
    assert sorted((r.id, r.n, r.component) for r in got.collect()) == brute_near(docs, 2)


def test_examples_that_were_written_read_back(spark, tmp_path):
    rng = random.Random(8)
    turns = [(i, k, rng.choice(["user", "assistant"]), f"<{i}#{k}\\") for i in range(40) for k in range(rng.randint(1, 9))]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chat_format.format_chats(d).repartition(7, "text").write.parquet(str(tmp_path / "examples"))
    got = chat_format.read_back(spark.read.parquet(str(tmp_path / "examples")))
    want = chat_format.read_back(chat_format.format_chats(d), in_order=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 40


# passages
def brute_passages(docs, s):
    """Pairs of documents with alike stretches of ``words`` words at equal distances, all of them tried."""
    linked = set()
    w = {i: words_of(t) for i, t in docs}
    sh = {i: [tuple(x[k : k + s.width]) for k in range(len(x) - s.width + 1)] for i, x in w.items()}
    where = defaultdict(set)
    for i, x in sh.items():
        for k, g in enumerate(x):
            where[g].add((i, k))
    for i, x in sh.items():
        shifts = {(j, p - k) for k, g in enumerate(x) for j, p in where[g] if j > i}
        for j, d in shifts:
            for k in range(max(0, -d), min(len(x), len(sh[j]) - d) - s.least + 1):
                one, two = set(x[k : k + s.least]), set(sh[j][k + d : k + d + s.least])
                if 100 * len(one & two) >= s.percent * len(one | two):
                    linked.add((i, j))
                    break
    return linked


@pytest.mark.parametrize("lists", [4096, 6])
def test_passages_whose_shingles_stand_in_others_are_found(spark, tmp_path, monkeypatch, lists):
    """Recall against brute force where lines, cut and edited versions share the passages' shingles; with short lists also cut ones."""
    monkeypatch.setattr(substring_dedup, "LIST_WINDOWS", lists)
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1 if lists < 100 else 16)
    monkeypatch.setattr(substring_dedup, "PARTS", 3)
    rng = random.Random(12)
    say = lambda n: [f"u{rng.randint(0, 10**6)}" for _ in range(n)]
    line, docs = say(30), []
    for g in range(12):
        p = say(rng.randint(55, 90))
        for k in range(rng.randint(3, 6)):
            q = [x if rng.random() > 0.01 * k else "new" for x in p]
            cut = q if k % 3 else q[: rng.randint(20, 45)]
            docs.append((len(docs), " ".join(say(rng.randint(0, 40)) + cut + line + say(rng.randint(0, 40)))))
    for setup in (substring_dedup.Setup(), substring_dedup.Setup(meet=2)):
        want = brute_passages(docs, setup)
        got = {tuple(sorted((r["id"], r["other_id"]))) for r in substring_dedup.repeated_passages(file_frame(spark, tmp_path, docs), setup).collect()}
        # a document's passage is found with one that stands for the others: compare whom each is connected with
        assert {i for p in got for i in p} >= {i for p in want for i in p}
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in got:
            root[find(a)] = find(b)
        assert sum(find(a) == find(b) for a, b in want) >= 0.95 * len(want)


def test_passages_of_nothing(spark, tmp_path):
    assert substring_dedup.repeated_passages(file_frame(spark, tmp_path, [])).count() == 0
    p = " ".join(f"w{k}" for k in range(60))
    body = [(1, p), (1, p + " x"), (None, p), (2, None), (3, ""), (4, "short")]
    got = substring_dedup.repeated_passages(file_frame(spark, tmp_path, body)).collect()
    assert sorted(str(r["id"]) for r in got) and {r["id"] for r in got} | {r["other_id"] for r in got} == {1, None}


# optima and gradients
def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient ascent on the dual of a small problem, in full matrices."""
    rng = np.random.default_rng(4)
    n, k = 30, 6
    y = (rng.random(n) < 0.4).astype(np.int64)
    x = np.stack([rng.choice(12, k, replace=False) for _ in range(n)])
    value = rng.normal(size=(n, k)).astype(np.float64)
    w = quality.dual_coordinate_descent(y, np.arange(0, n * k + 1, k), x.ravel(), value.ravel(), epochs=4000)[:12]
    dense = np.zeros((n, 12))
    np.put_along_axis(dense, x, value, 1)
    sign = np.where(y == 1, 1.0, -1.0)
    upper = n / (2 * np.where(y == 1, max(1, y.sum()), max(1, (1 - y).sum())))
    q = (dense @ dense.T) * np.outer(sign, sign)
    a = np.zeros(n)
    for _ in range(200_000):
        a = np.clip(a + (1 - q @ a) / (np.trace(q) + 1), 0, upper)
    dual = lambda a: a.sum() - a @ q @ a / 2
    primal = w @ w / 2 + (upper * np.maximum(0, 1 - sign * (dense @ w))).sum()
    assert primal == pytest.approx(dual(a), rel=1e-3)


def test_toxicity_fit_lowers_its_loss_to_that_of_gradient_descent():
    rng = np.random.default_rng(6)
    n, k = 400, 5
    truth = rng.normal(size=12) * 2
    x = np.stack([rng.choice(12, k, replace=False) for _ in range(n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-truth[x].sum(1)))).astype(np.int64)
    at = np.arange(0, n * k + 1, k)
    none = np.zeros(0, np.int64)
    w, a, b = toxicity.fit(y, at, x.ravel(), none, np.zeros(1, np.int64), none, epochs=60)
    use = np.arange(n) % 5 != 4
    dense = np.zeros((n, 12))
    np.put_along_axis(dense, x, 1.0, 1)
    seen = toxicity.telling(y, at, x.ravel())[:12]
    dense[:, ~seen] = 0
    rare = use.sum() / (2 * y[use].sum())
    weight = np.where(y == 1, min(rare, 5.0), 1.0)[use]
    v, c = np.zeros(12), 0.0
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-(dense[use] @ v + c))) - y[use]) * weight
        v, c = v - 0.002 * (dense[use].T @ g), c - 0.002 * g.sum()

    def loss(v, c):
        m = dense[use] @ v + c
        return (weight * (np.log1p(np.exp(m)) - y[use] * m)).sum()

    assert min(loss(w[:12], t) for t in np.linspace(-8, 8, 321)) < 1.2 * loss(v, c)  # the calibration moves the intercept


def test_conditional_field_gradient_is_that_of_the_log_likelihood():
    """Expected counts of forward-backward against numeric derivatives of the log partition function."""
    rng = np.random.default_rng(9)
    score, trans = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3))

    def logz(score, trans):
        a = score[0, 0]
        for s in range(1, 5):
            a = np.log(np.exp(a[:, None] + trans).sum(0)) + score[0, s]
        return np.log(np.exp(a).sum())

    gamma, xi = language_id._expected(score, trans)
    for s, g in ((0, 1), (2, 0), (4, 2)):
        up = score.copy()
        up[0, s, g] += 1e-5
        assert (logz(up, trans) - logz(score, trans)) / 1e-5 == pytest.approx(gamma[0, s, g], abs=1e-4)
    for a, b in ((0, 1), (2, 2)):
        up = trans.copy()
        up[a, b] += 1e-5
        assert (logz(score, up) - logz(score, trans)) / 1e-5 == pytest.approx(xi[a, b], abs=1e-4)


def test_neutral_mentions_are_flagged_less(spark, tmp_path):
    """Toxic texts name one group more often than others do; with swapped twins a neutral mention of it is no sign."""
    rng = random.Random(2)
    plain = ["walked", "home", "read", "books", "today", "sang", "cooked", "rice", "slept", "late", "met", "friends"]
    bad = ["idiot", "moron", "trash", "scum"]

    def text(toxic, name):
        w = rng.sample(plain, 6)
        if toxic and rng.random() < 0.6:
            w.insert(rng.randint(0, 6), rng.choice(bad))
        if name:
            w.insert(rng.randint(0, 6), name)
        return " ".join(w)

    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        name = ("muslims" if rng.random() < 0.8 else "christians") if toxic else ("christians" if rng.random() < 0.5 else None)
        rows.append((i, text(toxic, name), int(toxic)))
    docs = file_frame(spark, tmp_path, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, text(False, "muslims")) for i in range(200)], "doc_id long, text string")
    flagged = []
    for penalty in (0.0, 20.0):
        model = toxicity.train(docs, labels, penalty=penalty)
        assert model.rows == 600 and 200 < model.twins < 600
        flagged.append(toxicity.score_toxicity(neutral, model).filter(F.col("score") >= 0.5).count())
    assert flagged[1] < 0.6 * flagged[0]
    for lang, a, b in (("de", "Die Frauen und Juden", "Die Männer und Buddhisten"), ("fr", "les immigrés", "les réfugiés"), ("es", "las mujeres", "las hombres")):
        assert toxicity.swapped(a) == b, lang


# the pipeline
def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the one before left, each checked by hand but for the classifier's scores, which are held to the stage's own input."""
    rng = random.Random(17)
    say = lambda n, v="w": " ".join(f"{v}{rng.randint(0, 10**5)}" for _ in range(n))
    good = [(i, say(60)) for i in range(120)]
    item = say(25, "bench")
    docs = good + [(200 + i, "!! 77 $$ " * rng.randint(8, 20)) for i in range(60)]
    docs += [(300, good[0][1] + "  "), (301, good[1][1].replace(" ", "\n")), (302, good[2][1] + " tail"), (303, say(20) + " " + item + " " + say(20)), (304, item), (None, say(40)), (5, say(45)), (306, None), (307, "")]
    labels = [(i, 1) for i, _ in good[:90]] + [(200 + i, 0) for i in range(45)]
    sf = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", 7) for i, t in docs], "doc_id long, text string, lang string, source string, KEPT int").coalesce(2).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    now = spark.read.parquet(str(sf / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        out = shared.write_table(stage(spark, now, str(sf)), f"test-{name}")
        before = [(r.doc_id, r.text) for r in now.collect()]
        if name == "sentencepiece":
            pieces = sentencepiece_sampling.load_pieces()
            back = sentencepiece_sampling.decode(out, pieces).collect()
            assert Counter((r.doc_id, r.text) for r in back if r.sample == 0) == Counter((i, t or "") for i, t in before)
            break
        assert out.columns == now.columns
        after = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "quality":
            kept = {i for i, _ in after}
            assert set(range(120)) <= kept and len(kept & set(range(200, 260))) <= 2
        elif name == "exact_dedup":
            assert sum(after.values()) == len({x[3] for x in brute_exact(before)})
            assert {300, 302} <= {i for i, _ in after} and 0 not in {i for i, _ in after}
        elif name == "near_dedup":
            unique = [(k, t) for k, (_, t) in enumerate(before)]
            component = {k: c for k, _, c in brute_near(unique, 5)}
            assert sum(after.values()) == len(set(component.values()))
        else:
            clean = Counter(b for b, h in zip(before, [brute_hits([b], [(1, item), (2, None)])[0] for b in before], strict=True) if h[2] == 0)
            assert after == clean and not {303, 304} & {i for i, _ in after}
        left.append(sum(after.values()))
        now = out
    assert left == sorted(left, reverse=True) and len(left) == 4
    assert out.columns == ["doc_id", "sample", "ids", "logp", "inclusion"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(sf)).count() == 0


def test_counts_of_the_longest_texts(spark, tmp_path):
    """The two that the test of odd documents leaves out."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    vocab = token_counts.vocabulary()
    pieces, known = set(vocab), {}

    def greedy(w):
        if w not in known:
            n = i = 0
            while i < len(w):
                i = next(j for j in range(len(w), i, -1) if w[i:j] in pieces)
                n += 1
            known[w] = n
        return known[w]

    got = token_counts.count_tokens(file_frame(spark, tmp_path, [(1, long), (2, long + " ")]), vocab).collect()
    want = sum(greedy(b" " + w.encode()) for w in long.split())
    assert {(r.n_words, r.n_tokens) for r in got} == {(60_000, want)}
    enc = sentencepiece_sampling.encode(file_frame(spark, tmp_path, [(1, long)]), sentencepiece_sampling.load_pieces(), 2)
    assert {r.text for r in sentencepiece_sampling.decode(enc, sentencepiece_sampling.load_pieces()).collect()} == {long}


def test_chats_and_windows_of_very_long_texts(spark, tmp_path):
    long = "word # < \\ " * 100_000
    ex = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"))
    r = chat_format.read_back(ex, in_order=True).collect()[0]
    assert (r.n_turns, r.loss_chars) == (2, len(long))
    item = " ".join(f"bench{k}" for k in range(12))
    docs = [(1, "filler " * 150_000 + item + " filler" * 10), (2, "filler " * 150_000)]
    got = decontaminate.decontaminate(file_frame(spark, tmp_path, docs), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {(r.doc_id, r.n_hit) for r in got.collect()} == {(1, 12), (2, 0)}


def test_proximity_of_nulls_and_nothing(spark, tmp_path):
    items = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, None), (3, "")], "item_id long, text string")
    docs = file_frame(spark, tmp_path, [(1, "x a y b"), (1, "a b"), (None, "b a"), (2, None), (3, "")])
    got = Counter((r.doc, r["item"]) for r in decontaminate.proximity_matches(docs, items, 3).collect())
    assert got == Counter([(1, 1), (1, None), (None, 1), (None, None)])
    assert decontaminate.proximity_matches(docs.limit(0), items, 3).count() == 0
    assert decontaminate.proximity_matches(docs, items.limit(0), 3).count() == 0
    assert texts(pa.array([], pa.string()))[1].tolist() == [0]
