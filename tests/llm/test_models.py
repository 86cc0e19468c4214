"""Toxicity and class n-grams: searches against brute force, held-out quality, sums to one."""

import math
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from panelfx.llm import brown, common, toxicity

from .support import ODD, sample_texts


def index_of(n, seed=0):
    rng = random.Random(seed)
    idf = np.array([1 + rng.random() * 3 for _ in range(12)])
    seen, entries = set(), []
    while len(entries) < n:
        terms = sorted(rng.sample(range(12), rng.randrange(1, 5)))
        counts = [rng.randrange(1, 4) for _ in terms]
        if (tuple(terms), tuple(counts)) not in seen:
            seen.add((tuple(terms), tuple(counts)))
            m = rng.randrange(1, 4)
            entries.append((terms, counts, m, rng.randrange(m + 1), len(entries)))
    return toxicity.Index(idf, entries, 0.2, (10, 1)), entries, idf


def brute_nearest(entries, idf, terms, counts, k):
    def dense(t, c):
        v = np.zeros(len(idf))
        v[t] = (1 + np.log(c)) * idf[t]
        return v / np.linalg.norm(v)
    q = dense(terms, counts)
    scored = sorted(((round(float(q @ dense(e[0], e[1])), 9), e) for e in entries), key=lambda x: -x[0])
    scored = [(s, e) for s, e in scored if s > 0]
    held, out = 0, []
    for s, e in scored:
        if held >= k and s < out[-1][0]:
            break
        held += e[2]
        out.append((s, e))
    return sorted((s, e[4]) for s, e in out)


def test_block_max_search_is_exact():
    index, entries, idf = index_of(700)
    rng = random.Random(5)
    for _ in range(60):
        terms = sorted(rng.sample(range(12), rng.randrange(1, 6)))
        counts = [rng.randrange(1, 5) for _ in terms]
        got = sorted((s, index.ids[e]) for s, e in index.search(terms, counts))
        want = brute_nearest(entries, idf, terms, counts, toxicity.K)
        assert [g[1] for g in got] == [w[1] for w in want] or np.allclose([g[0] for g in got], [w[0] for w in want], atol=2e-9)
        assert len(got) == len(want)


@pytest.mark.parametrize("dense", [0, 5, 100])
def test_queries_are_searched_together(monkeypatch, dense):
    """However many entries share a query's terms: one pass over the postings for all queries of a
    part, and the exact neighbours whichever of the terms are rows of the matrix."""
    monkeypatch.setattr(toxicity, "DENSE", dense)
    index, entries, idf = index_of(700)
    rng = random.Random(8)
    queries = [(t, [rng.randrange(1, 5) for _ in t]) for t in (sorted(rng.sample(range(12), rng.randrange(1, 6))) for _ in range(150))]
    calls, real = [], index.cosines
    monkeypatch.setattr(index, "cosines", lambda q: calls.append(len(q)) or real(q))
    got = index.searches(queries)
    assert calls == [64, 64, 22]
    for (terms, counts), found in zip(queries, got):
        want = brute_nearest(entries, idf, terms, counts, toxicity.K)
        assert np.allclose(sorted(s for s, _ in found), [w[0] for w in want], atol=2e-9)
    some = {0, 3, 5, 7, 9}
    assert len(index.search(sorted(some), [1, 2, 1, 3, 1], k=10_000)) == sum(bool(some & set(e[0])) for e in entries)


def test_document_frequencies_are_summed_by_the_task(spark):
    """No row per text and term: each task sends a term once."""
    rows = [(list(range(i % 7)), i) for i in range(600)]
    vecs = spark.createDataFrame(rows, "terms array<int>, id int").repartition(3)
    got = toxicity.document_frequencies(vecs)
    assert {r.t: r.n for r in got.collect()} == {t: sum(t < i % 7 for i in range(600)) for t in range(6)}
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_scores_are_calibrated_and_monotone():
    index, _, _ = index_of(300)
    assert (np.diff(index.steps[1]) >= 0).all() and 0 <= index.steps[1][0] and index.steps[1][-1] <= 1
    assert 0 <= index.score([], [])[0] <= 1


def test_features():
    assert toxicity.tokens("A_b c1 Été!") == [b"a", b"b", b"c1", "été".encode()]
    f = toxicity.Features().counts("abcdefgh abcdefxy")
    assert f["abcde*"] == 2 and f["abcdefgh"] == 1 and "abcdefx*" in f
    assert toxicity.Features().counts(None) == {}
    words = toxicity.Chosen(["abcde*", "abcde*≥2", "zz"])
    assert words.vector("abcdefgh abcdefxy zz") == [(0, 2), (1, 1), (2, 1)]


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = [rng.choice(vocab) for _ in range(60)]
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(w)))
        if i % 10 < 8:
            labels.append((i, 1, int(bad)))
    labels += [(0, 1, 1), (1, 0, None), (None, 1, 1)]
    return docs(rows + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_toxicity_held_out(labelled):
    d, labels, rows = labelled
    out = toxicity.report(d, labels).collect()
    assert len(out) == len(rows) + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id > 6]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(e not in {r.doc_id for r in out if r.held_out} for r in out for e in r.evidence)
    left = toxicity.reject(d, labels)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} >= {i for i, _ in rows if i % 5 and i > 6}


def test_reject_learns_from_every_labelled_row(labelled):
    """With labels only on rows that report() holds out, reject() has examples to learn from."""
    d, labels, rows = labelled
    held = labels.filter(toxicity.remainder(labels.doc_id, 4) == 2)
    left = {r.doc_id for r in toxicity.reject(d, held).select("doc_id").collect()}
    assert not any(i % 5 == 0 and i > 6 and i in left for i, _ in rows)
    assert left >= {i for i, _ in rows if i % 5 and i > 6}


def test_every_significant_term_counts(spark, docs):
    """A lexicon of many words, each in a few toxic texts only, is found whole, past every floor
    of explained variance; a word as frequent in both kinds is no feature."""
    rows = []
    for i in range(6000):
        bad = i < 1200
        words = [f"plain{(i * 7 + k) % 50}" for k in range(12)] + (["common"] if i % 2 else [])
        rows.append((i, " ".join(words + ([f"q{i % 80}z"] if bad else []) + [f"n{i}"]), bad))
    train = spark.createDataFrame(rows, "id long, text string, toxic boolean")
    got = set(toxicity.feature_terms(train))
    assert {f"q{k}z" for k in range(80)} <= got and "common" not in got and "plain3" not in got


def test_scoring_tasks_are_bounded_in_rows(labelled, monkeypatch):
    d, labels, rows = labelled
    want = sorted((r.doc_id or -1, r.score) for r in toxicity.report(d, labels).collect())
    monkeypatch.setattr(toxicity, "SCORE_ROWS", 20)
    monkeypatch.setattr(toxicity, "MEMO_BYTES", 1000)
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.report(d, labels).collect()) == want


def test_toxicity_without_rows(labelled, empty, spark):
    d, labels, rows = labelled
    assert toxicity.report(empty, labels).collect() == []
    assert {r.score for r in toxicity.report(d, labels.limit(0)).collect()} == {0.0}


# ------------------------------------------------------------------ class n-grams

def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(1)
    size = 41  # END, then two groups that alternate
    n = np.zeros((size, size))
    for _ in range(4000):
        a, b = 1 + rng.integers(20), 21 + rng.integers(20)
        n[a, b] += 1
        n[b, 1 + rng.integers(20)] += 1
    n[0, 1:] += 1
    n[1:, 0] += 1
    of = brown.exchange(n, classes=3)
    assert len({int(c) for c in of[1:21]}) == 1 and len({int(c) for c in of[21:]}) == 1 and of[1] != of[21] and of[0] == 0
    start = np.array([0] + [1 + i % 2 for i in range(size - 1)])
    assert brown.likelihood(n, of) > brown.likelihood(n, start)


def test_exchange_stops_where_no_single_move_helps():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 6, (14, 14)).astype(float)
    of = brown.exchange(n, classes=4, sweeps=50)
    best = brown.likelihood(n, of)
    for i in range(1, 14):
        for c in range(1, 4):
            other = of.copy()
            other[i] = c
            assert brown.likelihood(n, other) <= best + 1e-6


def test_split_equals_words():
    """Every ASCII character between letters, other white space, ends, null and empty texts."""
    import pyarrow as pa
    texts = [f"A{chr(c)}b{chr(c)}{chr(c)}C" for c in range(128)] + ["\u00a0x\u2003y\u0085z", " lead", "trail ", "  ", "", None, "ÀÉ Straße İ"]
    texts += [t for _, t, _ in ODD] + sample_texts(10)
    ws, at, row = brown.split(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for i, r in zip(at.tolist(), row.tolist()):
        got[r].append(ws[i])
    assert got == [brown.words(t) for t in texts] and len(set(ws)) == len(ws)


def plain_base(rows, train):
    counts, n = {}, 0
    tokens = lambda t: brown.words(t) + [None]
    for t in train:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
            n += 1
    v = len(counts)
    return n, {(i, t): (len(tokens(t)), sum(w in counts for w in tokens(t)),
                        sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("head", [100_000, 20])
def test_brown_against_plain_counts(docs, monkeypatch, head):
    import zlib
    monkeypatch.setattr(brown, "HEAD", head)  # 20: most words go through the join
    monkeypatch.setattr(brown, "WORDS", 60)
    monkeypatch.setattr(brown, "ENDINGS", 40)
    monkeypatch.setattr(brown, "CLASSES", 12)
    rows = list(enumerate(sample_texts(40))) + [(i, t) for i, t, _ in ODD]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    n, want = plain_base(rows, [t for i, t in rows if not out_of(i)])
    got = brown.report(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        assert r.train_tokens == n and r.held_out == out_of(r.doc_id)
        fits = [want[r.doc_id, t] for t in texts[r.doc_id]]
        assert any(r.n_tokens == a and r.n_known == b and math.isclose(r.base_score, c, rel_tol=1e-9) for a, b, c in fits)
        assert r.score < 0
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_model_sums_to_one(docs, monkeypatch):
    monkeypatch.setattr(brown, "WORDS", 20)
    monkeypatch.setattr(brown, "ENDINGS", 10)
    monkeypatch.setattr(brown, "CLASSES", 6)
    model = brown.fit(docs(list(enumerate(sample_texts(8)))).select("text"))
    assert np.allclose((10 ** model.log_trans).sum(1), 1)
    item = brown.Items(model.frequent, model.endings)
    mass = np.zeros(len(model.log_room))
    for r in model.counts.collect():
        mass[model.of[item[bytes(r.word)]]] += r.n + brown.DELTA
    mass[0] += model.n_docs + brown.DELTA  # END
    assert np.allclose((mass + brown.DELTA) / 10 ** model.log_room, 1)  # and one unseen word a class


def test_brown_worker_holds_one_job_s_tables():
    """A worker that goes on to another job drops the tables of the last, and a word is remembered once."""
    ends = [b"ing"]
    tables = ([b"the"], ends, np.empty(0, np.int64), np.array([0, 1, 1, 1]), np.zeros((2, 2)), np.zeros(2), [(b"the", 5)], 9, 3, 2)
    scorer = brown.worker_scorer("scores", tables)
    scorer.run(pa.array(["the running The other", None, "singing"]))
    assert {b"running", b"other", b"singing"} <= set(scorer.slots) and not scorer.items.added
    assert scorer.items.found([b"the", b"running", b"other"]).tolist() == [2, 3, 1]
    held = weakref.ref(scorer)
    del scorer
    brown.worker_items("other", [b"the"], ends)
    assert held() is None


def test_brown_slices_are_bounded_in_bytes():
    texts = pa.array(["x" * 700_000] * 9)
    assert [n for _, n in common.text_slices(texts, brown.SLICE_ROWS, brown.SLICE_BYTES)] == [2, 2, 2, 2, 1]


def test_batches_are_small_and_own_bounds_stay(spark):
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    try:
        for given, want in ((("10000", "67108864b"), (common.BATCH_ROWS, common.BATCH_BYTES)), (("0", "67108864b"), (common.BATCH_ROWS, common.BATCH_BYTES)),
                            (("100", "64m"), (100, common.BATCH_BYTES)), (("500", "1000"), (500, 1000))):
            for k, v in zip(keys, given):
                spark.conf.set(k, v)
            common.small_batches(spark)
            assert tuple(int(spark.conf.get(k).rstrip("b")) for k in keys) == want
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_brown_small_frames_start_no_python_rows(spark):
    """The driver's few rows come as Arrow: no RDD of pickled rows, which would need workers of its own."""
    for frame in (brown._words_frame(spark.range(1), [b"a", b"b"]), brown._endings_frame(spark.range(1), [b"a"], [])):
        assert "ExistingRDD" not in frame._jdf.queryExecution().toString()
    assert [tuple(r) for r in brown._endings_frame(spark.range(1), [b"a"], [b"x", b"y"]).collect()] == [(b"x", 3), (b"y", 4)]


def test_brown_scores_against_plain_sums(docs, monkeypatch):
    """Class bigrams counted word by word give the model's transitions, and every text's score is
    the sum of its tokens' transition and emission, word by word."""
    monkeypatch.setattr(brown, "HEAD", 50)
    choose, exchange = brown.choose_items, brown.exchange
    monkeypatch.setattr(brown, "choose_items", lambda counts: choose(counts, 40, 30))
    monkeypatch.setattr(brown, "exchange", lambda n: exchange(n, classes=10))
    monkeypatch.setattr(brown, "FLOOR", 2)
    rows = list(enumerate(sample_texts(30))) + [(100, None), (101, ""), (102, "wholly unseen wörds")]
    train = docs(rows[:25])
    model = brown.fit(train.select("text"))
    item = brown.Items(model.frequent, model.endings, model.keys)
    assert len(model.keys) > 5
    chain_of = lambda t: [0] + [int(model.of[item[w]]) for w in brown.words(t)] + [0]
    classes = len(model.log_room)
    N, seen = np.zeros((classes, classes)), {}
    for _, t in rows[:25]:
        c = chain_of(t)
        for a, b in zip(c, c[1:]):
            N[a, b] += 1
        for w in brown.words(t):
            seen[w] = seen.get(w, 0) + 1
    uni = (N.sum(0) + 1) / (N.sum() + classes)
    trans = (N + brown.BACKOFF * uni) / (N.sum(1)[:, None] + brown.BACKOFF)
    assert np.allclose(np.log10(trans), model.log_trans, atol=1e-12)
    got = {r.doc_id: r.score for r in brown.score(docs(rows), model).collect()}
    for i, t in rows:
        c, want = chain_of(t), 0.0
        for a, b, w in zip(c, c[1:], brown.words(t) + [None]):
            n = 25 if w is None else seen.get(w, 0)
            want += math.log10(trans[a, b]) + math.log10(n + brown.DELTA) - model.log_room[b]
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_brown_without_rows(empty, docs):
    assert brown.report(empty).collect() == []


def further_model(docs, monkeypatch):
    """Two groups of words alternate; x and y words share endings and are not frequent."""
    choose, exchange = brown.choose_items, brown.exchange
    monkeypatch.setattr(brown, "choose_items", lambda counts: choose(counts, 20, 10))
    monkeypatch.setattr(brown, "exchange", lambda n: exchange(n, classes=3))
    monkeypatch.setattr(brown, "FLOOR", 30)
    rng = random.Random(3)
    one = [f"a{i}" for i in range(10)] * 30 + [f"x{i}same" for i in range(10)]
    two = [f"b{i}" for i in range(10)] * 30 + [f"y{i}same" for i in range(10)]
    one, two = one + [w for w in one if "same" in w] * 9, two + [w for w in two if "same" in w] * 9
    rows = [(i, " ".join(rng.choice(one) + " " + rng.choice(two) for _ in range(200))) for i in range(20)]
    return brown.fit(docs(rows + [(50, "rare0same")]).select("text"))


def test_words_over_the_floor_have_their_own_class(docs, monkeypatch):
    model = further_model(docs, monkeypatch)
    item = brown.Items(model.frequent, model.endings, model.keys)
    of = lambda w: model.of[item[w.encode()]]
    assert len(model.keys) == 20
    assert {of(f"x{i}same") for i in range(10)} == {of("a0")} and {of(f"y{i}same") for i in range(10)} == {of("b0")} != {of("a0")}
    mass = np.zeros(len(model.log_room))  # sums to one with further words, too
    for r in model.counts.collect():
        mass[model.of[item[bytes(r.word)]]] += r.n + brown.DELTA
    mass[0] += model.n_docs + brown.DELTA
    assert np.allclose((mass + brown.DELTA) / 10 ** model.log_room, 1)
    assert np.allclose((10 ** model.log_trans).sum(1), 1)


def test_best_class_is_the_best_of_brute_force():
    rng = np.random.default_rng(4)
    n = rng.integers(0, 6, (14, 14)).astype(float)
    of = np.array([0] + [1 + i % 4 for i in range(13)])
    member = np.eye(5)[of]
    for w in range(1, 14):
        wl, wr = n.T[w] @ member, n[w] @ member
        wl[of[w]] -= n[w, w]
        wr[of[w]] -= n[w, w]
        got = of.copy()
        got[w] = brown.best_class(member.T @ n @ member, of[w], wl, wr, n[w, w])
        for c in range(1, 5):
            other = of.copy()
            other[w] = c
            assert brown.likelihood(n, other) <= brown.likelihood(n, got) + 1e-6


def test_counts_around_words_hold_little_memory(monkeypatch):
    """What a task holds does not grow with its cells, and what it sends adds up to the plain counts."""
    monkeypatch.setattr(brown, "PAIRS", 1000)
    monkeypatch.setattr(brown, "CODES", 5000)
    rng = np.random.default_rng(3)
    size, classes, further = 20, 4, 300
    cls = rng.integers(0, classes, size + further)
    cells = [rng.integers(0, size + further, 30_000).astype(np.int32) for _ in range(8)] + [np.zeros(1, np.int32), np.full(2500, size, np.int32)]
    width = 2 * classes + 1
    want = np.zeros(further * width, np.int64)
    for c in cells:
        for x, y in zip(c[:-1].tolist(), c[1:].tolist()):
            if x == y and x >= size:
                want[(x - size) * width + 2 * classes] += 1
                continue
            if y >= size:
                want[(y - size) * width + cls[x]] += 1
            if x >= size:
                want[(x - size) * width + classes + cls[y]] += 1
    got = np.zeros_like(want)
    tracemalloc.start()
    for batch in brown.around_batches(iter(cells), cls, size, classes):
        for b, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            at = np.frombuffer(codes.as_buffer(), np.uint32).astype(np.int64) + b * brown.AROUND * width
            assert (np.diff(at) > 0).all()
            got[at] += np.frombuffer(n.as_buffer(), np.uint32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and peak < 1_000_000
