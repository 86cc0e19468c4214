"""SimHash, line chunks, components, decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelfx.llm import decontaminate, linechunks, simhash
from panelfx.llm.components import components

from .support import ODD, sample_texts


def unions(n, pairs):
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\v\f\r":
        lower = lower.replace(s, " ")
    words = [w for w in lower.split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_plain_version():
    for t in sample_texts(30) + [t for _, t, _ in ODD] + ["A b c D e F"]:
        assert simhash.majority(simhash.shingle_hashes(t)) % 2**64 == plain_fingerprint(t)


def test_embedding_bounds_hamming():
    rng = np.random.default_rng(0)
    a = rng.integers(-2**63, 2**63 - 1, 4000)
    b = a ^ (np.int64(1) << rng.integers(0, 62, 4000)) ^ (np.int64(1) << rng.integers(0, 62, 4000))
    low = simhash.manhattan(simhash.embed(a), simhash.embed(b))
    assert (low <= np.bitwise_count((a ^ b).view(np.uint64))).all()
    counts = lambda x: [(int(x) % 2**64 >> 2 * i & 3).bit_count() for i in range(32)]
    assert all(low[i] == sum(abs(p - q) for p, q in zip(counts(a[i]), counts(b[i]))) for i in range(200))


def clusters(n, seed, spread):
    """Fingerprints: loose ones, and a dense ball around one centre."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    centre = rng.getrandbits(64)
    for _ in range(n):
        x = centre
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return [x - 2**64 if x >= 2**63 else x for x in sorted(out)]


@pytest.mark.parametrize("cell,max_bits", [(16_384, 4), (8, 4), (16_384, 3), (16_384, 6)])
def test_links_connect_what_brute_force_connects(spark, cell, max_bits):
    # cell 8: most of the ball goes through the tiles
    fps = clusters(150, max_bits, 9)
    n = len(fps)
    want = unions(n, [(i, j) for i in range(n) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= max_bits])
    df = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    edges = simhash.fingerprint_links(df, max_bits, cell).collect()
    at = {f: i for i, f in enumerate(fps)}
    assert all(((e.a ^ e.b) % 2**64).bit_count() <= max_bits for e in edges)
    got = unions(n, [(at[e.a], at[e.b]) for e in edges])
    assert got == want and len(set(want)) < n


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_near_duplicates_rows(spark, docs, odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    zero = {r.doc_id: r.component_id for r in out if r.fingerprint == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert simhash.near_duplicates(empty).collect() == []
    text = sample_texts(1)[0]
    d = docs([(7, text), (5, text + " tail"), (9, text), (11, sample_texts(2)[1])] + ODD)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    parts = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    assert [i for none, i in ids if not none].count(4) == 1 and (True, 0) in ids
    # one for each class of linked fingerprints
    fps = sorted({int(r.fingerprint, 16) for r in simhash.near_duplicates(d).collect()})
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert len(ids) == len(set(unions(len(fps), linked)))
    assert parts[7] == parts[9] and simhash.keep_one(empty).collect() == []


def test_keep_one_leaves_unlinked_texts_of_one_id(docs):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "nine ten eleven twelve thirteen fourteen"),
            (2, "some third text that resembles neither of them"), (2, "alpha beta gamma delta epsilon zeta")]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(docs(rows)).collect())
    assert kept == sorted(rows[:3])


def test_keep_one_of_linked_rows_without_ids(docs, monkeypatch):
    """Rows with null ids and linked, unequal fingerprints are one class."""
    monkeypatch.setattr(simhash, "fingerprint_links", lambda fps, *_: fps.agg(F.min("fp").alias("a"), F.max("fp").alias("b")))
    rows = [(None, "one text of six words here"), (None, "quite another text with more words")]
    assert simhash.keep_one(docs(rows)).count() == 1


# ------------------------------------------------------------------ line chunks

def plain_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(ln.encode()).hexdigest()[:15], 16) % 1_000_003 for ln in lines]
    long = [len(ln.encode().split()) >= 50 for ln in lines]
    out, cur = [], []
    for i, ln in enumerate(lines):
        cur.append(ln)
        rolling = (h[i - 1] * 31 if i else 0) + h[i]
        if rolling % 2 == 0 or long[i] or i + 1 == len(lines) or long[i + 1]:
            body = "\n".join(cur)
            n = len(body.encode().split())
            out.append((body, n > 0 if len(cur) > 1 else n >= 50))
            cur = []
    return out


def plain_clean(rows):
    """Texts after removing later occurrences; equal (id, text) rows are one document."""
    order = sorted({(i is None, i or 0, i, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    seen, out = set(), {}
    for _, _, i, t in order:
        left = []
        for body, eligible in plain_chunks(t):
            if not (eligible and body in seen):
                left.append(body)
            if eligible:
                seen.add(body)
        out[i, t] = "\n".join(left)
    return out


@pytest.mark.parametrize("salt_rows", [256, 2])
def test_line_chunks_match_plain_version(docs, odd, empty, monkeypatch, salt_rows):
    monkeypatch.setattr(linechunks, "SALT_ROWS", salt_rows)  # 2: the shared passage's text goes to several copies
    texts = sample_texts(60)
    passage = "\n".join(f"shared line number {i} of the passage" for i in range(8))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, f"own start {i}\n{passage}\nown end {i}") for i in range(12)]
    rows += [(200, "word " * 60 + "\nx"), (201, "y\n" + "word " * 60), (201, "y\n" + "word " * 60), (300, None), (301, "")]
    want = plain_clean(rows)
    got = linechunks.clean(docs(rows)).collect()
    assert len(got) == len(rows) and list(got[0].asDict()) == [*docs(rows).columns, *linechunks.STATS]
    expected = sorted(str(want[i, t] if t is not None else None) for i, t in rows)
    assert sorted(str(r.text) for r in got) == expected
    assert sum(r.text is not None and passage in r.text for r in got) == 1  # shifted, yet found
    assert linechunks.clean(odd).count() == len(ODD)
    assert linechunks.report(empty).collect() == []
    kept = linechunks.dedup(docs(rows + [(400, passage)]))
    assert kept.columns == docs(rows).columns


def test_chunk_bytes_are_compared(docs, monkeypatch):
    """With a digest that always collides, different chunks stay."""
    class Same:
        def digest(self):
            return b"0"

        def hexdigest(self):
            return "0" * 32
    every = linechunks.chunks("a b\nc d", divisor=1)
    assert [c[2] for c in every] == [b"a b", b"c d"]
    # a wrong candidate text is not removed: the owner's text differs
    text = "alpha beta\ngamma delta\n" * 3
    rows = [(1, text), (2, text.replace("alpha", "omega"))]
    got = {r.doc_id: r.text for r in linechunks.clean(docs(rows), window=1, divisor=4).collect()}
    assert got[1] == text


def plain_grown(rows):
    """Texts after removing every repeated pair of lines, long line and chunk of rows with
    unequal ids, in their order; an overlap with the first occurrence is none."""
    first, out = {}, {}
    for i, t in sorted(rows):
        lines, gone, at = t.split("\n"), set(), 0
        looked = [(p, p + 2, "\n".join(lines[p:p + 2])) for p in range(len(lines) - 1) if (lines[p] + lines[p + 1]).strip()]
        for body, eligible in plain_chunks(t):
            n = body.count("\n") + 1
            looked += [(at, at + n, body)] if eligible and n != 2 else []
            at += n
        for a, b, body in sorted(looked):
            doc, start = first.setdefault(body, (i, a))
            if doc != i or a >= start + b - a:
                gone |= set(range(a, b))
        for a in sorted(gone):
            b = next((b for b in range(a + 1, len(lines)) if b in gone or lines[b].strip()), None)
            gone |= set(range(a, b)) if b in gone else set()
        out[i] = "\n".join(ln for k, ln in enumerate(lines) if k not in gone)
    return out


def test_dedup_removes_whole_passages(docs):
    """Passages of 2 to 6 lines and over 50 words go whole, whatever stands around them."""
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shapes = [(2, 30), (3, 20), (4, 15), (5, 12), (6, 10)]
    rows, own = [], {}
    for k in range(40):
        n, words = shapes[k % 5]
        passage = [line(words) for _ in range(n)]
        for i in (2 * k, 2 * k + 1):
            own[i] = [line(8) for _ in range(6)]
            rows.append((i, "\n".join(own[i][:3] + passage + own[i][3:])))
    texts = dict(rows)
    got = {r.doc_id: r.text for r in linechunks.dedup(docs(rows)).collect()}
    assert all(got[i] == (texts[i] if i % 2 == 0 else "\n".join(own[i])) for i in texts)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 3])
def test_dedup_matches_plain_version(docs, monkeypatch, broadcast_rows):
    monkeypatch.setattr(linechunks.common, "BROADCAST_ROWS", broadcast_rows)  # 3: the rarer digests are joined by a shuffle
    rows = list(enumerate(sample_texts(120)))
    long = "\n".join(f"line {i} of a text of over a million letters" for i in range(30_000))
    rows += [(300, long), (301, "its own\n" + long), (302, "x\n" + "word " * 300_000), (303, "y\n" + "word " * 300_000)]
    rows += [(200, "a\na\na\na\na"), (201, "a\na\na\na\na\nend"), (202, "p q\n\n\n\nr s\nt"), (203, "u\np q\n\n\n\nr s"), (204, "p q\n\n"), (205, "")]
    want = plain_grown(rows)
    got = {r.doc_id: r.text for r in linechunks.dedup(docs(rows)).collect()}
    assert got == {i: w for i, w in want.items() if w.strip() or w == dict(rows)[i]}
    assert got[200] == "a\na" and got[201] == "end" and got[203] == "u" and 204 not in got


def test_frequent_digests_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(linechunks.common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(linechunks, "HOT_ROWS", 3)
    occ = [(i, "a") for i in range(20)] + [(i, c) for c in "bcde" for i in range(2)] + [(0, "f")]
    first = linechunks.common.stage(spark.createDataFrame([("a", 20), ("b", 2), ("c", 2), ("d", 2), ("e", 2)], "digest string, n long"), "t")
    df = linechunks._repeated(linechunks.common.stage(spark.createDataFrame(occ, "id long, digest string"), "t"), first)
    assert df.columns == ["digest", "id", "n"]
    assert sorted((r.id, r.digest) for r in df.collect()) == sorted(o for o in occ if o[1] != "f")
    assert {r.digest: r.n for r in df.collect()} == {"a": 20, "b": 2, "c": 2, "d": 2, "e": 2}


# ------------------------------------------------------------------ decontamination

def plain_words(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        ch = chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
        if ch.isascii() and not (ch.isdigit() or "a" <= ch <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def plain_hits(text, items, k):
    w = plain_words(text)
    cover, found = set(), set()
    for item, t in items:
        iw = plain_words(t)
        n = min(k, len(iw))
        for s in range(len(iw) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == iw[s:s + n]:
                    cover |= set(range(p, p + n))
                    found |= {item} - {None}
    ids = ",".join(sorted(map(str, found)))
    return len(w), len(cover), len(found), hashlib.sha256(ids.encode()).hexdigest()


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination_matches_plain_version(spark, docs, odd, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", limit)  # 0: windows too many to broadcast
    long = "The quick brown fox jumps over the lazy dog while 7 small cats watch it from the old wall"
    items = [(1, long), (2, "Two words"), (10, long + " again"), (3, "..."), (4, None), (None, "null id item"), (2, "Two words"), (5, "été là")]
    rows = [(1, f"before. {long}! after"), (2, f"{long[4:60]} cut"), (3, "a two, WORDS b two-words"), (4, "clean text here"),
            (5, f"{long} {long}"), (6, "Été, LÀ; été là"), (7, "null id item"), (7, "null id item"), (8, "ÉTÉ été--là")] + [(i, t) for i, t, _ in ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, (r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in decontaminate.report(docs(rows), bench).collect())))
    assert got == sorted(str((i, plain_hits(t, items, 10))) for i, t in rows)
    left = decontaminate.remove(docs(rows), bench)
    assert left.columns == docs(rows).columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str((i, t)) for i, t in rows if plain_hits(t, items, 10)[1] == 0)
    if limit:
        cut = {(r.doc_id, r.text) for r in decontaminate.remove(docs(rows), bench, "spans").collect()}
        assert (1, "before. ! after") in cut and (4, "clean text here") in cut and (3, "a  b ") in cut
        assert decontaminate.report(empty, bench).collect() == []
        assert decontaminate.report(odd, bench.limit(0)).filter(F.col("n_hit") > 0).count() == 0


def test_decontamination_runs_no_python(spark, docs):
    plan = decontaminate.report(docs([(1, "a b")]).select("doc_id", "text"), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def test_one_window_in_very_many_items(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 100)  # the windows fit, the pairs with items do not
    shared = "answer the next question with one of the four letters given"
    items = [(i, shared) for i in range(10_000)] + [(-1, "two words"), (-2, "some other words that stand alone")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    rows = [(1, f"Here: {shared}! then two words"), (2, "two, words"), (3, "none of it")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs(rows), bench).collect()}
    ids = ",".join(sorted(map(str, [*range(10_000), -1])))
    assert got[1] == (15, 13, 10_001, hashlib.sha256(ids.encode()).hexdigest())
    assert got[2] == (2, 2, 1, hashlib.sha256(b"-1").hexdigest()) and got[3][1:3] == (0, 0)


def test_spans_of_mixed_lengths_in_a_very_long_text(spark, docs):
    bench = spark.createDataFrame([(1, "a b"), (2, "b c d e"), (3, "z")], "item_id long, text string")
    long = "x y, " * 300_000  # 1.5 MB
    rows = [(1, "a b c d e f a b. Z z"), (2, f"{long}A b C {long}z."), (3, long)]
    h = {r.id: r for r in decontaminate.hits(docs(rows), bench).collect()}
    assert [tuple(s) for s in h[1].spans] == [(0, 5), (6, 10)] and h[1].n_hit == 9
    assert [tuple(s) for s in h[2].spans] == [(600_000, 600_002), (1_200_003, 1_200_004)] and h[3].spans == [] and h[3].n_words == 600_000
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs(rows), bench, "spans").collect()}
    assert cut == {1: " f ", 2: f"{long} C {long}.", 3: long}
