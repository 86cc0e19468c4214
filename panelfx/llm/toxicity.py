"""Toxicity by nearest labelled examples (operator 2).

1. Terms: words and stems (the first 4 to 7 letters of longer words), each also as "at
   least twice" and "at least four times", so that repetition survives the unit length of
   a vector. Over all labelled training rows (equal texts count once), a term whose
   presence tells of the label beyond chance is a feature term: its chi squared passes the
   bound that, among as many terms as are tested, lets one in by chance with probability
   ALPHA at most. MAX_TERMS bounds the memory of their table; past it those with the
   largest chi squared stay.
2. Vectors: every text becomes (1 + ln tf) * idf over those terms, of unit length; the
   document frequencies are counted over all documents, labelled or not.
3. Index: training examples with equal vectors are one entry (how many, how many toxic).
   At most MAX_EXAMPLES entries, those with the lowest hash of their smallest id, are laid
   out as an inverted index, the postings of the DENSE most frequent terms as rows of a
   matrix. SEARCHES queries are multiplied with it at once and the other terms' postings
   added: the cosines of all entries in single precision, at a cost bounded by MAX_EXAMPLES
   and DENSE whatever the queries share. Entries that rounding cannot keep from the top k
   are computed anew in double precision, so the result is the exact top k.
4. Vote: neighbours vote with their cosine, towards the corpus rate by PRIOR votes; votes
   are calibrated by isotonic regression on leave-one-out votes of the index's own entries.
   A text without any feature term has no neighbours and gets the rate of such examples.

Scale: texts are read twice (terms over training rows, vectors over all); all later steps
run on slim vectors. Larger tables prove more terms, so vectors grow towards all terms of their
texts; document frequencies are therefore summed by the task, not one row per text and term. What reaches the driver is bounded by MAX_TERMS and MAX_EXAMPLES.
Scoring tasks hold SCORE_ROWS rows on average, whatever the size of the vectors' files.

Defined results. Null or empty text: no terms. Very long text: read whole. Repeated label
rows: the label is their mean, at least one half. Null labels or ids: no training rows. No
training rows at all: every score 0. Ties between neighbours: all entries of equal cosine
at the k-th place count. Rows that repeat: each returned. Further columns of the documents
are not looked at by `report` and kept by `reject`, whatever their names. Empty table:
empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_TERMS = 65_536    # a memory bound: of the list of terms, and of a task's document frequencies
ALPHA = 0.01          # probability that chance alone makes any tested term a feature term
MIN_DOCS = 5          # tested are the terms that occur in at least so many training texts
MAX_EXAMPLES = 8_192
DENSE = 256           # terms whose postings are rows of a matrix, 32 kB each
SEARCHES = 64         # queries searched at once
K = 15
PRIOR = 1.0
THRESHOLD = 0.3

STEMS = (4, 5, 6, 7)  # letters of a stem
LEVELS = (2, 4)       # a term counts as one more from so many occurrences on
MEMO = 100_000        # words a worker remembers the terms of
MEMO_BYTES = 32 << 20  # bytes of vectors a worker remembers the scores of
SCORE_ROWS = 50_000   # rows of a scoring task on average, at most

# Every ASCII byte that is no letter or digit separates words.
GAPS = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))


def tokens(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of non-ASCII characters of the lower-cased text."""
    return text.lower().encode().translate(GAPS).split() if text else []


class Features(dict):
    """The terms a word counts for, itself and its stems, of those in `base` (None: all);
    found once per word, up to MEMO words."""

    def __init__(self, base: set[str] | None = None):
        super().__init__()
        self.base = base

    def __missing__(self, word: bytes) -> list[str]:
        w = word.decode()
        got = [w, *[w[:k] + "*" for k in STEMS if k < len(w)]]
        if self.base is not None:
            got = [f for f in got if f in self.base]
        if len(self) > MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def counts(self, text: str | None) -> dict[str, int]:
        """The terms of a text and how often they occur."""
        found: dict[str, int] = {}
        get = found.get
        for w, n in Counter(tokens(text)).items():
            for f in self[w]:
                found[f] = get(f, 0) + n
        return found


class Chosen:
    """Vectors over the chosen terms."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.features = Features({t.partition("≥")[0] for t in terms})  # a level of a term needs the term's count

    def vector(self, text: str | None) -> list[tuple[int, int]]:
        """(term number, count) of a text's chosen terms, in rising order."""
        found = self.features.counts(text)
        out = [(self.number[f], n) for f, n in found.items() if f in self.number]
        out += [(i, 1) for f, n in found.items() for k in LEVELS if n >= k and (i := self.number.get(f"{f}≥{k}")) is not None]
        return sorted(out)


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


# ------------------------------------------------------------------ terms

def term_counts(df: DataFrame, text: str, toxic: str) -> DataFrame:
    """(term, n, n_toxic): in how many texts, and toxic texts, a term occurs."""
    common.ship(df.sparkSession)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_toxic", T.LongType())])

    def batch_of(n, pos):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([pos[t] for t in n], pa.int64())],
            names=["term", "n", "n_toxic"])

    def run(batches):
        n, pos, features = Counter(), Counter(), Features()
        for batch in batches:
            for start, size in common.text_slices(batch.column(0)):
                part = batch.slice(start, size)
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = features.counts(t)
                    seen = [*found, *[f"{f}≥{k}" for f, m in found.items() if m >= LEVELS[0] for k in LEVELS if m >= k]]
                    n.update(seen)
                    if y:
                        pos.update(seen)
                if len(n) > 150_000:
                    yield batch_of(n, pos)
                    n, pos = Counter(), Counter()
        if n:
            yield batch_of(n, pos)

    return df.select(text, toxic).mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def feature_terms(train: DataFrame, text: str = "text", toxic: str = "toxic") -> list[str]:
    """The terms whose presence tells of the label beyond chance, at most MAX_TERMS."""
    total = train.agg(F.count(F.lit(1)), F.sum(F.col(toxic).cast("long"))).first()
    n, n1 = total[0], total[1] or 0
    if n1 == 0 or n1 == n:
        return []
    c = common.stage(term_counts(train, text, toxic).filter(F.col("n").between(MIN_DOCS, n - 1)), "terms")
    # one degree of freedom: P(chi2 > x) <= exp(-x / 2)
    bound = 2 * math.log(max(c.count(), 1) / ALPHA)
    cov = F.col("n_toxic") / n - F.col("n") * (n1 / n / n)
    p = F.col("n") / n
    chi2 = n * cov * cov / (p * (1 - p) * ((n1 / n) * (1 - n1 / n)))
    top = c.withColumn("chi2", chi2).filter(F.col("chi2") >= bound)
    return [r[0] for r in top.orderBy(F.desc("chi2"), "term").limit(MAX_TERMS).collect()]


# ------------------------------------------------------------------ vectors

def vectors(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """`df` without `text`, plus the feature terms of every whole text (`terms`: numbers,
    rising) and their counts (`tfs`)."""
    fields = [T.StructField(c, T.ArrayType(T.IntegerType()), False) for c in ("terms", "tfs")]
    key = uuid.uuid4().hex

    def fn(texts):
        from panelfx.llm import toxicity as here
        found = [here.chosen(key, terms).vector(t) for t in texts]
        return [pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32()))]

    return common.map_texts(df, text, fields, fn)


def document_frequencies(vecs: DataFrame) -> DataFrame:
    """(t, n): in how many rows a term number occurs. A task sums its rows (MAX_TERMS numbers at
    most), so what it sends does not grow with the terms of a text."""

    def run(batches):
        n = np.zeros(0, np.int64)
        for batch in batches:
            part = np.bincount(pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False))
            if len(part) > len(n):
                n, part = part.astype(np.int64), n
            n[:len(part)] += part
        t = np.flatnonzero(n)
        if len(t):
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n[t], pa.int64())], names=["t", "n"])

    return vecs.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))


_CHOSEN: dict = {}


def chosen(key: str, terms: list[str]) -> Chosen:
    """The worker's own memo of this call's terms."""
    if key not in _CHOSEN:
        _CHOSEN.clear()
        _CHOSEN[key] = Chosen(terms)
    return _CHOSEN[key]


class Index:
    """Inverted index of unit vectors, with votes and their calibration."""

    def __init__(self, idf: np.ndarray, entries: list[tuple[list[int], list[int], int, int, object]], prior: float,
                 empty: tuple[int, int]):
        """`entries`: (terms, counts, examples, toxic examples, smallest id), no empty vectors."""
        # entries that share their heaviest term come together
        self.idf, self.prior = idf, prior
        entries = sorted(entries, key=lambda e: (max(zip(self.weights(e[0], e[1]), e[0]))[1], e[0], e[1]))
        self.n = np.array([e[2] for e in entries], float)
        self.toxic = np.array([e[3] for e in entries], float)
        self.ids = [e[4] for e in entries]
        # the entries' vectors, one after the other
        self.terms = np.concatenate([np.array(e[0], np.int32) for e in entries] or [np.empty(0, np.int32)])
        self.weight = np.concatenate([self.weights(e[0], e[1]) for e in entries] or [np.empty(0)])
        self.begin = np.cumsum([0, *[len(e[0]) for e in entries]])
        # postings: rows of a matrix for the most frequent terms (`row` gives theirs), lists for the others
        at = np.repeat(np.arange(len(entries), dtype=np.int32), np.diff(self.begin))
        often = np.bincount(self.terms, minlength=len(idf))
        top = np.argsort(-often, kind="stable")[:DENSE]
        self.row = np.full(len(idf), -1)
        self.row[top] = np.arange(len(top))
        dense = self.row[self.terms] >= 0
        self.matrix = np.zeros((len(top), len(entries)), np.float32)
        self.matrix[self.row[self.terms[dense]], at[dense]] = self.weight[dense]
        rest = np.flatnonzero(~dense)
        rest = rest[np.argsort(self.terms[rest], kind="stable")]
        self.start = np.searchsorted(self.terms[rest], np.arange(len(idf) + 1))
        self.rest_entry, self.rest_weight = at[rest], self.weight[rest]
        self.empty_rate = (empty[1] + PRIOR * prior) / (empty[0] + PRIOR)
        self.steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.calibrate([(e[0], e[1]) for e in entries])

    def weights(self, terms, counts) -> np.ndarray:
        w = (1 + np.log(np.array(counts, float))) * self.idf[np.array(terms, int)]
        return w / math.sqrt(float(w @ w))

    def cosines(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The cosines of queries (terms, weights) and all entries, in single precision."""
        size = len(self.n)
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        terms, q = (np.concatenate(x) for x in zip(*queries))
        row = self.row[terms]
        dense = row >= 0
        left = np.zeros((len(queries), len(self.matrix)), np.float32)
        left[of[dense], row[dense]] = q[dense]
        out = left @ self.matrix
        of, terms, q = of[~dense], terms[~dense], q[~dense]
        n = self.start[terms + 1] - self.start[terms]
        if n.sum():
            ends = np.cumsum(n)
            read = np.arange(ends[-1]) + np.repeat(self.start[terms] - ends + n, n)
            flat = np.repeat(of * size, n) + self.rest_entry[read]
            out += np.bincount(flat, weights=np.repeat(q, n) * self.rest_weight[read], minlength=out.size).reshape(out.shape)
        return out

    def search(self, terms, counts, k: int = K, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, entry) of the entries that hold the k nearest examples, with all of the
        last cosine; entries that share no term are no neighbours. One example of the
        entry `skip` is left out."""
        return self.searches([(terms, counts)], k, [skip])[0]

    def searches(self, queries, k: int = K, skips=None) -> list[list[tuple[float, int]]]:
        """`search` for each (terms, counts) of `queries`, SEARCHES at once."""
        out = []
        for first in range(0, len(queries), SEARCHES):
            part = [(np.array(t, int), self.weights(t, c)) for t, c in queries[first:first + SEARCHES]]
            scores = self.cosines(part)
            # k + 1 entries hold k examples even if one example is left out
            cut = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)].tolist() if scores.shape[1] > k + 1 else [0.0] * len(part)
            for i, (terms, q) in enumerate(part):
                slack = 1e-8 + (len(terms) + 8) * 2.0 ** -22         # twice what single precision can be off
                near = np.flatnonzero(scores[i] >= cut[i] - slack) if cut[i] > slack else np.flatnonzero(scores[i])
                out.append(self._exact(near, terms, q, k, skips[first + i] if skips else -1))
        return out

    def _exact(self, near: np.ndarray, terms: np.ndarray, q: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """The neighbours among the entries `near`; cosines are equal to nine digits."""
        weight = np.zeros(len(self.idf))
        weight[terms] = q
        n = self.begin[near + 1] - self.begin[near]
        ends = np.cumsum(n)
        read = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[near] - ends + n, n)
        scores = np.bincount(np.repeat(np.arange(len(near)), n), weights=weight[self.terms[read]] * self.weight[read], minlength=len(near)).round(9)
        found: list[tuple[float, int]] = []
        held = 0.0
        for i in np.lexsort((near, -scores)).tolist():
            s, e = float(scores[i]), int(near[i])
            if s < 1e-9 or held >= k and s < found[-1][0]:
                break
            found.append((s, e))
            held += self.n[e] - (e == skip)
        return found

    def vote(self, found: list[tuple[float, int]], skip: int = -1, skip_toxic: float = 0.0) -> float:
        w = y = 0.0
        for s, e in found:
            mine = e == skip
            w += s * (self.n[e] - mine)
            y += s * (self.toxic[e] - mine * skip_toxic)
        return (y + PRIOR * self.prior) / (w + PRIOR)

    def calibrate(self, vecs) -> None:
        """Isotonic regression (pool adjacent violators) of the label on leave-one-out votes."""
        points = []
        for i, found in enumerate(self.searches(vecs, skips=range(len(vecs)))):
            for y, m in ((1.0, self.toxic[i]), (0.0, self.n[i] - self.toxic[i])):
                if m > 0:
                    points.append((self.vote(found, i, y), y, m))
        pools: list[list[float]] = []  # [lowest vote, highest vote, weight, toxic weight]
        for v, y, m in sorted(points):
            pools.append([v, v, m, y * m])
            while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
                lo, _, a, b = pools.pop(-2)
                pools[-1] = [lo, pools[-1][1], pools[-1][2] + a, pools[-1][3] + b]
        if pools:
            x = [p for lo, hi, _, _ in pools for p in (lo, hi)]
            rate = [r for _, _, a, b in pools for r in [(b + PRIOR * self.prior) / (a + PRIOR)] * 2]
            self.steps = np.array(x), np.maximum.accumulate(rate)

    def score(self, terms, counts) -> tuple[float, list]:
        """The calibrated score of a vector and the smallest ids of its neighbours, nearest first."""
        return self.scores([(terms, counts)])[0]

    def scores(self, vecs) -> list[tuple[float, list]]:
        """`score` for each of `vecs`."""
        some = iter(self.searches([v for v in vecs if len(v[0])]))
        each = [next(some) if len(v[0]) else [] for v in vecs]
        return [(float(np.interp(self.vote(found), *self.steps)), [self.ids[e] for _, e in found[:K]]) if found
                else (float(self.empty_rate), []) for found in each]


# ------------------------------------------------------------------ fit and score

def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, fold: tuple[int, int] | None,
                  label_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(id, h, toxic): the labelled rows whose id's remainder is not the held-out one."""
    y = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).alias("toxic")).filter("id IS NOT NULL")
    if fold:
        y = y.filter(remainder(F.col("id"), fold[0]) != fold[1])
    d = docs.select(F.col(doc_id).alias("id"), common.text_hash(F.col(text)).alias("h"))
    return d.join(y, "id")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        fold: tuple[int, int] | None = (4, 2)) -> tuple[list[str], Index | None, DataFrame]:
    """Feature terms, index, and the vectors (id, h, terms, tfs) of all rows of `docs`;
    `fold` (folds, held-out remainder) keeps rows out of training."""
    rows = common.stage(training_rows(docs, labels, doc_id, text, fold), "labelled")
    # equal texts are one training text, toxic if at least half of its rows are
    one = rows.groupBy("h").agg(F.min("id").alias("id"), (F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic"))
    one = common.stage(one, "texts")
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), common.text_hash(F.col(text)).alias("h"))
    terms = feature_terms(d.join(common.bounded(one), ["id", "h"]))
    vecs = common.stage(vectors(d, terms), "vectors")
    if rows.limit(1).count() == 0:
        return terms, None, vecs
    n_docs = vecs.count()
    df = {r[0]: r[1] for r in document_frequencies(vecs).collect()}
    idf = np.array([math.log((n_docs + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(terms))])
    held = vecs.dropDuplicates(["id", "h"]).join(one, ["id", "h"]).groupBy("terms", "tfs").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("y"), F.min("id").alias("id"))
    held = common.stage(held, "entries")
    total = held.agg(F.sum("n"), F.sum("y")).first()
    empty = held.filter(F.size("terms") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    entries = held.filter(F.size("terms") > 0).orderBy(F.xxhash64("id"), "id").limit(MAX_EXAMPLES).collect()
    index = Index(idf, [(list(r[0]), list(r[1]), r[2], r[3], r[4]) for r in entries], total[1] / total[0], (empty[0], empty[1]))
    return terms, index, vecs


_MEMO: dict = {}


def score(vecs: DataFrame, index: Index | None) -> DataFrame:
    """(id, h, score, evidence) of every vector; evidence: ids of the nearest examples."""
    common.ship(vecs.sparkSession)
    shared = vecs.sparkSession.sparkContext.broadcast(index)
    key, id_type = uuid.uuid4().hex, vecs.schema["id"].dataType
    schema = T.StructType([vecs.schema["id"], vecs.schema["h"], T.StructField("score", T.DoubleType(), False),
                           T.StructField("evidence", T.ArrayType(id_type), False)])
    tasks = -(-vecs.count() // SCORE_ROWS)
    if tasks > vecs.rdd.getNumPartitions():
        vecs = vecs.repartition(tasks, "id", "h")

    def run(batches):
        from panelfx.llm import toxicity as here
        if here._MEMO.get("key") != key:
            here._MEMO.clear()
            here._MEMO.update(key=key, scores={}, size=0)
        held, index = here._MEMO, shared.value
        memo = held["scores"]
        for batch in (b.slice(i, 4 * SEARCHES) for b in batches for i in range(0, b.num_rows, 4 * SEARCHES)):
            vecs = [tuple(x.values.to_numpy(zero_copy_only=False) for x in v) for v in zip(batch.column(2), batch.column(3))]
            names_of = [terms.tobytes() + tfs.tobytes() for terms, tfs in vecs]
            got = {v: memo[v] for v in names_of if v in memo}
            new = {v: vec for v, vec in zip(names_of, vecs) if v not in got}
            got.update(zip(new, index.scores(list(new.values())) if index else [(0.0, [])] * len(new)))
            held["size"] += sum(len(v) + 500 for v in new)
            if held["size"] > MEMO_BYTES:
                memo.clear()
                held["size"] = 0
            memo.update((v, got[v]) for v in new)
            out = [got[v] for v in names_of]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([s for s, _ in out], pa.float64()),
                pa.array([e for _, e in out], pa.list_(arrow_type(id_type)))], names=schema.fieldNames())

    return vecs.select("id", "h", "terms", "tfs").mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    _, index, vecs = fit(docs, labels, doc_id, text)
    return score(vecs, index).select(
        F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows predicted toxic; every labelled row is learnt from."""
    _, index, vecs = fit(docs, labels, doc_id, text, fold=None)
    toxic = common.stage(score(vecs, index).filter(F.col("score") >= THRESHOLD).select("id", "h").distinct(), "toxic")
    return common.join_key(docs, doc_id, text, common.bounded(toxic), "left_anti")
