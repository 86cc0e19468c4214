"""Class-based n-gram scoring (operator 8).

Model: p(w | previous) = p(class(w) | class(previous)) * p(w | class(w)).

1. Word counts over all training texts (one aggregate, map-side combined). With them the items
   are known, and each training text is written once as the item numbers of its words, END
   between texts; all further counts are array work on that integer corpus.
2. Items: the WORDS most frequent words are items of their own; every other word, seen or
   not, belongs to the item of its last TAIL bytes, of which the ENDINGS most frequent are
   kept and the rest share one item. So every word has an item, and what the driver
   clusters is bounded whatever the data's size.
3. Item bigrams over all training texts (dense per task, one sparse aggregate), END between
   texts.
4. Exchange clustering of the items on the driver: each item moves to the class that
   raises the class-bigram likelihood most, until a sweep moves nothing (a warning tells
   if SWEEPS were not enough).
   Every further word that occurs FLOOR times or more then leaves its ending: its counts
   with the classes before and after it are aggregated in Spark, and it goes to the class
   with the largest gain, the same gain as in an exchange, the other words standing still.
   Class bigrams are counted anew with these words in their classes. Endings are left to
   rare and unseen words.
5. Emissions are smoothed by DELTA per word of the class and for one unseen word;
   transitions are interpolated with the class unigram by BACKOFF counts, which in turn is
   smoothed by one count a class.
6. Scoring: the HEAD most frequent words' counts are broadcast; the rest of a text's words
   are joined to the count table by a shuffle, as (text, word, times) rows.

Scale: the count table grows with the vocabulary and is never collected. What reaches the
driver is HEAD words, at most (items + 1)^2 bigram counts, and for each word over FLOOR a
64-bit key and two numbers (20 bytes, broadcast as 16; words whose keys collide share a
class), so the clustered vocabulary grows with the data.

Defined results. Null or empty text: END alone, scored after END. Rows that repeat: each
returned with the same result. Null ids: training rows (their remainder is unknown), not
held out. No training rows: counts are 0 and the model is uniform over the unseen word.
Ties in frequency: the smaller word first.
"""

from __future__ import annotations

import math
import uuid
import warnings
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORDS = 1_000      # frequent words that are clustered one by one
ENDINGS = 500      # endings that are clustered for all other words
TAIL = 3           # bytes of an ending
CLASSES = 64
SWEEPS = 200
FLOOR = 50         # a further word has a class of its own from so many occurrences on
HEAD = 100_000     # most frequent words whose counts are broadcast
DELTA = 0.5
BACKOFF = 5.0
MEMO = 100_000
SLICE_ROWS = 2_048  # texts at once, and their bytes: a slice's arrays take about 20 times these
SLICE_BYTES = 2 << 20
AROUND = 64        # further words whose neighbours' counts travel in one row
PAIRS = 1 << 20    # neighbours a task counts at once
CODES = 1 << 21    # distinct neighbours whose counts a task holds

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a column of texts (the empty string may be among them), and for every word
    of the column, in order, its place among them and its text: `words` for a whole slice at once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    enc, row = lists.flatten().dictionary_encode(), lists.value_parent_indices().to_numpy()
    kind = pa.large_binary() if pa.types.is_large_string(enc.dictionary.type) else pa.binary()
    ws, at = enc.dictionary.cast(kind).to_pylist(), enc.indices.to_numpy()
    if b"" in ws:               # white space at an end leaves an empty string there: it is no word
        some = at != ws.index(b"")
        at, row = at[some], row[some]
    return ws, at.astype(np.int64), row.astype(np.int64)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts."""
    common.ship(df.sparkSession)
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def merged(held):
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).select(["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for start, n in common.text_slices(batch.column(0), SLICE_ROWS, SLICE_BYTES):
                ws, at, _ = split(batch.column(0).slice(start, n))
                times = np.bincount(at, minlength=len(ws))
                held.append(pa.table([pa.array(ws, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"]).filter(pa.array(times > 0)))
                size += len(ws)
                if size > 300_000:
                    held = [merged(held)]
                    size = len(held[0])
                    if size > 150_000:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from merged(held).to_batches()

    return df.select(text).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ items

def word_keys(ws: list[bytes]) -> np.ndarray:
    """The words' XXH64 (seed 42), signed: what Spark's xxhash64 gives for them."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in ws], np.uint64).view(np.int64)


class Memo(dict):
    """Numbers of words: the given ones, and a bounded memory of those `many` has computed."""

    def __init__(self, fixed: dict[bytes, int]):
        super().__init__(fixed)
        self.added: list[bytes] = []

    def many(self, ws: list[bytes]) -> np.ndarray:
        raise NotImplementedError

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        s = np.fromiter(map(self.get, ws, repeat(-1)), np.int64, len(ws))
        open_ = np.flatnonzero(s < 0).tolist()
        if open_:
            new = list(dict.fromkeys([ws[i] for i in open_]))
            found = dict(zip(new, self.many(new).tolist()))
            s[open_] = [found[ws[i]] for i in open_]
            if len(self.added) > MEMO:
                for w in self.added:
                    del self[w]
                self.added = []
            keep = [w for w in new if len(w) <= 64]
            self.update((w, found[w]) for w in keep)
            self.added += keep
        return s

    def __missing__(self, word: bytes) -> int:
        return int(self.many([word])[0])


class Items(Memo):
    """Item number of a word: frequent words have their own, further words (`keys`, sorted)
    the numbers from `size` on, others that of their ending; 0 is END, 1 the item of all
    other endings."""

    def __init__(self, frequent: list[bytes], endings: list[bytes], keys: np.ndarray | None = None):
        super().__init__({w: 2 + i for i, w in enumerate(frequent)})
        self.endings = {e: 2 + len(frequent) + i for i, e in enumerate(endings)}
        self.size = 2 + len(frequent) + len(endings)
        self.keys = keys if keys is not None and len(keys) else None

    def found(self, ws: list[bytes]) -> np.ndarray:
        """The items of words, none of them remembered."""
        s = np.fromiter(map(self.get, ws, repeat(-1)), np.int64, len(ws))
        open_ = np.flatnonzero(s < 0)
        s[open_] = self.many([ws[i] for i in open_.tolist()])
        return s

    def many(self, ws: list[bytes]) -> np.ndarray:
        """The items of words that are not frequent."""
        out = np.array([self.endings.get(w[-TAIL:], 1) for w in ws], np.int64)
        if self.keys is not None:
            k = word_keys(ws)
            at = np.minimum(self.keys.searchsorted(k), len(self.keys) - 1)
            hit = self.keys[at] == k
            out[hit] = self.size + at[hit]
        return out


_TABLES: dict = {}     # a worker's one set of tables, that of the job it works for


def _worker_table(key: str, kind, args):
    if key not in _TABLES:
        _TABLES.clear()    # an earlier job's tables go before the new ones are built
        _TABLES[key] = kind(*args)
    return _TABLES[key]


def worker_items(key: str, frequent: list[bytes], endings: list[bytes], keys: np.ndarray | None = None) -> Items:
    return _worker_table(key, Items, (frequent, endings, keys))


def choose_items(counts: DataFrame, n_words: int = WORDS, n_endings: int = ENDINGS) -> tuple[list[bytes], list[bytes]]:
    frequent = [bytes(r[0]) for r in counts.orderBy(F.desc("n"), "word").limit(n_words).collect()]
    rest = counts.join(F.broadcast(_words_frame(counts, frequent)), "word", "left_anti")  # at most n_words rows are broadcast
    ends = rest.groupBy(_ending(F.col("word")).alias("e")).agg(F.sum("n").alias("n"))
    return frequent, [bytes(r[0]) for r in ends.orderBy(F.desc("n"), "e").limit(n_endings).collect()]


def _words_frame(counts: DataFrame, frequent: list[bytes]) -> DataFrame:
    return common.local_frame(counts.sparkSession, word=pa.array(frequent, pa.binary()))


def _endings_frame(counts: DataFrame, frequent: list[bytes], endings: list[bytes]) -> DataFrame:
    first = 2 + len(frequent)
    return common.local_frame(counts.sparkSession, e=pa.array(endings, pa.binary()), item=pa.array(range(first, first + len(endings)), pa.int32()))


def _ending(word: Column) -> Column:
    return F.when(F.octet_length(word) <= TAIL, word).otherwise(F.substring(word, -TAIL, TAIL))


def corpus(df: DataFrame, frequent: list[bytes], endings: list[bytes], keys: np.ndarray, text: str = "text") -> DataFrame:
    """The texts as item numbers, written: each row a slice of texts as int32, END (0) before, between
    and after them."""
    shared = df.sparkSession.sparkContext.broadcast((frequent, endings, keys))
    key = uuid.uuid4().hex

    def run(batches):
        from panelfx.llm import brown as here
        item = here.worker_items(key, *shared.value)
        for batch in batches:
            for start, n in common.text_slices(batch.column(0), SLICE_ROWS, SLICE_BYTES):
                _, ids, _, _ = here.laid_out(item, batch.column(0).slice(start, n), 0)
                ids = np.concatenate([np.zeros(1, np.int32), ids.astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["ids"])

    return common.stage(df.select(text).mapInArrow(run, "ids binary"), "corpus")


def laid_out(memo: Memo, texts: pa.Array, end: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the numbers of the texts' words with `end` after each text, and
    for every word its place among the distinct ones and its text."""
    ws, at, row = split(texts)
    out = np.full(len(at) + len(texts), end, np.int64)
    out[np.arange(len(at)) + row] = memo.numbers(ws)[at]
    return ws, out, at, row


def bigrams(ids: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbours over the corpus `ids`, each number taken as `of` it (below `size`)."""
    shared = ids.sparkSession.sparkContext.broadcast(of.astype(np.int32))
    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        of, total, held, n = shared.value, np.zeros(size * size, np.int64), [], 0
        for batch in batches:
            for cell in batch.column(0):
                s = of[np.frombuffer(cell.as_buffer(), np.int32)].astype(np.int64)
                held.append(s[:-1] * size + s[1:])
                n += len(s)
                if n > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=size * size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size * size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(total[at[i:i + 100_000]])], names=["pair", "n"])

    got = ids.mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    if got.num_rows:
        out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


# ------------------------------------------------------------------ exchange clustering

def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item. Item 0 (END) is class 0 and stays; the others start by rank
    of their frequency and move, one at a time, to the class with the largest gain in the
    likelihood of the class bigrams; the smaller class of equals."""
    size = len(n)
    total = n.sum(0) + n.sum(1)
    order = [int(i) for i in np.argsort(-total, kind="stable") if i != 0]
    classes = max(2, min(classes, size))
    of = np.zeros(size, np.int64)
    for rank, i in enumerate(order):
        of[i] = 1 + rank % (classes - 1)
    member = np.eye(classes)[of]                     # items x classes
    before, after = n.T @ member, n @ member         # counts with the classes before and after each item
    N = member.T @ n @ member
    L, R = N.sum(1), N.sum(0)
    moves = 0
    for _ in range(sweeps):
        moves = 0
        for w in order:
            if total[w] == 0:
                continue
            a, self_n = of[w], n[w, w]
            wl, wr = before[w].copy(), after[w].copy()
            wl[a] -= self_n
            wr[a] -= self_n
            # counts without w
            N[:, a] -= wl
            N[a, :] -= wr
            N[a, a] -= self_n
            out_n, in_n = wr.sum() + self_n, wl.sum() + self_n
            L[a] -= out_n
            R[a] -= in_n
            L -= wl
            R -= wr
            fN, diag = _f(N), np.diag(N)
            gain = (_f(N + wl[:, None]) - fN).sum(0) + (_f(N + wr[None, :]) - fN).sum(1)
            gain += _f(diag + wl + wr + self_n) - _f(diag + wl) - _f(diag + wr) + _f(diag)
            # row and column totals: those of w's neighbours' classes come back whatever its class
            L2, R2 = L + wl, R + wr
            gain -= _f(L2 + out_n) - _f(L2) + _f(R2 + in_n) - _f(R2)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            N[:, b] += wl
            N[b, :] += wr
            N[b, b] += self_n
            L, R = L2, R2
            L[b] += out_n
            R[b] += in_n
            if b != a:
                moves += 1
                of[w] = b
                before[:, a] -= n[w, :]
                before[:, b] += n[w, :]
                after[:, a] -= n[:, w]
                after[:, b] += n[:, w]
        if moves == 0:
            break
    if moves:
        warnings.warn(f"exchange clustering: the last of {sweeps} sweeps moved {moves} items")
    return of


def likelihood(n: np.ndarray, of: np.ndarray) -> float:
    """What exchange() raises: sum f(N) - sum f(L) - sum f(R) of the class bigrams."""
    member = np.eye(of.max() + 1)[of]
    N = member.T @ n @ member
    return float(_f(N).sum() - _f(N.sum(1)).sum() - _f(N.sum(0)).sum())


# ------------------------------------------------------------------ further words

def further_words(counts: DataFrame, frequent: list[bytes], endings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words over FLOOR that are not frequent, and their endings' items."""
    ends = _endings_frame(counts, frequent, endings)
    rest = counts.filter(F.col("n") >= FLOOR).join(F.broadcast(_words_frame(counts, frequent)), "word", "left_anti").withColumn("e", _ending(F.col("word")))
    got = rest.join(F.broadcast(ends), "e", "left").select(F.xxhash64("word").alias("key"), F.coalesce("item", F.lit(1)).alias("item")) \
        .groupBy("key").agg(F.min("item").alias("item")).toArrow()
    keys, items = got.column("key").to_numpy().astype(np.int64), got.column("item").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], items[order]


def best_class(N: np.ndarray, a: int, wl: np.ndarray, wr: np.ndarray, self_n: float) -> int:
    """The class a word of class `a` goes to: that with the largest gain in the likelihood
    of the class bigrams `N`, as in exchange(); `wl` and `wr` count the classes before and
    after it without pairs of the word with itself."""
    N = N.copy()
    N[:, a] -= wl
    N[a, :] -= wr
    N[a, a] -= self_n
    L, R = N.sum(1), N.sum(0)
    out_n, in_n = wr.sum() + self_n, wl.sum() + self_n
    fN, diag = _f(N), np.diag(N)
    gain = (_f(N + wl[:, None]) - fN).sum(0) + (_f(N + wr[None, :]) - fN).sum(1)
    gain += _f(diag + wl + wr + self_n) - _f(diag + wl) - _f(diag + wr) + _f(diag)
    L, R = L + wl, R + wr
    gain -= _f(L + out_n) - _f(L) + _f(R + in_n) - _f(R)
    gain[0] = -np.inf
    b = int(gain.argmax())
    return a if gain[b] <= gain[a] + 1e-9 else b


def _around(ids: DataFrame, cls: np.ndarray, size: int, classes: int) -> DataFrame:
    """(block, codes, n): what stands around the further words (items from `size` on) of each block of
    AROUND of them, as sorted codes and their counts. The code of word j of a block is
    j * (2 * classes + 1) plus the class before it, or classes plus the class after it, or
    2 * classes for a pair of the word with itself."""
    shared = ids.sparkSession.sparkContext.broadcast(cls.astype(np.int32))

    def run(batches):
        from panelfx.llm import brown as here
        cells = (np.frombuffer(cell.as_buffer(), np.int32) for batch in batches for cell in batch.column(0))
        yield from here.around_batches(cells, shared.value, size, classes)

    return ids.mapInArrow(run, "block long, codes binary, n binary")


def around_batches(cells, cls: np.ndarray, size: int, classes: int):
    """The batches of `_around` of one task. PAIRS neighbours are counted at once and added to the counts
    held; past CODES of these they are sent, so a task's memory does not grow with its cells."""
    width = 2 * classes + 1
    per = AROUND * width
    codes, n = np.empty(0, np.int64), np.empty(0, np.int64)

    def batch_of():
        block, first = np.unique(codes // per, return_index=True)
        last = np.append(first[1:], len(codes))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, last)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(block), cut((codes % per).astype(np.uint32)), cut(n.astype(np.uint32))],
                                          names=["block", "codes", "n"])

    for cell in cells:
        for at in range(0, max(len(cell) - 1, 0), PAIRS):
            x, y = cell[at:at + PAIRS + 1][:-1], cell[at + 1:at + PAIRS + 1]
            fx, fy, same = x >= size, y >= size, (x == y) & (x >= size)
            before, after = fy & ~same, fx & ~same
            new, times = np.unique(np.concatenate([
                (x[same].astype(np.int64) - size) * width + 2 * classes,
                (y[before].astype(np.int64) - size) * width + cls[x[before]],
                (x[after].astype(np.int64) - size) * width + classes + cls[y[after]]]), return_counts=True)
            place = codes.searchsorted(new)
            held = np.zeros(len(new), bool)
            inside = place < len(codes)
            held[inside] = codes[place[inside]] == new[inside]
            n[place[held]] += times[held]
            codes, n = np.insert(codes, place[~held], new[~held]), np.insert(n, place[~held], times[~held])
            if len(codes) > CODES:
                yield batch_of()
                codes, n = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(codes):
        yield batch_of()


def assign(ids: DataFrame, cls: np.ndarray, N: np.ndarray, size: int) -> np.ndarray:
    """The class of each further word of the corpus `ids`: `cls` gives the present class of every item
    and further word, N their bigrams, `size` the number of items. A block's rows stream past and
    are summed; no task holds more than one block's counts."""
    classes, start = len(N), cls[size:].astype(np.int64)
    width = 2 * classes + 1
    shared = ids.sparkSession.sparkContext.broadcast((N, start))
    schema = T.StructType([T.StructField("j", T.LongType()), T.StructField("class", T.IntegerType())])

    def run(batches):
        from panelfx.llm import brown as here
        N, start = shared.value
        block, total = None, np.zeros((AROUND, width))

        def chosen():
            js = np.flatnonzero(total.any(axis=1)) + block * AROUND
            best = [here.best_class(N, int(start[j]), v[:classes], v[classes:-1], v[-1]) for j, v in zip(js, total[js - block * AROUND])]
            return pa.RecordBatch.from_arrays([pa.array(js, pa.int64()), pa.array(best, pa.int32())], names=["j", "class"])

        for batch in batches:
            for b, codes, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != block:
                    if block is not None:
                        yield chosen()
                    block, total = b, np.zeros((AROUND, width))
                total.reshape(-1)[np.frombuffer(codes.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
        if block is not None:
            yield chosen()

    got = _around(ids, cls, size, classes).repartition("block").sortWithinPartitions("block").mapInArrow(run, schema).toArrow()
    start[got.column("j").to_numpy()] = got.column("class").to_numpy()
    return start


# ------------------------------------------------------------------ fit and score

class Model:
    """A fitted model's bounded tables; `counts` is the word count table (a written frame)."""

    def __init__(self, **kw):
        self.__dict__.update(kw)


def fit(train: DataFrame, text: str = "text") -> Model:
    """Fit the model on all rows of `train`."""
    common.small_batches(train.sparkSession)
    counts = common.stage(word_counts(train, text), "counts")
    n_docs = train.count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent, endings = choose_items(counts)
    keys, end_item = further_words(counts, frequent, endings)
    ids = corpus(train, frequent, endings, keys, text)
    size = 2 + len(frequent) + len(endings)
    n = bigrams(ids, np.concatenate([np.arange(size), end_item]), size)
    of = exchange(n)
    classes = int(of.max()) + 1
    member = np.eye(classes)[of]
    N = member.T @ n @ member
    cls = of
    if len(keys):
        cls = np.concatenate([of, assign(ids, np.concatenate([of, of[end_item]]), N, size)])
        N = bigrams(ids, cls, classes)

    # words and occurrences of each class: endings on the JVM, frequent words known here
    item_of_end = _endings_frame(counts, frequent, endings)
    rest = counts.join(F.broadcast(_words_frame(counts, frequent)), "word", "left_anti").withColumn("e", _ending(F.col("word")))
    by_item = rest.join(F.broadcast(item_of_end), "e", "left").groupBy(F.coalesce("item", F.lit(1)).alias("item")).agg(
        F.count(F.lit(1)).alias("types")).collect()
    types = np.zeros(len(of))
    types[2:2 + len(frequent)] = 1
    for r in by_item:
        types[r["item"]] = r["types"]
    types[0] = 1  # END
    N_c, V_c = N.sum(0), np.bincount(of, types, classes)  # every token follows one
    # further words count in their own classes, no longer in their endings'
    V_c += np.bincount(cls[len(of):], minlength=classes) - (np.bincount(of[end_item], minlength=classes) if len(keys) else 0)
    uni = (N_c + 1) / (N_c.sum() + classes)
    trans = (N + BACKOFF * uni[None, :]) / (N.sum(1)[:, None] + BACKOFF)
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    head = list(zip(head["word"].to_pylist(), head["n"].to_pylist()))
    return Model(counts=counts, n_tokens=n_words + n_docs, n_types=v_words + (1 if n_docs else 0), n_docs=n_docs, frequent=frequent,
                 endings=endings, keys=keys, of=cls, log_trans=np.log10(trans), log_room=np.log10(N_c + DELTA * (V_c + 1)), head=head)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, n_known, base_score (unigram), score (model)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    d = docs.select(F.col(doc_id).alias("id"), common.text_hash(F.col(text)).alias("h"), F.col(text).alias("text"))
    key = uuid.uuid4().hex
    tables = spark.sparkContext.broadcast((model.frequent, model.endings, model.keys, model.of, model.log_trans, model.log_room,
                                           model.head, model.n_tokens, model.n_types, model.n_docs))
    id_type = d.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("h", T.LongType()), T.StructField("word", T.BinaryType()),
        T.StructField("times", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType())])
    names = schema.fieldNames()

    def run(batches):
        from panelfx.llm import brown as here
        scorer = here.worker_scorer(key, tables.value)
        for batch in batches:
            for start, n in common.text_slices(batch.column(2), SLICE_ROWS, SLICE_BYTES):
                part = batch.slice(start, n)
                row, tail, times, stats = scorer.run(part.column(2))
                m = len(tail)
                at = np.concatenate([np.array(row, np.int64), np.arange(n)])
                ids, h = part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))
                # a text's own row has a word no text has (it starts with a space), which
                # spreads these rows evenly over the join's partitions
                marks = [b" " + str(x).encode() for x in part.column(1).to_pylist()]
                zero, zerof = np.zeros(m, np.int64), np.zeros(m)
                yield pa.RecordBatch.from_arrays([
                    ids, h, pa.array(tail + marks, pa.binary()), pa.array(np.concatenate([np.array(times, np.int64), np.zeros(n, np.int64)])),
                    pa.array(np.concatenate([zero, np.ones(n, np.int64)])), pa.array(np.concatenate([zero, stats[0]])),
                    pa.array(np.concatenate([zero, stats[1]])), pa.array(np.concatenate([zerof, stats[2]])),
                    pa.array(np.concatenate([zerof, stats[3]]))], names=names)

    rows = d.mapInArrow(run, schema).join(model.counts.withColumnRenamed("n", "c"), "word", "left")
    room = math.log10(model.n_tokens + model.n_types + 1)
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    out = rows.groupBy("id", "h").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        F.sum(F.col("known") + F.when(c > 0, times).otherwise(0)).alias("known"),
        F.sum(F.col("base") + times * (F.log10(c + 1) - room)).alias("base"),
        F.sum(F.col("model") + times * F.log10(c + DELTA)).alias("model"))
    # rows that repeat in full were summed into one
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    each = lambda name, kind: (F.col(name) / F.col("rows")).cast(kind)
    return out.select(F.col("id").alias("doc_id"), each("n", "long").alias("n_tokens"), each("known", "long").alias("n_known"),
                      each("base", "double").alias("base_score"), each("model", "double").alias("score"))


class Scorer:
    """Scores of texts as far as the broadcast tables tell; words outside the head are
    returned for the join, with their share of the model score left open."""

    def __init__(self, frequent, endings, keys, of, log_trans, log_room, head, n_tokens, n_types, n_docs):
        self.items = Items(frequent, endings, keys)
        self.of, self.log_trans, self.log_room = of, log_trans, log_room
        self.room = math.log10(n_tokens + n_types + 1)
        heads = [w for w, _ in head]
        c = np.array([n for _, n in head] + [0] * (int(of.max()) + 1) + [n_docs], float)
        self.end = len(c) - 1
        self.n_head = len(heads)
        cls = np.concatenate([of[self.items.found(heads)] if heads else np.empty(0, np.int64),
                              np.arange(int(of.max()) + 1), [0]]).astype(np.int64)
        is_head = np.zeros(len(c), bool)
        is_head[:self.n_head] = True
        is_head[self.end] = True
        self.cls = cls
        self.known = (is_head & (c > 0)).astype(np.int64)
        self.base = np.where(is_head, np.log10(c + 1) - self.room, 0.0)
        self.model = np.where(is_head, np.log10(c + DELTA), 0.0) - log_room[cls]
        self.slots = Slots(self.items, of, heads)

    def run(self, texts: pa.Array):
        """(row, word, times) of words outside the head, and per text: tokens, known, base, model."""
        ws, s, at, row = laid_out(self.slots, texts, self.end)
        n = len(texts)
        size = np.bincount(row, minlength=n) + 1
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        far = s[np.arange(len(at)) + row] >= self.n_head                 # words outside the head
        pair, times = np.unique(row[far] * max(len(ws), 1) + at[far], return_counts=True)
        rows, word = pair // max(len(ws), 1), pair % max(len(ws), 1)
        cls = self.cls[s]
        prev = np.empty_like(cls)
        prev[1:] = cls[:-1]
        prev[starts] = 0
        per = lambda x: np.add.reduceat(x, starts)
        return rows, [ws[i] for i in word.tolist()], times, (size, per(self.known[s]), per(self.base[s]), per(self.model[s] + self.log_trans[prev, cls]))


class Slots(Memo):
    """Where a word's numbers stand in the scorer's tables: its place in the head, or the
    place of its class behind the head."""

    def __init__(self, items: Items, of: np.ndarray, heads: list[bytes]):
        super().__init__({w: i for i, w in enumerate(heads)})
        self.items, self.of, self.n_head = items, of, len(heads)

    def many(self, ws: list[bytes]) -> np.ndarray:
        return self.n_head + self.of[self.items.found(ws)]     # remembered here, not there as well


def worker_scorer(key: str, tables) -> Scorer:
    return _worker_table(key, Scorer, tables)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: tuple[int, int] = (7, 2)) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the
    model learns from rows whose id's CRC-32 remainder is not the held-out one."""
    out_of = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))
    model = fit(docs.filter(~out_of).select(text), text)
    scored = score(docs, model, doc_id, text)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
