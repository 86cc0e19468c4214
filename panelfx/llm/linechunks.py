"""Line dedup by content-defined chunks (operator 9).

A text is cut at its newlines; every line is hashed, and a rolling hash over the last
`window` line hashes closes a chunk after a line where it is divisible by `divisor`. A long
line (`long_words` words or more) is a chunk of its own. Boundaries depend on nearby lines
only, so a passage that is shifted or embedded in another document is cut at the same
places. Chunks of at least two lines with a word, and long lines, are looked for in all
documents; every occurrence after the first (smallest id, then text hash, then place) is
removed once its bytes have been compared with the first one's.

Grown (`grow`, as `dedup` does): where a chunk ends depends on the line before it, so the
lines at both ends of a shared passage, and chunks of one short line, can stay. Every two
neighbouring lines with a word are looked for as well: each run of at least two repeated
lines goes whole, wherever the chunks end, with the wordless lines it encloses. An
occurrence that overlaps the first one stays, and the first occurrence of every line does.

Scale: a slim row per chunk (digest, key, place) is aggregated to the first and last place
of each digest; digests with two places are repeated. Texts travel only for repeated
chunks, as the first occurrence's text to the documents that may lose it; each document
compares its own bytes. A chunk that a third of all documents hold is a partial aggregate
per task, and its text is salted: one copy for every SALT_ROWS documents. Past the bound of
a broadcast, the digests most occurrences have are broadcast and only the rest is shuffled.

Defined results. Null text: stays null, no lines. Empty text: one empty line, kept. Null id:
an id like any other, after all of them. Very long text: cut and compared whole. Ties: of
equal chunks the first place of the first document stays. Rows that repeat in full are one
document: both lose, or both keep, a chunk. Lines keep their own bytes, carriage returns
included. Columns of `docs` with the names of the counts: kept, the counts' names are
lengthened. Empty table: empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 2        # line hashes under the rolling hash
DIVISOR = 2       # a chunk ends after one line in so many
LONG_WORDS = 50   # a line of so many words is a chunk of its own
BASE, PRIME = 31, 1_000_003
SALT_ROWS = 256   # documents that get a repeated chunk's text from one copy of it
HOT_ROWS = 10_000  # occurrences from which on a digest may be kept out of a shuffle by digest

SPACES = b" \t\n\v\f\r"


def line_hash(line: bytes) -> int:
    """The first 15 hexadecimal digits of the line's MD5, modulo PRIME."""
    return int(hashlib.md5(line).hexdigest()[:15], 16) % PRIME


def chunk_ends(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> list[int]:
    """The ends (exclusive) of the chunks of a text's lines."""
    long = [len(ln) >= 2 * long_words - 1 and len(ln.split()) >= long_words for ln in lines]
    hashes = [line_hash(ln) for ln in lines]
    ends, n = [], len(lines)
    for i in range(n):
        rolling = 0
        for h in hashes[max(0, i + 1 - window):i + 1]:
            rolling = rolling * BASE + h
        if rolling % divisor == 0 or long[i] or i + 1 == n or long[i + 1]:
            ends.append(i + 1)
    return ends


def chunks(text: str | None, long_words: int = LONG_WORDS, **kw) -> list[tuple[int, int, bytes, bool]]:
    """(first line, end line, bytes, looked for) of every chunk of a text."""
    if text is None:
        return []
    lines = text.encode().split(b"\n")
    out, start = [], 0
    for end in chunk_ends(lines, long_words=long_words, **kw):
        body = b"\n".join(lines[start:end])
        eligible = bool(body.strip(SPACES)) if end - start > 1 else len(body.split()) >= long_words
        out.append((start, end, body, eligible))
        start = end
    return out


def spans(text: str | None, grow: bool = False, **kw) -> dict[int, tuple[int, int, bytes]]:
    """(first line, end line, bytes) of all that is looked for in a text, by place: twice
    the first line, plus one for two lines."""
    every = chunks(text, **kw)
    out = {2 * a + (b - a == 2): (a, b, body) for a, b, body, eligible in every if eligible}
    if grow and every:
        lines = text.encode().split(b"\n")
        word = [bool(ln.strip(SPACES)) for ln in lines]
        out |= {2 * i + 1: (i, i + 2, lines[i] + b"\n" + lines[i + 1]) for i in range(len(lines) - 1) if word[i] or word[i + 1]}
    return out


def _repeated(occ: DataFrame, first: DataFrame) -> DataFrame:
    """The occurrences of the digests of `first`, with its columns. Where `first` is too large
    to broadcast, its most frequent digests still are: those with over HOT_ROWS occurrences and
    over one in BROADCAST_ROWS of all, so never more than BROADCAST_ROWS of them. The shuffle
    join sees the others alone."""
    rows = common.BROADCAST_ROWS
    if first.count() <= rows:
        return occ.join(F.broadcast(first), "digest")
    hot = F.col("n") > max(HOT_ROWS, occ.count() // rows)
    often = F.broadcast(common.stage(first.filter(hot), "often"))
    rare = occ.join(often.select("digest"), "digest", "left_anti").join(first.filter(~hot), "digest")
    return occ.join(often, "digest").unionByName(rare)


STATS = ("n_lines", "n_chunks", "n_cut_lines", "n_cut_chunks")


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grow: bool = False, **kw) -> DataFrame:
    """(id, h, drop): for each document with candidates, an array of (place, text) of the
    first occurrences' texts its spans at those places have to equal to be removed."""
    d = docs.select(F.col(doc_id).alias("id"), common.text_hash(F.col(text)).alias("h"), F.col(text).alias("text"))
    fields = [T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("place", T.IntegerType()), T.StructField("digest", T.BinaryType())])), False)]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.binary())]))

    def digests(texts):
        return [pa.array([[{"place": i, "digest": hashlib.md5(c[2]).digest()} for i, c in spans(t, grow, **kw).items()]
                          for t in texts], kind)]

    occ = common.map_texts(d, "text", fields, digests).select("id", "h", F.explode("found").alias("c"))
    occ = common.stage(occ.select("id", "h", "c.place", "c.digest"), "chunks")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "place")
    first = occ.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    first = first.filter("first <> last").select(
        "digest", F.col("first.id").alias("f_id"), F.col("first.h").alias("f_h"), F.col("first.place").alias("f_place"),
        F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"), "n")
    first = common.stage(first, "first")

    # the first occurrences' own texts, cut out of their documents
    wanted = common.stage(first.groupBy("f_id", "f_h").agg(F.collect_set("f_place").alias("places")), "wanted")
    owners = d.join(common.bounded(wanted), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")))
    owners = owners.select("text", "places")
    cut = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("body", T.BinaryType())])

    def bodies(batches):
        for batch in batches:
            for t, places in zip(batch.column(0), batch.column(1)):
                every = spans(t.as_py(), grow, **kw)
                got = [every[p][2] for p in places.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(b).digest() for b in got], pa.binary()),
                                                  pa.array(got, pa.binary())], names=["digest", "body"])

    body = owners.mapInArrow(bodies, cut).dropDuplicates(["digest"])
    later = _repeated(occ, first).filter(
        ~(F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
          & ((F.col("place") == F.col("f_place")) | ((F.col("place") % 2 == 1) & (F.col("place") - F.col("f_place") == 2)))))
    # a document that repeats a chunk needs its text once, with all its places
    later = later.groupBy("id", "h", "digest").agg(F.collect_set("place").alias("places"), F.first("salts").alias("salts"))
    # a chunk that very many documents hold is dealt to salted copies of its text
    later = later.withColumn("salt", F.expr("cast(pmod(xxhash64(id, h), salts) as int)")).drop("salts")
    body = body.join(common.bounded(first.select("digest", "salts")), "digest").withColumn(
        "salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts")
    return later.join(body, ["digest", "salt"]).groupBy("id", "h").agg(F.collect_list(F.struct("places", "body")).alias("drop"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grow: bool = False, **kw) -> DataFrame:
    """`docs` with repeated chunks removed from `text`, plus four long columns (STATS, their
    names lengthened where `docs` has them): the lines and chunks of the text, and those
    removed."""
    drop = removals(docs, doc_id, text, grow, **kw).withColumnRenamed("drop", common.free_name(docs, "__drop"))
    joined = common.join_key(docs, doc_id, text, drop, "left")
    schema = T.StructType(docs.schema.fields + [T.StructField(common.free_name(docs, c), T.LongType()) for c in STATS])
    names = schema.fieldNames()
    text_at, n_cols = docs.columns.index(text), len(docs.columns)

    def run(batches):
        for batch in batches:
            for start, n in common.text_slices(batch.column(text_at)):
                part = batch.slice(start, n)
                new = [one(t, d) for t, d in zip(part.column(text_at).to_pylist(), part.column(n_cols).to_pylist())]
                cols = [part.column(i) for i in range(n_cols)]
                cols[text_at] = pa.array([r[0] for r in new], part.schema.field(text_at).type)
                cols += [pa.array([r[k] for r in new], pa.int64()) for k in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def one(t, drop):
        if t is None:
            return None, 0, 0, 0, 0
        if not drop:
            return t, t.count("\n") + 1, len(chunks(t, **kw)), 0, 0
        every, looked, lines = chunks(t, **kw), spans(t, grow, **kw), t.encode().split(b"\n")
        gone = set()
        for x in drop:
            for a, b, body in map(looked.__getitem__, x["places"]):
                if body == x["body"]:  # the comparison of bytes
                    gone.update(range(a, b))
        if grow:
            last = None  # the last line with a word or removed
            for i, ln in enumerate(lines):
                if i in gone or ln.strip(SPACES):
                    if i in gone and last in gone:
                        gone.update(range(last + 1, i))
                    last = i
        left = b"\n".join(ln for i, ln in enumerate(lines) if i not in gone).decode()
        return left, len(lines), len(every), len(gone), sum(all(i in gone for i in range(c[0], c[1])) for c in every)

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per row: doc_id, n_lines, n_chunks, n_cut_lines, n_cut_chunks, clean_md5."""
    out = clean(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **kw)
    return out.select("doc_id", *STATS, F.md5(F.col("text").cast("binary")).alias("clean_md5"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """`docs` with cleaned texts, repeated runs of lines grown to their ends; rows that had
    words and lost all of them are dropped."""
    out = clean(docs, doc_id, text, grow=True, **kw)
    left = F.translate(F.col(text), SPACES.decode(), "") != ""
    return out.filter((F.col(common.free_name(docs, STATS[2])) == 0) | left).select(*docs.columns)
