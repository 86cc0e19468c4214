"""Benchmark decontamination (operator 6), DataFrame functions only.

Words of both sides are runs of ASCII digits, letters and non-ASCII characters after A-Z is
lower-cased. Every benchmark item is cut into windows of `window` consecutive words (an
item with fewer words is one window); the distinct windows are a hash table that is
broadcast if it has at most MAX_WINDOWS rows, and joined by a shuffle beyond that. Each
document is scanned once: its windows of the lengths the benchmark has are looked up by the
words themselves, so a hit is verified by equality, not by a hash.

Scale: the scan emits one row per window into the broadcast join and keeps only hits plus
one marker row per document (which carries the word count), so what is shuffled is the hits
and a few numbers per document. Where the windows are too many to broadcast, the markers
stay out of the join, and the windows are dealt by themselves and a salt, SALT ways, so a
window that a third of all documents hold is joined by many tasks. The pairs of window and
item are counted on their own before they are broadcast, as one window may belong to very
many items; beyond the bound they are salted too. No pairs of documents arise. Spans are
merged inside a document's own row, in one pass over its sorted hits.

Defined results. Null or empty text on either side: no words, no windows. Very long texts
are scanned whole. Repeated benchmark rows count once; a null item id counts as no item but
its windows still hit. Rows of `documents` that repeat in full each get the same result.
Empty tables: no hits. Overlapping or touching windows: the union of their words. Ties do
not arise. Only the named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
# Bound of the broadcast: so many windows of ten words are about 100 MB.
MAX_WINDOWS = 500_000
# Ways a window's rows are dealt where the windows are joined by a shuffle.
SALT = 16

# The letters that are lower-cased, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.filter(parts, lambda w: w != "")


# The words that sorted hits (found) cover.
COVERED = """array_sort(array_distinct(flatten(transform(found, (x, i) -> CASE
  WHEN i + 1 >= size(found) OR found[i + 1].e < x.e THEN sequence(x.s, x.e - 1)
  WHEN found[i + 1].s > x.s THEN sequence(x.s, least(x.e, found[i + 1].s) - 1)
  ELSE CAST(array() AS ARRAY<INT>) END))))"""


def _salted(many: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`many` joined to `table` on `key`, every key's rows of `many` dealt SALT ways."""
    left = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALT)).cast("int"))
    right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def _windows(words: str, n: str, length: int) -> Column:
    return F.expr(f"CASE WHEN {n} >= {length} THEN transform(sequence(1, {n} - {length} + 1), "
                  f"i -> array_join(slice({words}, i, {length}), ' ')) ELSE array() END")


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(window, len, item): the distinct windows of every item."""
    items = benchmark.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w"))
    items = items.withColumn("n", F.size("w")).filter("n > 0").withColumn("len", F.least("n", F.lit(window)))
    cut = items.select("item", "len", F.explode(F.expr(
        "transform(sequence(1, n - len + 1), i -> array_join(slice(w, i, len), ' '))")).alias("window"))
    return cut.distinct()


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct (id, text) of `docs`: id, h (hash of the text), n_rows, n_words,
    spans (array of start and end word, merged, ends exclusive), n_hit, items (ids as
    sorted strings)."""
    cut = common.stage(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    distinct = common.stage(
        cut.groupBy("window").agg(F.min("len").alias("len")).withColumn("wid", F.monotonically_increasing_id()), "wids")
    lengths = sorted(r[0] for r in distinct.select("len").distinct().collect())  # at most `window` values
    fits = distinct.count() <= MAX_WINDOWS

    d = docs.select(F.col(doc_id).alias("id"), common.text_hash(F.col(text)).alias("h"), words(F.col(text)).alias("w"))
    d = d.withColumn("n", F.size("w"))
    # element 0 is the marker that keeps the document; then its windows, length by length
    arrays = [F.expr("array(CAST(NULL AS STRING))")] + [_windows("w", "n", k) for k in lengths]
    rows = d.select("id", "h", "n", F.posexplode(F.concat(*arrays)).alias("p", "window"))
    table = distinct.select("window", "wid")
    if fits:
        rows = rows.join(F.broadcast(table), "window", "left").filter("p = 0 OR wid IS NOT NULL")
    else:
        marks = d.select("id", "h", "n", F.lit(0).alias("p"), F.lit(None).cast("string").alias("window"), F.lit(None).cast("long").alias("wid"))
        rows = _salted(rows.filter("p > 0"), table, "window").unionByName(marks)

    # position and length of a hit follow from its place in the concatenated arrays
    start = length = F.lit(None).cast("int")
    first = F.lit(1)
    for k in lengths:
        here = F.col("p") >= first
        start, length = F.when(here, F.col("p") - first).otherwise(start), F.when(here, F.lit(k)).otherwise(length)
        first = first + F.greatest(F.col("n") - k + 1, F.lit(0))
    hit = F.when(F.col("wid").isNotNull(), F.struct(start.alias("s"), (start + length).alias("e"), "wid"))
    per_doc = rows.groupBy("id", "h", "n").agg(
        F.sum(F.when(F.col("p") == 0, 1).otherwise(0)).alias("n_rows"),
        F.array_sort(F.collect_set(hit)).alias("found"))
    per_doc = common.stage(per_doc, "hits")

    # the covered words, each hit giving those before the next one starts where that one
    # reaches as far; a span is a run of consecutive covered words
    per_doc = per_doc.withColumn("covered", F.expr(COVERED))
    edge = "filter(covered, (w, i) -> i = {at} OR covered[i {step}] <> w {step})"
    merged = F.zip_with(F.expr(edge.format(at="0", step="- 1")), F.expr(edge.format(at="size(covered) - 1", step="+ 1")),
                        lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))
    wid_items = cut.join(F.broadcast(table), "window") if fits else _salted(cut, table, "window")
    wid_items = common.stage(wid_items.select("wid", F.col("item").cast("string").alias("item")), "wid-items")
    held = per_doc.filter(F.size("found") > 0).select(
        "id", "h", F.explode(F.array_distinct(F.expr("transform(found, x -> x.wid)"))).alias("wid"))
    held = held.join(F.broadcast(wid_items), "wid") if wid_items.count() <= MAX_WINDOWS else _salted(held, wid_items, "wid")
    held = held.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = per_doc.join(held, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    return out.select("id", "h", "n_rows", F.col("n").cast("long").alias("n_words"), merged.alias("spans"), F.size("covered").cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(docs, benchmark, doc_id, text, **kw)
    out = h.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                   F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                   (F.col("n_hit") > 0).alias("contaminated"), "n_rows")
    return out.withColumn("n_rows", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).drop("n_rows")


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents", doc_id: str = "doc_id",
           text: str = "text", **kw) -> DataFrame:
    """`docs` without its contaminated rows (what="documents"), or with the hit words and
    the gaps between them cut out of their texts (what="spans")."""
    found = hits(docs, benchmark, doc_id, text, **kw).filter("n_hit > 0")
    if what == "documents":
        return common.join_key(docs, doc_id, text, found.select("id", "h"), "left_anti")
    spans, gaps, kept, bounds = (common.free_name(docs, c) for c in ("__spans", "__gaps", "__words", "__bounds"))
    joined = common.join_key(docs, doc_id, text, found.select("id", "h", F.col("spans").alias(spans)), "left")
    hit = F.col(spans).isNotNull()
    joined = joined.withColumns({
        gaps: F.when(hit, F.split(F.col(text), WORD_ANY_CASE, -1)),
        kept: F.when(hit, F.regexp_extract_all(F.col(text), F.lit(f"({WORD_ANY_CASE})"), F.lit(1)))})
    joined = joined.withColumn(bounds, F.when(hit, F.concat(
        F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), F.col(spans),
        F.array(F.struct(F.size(kept).alias("s"), F.lit(0).alias("e"))))))
    new = F.when(hit, _stretches(F.col(gaps), F.col(kept), F.col(bounds))).otherwise(F.col(text))
    return joined.withColumn(text, new).select(*docs.columns)


def _stretches(gaps: Column, kept: Column, bounds: Column) -> Column:
    """The text between the spans: stretch k has the words from the end of bound k to the
    start of bound k + 1, the gap before each, and the gap before the span that follows."""
    def stretch(x, k):
        start, end = x["e"], F.get(bounds, k + 1)["s"]
        inner = F.zip_with(F.slice(gaps, start + 1, end - start), F.slice(kept, start + 1, end - start), lambda g, w: F.concat(g, w))
        return F.concat(F.array_join(inner, ""), F.get(gaps, end))

    return F.array_join(F.transform(F.slice(bounds, 1, F.size(bounds) - 1), stretch), "")
