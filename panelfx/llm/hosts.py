"""Quality rules at host level (operator 10).

``signals`` measures every document, ``failures`` applies named rules to the signals, and
``host_rates`` counts the failures of every rule by host and shrinks each host's rate
towards the corpus rate of that rule, with a beta prior fitted to the hosts themselves (the
analysis-of-variance estimate of the beta-binomial's intra-class correlation).
``host_verdicts`` reads two verdicts from the shrunk rates:

* rejected: the host's rate of base failures is over `max_rate`; all its documents go.
* watched for a rule: its rate of that rule is over `watch_rate`; documents that fail the
  rule go. Elsewhere one such failure is taken for chance, and the document stays.

The base rules (too short, repeated windows) reject a document whatever its host.

Scale: failures are pre-aggregated map-side to one row per host, so a host with a third of
all rows is one row per task in the shuffle. Verdicts travel back by broadcast if the hosts
are few. Beyond that, hosts with more than 1 / BROADCAST_ROWS of the documents (so fewer
than BROADCAST_ROWS of them) are broadcast, and only the others' documents are shuffled.

Defined results. Null or empty text: no words, counts 0, base_failed true. Very long texts
are measured whole, one at a time. Null host: a host of its own. Empty table: empty result.
Rows that repeat are each counted and each returned. Ties do not arise: every verdict
depends on a host's counts alone. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The characters that count as symbols, and the six ASCII white space bytes.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

WINDOW = 8              # words in a window that may repeat
MIN_WORDS = 20          # fewer words fail
MAX_REPEAT_PCT = 30     # a larger share of words in repeated windows fails
MAX_SYMBOL_PCT = 10     # more symbols per 100 words fail
MAX_DUP_LINE_PCT = 5    # more repeated lines per 100 words fail
WORD_CHARS = (2, 12)    # a mean word length outside fails
MAX_HOST_RATE = 0.5     # a host whose shrunk rate of base failures is over this is rejected
WATCH_RATE = 0.05       # a host whose shrunk rate of a rule is over this is watched for it

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a `window`-word window found at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, n)
    np.add(ends, 1, out=ends)
    ends = np.cumsum(ends) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    slices = starmap(slice, zip(starts[:n - window + 1].tolist(), ends[window - 1:].tolist()))
    grams = list(map(joined.__getitem__, slices))
    if len(set(grams)) == len(grams):
        return 0
    first: dict[bytes, int] = {}
    cover = np.zeros(n + 1, np.int32)
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            cover[j] += 1
            cover[min(j + window, n)] -= 1
            cover[i] += 1
            cover[min(i + window, n)] -= 1
    return int((np.cumsum(cover[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five signals of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    filled = [ln for ln in text.split("\n") if ln.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(filled) - len(set(filled)), repeat_words(words))


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without `text`, plus the five signals of every whole text."""
    fields = [T.StructField(s, T.LongType(), False) for s in SIGNALS]

    def fn(texts):
        rows = [measure(t) for t in texts]
        return [pa.array(list(col), pa.int64()) for col in zip(*rows)]

    return common.map_texts(df, text, fields, fn)


def base_failed(min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT):
    """The per-document rules over the signal columns."""
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_pct) * F.col("n_words"))


# The rules that count against a host and reject a document only where its host is watched.
WATCHED = ["symbols", "dup_lines", "word_chars"]


def failures() -> dict:
    """The named rules over the signal columns: base_failed, and one column per rule of WATCHED."""
    low, high = WORD_CHARS
    words = F.col("n_words")
    return {"base_failed": base_failed(),
            "fails_symbols": F.lit(100) * F.col("n_symbols") > F.lit(MAX_SYMBOL_PCT) * words,
            "fails_dup_lines": F.lit(100) * F.col("n_dup_lines") > F.lit(MAX_DUP_LINE_PCT) * words,
            "fails_word_chars": (F.col("word_chars") < low * words) | (F.col("word_chars") > high * words)}


def host_rates(df: DataFrame, host: str, rules: str | list[str]) -> DataFrame:
    """One row per host and rule (a Boolean column of `df`): n_docs, n_failed, the rule's
    prior (prior_a, prior_b), shrunk_rate.

    A rule's prior is fitted over all hosts in one aggregate. With one host, with a single
    document each, or without more spread between hosts than chance gives, the intra-class
    correlation is held to [1e-6, 1 - 1e-6], so that the prior stays proper.
    """
    rules = [rules] if isinstance(rules, str) else rules
    hosts = df.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"failed_{i}") for i, r in enumerate(rules)])
    hosts = hosts.select("host", "n_docs", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"failed_{i}").alias("n_failed")) for i, r in enumerate(rules)])).alias("r"))
    hosts = common.stage(hosts.select("host", "r.rule", "n_docs", "r.n_failed"), "host-counts")
    x, n = F.col("n_failed").cast("double"), F.col("n_docs").cast("double")
    fit = hosts.groupBy(F.col("rule").alias("fit_rule")).agg(
        F.sum(n).alias("N"), F.sum(x).alias("X"), F.count(F.lit(1)).cast("double").alias("H"), F.sum(n * n).alias("nn"),
        F.sum(x * x / n).alias("xx"))
    # sum n(p-m)^2 = xx - X^2/N ; sum n p(1-p) = X - xx
    fit = fit.withColumns({
        "m": F.expr("X / N"),
        "msb": F.expr("CASE WHEN H > 1 THEN greatest(xx - X * X / N, 0D) / (H - 1) ELSE 0D END"),
        "msw": F.expr("CASE WHEN N > H THEN greatest(X - xx, 0D) / (N - H) ELSE 0D END"),
        "n0": F.expr("CASE WHEN H > 1 THEN (N - nn / N) / (H - 1) ELSE 1D END")})
    fit = fit.withColumn("spread", F.expr("msb + (n0 - 1) * msw"))
    fit = fit.withColumn("rho", F.expr(
        "CASE WHEN spread > 0 THEN least(greatest((msb - msw) / spread, 1e-6D), 1 - 1e-6D) ELSE 1e-6D END"))
    fit = fit.select("fit_rule", F.expr("m * (1 - rho) / rho").alias("prior_a"), F.expr("(1 - m) * (1 - rho) / rho").alias("prior_b"))
    out = hosts.join(F.broadcast(fit), F.col("rule") == F.col("fit_rule")).drop("fit_rule")  # one row per rule
    return out.withColumn("shrunk_rate", F.expr("(n_failed + prior_a) / (n_docs + prior_a + prior_b)"))


def host_verdicts(rates: DataFrame, max_rate: float = MAX_HOST_RATE, watch_rate: float = WATCH_RATE) -> DataFrame:
    """One row per host: n_docs, host_rejected, and watched_<rule> per rule of WATCHED."""
    def over(rule, rate):
        return F.max((F.col("rule") == rule) & (F.col("shrunk_rate") > rate))

    return rates.groupBy("host").agg(F.max("n_docs").alias("n_docs"), over("base_failed", max_rate).alias("host_rejected"),
                                     *[over(f"fails_{r}", watch_rate).alias(f"watched_{r}") for r in WATCHED])


def apply_host_verdicts(df: DataFrame, verdicts: DataFrame, host: str = "host") -> DataFrame:
    """`df` (with the columns of ``failures``) plus host_rejected, watched_<rule> and kept."""
    verdicts = common.stage(verdicts.withColumnRenamed("host", "__host"), "hosts")
    same = F.col(host).eqNullSafe(F.col("__host"))
    side = verdicts.drop("n_docs")
    if verdicts.count() <= common.BROADCAST_ROWS:
        out = df.join(F.broadcast(side), same, "left")
    else:
        total = verdicts.agg(F.sum("n_docs")).first()[0]
        big = verdicts.filter(F.col("n_docs") * common.BROADCAST_ROWS > total).drop("n_docs")  # fewer than BROADCAST_ROWS hosts
        first = df.join(F.broadcast(big), same, "left")
        rest = first.filter("host_rejected IS NULL").select(*df.columns).join(side, same, "left")
        out = first.filter("host_rejected IS NOT NULL").unionByName(rest)
    bad = F.col("base_failed") | F.col("host_rejected")
    for r in WATCHED:
        bad = bad | (F.col(f"fails_{r}") & F.col(f"watched_{r}"))
    return out.drop("__host").withColumn("kept", ~bad)


def host_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
               max_rate: float = MAX_HOST_RATE, watch_rate: float = WATCH_RATE) -> DataFrame:
    """Per document: its id and host, the signals, base_failed and fails_<rule>,
    host_rejected and watched_<rule>, kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured = signals(slim).withColumns(failures())
    measured = common.stage(measured, "signals")  # read by the host rates and by the join back
    return apply_host_verdicts(measured, host_verdicts(host_rates(measured, "host", list(failures())), max_rate, watch_rate))
