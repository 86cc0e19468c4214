"""Token counts by the whole-token shortcut (operator 3).

A byte-level BPE vocabulary is read from its file (vocabulary, merges, added tokens).
``whole_tokens`` proves, before any text is read, which vocabulary strings encode alone as
exactly one token: it runs the merges on each string. Counting a text then needs no merges
for a pre-token in that set, and merges (memoised per distinct pre-token) for the rest.

The tables are bounded by the vocabulary, not by the data, and broadcast once. The memo of
a worker is cleared when it holds MEMO entries.

Defined results. Null or empty text: 0 tokens, 0 bytes. Rows that repeat: each returned.
An added token's string inside a text counts as that one token. Texts are never cut: one
very long run of letters is merged with a heap in n log n.
"""

from __future__ import annotations

import heapq
import json
import uuid

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LIMIT = 512       # over_limit: more tokens than this
MEMO = 400_000    # distinct pre-tokens a worker remembers
SHORT = 48        # bytes of a pre-token that is merged by scanning
NONE = 1 << 60    # rank of a pair that no merge joins


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    if it is a visible Latin-1 character, else the next free character from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out = {b: chr(b) for b in visible}
    free = 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Bpe:
    """Merges of one vocabulary, over token ids. Plain data, so Spark can broadcast it.

    `ranks` maps a pair of ids (the left one shifted by 32 bits) to the merge's rank,
    `merged` a rank to the id it makes, `bytes_id` a byte to its id.
    """

    def __init__(self, ranks: dict[int, int], merged: list[int], bytes_id: list[int], vocab: dict[bytes, int],
                 added: tuple[str, ...]):
        self.ranks, self.merged, self.bytes_id, self.vocab, self.added = ranks, merged, bytes_id, vocab, added

    @classmethod
    def from_json(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE without normalizer is needed")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only the plain byte-level pre-tokenizer is supported")
        symbols, ids = byte_symbols(), spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(symbols)}
        added = tuple(t["content"] for t in spec.get("added_tokens", []))
        ranks, merged = {}, []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[ids[a] << 32 | ids[b]] = rank
            merged.append(ids[a + b])
        vocab = {bytes(back[c] for c in s): i for s, i in ids.items() if s not in added}
        return cls(ranks, merged, [ids[c] for c in symbols], vocab, added)

    def merge(self, data: bytes) -> list[int]:
        """The token ids of one pre-token: the lowest-ranked neighbouring pair is merged
        first, the leftmost of equals, until no pair has a rank."""
        parts = list(map(self.bytes_id.__getitem__, data))
        return self._by_scan(parts) if len(parts) <= SHORT else self._by_heap(parts)

    def _by_scan(self, parts: list[int]) -> list[int]:
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            new = parts[i] = merged[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], NONE)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        n, get, gone = len(parts), self.ranks.get, -1
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if (r := get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one side has been merged meanwhile
            new = parts[i] = self.merged[rank]
            parts[j] = gone
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                if (r := get(new << 32 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, new, parts[k]))
            h = prev[i]
            if h >= 0 and (r := get(parts[h] << 32 | new)) is not None:
                heapq.heappush(heap, (r, h, parts[h], new))
        return [p for p in parts if p != gone]

    def whole_tokens(self) -> frozenset[str]:
        """The vocabulary strings that are valid text, form a single pre-token, and that
        the merges turn into exactly their own token."""
        pattern = regex.compile(PATTERN)
        out = []
        for token, own in self.vocab.items():
            try:
                s = token.decode()
            except UnicodeDecodeError:
                continue
            if pattern.fullmatch(s) and self.merge(token) == [own]:
                out.append(s)
        return frozenset(out)


class Memo(dict):
    """Token count of a pre-token: 1 for the proven ones, merged once for any other."""

    def __init__(self, bpe: Bpe, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.bpe, self.whole = bpe, whole

    def __missing__(self, piece: str) -> int:
        n = len(self.bpe.merge(piece.encode()))
        if len(self) >= MEMO:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(piece) <= 64:
            self[piece] = n
        return n


def counter(bpe: Bpe, whole: frozenset[str]):
    """A function that counts the tokens of one whole text."""
    memo = Memo(bpe, whole)
    pieces = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(bpe.added, key=len, reverse=True)))) if bpe.added else None

    def count(text: str | None) -> int:
        if not text:
            return 0
        if special is None or special.search(text) is None:
            return sum(map(memo.__getitem__, pieces(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(memo.__getitem__, pieces(p))) for p in parts)

    return count


_COUNTERS: dict = {}  # of this worker, by call: a reused worker keeps its memo


def token_counts(df: DataFrame, vocab_path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`df` without `text`, plus n_bytes, n_tokens and over_limit of every whole text.
    `vocab_path` is read on the driver only; its tables are broadcast."""
    bpe = Bpe.from_json(vocab_path)
    tables = df.sparkSession.sparkContext.broadcast((bpe, bpe.whole_tokens()))
    key = uuid.uuid4().hex
    fields = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False),
              T.StructField("over_limit", T.BooleanType(), False)]

    def fn(texts):
        from panelfx.llm import tokens as here
        count = here._COUNTERS.get(key)
        if count is None:
            here._COUNTERS.clear()
            count = here._COUNTERS[key] = here.counter(*tables.value)
        n = [count(t) for t in texts]
        return [pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([k > limit for k in n], pa.bool_())]

    return common.map_texts(df, text, fields, fn)
