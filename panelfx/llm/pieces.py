"""SentencePiece encoding and decoding (operator 4).

Pieces and log scores are read from a published model file. They are laid out as a
double-array trie over UTF-8 bytes; a Unigram Viterbi over it finds the segmentation with
the highest total score. White space is written as the marker U+2581, with one marker put
before the text if the model asks for it. A character that no piece covers becomes its
byte pieces. Decoding joins the pieces, turns byte pieces back into characters, markers
into spaces, and drops the marker put before the text.

No piece of these vocabularies holds a marker after another character (checked when the
model is read), so the best segmentation of a text is the best one of each run of markers
with the letters after it; runs are memoised per worker up to MEMO entries.

The trie is bounded by the vocabulary, built once on the driver and broadcast.

Defined results. Null text: null ids, no pieces. Empty text: no ids. Ties between
segmentations: the one whose last piece is longest, and so on towards the front. Rows that
repeat: each returned. Invalid byte sequences while decoding: one U+FFFD per byte.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

MARK = "▁"
UNKNOWN_PENALTY = 10.0   # an uncovered character scores so far below the lowest piece
MEMO = 600_000           # runs a worker remembers, about 200 bytes each

# Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_model(path: str) -> dict:
    """Pieces (text, score, kind) and the settings that matter, from a model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normalizer are supported")
    return {"pieces": [(p.piece, p.score, p.type) for p in m.pieces], "prefix": m.normalizer_spec.add_dummy_prefix}


class DoubleArray:
    """A double-array trie over bytes: from state s, byte c leads to base[s] + c + 1 if
    check there is s; `value` holds the piece id of a state, -1 without one."""

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for w, i in words.items():
            at = tree
            for c in w:
                at = at.setdefault(c, {})
            at[None] = i
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        todo, low = [(0, tree)], 1
        while todo:
            state, node = todo.pop()
            value[state] = node.get(None, -1)
            codes = sorted(c for c in node if c is not None)
            if not codes:
                continue
            offsets = np.array(codes) + 1
            b = max(low - int(offsets[0]), 0)
            while True:  # the first base where every child's cell is free
                if b + 4096 + 257 >= len(used):
                    grow = len(used)
                    base, value = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([value, np.full(grow, -1, np.int32)])
                    check, used = np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([used, np.zeros(grow, bool)])
                free = ~used[b + offsets[0]:b + offsets[0] + 4096]
                for o in offsets[1:]:
                    free &= ~used[b + o:b + o + 4096]
                hit = int(free.argmax())
                if free[hit]:
                    b += hit
                    break
                b += 4096
            base[state] = b
            for c, o in zip(codes, offsets):
                used[b + o] = True
                check[b + o] = state
                todo.append((int(b + o), node[c]))
            while used[low]:
                low += 1
        end = int(np.flatnonzero(used)[-1]) + 258
        self.base, self.check, self.value = base[:end].tolist(), check[:end].tolist(), value[:end].tolist()


class Unigram:
    """Encoder and decoder of one model. Plain data, so Spark can broadcast it."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece holds a marker after another character")
        self.prefix = model["prefix"]
        self.scores = [s for _, s, _ in pieces]
        self.trie = DoubleArray(normal)
        byte = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [byte.get(f"<0x{b:02X}>") for b in range(256)] if byte else None
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.unknown_score = min((pieces[i][1] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.is_byte = [kind == BYTE for _, _, kind in pieces]
        # what an id adds to a score: its piece's score; for bytes, the penalty of their
        # character once, at its first byte
        lead = {i for b, i in enumerate(self.byte_ids) if b & 0xC0 != 0x80} if self.byte_ids else set()
        self.adds = [(self.unknown_score if i in lead else 0.0) if kind == BYTE else self.unknown_score if kind == UNKNOWN else s
                     for i, (_, s, kind) in enumerate(pieces)]
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
                        else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
                        for p, _, kind in pieces]

    def segment(self, word: str) -> tuple[list[int], float]:
        """The best segmentation of a run, and its score."""
        data = word.encode()
        n = len(data)
        base, check, value, scores, unknown = self.trie.base, self.trie.check, self.trie.value, self.scores, self.unknown_score
        best, back, piece = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            first = data[i]
            char_end = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            here, state, end, covered = best[i], 0, i, False
            while end < n:
                to = base[state] + data[end] + 1
                if check[to] != state:
                    break
                state = to
                end += 1
                v = value[to]
                if v >= 0:
                    if end == char_end:
                        covered = True
                    s = here + scores[v]
                    if s > best[end]:
                        best[end] = s
                        back[end] = i
                        piece[end] = v
            if not covered and here + unknown > best[char_end]:
                best[char_end], back[char_end], piece[char_end] = here + unknown, i, -1
            i = char_end
        out, at = [], n
        while at > 0:
            v, start = piece[at], back[at]
            if v >= 0:
                out.append(v)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(data[start:at]))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = start
        return out[::-1], best[n]

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _decode_bytewise(raw)


def _decode_bytewise(raw: bytes) -> str:
    """UTF-8 with one U+FFFD per byte that belongs to no valid character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class Memo(dict):
    """The ids of a run, as int32 bytes, found once per worker."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model = model
        self.adds = np.array(model.adds)
        self.is_byte = np.array(model.is_byte)

    def __missing__(self, run: str) -> bytes:
        ids = array("i", self.model.segment(run)[0]).tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(run) <= 64:
            self[run] = ids
        return ids


RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_MODELS: dict = {}


def encode_text(memo: Memo, text: str) -> tuple[np.ndarray, float]:
    ids = np.frombuffer(b"".join(map(memo.__getitem__, RUNS.findall(memo.model.normalize(text)))), np.int32)
    return ids, float(memo.adds[ids].sum())


FIELDS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType(), False),
          T.StructField("n_bytes", T.LongType(), False), T.StructField("score", T.DoubleType(), False),
          T.StructField("round_trip", T.BooleanType(), False)]


def _coder(df: DataFrame, model_path: str):
    """A function for tasks that gives the worker's memo of this call's model."""
    common.ship(df.sparkSession)
    common.small_batches(df.sparkSession)
    tables = df.sparkSession.sparkContext.broadcast(Unigram(read_model(model_path)))
    key = uuid.uuid4().hex

    def memo():
        from panelfx.llm import pieces as here
        if key not in here._MODELS:
            here._MODELS.clear()
            here._MODELS[key] = here.Memo(tables.value)
        return here._MODELS[key]

    return memo


def encode(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None,
           names: dict[str, str] | None = None, keep_text: bool = False) -> DataFrame:
    """`df` plus ids, n_pieces, n_bytes (byte pieces among them), score, and round_trip
    (the ids decode to the text), for every whole text. `names` renames new columns."""
    memo = _coder(df, model_path)
    df = df.select(*(keep or [c for c in df.columns if c != text]), *([text] if text not in (keep or []) else []))
    names = names or {}
    fields = [T.StructField(names.get(f.name, f.name), f.dataType, f.nullable) for f in FIELDS]

    def fn(texts):
        m = memo()
        parts, sizes, rows = [], [0], []
        for t in texts:
            ids, score = encode_text(m, t) if t else (np.empty(0, np.int32), 0.0)
            parts.append(ids)
            sizes.append(sizes[-1] + len(ids))
            back = m.model.decode(ids.tolist())
            rows.append((len(ids), int(m.is_byte[ids].sum()), score, back == (t or "")))
        flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
        nulls = pa.array([t is None for t in texts]) if any(t is None for t in texts) else None
        ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=nulls)
        n, b, s, r = zip(*rows)
        return [ids, pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array(r, pa.bool_())]

    return (common.append_texts if keep_text else common.map_texts)(df, text, fields, fn)


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` plus the text of each row's ids (null for null)."""
    memo = _coder(df, model_path)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])
    at = df.columns.index(ids)
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            m = memo()
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [None if x is None else m.model.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(run, schema)
