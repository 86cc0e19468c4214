"""Conversation structure repair by depth-first branch and bound.

A conversation's rows, in the order of their turns, are edited at least cost until their
role initials read ``(s?(ua)+)?``: keep (0), rerole to user or assistant (1), delete (2; blank
and duplicate rows must go), insert an empty user or assistant row (5); a truncated row that
stays adds 5. Of equally cheap edits the audit (initials of the edits, in order) that comes
first in ASCII is taken; it fixes the repaired rows.

Search. A node is (rows edited, state), the state being what was last emitted: nothing, s, u
or a. The search keeps an explicit stack of prefixes; a prefix goes if its cost and the bound
of its suffix exceed the incumbent (cost, audit), if they tie and its audit comes later, or if
the node's dominance table holds a prefix at least as good. The suffix bounds are the least costs
with which the remaining rows can reach a state when audits are left out, so the search
branches among equally cheap edits only; the empty stack proves the incumbent optimal.

Long conversations. Rows are sorted by range, so that a conversation with a third of all rows
is spread over many tasks, and each task cuts its stretch into segments of at most `SEGMENT`
rows and `SEGMENT_BYTES` of text. A segment is solved from every state it can be entered in to
every state it can be left in. Then each conversation's segments stream past in order: per
state the best (cost, audit) and the running SHA-256 of its repaired rows are carried on, so
a task holds one segment and the audits. Equal-cost audits of one node are never proper prefixes
of each other (the longer would hold more insertions and cost more), so choosing the least audit
by segment chooses the least as a whole.

Defined results. Nulls in any column read as one space (a blank text, a role that has to go or
be reroled); the order is by turn with nulls first, rows of one turn by role and text. Rows
repeated in full are duplicates; rows that share a turn only are rows of their own. A null
conv_id is a conversation like any other. An empty text is blank. A single text of any length is
a segment of its own at most. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEGMENT = 512
SEGMENT_BYTES = 4 << 20

START, S, U, A = range(4)               # what was emitted last
EMITS = {START: "u", S: "u", U: "a", A: "u"}
NEXT = {START: U, S: U, U: A, A: U}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINISH = {START: (0, ""), A: (0, ""), U: (INSERT, "I"), S: (2 * INSERT, "II")}
_FAR = 1 << 60
_SPACE = " \t\n\v\f\r"
_END = set(".!?")


def _moves(row: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that consume a row. A row is its role initial
    and its fault: b blank, d duplicate, t truncated, - none."""
    initial, fault = row[0], row[1]
    out = [("D", DELETE, state)]
    if fault in "bd":
        return out
    extra = TRUNCATED if fault == "t" else 0
    if state == START and initial == "s":
        out.append(("K", extra, S))
    if initial == EMITS[state]:
        out.append(("K", extra, NEXT[state]))
    else:
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def suffix_bounds(rows: list[str], target: int) -> list[list[int]]:
    """For each place and state the least cost of reaching `target` after the last row."""
    low = [[_FAR] * 4 for _ in range(len(rows) + 1)]
    low[-1][target] = 0
    for i in range(len(rows) - 1, -1, -1):
        use = [min(c + low[i + 1][to] for _, c, to in _moves(rows[i], s)) for s in range(4)]
        for s in range(4):                      # at most two insertions reach any state there is
            one, two = NEXT[s], NEXT[NEXT[s]]
            low[i][s] = min(use[s], INSERT + use[one], 2 * INSERT + use[two], _FAR)
    return low


def branch_and_bound(rows: list[str], entry: int, target: int) -> tuple[int, str] | None:
    """Least (cost, audit) of edits that lead from `entry` to `target`; None if none do."""
    low = suffix_bounds(rows, target)
    if low[0][entry] >= _FAR:
        return None
    incumbent: tuple[int, str] | None = None
    best: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if incumbent and (cost + low[i][state], audit) > (incumbent[0], incumbent[1][:len(audit)]):
            continue
        if (i, state) in best and best[i, state] < (cost, audit):
            continue
        if i == len(rows):
            if state == target and (incumbent is None or (cost, audit) < incumbent):
                incumbent = (cost, audit)
            continue
        nodes = [(i + 1, to, cost + c, audit + edit) for edit, c, to in _moves(rows[i], state)]
        nodes.append((i, NEXT[state], cost + INSERT, audit + "I"))
        for node in sorted(nodes, key=lambda x: x[3], reverse=True):        # the least audit on top
            j, to, c, text = node
            bound = c + low[j][to]
            if bound >= _FAR or incumbent and bound > incumbent[0]:
                continue
            if bound > cost + low[i][state]:        # dearer than the best this prefix can do
                continue
            if (j, to) not in best or (c, text) < best[j, to]:
                best[j, to] = (c, text)
                stack.append(node)
    return incumbent


@lru_cache(maxsize=1 << 16)
def solve(signature: str, entry: int) -> tuple[tuple[int, str] | None, ...]:
    """The best (cost, audit) from `entry` to each state; two letters a row."""
    rows = [signature[i:i + 2] for i in range(0, len(signature), 2)]
    return tuple(branch_and_bound(rows, entry, t) for t in range(4))


def apply_audit(audit: str, entry: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The rows (role, text) an audit leaves of a segment entered in `entry`, and the state after."""
    out, state, i = [], entry, 0
    for edit in audit:
        if edit == "I":
            out.append((ROLES[EMITS[state]], ""))
            state = NEXT[state]
            continue
        if edit != "D":
            keeps_s = edit == "K" and state == START and roles[i][:1] == "s"
            out.append((roles[i] if edit == "K" else ROLES[EMITS[state]], texts[i]))
            state = S if keeps_s else NEXT[state]
        i += 1
    return out, state


def damage(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with the contract's damage by crc32 of `conv_id:turn`:
    dropped rows keep only their conversation (gone = true), repeated rows occur twice."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    gone = kind == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(~gone, F.when(kind == 4, "user").otherwise(word("role"))).alias("role"),
        F.when(~gone, text).alias("text"), gone.alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


_SEGMENT = ("conv_id long, part int, seq int, n long, roles array<string>, texts array<string>, signature string, "
            "turns long, low_turn long, high_turn long, edges array<struct<entry int, state int, cost long, audit string>>")


def _segments(batches):
    """Sorted rows (conv_id, turn, role, text, gone, duplicate) to segments of one conversation."""
    from pyspark import TaskContext
    part, seq, conv, held, size = TaskContext.get().partitionId(), 0, None, [], 0
    began = False       # the held rows open their conversation; a task's first rows may continue one

    def segment():
        nonlocal seq
        rows = [r for r in held if not r[3]]
        signature = "".join((r[1][:1] or " ") + _fault(r) for r in rows)
        edges = [{"entry": e, "state": t, "cost": x[0], "audit": x[1]}
                 for e in ([START] if began else range(4)) for t, x in enumerate(solve(signature, e)) if x is not None]
        turns = [r[0] for r in rows if r[0] is not None]
        seq += 1
        return {"conv_id": conv, "part": part, "seq": seq, "n": len(rows), "roles": [r[1] for r in rows],
                "texts": [r[2] for r in rows], "signature": signature, "turns": len(set(turns)),
                "low_turn": min(turns, default=None), "high_turn": max(turns, default=None), "edges": edges}

    for b in batches:
        out = []
        cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for c, *row in zip(*cols):
            bytes_ = len(row[2] or "")
            if held and (c != conv or len(held) >= SEGMENT or size + bytes_ > SEGMENT_BYTES):
                out.append(segment())
                began, held, size = c != conv, [], 0
            conv = c
            held.append(row)
            size += bytes_
        if out:
            yield from pa.Table.from_pylist(out, schema=_arrow_segment()).to_batches()
    if held:
        yield from pa.Table.from_pylist([segment()], schema=_arrow_segment()).to_batches()


def _arrow_segment() -> pa.Schema:
    edge = pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    texts = pa.list_(pa.string())
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("roles", texts),
                      ("texts", texts), ("signature", pa.string()), ("turns", pa.int64()), ("low_turn", pa.int64()),
                      ("high_turn", pa.int64()), ("edges", pa.list_(edge))])


def _fault(row: list) -> str:
    text, duplicate = row[2].rstrip(_SPACE), row[4]
    return "b" if not text else "d" if duplicate else "-" if text[-1] in _END else "t"


_RESULT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                     ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                     ("repaired_sha256", pa.string()), ("rows_before", pa.int64()), ("rows_after", pa.int64()),
                     ("path", pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32()),
                                                  ("audit", pa.string()), ("before", pa.int64())])))])
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is carried along one conversation's segments."""

    def __init__(self):
        # state -> (cost, audit, hash of the repaired rows so far, their number, segments as a linked list)
        self.at = {START: (0, "", hashlib.sha256(), 0, None)}
        self.faults = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal = self.n = self.turns = 0
        self.last = self.low = self.high = None

    def add(self, g: dict) -> None:
        initials, marks = g["signature"][::2], g["signature"][1::2]
        for m in marks:
            self.faults[m] += 1
        if g["n"]:
            pairs = (self.last or "") + initials
            self.illegal += sum(pairs[i:i + 2] not in _LEGAL for i in range(len(pairs) - 1))
            self.last, self.n = initials[-1], self.n + g["n"]
        if g["turns"]:
            self.turns += g["turns"] - (g["low_turn"] == self.high)     # a turn may go on from the segment before
            self.low = g["low_turn"] if self.low is None else self.low
            self.high = g["high_turn"]
        chosen: dict[int, tuple[int, str, int, str]] = {}
        for e in g["edges"]:
            if e["entry"] in self.at:
                cost, audit = self.at[e["entry"]][:2]
                new = (cost + e["cost"], audit + e["audit"], e["entry"], e["audit"])
                if e["state"] not in chosen or new[:2] < chosen[e["state"]][:2]:
                    chosen[e["state"]] = new
        after = {}
        for state, (cost, audit, entry, part) in chosen.items():
            rows, _ = apply_audit(part, entry, g["roles"], g["texts"])
            _, _, sha, n, path = self.at[entry]
            step = (path, {"part": g["part"], "seq": g["seq"], "entry": entry, "audit": part, "before": n})
            after[state] = (cost, audit, *_hashed(sha, n, rows), step)
        self.at = after

    def result(self, conv: int | None) -> dict:
        cost, audit, state = min((x[0] + FINISH[s][0], x[1] + FINISH[s][1], s) for s, x in self.at.items())
        ends = {START: [], A: [], U: [("assistant", "")], S: [("user", ""), ("assistant", "")]}[state]
        _, _, sha, n, link = self.at[state]
        path = []
        while link is not None:
            link, step = link
            path.append(step)
        if path:
            path[0] = path[0] | {"audit": path[0]["audit"] + FINISH[state][1]}
        sha, n = _hashed(sha, n, ends)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": conv, "gaps": gaps, "blank": self.faults["b"], "duplicate": self.faults["d"],
                "truncated": self.faults["t"], "illegal": self.illegal, "cost": cost, "audit": audit,
                "repaired_sha256": sha.hexdigest(), "rows_before": self.n, "rows_after": n, "path": path[::-1]}


def _hashed(sha, n: int, rows: list[tuple[str, str]]):
    """A copy of `sha` that has read the newline-joined rows on from row number `n`."""
    sha = sha.copy()
    for role, text in rows:
        sha.update((("\n" if n else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        n += 1
    return sha, n


def _compose(batches):
    """Segments sorted by conversation to one row for each conversation."""
    conv, cur = None, None
    for b in batches:
        out = []
        for i in range(b.num_rows):                 # a segment at a time: texts are bounded by one
            g = b.slice(i, 1).to_pylist()[0]
            if cur is None or g["conv_id"] != conv:
                if cur is not None:
                    out.append(cur.result(conv))
                conv, cur = g["conv_id"], _Conversation()
            cur.add(g)
        if out:
            yield from pa.Table.from_pylist(out, schema=_RESULT).to_batches()
    if cur is not None:
        yield from pa.Table.from_pylist([cur.result(conv)], schema=_RESULT).to_batches()


_RESULT_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
               "repaired_sha256 string, rows_before long, rows_after long, "
               "path array<struct<part int, seq int, entry int, audit string, before long>>")
_ROW = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def segments(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows, sorted, their faults marked, cut into segments and each segment solved. Written.
    `rows` may hold a boolean `gone` (rows that only name their conversation) and a number `copy`
    that keeps repeated rows apart."""
    extra = [F.col(c) if c in rows.columns else F.lit(d).alias(c) for c, d in (("gone", False), ("copy", 0))]
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    slim = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                       space(role).alias("role"), space(text).alias("text"), *extra)
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy"))
    marked = common.stage(slim.withColumn("duplicate", ~F.col("gone") & (seen > 1)).drop("copy"), "turns")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "duplicate"]
    cut = marked.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("conv_id", "turn", "role", "text", "gone", "duplicate").mapInArrow(_segments, _SEGMENT)
    return common.stage(cut, "segments")


def repair(cut: DataFrame) -> DataFrame:
    """One row for each conversation of `segments`: its faults, least cost, audit, the SHA-256 of
    the repaired rows, and the path of (segment, entry state, audit) that gives them."""
    return cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_compose, _RESULT_DDL)


def repaired_rows(cut: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position from 0, role, text)."""
    steps = repaired.select(F.explode("path").alias("p")).select("p.*")
    joined = cut.select("conv_id", "part", "seq", "roles", "texts").join(steps, ["part", "seq"]) \
        .select("conv_id", "roles", "texts", "entry", "audit", "before")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                g = b.slice(i, 1).to_pylist()[0]
                rows, _ = apply_audit(g["audit"], g["entry"], g["roles"], g["texts"])
                out = [{"conv_id": g["conv_id"], "position": g["before"] + k, "role": r, "text": t} for k, (r, t) in enumerate(rows)]
                if out:
                    yield from pa.Table.from_pylist(out, schema=_ROW).to_batches()

    return joined.mapInArrow(run, "conv_id long, position long, role string, text string")
