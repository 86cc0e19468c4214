"""Conversation repair against a brute-force search over edit sequences."""

import hashlib
import heapq
import random
import zlib

import pytest

from panelfx.llm import queries, repair

SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def plain_damage(rows):
    out, every = [], {}
    for c, t, r, x in rows:
        every.setdefault(c, [])
        word = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        r, x = word(r), word(x)
        if kind == 0:
            continue
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    for row in out:
        every[row[0]].append(row)
    return every


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) by uniform-cost search
    over whole edit sequences, (cost, audit) ascending: the first finished one is the answer."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, r, x in rows:
        body = x.rstrip(SPACE)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((r, x))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def grows(text):        # prefixes of (s?(ua)+)?
        core = text[1:] if text[:1] == "s" else text
        return all(c == "ua"[i % 2] for i, c in enumerate(core))

    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, text, kept = heapq.heappop(queue)
        core = text[1:] if text[:1] == "s" else text
        if i == len(rows) and len(core) % 2 == 0 and (core or not text):
            out = "\n".join(f"{r}:{x}" for r, x in kept)
            return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(out.encode()).hexdigest())
        state = (i, text[:1] if len(text) < 2 else "", text[-1:], len(text) == 1)
        if state in done:
            continue
        done.add(state)
        nexts = [("I", 5, i, role) for role in ("user", "assistant")]
        if i < len(rows):
            nexts.append(("D", 2, i + 1, None))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                nexts += [("K", extra, i + 1, rows[i][2])] + [("R", 1 + extra, i + 1, role) for role in ("user", "assistant")]
        for edit, c, j, role in nexts:
            if role is None:
                heapq.heappush(queue, (cost + c, audit + edit, j, text, kept))
            elif role and grows(text + role[0]):
                heapq.heappush(queue, (cost + c, audit + edit, j, text + role[0], (*kept, (role, "" if edit == "I" else rows[i][3]))))


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    return {r.conv_id: tuple(r[c] for c in COLS) for r in df.collect()}


def test_registered_query_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(queries.QUERIES["op13_repair"](spark, SMALL))
    assert got == {c: plain_repair(v) for c, v in plain_damage(rows).items()}


KIND = "conv_id long, turn long, role string, text string, part int, gone_ string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(parts)


def noisy(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n // 9)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]),
             rng.choice(["Yes.", "No!", "cut", "", " ", None, "Why?", f"t{rng.randrange(9)}.", "end. \n"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_random_conversations(spark, seed):
    rows = noisy(400, seed)
    want = {c: plain_repair(v) for c, v in plain_damage(rows).items()}
    damaged = repair.damage(frame(spark, rows).select("conv_id", "turn", "role", "text"))
    cut = repair.segments(damaged)
    out = repair.repair(cut)
    assert results(out) == want
    lines = {}
    for r in sorted(repair.repaired_rows(cut, out).collect(), key=lambda r: (str(r.conv_id), r.position)):
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for c, v in want.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == v[-1]


def test_segments_compose_to_the_whole():
    """A signature solved in pieces, over all states between, equals it solved at once."""
    rng = random.Random(5)
    for _ in range(300):
        rows = [rng.choice("suat") + rng.choice("b-d--t") for _ in range(rng.randrange(1, 12))]
        at = {repair.START: (0, "")}
        for i in range(0, len(rows), 3):
            after = {}
            for e, (c, a) in at.items():
                for t, x in enumerate(repair.solve("".join(rows[i:i + 3]), e)):
                    if x:
                        after[t] = min(after.get(t, (1 << 60, "")), (c + x[0], a + x[1]))
            at = after
        whole = repair.solve("".join(rows), repair.START)
        assert at == {t: x for t, x in enumerate(whole) if x}


def test_one_long_conversation(spark):
    """A conversation of many segments, cut over several tasks, and one of huge texts."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"t{t}.", ""])) for t in range(700)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", "long " * 300_000 + str(t) + ".") for t in range(4)] + [(3, 0, "user", "a.")]
    segment, merge = repair.SEGMENT, "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(merge, "false")
        repair.SEGMENT = 40
        cut = repair.segments(frame(spark, rows, 5))
        assert cut.filter("conv_id = 1").select("part").distinct().count() > 1
        got = results(repair.repair(cut))
    finally:
        repair.SEGMENT = segment
        spark.conf.set(merge, "true")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: plain_repair(v) for c, v in by.items()}


def test_known_repairs(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."),      # one row too many
            (2, 0, "assistant", "x."), (2, 3, "user", "y"),                              # gap, truncated
            (3, 0, "system", "s."), (4, None, None, None)]
    got = results(repair.repair(repair.segments(frame(spark, rows))))
    assert got[1][:7] == (0, 0, 0, 0, 1, 2, "DKK")
    assert got[2][:7] == (2, 0, 0, 1, 0, 4, "DD")
    assert got[3][5:7] == (2, "D") and got[4][:7] == (0, 1, 0, 0, 0, 2, "D")
    assert got[4][7] == hashlib.sha256(b"").hexdigest()
    assert repair.repair(repair.segments(frame(spark, []))).collect() == []
