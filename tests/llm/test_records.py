"""WARC round trips and assembly, chat linking."""

import base64
import hashlib
import io
import json
import math
import random

import pytest

from panelfx.llm import chat, common, warc

PAGES = "page_id long, url string, html string, record_id string, type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(2)


def test_round_trip(spark):
    same = "<p>same</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a/", same), (2, "http://b/\r\nX: y", "own é你"), (9, None, same), (5, "http://c/", same), (3, "u", None),
            (4, "u", ""), (None, "n", "null id"), (7, "d", "twice"), (7, "d", "twice"), (8, "e", "x" * 100_000)]
    got = sorted(warc.round_trip(pages(spark, rows), common.shared_path(spark, "t")).collect(), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max((j for j, _, k in rows if (k or "") == (h or "") and j is not None), default=None)
        first = last is None or i == last
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    small = warc.round_trip(pages(spark, rows), common.shared_path(spark, "t"), min_bytes=10).collect()
    assert {r.page_id: r.record_type for r in small}[3] == "response"
    assert warc.round_trip(pages(spark, []), common.shared_path(spark, "t")).collect() == []


def test_records_keep_payloads(spark):
    path = common.shared_path(spark, "t")
    warc.write(pages(spark, [(1, "http://a/", "line\r\n\r\nend"), (2, "http://b/", "é")]), path)
    rows = warc.read_records(spark, path).collect()
    assert {r.payload for r in rows if r.type == "response"} == {"line\r\n\r\nend", "é"}
    assert sorted(r.type for r in rows) == ["metadata"] * 2 + ["request"] * 2 + ["response"] * 2


def test_archives_are_bounded_in_bytes(spark):
    """Pages of very different sizes: no archive passes the bound unless one page alone does."""
    import gzip as gz
    from pathlib import Path
    sizes = [0, 10, 16_384, 16_385, 70_000, 300_000, 1_500_000, 17_000_000] + [60_000] * 9
    rows = [(i, f"http://{i}/", chr(97 + i) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).coalesce(1)
    path = common.shared_path(spark, "t")
    warc.write(df, path, archive_bytes=200_000)
    files = [len(gz.decompress(f.read_bytes())) for f in Path(path.removeprefix("file:")).rglob("*.gz")]
    assert len(files) >= 8 and sorted(f for f in files if f > 220_000) == sorted(f for f in files if f >= 300_000)
    got = {r.payload_digest: r.payload_bytes for r in warc.read_records(spark, path, payload=False).collect() if r.type == "response"}
    assert sorted(got.values()) == sorted(sizes)
    assert [warc.records_per_file(k) for k in range(warc.CLASSES)] == [12_288, 3_072, 768, 192, 48, 12, 3]
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(df, common.shared_path(spark, "t")).collect()} == dict(enumerate(sizes))


def test_parser_refuses_truncated_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n12345"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record)))
    assert list(warc.parse(io.BytesIO(b""))) == []


def record(rid, kind, to=()):
    return (rid, kind, "u", list(to), None, None, 1, f"page-id: {rid}", None)


def test_assembly_follows_pointers(spark):
    rows = [record("r1", "response", ["q1"]), record("q1", "request"), record("m1", "metadata", ["q1"]),   # backwards, then a chain
            record("r2", "revisit"), record("q2", "request", ["r2"]), record("q3", "request", ["r2"]), record("m2", "metadata", ["r2", "r1"]),
            record("x", "metadata", ["nowhere"]), record("c1", "metadata", ["c2"]), record("c2", "metadata", ["c1"]), record("r3", "response"),
            record("r3", "response")]
    df = common.stage(spark.createDataFrame(rows, warc.RECORD), "t")
    got = {r.capture.record_id: r for r in warc.assemble(df).collect()}
    assert got["r1"].request.record_id == "q1" and got["r1"].metadata.record_id == "m1" and got["r1"].n_metadata == 2
    assert got["r2"].n_requests == 2 and got["r2"].request.record_id == "q2" and got["r2"].metadata.record_id == "m2"
    assert got["r3"].request is None and got["r3"].n_copies == 2 and len(got) == 3
    assert {r.record_id for r in warc.orphans(df).collect()} == {"x", "c1", "c2"}


# ------------------------------------------------------------------ chat

CALLS = "conv long, pos long, call_id string, name string, arguments string, needs array<string>"
RESULTS = "conv long, pos long, call_id string, content string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number", "minimum": 0}, "s": {"type": "string", "pattern": "^x"}},
                   "additionalProperties": False}}


def test_canonical_json():
    assert chat.canonical(chat.parse('{"b": [1.0, 1e30, 1e-7, 0.000001, 333333333.33333329, -0.0], "a\\u20ac": "\\u000f\\n\\"", "\\ud83d\\ude02": true, "\\ufb33": null}')) \
        == '{"a€":"\\u000f\\n\\"","b":[1,1e+30,1e-7,0.000001,333333333.3333333,0],"\U0001f602":true,"דּ":null}'
    rng = random.Random(4)
    for _ in range(500):
        x = rng.uniform(-1, 1) * 10 ** rng.randrange(-25, 25)
        assert float(chat._number(x)) == x and math.isclose(json.loads(chat.canonical(x)), x)
    for bad in ('{"a":1,"a":2}', "NaN", "", None, "{"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_schema_rules():
    s = SCHEMAS["add"]
    assert chat.violations({"a": 1, "s": "xy"}, s) == []
    assert chat.violations({"a": -1, "s": "y", "z": 0}, s) == ["$.a: minimum", "$.s: pattern", "$.z: unknown"]
    assert chat.violations({}, s) == ["$.a: missing"] and chat.violations([], s) == ["$: not object"]
    assert chat.violations({"a": True}, s) == ["$.a: not number"]
    assert chat.violations(["a", 2], {"items": {"enum": ["a"]}, "maxItems": 1}) == ["$: maxItems", "$[1]: not in enum"]


def run(spark, calls, results):
    c, r = spark.createDataFrame(calls, CALLS).repartition(2), spark.createDataFrame(results, RESULTS).repartition(2)
    return chat.tool_calls(c, r, SCHEMAS).collect()


def test_linking(spark):
    calls = [(1, 0, "a", "add", '{"a": 2.50}', None), (1, 4, "a", "add", '{"a": 9}', None), (1, 2, "b", "none", "{}", ["a"]),
             (1, 3, None, "add", "[]", None), (None, 0, "n", "add", "no json", ["gone"]), (2, 0, "a", None, None, None)]
    results = [(1, 1, "a", "first"), (1, 5, "a", "second"), (3, 0, "z", None), (None, 1, "n", "of null"), (1, 7, None, "alone")]
    got = {(r.conv, r.call_id, r.status): r for r in run(spark, calls, results)}
    a = got[1, "a", "linked"]
    assert a.n_calls == 2 and a.n_results == 2 and a.valid
    assert a.json == '{"call":{"arguments":{"a":2.5},"id":"a","name":"add","needs":[],"turn":0},"result":{"content":"first","id":"a","turn":1}}'
    assert got[1, "b", "unanswered"].errors == "$: no schema for none"
    assert got[None, "n", "linked"].errors == "$: not JSON; needs: missing"
    assert got[3, "z", "orphan"].json == '{"call":null,"result":{"content":null,"id":"z","turn":0}}'
    assert not got[2, "a", "unanswered"].valid
    assert sorted(r.status for r in run(spark, calls, results)) == ["linked", "linked", "no_id", "no_id", "orphan", "unanswered", "unanswered"]
    assert run(spark, [], []) == []


def test_topological_order(spark):
    rng = random.Random(9)
    calls, edges = [], {}
    for conv in range(6):
        names = [f"c{i}" for i in range(12)]
        rank = names[:]
        rng.shuffle(rank)  # the order the calls stand in is not the order they need
        for i, n in enumerate(names):
            needs = rng.sample(names[:i], min(i, 2)) if conv else names[max(0, i - 1):i]
            edges[conv, n] = needs
            calls.append((conv, rank.index(n) if conv else i, n, "add", '{"a": 1}', needs))
    calls += [(99, 0, "x", "add", "{}", ["y"]), (99, 1, "y", "add", "{}", ["x"]), (99, 2, "after", "add", "{}", ["y"]), (99, 3, "free", "add", "{}", [])]
    got = run(spark, calls, [])
    at = {}
    for conv in {c[0] for c in calls}:
        own = sorted((r for r in got if r.conv == conv), key=lambda r: (r.cyclic, r.layer, r.pos, r.call_id))
        at.update({(conv, r.call_id): k for k, r in enumerate(own)})
    for (conv, n), needs in edges.items():
        assert all(at[conv, p] < at[conv, n] for p in needs)
    assert {r.call_id for r in got if r.cyclic} == {"x", "y", "after"}
