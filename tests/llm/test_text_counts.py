"""Host rules, token counts and pieces against plain versions and the public libraries."""

import random

import pytest

from panelfx.llm import common, hosts, pieces, tokens
from panelfx.llm.queries import vocabulary

from .support import ODD, sample_texts


def plain_signals(text):
    text = text or ""
    words, word = [], ""
    for ch in text + " ":
        if ch in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += ch
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines = [ln for ln in text.split("\n") if ln.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text),
            sum(ln in lines[:i] for i, ln in enumerate(lines)), len(hit))


def test_signals_match_plain_version():
    rng = random.Random(1)
    texts = sample_texts(40) + [t for _, t, _ in ODD]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) + "\n\na b\na b" for _ in range(5)]
    for t in texts:
        assert hosts.measure(t) == plain_signals(t)


def test_host_rules_rows(spark, docs, odd, empty):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "too short", "bad") for i in range(30)] + [(100 + i, good, "bad") for i in range(3)]
    rows += [(200 + i, good, "fine") for i in range(40)] + [(300, "short", "fine"), (301, good, None)]
    out = {r.doc_id: r for r in hosts.host_rules(docs(rows)).collect()}
    assert len(out) == len(rows)
    assert all(not out[100 + i].kept and not out[100 + i].base_failed for i in range(3))  # their host is rejected
    assert all(out[200 + i].kept for i in range(40)) and not out[300].kept and out[301].kept
    assert hosts.host_rules(odd).count() == len(ODD)
    assert hosts.host_rules(empty).collect() == []


def test_shrinkage_pulls_small_hosts(spark, docs):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 4 else "x", f"h{i % 20}") for i in range(400)] + [(900, "x", "tiny")]
    d = hosts.signals(docs(rows).select("doc_id", "source", "text")).withColumn("bad", hosts.base_failed())
    rates = {r.host: r for r in hosts.host_rates(d, "source", "bad").collect()}
    assert rates["tiny"].n_docs == 1 and rates["tiny"].shrunk_rate < 1
    assert all(0 <= r.shrunk_rate <= 1 for r in rates.values())


@pytest.fixture(scope="module")
def bpe():
    return tokens.Bpe.from_json(vocabulary("byte_bpe_50k.json"))


def test_token_counts_match_library(bpe):
    from tokenizers import Tokenizer
    ref = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    whole = bpe.whole_tokens()
    assert len(whole) > 40_000
    count = tokens.counter(bpe, whole)
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3000, 0x3100), 10, 32, 32]))
                   for _ in range(80)) for _ in range(60)]
    for t in sample_texts(60) + [x for _, x, _ in ODD] + odd + ["<|endoftext|>a <|endoftext|>", "a" * 5000, "  \n\n  x", "it's 12 we'LL"]:
        assert count(t) == len(ref.encode(t or "", add_special_tokens=False).ids)


def test_scan_and_heap_agree(bpe):
    rng = random.Random(3)
    for n in (2, 7, 30, 48):
        for _ in range(50):
            parts = [bpe.bytes_id[rng.choice(b"etaoin shrdlu")] for _ in range(n)]
            assert bpe._by_scan(list(parts)) == bpe._by_heap(list(parts))


def test_token_counts_rows(odd, empty):
    path = vocabulary("byte_bpe_50k.json")
    out = tokens.token_counts(odd.select("doc_id", "text"), path, limit=100).collect()
    assert len(out) == len(ODD)
    null = next(r for r in out if r.doc_id == 1)
    assert (null.n_bytes, null.n_tokens, null.over_limit) == (0, 0, False)
    assert any(r.over_limit for r in out)
    assert tokens.token_counts(empty.select("doc_id", "text"), path).collect() == []


def library(model_type=1, floor=-40_000.0):
    """The public library on the same pieces, as a Unigram model. It adds scores in single
    precision, so scores of -1e9 (pieces without a rank) are raised to a floor for it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = model_type
    for p in m.pieces:
        p.score = max(p.score, floor)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_pieces_match_library():
    model = pieces.read_model(vocabulary("piece_bpe_32k.model"))
    model["pieces"] = [(p, max(s, -40_000.0), k) for p, s, k in model["pieces"]]
    memo, ref = pieces.Memo(pieces.Unigram(model)), library()
    words = sorted({w for t in sample_texts(100) for w in t.split()})[:4000]
    for w in words + ["  a  b", "é你\U00010348x", "tab\tend"]:
        assert pieces.encode_text(memo, w)[0].tolist() == ref.encode(w)
    for ids in (ref.encode("né 你 \U00010348"), [3 + 0xC3, 3 + 0x28, 400], [5, 400, 3 + 0xE4]):
        assert memo.model.decode(ids) == ref.decode(ids)


def brute_segment(model, run):
    """Best score over all segmentations, by recursion over prefixes."""
    ids = {p: i for i, (p, _, k) in enumerate(model["pieces"]) if k in (pieces.NORMAL, pieces.USER_DEFINED)}
    low = min(model["pieces"][i][1] for i in ids.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0] + [float("-inf")] * len(run)
    for i in range(len(run)):
        for j in range(i + 1, len(run) + 1):
            s = model["pieces"][ids[run[i:j]]][1] if run[i:j] in ids else low if j == i + 1 else None
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_viterbi_score_is_the_best():
    model = pieces.read_model(vocabulary("piece_bpe_32k.model"))
    uni = pieces.Unigram(model)
    for w in sorted({w for t in sample_texts(30) for w in t.split()})[:400] + ["▁▁▁", "▁你\U00010348"]:
        ids, score = uni.segment(w)
        assert score == brute_segment(model, w) == sum(uni.adds[i] for i in ids)


def test_pieces_batches_are_bounded(spark, odd):
    """Texts go to the workers in batches of a few MB, not of 10,000 rows whatever their length."""
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("10000", "67108864b")):
            spark.conf.set(k, v)
        pieces.encode(odd.select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
        assert [int(spark.conf.get(k).rstrip("b")) for k in keys] == [common.BATCH_ROWS, common.BATCH_BYTES]
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_pieces_rows_and_round_trip(spark, odd, empty):
    path = vocabulary("piece_bpe_32k.model")
    enc = pieces.encode(odd.select("doc_id", "text"), path, keep_text=True).collect()
    assert len(enc) == len(ODD)
    for r in enc:
        assert (r.ids is None) == (r.text is None) and r.n_pieces == len(r.ids or [])
        assert r.round_trip == ("▁" not in (r.text or ""))  # a marker in a text comes back as a space
    dec = pieces.decode(spark.createDataFrame(enc), path).collect()
    assert all(r.decoded == r.text for r in dec if r.round_trip)
    assert pieces.encode(empty.select("doc_id", "text"), path).collect() == []


def test_watched_hosts_lose_what_fails_the_rule(docs, monkeypatch):
    good = " ".join(f"word{i}" for i in range(30))
    signs = good + " #$#$#$"
    rows = [(i, signs if i % 5 == 0 else good, "often") for i in range(200)] + [(1000 + i, signs if i == 0 else good, "seldom") for i in range(400)]
    for limit in (1_000_000, 1):  # all verdicts broadcast; none but those of very large hosts
        monkeypatch.setattr(hosts.common, "BROADCAST_ROWS", limit)
        out = {r.doc_id: r for r in hosts.host_rules(docs(rows)).collect()}
        assert {i for i, r in out.items() if not r.kept} == {i for i in range(0, 200, 5)}
        assert out[0].watched_symbols and not out[1000].watched_symbols and out[1000].fails_symbols and not out[0].base_failed
        assert not any(r.host_rejected for r in out.values()) and len(out) == len(rows)
