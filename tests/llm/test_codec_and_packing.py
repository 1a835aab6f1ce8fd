"""The encoder against the public library, packing against its contract, secrets against plain regexes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm.automaton import compile_rules
from quillmesh.llm.bpe import bpe_decode, bpe_encode, default_vocabulary, round_trip, vocabulary
from quillmesh.llm.common import text_buffer
from quillmesh.llm.packing import cutting_stock, pack, plan_of, ranked
from quillmesh.llm.secret_scan import RULES, _positions, scan_texts, secret_scan

TEXTS = [None, "", " \n", "Hello, WORLD's 42nd <|endoftext|> né́e Σς", "a" * 3000, "word " * 900, "\x1c\x85 x", "👍🏽 日本語", "same", "same"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, length int")


def test_round_trip_against_the_library(spark, library):
    rows = {r.doc_id: r for r in round_trip(frame(spark), default_vocabulary()).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_random_words_against_the_library(library):
    rng, coder = random.Random(4), vocabulary(default_vocabulary())
    tokens = [t.replace("</w>", "") for t in library.get_vocab() if t.isascii()]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))) if rng.random() < 0.5 else "".join(rng.choice("abcdefgé'., 12ñ\n") for _ in range(25))
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_frames(spark, library):
    coded = bpe_encode(frame(spark).drop("ids"), default_vocabulary())
    back = bpe_decode(coded, default_vocabulary()).orderBy("doc_id").collect()
    assert back[3].decoded == library.decode(library.encode(TEXTS[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert back[0].decoded == "" and bpe_encode(frame(spark, []), default_vocabulary(), out_col="tokens").count() == 0
    kept = bpe_encode(frame(spark), default_vocabulary(), out_col="tokens")
    assert kept.columns == ["doc_id", "ids", "length", "tokens"] and kept.filter("doc_id = 8").first().ids == "x"
    with pytest.raises(ValueError):
        bpe_encode(frame(spark), default_vocabulary())
    with pytest.raises(ValueError):
        bpe_decode(coded.withColumn("decoded", coded.doc_id), default_vocabulary())
    odd = spark.createDataFrame([(1, [320, None, -5, 10**9, 320]), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.decoded for r in bpe_decode(odd, default_vocabulary()).collect()} == {1: " ".join([library.id_to_token(320)] * 2), 2: None, 3: ""}


def test_memory_of_the_encoder_is_bounded_in_bytes(library):
    from quillmesh.llm import bpe

    coder, rng = bpe.Vocabulary(default_vocabulary()), random.Random(8)
    long = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(600)) for _ in range(2000)]
    assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in long[:20]] == [library.encode(t, add_special_tokens=False).ids for t in long[:20]]
    for t in long:
        coder.encode(t)
    assert coder.known.held < 1 << 20  # long stretches aren't remembered
    old, bpe.REMEMBERED = bpe.REMEMBERED, 1 << 20
    try:
        for _ in range(40):
            coder.encode(" ".join(f"w{rng.getrandbits(60)}" for _ in range(2000)) * 3)
            assert coder.known.held + getattr(coder.known.old, "held", 0) < 4 << 20
    finally:
        bpe.REMEMBERED = old


def test_a_worker_forgets_when_it_is_idle(monkeypatch):
    import time

    from quillmesh.llm import bpe

    monkeypatch.setattr(bpe, "IDLE", 0.2)
    with bpe.coding(default_vocabulary()) as coder:
        time.sleep(0.5)
        assert vocabulary(default_vocabulary()) is coder
    with bpe.coding(default_vocabulary()) as again:
        assert again is coder
    time.sleep(0.6)
    assert vocabulary.cache_info().currsize == 0


def test_very_long_texts_are_read_in_parts(library, monkeypatch):
    from quillmesh.llm import bpe

    monkeypatch.setattr(bpe, "PART", 50)
    text = "Éa b\u0301c's <|endoftext|>1 \n" * 40 + "z" * 300
    assert np.frombuffer(vocabulary(default_vocabulary()).encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_another_vocabulary_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("size", [64, 2048])
def test_pack(spark, library, size):
    rows = pack(frame(spark), default_vocabulary(), size=size).collect()
    for i, t in enumerate(TEXTS):
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= size


def test_pack_of_nothing(spark):
    assert pack(frame(spark, []), default_vocabulary()).count() == 0


def test_short_texts_are_not_padded(spark):
    rows = pack(frame(spark, ["", None] * 2500), default_vocabulary(), size=2048).collect()
    assert len({r.sequence_id for r in rows}) == 3
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) == 2048


def test_plan_of_short_and_long_pieces():
    rng = random.Random(6)
    for _ in range(20):
        histogram = {c: rng.randint(1, 500) for c in [*rng.sample(range(1, 65), 30), *(8 * k for k in rng.sample(range(9, 257), 30))]}
        plan = plan_of(histogram, 2048, 8)
        assert all(k > 0 and sum(c * n for c, n in p.items()) <= 2048 for p, k in plan)
        assert {c: sum(p.get(c, 0) * k for p, k in plan) for c in histogram} == histogram
    assert plan_of({}, 2048, 8) == []
    assert sum(k for _, k in plan_of({1: 2048 * 5}, 2048, 8)) == 5


def test_cutting_stock_holds_every_piece():
    rng = random.Random(2)
    sizes = sorted(rng.sample(range(1, 65), 40))
    demand = [rng.randint(1, 60) for _ in sizes]
    plan = cutting_stock(sizes, demand, 64)
    for s, d in zip(sizes, demand):
        assert sum(p.get(s, 0) * k for p, k in plan) == d
    assert all(sum(s * c for s, c in p.items()) <= 64 for p, _ in plan)
    # no more sequences than first fit decreasing takes
    bins = []
    for s, d in sorted(zip(sizes, demand), reverse=True):
        for _ in range(d):
            k = next((k for k, free in enumerate(bins) if free >= s), None)
            if k is None:
                bins.append(64 - s)
            else:
                bins[k] -= s
    assert sum(k for _, k in plan) <= len(bins)


def test_ranks_of_a_hot_value(spark):
    rows = ranked(spark.range(500).selectExpr("id % 10 > 2 AS c", "id"), "c", ["id"], 500).collect()
    for c in (True, False):
        got = sorted(r["rank"] for r in rows if r.c == c)
        assert got == list(range(len(got)))


PLAIN = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in p.finditer(text) if ok(m))


def test_secrets_against_plain_regexes():
    rng = random.Random(1)
    bits = ["password", "PassWord", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789", "abcdef", "0123456789ab", "é", "\n", "==", "token=", "ab", "日本", "zz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "".join(rng.choice(bits) for _ in range(6000)).replace("\n", "")]
    data, offsets = text_buffer(pa.array(texts))
    for text, own in zip(texts, scan_texts(data, offsets)):
        assert [(a, r, b) for r, a, b in _positions(text.encode(), own) if r < 3] == plain(text)


def test_secret_frames(spark):
    rows = frame(spark, [None, "", "é token=abcdef12 x", "AKIA" + "A1" * 8]).withColumnRenamed("ids", "secret_note")
    found = secret_scan(rows).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.secret_spans] for r in found] == [[], [], [("assign", 2, 16)], [("access", 0, 20)]]
    assert [r.text for r in secret_scan(rows, redact=True).orderBy("doc_id").collect()] == [None, "", "é [assign] x", "[access]"]
    assert secret_scan(frame(spark, [])).count() == 0
    clash = rows.withColumnRenamed("secret_note", "secret_spans")
    with pytest.raises(ValueError):
        secret_scan(clash)
    assert secret_scan(clash, spans_col="found").filter("doc_id = 2").first().secret_spans == "x"
    assert secret_scan(clash, redact=True).columns == clash.columns


def test_near_misses_cost_no_more_than_their_bytes():
    import time

    for text in ("eyJ" * 100_000, "token" * 60_000, "-----BEGIN " * 30_000, "eyJa." * 60_000, "password  " * 30_000):
        data, offsets = text_buffer(pa.array([text + " token=abcdef12"]))
        began = time.process_time()
        (found,) = scan_texts(data, offsets)
        assert time.process_time() - began < 5
        assert (0, len(text) + 1, len(text) + 15) in found


def test_added_rules_against_plain_regexes():
    rng = random.Random(9)
    plain_rules = [(re.compile(p), least) for p, least in (("gh[pousr]_[A-Za-z0-9]+", 40), (r"xox[abprs]-[A-Za-z0-9\-]+", 20), ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0), (r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40))]
    bits = ["ghp_", "A1b2C3d4E5F6", "xoxb-", "12-34", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", ".", "_x-", " ", "\n", "zz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    data, offsets = text_buffer(pa.array(texts))
    for text, own in zip(texts, scan_texts(data, offsets)):
        want = sorted((m.start(), k + 3, m.end()) for k, (p, least) in enumerate(plain_rules) for m in p.finditer(text) if m.end() - m.start() >= least)
        assert [(a, r, b) for r, a, b in own if r >= 3] == want


def test_automaton_matches_like_re():
    for pattern in ("a(b|cd)*e?", "[^x]{2,3}y", "(ab){2}|a+", r"\x41\.[0-9\-]+"):
        auto = compile_rules([pattern], search=False)
        for text in ("abcdbe", "aaaa", "zzy", "zzzy", "abab", "A.1-2", "", "xx"):
            m = re.match(pattern.replace("{2}", "{2}"), text)
            got = auto.longest(text.encode(), 0, len(text))[0]
            longest = max((n for n in range(len(text) + 1) if re.fullmatch(pattern, text[:n])), default=-1)
            assert got == (longest if longest > 0 else -1), (pattern, text, m)
    assert len(RULES) > 3


def test_the_offset_table_gives_texts_and_digests(monkeypatch):
    from quillmesh.llm import bpe

    monkeypatch.setattr(bpe, "IDS", 3)
    table = bpe.OffsetTable([b"a", b"bcd", None, b"", b"\xc3\xa9"])
    rows = [np.array(r, np.int64) for r in ([0, 1, 4, 1], [], [3], [4, 4, 4, 4, 4, 4, 0])]
    said = [" ".join({0: "a", 1: "bcd", 3: "", 4: "é"}[i] for i in r.tolist()) for r in rows]
    assert [table.text(r) for r in rows] == said
    assert table.digests(rows) == [hashlib.sha256(t.encode()).hexdigest() for t in said]
