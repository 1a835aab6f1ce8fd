"""Alignment, hard negatives and best-fit packing, against brute force and edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from quillmesh.llm import alignment, best_fit, hard_negatives
from quillmesh.llm.bpe import byte_letters
from quillmesh.llm.byte_codec import byte_vocabulary, public_path

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOP = (1 << 63) - 1
TEXTS = [
    "The cat sat on the mat, the cat sat.", None, "", " ", "  two  spaces \t and\n\nlines ", "Élan, naïve façade; 東京タワー 🙂🙂 x" * 3, "<|endoftext|> and <s>plain</s> <0x41>",
    "a▁b", "a" * 3000, " " * 2500 + "x", "The cat sat on the mat, the cat sat.", "\x00\x01 control", "1234567890 3.14159 don't we'll",
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(public_path(BYTES))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_path(PIECES))
    to_byte = {c: b for b, c in enumerate(byte_letters())}
    counts, rows = collections.Counter(), []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        raw = (" " + text).encode()
        said = a_coder.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(said.ids, said.tokens)]
        b = [(i, bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()) for i in b_coder.encode(text)]
        if any(b"".join(x for _, x in side) != raw for side in (a, b)):
            rows.append(None)
            continue
        ends = []
        for side in (a, b):
            at, seen = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                seen[at] = k
            ends.append(seen)
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            to = ends[0][cut] + 1, ends[1][cut] + 1
            groups.append(",".join(str(x) for x, _ in a[i : to[0]]) + "|" + ",".join(str(x) for x, _ in b[j : to[1]]))
            i, j = to
            links.append((a[i - 1][0], b[j - 1][0]))
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for row in rows:
        if row is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = row
            yield (n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())


@pytest.mark.parametrize("sent", [2_000_000, 3])
def test_alignment_is_that_of_brute_force(spark, sent):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, pairs int, n_b_ string").repartition(3)
    rows = alignment.align(docs, public_path(BYTES), public_path(PIECES), sent_pairs=sent).collect()
    got = {r["doc_id"]: tuple(r[c] for c in alignment.RESULTS) for r in rows}
    assert len(rows) == len(TEXTS)
    assert got == dict(enumerate(brute_alignment(TEXTS)))


def test_alignment_of_repeated_ids_clashes_and_nothing(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one two")], "doc_id long, text string")
    rows = alignment.align(docs, public_path(BYTES), public_path(PIECES)).collect()
    assert len(rows) == 3 and len({tuple(r[c] for c in alignment.RESULTS) for r in rows}) == 1
    assert alignment.align(docs.limit(0), public_path(BYTES), public_path(PIECES)).count() == 0
    with pytest.raises(ValueError, match="n_links"):
        alignment.align(docs.withColumnRenamed("doc_id", "n_links"), public_path(BYTES), public_path(PIECES), id_col="n_links")


def test_overlaps_and_cuts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    for r in alignment.linked(docs, public_path(BYTES), public_path(PIECES), overlaps=True).collect():
        aligner = alignment.Aligner(public_path(BYTES), public_path(PIECES))
        ends = [np.cumsum([length[i] for i in ids]).astype(int).tolist() for ids, length in ((r["a_ids"], aligner.a_length), (r["b_ids"], aligner.b_length))]
        spans = [list(zip([0, *e], e)) for e in ends]
        want = [(i, j) for i, (a, b) in enumerate(spans[0]) for j, (c, d) in enumerate(spans[1]) if max(a, c) < min(b, d)]
        assert list(zip(r["overlap_a"], r["overlap_b"])) == want
        assert r["cuts"] == sorted(set(ends[0]) & set(ends[1]))


def brute_negatives(rows):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label), equal ones being rows of their own."""
    fit = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(fit):
        if i % 100:
            continue
        scored = [(-max(-TOP, min(TOP, sum(a * b for a, b in zip(v, w)))), j, z) for n, (j, w, z) in enumerate(fit) if n != k and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:5]:
            inside = sorted(x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside)]
    return sorted(out)


def mined(frame):
    return sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_hard_negatives_are_those_of_brute_force(spark):
    r = random.Random(5)
    rows = [(k, [r.choice([0.0, 0.1, -0.1, 0.5]) if k % 3 else r.gauss(0, 0.3) for _ in range(6)], r.randrange(3)) for k in range(900)]
    rows += [(k, [0.5] * 6, 1) for k in range(900, 1000)]  # many ties
    rows += [(200, [0.5] * 6, 1)] * 3 + [(None, [0.5] * 6, 1), (300, None, 1), (300, [0.5] * 6, None), (400, [float("nan")] + [0.5] * 5, 0), (400, [float("inf")] + [0.5] * 5, 0)]
    rows += [(500, [None] + [0.5] * 5, 2), (600, [], 0), (700, [0.5] * 3, 0), (701, [0.25] * 3, 0), (702, [0.2] * 3, 1), (-100, [0.5] * 6, 1), (-7, [-0.5] * 6, 2)]
    frame = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<float>, label int, rank int, i string").repartition(5)
    want = brute_negatives(rows)
    assert len(want) > 200
    assert mined(hard_negatives.hard_negatives(frame)) == want
    assert mined(hard_negatives.hard_negatives(frame, cell_bytes=4000, column_bytes=2000)) == want  # a grid of many rows and columns
    assert hard_negatives.hard_negatives(frame.limit(0)).count() == 0


def test_hard_negatives_with_large_components(spark):
    for scale in (1e3, 1e7, 1e12):
        r = random.Random(3)
        rows = [(k * 50, [r.gauss(0, 1) * scale for _ in range(4)], r.randrange(2)) for k in range(60)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
        assert mined(hard_negatives.hard_negatives(frame)) == brute_negatives(rows)


def test_bounds_hold_every_score():
    r = np.random.default_rng(1)
    for m in (r.integers(-90, 90, (2000, 16)).astype(np.int16), np.repeat(r.integers(-3, 3, (1, 16)), 50, axis=0), r.integers(-(2**30), 2**30, (7, 3))):
        q = r.integers(-90, 90, (20, m.shape[1]))
        low, high = hard_negatives.Approximation(*hard_negatives.approximated(m)).bounds(q, slice(0, len(m)))
        score = 2 * (q @ m.T.astype(np.int64))
        assert (low <= score).all() and (score <= high).all()
        assert (high - low).mean() < 0.1 * max(1, np.abs(score).max())


def packed_rightly(rows, texts, size=1024):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_path(BYTES))
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    for k, text in texts.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, own = 0, sorted(pieces[k], key=lambda r: r["piece"])
        assert len(own) == -(-len(ids) // size)
        for n, r in enumerate(own):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(sequences)


def test_best_fit_pieces(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = best_fit.query(spark, data).collect()
    held = packed_rightly(rows, texts)
    assert -(-sum(r["length"] for r in rows) // 1024) <= held <= -(-sum(r["length"] for r in rows) // 1024) + 1
    texts = dict(enumerate(TEXTS))
    frame = spark.createDataFrame([(k, t, 5) for k, t in texts.items()], "doc_id long, text string, rank int")
    packed_rightly(best_fit.best_fit_pack(frame, public_path(BYTES), size=64).collect(), texts, 64)


def test_best_fit_edges(spark):
    same = spark.createDataFrame([(None, "x y")] * 300, "doc_id long, text string")
    rows = best_fit.best_fit_pack(same, public_path(BYTES), size=7, with_ids=True).collect()
    assert len(rows) == 300 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 300
    assert len({r["sequence_id"] for r in rows}) == 150 and rows[0]["ids"][-1] == 2
    assert best_fit.best_fit_pack(same.limit(0), public_path(BYTES)).count() == 0
    with pytest.raises(ValueError, match="offset"):
        best_fit.best_fit_pack(same.withColumnRenamed("doc_id", "offset"), public_path(BYTES), id_col="offset")


def test_two_documents_take_the_smallest_ones_place():
    # greedily 6 + 3 leaves a gap of 1; 2 + 2 in the place of 3 closes it
    plan = best_fit.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ({6: 1, 2: 2}, 1) and plan[1] == ({3: 1}, 1)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_document(seed):
    r = random.Random(seed)
    room = r.choice([10, 64, 500])
    histogram = collections.Counter(min(room, 1 + int(r.expovariate(4 / room))) for _ in range(3000))
    plan = best_fit.fewest(histogram, room)
    held = collections.Counter()
    for pattern, times in plan:
        assert times > 0 and sum(c * k for c, k in pattern.items()) <= room
        for c, k in pattern.items():
            held[c] += k * times
    assert held == histogram
    total = sum(c * n for c, n in histogram.items())
    assert sum(times for _, times in plan) <= -(-total // room) + 1


def test_byte_ids_are_the_librarys(spark):
    coder = byte_vocabulary(public_path(BYTES))
    assert coder.quick is not None
    for text in TEXTS:
        for special in (True, False):
            coder.library.encode_special_tokens = not special
            want = coder.library.encode(text or "", add_special_tokens=False).ids
            assert coder.ids(text or "", special=special).tolist() == want
