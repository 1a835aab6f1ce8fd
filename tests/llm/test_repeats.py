"""Substring and line dedup against brute force, on hypothesis texts and edge cases."""

import hashlib
import random
import re

import numpy as np

from quillmesh.llm.common import hash_spans, line_spans, text_buffer, window_hashes, word_spans
from quillmesh.llm.line_dedup import line_dedup
from quillmesh.llm.recompression import symbols
from quillmesh.llm.repeats import remove_repeats
from quillmesh.llm.substring_dedup import substring_dedup

DDL = "doc_id long, text string, units_ int, _blk string"


def units_of(text, unit):
    if unit == "words":
        return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return [] if text is None else text.split("\n")


def brute(rows, unit, window):
    first, gone = {}, []
    key = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        u = units_of(t, unit)
        for p in range(len(u) - window + 1):
            w = tuple(u[p : p + window])
            first[w] = min(first.get(w, (key(i), p)), (key(i), p))
    out = []
    for i, t in rows:
        u = units_of(t, unit)
        mask = [False] * len(u)
        for p in range(len(u) - window + 1):
            if first[tuple(u[p : p + window])] < (key(i), p):
                mask[p : p + window] = [True] * window
        kept = (" " if unit == "words" else "\n").join(x for x, m in zip(u, mask) if not m)
        out.append((i, len(u), sum(mask), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, unit, window, **more):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DDL).repartition(3)
    out = remove_repeats(frame, unit=unit, window=window, prefilter=unit == "words", with_text=True, block_bytes=300, **more).collect()
    assert sorted(((r.doc_id, r.n_units, r.n_removed, r.kept_sha256) for r in out), key=str) == brute(rows, unit, window)


def corpus(seed, docs=30):
    rng = random.Random(seed)
    passage = [rng.choice("abcdefgh") + str(k) for k in range(40)]
    rows = []
    for i in range(docs):
        words = [rng.choice(["the", "of", "a", "é", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            at, lo = rng.randint(0, len(words)), rng.randint(0, 15)
            words[at:at] = passage[lo : lo + rng.randint(5, 25)]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words)))
    return rows


def test_words_against_brute_force(spark):
    rows = corpus(1) + [(100, "x " * 70), (101, "x " * 30), (102, None), (103, ""), (104, " \n\t"), (105, "long" * 20_000), (None, corpus(1)[3][1])]
    rows += [rows[5], rows[5], (200, rows[7][1]), (201, rows[7][1])]
    check(spark, rows, "words", 20)
    check(spark, corpus(2), "words", 5)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", "line é", f"l{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    check(spark, [*rows, (50, None), (51, ""), (52, "a\na\na\na\na"), rows[4], rows[4]], "lines", 3)


def test_empty_tables_and_kept_columns(spark):
    none = spark.createDataFrame([], DDL)
    assert substring_dedup(none).count() == 0 and line_dedup(none).count() == 0
    frame = spark.createDataFrame([(1, "a\nb\nc", 7, "q"), (2, "a\nb\nc\nd", 8, None)], DDL)
    rows = line_dedup(frame, keep_columns=frame.columns).orderBy("doc_id").collect()
    assert [(r.units_, r["_blk"], r.kept_text, r.n_removed) for r in rows] == [(7, "q", "a\nb\nc", 0), (8, None, "d", 3)]


def test_spans_and_hashes():
    import pyarrow as pa

    data, off = text_buffer(pa.array(["a bb", None, "cc", " d\n"]))
    s, e, r = word_spans(data, off)
    assert [(bytes(data[a:b]).decode(), k) for a, b, k in zip(s, e, r)] == [("a", 0), ("bb", 0), ("cc", 2), ("d", 3)]
    s, e, r = line_spans(data, off)
    assert r.tolist() == [0, 1, 2, 3, 3]
    words = [b"x" * n for n in range(200)] + [b"y" * n for n in range(1, 60)]
    body = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(hash_spans(body, ends - [len(w) for w in words], ends).tolist())) == len(words)
    u = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    h, g = window_hashes(u, 3)
    assert h[0] == h[3] and g[0] == g[3] and len(set(h.tolist())) == 5


def test_symbols_agree_inside_equal_windows():
    """Wherever a window holds a symbol's context, the same symbol stands at its other places."""
    rng = np.random.default_rng(0)
    passage = rng.integers(1, 50, 60).astype(np.uint64)
    one = np.concatenate([rng.integers(1, 50, 33).astype(np.uint64), passage, rng.integers(1, 50, 9).astype(np.uint64)])
    two = np.concatenate([rng.integers(1, 50, 5).astype(np.uint64), passage])
    found = []
    for u, at in ((one, 33), (two, 5)):
        name, length, lo, hi = symbols(u, np.zeros(len(u), np.int32))
        inside = (lo >= at) & (hi <= at + 60)
        found.append({(int(n), int(a) - at, int(b) - at) for n, a, b in zip(name[inside], lo[inside], hi[inside])})
    assert found[0] == found[1] and len(found[0]) > 10


def test_clashing_columns_are_refused(spark):
    import pytest

    from quillmesh.llm.line_dedup import line_dedup
    from quillmesh.llm.quality import classify
    from quillmesh.llm.simhash import fingerprints
    from quillmesh.llm.substring_dedup import substring_dedup

    docs = spark.createDataFrame([(1, "a b", "x", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (
        lambda: line_dedup(docs.withColumnRenamed("lang", "kept_text"), keep_columns=["doc_id", "kept_text"]),
        lambda: substring_dedup(docs.withColumnRenamed("lang", "n_removed"), keep_columns=["doc_id", "n_removed"]),
        lambda: classify(docs.withColumn("_quality", docs.doc_id), labels),
        lambda: fingerprints(docs.withColumnRenamed("lang", "fp")),
    ):
        with pytest.raises(ValueError):
            run()
