"""Operator 5, secret scans: one automaton for all rules, one pass over the bytes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from quillmesh.llm.automaton import compile_rules
from quillmesh.llm.common import documents, lean, slices, text_buffer

CHUNK_BYTES = 2 << 20
LANE_BYTES = 512
#: cells of one grid of spans in lock step
PADDED = 4 << 20
_SPANS = ArrayType(StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType()))


def either(word: str) -> str:
    """A pattern for the word with letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives the span, longest from its start; ``probe``, what every span that passes holds, marks a line.

    If ``head`` is given, what follows it in the span must have ``least`` bytes; otherwise the
    whole span must.  Spans are leftmost and don't overlap; failing ones are dropped after that.
    """

    kind: str
    pattern: str
    probe: str
    head: str | None = None
    least: int = 0
    base: bool = False


_KEYS = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"(?:{_KEYS})[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=\\-]"
RULES = (
    Rule("assign", _ASSIGN + _VALUE + "+", _ASSIGN + _VALUE, _ASSIGN, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", None, 20, True),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", None, 24, True),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]", None, 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9\\-]+", "xox[abprs]-[A-Za-z0-9]", None, 20),
    Rule("key_block", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", "eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", "eyJ[A-Za-z0-9_\\-]+\\.", None, 40),
)


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    """Three automata of all rules: which lines to look at, where a match begins (read backwards), and how far one goes."""
    patterns = [r.pattern for r in rules]
    heads = [r.head or r.pattern for r in rules]
    return compile_rules([r.probe for r in rules], search=True), compile_rules(patterns, search=True, backwards=True), compile_rules(patterns + heads, search=False)


def flagged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole) -> np.ndarray:
    """Rule bits met in each span of bytes; spans of like length run in lock step."""
    n = len(starts)
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    length, starts = length[order], starts[order]
    kinds = whole.classes[data].astype(np.int32)
    width = np.int32(whole.width)
    # states that accept are numbered last, and states are kept times the width
    rank = np.argsort(whole.accepts != 0, kind="stable")
    place = np.empty(len(rank), np.int32)
    place[rank] = np.arange(len(rank), dtype=np.int32)
    table = (place[whole.table.reshape(-1, width)[rank]] * width).reshape(-1).astype(np.int32)
    accepts = whole.accepts[rank]
    loud = np.int32(int((whole.accepts == 0).sum()) * width)
    seen = np.zeros(n, np.int64)
    i = 0
    while i < n and length[i] > 0:
        longest = int(length[i])
        j = int(np.searchsorted(-length, -(longest // 2), side="right"))
        j = max(i + 1, min(j, i + max(1, PADDED // longest)))
        grid = kinds.take(np.arange(longest)[:, None] + starts[i:j][None, :], mode="clip")
        state = np.full(j - i, place[whole.start] * width, np.int32)
        live = np.searchsorted(-length[i:j], -np.arange(1, longest + 1), side="right")
        buffer = np.empty(j - i, np.int32)
        for k, m in enumerate(live.tolist()):
            np.add(state[:m], grid[k, :m], out=buffer[:m])
            table.take(buffer[:m], out=state[:m], mode="clip")
            if state[:m].max() >= loud:
                hit = np.flatnonzero(state[:m] >= loud)
                seen[i + hit] |= accepts[state[hit] // width]
        i = j
    bits = np.zeros(n, np.int64)
    bits[order] = seen
    return bits


def _lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole):
    """Long lines cut after pairs of bytes that bring every state back to the start; with the line of each."""
    long = np.flatnonzero(ends - starts > 2 * LANE_BYTES)
    resets = whole.pair_resets()
    if not len(long):
        return starts, ends, np.arange(len(starts))
    extra = []
    for k in long:
        kinds = whole.classes[data[starts[k] : ends[k]]]
        breaks = np.flatnonzero(resets[kinds[:-1], kinds[1:]]) + 2 + starts[k]
        want = np.arange(starts[k] + LANE_BYTES, ends[k] - LANE_BYTES, LANE_BYTES)
        where = np.searchsorted(breaks, want)
        cut = np.unique(breaks[where[where < len(breaks)]])
        extra.append((cut[cut < ends[k]], k))
    more = np.concatenate([c for c, _ in extra]) if extra else np.zeros(0, np.int64)
    owner = np.concatenate([np.full(len(c), k) for c, k in extra]) if extra else np.zeros(0, np.int64)
    line = np.concatenate([np.arange(len(starts)), owner])
    begin = np.concatenate([starts, more])
    order = np.lexsort((begin, line))
    begin, line = begin[order], line[order]
    stop = np.append(begin[1:], 0)
    last = np.append(line[1:] != line[:-1], True)
    stop[last] = ends[line[last]]
    return begin, stop, line


def _spans(rules: tuple[Rule, ...], backwards, anchored, data: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
    """(rule number, start, end) of the leftmost non-overlapping matches in data[a:b] that pass their rule's length.

    One pass back over the bytes tells where matches begin; only these are followed, so a match that
    nearly comes about costs nothing.
    """
    n = len(rules)
    upto = [a] * n
    out = []
    for i, bits in backwards.starts(data, a, b):
        for r in range(n):
            if bits >> r & 1 and i >= upto[r]:
                rule = rules[r]
                end, at = anchored.longest(data, i, b, 1 << r, 1 << (n + r) if rule.head else 0)
                upto[r] = end
                if end - (at if rule.head else i) >= rule.least:
                    out.append((r, i, end))
    return out


def scan_texts(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per row: (rule number, start, end) of the spans found, in bytes of the row, by start and rule."""
    whole, backwards, anchored = _compiled(rules)
    n = len(offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if not len(data):
        return found
    # lines are independent where a line feed resets every rule and no rule's span holds one
    apart = whole.resets()[10] and all(row[10] == anchored.dead for row in anchored.rows)
    starts, ends = offsets[:-1], offsets[1:]
    if apart:
        feeds = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([starts, feeds + 1]))
        ends = np.append(starts[1:], len(data))
        starts, ends = starts[starts < len(data)], ends[starts < len(data)]
    begin, stop, line = _lanes(data, starts, ends, whole)
    bits = np.zeros(len(starts), np.int64)
    np.bitwise_or.at(bits, line, flagged(data, begin, stop, whole))
    body = data.tobytes()
    for k in np.flatnonzero(bits).tolist():
        a, b = int(starts[k]), int(ends[k])
        row = int(np.searchsorted(offsets, a, side="right")) - 1
        base = int(offsets[row])
        found[row] += [(r, s - base, e - base) for r, s, e in _spans(rules, backwards, anchored, body, a, b)]
    for row in found:
        row.sort(key=lambda x: (x[1], x[0]))
    return found


def _positions(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points."""
    if not spans or raw.isascii():
        return spans
    view = np.frombuffer(raw, np.uint8)
    points = np.concatenate([[0], np.cumsum((view & 0xC0) != 0x80)])
    return [(r, int(points[a]), int(points[b])) for r, a, b in spans]


def secret_scan(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", redact: bool = False, with_text: bool = True, spans_col: str = "secret_spans") -> DataFrame:
    """Adds ``spans_col`` (kind, start, end in code points) to every row, or with ``redact`` replaces
    each span in the text by ``[kind]``.  ``with_text`` false leaves the text out.

    All rules are compiled into one minimal automaton, which meets each byte once and marks lines; on these,
    one automaton of all rules read backwards tells where matches begin.  Overlapping spans of
    several rules are redacted together.  A null text stays null and has no spans, as has an empty one;
    other columns and repeated rows are carried as they are, and one that is called ``spans_col`` is refused
    with a ValueError; an empty table gives an empty result.
    """
    schema = docs.schema
    if not redact and spans_col in schema.fieldNames():
        raise ValueError(f"the table already has a column {spans_col}; name another by spans_col")
    at = schema.fieldNames().index(text_col)
    kept = [c for c in range(len(schema)) if redact or with_text or c != at]
    out_ddl = StructType([schema[c] for c in kept])
    if not redact:
        out_ddl = out_ddl.add(spans_col, _SPANS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for whole in batches:
            _, sizes = text_buffer(whole.column(at))
            for i, j in slices(sizes, CHUNK_BYTES):
                batch = whole.slice(i, j - i)
                column = batch.column(at)
                data, offsets = text_buffer(column)
                spans = scan_texts(data, offsets, rules)
                if redact:
                    body, texts = data.tobytes(), []
                    valid = column.is_valid().to_pylist()
                    for k, own in enumerate(spans):
                        raw = body[offsets[k] : offsets[k + 1]]
                        texts.append(_redacted(raw, own, rules).decode() if valid[k] else None)
                    arrays = [pa.array(texts, column.type) if c == at else batch.column(c) for c in range(batch.num_columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
                else:
                    body = data.tobytes()
                    rows = [[{"kind": rules[r].kind, "start": a, "end": b} for r, a, b in _positions(body[offsets[k] : offsets[k + 1]], own)] if own else [] for k, own in enumerate(spans)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, kind)], names=[*[batch.schema.names[c] for c in kept], spans_col])

    return docs.mapInArrow(lean(run), out_ddl)


def _redacted(raw: bytes, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> bytes:
    if not spans:
        return raw
    out, upto = [], 0
    for r, a, b in spans:
        if a >= upto:
            out.append(raw[upto:a])
            out.append(b"[" + rules[r].kind.encode() + b"]")
        upto = max(upto, b)
    out.append(raw[upto:])
    return b"".join(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of the base rules, and all spans as text."""
    found = secret_scan(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    base = {r.kind: k for k, r in enumerate(RULES) if r.base}

    def digest(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            ids = batch.column(0)
            said = [[f"{x['kind']}:{x['start']}:{x['end']}" for x in row] for row in rows]
            own = [[s for s, x in zip(a, row) if x["kind"] in base] for a, row in zip(said, rows)]
            counts = [pa.array([sum(x["kind"] == k for x in row) for row in rows], pa.int64()) for k in base]
            shas = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in own], pa.string())
            yield pa.RecordBatch.from_arrays([ids, *counts, shas, pa.array([",".join(x) for x in said], pa.string())], names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    return found.mapInArrow(lean(digest), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
