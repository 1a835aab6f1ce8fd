"""Operator 7, BPE encoding and decoding with a backtracking encoder.

A word is cut into the longest tokens that an Aho-Corasick automaton finds; a neighbour pair is kept
only if merging the two tokens' bytes alone would give back just these two, which a table of pairs
remembers.  If no token fits, the last one is taken back and shortened.  Every place in a word is
given up at most once, so the work is linear, and the result is that of merging by rank.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import threading
import unicodedata
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import documents, slices, text_buffer

CHUNK_BYTES = 1 << 20
#: bytes of stretches of text and their ids that a worker remembers, in each of two generations
REMEMBERED = 64 << 20
#: seconds without a task after which a worker forgets
IDLE = 3.0
#: marks of stretches met once, which aren't remembered until they come again
MARKS = 1 << 22
#: a longer stretch isn't remembered, and what one entry takes besides its own bytes
LONGEST, ENTRY = 64, 190
#: letters of a very long text that are read at once, and ids that are turned into text at once
PART, IDS = 1 << 20, 1 << 18

# The settings of a vocabulary file that this encoder follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def _followed(spec: dict) -> bool:
    """Whether the file's settings are those that this encoder follows."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = steps[0]
    model = spec["model"]
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    marks = all(not any(t.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    return (
        plain and marks and spec.get("normalizer") == NORMALIZER and not spec.get("decoder") and bool(model.get("end_of_word_suffix"))
        and len(steps) == 2 and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    )


class OffsetTable:
    """Texts of ids in one buffer, each followed by a space, and where each begins."""

    def __init__(self, items: list[bytes | None]):
        self.known = np.array([x is not None for x in items], bool)
        body = [b"" if x is None else x + b" " for x in items]
        self.buffer = np.frombuffer(b"".join(body), np.uint8)
        self.length = np.array([len(x) for x in body], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, cut from the buffer by offset, and where each id's end."""
        length = self.length[ids]
        ends = np.cumsum(length)
        place = np.repeat(self.start[ids] - (ends - length), length)
        place += np.arange(len(place))
        return self.buffer[place], ends

    def text(self, ids: np.ndarray) -> str:
        """The texts of the ids, one space between; ids that no token has are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        ids = ids[self.known[ids]]
        return b"".join([self.joined(ids[i : i + IDS])[0].tobytes() for i in range(0, len(ids), IDS)])[:-1].decode()

    def digests(self, rows: list[np.ndarray]) -> list[str]:
        """SHA-256 of each row's text, some ids at a time."""
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        hashes = [hashlib.sha256() for _ in rows]
        for i in range(0, len(flat), IDS):
            j = min(i + IDS, len(flat))
            body, ends = self.joined(flat[i:j])
            body = memoryview(body)
            k = int(np.searchsorted(bounds, i, side="right")) - 1
            while k < len(rows) and bounds[k] < j:
                a, b = max(int(bounds[k]), i) - i, min(int(bounds[k + 1]), j) - i
                if b > a:
                    last = int(bounds[k + 1]) == b + i  # no space after the last id
                    hashes[k].update(body[int(ends[a - 1]) if a else 0 : int(ends[b - 1]) - last])
                k += 1
        return [h.hexdigest() for h in hashes]


class _Remembered(dict):
    """Packed ids by stretch of lower-case text; what isn't known is encoded when it is looked up.

    Most stretches of a corpus come once, so a stretch is kept only when it comes again.
    """

    __slots__ = ("coder", "old", "held", "met")

    def __init__(self, coder: "Vocabulary", old: dict):
        super().__init__()
        self.coder, self.old, self.held, self.met = coder, old, 0, bytearray(MARKS)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.coder.stretch(word)
            mark = hash(word) & (MARKS - 1)
            if not self.met[mark]:
                self.met[mark] = 1
                return ids
        if len(word) <= LONGEST:
            self.held += ENTRY + len(word) + len(ids)
            self[word] = ids
        return ids


class Vocabulary:
    """Tokens, merges and special tokens of a word-end BPE file, as one alphabet of byte letters.

    A byte letter that ends a word is one letter of its own, so tokens are plain strings.  A file whose
    normaliser, splitting or model differs from what is followed here is refused with a ValueError.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _followed(spec):
            raise ValueError(f"{path}: its settings are not those of a lower-case word-end BPE vocabulary")
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        to_byte = {ord(c): b for b, c in enumerate(byte_letters())}
        self.final = [chr(b + 256) for b in range(256)]

        def spelled(token: str) -> str:
            if token.endswith(suffix) and token != suffix:
                body = token[: -len(suffix)].translate(to_byte)
                return body[:-1] + self.final[ord(body[-1])]
            return token.translate(to_byte)

        ids = model["vocab"]
        special = {x["content"] for x in spec["added_tokens"]}
        self.rank_of: dict[str, int] = {}
        spelling: list[str] = []
        self.ids: list[int] = []
        self.parts: list[tuple[int, int]] = []
        by_id: dict[int, str] = {}

        def add(token: str, parts=None) -> int:
            s = spelled(token)
            if s not in self.rank_of:
                k = self.rank_of[s] = len(spelling)
                spelling.append(s)
                self.ids.append(ids[token])
                by_id[ids[token]] = token
                self.parts.append(parts or (k, k))
            return self.rank_of[s]

        for token in ids:
            if token not in special and len(spelled(token)) == 1:
                add(token)
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = self.rank_of[spelled(left)], self.rank_of[spelled(right)]
            self.merged[a, b] = add(left + right, (a, b))
        self.length = [len(s) for s in spelling]
        self.automaton = ahocorasick.Automaton()
        for s, k in self.rank_of.items():
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()
        # the longest token that is a proper prefix of each token
        self.shorter = [-1] * len(spelling)
        for s, k in self.rank_of.items():
            for cut in range(len(s) - 1, 0, -1):
                if s[:cut] in self.rank_of:
                    self.shorter[k] = self.rank_of[s[:cut]]
                    break
        self.packed_id = [struct.pack("<I", i) for i in self.ids]
        # words that are one token
        self.whole: dict[str, bytes] = {}
        for s, k in self.rank_of.items():
            if ord(s[-1]) >= 256:
                raw = s[:-1].encode("latin-1") + bytes([ord(s[-1]) - 256])
                try:
                    self.whole[raw.decode()] = self.packed_id[k]
                except UnicodeDecodeError:
                    continue
        self.pairs: dict[int, int] = {}
        self.special = {x["content"]: struct.pack("<I", x["id"]) for x in spec["added_tokens"]}
        by_id |= {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.tokens = OffsetTable([by_id[i].encode() if i in by_id else None for i in range(max(by_id) + 1)])
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+")
        self.ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self._late_letters()
        self.known = _Remembered(self, {})

    def _late_letters(self) -> None:
        """Unicode tables differ by version: for code points that Python's don't know, the vocabulary's library is asked."""
        import regex
        from tokenizers import Regex, normalizers, pre_tokenizers

        # all planes with letters; those above hold tags, variants and private signs
        new = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
        taken = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed", invert=True).pre_tokenize_str("".join(new))
        here = regex.compile(r"[\p{L}\p{N}]")
        late = {c for c in new if here.match(c)} - {c for x, _ in taken for c in x}
        small = normalizers.Lowercase().normalize_str("\n".join(new)).split("\n")
        self.lower = str.maketrans({c: x for c, x in zip(new, small) if c != x})
        self.late = frozenset(late) | {chr(c) for c in self.lower}
        spans: list[list[int]] = []
        for c in sorted(map(ord, late)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        late = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
        self.late_pieces = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{late}]]+|[\p{{N}}--[{late}]]|(?:[^\s\p{{L}}\p{{N}}]|[{late}\x1c-\x1f])+") if late else self.pieces

    # -- the encoder ---------------------------------------------------------------------------
    def following(self, left: int, token: int) -> int:
        """The longest of a token and the tokens that begin it which may follow ``left``; -1 if none."""
        key = left << 20 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            known = token
            while known >= 0 and not self._fits(left, known):
                known = self.shorter[known]
            self.pairs[key] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of the two tokens gives back just these two."""
        # undo merges around the seam from the latest on; none across it may have come first
        limit = 1 << 62
        merged, parts = self.merged, self.parts
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and parts[left][1] != left:
                    limit, left = left, parts[left][1]
                    break
                if side == "right" and parts[right][0] != right:
                    limit, right = right + 1, parts[right][0]
                    break
            else:
                return True

    def encode_word(self, word: str) -> bytes:
        """Packed ids of one word."""
        ids = self.whole.get(word)
        if ids is not None:
            return ids
        if word.isascii():
            spelled = word[:-1] + self.final[ord(word[-1])]
        else:
            raw = word.encode()
            spelled = raw[:-1].decode("latin-1") + self.final[raw[-1]]
        # the longest tokens from the left; often each pair of them holds
        out = [k for _, k in self.automaton.iter_long(spelled)]
        pairs, last = self.pairs, out[0]
        for i in range(1, len(out)):
            k = out[i]
            if pairs.get(last << 20 | k) != k and self.following(last, k) != k:
                out = self._backtracked(spelled, out, i)
                break
            last = k
        packed = self.packed_id
        return b"".join([packed[k] for k in out])

    def _backtracked(self, spelled: str, path: list[int], good: int) -> list[int]:
        """The encoding of a word whose first ``good`` longest tokens hold, but not the next."""
        length, shorter, pairs, following = self.length, self.shorter, self.pairs, self.following
        longest: dict[int, int] = {}
        place = here = 0
        for i, k in enumerate(path):
            longest[place] = k
            if i == good:
                here = place
            place += length[k]
        n = len(spelled)
        shut: set[int] = set()  # places given up
        out = path[:good]
        at, token = here, path[good]
        while True:
            if out:
                last = out[-1]
                fit = pairs.get(last << 20 | token)
                token = following(last, token) if fit is None else fit
                while token >= 0 and at + length[token] in shut:
                    token = following(last, shorter[token]) if shorter[token] >= 0 else -1
            else:
                while token >= 0 and at + length[token] in shut:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = longest.get(at, -1)
                if token < 0:
                    place = at
                    for _, k in self.automaton.iter_long(spelled, at):
                        if place in longest:
                            break
                        longest[place] = k
                        place += length[k]
                    token = longest[at]
            else:
                shut.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token] if at + length[token] in shut else token

    def stretch(self, word: str) -> bytes:
        """Packed ids of one space-free stretch of lower-case text."""
        if word.isalpha():
            return self.encode_word(word)
        known, own = self.known.get, self.encode_word
        return b"".join([known(x) or own(x) for x in self.split(word)])

    def split(self, word: str) -> list[str]:
        """Words, digits and runs of other signs."""
        if word.isascii():
            return [word[:-1], word[-1]] if word[:-1].isalpha() else self.ascii_pieces.findall(word)
        if self.late.isdisjoint(word):
            return self.pieces.findall(word)
        return self.late_pieces.findall(word.translate(self.lower))

    def encode(self, text: str) -> bytes:
        """Packed ids (little-endian, 32 bits) of a whole text."""
        if self.known.held > REMEMBERED:
            self.known.old = {}
            self.known = _Remembered(self, self.known)  # the marks begin anew
        if any(s in text for s in self.special):
            return b"".join([self.special.get(x) or self._plain(x) for x in self.special_split.split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(text) <= 2 * PART:
            return b"".join(map(self.known.__getitem__, _stretches(text)))
        out, at = [], 0
        while at < len(text):  # parts end before a space, which nothing crosses
            cut = text.find(" ", at + PART)
            cut = len(text) if cut < 0 else cut
            out.append(b"".join(map(self.known.__getitem__, _stretches(text[at:cut]))))
            at = cut
        return b"".join(out)


def _stretches(text: str) -> list[str]:
    """Composed, lower-cased text without its white space."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # letter by letter: no final form
    text = text.lower()
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
        import regex

        return [x for x in regex.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if x]
    return text.split()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def decimals(path: str) -> OffsetTable:
    """The ids of a vocabulary in decimal digits."""
    return OffsetTable([str(i).encode() for i in range(len(vocabulary(path).tokens.known))])


class _Idle:
    """Lets a worker forget its vocabulary when no task has asked for it for a while, so that it leaves its memory to others."""

    def __init__(self):
        self.lock, self.tasks, self.timer = threading.Lock(), 0, None

    def begin(self) -> None:
        with self.lock:
            self.tasks += 1
            if self.timer is not None:
                self.timer.cancel()

    def end(self) -> None:
        with self.lock:
            self.tasks -= 1
            if self.tasks == 0:
                self.timer = threading.Timer(IDLE, self.forget)
                self.timer.daemon = True
                self.timer.start()

    def forget(self) -> None:
        with self.lock:
            if self.tasks == 0:
                vocabulary.cache_clear()
                decimals.cache_clear()
                gc.collect()
                pa.default_memory_pool().release_unused()


_idle = _Idle()


@contextmanager
def coding(path: str):
    """The worker's vocabulary for one task; what it remembers stays for the worker's next task, if that comes soon."""
    _idle.begin()
    collects = gc.isenabled()
    try:
        coder = vocabulary(path)
        gc.disable()  # remembered words make no cycles, and walking them again and again is costly
        yield coder
    finally:
        if collects:
            gc.enable()
        _idle.end()


def each_text(batch: pa.RecordBatch, at: int):
    """The rows of a batch in slices of bounded bytes, with their texts (null: empty)."""
    column = batch.column(at)
    _, sizes = text_buffer(column)
    for i, j in slices(sizes, CHUNK_BYTES):
        yield batch.slice(i, j - i), column.slice(i, j - i).fill_null("").to_pylist()


def _ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.int64)


def _free(docs: DataFrame, keep: list[str], name: str) -> None:
    if name in keep:
        raise ValueError(f"the table already has a column {name}; name another by out_col")


def bpe_encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: list[str] | None = None, out_col: str = "ids") -> DataFrame:
    """Adds ``out_col`` (array<int>), the tokens of the whole text, to the kept columns.

    Special tokens written in a text are encoded as such.  A null or empty text has no tokens;
    repeated rows are encoded alike; other columns are carried, and one that is called as ``out_col``
    is refused with a ValueError; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    _free(docs, keep, out_col)
    slim = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        with coding(path) as coder:
            for whole in batches:
                for batch, texts in each_text(whole, len(keep)):
                    ids = [np.frombuffer(coder.encode(t), "<u4").astype(np.int32) for t in texts]
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=[*batch.schema.names[:-1], "ids_"])

    ddl = ", ".join([f"c{i}_ {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["ids_ array<int>"])
    return slim.mapInArrow(run, ddl).select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(keep)], F.col("ids_").alias(out_col))


def bpe_decode(coded: DataFrame, path: str, *, ids_col: str = "ids", keep: list[str] | None = None, out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the texts of the ids joined by one space, cut from an offset table.

    Null ids give a null text; ids within the list that are null or that no token has are left out.
    Other columns are carried, and one that is called as ``out_col`` is refused with a ValueError.
    """
    keep = [c for c in coded.columns if c != ids_col] if keep is None else keep
    _free(coded, keep, out_col)
    slim = coded.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(keep)], F.col(ids_col).cast("array<long>").alias("_ids"))

    def run(batches):
        tokens = vocabulary(path).tokens
        for batch in batches:
            texts = [None if row is None else tokens.text(np.array([-1 if i is None else i for i in row], np.int64)) for row in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded_"])

    ddl = ", ".join([f"c{i}_ {coded.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["decoded_ string"])
    return slim.mapInArrow(run, ddl).select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(keep)], F.col("decoded_").alias(out_col))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the encoding and of its decoding by offsets, without moving either between processes.

    A null or empty text has no tokens; repeated rows and null ids are rows like others; other columns
    are not carried; an empty table gives an empty result.
    """

    def run(batches):
        digits = decimals(path)
        with coding(path) as coder:
            for whole in batches:
                for batch, texts in each_text(whole, 1):
                    ids = [_ids_of(coder.encode(t)) for t in texts]
                    counts = pa.array([len(x) for x in ids], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(digits.digests(ids), pa.string()), pa.array(coder.tokens.digests(ids), pa.string())], names=["i", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    ddl = f"i {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return slim.mapInArrow(run, ddl).withColumnRenamed("i", id_col)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_vocabulary())
