"""Byte-level and piece tokens of public vocabularies: ids of texts and the bytes of each id."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from quillmesh.llm.bpe import byte_letters

# Fixed value: the pattern by which byte-level vocabularies of this kind cut a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: letters of a run without (or of nothing but) white space past which the slower, linear encoder is asked
LONG_RUN = 1000


class ByteVocabulary:
    """A byte-level BPE file of the tokenizers library.

    Where token ids follow the order of merges, as they do in such files as a rule, texts are encoded by
    tiktoken from the same tokens as ranks, which gives the same ids several times faster; texts with
    very long runs, and files of another kind, are left to the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        own = {t: i for t, i in vocab.items() if t not in self.special}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in own.items()}
        self.bytes_of: list[bytes | None] = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        merged = [own.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in merges]
        singles = [i for t, i in ranks.items() if len(t) == 1]
        plain = not spec.get("normalizer") and not any(spec["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        split = spec.get("pre_tokenizer") or {}
        plain &= split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", False)
        plain &= len(singles) == 256 and len(merged) + 256 == len(ranks) and merged == sorted(merged) and min(merged) > max(singles)
        plain &= all(not any(x.get(y) for y in ("single_word", "lstrip", "rstrip", "normalized")) for x in spec["added_tokens"])
        self.quick = None
        if plain:
            import tiktoken

            self.quick = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.special)
        self.runs = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def ids(self, text: str, *, special: bool) -> np.ndarray:
        """The ids (unsigned 32 bits) of a whole text; ``special``: whether special tokens' strings in it stand for these."""
        if self.quick is None or (len(text) >= LONG_RUN and self.runs.search(text)):
            self.library.encode_special_tokens = not special
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        marks = set(self.special) if special and any(s in text for s in self.special) else set()
        return self.quick.encode_to_numpy(text, allowed_special=marks, disallowed_special=()).astype(np.uint32, copy=False)


class PieceVocabulary:
    """A sentencepiece model: pieces in UTF-8 with U+2581 as a space, <0xHH> as the byte HH."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes | None] = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> ByteVocabulary:
    """One for each worker process."""
    return ByteVocabulary(path)


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> PieceVocabulary:
    """One for each worker process."""
    return PieceVocabulary(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
