"""Stable keys: FNV-1a over UTF-16 units, and shortened SHA-256."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BASIS, _PRIME = 2166136261, 16777619


def fnv1a_text(text: str) -> str:
    """The 32-bit hash as 8 hex digits."""
    h = _BASIS
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (h ^ unit) * _PRIME & 0xFFFFFFFF
    return f"{h:08x}"


def _fnv1a_batch(texts) -> np.ndarray:
    """All texts of a batch advance together, one UTF-16 unit at a time."""
    raw = [None if t is None else np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    length = np.array([0 if r is None else len(r) for r in raw])
    order = np.argsort(-length, kind="stable")
    start = np.concatenate([[0], np.cumsum(length[order])])[:-1]
    units = np.concatenate([raw[i] for i in order if length[i]]) if length.any() else np.zeros(0, np.uint16)
    h = np.full(len(raw), _BASIS, np.uint64)
    mask, prime = np.uint64(0xFFFFFFFF), np.uint64(_PRIME)
    live = np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), side="right")
    for k, m in enumerate(live.tolist()):
        h[:m] = (h[:m] ^ units[start[:m] + k]) * prime & mask
    out = np.empty(len(raw), object)
    for place, i in enumerate(order):
        out[i] = None if raw[i] is None else f"{int(h[place]):08x}"
    return out


@F.pandas_udf(StringType())
def _fnv1a(texts: pd.Series) -> pd.Series:
    return pd.Series(_fnv1a_batch(texts))


def fnv1a(c: Column) -> Column:
    """FNV-1a of a string, Arrow-batched; null stays null."""
    return _fnv1a(c)


def fnv1a_expr(c: Column) -> Column:
    """The same as an expression of the JVM, for use inside lambdas, where Python functions can't stand."""
    step = lambda h, unit: (h.bitwiseXOR(unit) * _PRIME).bitwiseAND(0xFFFFFFFF)

    def letter(h: Column, x: Column) -> Column:
        code = F.ascii(x).cast("long")
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + code.bitwiseAND(0x3FF)
        return F.when(code < 0x10000, step(h, code)).otherwise(step(step(h, high), low))

    letters = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "", -1))
    return F.lower(F.lpad(F.hex(F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(_BASIS).cast("long"), letter)), 8, "0"))


def content_hash(c: Column) -> Column:
    """The first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 32)


def snapshot_key(url: Column) -> Column:
    return F.concat(F.lit("snapshot:"), content_hash(url))


def block_key(kind: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(kind, F.lit("block")), fnv1a(F.coalesce(text, F.lit(""))))
