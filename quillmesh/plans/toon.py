"""JSON values in TOON: indented keys, tables for arrays of like objects, inline arrays of scalars."""

from __future__ import annotations

import re

_SAFE = re.compile(r"[A-Za-z_][\w.]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _quoted(s: str) -> str:
    for raw, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(raw, to)
    return f'"{s}"'


def _scalar(v, delimiter: str = ",") -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if isinstance(v, float) and v.is_integer() else repr(v)
    s = str(v)
    bad = not s or s != s.strip() or s in ("true", "false", "null") or _NUMBER.fullmatch(s) or s.startswith("-") or any(c in s for c in f':"\\[]{{}}\n\r\t{delimiter}')
    return _quoted(s) if bad else s


def _key(k: str) -> str:
    return k if _SAFE.fullmatch(k) else _quoted(k)


def _plain(v) -> bool:
    return not isinstance(v, (dict, list))


def toon(value, indent: int = 2) -> str:
    """The text of a value; empty for an empty object."""
    out: list[str] = []

    def line(depth: int, text: str) -> None:
        out.append(" " * (indent * depth) + text)

    def array(depth: int, head: str, items: list) -> None:
        n = len(items)
        if all(_plain(v) for v in items):
            line(depth, f"{head}[{n}]:" + (" " + ",".join(map(_scalar, items)) if n else ""))
            return
        if all(isinstance(v, dict) and v for v in items):
            keys = list(items[0])
            if all(set(v) == set(keys) and all(map(_plain, v.values())) for v in items):
                line(depth, f"{head}[{n}]{{{','.join(map(_key, keys))}}}:")
                for v in items:
                    line(depth + 1, ",".join(_scalar(v[k]) for k in keys))
                return
        line(depth, f"{head}[{n}]:")
        for v in items:
            if _plain(v):
                line(depth + 1, f"- {_scalar(v)}")
            elif isinstance(v, list):
                array(depth + 1, "- ", v)
            elif not v:
                line(depth + 1, "-")
            else:
                at = len(out)
                fields(depth + 2, v)
                out[at] = " " * (indent * (depth + 1)) + "- " + out[at].lstrip(" ")

    def fields(depth: int, obj: dict) -> None:
        for k, v in obj.items():
            if isinstance(v, dict):
                line(depth, f"{_key(k)}:")
                fields(depth + 1, v)
            elif isinstance(v, list):
                array(depth, _key(k), v)
            else:
                line(depth, f"{_key(k)}: {_scalar(v)}")

    if isinstance(value, dict):
        fields(0, value)
    elif isinstance(value, list):
        array(0, "", value)
    else:
        return _scalar(value)
    return "\n".join(out)
