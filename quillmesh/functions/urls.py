"""URLs as browsers read them: parsing, resolution and normal form for http and https."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PORTS = {"http": "80", "https": "443"}
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|]")


def _encoded(part: str, keep: str) -> str:
    return quote(part, safe=keep + "%")


@lru_cache(maxsize=1 << 14)  # a page's addresses are resolved one after the other against the same base
def canonical(url: str) -> str | None:
    """The serialised form of an absolute URL; None if it can't be parsed."""
    url = re.sub(r"[\t\n\r]", "", url.strip("\x00\x01\x02\x03\x04\x05\x06\x07\x08\t\n\x0b\x0c\r\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f "))
    found = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)$", url, re.S)
    if not found:
        return None
    scheme, rest = found[1].lower(), found[2]
    if scheme not in _PORTS:
        return f"{scheme}:{rest}" if rest else None
    rest = re.sub(r"^[/\\]*", "", rest)
    body, hash_, fragment = rest.partition("#")
    body, mark, query = body.partition("?")
    host, slash, path = re.match(r"([^/\\]*)([/\\]?)(.*)$", body, re.S).groups()
    user, at, host = host.rpartition("@")
    six = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\])(?::(\d*))?", host)
    name, port = (six[1], six[2] or "") if six else (host.partition(":")[0], host.partition(":")[2])
    if port and not port.isdigit() or port and int(port) > 65535:
        return None
    try:
        name = name.lower() if name.isascii() else name.lower().encode("idna").decode()
    except UnicodeError:
        return None
    if not name or not six and _BAD_HOST.search(name):
        return None
    port = str(int(port)) if port else ""
    out = f"{scheme}://{user + '@' if at and user else ''}{name}"
    if port and port != _PORTS[scheme]:
        out += f":{port}"
    steps: list[str] = []
    parts = path.replace("\\", "/").split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            steps = steps[:-1]
            if last:
                steps.append("")
        elif plain == ".":
            if last:
                steps.append("")
        else:
            steps.append(_encoded(part, "!$&'()*+,;=:@~|[]^-._"))
    out += "/" + "/".join(steps)
    if mark:
        out += "?" + _encoded(query, "!$&()*+,;=:@~/?[]|^`{}\\-._")
    if hash_:
        out += "#" + _encoded(fragment, "!$&'()*+,;=:@~/?#[]|^{}\\-._")
    return out


def resolve(href: str, base: str) -> str | None:
    """``href`` against ``base`` in serialised form; None if neither gives a URL."""
    href = href.strip()
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", href):
        return canonical(href)
    root = canonical(base)
    if root is None:
        return None
    if href.startswith(("//", "\\\\")):
        return canonical(root.split(":")[0] + ":" + href)
    try:
        return canonical(urljoin(root, href.replace("\\", "/"))) if href else canonical(root.split("#")[0])
    except ValueError:
        return None


def normalized(raw: str) -> str | None:
    """A typed address as a URL: scheme mended or https put before it."""
    s = raw.strip()
    if not s:
        return None
    if not re.match(r"https?://", s, re.I):
        s = re.sub(r"^(https?:/)", r"\1/", s, flags=re.I) if re.match(r"https?:/[^/]", s, re.I) else "https://" + s
    return canonical(s)


def origin_of(url: str) -> str | None:
    found = canonical(url)
    parts = urlsplit(found) if found else None
    return f"{parts.scheme}://{parts.netloc.rpartition('@')[2]}" if parts and parts.netloc else None


@F.pandas_udf(StringType())
def _normalize(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else normalized(x))


@F.pandas_udf(StringType())
def _resolve(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or b is None else resolve(h, b) for h, b in zip(href, base)], dtype=object)


@F.pandas_udf(StringType())
def _origin(url: pd.Series) -> pd.Series:
    return url.map(lambda x: None if x is None else origin_of(x))


def normalize_url(c: Column) -> Column:
    return _normalize(c)


def resolve_or_null(href: Column, base: Column) -> Column:
    return _resolve(href, base)


def resolve_url(href: Column, base: Column) -> Column:
    """Resolved, or as it stands if that fails; an absent or empty one stays absent."""
    href = F.nullif(href, F.lit(""))
    return F.coalesce(_resolve(href, base), href)


def url_origin(c: Column) -> Column:
    return _origin(c)


def document_base(c: Column) -> Column:
    """Without its fragment."""
    return F.split_part(c, F.lit("#"), F.lit(1))
