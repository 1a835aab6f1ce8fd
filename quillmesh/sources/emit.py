"""Markdown from the tree: one emitter for whole pages and for single blocks.

Inline content is folded into one line of text with marks; block content is a list of paragraphs set
apart by empty lines.  Bullets are ``-``, emphasis ``_`` and ``**``, code is fenced, rules are ``---``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillmesh.functions.urls import resolve
from quillmesh.sources.html import BLOCKS, Node

REMOVED = frozenset("script style noscript iframe form button".split())
# Signs of markdown that a text must not set by chance.
_SPECIAL = ((re.compile(r"([\\*`\[\]_])"), r"\\\1"), (re.compile(r"^(-|\+ |=+|>|~~~)"), r"\\\1"), (re.compile(r"^(#{1,6}) "), r"\\\1 "), (re.compile(r"^(\d+)\. "), r"\1\\. "))
#: finds whether any of them can be in a text
_ANY_SPECIAL = re.compile(r"[\\*`\[\]_]|^[-+=>~#\d]")
_BLANKS, _DOUBLED = re.compile(r"[ \t\r\n]+"), re.compile(r" {2,}(?!\n)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Style:
    """How links and images are written, and what relative targets are relative to."""

    base: str = ""
    links: str = "inline"  # inline, referenced (written inline), discard
    images: str = "keep"  # keep, alt-only, discard


def absolute(href: str, style: Style) -> str:
    return resolve(href, style.base) or href


def _escaped(text: str) -> str:
    if not _ANY_SPECIAL.search(text):
        return text
    for pattern, to in _SPECIAL:
        text = pattern.sub(to, text)
    return text


def _wrapped(mark: str, inner: str) -> str:
    body = inner.strip()
    if not body:
        return inner
    left, right = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    return f"{left}{mark}{body}{mark}{right}"


def _single(text: str) -> str:
    """One blank for several, but before a line's end."""
    return _DOUBLED.sub(" ", text) if "  " in text else text


def inline(node: Node | str, style: Style) -> str:
    if isinstance(node, str):
        return _escaped(_BLANKS.sub(" ", node))
    tag = node.tag
    if tag in REMOVED:
        return ""
    if tag == "br":
        return "  \n"
    if tag == "img":
        alt = node.get("alt") or ""
        if style.images == "discard":
            return ""
        if style.images == "alt-only":
            return alt.strip()
        src = node.get("src")
        return f"![{re.sub(r'[\[\]\n]', ' ', alt).strip()}]({absolute(src, style)})" if src else ""
    if tag == "code":
        raw = re.sub(r"\r?\n|\r", " ", node.text())
        if not raw:
            return ""
        fence = "`"
        while fence in re.findall(r"`+", raw):
            fence += "`"
        pad = " " if raw.startswith("`") or raw.endswith("`") else ""
        return f"{fence}{pad}{raw}{pad}{fence}"
    inner = _single("".join([inline(c, style) for c in node.children]))
    if tag in ("em", "i"):
        return _wrapped("_", inner)
    if tag in ("strong", "b"):
        return _wrapped("**", inner)
    if tag in ("del", "s", "strike"):
        return _wrapped("~", inner)
    if tag == "input" and node.get("type") == "checkbox":
        return "[x] " if node.get("checked") is not None else "[ ] "
    if tag == "a":
        href = node.get("href")
        if not href or style.links == "discard":
            return inner
        title = node.get("title")
        quoted = f' "{title.replace(chr(34), chr(92) + chr(34))}"' if title else ""
        return f"[{inner.strip() if inner.strip() else inner}]({absolute(href, style)}{quoted})"
    return inner


def own_rows(table: Node) -> list[list[Node]]:
    """Cells of the rows that belong to this table and not to one inside it."""
    rows = [n for n in table.walk() if n.tag == "tr" and n.parent is not None and n.parent.closest("table") is table]
    return [[c for c in r.walk() if c.tag in ("th", "td") and c.parent is not None and c.parent.closest("tr") is r] for r in rows]


def _table(node: Node, style: Style) -> str:
    rows = [[re.sub(r"\s+", " ", markdown(c, style)).replace("|", "\\|").strip() for c in r] for r in own_rows(node)]
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = [r + [""] * (width - len(r)) for r in rows]
    lines.insert(1, ["---"] * width)
    return "\n".join(f"| {' | '.join(r)} |" for r in lines)


def _list(node: Node, style: Style) -> str:
    out, number = [], int(node.get("start") or 1) if (node.get("start") or "1").lstrip("-").isdigit() else 1
    for item in node.children:
        if not isinstance(item, Node):
            continue
        mark = f"{number}.  " if node.tag == "ol" else "-   "
        number += 1
        body = markdown(item, style, tight=True)
        out.append(mark + re.sub(r"\n(?!\n|$)", "\n    ", body))
    return "\n".join(out)


def _paragraphs(node: Node, style: Style, tight: bool = False) -> list[str]:
    """The blocks of an element, each as its own text."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if not line:
            return
        text = _single("".join(line)).strip(" \n\t")
        line.clear()
        if text:
            out.append(text)

    for child in node.children:
        if isinstance(child, str) or child.tag not in BLOCKS and not child.spread:
            line.append(inline(child, style))
            continue
        if child.tag in REMOVED:
            continue
        flush()
        tag = child.tag
        if tag in HEADINGS:
            text = re.sub(r"\s*\n\s*", " ", " ".join(_paragraphs(child, style))).strip()
            if text:
                out.append("#" * int(tag[1]) + " " + text)
        elif tag == "hr":
            out.append("---")
        elif tag in ("ul", "ol"):
            text = _list(child, style)
            if text:
                out.append(text)
        elif tag == "table":
            text = _table(child, style)
            if text:
                out.append(text)
        elif tag == "blockquote":
            text = markdown(child, style)
            if text:
                out.append(re.sub(r"^", "> ", text, flags=re.M))
        elif tag == "pre":
            code = child.first("code")
            lang = re.search(r"language-(\S+)", (code.get("class") if code else "") or "")
            raw = (code or child).text()
            fence = "```"
            while re.search(rf"^{fence}", raw, re.M):
                fence += "`"
            out.append(f"{fence}{lang[1] if lang else ''}\n{raw.removesuffix(chr(10))}\n{fence}")
        else:
            out.extend(_paragraphs(child, style))
    flush()
    return out


def markdown(node: Node, style: Style, tight: bool = False) -> str:
    """The content of an element."""
    parts = _paragraphs(node, style)
    if not tight:
        return "\n\n".join(parts).strip()
    loose = any(isinstance(c, Node) and c.tag == "p" for c in node.children)
    return ("\n\n" if loose else "\n").join(parts).strip()
