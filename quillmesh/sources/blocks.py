"""Typed blocks of a parsed page, as flat rows in document order."""

from __future__ import annotations

import re
from collections.abc import Iterator

from quillmesh.sources.emit import HEADINGS, Style, absolute, markdown, own_rows
from quillmesh.sources.html import Node

GROUPING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol table blockquote pre div section article main header footer aside nav details summary".split())
_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")


def _link_or_text(text: str) -> dict:
    found = _LINK.fullmatch(text)
    return {"type": "link", "text": found[1].strip(), "href": found[2].strip()} if found else {"type": "paragraph", "text": text}


def _leaf(node: Node, style: Style) -> dict | None:
    """An element without block children: picture, link or paragraph."""
    text = node.text().strip()
    image = node.first("img")
    if image is not None and not text:
        return {"type": "image", "src": image.get("src") or "", "alt": image.get("alt") or ""}
    link = node.first("a")
    if link is not None and text == link.text().strip():
        return {"type": "link", "href": link.get("href") or "", "text": link.text().strip()}
    said = markdown(node, style)
    return _link_or_text(said) if said and node.tag not in ("script", "style") else None


def _block(node: Node, style: Style, want: frozenset[str] | None = None) -> dict | None:
    tag = node.tag
    read = lambda *columns: want is None or not want.isdisjoint(columns)
    if tag in HEADINGS:
        return {"type": "heading", "level": int(tag[1]), "text": markdown(node, style)}
    if tag == "p":
        return _leaf(node, style)
    if tag == "a":
        return {"type": "link", "href": node.get("href") or "", "text": node.text().strip()}
    if tag == "blockquote":
        text = markdown(node, style)
        return {"type": "blockquote", "text": text} if text else None
    if tag in ("code", "pre"):
        found = re.search(r"language-(\w+)", node.get("class") or "", re.ASCII)
        return {"type": "code", "language": found[1] if found else "", "code": node.text().strip()}
    if tag == "img":
        return {"type": "image", "src": node.get("src") or "", "alt": node.get("alt") or ""}
    if tag in ("ul", "ol") and not read("items"):
        return {"type": "list", "ordered": tag == "ol"}
    if tag in ("ul", "ol"):
        own = [n for n in node.walk() if n.tag == "li" and n.parent is not None and n.parent.closest("ul", "ol") is node]
        items = [_link_or_text(markdown(li, style)) for li in own]
        return {"type": "list", "ordered": tag == "ol", "items": [{"text": x["text"], "href": x.get("href")} for x in items]}
    if tag == "table" and not read("headers", "rows"):
        return {"type": "table"}
    if tag == "table":
        rows = own_rows(node)
        said = [[markdown(c, style) for c in r] for r in rows]
        head = bool(rows) and any(c.tag == "th" for c in rows[0])
        return {"type": "table", "headers": said[0] if head else [], "rows": said[1:] if head else said}
    if any(isinstance(c, Node) and c.tag in GROUPING for c in node.children):
        return {"type": "group", "tag_name": tag}
    return _leaf(node, style)


def stream_blocks(root: Node, style: Style, want: frozenset[str] | None = None) -> Iterator[dict]:
    """Rows with ord (preorder), parent_ord (null at the top), depth and section_ord, one after the other.

    A group comes out just before its first block, so one without content is left out.  ``section_ord`` is that
    of the last heading at the top level, -1 before any.  With ``want``, what only other columns need isn't read.
    """
    n, section = 0, -1
    open_: list = [(iter(root.children), None)]  # what is left of each open element, and the row of its group
    while open_:
        child = next(open_[-1][0], None)
        if child is None:
            open_.pop()
            continue
        depth = len(open_) - 1
        if isinstance(child, str):
            row = {"type": "paragraph", "text": child.strip()} if child.strip() else None
        else:
            row = _block(child, style, want)
        if row is None:
            continue
        row["depth"] = depth
        if isinstance(child, Node):
            row |= {"html_id": child.get("id") or None, "html_class": child.get("class") or None}
            for kind in ("href", "src"):
                if row.get(kind) and (want is None or f"{kind}_url" in want):
                    row[f"{kind}_url"] = absolute(row[kind], style)
        if row["type"] == "group":
            open_.append((iter(child.children), row))
            continue
        if depth == 0 and row["type"] == "heading":
            section = n
        above = None
        for one in [g for _, g in open_[1:]] + [row]:
            if "ord" not in one:
                one |= {"ord": n, "parent_ord": above, "section_ord": section}
                n += 1
                yield one
            above = one["ord"]


def block_rows(root: Node, style: Style) -> list[dict]:
    """All rows of a page."""
    return list(stream_blocks(root, style))
