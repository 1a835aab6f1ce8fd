"""HTML to a small tree.

Tag soup is mended by few rules: a paragraph's start tag closes an open paragraph with all inline
elements in it, list items, table rows and cells close their like, void elements hold nothing, end
tags without a start are passed over, and the end of the text closes all.  Elements deeper than
``DEEPEST`` become siblings, as in browsers, so walks that recurse stay bounded.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

DEEPEST = 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link script style base noscript template".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ALIKE = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_STOPS_P = frozenset("body html div section article main header footer aside nav td th li table blockquote details form button figure".split())


BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_PRUNED = frozenset("script style noscript iframe".split())
_FRAME = frozenset(("html", "body", "head"))
#: plain markup, a text and what comes after it: a tag with quoted attributes, a comment, a doctype or the end
_PLAIN = re.compile(
    r"""([^<]*+)(?:<(/?)([a-z][a-z0-9-]*+)((?:[ \t\n\r\f]++[a-z_][\w:.-]*+(?:="[^"]*+"|='[^']*+')?+)*+)[ \t\n\r\f]*+(/?)>|<!--(?!-?>)(?:[^-]|-(?!-))*+-->|<!doctype[ \t\n][^<>\[\]"']*+>|\Z)""",
    re.I | re.A,
)
_PLAIN_ATTR = re.compile(r"""([a-z_][\w:.-]*+)(?:=("[^"]*+"|'[^']*+'))?+""", re.I | re.A)
#: elements whose content is a text of its own: as it stands, with references, and those left to the tokenizer
_AS_IT_IS, _TEXT, _ODD = frozenset(("script", "style")), frozenset(("title", "textarea")), frozenset("iframe noembed noframes noscript plaintext xmp".split())
_END = {tag: re.compile(rf"</{tag}([ \t\n\r\f]*>)?", re.I | re.A) for tag in _AS_IT_IS}


class Node:
    """An element; ``spread`` says whether a block element stands anywhere below it."""

    __slots__ = ("tag", "attrs", "children", "parent", "spread")

    def __init__(self, tag: str, attrs: dict | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent, self.spread = tag, attrs or {}, [], parent, False

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def walk(self):
        """All elements below, in document order."""
        todo = self.children[::-1]
        while todo:
            node = todo.pop()
            if isinstance(node, Node):
                yield node
                if node.children:
                    todo.extend(reversed(node.children))

    def text(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style") or x is self:
                todo.extend(reversed(x.children))
        return "".join(out)

    def first(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags), None)

    def closest(self, *tags: str) -> "Node | None":
        node: Node | None = self
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = Node("head", parent=self.root)
        self.body = Node("body", parent=self.root)
        self.root.children = [self.head, self.body]
        self.open = [self.root]
        self.begun = False  # whether the body is
        self.made: list[Node] = []

    def updatepos(self, i, j):
        """Lines aren't counted."""
        return j

    def _place(self, tag: str) -> Node:
        if len(self.open) > 1:
            return self.open[min(len(self.open) - 1, DEEPEST)]
        if not self.begun and tag in HEAD:
            return self.head
        self.begun = True
        return self.body

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            if k not in own:
                own[k] = v or ""
        if tag in _FRAME:
            node = {"html": self.root, "body": self.body, "head": self.head}[tag]
            for k, v in own.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self.begun = True
                self.open = [self.root]
            return
        if tag in _CLOSES_P:
            self._close("p", _STOPS_P)
        if tag in _ALIKE:
            alike, stops = _ALIKE[tag]
            for like in alike:
                self._close(like, stops)
        parent = self._place(tag)
        node = Node(tag, own, parent)
        parent.children.append(node)
        self.made.append(node)
        if tag in BLOCKS:
            while parent is not None and not parent.spread and parent.tag not in _PRUNED:
                parent.spread = True
                parent = parent.parent
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stops) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in stops:
                return

    def elements(self) -> list[Node]:
        """All elements below the root: they are made in document order, those of the head before those of the body."""
        first = next((c for c in self.body.children if isinstance(c, Node)), None)
        k = len(self.made) if first is None else self.made.index(first)
        return [self.head, *self.made[:k], self.body, *self.made[k:]]

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            self.open = [self.root]
        elif tag == "head":
            self.open = [self.root]
            self.begun = True
        else:
            self._close(tag, ())

    def handle_data(self, data):
        if len(self.open) > 1:
            self.open[-1].children.append(data)
        elif self.begun or data.strip():
            self.begun = True
            self.body.children.append(data)


def _plain(html: str, builder: _Builder | None = None) -> Node | None:
    """The tree of a page of plain markup alone, by one pattern; None for any other, which is left to the tokenizer."""
    builder = builder or _Builder()
    at, held, n = 0, None, len(html)
    while m := _PLAIN.match(html, at):
        text, shut, tag, attrs, closed = m.groups()
        tag = tag and tag.lower()
        if held and (tag != held or not shut):
            return None
        if text:
            builder.handle_data(unescape(text) if "&" in text else text)
        at = m.end()
        if tag is None:
            if at == n:
                return builder.root
        elif shut:
            if attrs or closed:
                return None
            builder.handle_endtag(tag)
            held = None
        else:
            if tag in _ODD or "&" in attrs:
                return None
            builder.handle_starttag(tag, [(k.lower(), v[1:-1]) for k, v in _PLAIN_ATTR.findall(attrs)] if attrs else ())
            if tag in _AS_IT_IS:
                end = _END[tag].search(html, at)
                if closed or not end or not end[1]:
                    return None
                if end.start() > at:
                    builder.handle_data(html[at : end.start()])
                builder.handle_endtag(tag)
                at = end.end()
            elif tag in _TEXT:
                if closed:
                    return None
                held = tag
    return None


def _built(html: str) -> _Builder:
    builder = _Builder()
    if _plain(html, builder) is None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
    return builder


def parse_html(html: str) -> Node:
    return _built(html).root


def parse_elements(html: str) -> tuple[Node, list[Node]]:
    """The tree and all elements below its root in document order, so that no walk is needed to look at each."""
    builder = _built(html)
    return builder.root, builder.elements()


def prune(root: Node, elements: list[Node] | None = None) -> None:
    """Drops what carries no content; hydration and linked-data scripts stay.  ``elements`` are all below the root, if they are known."""
    above = {id(n.parent): n.parent for n in (root.walk() if elements is None else elements) if n.tag in _PRUNED and _dropped(n)}
    for node in above.values():
        node.children = [c for c in node.children if not (isinstance(c, Node) and _dropped(c))]


def _dropped(n: Node) -> bool:
    if n.tag == "script":
        return n.get("id") != "__NEXT_DATA__" and n.get("type") != "application/ld+json"
    return n.tag in _PRUNED


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]|:not\(([^)]*)\)""", re.X)


def _matches(node: Node, simple: str) -> bool:
    at = 0
    while at < len(simple):
        m = _SIMPLE.match(simple, at)
        if not m:
            return False
        at = m.end()
        tag, id_, cls, name, how, a, b, c, inner = m.groups()
        value = a if a is not None else b if b is not None else c
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if id_ and node.get("id") != id_:
            return False
        if cls and cls not in (node.get("class") or "").split():
            return False
        if name:
            own = node.get(name.lower())
            if own is None:
                return False
            ok = {None: True, "=": own == value, "^=": own.startswith(value or ""), "$=": own.endswith(value or ""), "*=": (value or "") in own, "~=": value in own.split()}[how]
            if not ok:
                return False
        if inner and any(_matches(node, x.strip()) for x in inner.split(",")):
            return False
    return True


def select_first(root: Node, selector: str) -> Node | None:
    """The first element for a list of selectors of tags, ids, classes, attributes, :not, child and descendant."""
    choices = [re.sub(r"\s*>\s*", " > ", s.strip()).split() for s in selector.split(",") if s.strip()]
    for node in root.walk():
        if any(_chain(node, steps) for steps in choices):
            return node
    return None


def _chain(node: Node, steps: list[str]) -> bool:
    if not _matches(node, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return node.parent is not None and _chain(node.parent, steps[:-2])
    up = node.parent
    while up is not None:
        if _chain(up, steps[:-1]):
            return True
        up = up.parent
    return False


_ESCAPE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})


def inner_html(node: Node) -> str:
    """The markup of what an element holds."""
    out: list[str] = []
    todo: list = [(c, node.tag) for c in reversed(node.children)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            out.append(x if inside in ("script", "style", None) else x.translate(_ESCAPE))
            continue
        attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in x.attrs.items())
        out.append(f"<{x.tag}{attrs}>")
        if x.tag not in VOID:
            todo.append((f"</{x.tag}>", None))  # markup, written as it is
            todo.extend((c, x.tag) for c in reversed(x.children))
    return "".join(out)
