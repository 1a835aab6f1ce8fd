"""Text expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as the web platform counts it, inside a character class
WIDE_SPACE = r"\s   -     　﻿"
#: each of its signs
_SPACES = "".join(c for c in map(chr, range(1 << 16)) if re.match(f"[{WIDE_SPACE}]", c, re.ASCII))
#: word edges over ASCII letters, digits and underscore; Java's \b also counts accented letters
_WORD = "0-9A-Za-z_"
EDGE = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"


def trimmed(c: Column) -> Column:
    """Without white space at either end, no-break and other wide spaces included."""
    return F.trim(c, F.lit(_SPACES))


def collapse_whitespace(c: Column) -> Column:
    """CRLF to LF, blanks before a line's end dropped, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(c, "\r\n", "\n")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


def space_injection(c: Column) -> Column:
    """A space between neighbouring inline or block elements, so that their texts don't run together."""
    for left, right in (("span", "span"), ("div", "div"), ("span", "div"), ("div", "span")):
        c = F.regexp_replace(c, rf"(?i)</{left}>\s*<{right}", f"</{left}> <{right}")
    c = F.regexp_replace(c, r"(?i)</h([1-6])>\s*<h([1-6])", r"</h$1> <h$2>")
    return F.regexp_replace(c, r"(?i)</a>\s*<a", "</a> <a")


def strip_dropped(c: Column) -> Column:
    """Without comments and elements that carry no text to read."""
    c = F.regexp_replace(c, "(?is)<(script|style|noscript|iframe)\\b.*?</\\1\\s*>", "")
    return F.regexp_replace(c, "(?s)<!--.*?-->", "")


def body_of(c: Column) -> Column:
    """What stands between the body tags, or after the opening one if it is never closed."""
    found = F.regexp_extract(c, r"(?is)<body[^>]*>(.*?)(?:</body\s*>|$(?![\r\n]))", 1)
    return F.when(c.rlike("(?i)<body[\\s>]"), found).otherwise(c)


def entities(c: Column) -> Column:
    """The named entities that pages use most, the ampersand last."""
    for name, to in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def text_content(html: Column) -> Column:
    """The text of a page's body by tag stripping; the parse stage agrees with it."""
    return collapse_whitespace(entities(F.regexp_replace(space_injection(strip_dropped(body_of(html))), "<[^>]+>", "")))


def is_static(text: Column, html: Column) -> Column:
    """Whether a page has content of its own: 150 characters, or over 30 and an element that holds text."""
    n = F.length(text)
    return (n >= 150) | ((n > 30) & html.rlike(r"(?i)<(p|h1|h2|h3|li|td)[\s>]"))


def content_score(c: Column) -> Column:
    """struct(kind, score) of a text as content: HTML by its tags, markdown by its marks, prose by its words; 0 if it is none."""
    n = F.length(c)
    count = lambda p: F.regexp_count(c, F.lit(p))
    # plain searches first: most texts have none of what a pattern can't do without
    has = lambda sign, p: F.when(c.contains(sign), count(p)).otherwise(0)
    tags = has("<", "<[a-zA-Z1-6]+[^>]*>")
    marks = 30 * has("#", r"(?m)^#{1,6}\s+\S+") + 20 * has("](", r"\[[^\]]+\]\([^)]+\)") + 10 * has("**", r"\*\*[^*]+\*\*") + 15 * count(r"(?m)^\s*[-*+]\s+")
    said = lambda kind, score: F.struct(F.lit(kind).alias("kind"), score.cast("long").alias("score"))
    return F.when(n < 50, said("text", F.lit(0))).when((tags > 2) & (has("</", "</[a-zA-Z1-6]+>") > 2), said("html", n + 10 * tags)).when(marks > 10, said("markdown", n + marks)).otherwise(said("text", F.when(count(r"\s+") > 5, n).otherwise(0)))
