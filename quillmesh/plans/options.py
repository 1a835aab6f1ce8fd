"""Options of reads, graphs, diffs and crawls: plan-time constants, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, fields
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from quillmesh.functions.urls import normalized
from quillmesh.operators.markers import marker_filter

FORMATS = ("markdown", "json", "html", "text", "toon", "raw", "graph")
LINKS, IMAGES, CACHES = ("inline", "referenced", "discard"), ("keep", "alt-only", "discard"), ("default", "bypass", "force")
#: query parameters that belong to a read and not to the page that is read
RESERVED = ("url", "format", "selector", "frontmatter", "links", "images", "ua", "timeout", "cache", "marker", "classify", "track")

# User agents by name, and the headers that go with them.
AGENTS = {
    "chrome": "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/131.0.0.0 Safari/537.36",
    "firefox": "Mozilla/5.0 (Macintosh; Intel Mac OS X 14.7; rv:133.0) Gecko/20100101 Firefox/133.0",
    "googlebot": "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; Googlebot/2.1; +http://www.google.com/bot.html) Safari/537.36",
    "bingbot": "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
}
BOT_HEADERS = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.5"}
BROWSER_HEADERS = {
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9",
    "Sec-Ch-Ua": '"Google Chrome";v="131", "Chromium";v="131", "Not_A Brand";v="24"', "Sec-Ch-Ua-Mobile": "?0", "Sec-Ch-Ua-Platform": '"macOS"',
    "Sec-Fetch-Dest": "document", "Sec-Fetch-Mode": "navigate", "Sec-Fetch-Site": "none", "Sec-Fetch-User": "?1", "Upgrade-Insecure-Requests": "1", "Cache-Control": "no-cache", "Pragma": "no-cache",
}


class OptionError(ValueError):
    """An option out of its bounds; code 400."""

    code = 400


def flag(value, default: bool | None = None) -> bool | None:
    """A boolean as people write it."""
    if value is None or value == "":
        return default
    if isinstance(value, bool):
        return value
    found = {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
    if found is None:
        raise OptionError(f"not a flag: {value!r}")
    return found


def _one_of(name: str, value, allowed):
    if value not in allowed:
        raise OptionError(f"{name} must be one of {', '.join(allowed)}")


@dataclass(frozen=True)
class ReadOptions:
    format: str = "markdown"
    selector: str | None = None
    frontmatter: bool = True
    links: str = "inline"
    images: str = "keep"
    ua: str | None = None
    timeout: int = 15_000
    cache: str = "default"
    marker: tuple[str, ...] | None = None
    classify: bool = False
    track: bool = False
    bare_references: bool | tuple[str, ...] = True  # see sources.pages.ParseOptions

    def __post_init__(self):
        _one_of("format", self.format, FORMATS)
        _one_of("links", self.links, LINKS)
        _one_of("images", self.images, IMAGES)
        _one_of("cache", self.cache, CACHES)
        if not 1_000 <= self.timeout <= 30_000:
            raise OptionError("timeout must lie between 1000 and 30000")


@dataclass(frozen=True)
class GraphOptions:
    link_entities: bool = True
    limit: int = 8
    claims: bool = True
    lang: str | None = None
    selector: str | None = None
    classify: bool = False
    labelled_ids: bool = False  # whether a block's id names its label by the rules, though nodes aren't classified
    bare_references: bool | tuple[str, ...] = True

    def __post_init__(self):
        if not 0 <= self.limit <= 15:
            raise OptionError("limit must lie between 0 and 15")


@dataclass(frozen=True)
class DiffOptions:
    update: bool = True
    output: str = "unified"
    classify: bool = False
    selector: str | None = None

    def __post_init__(self):
        _one_of("output", self.output, ("unified", "json"))


@dataclass(frozen=True)
class CrawlOptions:
    expand: bool = False
    limit: int = 20


def parse_options(kind, *sources: dict):
    """An option object from string maps; later maps win, unknown names are passed over."""
    merged: dict = {}
    for source in sources:
        merged |= {k: v for k, v in (source or {}).items() if v is not None}
    out = {}
    for f in fields(kind):
        if f.name not in merged:
            continue
        value = merged[f.name]
        if f.name == "marker":
            found = marker_filter(value)
            out[f.name] = tuple(found) if found else None
        elif "bool" in str(f.type):
            out[f.name] = flag(value, f.default)
        elif "int" in str(f.type):
            try:
                out[f.name] = int(value)
            except (TypeError, ValueError):
                raise OptionError(f"{f.name} must be a whole number") from None
        else:
            out[f.name] = value
    return kind(**out)


def diff_output(value: str | None) -> str:
    return "json" if value == "json" else "unified"


def split_request(request: str) -> tuple[str | None, dict]:
    """(page address, options) of one address: reserved parameters are options, others stay with the page."""
    url = normalized(request)
    if url is None:
        return None, {}
    parts = urlsplit(url)
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    own = {k: v for k, v in pairs if k in RESERVED}
    if "url" in own:
        raise OptionError("url can't be a parameter of the page's own address")
    rest = [(k, v) for k, v in pairs if k not in RESERVED]
    return urlunsplit(parts._replace(query=urlencode(rest))), own


def resolve_agent(ua: str | None) -> str:
    return AGENTS.get((ua or "chrome").lower(), ua or AGENTS["chrome"])


def request_headers(ua: str, overrides: dict | None = None) -> dict:
    """Headers for an agent; overrides win whatever their case."""
    bot = any(w in ua.lower() for w in ("bot", "crawler", "spider"))
    out = {"User-Agent": ua} | (BOT_HEADERS if bot else BROWSER_HEADERS)
    names = {k.lower(): k for k in out}
    for k, v in (overrides or {}).items():
        out[names.get(k.lower(), k)] = v
    return out


def cache_key(request: str, options: ReadOptions | GraphOptions) -> str:
    """The request's address with its options as sorted parameters."""
    parts = urlsplit(request)
    pairs = dict(parse_qsl(parts.query, keep_blank_values=True))
    if isinstance(options, GraphOptions):
        pairs["_format"] = "graph"
        pairs |= {k: v for k, v in (("_selector", options.selector), ("_link", None if options.link_entities else "0"), ("_limit", str(options.limit) if options.limit != 8 else None), ("_claims", None if options.claims else "0"), ("_bare_references", None if options.bare_references is True else str(options.bare_references))) if v}
    else:
        pairs["_format"] = options.format
        default = ReadOptions()
        for name in ("selector", "links", "images", "ua", "timeout", "bare_references"):
            if getattr(options, name) != getattr(default, name):
                pairs["_" + name] = str(getattr(options, name))
        if not options.frontmatter:
            pairs["_frontmatter"] = "false"
        if options.marker:
            pairs["_marker"] = ",".join(options.marker)
        pairs |= {"_" + n: "1" for n in ("classify", "track") if getattr(options, n)}
    return urlunsplit(parts._replace(query=urlencode(sorted(pairs.items()))))
