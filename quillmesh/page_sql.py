"""SQL of what whole reads give for the pages table, whose pages follow one skeleton.

A page is a navigation list, an advertisement, an article (a heading and paragraphs, some of them begun by a
bold line that is never closed) and a footer.  Each statement starts from the HTML and shares nothing with
the library but the patterns of the classifier, which are fixed values.
"""

from __future__ import annotations

from quillmesh.functions import patterns as P
from quillmesh.operators.graph import CONTEXT
from quillmesh.operators.markers import MARK

#: the label of a text ``t``, and the hash of a text
LABEL = (
    "CASE WHEN regexp_matches(t, '{price}') THEN 'pricing' WHEN regexp_matches(t, '{date}') THEN 'date' WHEN regexp_matches(t, '{rating}') THEN 'rating'"
    " WHEN regexp_matches(t, '{email}') OR regexp_matches(t, '{phone}') THEN 'contact' WHEN regexp_matches(t, '{author}') AND length(t) < 120 THEN 'author'"
    " WHEN regexp_matches(t, '{product}') THEN 'product' ELSE 'paragraph' END"
).format(**{k: v.replace("'", "''") for k, v in P.SQL.items()})
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: ((xor(h, c)) * 16777619) & 4294967295)"
CONFIDENCE = "CASE label WHEN 'list' THEN '0.8' WHEN 'heading' THEN '1.0' WHEN 'pricing' THEN '0.85' WHEN 'date' THEN '0.8' WHEN 'rating' THEN '0.75' WHEN 'contact' THEN '0.8' WHEN 'author' THEN '0.6' WHEN 'product' THEN '0.65' ELSE '0.5' END"
_N = "chr(10)"


def _hash(text: str) -> str:
    return f"printf('%08x', {FNV.format(text)})"


def _json(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


def _decoded(x: str) -> str:
    for name, sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{name}', '{sign}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _said(x: str) -> str:
    """A piece of HTML as a line of markdown: tags off, entities read, spaces folded, signs of markdown escaped."""
    x = f"regexp_replace({_decoded(f"regexp_replace({x}, '</?(b|p|br)>', '', 'g')")}, '[ \\t\\r\\n]+', ' ', 'g')"
    for pattern, to, every in ((r"([\\*`\[\]_])", r"\\\1", ", 'g'"), (r"^(-|\+ |=+|>|~~~)", r"\\\1", ""), (r"^(#{1,6}) ", r"\\\1 ", ""), (r"^(\d+)\. ", r"\1\\. ", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}'{every})"
    return f"trim({x}, ' ' || {_N})"


def _block(type_: str, depth: int, text: str = "NULL", level: str = "NULL", tag: str = "NULL", css: str = "NULL") -> str:
    return f"{{'type': '{type_}', 'level': CAST({level} AS INTEGER), 'depth': {depth}, 'text': CAST({text} AS VARCHAR), 'tag': CAST({tag} AS VARCHAR), 'css': CAST({css} AS VARCHAR)}}"


_LINE = f"CASE WHEN starts_with(x, '<b>') AND {_said('x')} <> '' THEN '**' || {_said('x')} || '**' ELSE {_said('x')} END"
#: ``page``: a page with its list's items and its blocks; ``row``: a row for each block, with its label
_PAGES = rf"""raw AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+', 0) AS origin, split_part(url, '#', 1) AS base, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, trim({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head, string_split(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<p>') AS lines, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS foot FROM pages),
page AS (SELECT page_id, url, origin, base, lang, title, list_transform(regexp_extract_all(nav, '<a href="([^"]*)">', 1), lambda h: origin || array_to_string(list_transform(string_split(h, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')) AS hrefs, list_transform(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1), lambda x: {_said('x')}) AS names,
list_filter([{_block('group', 0, tag="'nav'")}, {_block('list', 1)}, {_block('paragraph', 0, _said('ad'), css="'ad'")}, {_block('group', 0, tag="'article'")}, {_block('heading', 1, _said('head'), '1')}] || list_transform(lines[2:], lambda x: {_block('paragraph', 1, _LINE)}) || [{_block('paragraph', 0, _said('foot'))}], lambda b: b.text IS NULL OR b.text <> '' OR b.type = 'heading') AS blocks FROM raw),
row AS (SELECT page_id, url, base, ord, b.*, CASE WHEN b.type = 'paragraph' THEN label ELSE b.type END AS label, CASE WHEN b.depth = 1 THEN CASE WHEN b.type = 'list' THEN 0 ELSE article END END AS parent_ord FROM (SELECT page_id, url, base, ord, b, article, {LABEL} AS label FROM (SELECT *, coalesce(b.text, '') AS t FROM (SELECT page_id, url, base, unnest(blocks) AS b, unnest(range(len(blocks))) AS ord, list_position(list_transform(blocks, lambda y: coalesce(y.tag, '')), 'article') - 1 AS article FROM page))))"""
_ITEMS = f"array_to_string(list_transform(range(1, len(names) + 1), lambda i: '{{\"text\":' || {_json('names[i]')} || ',\"href\":' || {_json('hrefs[i]')} || '}}'), ',')"
_TYPE = "text/html; charset=utf-8"
_RECORD = "'{\"url\":' || " + " || ".join((_json("url"), "',\"finalUrl\":'", _json("url"), f"',\"status\":200,\"contentType\":\"{_TYPE}\"'", f"coalesce(',\"title\":' || {_json("nullif(title, '')")}, '')", f"coalesce(',\"lang\":' || {_json("nullif(lang, '')")}, '')", *[f"',\"{n}\":' || {_json(f"origin || '/{f}'")}" for n, f in (("favicon", "favicon.ico"), ("sitemap", "sitemap.xml"), ("robots", "robots.txt"))], "'}'"))
_HEAD = f"""'---' || {_N} || 'url: ' || url || {_N} || 'finalUrl: ' || url || {_N} || 'status: 200' || {_N} || 'contentType: {_TYPE}' || {_N} || coalesce('title: ' || nullif(title, '') || {_N}, '') || coalesce('lang: ' || nullif(lang, '') || {_N}, '') || 'favicon: ' || origin || '/favicon.ico' || {_N} || 'sitemap: ' || origin || '/sitemap.xml' || {_N} || 'robots: ' || origin || '/robots.txt' || {_N} || '---' || {_N} || {_N}"""
_MARKDOWN_LIST = "array_to_string(list_transform(range(1, len(names) + 1), lambda i: '{0}[' || names[i] || '](' || hrefs[i] || ')'), chr(10))"

BLOCKS = f"WITH {_PAGES} SELECT page_id, CAST(ord AS INTEGER) AS ord, CAST(parent_ord AS INTEGER) AS parent_ord, CAST(depth AS INTEGER) AS depth, type, level, text, CAST(NULL AS VARCHAR) AS href, tag AS tag_name FROM row"
RECORDS = f"WITH {_PAGES} SELECT page_id, {_RECORD} AS record FROM page"
MARKDOWN = f"""WITH {_PAGES}, said AS (SELECT page_id, string_agg(CASE WHEN type = 'heading' THEN '# ' || text ELSE text END, {_N} || {_N} ORDER BY ord) AS rest FROM row WHERE text <> '' GROUP BY page_id)
SELECT page_id, 'dom' AS engine, {_HEAD} || {_MARKDOWN_LIST.format('-   ')} || {_N} || {_N} || rest || {_N} AS body FROM page JOIN said USING (page_id)"""
_WANTED = ("paragraph", "list", "author")
MARKED = f"""WITH {_PAGES}, shown AS (SELECT page_id, ord, label, CASE WHEN type = 'list' THEN {_MARKDOWN_LIST.format('- ')} WHEN type = 'heading' THEN '# ' || text ELSE text END AS md, CASE WHEN type = 'list' THEN array_to_string(names, ' ') ELSE text END AS said FROM row JOIN (SELECT page_id, names, hrefs FROM page) USING (page_id) WHERE type <> 'group'),
keyed AS (SELECT *, {_hash("label || ':' || said")} AS k FROM shown),
body AS (SELECT page_id, string_agg(CASE WHEN label IN {_WANTED} THEN '<!-- {MARK}:' || label || ':' || k || ' -->' || {_N} || md || {_N} || '<!-- /{MARK}:' || label || ':' || k || ' -->' ELSE md END, {_N} || {_N} ORDER BY ord) AS rest FROM keyed WHERE md <> '' GROUP BY page_id)
SELECT page_id, {_HEAD} || rest || {_N} AS body FROM page JOIN body USING (page_id)"""
SNAPSHOTS = f"""WITH {_PAGES}, leaf AS (SELECT url, ord, CASE WHEN type = 'list' THEN '{{"type":"list","ordered":false,"items":[' || {_ITEMS} || ']}}' ELSE text END AS content FROM row JOIN (SELECT page_id, names, hrefs FROM page) USING (page_id) WHERE type <> 'group')
SELECT url, TIMESTAMP '2024-01-01' AS fetched_at, left(sha256(string_agg(content, {_N} ORDER BY ord)), 32) AS content_hash, count(*) AS n_blocks FROM leaf GROUP BY url"""

_OWN = f"""CASE WHEN type = 'list' THEN '{{"type":"list","ordered":false,"items":[' || {_ITEMS} || '],' ELSE '{{"type":"' || type || '",' || coalesce('"level":' || level || ',', '') || '"text":' || {_json('text')} || ',' || coalesce('"class":"' || css || '",', '') END || '"classification":"' || label || '","confidence":' || {CONFIDENCE} || '}}'"""
JSON = f"""WITH {_PAGES}, own AS (SELECT page_id, ord, parent_ord, depth, tag, CASE WHEN type <> 'group' THEN {_OWN} END AS j FROM row JOIN (SELECT page_id, names, hrefs FROM page) USING (page_id)),
below AS (SELECT page_id, parent_ord AS ord, string_agg(j, ',' ORDER BY ord) AS held FROM own WHERE depth = 1 GROUP BY ALL),
top AS (SELECT page_id, string_agg(coalesce(j, '{{"type":"group","tagName":"' || tag || '","children":[' || coalesce(held, '') || ']}}'), ',' ORDER BY ord) AS content FROM own LEFT JOIN below USING (page_id, ord) WHERE depth = 0 GROUP BY page_id)
SELECT page_id, 'dom' AS engine, '{{"metadata":' || {_RECORD} || ',"content":[{{"heading":null,"level":0,"content":[' || content || '],"children":[]}}]}}' AS body FROM page JOIN top USING (page_id)"""


def _scalar(x: str) -> str:
    """A text of TOON: quoted where it has signs of the form, looks like another kind of value, or is empty."""
    bad = rf"""{x} = '' OR {x} <> trim({x}) OR {x} IN ('true', 'false', 'null') OR starts_with({x}, '-') OR regexp_full_match({x}, '-?\d+(\.\d+)?([eE][+-]?\d+)?') OR regexp_matches({x}, '[:"\\\[\]{{}}\n\r\t,]')"""
    return f"""CASE WHEN {bad} THEN '"' || replace(replace(replace({x}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' ELSE {x} END"""


def _lines(indent: int, *parts: str) -> str:
    return " || ".join(f"'{' ' * indent}' || {p} || {_N}" for p in parts)


_SAID = f"'text: ' || {_scalar('text')}"
_LEAF = f"""CASE WHEN type = 'list' THEN {_lines(10, "'- type: list'", "'  ordered: false'", "'  items[' || len(names) || ']{text,href}:'")} || array_to_string(list_transform(range(1, len(names) + 1), lambda i: '{' ' * 14}' || {_scalar('names[i]')} || ',' || {_scalar('hrefs[i]')} || {_N}), '')
WHEN type = 'heading' THEN {_lines(10, "'- type: heading'", "'  level: 1'", f"'  ' || {_SAID}")} WHEN type = 'paragraph' AND depth = 1 THEN {_lines(10, "'- type: paragraph'", f"'  ' || {_SAID}")}
WHEN type = 'paragraph' THEN {_lines(6, "'- type: paragraph'", f"'  ' || {_SAID}")} || CASE WHEN css IS NULL THEN '' ELSE {_lines(6, "'  class: ' || css")} END END"""
TOON = f"""WITH {_PAGES}, own AS (SELECT page_id, ord, parent_ord, depth, tag, {_LEAF} AS j FROM row JOIN (SELECT page_id, names, hrefs FROM page) USING (page_id)),
below AS (SELECT page_id, parent_ord AS ord, count(*) AS n, string_agg(j, '' ORDER BY ord) AS held FROM own WHERE depth = 1 GROUP BY ALL),
top AS (SELECT page_id, count(*) AS n, string_agg(coalesce(j, {_lines(6, "'- type: group'", "'  tagName: ' || tag", "'  children[' || n || ']:'")} || held), '' ORDER BY ord) AS content FROM own LEFT JOIN below USING (page_id, ord) WHERE depth = 0 GROUP BY page_id)
SELECT page_id, 'dom' AS engine, 'metadata:' || {_N} || {_lines(2, f"'url: ' || {_scalar('url')}", f"'finalUrl: ' || {_scalar('url')}", "'status: 200'", f"'contentType: {_TYPE}'")} || CASE WHEN title = '' THEN '' ELSE {_lines(2, f"'title: ' || {_scalar('title')}")} END || CASE WHEN lang = '' THEN '' ELSE {_lines(2, "'lang: ' || lang")} END || {_lines(2, *[f"'{n}: ' || {_scalar(f"(origin || '/{f}')")}" for n, f in (("favicon", "favicon.ico"), ("sitemap", "sitemap.xml"), ("robots", "robots.txt"))])}
|| 'content[1]:' || {_N} || {_lines(2, "'- heading: null'", "'  level: 0'", "'  content[' || n || ']:'")} || content || '    children[0]:' AS body FROM page JOIN top USING (page_id)"""

_ID = f"base || '#block-' || label || '-' || CASE WHEN coalesce(text, '') = '' THEN '811c9dc5' ELSE {_hash('text')} END"
GRAPH = f"""WITH {_PAGES}, top AS (SELECT page_id, ord, text, {_ID} AS id FROM row WHERE depth = 0),
listed AS (SELECT page_id, string_agg('{{"@id":' || {_json('id')} || '}}', ',' ORDER BY ord) AS parts FROM top GROUP BY page_id),
node AS (SELECT page_id, string_agg('{{"@id":' || {_json('id')} || ',"@type":"WebPageElement"' || coalesce(',"text":' || {_json('text')}, '') || '}}', ',' ORDER BY ord) AS nodes, count(*) AS n FROM (SELECT page_id, id, min(ord) AS ord, any_value(text) AS text FROM top GROUP BY page_id, id) GROUP BY page_id)
SELECT page_id, n + 2 AS n_nodes, '{{"@context":{CONTEXT},"@graph":[{{"@id":' || {_json("base || '#webpage'")} || ',"@type":"WebPage","url":' || {_json('url')} || coalesce(',"name":' || {_json("nullif(title, '')")}, '') || coalesce(',"inLanguage":' || {_json("nullif(lang, '')")}, '') || ',"hasPart":{{"@list":[{{"@id":' || {_json("base || '#section-l0-preamble-0'")} || '}}]}}}},{{"@id":' || {_json("base || '#section-l0-preamble-0'")} || ',"@type":"WebPageElement","isPartOf":{{"@id":' || {_json("base || '#webpage'")} || '}},"hasPart":{{"@list":[' || parts || ']}}}},' || nodes || ']}}' AS document, CAST(0 AS BIGINT) AS n_linked, 'dom' AS engine, CAST(NULL AS VARCHAR) AS error
FROM page JOIN listed USING (page_id) JOIN node USING (page_id)"""
UNIFIED = rf"""WITH w AS (SELECT conv_id, turn % 2 AS odd, turn * 1000000 + k AS ord, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations)),
s AS (SELECT conv_id, word, min(ord) FILTER (WHERE odd = 0) AS p, min(ord) FILTER (WHERE odd = 1) AS c FROM w GROUP BY ALL),
o AS (SELECT *, CASE WHEN p IS NULL THEN 'added' WHEN c IS NULL THEN 'removed' ELSE 'unchanged' END AS kind, CASE WHEN p IS NULL THEN '+' ELSE '-' END AS sign, row_number() OVER (PARTITION BY conv_id ORDER BY c IS NULL, c, p) AS n FROM s),
h AS (SELECT conv_id, count(*) FILTER (WHERE kind = 'added') AS a, count(*) FILTER (WHERE kind = 'removed') AS r, count(*) FILTER (WHERE kind = 'unchanged') AS u, string_agg('@@ ' || kind || ' @@' || CASE WHEN word = '' THEN '' ELSE {_N} || sign || replace(word, {_N}, {_N} || sign) END || {_N}, {_N} ORDER BY n) FILTER (WHERE kind <> 'unchanged') AS hunks FROM o GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS url, regexp_replace('diff --quill ' || conv_id || {_N} || '--- /dev/null' || {_N} || '+++ ' || {_N} || '@@ +' || a || ' -' || r || ' ~0 (' || u || ' unchanged) @@' || {_N} || {_N} || coalesce(hunks, ' (no changes)'), '\s+$', '') || {_N} AS body FROM h"""
