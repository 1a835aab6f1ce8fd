"""What reads of the catalogue's rich page give, by format; checked by hand against the formats' rules."""

RICH_BODIES = {
    "markdown": """---
url: https://x.org/d/p#f
finalUrl: https://x.org/d/p#f
status: 200
contentType: text/html; charset=utf-8
title: T
description: D
author: Ann Lee
lang: en
favicon: https://x.org/favicon.ico
sitemap: https://x.org/sitemap.xml
robots: https://x.org/robots.txt
---

by Ann Lee

# A _b_

## in

![x](https://x.org/d/i.png)

[go](https://x.org/l)

> q \\*r\\*

```
x = 1
y
```

1.  a
2.  [b](https://x.org/u)

| h | k |
| --- | --- |
| 1\\|2 | $5 |

## Second

loose text![](https://x.org/j.png)

call 555-123-4567, 4/5

## Third
""",
    "json": """{"metadata":{"url":"https://x.org/d/p#f","finalUrl":"https://x.org/d/p#f","status":200,"contentType":"text/html; charset=utf-8","title":"T","description":"D","author":"Ann Lee","lang":"en","favicon":"https://x.org/favicon.ico","sitemap":"https://x.org/sitemap.xml","robots":"https://x.org/robots.txt"},"content":[{"heading":null,"level":0,"content":[{"type":"paragraph","text":"by Ann Lee","id":"i","class":"c d","classification":"author","confidence":0.9}],"children":[]},{"heading":"A _b_","level":1,"content":[{"type":"group","tagName":"div","children":[{"type":"group","tagName":"section","children":[{"type":"heading","level":2,"text":"in","classification":"heading","confidence":1.0},{"type":"image","src":"i.png","alt":"x","classification":"image","confidence":1.0}]},{"type":"link","text":"go","href":"/l","classification":"link","confidence":0.9}]},{"type":"blockquote","text":"q \\\\*r\\\\*","classification":"paragraph","confidence":0.5},{"type":"code","language":"py","code":"x = 1\\ny","class":"language-py","classification":"code","confidence":1.0},{"type":"list","ordered":true,"items":[{"text":"a"},{"text":"b","href":"https://x.org/u"}],"classification":"list","confidence":0.8},{"type":"table","headers":["h","k"],"rows":[["1|2","$5"]],"classification":"pricing","confidence":0.7}],"children":[{"heading":"Second","level":2,"content":[{"type":"paragraph","text":"loose text","classification":"paragraph","confidence":0.5},{"type":"image","src":"/j.png","alt":""},{"type":"paragraph","text":"call 555-123-4567, 4/5","classification":"rating","confidence":0.75}],"children":[]},{"heading":"Third","level":2,"content":[],"children":[]}]}]}""",
    "html": """<p id="i" class="c d">by Ann Lee</p><h1>A <em>b</em></h1><div><section><h2>in</h2><p><img src="i.png" alt="x"></p></section><p><a href="/l">go</a></p></div><blockquote>q *r*</blockquote><pre class="language-py">x = 1
y</pre><ol><li>a</li><li><a href="/u">b</a></li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1|2</td><td>$5</td></tr></table><h2>Second</h2>loose text<img src="/j.png"><p>call 555-123-4567, 4/5</p><h2>Third</h2>""",
    "text": """by Ann LeeA bingoq *r*x = 1
yabhk1|2$5Secondloose textcall 555-123-4567, 4/5Third""",
    "toon": """metadata:
  url: "https://x.org/d/p#f"
  finalUrl: "https://x.org/d/p#f"
  status: 200
  contentType: text/html; charset=utf-8
  title: T
  description: D
  author: Ann Lee
  lang: en
  favicon: "https://x.org/favicon.ico"
  sitemap: "https://x.org/sitemap.xml"
  robots: "https://x.org/robots.txt"
content[2]:
  - heading: null
    level: 0
    content[1]{type,text,id,class,classification,confidence}:
      paragraph,by Ann Lee,i,c d,author,0.9
    children[0]:
  - heading: A _b_
    level: 1
    content[5]:
      - type: group
        tagName: div
        children[2]:
          - type: group
            tagName: section
            children[2]:
              - type: heading
                level: 2
                text: in
                classification: heading
                confidence: 1
              - type: image
                src: i.png
                alt: x
                classification: image
                confidence: 1
          - type: link
            text: go
            href: /l
            classification: link
            confidence: 0.9
      - type: blockquote
        text: "q \\\\*r\\\\*"
        classification: paragraph
        confidence: 0.5
      - type: code
        language: py
        code: "x = 1\\ny"
        class: language-py
        classification: code
        confidence: 1
      - type: list
        ordered: true
        items[2]:
          - text: a
          - text: b
            href: "https://x.org/u"
        classification: list
        confidence: 0.8
      - type: table
        headers[2]: h,k
        rows[1]:
          - [2]: 1|2,$5
        classification: pricing
        confidence: 0.7
    children[2]:
      - heading: Second
        level: 2
        content[3]:
          - type: paragraph
            text: loose text
            classification: paragraph
            confidence: 0.5
          - type: image
            src: /j.png
            alt: ""
          - type: paragraph
            text: "call 555-123-4567, 4/5"
            classification: rating
            confidence: 0.75
        children[0]:
      - heading: Third
        level: 2
        content[0]:
        children[0]:""",
    "graph": """{"@context":["https://schema.org",{"wd":"http://www.wikidata.org/entity/","wdt":"http://www.wikidata.org/prop/direct/","rdfs":"http://www.w3.org/2000/01/rdf-schema#","skos":"http://www.w3.org/2004/02/skos/core#"}],"@graph":[{"@id":"https://x.org/d/p#webpage","@type":"WebPage","url":"https://x.org/d/p#f","name":"T","description":"D","inLanguage":"en","author":{"@id":"https://x.org/d/p#person-184707aa"},"hasPart":{"@list":[{"@id":"https://x.org/d/p#section-l0-preamble-0"},{"@id":"https://x.org/d/p#section-l1-403c56b2-1"}]}},{"@id":"https://x.org/d/p#section-l0-preamble-0","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/p#webpage"},"hasPart":{"@list":[{"@id":"https://x.org/d/p#block-author-39b70ec5"}]}},{"@id":"https://x.org/d/p#block-author-39b70ec5","@type":"Person","name":"by Ann Lee"},{"@id":"https://x.org/d/p#section-l1-403c56b2-1","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/p#webpage"},"name":"A _b_","headline":"A _b_","position":1,"hasPart":{"@list":[{"@id":"https://x.org/d/p#block-group-811c9dc5"},{"@id":"https://x.org/d/p#block-paragraph-c441470e"},{"@id":"https://x.org/d/p#block-code-abd441fe"},{"@id":"https://x.org/d/p#block-list-10a3f9f2"},{"@id":"https://x.org/d/p#block-pricing-79c40d16"},{"@id":"https://x.org/d/p#section-l2-f486b7fd-0"},{"@id":"https://x.org/d/p#section-l2-1230b6de-1"}]}},{"@id":"https://x.org/d/p#block-group-811c9dc5","@type":"WebPageElement"},{"@id":"https://x.org/d/p#block-paragraph-c441470e","@type":"Quotation","text":"q \\\\*r\\\\*"},{"@id":"https://x.org/d/p#block-code-abd441fe","@type":"SoftwareSourceCode","text":"x = 1\\ny","programmingLanguage":"py"},{"@id":"https://x.org/d/p#block-list-10a3f9f2","@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"name":"a"},{"@type":"ListItem","position":2,"name":"b","item":"https://x.org/u"}]},{"@id":"https://x.org/d/p#block-pricing-79c40d16","@type":"Table","description":"h k 1|2 $5"},{"@id":"https://x.org/d/p#section-l2-f486b7fd-0","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/p#section-l1-403c56b2-1"},"name":"Second","headline":"Second","position":2,"hasPart":{"@list":[{"@id":"https://x.org/d/p#block-paragraph-de05bb34"},{"@id":"https://x.org/d/p#block-image-811c9dc5"},{"@id":"https://x.org/d/p#block-rating-d7309ddc"}]}},{"@id":"https://x.org/d/p#block-paragraph-de05bb34","@type":"WebPageElement","text":"loose text"},{"@id":"https://x.org/d/p#block-image-811c9dc5","@type":"ImageObject","contentUrl":"https://x.org/j.png"},{"@id":"https://x.org/d/p#block-rating-d7309ddc","@type":"AggregateRating","ratingValue":4.0,"bestRating":5,"description":"call 555-123-4567, 4/5"},{"@id":"https://x.org/d/p#section-l2-1230b6de-1","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/p#section-l1-403c56b2-1"},"name":"Third","headline":"Third","position":2,"hasPart":{"@list":[]}},{"@id":"https://x.org/d/p#person-184707aa","@type":"Person","name":"Ann Lee"}]}""",
    "marked": """<!-- QUILL:author:406b0dac -->
by Ann Lee
<!-- /QUILL:author:406b0dac -->

## in

![x](i.png)

[go](/l)

> q \\*r\\*

```py
x = 1
y
```

1. a
2. [b](https://x.org/u)

<!-- QUILL:pricing:e55a9ce6 -->
| h | k |
| --- | --- |
| 1|2 | $5 |
<!-- /QUILL:pricing:e55a9ce6 -->

loose text

![](/j.png)

<!-- QUILL:rating:8edb5c0f -->
call 555-123-4567, 4/5
<!-- /QUILL:rating:8edb5c0f -->
""",
}
