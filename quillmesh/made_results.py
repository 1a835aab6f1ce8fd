"""What reads of made_pages' product page give, by format, as templates of the row's values."""

#: the metadata record
RECORD = r"""{"url":"https://x.org/d/@K#f","finalUrl":"https://x.org/d/@K#f","status":200,"contentType":"text/html; charset=utf-8","title":"@N @K","description":"Item @K","author":"Ann Lee","publishedTime":"2024-05-06","lang":"en","canonical":"https://x.org/c/@K","image":"https://x.org/i/@K.png","favicon":"https://x.org/t.png","sitemap":"https://x.org/sitemap.xml","robots":"https://x.org/robots.txt","frameworks":["Hugo","Tailwind CSS"],"og":{"title":" @N @K ","image":"/j/@K.png"},"twitter":{"card":"p@S"},"jsonld":[{"@type":"Organization","@id":"#o","name":"Makers"},{"@context":"x","@graph":[{"@type":"schema:Product","@id":"#p@K","name":"@N","author":{"name":"Ann Lee"}}]}]}"""
#: sections and blocks with their labels
CONTENT = r"""[{"heading":null,"level":0,"content":[{"type":"paragraph","text":"by Ann Lee","id":"i@K","class":"c d","classification":"author","confidence":0.9}],"children":[]},{"heading":"@N _@K_","level":1,"content":[{"type":"group","tagName":"div","children":[{"type":"group","tagName":"section","children":[{"type":"heading","level":2,"text":"in @K","classification":"heading","confidence":1.0},{"type":"image","src":"@K.png","alt":"x","classification":"image","confidence":1.0}]},{"type":"link","text":"go","href":"/l/@K","classification":"link","confidence":0.9}]},{"type":"blockquote","text":"q \\*@K\\*","classification":"paragraph","confidence":0.5},{"type":"code","language":"py","code":"x = @K\ny","class":"language-py","classification":"code","confidence":1.0},{"type":"list","ordered":true,"items":[{"text":"a @K"},{"text":"b","href":"https://x.org/u/@K"}],"classification":"list","confidence":0.8},{"type":"table","headers":["h","k"],"rows":[["1|@K","$@S"]],"classification":"pricing","confidence":0.7}],"children":[{"heading":"Second","level":2,"content":[{"type":"paragraph","text":"loose @N","classification":"product","confidence":0.95},{"type":"image","src":"/j@K.png","alt":""},{"type":"paragraph","text":"call 555-123-4567, 4/5","classification":"rating","confidence":0.75}],"children":[]},{"heading":"Third @K","level":2,"content":[],"children":[]}]}]"""
MARKDOWN = r"""---
url: https://x.org/d/@K#f
finalUrl: https://x.org/d/@K#f
status: 200
contentType: text/html; charset=utf-8
title: @N @K
description: Item @K
author: Ann Lee
publishedTime: '2024-05-06'
lang: en
canonical: https://x.org/c/@K
image: https://x.org/i/@K.png
favicon: https://x.org/t.png
sitemap: https://x.org/sitemap.xml
robots: https://x.org/robots.txt
frameworks:
- Hugo
- Tailwind CSS
og:
  title: ' @N @K '
  image: /j/@K.png
twitter:
  card: p@S
jsonld:
- '@type': Organization
  '@id': '#o'
  name: Makers
- '@context': x
  '@graph':
  - '@type': schema:Product
    '@id': '#p@K'
    name: @N
    author:
      name: Ann Lee
---

by Ann Lee

# @N _@K_

## in @K

![x](https://x.org/d/@K.png)

[go](https://x.org/l/@K)

> q \*@K\*

```
x = @K
y
```

1.  a @K
2.  [b](https://x.org/u/@K)

| h | k |
| --- | --- |
| 1\|@K | $@S |

## Second

loose @N![](https://x.org/j@K.png)

call 555-123-4567, 4/5

## Third @K
"""
#: @1 is the hash of MARKED_HASHED
MARKED = r"""<!-- QUILL:author:406b0dac -->
by Ann Lee
<!-- /QUILL:author:406b0dac -->

## in @K

![x](@K.png)

[go](/l/@K)

> q \*@K\*

```py
x = @K
y
```

1. a @K
2. [b](https://x.org/u/@K)

<!-- QUILL:pricing:@1 -->
| h | k |
| --- | --- |
| 1|@K | $@S |
<!-- /QUILL:pricing:@1 -->

loose @N

![](/j@K.png)

<!-- QUILL:rating:8edb5c0f -->
call 555-123-4567, 4/5
<!-- /QUILL:rating:8edb5c0f -->
"""
MARKED_HASHED = ("pricing:h k 1|@K $@S",)
TEXT = r"""by Ann Lee@N @Kin @Kgoq *@K*x = @K
ya @Kbhk1|@K$@SSecondloose @Ncall 555-123-4567, 4/5Third @K"""
TOON = r"""metadata:
  url: "https://x.org/d/@K#f"
  finalUrl: "https://x.org/d/@K#f"
  status: 200
  contentType: text/html; charset=utf-8
  title: @N @K
  description: Item @K
  author: Ann Lee
  publishedTime: 2024-05-06
  lang: en
  canonical: "https://x.org/c/@K"
  image: "https://x.org/i/@K.png"
  favicon: "https://x.org/t.png"
  sitemap: "https://x.org/sitemap.xml"
  robots: "https://x.org/robots.txt"
  frameworks[2]: Hugo,Tailwind CSS
  og:
    title: " @N @K "
    image: /j/@K.png
  twitter:
    card: p@S
  jsonld[2]:
    - "@type": Organization
      "@id": #o
      name: Makers
    - "@context": x
      "@graph"[1]:
        - "@type": "schema:Product"
          "@id": #p@K
          name: @N
          author:
            name: Ann Lee
content[2]:
  - heading: null
    level: 0
    content[1]{type,text,id,class,classification,confidence}:
      paragraph,by Ann Lee,i@K,c d,author,0.9
    children[0]:
  - heading: @N _@K_
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
                text: in @K
                classification: heading
                confidence: 1
              - type: image
                src: @K.png
                alt: x
                classification: image
                confidence: 1
          - type: link
            text: go
            href: /l/@K
            classification: link
            confidence: 0.9
      - type: blockquote
        text: "q \\*@K\\*"
        classification: paragraph
        confidence: 0.5
      - type: code
        language: py
        code: "x = @K\ny"
        class: language-py
        classification: code
        confidence: 1
      - type: list
        ordered: true
        items[2]:
          - text: a @K
          - text: b
            href: "https://x.org/u/@K"
        classification: list
        confidence: 0.8
      - type: table
        headers[2]: h,k
        rows[1]:
          - [2]: 1|@K,$@S
        classification: pricing
        confidence: 0.7
    children[2]:
      - heading: Second
        level: 2
        content[3]:
          - type: paragraph
            text: loose @N
            classification: product
            confidence: 0.95
          - type: image
            src: /j@K.png
            alt: ""
          - type: paragraph
            text: "call 555-123-4567, 4/5"
            classification: rating
            confidence: 0.75
        children[0]:
      - heading: Third @K
        level: 2
        content[0]:
        children[0]:"""
#: the graph; @1 to @7 are hashes of HASHED
GRAPH = r"""{"@context":["https://schema.org",{"wd":"http://www.wikidata.org/entity/","wdt":"http://www.wikidata.org/prop/direct/","rdfs":"http://www.w3.org/2000/01/rdf-schema#","skos":"http://www.w3.org/2004/02/skos/core#"}],"@graph":[{"@id":"https://x.org/d/@K#webpage","@type":"WebPage","url":"https://x.org/d/@K#f","name":"@N @K","description":"Item @K","inLanguage":"en","datePublished":"2024-05-06","image":"https://x.org/i/@K.png","isBasedOn":"https://x.org/c/@K","author":{"@id":"https://x.org/d/@K#person-184707aa"},"mainEntity":{"@id":"#o"},"hasPart":{"@list":[{"@id":"https://x.org/d/@K#section-l0-preamble-0"},{"@id":"https://x.org/d/@K#section-l1-@1-1"}]}},{"@id":"https://x.org/d/@K#section-l0-preamble-0","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/@K#webpage"},"hasPart":{"@list":[{"@id":"https://x.org/d/@K#block-author-39b70ec5"}]}},{"@id":"https://x.org/d/@K#block-author-39b70ec5","@type":"Person","name":"by Ann Lee"},{"@id":"https://x.org/d/@K#section-l1-@1-1","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/@K#webpage"},"name":"@N _@K_","headline":"@N _@K_","position":1,"hasPart":{"@list":[{"@id":"https://x.org/d/@K#block-group-811c9dc5"},{"@id":"https://x.org/d/@K#block-paragraph-@2"},{"@id":"https://x.org/d/@K#block-code-@3"},{"@id":"https://x.org/d/@K#block-list-@4"},{"@id":"https://x.org/d/@K#block-pricing-@5"},{"@id":"https://x.org/d/@K#section-l2-f486b7fd-0"},{"@id":"https://x.org/d/@K#section-l2-@7-1"}]}},{"@id":"https://x.org/d/@K#block-group-811c9dc5","@type":"WebPageElement"},{"@id":"https://x.org/d/@K#block-paragraph-@2","@type":"Quotation","text":"q \\*@K\\*"},{"@id":"https://x.org/d/@K#block-code-@3","@type":"SoftwareSourceCode","text":"x = @K\ny","programmingLanguage":"py"},{"@id":"https://x.org/d/@K#block-list-@4","@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"name":"a @K"},{"@type":"ListItem","position":2,"name":"b","item":"https://x.org/u/@K"}]},{"@id":"https://x.org/d/@K#block-pricing-@5","@type":"Table","description":"h k 1|@K $@S"},{"@id":"https://x.org/d/@K#section-l2-f486b7fd-0","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/@K#section-l1-@1-1"},"name":"Second","headline":"Second","position":2,"hasPart":{"@list":[{"@id":"https://x.org/d/@K#block-product-@6"},{"@id":"https://x.org/d/@K#block-image-811c9dc5"},{"@id":"https://x.org/d/@K#block-rating-d7309ddc"}]}},{"@id":"https://x.org/d/@K#block-product-@6","@type":"Product","name":"loose @N","description":"loose @N"},{"@id":"https://x.org/d/@K#block-image-811c9dc5","@type":"ImageObject","contentUrl":"https://x.org/j@K.png"},{"@id":"https://x.org/d/@K#block-rating-d7309ddc","@type":"AggregateRating","ratingValue":4.0,"bestRating":5,"description":"call 555-123-4567, 4/5"},{"@id":"https://x.org/d/@K#section-l2-@7-1","@type":"WebPageElement","isPartOf":{"@id":"https://x.org/d/@K#section-l1-@1-1"},"name":"Third @K","headline":"Third @K","position":2,"hasPart":{"@list":[]}},{"@id":"#o","@type":"Organization","name":"Makers"},{"@id":"#p@K","@type":"schema:Product","name":"@N","author":{"name":"Ann Lee"}},{"@id":"https://x.org/d/@K#person-184707aa","@type":"Person","name":"Ann Lee"}]}"""
HASHED = ("@N _@K_", r"q \*@K\*", "x = @K\ny", "a @K b", "h k 1|@K $@S", "loose @N", "Third @K")
