"""HTML to one nested column.

Trees need imperative code, so this is the engine's only hop to Python: one Arrow batch in, one struct column out, and
each page is parsed once.  What needs no tree is left to Column expressions.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed

_IMAGE = "array<struct<src: string, alt: string, kind: string, rel: string, class_name: string, id: string>>"
_ZONES = ("heading_text", "button_text", "link_text", "label_text", "placeholder_text", "paragraph_text", "footer_text", "image_alt_text", "form_nearby_text", "iframe_text")
DOC = f"""
meta: struct<title: string, title_source: string, description: string, og_title: string, og_site_name: string, og_description: string, icon: string, canonical: string>,
rendered_text: string, body_text: string, analysis_text: string, visible_text: array<string>,
text_extras: struct<image_alts: array<string>, placeholders: array<string>, aria_labels: array<string>, jsonld_text: array<string>, submit_values: array<string>>,
images: {_IMAGE},
forms: array<struct<action: string, method: string, hidden_fields: array<struct<name: string, value: string>>, inputs: array<struct<type: string, name: string, id: string, autocomplete: string>>, input_count: int>>,
links: array<struct<text: string, href: string, rel: string>>,
text_zones: struct<title_text: string, {", ".join(f"{z}: array<string>" for z in _ZONES)}>,
structured_data: array<string>,
iframes: array<struct<src: string, title: string>>,
trust_items: array<struct<text: string, href: string, href_attr: string, source: string>>,
anchor_targets: array<string>,
price_pairs: array<struct<original: string, sale: string>>,
footer_text: string, page_text: string,
brand_attributes: array<string>
"""

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open element of the values ends where an element of the key begins.
CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
CLOSES |= {t: {t} for t in ("a", "button")}
CLOSES |= {t: {"p"} for t in "p div ul ol table section article header footer nav form h1 h2 h3 h4 h5 h6 main aside blockquote pre".split()}
#: An open paragraph ends at such an element wherever it is open, unless one of these is open inside it.
KEEPS_P = frozenset("button table td th caption template object".split())
SILENT = frozenset(("script", "style", "noscript"))


class Node:
    __slots__ = ("at", "attrs", "hidden", "kids", "last", "parent", "silent", "tag", "whole")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        # what is inherited is settled here, once
        self.hidden = (parent is not None and parent.hidden) or self.get("aria-hidden").lower() == "true"
        self.silent = (parent is not None and parent.silent) or tag in SILENT
        self.at, self.last, self.whole = -1, -1, None

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node is not self:
                yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def text(self, without: frozenset[str] = SILENT) -> str:
        if without is SILENT and self.whole and not self.silent:
            text, low, high = self.whole
            return text[0][low:high]
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append("\n")
            elif node.tag not in without:
                stack.extend(reversed(node.kids))
        return "".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.open: Counter[str] = Counter()
        self.title: list = []  # place and text of the first title's tag, and the place of its end tag

    def leave(self) -> None:
        if self.at.parent is not None:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "form" and self.open["form"]:
            return  # forms don't nest
        ends = CLOSES.get(tag, ())
        if self.at.tag in ends:
            self.leave()
        elif "p" in ends and self.open["p"] and not any(self.open[t] for t in KEEPS_P):
            while self.open["p"]:
                self.leave()
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Node(tag, own, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1
        if tag == "title" and not self.title:
            self.title += [self.getpos(), self.get_starttag_text()]

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.leave()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and len(self.title) == 2:
            self.title.append(self.getpos())
        if self.open[tag]:
            while self.at.tag != tag:
                self.leave()
            self.leave()

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str | None) -> tuple[Node, str]:
    """The tree, and the first title as the page's source has it, character references unread; empty if it isn't closed."""
    html = html or ""
    b = _Builder()
    b.feed(html)
    b.close()
    _lay_out(b.root)
    if len(b.title) < 3:
        return b.root, ""
    begin, tag, end = b.title
    place = lambda line, column: sum(len(x) + 1 for x in html.split("\n", line - 1)[: line - 1]) + column
    return b.root, html[place(*begin) + len(tag) : place(*end)]


def _lay_out(root: Node) -> None:
    """Numbers all nodes in order, with the last one inside each, and lays their text end to end, so that a node's is a
    slice of it: however deep the nesting, each node is looked at once."""
    parts: list[str] = []
    whole: list[str] = []
    n = size = 0
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            parts.append(node)
            size += len(node)
        elif done:
            node.last = n - 1
            node.whole = (whole, node.whole, size)
        else:
            node.at, n, node.whole = n, n + 1, size
            if node.tag == "br":
                parts.append("\n")
                size += 1
            stack.append((node, True))
            stack.extend((k, False) for k in reversed(node.kids) if isinstance(k, Node) or not node.silent)
    whole.append("".join(parts))


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def _distinct(texts: Iterator[str] | list[str], seen: set[str] | None = None, lower: bool = False) -> list[str]:
    seen, out = set() if seen is None else seen, []
    for t in map(squeeze, texts):
        key = t.lower() if lower else t
        if t and key not in seen:
            seen.add(key)
            out.append(t)
    return out


def dom_hidden(node: Node) -> bool:
    return "hidden" in node.attrs or node.get("aria-hidden").lower() == "true"


BODY = frozenset("main article nav header footer h1 h2 h3 h4 h5 h6 p li a button label td th figcaption".split())


def body_segments(nodes: list[Node]) -> list[str]:
    """Text of body elements in order; none inside another that counts, none twice but for case."""
    done = -1  # the last node inside of one that counts
    seen: set[str] = set()
    out = []
    for n in nodes:
        if n.at <= done or not (n.tag in BODY or n.get("role") == "main") or n.hidden or dom_hidden(n):
            continue
        text = squeeze(n.text())
        if text and text.lower() not in seen:
            seen.add(text.lower())
            done = n.last
            out.append(text)
    return out


JSON_LD = re.compile(r"<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.I | re.S)
JSON_TEXT = ("name", "description", "headline", "alternateName", "caption")


def structured_data(html: str) -> list:
    out: list = []
    for block in JSON_LD.findall(html):
        try:
            data = json.loads(block.strip())
        except ValueError:
            continue
        if isinstance(data, list):
            out += data
        elif isinstance(data, dict):
            out.append(data)
    return out


def json_texts(data) -> list[str]:
    out: list[str] = []
    stack = [data]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            out += [node[k] for k in JSON_TEXT if isinstance(node.get(k), str)]
            stack.extend(v for v in reversed(list(node.values())) if isinstance(v, (dict, list)))
    return out


def text_extras(nodes: list[Node], data: list) -> dict[str, list[str]]:
    """Alternative texts and the like; one text counts once over all kinds."""
    seen: set[str] = set()
    shown = [n for n in nodes if not n.hidden]
    open_ = [n for n in shown if not dom_hidden(n)]
    push = lambda texts: _distinct(list(texts), seen, lower=True)
    return {
        "image_alts": push(n.get("alt") for n in shown if n.tag == "img"),
        "placeholders": push(n.get("placeholder") for n in open_ if n.tag in ("input", "textarea")),
        "aria_labels": push(n.get("aria-label") for n in open_ if "aria-label" in n.attrs),
        "submit_values": push(n.get("value") for n in open_ if is_button(n)),
        "jsonld_text": push(json_texts(data)),
    }


def is_button(n: Node) -> bool:
    return n.tag == "button" or (n.tag == "input" and n.get("type").lower() in ("submit", "button"))


def analysis_text(meta: dict[str, str], body: str, extras: dict[str, list[str]]) -> str:
    seen: set[str] = set()
    head = _distinct([meta[k] for k in ("title", "description", "og_title", "og_site_name", "og_description")], seen, lower=True)
    body = squeeze(body)
    low = body.lower()
    seen.add(low)
    rest = [t for k in ("image_alts", "placeholders", "submit_values", "aria_labels", "jsonld_text") for t in extras[k]]
    rest = [t for t in rest if not (low and t.lower() in low)]
    return " ".join([*head, *([body] if body else []), *_distinct(rest, seen, lower=True)])


def first_of_srcset(value: str) -> str:
    parts = value.split(",")[0].split()
    return parts[0] if parts else ""


CSS_URL = re.compile(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", re.I)
IMAGE_SRC = re.compile(r"^data:image/|\.(?:png|jpe?g|gif|webp|svg|ico|bmp|avif)(?:[?#]|$)", re.I)


def images(nodes: list[Node]) -> list[dict]:
    """Images of all kinds; the first of equal sources counts."""
    found: dict[str, dict] = {}

    def push(src: str, kind: str, n: Node | None = None, alt: str = "", rel: str | None = None) -> None:
        src = src.strip()
        if src:
            found.setdefault(src, {"src": src, "alt": alt.strip(), "kind": kind, "rel": rel, "class_name": (n and n.get("class")) or None, "id": (n and n.get("id")) or None})

    of = lambda *tags: (n for n in nodes if n.tag in tags)
    for n in of("link"):
        rel = n.get("rel").lower()
        if re.search(r"\bicon\b", rel) or "apple-touch-icon" in rel or "mask-icon" in rel:
            push(n.get("href"), "icon", n, rel=rel)
    for key, value in (("property", "og:image"), ("name", "og:image"), ("name", "twitter:image"), ("property", "twitter:image"), ("name", "msapplication-TileImage")):
        for n in of("meta"):
            if n.attrs.get(key) == value:
                push(n.get("content"), "og")
    for n in of("img"):
        alt = n.get("alt")
        push(n.get("src"), "img", n, alt)
        for k in ("data-src", "data-lazy-src", "data-original", "loading-src"):
            push(n.get(k), "lazy", n, alt)
        for k in ("srcset", "data-srcset"):
            push(first_of_srcset(n.get(k)), "srcset", n, alt)
    for n in of("source"):
        push(n.get("src"), "srcset", n)
        push(first_of_srcset(n.get("srcset")), "srcset", n)
        push(n.get("data-src"), "lazy", n)
    for n in nodes:
        for u in CSS_URL.findall(n.attrs.get("style") or ""):
            push(u, "css_bg", n, n.get("aria-label") or n.get("title"))
    for n in of("video"):
        push(n.get("poster"), "poster", n)
    for n in of("image"):
        push(n.get("href") or n.get("xlink:href"), "svg_image", n)
    for n in of("object", "embed"):
        src = n.get("data") if n.tag == "object" else n.get("src")
        if IMAGE_SRC.search(src):
            push(src, "object", n)
    return list(found.values())


def zones(nodes: list[Node]) -> dict:
    text = lambda test: _distinct(n.text() for n in nodes if test(n))
    tag = lambda *tags: lambda n: n.tag in tags
    title = next((squeeze(n.text()) for n in nodes if n.tag == "title"), "")
    title = title or next((n.get("content") for n in nodes if n.tag == "meta" and n.attrs.get("property") == "og:title"), "")
    return {
        "title_text": title or None,
        "heading_text": text(tag("h1", "h2", "h3")),
        "button_text": _distinct(n.text() or n.get("value") for n in nodes if is_button(n)),
        "link_text": text(tag("a")),
        "label_text": text(tag("label")),
        "placeholder_text": _distinct(n.get("placeholder") for n in nodes if n.tag in ("input", "textarea")),
        "paragraph_text": text(tag("p")),
        "footer_text": text(lambda n: n.tag == "footer" or n.get("role") == "contentinfo"),
        "image_alt_text": _distinct(n.get("alt") for n in nodes if n.tag == "img"),
        "form_nearby_text": text(tag("form")),
        "iframe_text": text(lambda n: "data-captured-iframe" in n.attrs),
    }


def forms(nodes: list[Node]) -> list[dict]:
    out = []
    for f in nodes:
        if f.tag != "form":
            continue
        inputs = [n for n in f.walk() if n.tag == "input"]
        own = [{"type": n.get("type").lower(), "name": n.get("name"), "id": n.get("id"), "autocomplete": n.get("autocomplete").lower()} for n in inputs]
        hidden = [{"name": n.get("name"), "value": n.get("value")} for n in inputs if n.get("type").lower() == "hidden"]
        out.append({"action": f.get("action"), "method": f.get("method").upper() or "GET", "hidden_fields": hidden, "inputs": own, "input_count": len(own)})
    return out


INERT_CLICK = re.compile(r"\s*(return\s+false\s*;?|void\s*[\s(]|javascript\s*:\s*void)", re.I)
CLICK_URL = (re.compile(r"(?:window\.)?location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]", re.I), re.compile(r"(?:window\.)?location\.(?:assign|replace)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", re.I))


def click_url(n: Node) -> str:
    handler = n.get("onclick")
    if not handler or INERT_CLICK.match(handler):
        return ""
    return next((m[1].strip() for p in CLICK_URL if (m := p.search(handler))), "")


def trust_items(nodes: list[Node]) -> list[dict]:
    """Anchors, then buttons, then elements with the role of one: what trust navigation is sought in."""
    out = [{"text": squeeze(n.text()), "href": n.get("href"), "href_attr": n.get("href"), "source": "anchor"} for n in nodes if n.tag == "a"]
    for n in nodes:
        if is_button(n):
            out.append({"text": squeeze(n.text() or n.get("value") or n.get("aria-label")), "href": n.get("href") or click_url(n), "href_attr": "", "source": "button"})
    for n in nodes:
        if n.get("role") in ("link", "button"):
            out.append({"text": squeeze(n.text() or n.get("aria-label")), "href": n.get("href") or click_url(n), "href_attr": n.get("href"), "source": "role"})
    return out


LOOKS_LIKE_PRICE = re.compile(fixed.PRICE_LOOKALIKE, re.I)


def price_pairs(nodes: list[Node]) -> list[dict]:
    """An original price with the sale price near it: up to three ancestors up, else a sibling that looks like a price."""
    out = []
    sales = [n for n in nodes if any(c in fixed.SALE_PRICE_CLASSES for c in n.classes())]
    places = [n.at for n in sales]
    priced: dict[int, list[str]] = {}  # different texts of children that look like a price, for each parent

    def inside(up: Node) -> Node | None:
        k = bisect_right(places, up.at)
        return sales[k] if k < len(sales) and places[k] <= up.last else None

    for n in nodes:
        if not (n.tag in fixed.ORIGINAL_PRICE_TAGS or any(c in fixed.ORIGINAL_PRICE_CLASSES for c in n.classes())):
            continue
        original, sale, up = n.text().strip(), "", n.parent
        if not original:
            continue
        for _ in range(3):
            if up is None or sale:
                break
            near = inside(up)
            sale, up = near.text().strip() if near else "", up.parent
        if not sale and n.parent:
            if id(n.parent) not in priced:
                kids = dict.fromkeys(k.text().strip() for k in n.parent.kids if isinstance(k, Node))
                priced[id(n.parent)] = [t for t in kids if t and LOOKS_LIKE_PRICE.search(t)]
            sale = next((t for t in priced[id(n.parent)] if t != original), "")
        if sale:
            out.append({"original": original, "sale": sale})
    return out


UNSEEN = frozenset("script style noscript iframe template svg".split())
COMMENT = re.compile(r"<!--(.*?)-->", re.S)


def brand_attributes(nodes: list[Node], html: str) -> list[str]:
    """Comments, and names and values of attributes that a brand can be claimed in."""
    out = COMMENT.findall(html)
    for n in nodes:
        for k, v in n.attrs.items():
            if k in fixed.BRAND_ATTRIBUTES or k.startswith("data-"):
                out += [v, k]
    return out


def analyze(html: str | None, rendered: str | None = None) -> dict:
    html = html or ""
    root, title_source = parse(html)
    nodes = list(root.walk())
    one = lambda test, key: next((n.get(key) for n in nodes if test(n)), "")
    of_meta = lambda key, value: one(lambda n: n.tag == "meta" and n.attrs.get(key) == value, "content")
    link = lambda rel: one(lambda n: n.tag == "link" and n.get("rel").lower() == rel, "href")
    meta = {
        "title": next((squeeze(n.text()) for n in nodes if n.tag == "title"), ""),
        "title_source": title_source,
        "description": of_meta("name", "description"),
        "og_title": of_meta("property", "og:title"),
        "og_site_name": of_meta("property", "og:site_name"),
        "og_description": of_meta("property", "og:description"),
        "icon": link("icon") or link("shortcut icon"),
        "canonical": link("canonical"),
    }
    data = structured_data(html)
    rendered = squeeze(rendered)
    segments = body_segments(nodes)
    body = rendered or " ".join(segments)
    extras = text_extras(nodes, data)
    footer = [n for n in nodes if n.tag == "footer" or n.get("role") == "contentinfo" or "footer" in n.get("class") or "footer" in n.get("id")]
    page = next((n for n in nodes if n.tag == "body"), root)
    return {
        "meta": meta,
        "rendered_text": rendered or None,
        "body_text": body,
        "analysis_text": analysis_text(meta, body, extras),
        "visible_text": ([body] if body else []) if rendered else segments,
        "text_extras": extras,
        "images": images(nodes),
        "forms": forms(nodes),
        "links": [{"text": squeeze(n.text()), "href": n.get("href"), "rel": n.get("rel")} for n in nodes if n.tag == "a"],
        "text_zones": zones(nodes),
        "structured_data": [json.dumps(x, ensure_ascii=False) for x in data],
        "iframes": [{"src": n.get("src") or n.get("data-src"), "title": n.get("title")} for n in nodes if n.tag == "iframe"],
        "trust_items": trust_items(nodes),
        "anchor_targets": [n.get(k) for tag, k in (("a", "href"), (None, "data-href"), (None, "data-url")) for n in nodes if (tag is None or n.tag == tag) and n.get(k)],
        "price_pairs": price_pairs(nodes),
        "footer_text": squeeze(" ".join(n.text(UNSEEN) for n in footer)),
        "page_text": squeeze(page.text(UNSEEN)),
        "brand_attributes": brand_attributes(nodes, html),
    }


def with_document(df: DataFrame, html: str = "html", rendered_text: str | None = None, name: str = "doc") -> DataFrame:
    """``df`` with the parsed page; null pages give an empty one."""
    kept = df.select(*[f"`{c}`" for c in df.columns if c != name])
    field = T.StructField(name, T._parse_datatype_string(DOC))
    arrow = to_arrow_type(field.dataType)
    at, more = kept.columns.index(html), kept.columns.index(rendered_text) if rendered_text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                rendered = b.column(more).to_pylist() if more is not None else [None] * b.num_rows
                docs = [analyze(h, r) for h, r in zip(b.column(at).to_pylist(), rendered, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(docs, arrow)], names=[*b.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, field]))
