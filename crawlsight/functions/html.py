"""One pass over a page's HTML that yields all that the crawl table and the checks need.

The parser keeps a stack of open elements; a closing tag pops to its nearest opening
one, void elements never open. Text is taken outside script, style and template
elements. A page is parsed once, and checks look at the whole of it. Where they are asked to
look at an excerpt, a longer page is parsed a second time in its excerpt; its elements are
counted in the whole page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import EXCERPT_CHARS, MARKUP, PAGE, TRUNCATED

#: Fixed values of HTML: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not page text.
SILENT = frozenset(("script", "style", "template"))
#: Input types that need no label.
UNLABELLED_TYPES = frozenset(("hidden", "submit", "button", "image", "reset"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLANKS = re.compile(r"\s+")
#: A character reference that no semicolon ends, outside of scripts and styles, whose text is taken as it stands.
_BARE = re.compile(r"(<(script|style)\b.*?</\2\s*>)|&(?=#?[a-zA-Z0-9]+(?![a-zA-Z0-9;]))", re.DOTALL | re.IGNORECASE)
#: Pages, and characters of their HTML, whose parse a task holds at once.
LOT_PAGES, LOT_CHARS = 128, 2_000_000


def normalise_url(url: str) -> str:
    """Without fragment and outer blanks."""
    return url.split("#", 1)[0].strip()


def resolve(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def netloc(url: str) -> str:
    try:
        return urlparse(url).netloc
    except ValueError:
        return ""


class _Capture:
    """The text under one element."""

    __slots__ = ("pieces",)

    def __init__(self):
        self.pieces: list[str] = []

    def joined(self, by: str) -> str:
        return by.join(s for p in self.pieces if (s := p.strip()))


class PageParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: list[tuple[str, _Capture]] = []
        self.tags = 0
        self.requests = 0
        self.pieces: list[str] = []
        self.bare: list[str] = []
        self.titles: list[_Capture] = []
        self.headings: list[tuple[str, _Capture]] = []
        self.anchors: list[tuple[dict, _Capture]] = []
        self.images: list[dict] = []
        self.scripts: list[tuple[dict, bool]] = []
        self.jsonld: list[_Capture] = []
        self.links: list[dict] = []
        self.metas: list[dict] = []
        self.forms: list[dict] = []
        self.fields: list[tuple[str, dict, bool]] = []
        self.label_for: set[str] = set()
        self.html: dict | None = None
        self.breadcrumb = self.article = self.font_size = False
        self.data: list[str] = []

    def handle_starttag(self, tag: str, attributes: list) -> None:
        self.end_data()
        given = {}
        for name, value in attributes:
            given.setdefault(name, value or "")
        self.tags += 1
        if "breadcrumb" in given.get("aria-label", "").lower() or "breadcrumb" in given.get("class", "").lower():
            self.breadcrumb = True
        if "font-size" in given.get("style", "").lower():
            self.font_size = True
        if tag in ("script", "link", "img"):
            self.requests += 1
        capture = None
        if tag == "title":
            self.titles.append(capture := _Capture())
        elif tag in HEADINGS:
            self.headings.append((tag, capture := _Capture()))
        elif tag == "a":
            self.anchors.append((given, capture := _Capture()))
        elif tag == "script":
            self.scripts.append((given, "head" in self.stack))
            if given.get("type") == "application/ld+json":
                self.jsonld.append(capture := _Capture())
        elif tag == "img":
            self.images.append(given)
        elif tag == "link":
            self.links.append(given)
        elif tag == "meta":
            self.metas.append(given)
        elif tag == "form":
            self.forms.append(given)
        elif tag in ("input", "select", "textarea"):
            self.fields.append((tag, given, "label" in self.stack))
        elif tag == "label" and given.get("for"):
            self.label_for.add(given["for"])
        elif tag == "html" and self.html is None:
            self.html = given
        elif tag == "article":
            self.article = True
        if tag not in VOID:
            self.stack.append(tag)
            if capture is not None:
                self.open.append((tag, capture))

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.end_data()
        if tag not in self.stack:
            return
        while self.stack:
            last = self.stack.pop()
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == last:
                    if self.stack.count(last) < sum(name == last for name, _ in self.open):
                        del self.open[at]
                    break
            if last == tag:
                return

    def handle_comment(self, data: str) -> None:
        self.end_data()

    def handle_decl(self, decl: str) -> None:
        self.end_data()

    def unknown_decl(self, data: str) -> None:
        self.end_data()

    def handle_pi(self, data: str) -> None:
        self.end_data()

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def end_data(self) -> None:
        """Data without a tag or comment between is one text, also a tag that is cut off."""
        if not self.data:
            return
        data = "".join(self.data)
        self.data.clear()
        inside = self.stack[-1] if self.stack else ""
        if inside in SILENT:
            if "font-size" in data.lower():
                self.font_size = True
            for name, capture in self.open:
                if name == "script":
                    capture.pieces.append(data)
            return
        for name, capture in self.open:
            if name != "script":
                capture.pieces.append(data)
        if piece := data.strip():
            self.pieces.append(piece)
            if "noscript" not in self.stack:
                self.bare.append(piece)


def parsed(html: str, bare_references: bool = True) -> PageParser:
    """``bare_references`` reads ``&amp`` like ``&amp;``, as browsers do; without it only a semicolon ends a reference."""
    if not bare_references and "&" in html:
        html = _BARE.sub(lambda m: m[1] or "&amp;", html)
    parser = PageParser()
    parser.feed(html)
    parser.close()
    parser.end_data()
    return parser


def _types(node: dict) -> list[str]:
    kind = node.get("@type")
    return [str(k) for k in (kind if isinstance(kind, list) else [kind])]


def _jsonld(page: PageParser) -> tuple[bool, list[dict], list[str]]:
    """(some block is malformed, its nodes with @graph descended, the types that the crawl table lists)."""
    invalid, nodes, listed = False, [], []
    for block in page.jsonld:
        raw = "".join(block.pieces)
        if not raw.strip():
            continue
        try:
            data = json.loads(raw)
        except ValueError:
            invalid = True
            continue
        for top in data if isinstance(data, list) else [data]:
            if not isinstance(top, dict):
                continue
            kind = top.get("@type") or top.get("type")
            listed += [str(k) for k in (kind if isinstance(kind, list) else [kind] if kind else [])]
            graph = top.get("@graph")
            inner = [n for n in graph if isinstance(n, dict)] if isinstance(graph, list) else [top]
            nodes += [{"types": _types(n), "keys": [str(k) for k in n]} for n in inner]
    return invalid, nodes, listed


def _meta(page: PageParser, key: str, value: str) -> str:
    """Trimmed content of the first meta tag whose attribute has this value."""
    first = next((m for m in page.metas if m.get(key) == value), {})
    return first.get("content", "").strip()


def _rel(link: dict) -> str:
    return " ".join(link.get("rel", "").split())


def page_columns(url: str, page: PageParser) -> dict:
    """The crawl table's columns of a whole page."""
    own = netloc(url)
    headings: dict[str, list[str]] = {f"h{i}": [] for i in range(1, 7)}
    for tag, capture in page.headings:
        headings[tag].append(capture.joined(" "))
    targets = [normalise_url(resolve(url, a["href"])) for a, _ in page.anchors if "href" in a]
    targets = [t for t in targets if t]
    inner = [t for t in targets if netloc(t) == own]
    outer = [t for t in targets if netloc(t) != own]
    text = " ".join(page.pieces)
    words = len(text.split())
    canonical = next((k for k in page.links if "canonical" in k.get("rel", "").split()), {}).get("href", "")
    low = url.lower()
    if re.search(r"/blog/|/news/|/posts/|/articles/", low) or page.article:
        content_type = "Blog / Article"
    elif re.search(r"/product/|/shop/|/item/|/store/|/collections/", low):
        content_type = "Product"
    elif re.search(r"/about|/contact|/service|/services|/pricing|/features", low):
        content_type = "Landing Page"
    else:
        content_type = "Product" if _meta(page, "property", "og:type") == "product" else "Other"
    return {
        "title": "".join(page.titles[0].pieces).strip() if page.titles else "",
        "description": _meta(page, "name", "description"),
        "h1": headings["h1"][0] if headings["h1"] else "",
        "h_tags": headings,
        "word_count": words,
        "heading_count": len(page.headings),
        "image_count": len(page.images),
        "internal_links": len(set(inner)),
        "external_links": len(set(outer)),
        "link_to_word_ratio": round(len(targets) / words, 3) if words else 0.0,
        "schema": ", ".join(_jsonld(page)[2]),
        "content_type": content_type,
        "canonical_url": normalise_url(resolve(url, canonical)) if canonical else "",
        "og_title": _meta(page, "property", "og:title"),
        "og_description": _meta(page, "property", "og:description"),
        "content_text": text,
        "links": targets,
        "image_urls": [normalise_url(resolve(url, i["src"])) for i in page.images if i.get("src")],
        "icon_urls": [normalise_url(resolve(url, k["href"])) for k in page.links if "icon" in _rel(k).lower() and k.get("href")],
        "has_amphtml": any("amphtml" in _rel(k).lower().split() for k in page.links),
        "is_amp": page.html is not None and ("amp" in page.html or "⚡" in page.html),
        "has_font_size": page.font_size,
    }


def markup_columns(url: str, page: PageParser) -> dict:
    """What the checks look at."""
    invalid, nodes, _ = _jsonld(page)
    anchors = []
    for given, capture in page.anchors:
        if "href" not in given:
            anchors.append({"href": None, "absolute": None, "netloc": None, "text": capture.joined(""), "rel": _rel(given)})
            continue
        absolute = resolve(url, given["href"].strip())
        anchors.append(
            {
                "href": given["href"],
                "absolute": absolute,
                "netloc": netloc(absolute).lower(),
                "text": capture.joined(""),
                "rel": _rel(given).lower(),
            }
        )
    images = [
        {
            "src": i.get("src"),
            "absolute": resolve(url, i["src"].strip()) if i.get("src", "").strip() else None,
            "netloc": netloc(i.get("src", "")).lower(),
            "alt": i.get("alt"),
            "sized": bool(i.get("width")) and bool(i.get("height")),
            "loading": i.get("loading", ""),
        }
        for i in page.images
    ]
    unlabelled = any(
        not (tag == "input" and given.get("type", "text").lower() in UNLABELLED_TYPES)
        and not (given.get("id") and given["id"] in page.label_for)
        and not labelled
        and not given.get("aria-label")
        and not given.get("aria-labelledby")
        for tag, given, labelled in page.fields
    )
    return {
        "anchors": anchors,
        "images": images,
        "scripts": [
            {"src": g.get("src"), "in_head": inside, "deferred": "async" in g or "defer" in g} for g, inside in page.scripts
        ],
        "rels": [{"rel": _rel(k), "href": k.get("href", ""), "hreflang": k.get("hreflang")} for k in page.links],
        "metas": [
            {
                "name": m.get("name"),
                "property": m.get("property"),
                "http_equiv": m.get("http-equiv"),
                "content": m.get("content", ""),
            }
            for m in page.metas
        ],
        "levels": [int(tag[1]) for tag, _ in page.headings],
        "actions": [f.get("action", "") for f in page.forms],
        "unlabelled": unlabelled,
        "n_tags": page.tags,
        "n_requests": page.requests,
        "lang": (page.html or {}).get("lang", "").strip().lower(),
        "has_breadcrumb": page.breadcrumb or any("BreadcrumbList" in "".join(b.pieces) for b in page.jsonld),
        "jsonld_invalid": invalid,
        "nodes": nodes,
        "text": " ".join(page.pieces),
        "body_text": _BLANKS.sub(" ", " ".join(page.bare)).strip(),
    }


def excerpt(html: str, chars: int = EXCERPT_CHARS) -> str:
    return html if len(html) <= chars else html[:chars] + TRUNCATED


def parse_page(url: str, html: str, bare_references: bool = True, markup: bool = True, excerpt_chars: int | None = EXCERPT_CHARS) -> tuple[dict, dict]:
    """(columns of the crawl table, what the checks look at; empty without ``markup``).

    ``excerpt_chars`` None lets the checks look at the whole page.
    """
    page = parsed(html, bare_references)
    if not markup:
        return page_columns(url, page), {}
    whole = excerpt_chars is None or len(html) <= excerpt_chars
    short = page if whole else parsed(excerpt(html, excerpt_chars), bare_references)
    return page_columns(url, page), markup_columns(url, short) | {"n_tags": page.tags}


def page_lots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in lots of bounded pages and characters (of one page at least)."""
    begin = held = 0
    for at, size in enumerate(pc.utf8_length(batch.column("html")).to_pylist()):
        if at > begin and (at - begin == LOT_PAGES or held + (size or 0) > LOT_CHARS):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def parse_pages(pages: DataFrame, bare_references: bool = True, only: list[str] | None = None, excerpt_chars: int | None = None) -> DataFrame:
    """``pages`` (with url and html) plus the columns of PAGE and a struct ``h`` of MARKUP.

    One Arrow pass; rows without HTML get empty values. A narrow step: it moves no row. A
    task holds the parse of one lot, whatever the size of the batches that it gets. ``only``
    names the columns that are wanted, because Spark can't tell the pass what it needn't make:
    other columns are not handed on, and without ``h`` no page is looked at for its markup.
    ``h`` is of the whole page unless ``excerpt_chars`` bounds it.
    """
    page_fields = StructType.fromDDL(PAGE).fields
    kept = [f for f in pages.schema.fields if f.name not in {p.name for p in page_fields} | {"h"}]
    markup = only is None or "h" in only
    if only is not None:
        if unknown := set(only) - {f.name for f in [*kept, *page_fields]} - {"h"}:
            raise ValueError(f"no columns {sorted(unknown)}")
        kept, page_fields = ([f for f in fields if f.name in only] for fields in (kept, page_fields))
    schema = StructType([*kept, *page_fields])
    if markup:
        schema.add("h", StructType.fromDDL(MARKUP))
    names = [f.name for f in kept]
    arrow = pages.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in page_lots(batch):
                texts = zip(lot.column("url").to_pylist(), lot.column("html").to_pylist())
                both = [parse_page(u or "", h or "", bare_references, markup, excerpt_chars) for u, h in texts]
                arrays = [lot.column(n) for n in names]
                for f in page_fields:
                    values = [a[f.name] for a, _ in both]
                    is_map = f.dataType.typeName() == "map"
                    arrays.append(pa.array([list(v.items()) for v in values] if is_map else values, arrow.field(f.name).type))
                if markup:
                    arrays.append(pa.array([b for _, b in both], arrow.field("h").type))
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return pages.select(*dict.fromkeys([*names, "url", "html"])).mapInArrow(run, schema)
