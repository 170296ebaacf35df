"""Tolerant HTML parsing in Arrow batches, and extraction by CSS, XPath and regular expressions.

The standard library's tokenizer feeds an element tree; void elements, implied
ends (paragraphs, list items, table cells, options) and the border of head and
body follow the HTML standard, so pages with missing end tags come out as
browsers read them.  Differences from browsers: misnested formatting elements
are closed where their parent ends, and nothing is moved out of tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url as urls
from .text import DESC_PX, SPACE, TITLE_PX, pixels_of, simhash_of

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = set("base link meta title style script noscript template".split())
#: Start tags that end an open paragraph.
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
#: Elements that a start tag ends, up to the nearest of the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe"}
SCOPES = {"td", "th", "table", "caption", "html", "button", "template", "body"}


def clean(text: str) -> str:
    return SPACE.sub(" ", text).strip(" ")


class Builder(HTMLParser):
    """Makes an element tree html / head, body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.head, self.body = ET.SubElement(self.root, "head"), ET.SubElement(self.root, "body")
        self.open, self.in_body = [self.root, self.head], False

    def to_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open = True, [self.root, self.body]

    def close_until(self, names: set[str], borders: set[str]) -> None:
        for i in range(len(self.open) - 1, 1, -1):
            tag = self.open[i].tag
            if tag in names:
                del self.open[i:]
                return self.close_until(names, borders)
            if tag in borders:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}  # the first of repeated attributes counts
        if not re.fullmatch(r"[^\s<>&/]+", tag):
            return
        if tag in ("html", "head", "body"):
            own = {"html": self.root, "head": self.head, "body": self.body}[tag]
            own.attrib = given | own.attrib
            if tag == "body":
                self.to_body()
            return
        if not self.in_body and self.open[-1] is self.head and tag not in IN_HEAD:
            self.to_body()
        if tag in BLOCKS:
            self.close_until({"p"}, SCOPES)
        if tag in ENDS:
            self.close_until(*ENDS[tag])
        node = ET.SubElement(self.open[-1], tag, given)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self.open)
        self.handle_starttag(tag, attrs)
        # a slash ends an element in foreign content; elsewhere it means nothing
        if len(self.open) > before and any(n.tag in ("svg", "math") for n in self.open):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.to_body()
        elif tag not in ("html", "body"):
            for i in range(len(self.open) - 1, 1, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return

    def handle_data(self, data: str) -> None:
        if not self.in_body and self.open[-1] is self.head:
            if not data.strip():
                return
            self.to_body()
        node = self.open[-1]
        if len(node):
            node[-1].tail = (node[-1].tail or "") + data
        else:
            node.text = (node.text or "") + data


def tree(html: str) -> ET.Element:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


def text_of(node: ET.Element, without: set[str] = frozenset()) -> str:
    """All text inside, blocks joined without a space; iterative, so depth does not matter."""
    out, todo = [], [(node, False)]
    while todo:
        n, tail = todo.pop()
        if tail:
            out.append(n.tail or "")
            continue
        out.append(n.text or "")
        for child in reversed(n):
            todo.append((child, True))
            if child.tag not in without:
                todo.append((child, False))
    return "".join(out)


def spa_of(html: str) -> str | None:
    """The framework that a page shows signs of; the first of the list."""
    signs = [
        ("Next.js (React)", ("__NEXT_DATA__", 'id="__next"')), ("React", ("data-reactroot", "data-reactid")), ("Angular", ('ng-version="',)), ("Nuxt (Vue)", ("__NUXT__", 'id="__nuxt"')),
        ("Vue.js", ("data-v-app",)), ("SvelteKit", ("__sveltekit",)), ("Gatsby (React)", ('id="___gatsby"',)),
    ]
    for name, marks in signs:
        if any(m in html for m in marks) or (name == "Vue.js" and re.search(r"\bnew Vue\(", html)):
            return name
    return None


def units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def json_ld(root: ET.Element) -> Iterator[tuple[str, str, str]]:
    for node in root.iter("script"):
        raw = text_of(node).strip() if node.get("type", "").lower().strip() == "application/ld+json" else ""
        if not raw:
            continue
        try:
            got = json.loads(raw, parse_constant=_no_constant)
            graph = got.get("@graph") if isinstance(got, dict) else None
            if got is None:
                raise ValueError("null has no properties")
        except ValueError:
            yield "jsonld", "PARSE_ERROR", raw[:5000]
            continue
        items = got if isinstance(got, list) else [got] if graph is None else graph
        for item in items if isinstance(items, list) else [items]:
            if isinstance(item, (dict, list)):
                kind = item.get("@type", "Unknown") if isinstance(item, dict) else "Unknown"
                kind = "Unknown" if kind is None else ",".join(map(str, kind)) if isinstance(kind, list) else str(kind)
                yield "jsonld", kind, json.dumps(item, ensure_ascii=False, separators=(",", ":"))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def microdata(root: ET.Element) -> Iterator[tuple[str, str, str]]:
    """Top-level items with all properties below them."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.get("itemscope") is None:
            todo.extend(reversed(node))
            continue
        kind, props = node.get("itemtype", "").strip(), {}
        for p in node.iter():
            name = p.get("itemprop", "").strip()
            if p is not node and name:
                value = next((v for v in (p.get("content"), p.get("href"), p.get("src")) if v is not None), None)
                props.setdefault(name, []).append((clean(text_of(p)) if value is None else value)[:500])
        name = kind.split("/")[-1]
        yield "microdata", name, json.dumps({"@type": name, "itemtype": kind, "properties": props}, ensure_ascii=False, separators=(",", ":"))


PARSED = (
    "id long, title string, title_count int, title_px int, meta_description string, meta_description_count int, meta_description_px int, meta_robots string, canonical string, canonical_all array<string>, viewport string, "
    "h1 array<string>, h2 array<string>, rel_next string, rel_prev string, og map<string,string>, word_count int, text_ratio double, content_hash string, simhash string, spa_framework string, "
    "links array<struct<href:string,anchor:string,rel:string,follow:int>>, images array<struct<src:string,alt:string,has_dimensions:int,loading:string>>, hreflang array<struct<lang:string,href:string>>, structured array<struct<format:string,type:string,json:string>>"
)


def parse_page(html: str, page_url: str) -> dict:
    """What a page says about itself, its links, images, alternates and structured data."""
    root = tree(html)
    head, body = root[0], root[1]
    own = urls.parse(page_url or "")
    stated = next((n.get("href") for n in root.iter("base") if n.get("href") is not None), None)
    base = (urls.parse(stated, own) if stated and own else None) or own

    def absolute(href: str | None) -> str | None:
        got = urls.parse(href.strip(), base) if href and base else None
        return got and str(got)

    metas, tags = list(root.iter("meta")), [(n, n.get("rel", "").lower().strip(), n.get("href")) for n in root.iter("link")]
    titles = [n for n in head.iter("title")]
    descs = [n for n in head.iter("meta") if n.get("name", "").lower() == "description"]
    title = clean(text_of(titles[0])) if titles else None
    desc = clean(descs[0].get("content", "")) if descs else None
    robots = [n.get("content").lower().strip() for n in metas if n.get("name", "").lower() in ("robots", "googlebot") and n.get("content")]
    canonicals = [u for _, rel, href in tags if rel == "canonical" and (u := absolute(href))]
    pages = [(n.get("rel", "").lower().strip(), absolute(n.get("href"))) for n in head.iter("link")]
    og: dict[str, str] = {}
    for n in metas:
        name, value = (n.get("property") if n.get("property") is not None else n.get("name", "")).lower(), n.get("content")
        if name.startswith(("og:", "twitter:")) and value:
            og.setdefault(name, value[:500])
    links = []
    for n in root.iter("a"):
        href = n.get("href", "").strip()
        if href and not href.startswith("#") and not re.match(r"(?i)(javascript|mailto|tel|data):", href) and (to := absolute(href)):
            rel = n.get("rel", "").lower()
            links.append({"href": to, "anchor": clean(text_of(n))[:200], "rel": rel, "follow": int(not re.search(r"\bnofollow\b", rel))})
    images = []
    for n in root.iter("img"):
        src = (n.get("src") if n.get("src") is not None else n.get("data-src", "")).strip()
        if src and not src.startswith("data:") and (at := absolute(src)):
            alt = n.get("alt")
            images.append({"src": at, "alt": None if alt is None else clean(alt), "has_dimensions": int(n.get("width") is not None and n.get("height") is not None), "loading": n.get("loading")})
    visible = clean(text_of(body, HIDDEN))
    return {
        "title": title, "title_count": len(titles), "title_px": pixels_of(title, TITLE_PX) if title else None, "meta_description": desc, "meta_description_count": len(descs), "meta_description_px": pixels_of(desc, DESC_PX) if desc else None,
        "meta_robots": ", ".join(robots) or None, "canonical": canonicals[0] if canonicals else None, "canonical_all": canonicals if len(canonicals) > 1 else None, "viewport": next((n.get("content") for n in metas if n.get("name") == "viewport"), None),
        "h1": [clean(text_of(n))[:300] for n in root.iter("h1")], "h2": [clean(text_of(n))[:300] for n in root.iter("h2")],
        "rel_next": next((u for r, u in pages if r == "next" and u), None), "rel_prev": next((u for r, u in pages if r == "prev" and u), None), "og": og,
        "word_count": len(visible.split(" ")) if visible else 0, "text_ratio": units(visible) / units(html) if html else 0.0, "content_hash": hashlib.sha1(visible.encode("utf-8", "replace")).hexdigest(), "simhash": f"{simhash_of(visible) % (1 << 64):x}", "spa_framework": spa_of(html),
        "links": links, "images": images, "hreflang": [{"lang": n.get("hreflang").strip(), "href": u} for n, rel, href in tags if rel == "alternate" and n.get("hreflang") and (u := absolute(href))],
        "structured": [{"format": f, "type": t, "json": j} for f, t, j in [*json_ld(root), *microdata(root)]],
    }


#: What the second version of a page, as a browser has left it, adds.
RENDERED = "rendered_title string, rendered_meta_description string, rendered_canonical string, rendered_meta_robots string, rendered_h1 array<string>, rendered_word_count int, render_links array<struct<href:string,anchor:string,rel:string,follow:int>>"


UNSEEN = {x.split(" ")[0]: None for x in RENDERED.split(", ")}


def compare_rendered(first: dict, html: str, page_url: str) -> dict:
    """The columns RENDERED of a page whose stored version is parsed already: links whose target the stored version has are left out, repeats of new ones stay."""
    second = parse_page(html, page_url)
    known = {x["href"] for x in first["links"]}
    own = {f"rendered_{c}": second[c] for c in ("title", "meta_description", "canonical", "meta_robots", "h1", "word_count")}
    return own | {"render_links": [x for x in second["links"] if x["href"] not in known]}


def parsed(raw: DataFrame) -> DataFrame:
    """raw (id, url, html, and rendered_html if it is known) to the columns PARSED and RENDERED, a row each.

    Both versions of a page are parsed in one pass over the table and compared where
    they are.  A null page is empty; without a rendered version the columns RENDERED
    are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, u, h, r in zip(batch["id"], batch["url"], batch["html"], batch["rendered_html"], strict=True):
                first = parse_page(h or "", u)
                rows.append({"id": i} | first | (compare_rendered(first, r, u) if r is not None else UNSEEN))
            table = pd.DataFrame(rows, columns=[c for c in FIELDS])
            yield table.assign(rendered_word_count=table["rendered_word_count"].astype("Int32"))

    second = raw["rendered_html"] if "rendered_html" in raw.columns else F.lit(None).cast("string").alias("rendered_html")
    return raw.select("id", "url", "html", second).mapInPandas(run, f"{PARSED}, {RENDERED}")


FIELDS = [x.strip().split(" ")[0] for x in re.split(r",\s(?=[a-z0-9_]+ )", f"{PARSED}, {RENDERED}")]

_SIMPLE = re.compile(r"""(?P<tag>[\w-]+|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\]\s]+)))?\s*\]|:(?P<pseudo>first-child|last-child|nth-child\((?P<n>\d+)\))""")


def compound(text: str):
    """A test for one compound selector: tag, id, classes, attributes, first-, last- and nth-child."""
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not understood: {text}")
        at = m.end()
        g = m.groupdict()
        if g["tag"]:
            tests.append(lambda n, up, t=g["tag"].lower(): t == "*" or n.tag == t)
        elif g["id"]:
            tests.append(lambda n, up, v=g["id"]: n.get("id") == v)
        elif g["cls"]:
            tests.append(lambda n, up, v=g["cls"]: v in n.get("class", "").split())
        elif g["attr"]:
            value = next((g[k] for k in ("dq", "sq", "raw") if g[k] is not None), None)
            tests.append(lambda n, up, k=g["attr"].lower(), op=g["op"], v=value: k in n.attrib and (op is None or ATTR[op](n.attrib[k], v)))
        else:
            place = -1 if g["pseudo"] == "last-child" else int(g["n"] or 1) - 1
            tests.append(lambda n, up, i=place: n in up and -len(up[n]) <= i < len(up[n]) and up[n][i] is n)
    return lambda n, up: all(t(n, up) for t in tests)


PIECE = re.compile(r"((?:\[[^\]]*\]|[^\s>+~\[])+)|([>+~])")
ATTR = {"=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "|=": lambda a, v: a == v or a.startswith(v + "-"), "^=": lambda a, v: bool(v) and a.startswith(v), "$=": lambda a, v: bool(v) and a.endswith(v), "*=": lambda a, v: bool(v) and v in a}


def select(root: ET.Element, selector: str) -> list[ET.Element]:
    """Elements that a selector list matches, in document order."""
    up = {child: node for node in root.iter() for child in node}
    chains = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, link = [], " "
        if PIECE.sub("", one).strip():
            raise ValueError(f"selector not understood: {selector}")
        for part, sign in PIECE.findall(one):
            if sign:
                link = sign
            else:
                steps.append((link, compound(part)))
                link = " "
        if not steps:
            raise ValueError(f"selector not understood: {selector}")
        chains.append(steps)

    def fits(node: ET.Element, steps: list) -> bool:
        link, test = steps[-1]
        if not test(node, up):
            return False
        if len(steps) == 1:
            return True
        if link in "+~":
            siblings = list(up[node]) if node in up else []
            before = siblings[: siblings.index(node)] if siblings else []
            return any(fits(b, steps[:-1]) for b in (before[-1:] if link == "+" else before))
        while node in up:
            node = up[node]
            if fits(node, steps[:-1]):
                return True
            if link == ">":
                return False
        return False

    return [n for n in root.iter() if any(fits(n, c) for c in chains)]


def css_each(html: str, selector: str, extract: str = "text", attribute: str | None = None) -> Iterator[str]:
    for n in select(tree(html), selector):
        if extract == "attr" and attribute:
            value = n.get(attribute.lower())
        elif extract == "html":
            n.tail, kept = None, n.tail
            value = ET.tostring(n, encoding="unicode", method="html")
            n.tail = kept
        else:
            value = clean(text_of(n))
        if value:
            yield value


def css(html: str, selector: str, extract: str = "text", attribute: str | None = None) -> list[str]:
    return list(css_each(html, selector, extract, attribute))


def xpath(html: str, path: str) -> list[str]:
    """Paths of elements with the library's predicates, ending in /@attribute or /text() if wanted; string(...) and count(...) around a path."""
    outer = re.fullmatch(r"(string|count)\((.*)\)", path.strip())
    inner, end = re.fullmatch(r"(.*?)(?:/(@[\w:-]+|text\(\)))?", (outer[2] if outer else path).strip(), re.S).groups()
    root = ET.Element("document")
    root.append(tree(html))
    nodes = root.findall("." + inner if inner.startswith("/") else inner or ".")
    if end == "text()":
        found = [t for n in nodes for t in (n.text, *(c.tail for c in n)) if t]
    else:
        found = [n.get(end[1:]) for n in nodes if n.get(end[1:]) is not None] if end else [text_of(n) for n in nodes]
    if outer:
        found = [str(len(found))] if outer[1] == "count" else found[:1]
    return [c for f in found if (c := clean(f))]


def regex_each(html: str, pattern: str) -> Iterator[str]:
    for m in re.finditer(pattern, html, re.I):
        yield m[1] if m.re.groups and m[1] is not None else m[0]


def regex(html: str, pattern: str) -> list[str]:
    return list(regex_each(html, pattern))


def extract_each(html: str, extractors: list[dict]) -> Iterator[tuple[str, str]]:
    """(extractor, value) of each match, whole and however many there are; an extractor that fails on a page has none there: what can fail does so before its first match."""
    for x in extractors:
        try:
            kind = x.get("type", "css")
            got = css_each(html, x["expression"], x.get("extract", "text"), x.get("attribute")) if kind == "css" else xpath(html, x["expression"]) if kind == "xpath" else regex_each(html, x["expression"])
            for v in got:
                yield x["id"], v
        except (ValueError, SyntaxError, KeyError, re.error):
            pass


def extract_all(html: str, extractors: list[dict]) -> list[tuple[str, str]]:
    return list(extract_each(html, extractors))
