"""Records in web pages: titles, links and metadata as expressions; tables, cards, JSON-LD and microdata from a tree.

Pages are rows (url, html). The tree is built by the standard library's parser in Arrow-sized batches, page by page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FIELDS = ("name", "description", "price", "rating", "link", "image", "category")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENTITY_TYPES = frozenset("product article newsarticle blogposting recipe event book movie jobposting restaurant localbusiness softwareapplication offer".split())
LAZY = ("data-src", "data-lazy-src", "data-lazy", "data-original", "data-echo")
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
MOST_EXTRAS = 8
CARD_FIELDS = {
    "name": "h1, h2, h3, h4, h5, [class*=title], [class*=name], [class*=heading]", "description": "p, [class*=desc], [class*=summary], [class*=subtitle], [class*=excerpt]", "price": "[class*=price], [itemprop=price]",
    "rating": "[class*=rating], [class*=stars], [aria-label*=rating]", "link": "a[href]", "category": "[class*=category], [class*=tag], [class*=badge], [class*=breadcrumb]",
}
CARD_WORDS = frozenset("name title heading description desc summary subtitle excerpt price rating stars link href image img category tag badge breadcrumb".split())
ATTRIBUTES = {
    "brand": "Brand", "sku": "SKU", "location": "Location", "address": "Address", "author": "Author", "publisher": "Publisher", "duration": "Duration", "availability": "Availability", "stock": "Stock",
    "bedroom": "Bedrooms", "bathroom": "Bathrooms", "area": "Area", "salary": "Salary", "employment": "Employment Type", "isbn": "ISBN", "weight": "Weight", "color": "Color", "colour": "Color", "size": "Size",
    "material": "Material", "warranty": "Warranty", "condition": "Condition", "seller": "Seller", "shipping": "Shipping", "posted": "Posted",
}
LABELLED = re.compile(r"\s*([A-Za-z][A-Za-z ]{1,24}?)\s*:\s*(.+\S)\s*")
LINKED_FIELDS = frozenset("@context @type @id name headline description price lowprice pricecurrency offers aggregaterating image url category articlesection".split())
PROPERTY_FIELDS = frozenset("name headline title description price lowprice ratingvalue ratingscore url image category".split())
MONEY = re.compile(r"(?:₹|\$|€|£)\s?[0-9][0-9,.]*")
RATING = re.compile(r"[0-5](?:\.[0-9])?\s*(?:out of\s*5|stars|★)", re.I)
# End of fixed values.
SCHEMA = "url string, " + ", ".join(f"{f} string" for f in FIELDS) + ", extra array<struct<k:string,v:string>>, strategy string"


def page_title(html: Column) -> Column:
    return unescape(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))


def links(html: Column) -> Column:
    """Distinct targets of links, as they stand."""
    return F.array_distinct(F.filter(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*"([^"]*)\""""), F.lit(1)), lambda x: F.trim(x) != ""))


def unescape(text: Column) -> Column:
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    return text


def visible_text(html: Column) -> Column:
    """The text of the body, white space folded."""
    body = F.regexp_replace(html, r"(?is)<head\b.*?</head>|<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", " ")
    body = F.regexp_replace(body, r"(?i)</?(?:b|i|em|strong|a|span|u|small|code)\b[^>]*>", "")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(body, r"<[^>]*>", " ")), r"[\s\p{Z}]+", " "))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        if self.tag in ("script", "style"):
            return ""
        return " ".join(" ".join(c.text() if isinstance(c, Node) else c for c in self.children).split())

    def raw(self) -> str:
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        while tag in CLOSES and self.at.tag in CLOSES[tag]:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


SELECTOR = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)")


def _meets(node: Node, simple: str) -> bool:
    m = SELECTOR.fullmatch(simple)
    if not m or (m[1] and m[1] != "*" and m[1].lower() != node.tag):
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == ".":
            good = part[1:] in node.classes()
        elif part[0] == "#":
            good = node.attrs.get("id") == part[1:]
        else:
            name, op, want = re.fullmatch(r"\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"']*)[\"']?)?\s*\]", part).groups()
            has = node.attrs.get(name)
            good = has is not None and (op is None or {"=": has == want, "*=": want in has, "^=": has.startswith(want or ""), "$=": has.endswith(want or "")}[op])
        if not good:
            return False
    return True


def select(node: Node, selector: str) -> list[Node]:
    """Descendants by tag, class, id and attribute selectors, with descendants and commas."""
    chains = [c.split() for c in selector.split(",") if c.strip()]

    def matches(n: Node, chain: list[str]) -> bool:
        if not _meets(n, chain[-1]):
            return False
        up, rest = n.parent, chain[:-1]
        while rest and up is not None:
            if up.tag and _meets(up, rest[-1]):
                rest = rest[:-1]
            up = up.parent
        return not rest

    return [n for n in node.walk() if any(matches(n, c) for c in chains)]


def tables(root: Node) -> list[list[list[str]]]:
    return [[[c.text() for c in r.walk() if c.tag in ("td", "th")] for r in t.walk() if r.tag == "tr"] for t in root.walk() if t.tag == "table"]


def image_of(node: Node, base: str) -> str | None:
    for img in (n for n in node.walk() if n.tag in ("img", "source")):
        for name in (*LAZY, "srcset", "src"):
            value = img.attrs.get(name, "").strip()
            if value and not value.startswith("data:"):  # a placeholder
                return urljoin(base, value.split(",")[0].split(" ")[0])
    return next((urljoin(base, m[1]) for n in (node, *node.walk()) if (m := re.search(r"background(?:-image)?\s*:[^;]*url\([\"']?([^\"')]+)", n.attrs.get("style", "")))), None)


def _own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def card_extras(node: Node) -> dict[str, str]:
    """Up to eight more labels of a card: term lists, class names that tell of attributes, children that say ``Label: value``."""
    found: list[tuple[str, str]] = []
    for n in node.walk():
        if n.tag == "dt":
            beside = [c for c in n.parent.children if isinstance(c, Node)]
            after = beside[beside.index(n) + 1 :][:1]
            found += [(label(n.text()), d.text()) for d in after if d.tag == "dd"]
    found += [(name, t) for hint, name in ATTRIBUTES.items() if (hits := select(node, f"[class*={hint}]")) and (t := hits[0].text())]
    for c in node.children:
        if isinstance(c, Node) and (m := LABELLED.fullmatch(_own_text(c))) and m[1].strip().lower() not in CARD_WORDS:
            found.append((label(m[1]), m[2]))
    out: dict[str, str] = {}
    for name, value in found:
        if name and value.strip() and len(out) < MOST_EXTRAS:
            out.setdefault(name, value.strip())
    return out


def card(node: Node, base: str) -> dict:
    """Fields of a card by tags and class names, money and ratings also by their looks."""
    first = {name: next(iter(select(node, where)), None) for name, where in CARD_FIELDS.items()}
    anchor, picture, text = first["link"], next((n for n in node.walk() if n.tag == "img" and n.attrs.get("alt")), None), node.text()
    seen = lambda pattern: m[0] if (m := pattern.search(text)) else None
    name = first["name"].text() if first["name"] else (anchor.text() or anchor.attrs.get("title")) if anchor else picture.attrs["alt"] if picture else None
    price = first["price"].text() if first["price"] else seen(MONEY)
    rating = (first["rating"].attrs.get("aria-label") or first["rating"].text()) if first["rating"] else seen(RATING)
    made = {"name": name, "description": first["description"].text() if first["description"] else None, "price": price, "rating": rating, "link": urljoin(base, anchor.attrs["href"]) if anchor else None, "image": image_of(node, base), "category": first["category"].text() if first["category"] else None}
    return {k: v.strip() or None if v else None for k, v in made.items()} | {"extra": list(card_extras(node).items())}


def cards(root: Node, base: str) -> list[dict]:
    """The largest group of three or more siblings of one tag and class, preferably with headings or links."""
    groups: dict[tuple, list[Node]] = {}
    for n in root.walk():
        if n.tag in ("article", "li", "div", "section"):
            for c in n.classes() or [""]:
                groups.setdefault((id(n.parent), n.tag, c), []).append(n)
    told = lambda g: sum(any(x.tag == "a" or re.fullmatch("h[1-6]", x.tag) for x in n.walk()) for n in g) * 2 >= len(g)
    large = [g for g in groups.values() if len(g) >= 3]
    best = max([g for g in large if told(g)] or large, key=len, default=[])
    return [x for x in (card(n, base) for n in best) if any(x[f] for f in FIELDS)]


def label(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in re.split(r"[\s_-]+", name.lower()) if w)


def _scalar(v) -> str | None:
    """A text that is not blank, or a number."""
    if isinstance(v, str):
        return v.strip() or None
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _named(v) -> str | None:
    return (v.get("name") if isinstance(v.get("name"), str) and v["name"].strip() else None) if isinstance(v, dict) else v if isinstance(v, str) and v.strip() else None


def _entity(x: dict, base: str) -> dict:
    """The record of an entity: fields by their keys, all other properties that have a text as extras."""
    get = lambda *keys: next((t for k in keys if (t := _scalar(x.get(k)))), None)
    offers = x.get("offers")
    offer = next(iter(offers), None) if isinstance(offers, list) else offers
    price = None
    if isinstance(offer, dict) and (amount := _scalar(offer.get("price", offer.get("lowPrice")))):
        price = f"{offer.get('priceCurrency') or ''} {amount}".strip()
    image = x.get("image")
    while isinstance(image, list):
        image = image[0] if image else None
    image = image.get("url") if isinstance(image, dict) else image
    rating = x["aggregateRating"].get("ratingValue") if isinstance(x.get("aggregateRating"), dict) else None
    link = get("url")
    extra = {}
    for k, v in x.items():
        if k.lower() in LINKED_FIELDS or len(extra) >= MOST_EXTRAS:
            continue
        if isinstance(v, list):
            text = ", ".join(t for y in v if (t := _named(y)))
        else:
            text = str(v).lower() if isinstance(v, bool) else _named(v) or _scalar(v)
        if text:
            extra[label(k)] = text
    return {
        "name": get("name", "headline"), "description": get("description"), "price": price or get("price", "lowPrice"), "rating": None if rating is None else str(rating),
        "link": urljoin(base, link) if link else None, "image": urljoin(base, image) if isinstance(image, str) and image.strip() else None, "category": get("category", "articleSection"), "extra": list(extra.items()),
    }


def json_ld(root: Node, base: str) -> list[dict]:
    """Entities of the known types, nested ones too; of those alike in name, link and price the first."""
    found: dict[tuple, dict] = {}
    todo: list = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                todo.append(json.loads(n.raw()))
            except ValueError:
                continue
    todo.reverse()
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            kinds = x.get("@type")
            if ENTITY_TYPES & {k.lower() for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}:
                made = _entity(x, base)
                if made["extra"] or any(made[f] for f in FIELDS):
                    found.setdefault((made["name"], made["link"], made["price"]), made)
            todo += [x[k] for k in ("item", "mainEntity", "itemListElement", "@graph") if k in x and (k != "item" or isinstance(x[k], dict))]
    return list(found.values())


def _property(n: Node, base: str) -> str:
    """The value of a microdata property."""
    if n.tag == "img":
        return (image_of(n, base) or n.attrs.get("content", "")).strip()
    if n.tag == "a" and "content" not in n.attrs:
        return urljoin(base, n.attrs.get("href", "")).strip() if n.attrs.get("href") else ""
    return next((n.attrs[a] for a in ("content", "datetime") if a in n.attrs), None or n.text()).strip()


def microdata(root: Node, base: str) -> list[dict]:
    """A record for each element with itemscope; one or two count only if all are named."""
    out = []
    for scope in root.walk():
        if "itemscope" not in scope.attrs:
            continue
        inside = [(n.attrs["itemprop"].strip(), n) for n in (scope, *scope.walk()) if (n.attrs.get("itemprop") or "").strip()]
        first: dict[str, Node] = {}
        for name, n in inside:
            first.setdefault(name, n)
        get = lambda *names: next((v for name in names if name in first and (v := _property(first[name], base))), None)  # noqa: E731, B023
        anchor = next((n for n in scope.walk() if n.tag == "a" and n.attrs.get("href")), None)
        extra: dict[str, str] = {}
        for name, n in inside:
            if name.lower() not in PROPERTY_FIELDS and len(extra) < MOST_EXTRAS and label(name) not in extra and (v := _property(n, base)):
                extra[label(name)] = v
        link = get("url") or (anchor and anchor.attrs["href"])
        x = {"name": get("name", "headline", "title"), "description": get("description"), "price": get("price", "lowPrice"), "rating": get("ratingValue", "ratingScore"), "link": urljoin(base, link) if link else None, "image": get("image"), "category": get("category"), "extra": list(extra.items())}
        if extra or any(x[f] for f in FIELDS):
            out.append(x)
    return out if len(out) >= 3 or all(x["name"] for x in out) else []


def page_meta(root: Node, base: str) -> list[dict]:
    meta = {(n.attrs.get("property") or n.attrs.get("name") or "").lower(): n.attrs.get("content", "") for n in root.walk() if n.tag == "meta"}
    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    get = lambda *keys: next((meta[k] for k in keys if meta.get(k)), None)
    image = get("og:image", "twitter:image")
    x = {"name": get("og:title", "twitter:title") or title or None, "description": get("og:description", "twitter:description", "description"), "price": get("product:price:amount", "og:price:amount"), "rating": None, "link": get("og:url") or base, "image": urljoin(base, image) if image else None, "category": get("article:section"), "extra": []}
    return [x] if x["name"] or x["description"] else []


def manual(root: Node, base: str, selectors: dict[str, str]) -> list[dict]:
    """Records by selectors for the container and its fields; a field without one goes by the card's rules."""
    if not selectors.get("container"):
        return []
    out = []
    for n in select(root, selectors["container"]):
        x = card(n, base)
        for key, selector in selectors.items():
            field = {"title": "name"}.get(key, key)
            if field in FIELDS and selector.strip():
                hit = next(iter(select(n, selector)), None)
                x[field] = None if hit is None else urljoin(base, hit.attrs.get("href", "")) if field == "link" else image_of(Node("", {}, None) if hit.tag != "img" else _holder(hit), base) if field == "image" else hit.text()
        if any(x[f] for f in FIELDS):
            out.append(x)
    return out


def _holder(node: Node) -> Node:
    out = Node("", {}, None)
    out.children.append(node)
    return out


def items(url: str, html: str, selectors: dict[str, str] | None = None) -> tuple[str, list[dict]]:
    """The first strategy that finds something: selectors, JSON-LD, microdata, cards, the page itself."""
    root, base = Tree(html or "").root, url or ""
    for name, f in (("manual", lambda: manual(root, base, selectors or {})), ("json-ld", lambda: json_ld(root, base)), ("microdata", lambda: microdata(root, base)), ("cards", lambda: cards(root, base)), ("page", lambda: page_meta(root, base))):
        if found := f():
            return name, found
    return "none", []


def extract(pages: DataFrame, selectors: dict[str, str] | None = None) -> DataFrame:
    """(url, fields, extra, strategy): the records of each page (url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"]):
                name, found = items(url, html, selectors)
                rows += [(url, *[x[f] for f in FIELDS], [{"k": k, "v": v} for k, v in x["extra"]], name) for x in found]
            yield pd.DataFrame(rows, columns=["url", *FIELDS, "extra", "strategy"])

    return pages.select("url", "html").mapInPandas(run, SCHEMA)


def page_tables(pages: DataFrame) -> DataFrame:
    """(url, table, row, cells) of every table of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, t, r, c) for u, h in zip(batch["url"], batch["html"]) for t, table in enumerate(tables(Tree(h or "").root)) for r, c in enumerate(table)]
            yield pd.DataFrame(rows, columns=["url", "table", "row", "cells"])

    return pages.select("url", "html").mapInPandas(run, "url string, table int, row int, cells array<string>")


def flat(records: DataFrame, most_labels: int = 200) -> DataFrame:
    """Fields and extra labels as columns, blanks for what a record lacks; labels are counted before they become columns.

    The ``most_labels`` commonest labels are columns; if there are more, a map column ``More`` has the others' values.
    """
    ranked = [r["k"] for r in records.select(F.explode("extra").alias("e")).groupBy("e.k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(most_labels + 1).collect()]
    taken = {f.capitalize() for f in FIELDS} | {"Source"}
    labels = [k for k in ranked[:most_labels] if k.capitalize() not in taken]
    extra = F.map_from_entries("extra")
    others = [F.map_filter(extra, lambda k, v: ~k.isin(ranked[:most_labels])).alias("More")] if len(ranked) > most_labels else []
    return records.select(F.col("url").alias("Source"), *[F.coalesce(F.col(f), F.lit("")).alias(f.capitalize()) for f in FIELDS], *[F.coalesce(F.try_element_at(extra, F.lit(k)), F.lit("")).alias(k) for k in labels], *others)


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands on a page, made absolute; null where that cannot be read."""
    bare, site = F.trim(link), F.regexp_extract(base, r"(?i)\A([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#](?s:.*)\z", ""), r"(?<=[^/:]/)[^/]*\z", "")
    folder = F.when(folder.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://[^/]*\z"), F.concat(folder, F.lit("/"))).otherwise(folder)
    return (
        F.when(bare.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, r"(?i)\A([a-z][a-z0-9+.-]*:)", 1), bare))
        .when(bare.startswith("/"), F.concat(site, bare))
        .when(bare.startswith("#"), F.concat(F.regexp_replace(base, r"#(?s:.*)\z", ""), bare))
        .when(bare.startswith("?"), F.concat(F.regexp_replace(base, r"[?#](?s:.*)\z", ""), bare))
        .otherwise(F.concat(folder, bare))
    )


def _described(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    found = F.array_distinct(F.transform(links(html), lambda x: absolute(x, F.col("url"))))
    return pages.select(F.col("url"), page_title(html).alias("title"), found.alias("links"), F.regexp_count(html, F.lit(r"(?i)<table\b")).alias("tables"), visible_text(html).alias("text"))


def fallback(pages: DataFrame, preview: int = 300) -> DataFrame:
    """A row for each page without records: Title, Source URL, Links Found, Tables Found, Text Preview."""
    return _described(pages).select(F.col("title").alias("Title"), F.col("url").alias("Source URL"), F.size("links").cast("string").alias("Links Found"), F.col("tables").cast("string").alias("Tables Found"), F.substring("text", 1, preview).alias("Text Preview"))


def summary(pages: DataFrame, preview: int = 500) -> DataFrame:
    """(url, place, Field, Value): what is known of a page without records, as a small table in order."""
    rows = (("Title", F.col("title")), ("URL", F.col("url")), ("Links found", F.size("links").cast("string")), ("Text preview", F.substring("text", 1, preview)))
    return _described(pages).select("url", F.posexplode(F.array(*[F.struct(F.lit(k).alias("Field"), v.alias("Value")) for k, v in rows])).alias("place", "f")).select("url", "place", "f.*")


def report(pages: DataFrame) -> DataFrame:
    """(url, report): address, title, text and links of each page as a text."""
    lines = F.concat(F.lit("URL: "), F.col("url"), F.lit("\nTitle: "), F.col("title"), F.lit("\n\n"), F.col("text"), F.lit("\n\n--- LINKS ---\n"), F.array_join(F.transform("links", lambda x: F.concat(x, F.lit("\n"))), ""))
    return _described(pages).select("url", lines.alias("report"))
