"""Pages to links and to offers: a small tree of the page, a subset of CSS selectors, and one Arrow function over both."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.urls import host_of, is_blocked, link_class, same_shop, strip_fragment, strip_www
from cataloom.operators.mutations import unknown_hosts

OFFER = "name string, price double, original_price double, product_url string, image_url string, rating double, review_count int, in_stock boolean"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def data(self) -> str:
        return "".join(c if isinstance(c, str) else c.data() for c in self.children)

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                stack += reversed(x.children)
        return " ".join("".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w:-]+)(?:([*^$]?=)\"?([^\]\"]*)\"?)?\]")


def _compile(selector: str) -> list[list[list[tuple]]]:
    """Alternatives of chains of simple tests: tags, .class, #id, [attr], [attr=v], [attr*=v], and descendants."""
    return [[[m.groups() for m in _SIMPLE.finditer(step)] for step in chain.split()] for chain in selector.split(",")]


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, cls, ident, attr, op, value in tests:
        if tag and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr:
            got = node.attrs.get(attr)
            if got is None or op == "=" and got.lower() != value.lower() or op == "*=" and value not in got:
                return False
    return True


def select(root: Node, selector: str) -> Node | None:
    """The first node in document order that a selector finds."""
    chains = _compile(selector)
    for node in root.walk():
        for chain in chains:
            if not _fits(node, chain[-1]):
                continue
            up, left = node.parent, len(chain) - 2
            while up is not None and left >= 0:
                left -= _fits(up, chain[left])
                up = up.parent
            if left < 0:
                return node
    return None


_PRICE = re.compile(r"(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d{1,2}))?")
_DIGITS = str.maketrans("০১২৩৪৫৬৭৮৯", "0123456789")


def first_price(text: str | None) -> float | None:
    """As numbers.first_price, for the extractors."""
    for m in _PRICE.finditer((text or "").translate(_DIGITS)):
        whole = m[1].replace(",", "")
        if len(whole) > 1 and whole[0] == "0" or m[2] and int(whole) < 10:
            continue
        value = float(f"{whole}.{m[2] or 0}")
        if 5 <= value < 1e8:
            return value
    return None


def _round1(x: float) -> float:
    return int(x * 10 + 0.5) / 10


def stars(text: str | None) -> float | None:
    m = re.search(r"\d+[.,]?\d*", text or "")
    v = float(m[0].replace(",", ".")) if m else -1.0
    return _round1(v) if 0 <= v <= 5 else _round1(v / 20) if 5 < v <= 100 else None


def _number(x) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    return float(x) if isinstance(x, (int, float)) else first_price(x) if isinstance(x, str) else None


def _products(x) -> Iterator[dict]:
    """Objects of type Product in a JSON-LD value, through lists and @graph."""
    if isinstance(x, list):
        for y in x:
            yield from _products(y)
    elif isinstance(x, dict):
        yield from _products(x.get("@graph"))
        kinds = x.get("@type")
        if any(isinstance(k, str) and k.lower() == "product" for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield x


def _image(x) -> str | None:
    if isinstance(x, list):
        x = x[0] if x else None
    return x.get("url") if isinstance(x, dict) else x if isinstance(x, str) else None


def from_json_ld(root: Node) -> dict | None:
    for node in root.walk():
        if node.tag != "script" or node.attrs.get("type", "").lower() != "application/ld+json":
            continue
        try:
            found = next(_products(json.loads(node.data())), None)
        except ValueError:
            continue
        if not found or not isinstance(found.get("name"), (str, int, float)) or not str(found["name"]).strip():
            continue
        rated = found.get("aggregateRating") or {}
        offer = found.get("offers") or {}
        offer = (offer[0] if offer else {}) if isinstance(offer, list) else offer
        price = _number(offer.get("price"))
        price = _number(offer.get("lowPrice")) if price is None else price
        high = _number(offer.get("highPrice"))
        count = rated.get("reviewCount", rated.get("ratingCount"))
        state = offer.get("availability")
        sold = isinstance(state, str) and any(w in state.lower() for w in ("outofstock", "soldout"))
        return {
            "name": str(found["name"]).strip(), "price": price, "original_price": high if high is not None and (price is None or high > price) else None,
            "image_url": _image(found.get("image")), "rating": _number_any(rated.get("ratingValue")), "review_count": count if isinstance(count, int) else None, "in_stock": not sold,
        }
    return None


def _number_any(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else first_price(x) if isinstance(x, str) else None


def _meta(root: Node, name: str) -> str | None:
    node = select(root, f"meta[property={name}], meta[name={name}]")
    value = node.attrs.get("content", "") if node else ""
    return value if value.strip() else None


def from_open_graph(root: Node) -> dict | None:
    amount = _meta(root, "product:price:amount") or _meta(root, "og:price:amount")
    if amount is None and "product" not in (_meta(root, "og:type") or "").lower():
        return None
    name = _meta(root, "og:title")
    state = (_meta(root, "product:availability") or "").lower()
    sold = any(w in state for w in ("outofstock", "oos", "sold"))
    return {"name": name.strip(), "price": first_price(amount), "image_url": _meta(root, "og:image"), "in_stock": not sold} if name else None


def _value(node: Node | None, attr: str = "content") -> str | None:
    return None if node is None else node.attrs[attr] if attr in node.attrs else node.text()


def from_microdata(root: Node) -> dict | None:
    name, price, image = (select(root, f"[itemprop={x}]") for x in ("name", "price", "image"))
    label = _value(name)
    if price is None or not (label or "").strip():
        return None
    return {"name": label.strip(), "price": first_price(_value(price)), "image_url": image and (image.attrs.get("content") or image.attrs.get("src")), "in_stock": True}


# Where shop themes put name, price, image, rating and reviews, in order.
NAME_AT = "h1.product_title, h1.product-single__title, h1.product-title, h1.entry-title, h1[class*=product], h1"
PRICE_AT = ["p.price ins .woocommerce-Price-amount bdi", "p.price .woocommerce-Price-amount bdi", ".product-price-update", "span.price-item--sale", "span.price-item--regular", "span.price ins", "span.price", "[data-product-price]", ".product-info-price [data-price-amount]", "[itemprop=offers] [itemprop=price]"]
IMAGE_AT = "img.wp-post-image, .woocommerce-product-gallery__image img, .product-single__image, .product-image-main img, [itemprop=image], img[class*=product]"
RATING_AT = [".star-rating", "[class*=star-rating]", ".woocommerce-product-rating .rating", ".spr-badge-starrating", ".jdgm-prev-badge", "[data-rating]"]
REVIEWS_AT = [".woocommerce-review-link", ".reviews-count", ".reviewCount", ".spr-badge-caption", ".jdgm-prev-badge__text", "[class*=review-count]"]


def read_rating(root: Node) -> float | None:
    node = select(root, "[itemprop=ratingValue]")
    if node is not None and (got := stars(_value(node))) is not None:
        return got
    for at in RATING_AT:
        if (node := select(root, at)) is None:
            continue
        for attr in ("aria-label", "title", "data-rating", "data-score"):
            if (got := stars(node.attrs.get(attr))) is not None:
                return got
        span = select(node, "span[style*=width]")
        width = re.search(r"width:(\d+(?:\.\d+)?)%", re.sub(r"\s", "", span.attrs["style"])) if span else None
        if width:
            return _round1(float(width[1]) / 20)
    return None


def read_reviews(root: Node) -> int | None:
    node = select(root, "[itemprop=reviewCount], [itemprop=ratingCount]")
    if node is not None and (_value(node) or "").strip().isdigit():
        return int(_value(node).strip())
    for at in REVIEWS_AT:
        node = select(root, at)
        m = re.search(r"\d[\d,]*", node.text()) if node else None
        if m:
            return int(m[0].replace(",", ""))
    return None


def from_css(root: Node) -> dict | None:
    name = select(root, NAME_AT)
    if name is None or not name.text():
        return None
    for at in PRICE_AT:
        if (node := select(root, at)) is None:
            continue
        raw = next((node.attrs[a] for a in ("data-product-price", "data-price-amount", "content") if a in node.attrs), None)
        price = first_price(node.text() if raw is None else raw)
        if price:
            image = select(root, IMAGE_AT)
            return {"name": name.text(), "price": price, "image_url": image and (image.attrs.get("src") or image.attrs.get("data-src")), "rating": read_rating(root), "review_count": read_reviews(root), "in_stock": True}
    return None


def site_css(name: str, price: str, image: str, was: str | None = None):
    """An extractor of one site's own markup."""

    def extract(root: Node) -> dict | None:
        title, now = select(root, name), select(root, price)
        if title is None or now is None or (value := first_price(now.text())) is None:
            return None
        old = select(root, was) if was else None
        picture = select(root, image)
        return {"name": title.text(), "price": value, "original_price": first_price(old.text()) if old else None, "image_url": picture and picture.attrs.get("src"), "in_stock": True}

    return extract


def is_valid(offer: dict | None) -> bool:
    return bool(offer and (offer.get("name") or "").strip() and (offer.get("price") or 0) > 0)


GENERIC = [from_json_ld, from_open_graph, from_microdata, from_css]

#: Extractors of single sites: a part of the URL and the steps tried there. register() adds to it.
SITES: list[tuple[str, list]] = []


def register(url_part: str, steps: list) -> None:
    """Route URLs that hold url_part to these steps; the first registered part that fits wins."""
    SITES.append((url_part, steps))


# Sites with markup of their own.
register("daraz.com.bd", [site_css(".pdp-mod-product-badge-title, h1.pdp-product-title", ".pdp-price, .pdp-price_type_normal, span.pdp-price_color_orange", "img.pdp-mod-common-image, img.gallery-preview-panel__image"), from_json_ld, from_open_graph])
register("pickaboo.com", [from_json_ld, from_open_graph, site_css("h1.product-title, h1.product-name, h1", ".product-price .new-price, .product-price-now, .price--current", ".product-gallery img, img.product-image, .product-image-zoom img", ".product-price .old-price, .product-price-old, .price--was")])
register("startech.com.bd", [site_css("h1.product-name, .product-name h1, h1", "td.product-info-data.product-price, .product-price-update, .product-price", ".product-img-holder img, .product-image img, img.product-image-loader"), from_json_ld, from_open_graph])


def extract(url: str, html: str | None, sites: list[tuple[str, list]] | None = None) -> dict | None:
    """The offer of a page: the steps of its site, else the generic ones; the first with a name and a price wins."""
    steps = next((s for part, s in (SITES if sites is None else sites) if part in (url or "")), GENERIC)
    root = parse(html)
    for step in steps:
        offer = step(root)
        if is_valid(offer):
            offer["product_url"] = url
            image = offer.get("image_url")
            if image and not image.startswith("http"):
                offer["image_url"] = urljoin(url, image)
            return offer
    return None


def offers(pages: DataFrame) -> DataFrame:
    """(page_id, offer columns) of the pages that sell something; price 10 or more."""
    names = [x.split()[0] for x in OFFER.split(", ")]
    sites = list(SITES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(page, extract(url, html, sites)) for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"])]
            yield pd.DataFrame([{"page_id": page, **{n: o.get(n) for n in names}} for page, o in rows if o], columns=["page_id", *names])

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, {OFFER}").where("name is not null and price >= 10")


_SKIP = ("#", "javascript:", "mailto:", "tel:")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, shop_host) of each page's anchors, resolved; shop_host is the page's own host."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, url, html, shop in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["shop_host"]):
                pos = 0
                for node in parse(html).walk():
                    href = node.attrs.get("href", "").strip() if node.tag == "a" else ""
                    if href and not href.startswith(_SKIP):
                        try:
                            out.append((page, pos, urljoin(url or "", href), shop))
                        except ValueError:
                            continue
                        pos += 1
            yield pd.DataFrame(out, columns=["page_id", "pos", "url", "shop_host"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("shop_host"))
    return rows.mapInPandas(run, "page_id long, pos int, url string, shop_host string")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, class) of the anchors that stay in the page's shop, resolved and without fragments."""
    inside = anchors(pages).where(F.coalesce(same_shop(host_of(F.col("url")), F.col("shop_host")), F.lit(False)))
    return inside.select("page_id", "pos", strip_fragment(F.col("url")).alias("url")).withColumn("class", link_class(F.col("url")))


def discover(directory: DataFrame, shops: DataFrame, pending: DataFrame) -> DataFrame:
    """(host) of the sites that directory pages link to, without www, that are not blocked, not the directory's own, and neither shops nor pending ones (base_url)."""
    found = anchors(directory).select(host_of(F.col("url")).alias("full"), "shop_host")
    found = found.where(F.col("full").isNotNull() & ~is_blocked(F.col("full")) & ~F.coalesce(same_shop(F.col("full"), F.col("shop_host")), F.lit(False)))
    known = [rows.select(strip_www(host_of(F.col("base_url"))).alias("host")) for rows in (shops, pending)]
    return unknown_hosts(found.select(strip_www(F.col("full")).alias("host")), *known)


def crawl_front(pages: DataFrame, most: int = 1500, categories: int = 25) -> DataFrame:
    """(page_id, url): product links of each front page and of the category pages it links to, among the pages given.

    Two hops as joins: page to links, links to pages. At most categories category pages and most products for each front page.
    """
    from pyspark.sql import Window

    found = links(pages)
    first = found.where("class = 'product'").select("page_id", F.lit(0).alias("hop"), "pos", "url")
    order = Window.partitionBy("page_id").orderBy("pos")
    visited = found.where("class = 'category'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= categories)
    targets = pages.select(F.col("page_id").alias("target"), strip_fragment(F.col("url")).alias("url"))
    second = visited.join(targets, "url").join(found.where("class = 'product'").select(F.col("page_id").alias("target"), F.col("pos").alias("p"), F.col("url").alias("u")), "target")
    both = first.unionByName(second.select("page_id", F.lit(1).alias("hop"), F.col("p").alias("pos"), F.col("u").alias("url")))
    once = both.groupBy("page_id", "url").agg(F.min(F.struct("hop", "pos")).alias("at"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("at", "url"))).where(F.col("n") <= most)
    return ranked.select("page_id", "url")
