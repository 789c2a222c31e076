"""Merges, uploads, offers, reviews of submissions, runs, jobs, caches and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cataloom.functions import dictionaries, minhash, text
from cataloom.operators import classify, lifecycle, lookups, mutations, search
from cataloom.sources import html
from cataloom.streaming import events as stream_events

D = dt.datetime


def rows(df):
    return [tuple(r) for r in df.collect()]


PRODUCT = "id long, name string, category string, image_url string, description string, lowest_price double, highest_price double"


def test_merge(spark):
    products = spark.createDataFrame([(1, "a", None, None, "d", 9.0, 9.0), (2, "b", "tv", "i2", "e", 5.0, 5.0), (3, "c", "ac", "i3", None, 7.0, 7.0), (4, "d", None, None, None, None, None)], PRODUCT)
    prices = spark.createDataFrame([(1, "u", 9.0), (2, "u", 5.0), (2, "v", None), (2, None, 6.0), (3, "w", 7.0), (3, "v", 8.0), (3, "w", 7.5)], "product_id long, product_url string, price double")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 4), (None, 1), (4, 9), (9, 4)], "from_id long, to_id long")
    assert sorted(rows(mutations.merge_codes(products, pairs)), key=repr) == sorted([(2, 1, 200), (3, 1, 200), (4, 4, 400), (None, 1, 400), (4, 9, 404), (9, 4, 404)], key=repr)
    left, after = mutations.merge_catalog(products, prices, pairs)
    assert sorted(rows(left)) == [(1, "a", "tv", "i2", "d", 6.0, 9.0), (4, "d", None, None, None, None, None)]
    assert sorted(rows(after), key=repr) == sorted([(1, "u", 9.0), (1, "v", None), (1, None, 6.0), (1, "w", 7.0)], key=repr)
    chain = spark.createDataFrame([(1, 2), (2, 3)], "from_id long, to_id long")
    assert sorted(rows(mutations.merge_codes(products, chain))) == [(1, 2, 409), (2, 3, 200)]
    left, after = mutations.merge_catalog(products, prices, pairs.limit(0))
    assert sorted(rows(left)) == sorted(rows(products)) and after.count() == prices.count()


def test_upload(spark):
    products = spark.createDataFrame([(1, "a", "a", None, None, None, 50.0), (2, "b", "b", None, None, None, None)], "id long, name string, slug string, category string, image_url string, description string, lowest_price double")
    prices = spark.createDataFrame([(1, "fb", "u1", 50.0, True), (1, "x", "u1", 60.0, True), (2, "x", "u2", None, None)], "product_id long, site_slug string, product_url string, price double, in_stock boolean")
    sellers = spark.createDataFrame([("fb", "home")], "slug string, url string")
    cells = spark.createDataFrame(
        [(1, "New TV", "TK 100", "p.png", "u1", "tv", "x", "false"), (2, "Other", "70", None, "u2", None, None, None), (3, "Mine", "30", " ", None, " ", None, None), (4, "Mine 2", "20", None, None, None, None, None), (5, "x", "99", None, "u9", None, None, None), (6, "Low", "9", None, "u9", None, None, None), (7, "Bad", "n/a", None, "u9", None, None, None)],
        "line int, name string, price string, image_url string, product_url string, category string, description string, in_stock string",
    )
    after, listed, counts = mutations.inventory_load(products, prices, sellers, "fb", cells)
    assert sorted(rows(after.select("id", "name", "slug", "category", "image_url", "lowest_price"))) == [("1", "a", "a", None, None, 50.0), ("2", "b", "b", None, None, None if False else 70.0), ("new:home", "Mine", "fb-mine", None, None, 20.0)]
    assert sorted(rows(listed.where("site_slug = 'fb'"))) == [("1", "fb", "u1", 100.0, False), ("2", "fb", "u2", 70.0, True), ("new:home", "fb", "home", 20.0, True)]
    assert listed.count() == 5 and rows(counts) == [(1, 3, 3)]
    with pytest.raises(LookupError):
        mutations.inventory_load(products, prices, sellers, "nobody", cells)


def test_load_offers(spark):
    products = spark.createDataFrame([(1, "Phone", "phone", "smartphones", ["x"], None), (2, "Pan", "pan", "kitchen", [], "i")], "id long, name string, slug string, category string, brands array<string>, image_url string")
    prices = spark.createDataFrame([(1, "a", "u1", 100.0), (1, "b", "u3", 90.0), (2, "a", "u2", 50.0)], "product_id long, site_slug string, product_url string, price double")
    offers = [("1", "url", "a", "u1", "Phone 12 Pro", 95.0, "p"), ("2", "name", "b", "v2", "Pan", 45.0, "q"), ("new:tv", "new", "a", "v3", "Big TV", 900.0, None), ("new:tv", "new", "b", "v4", "Big TV 4k", 910.0, "t"), ("2", "name", "c", "v9", "Pan", 9.0, None), ("1", "name", "c", "v8", "x" * 201, 80.0, None)]
    resolved = spark.createDataFrame(offers, "product_id string, how string, shop_id string, url string, name string, price double, image_url string")
    intents = spark.createDataFrame([("Big TV", "tvs", ["lg"])], "name string, category string, brands array<string>")
    after, listed = mutations.load_offers(products, prices, resolved, intents)
    assert sorted(rows(after)) == [("1", "Phone 12 Pro", "phone", "smartphones", ["x"], "p"), ("2", "Pan", "pan", "kitchen", [], "i"), ("new:tv", "Big TV 4k", "big-tv", "tvs", ["lg"], "t")]
    assert sorted(rows(listed)) == [("1", "a", "u1", 95.0), ("1", "b", "u3", 90.0), ("1", "c", "v8", 80.0), ("2", "a", "u2", 50.0), ("2", "b", "v2", 45.0), ("new:tv", "a", "v3", 900.0), ("new:tv", "b", "v4", 910.0)]


def test_reviews(spark):
    pending = spark.createDataFrame([(1, "New Shop", "https://n", None, "custom", None, "pending", None, None), (2, "New shop", "https://m", None, None, ["tv"], "pending", None, None), (3, "Old", "https://o", None, None, None, "pending", None, None)], "id int, name string, base_url string, sitemap_url string, platform string, categories array<string>, status string, reviewed_at timestamp_ntz, review_note string")
    shops = spark.createDataFrame([("old", "Old", "active")], "slug string, name string, status string")
    decisions = spark.createDataFrame([(1, True, None), (2, True, None), (3, True, None), (9, False, "x")], "id int, approve boolean, note string")
    after, found, codes = mutations.review(pending, shops, decisions, "2024-01-01 00:00:00")
    assert sorted(rows(codes)) == [(1, 200), (2, 409), (3, 409), (9, 404)]
    assert {r.id: r.status for r in after.collect()} == {1: "approved", 2: "pending", 3: "pending"} and found.count() == 2
    after, found, _ = mutations.review(pending, shops, spark.createDataFrame([(2, False, "spam")], "id int, approve boolean, note string"), "2024-01-01 00:00:00")
    assert {(r.status, r.review_note) for r in after.where("id = 2").collect()} == {("rejected", "spam")} and found.count() == 1
    assert [r.code for r in mutations.add_saved_searches(spark.createDataFrame([("u", " a ", None), (None, "tv", None), ("u", " tv ", "e"), ("u", None, None)], "user_id string, query string, email string")).collect()] == [400, 401, 200, 400]


def test_wishlist(spark):
    products = spark.createDataFrame([(1, None, 5.0), (2, "b", None)], "id long, name string, lowest_price double")
    items = spark.createDataFrame([("u", 1, 4.0), ("u", 9, 3.0)], "user_id string, product_id long, price_at_add double")
    assert {r.product_id: r.missing for r in lookups.wishlist(items, products).collect()} == {1: False, 9: True}
    added = mutations.wishlist_add(items, spark.createDataFrame([("u", 1), ("u", 2), ("v", 1), ("v", 1)], "user_id string, product_id long"), products)
    assert sorted(rows(added), key=repr) == sorted([("u", 1, 4.0), ("u", 9, 3.0), ("u", 2, None), ("v", 1, 5.0)], key=repr)
    urls = spark.createDataFrame([(1, "u"), (2, "v"), (3, "v")], "product_id long, product_url string")
    assert rows(lookups.by_price_url(urls, "u")) == [(1,)] and lookups.by_price_url(urls, "v").count() == 0


def test_classifier(spark):
    assert sum(map(len, dictionaries.KEYWORDS.values())) == 305 and len(dictionaries.BRANDS) == 50
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(classify.model_tokens(F.lit("iphone 15 pro s24 x 8 wh1000xm5"))) == ["15", "s24", "wh1000xm5"]
    cats = F.array(F.lit("TV"), F.lit("AC"))
    assert one(classify.primary_category(cats)) == "TV" and one(classify.primary_category(F.array().cast("array<string>"))) == "GENERAL"
    assert one(classify.has_category(cats, "AC")) and not one(classify.has_category(cats, "BOOK")) and one(classify.has_any_category(cats, ["BOOK", "AC"])) and not one(classify.has_any_category(cats, ["BOOK"]))
    asked = spark.createDataFrame([(1, "a very long term here"), (2, "long term")], "query_id int, query string")
    keywords = spark.createDataFrame([("TV", "very long term"), ("AC", "term")], "category string, keyword string")
    brands = spark.createDataFrame([("long term here", "TV")], "brand string, category string")
    got = {(r.query_id, r.category): r.score for r in classify.scores(asked, keywords, brands, dictionaries.category_dim(spark)).collect()}
    assert got == {(1, "TV"): 4, (1, "AC"): 2, (2, "AC"): 2}
    assert rows(classify.brand_mentions(asked, brands)) == [(1, ["long term here"])]


def test_search_response(spark):
    products = spark.createDataFrame([(1, "Walton tv", 5.0), (2, "TV stand", 3.0), (3, "Nut", 2.0)], "id long, name string, lowest_price double")
    prices = spark.createDataFrame([(1, 9), (1, 4), (2, 7), (2, 4), (3, 1), (2, None)], "product_id long, site_id long")
    found = search.search(products, "walton TV")
    got = search.response(found, prices, "walton TV", dictionaries.keyword_dim(spark), dictionaries.brand_dim(spark), dictionaries.category_dim(spark)).first()
    assert (got.query, got.total_results, got.sites, got.detected_category, got.brands) == ("walton TV", 2, [4, 9, 7], "TVs", ["walton"])
    got = search.response(search.search(products, " "), prices, " ", dictionaries.keyword_dim(spark), dictionaries.brand_dim(spark), dictionaries.category_dim(spark)).first()
    assert (got.total_results, got.sites, got.detected_category, got.brands, got.confidence) == (0, [], "General", [], 0.0)
    assert [r.id for r in search.autocomplete(products, "tv", 0).collect()] == [1]


def test_stems(spark):
    words = {"bolts": "bolt", "boxes": "box", "batteries": "battery", "charging": "charg", "charged": "charg", "glass": "glass", "bus": "bus", "red": "red", "ring": "ring", "tv": "tv"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == words


def test_coefficients_are_javas(spark):
    random = spark._jvm.java.util.Random(0xC0FFEE)
    want = [((random.nextLong() & 0x7FFFFFFF) | 1, random.nextLong() & 0x7FFFFFFF) for _ in range(128)]
    assert minhash.coefficients(128) == want


def test_links_of_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.test/", '<a href="/product/x">x</a>')] * 3 + [(1, "https://b.test/", '<a href="https://a.test/product/y">y</a>')], "page_id long, url string, html string")
    assert html.links(pages).count() == 3


def test_runs(spark, tmp_path):
    shops = spark.createDataFrame([("a", "active", True), ("b", "blocked", True), ("c", None, True), ("d", "active", None)], "slug string, status string, needs_retry boolean")
    slugs = lambda mode, slug=None: sorted(r.slug for r in lifecycle.run_shops(shops, mode, slug).collect())
    assert (slugs("full"), slugs("retry"), slugs("single", "b"), slugs("single", "zz")) == (["a", "d"], ["a", "c"], ["b"], [])
    with pytest.raises(ValueError):
        lifecycle.run_shops(shops, "odd")
    guard, other = (lifecycle.RunGuard(spark, str(tmp_path / "lock")) for _ in range(2))
    assert guard.enter() and not other.enter()
    guard.leave()
    assert other.enter()
    record = lifecycle.run_record(spark.createDataFrame([], "urls long, inserted long, merged long, error string"), "single", "2024-01-01 00:00:00", "2024-01-01 00:00:01")
    assert rows(record) == [("single", 0, 0, 0, 0, 0, 0, 1)]
    assert lifecycle.append_record(record, str(tmp_path / "runs")) and lifecycle.append_record(record, str(tmp_path / "runs")) and spark.read.parquet(str(tmp_path / "runs")).count() == 2
    (tmp_path / "file").write_text("x")
    assert not lifecycle.append_record(record, str(tmp_path / "file" / "x"))
    outcomes = spark.createDataFrame([("inserted",), ("merged",), ("merged",), ("failed",)], "outcome string")
    assert rows(mutations.run_summary(outcomes)) == [(1, 2, 1, 3)]


def test_result_cache(spark):
    now = [0.0]
    cache = lifecycle.ResultCache(60, 2, lambda: now[0])
    ask = lambda key: cache.get(key, lambda: spark.range(3))
    assert len(ask("a")) == 3 and len(ask("a")) == 3
    now[0] = 60.0
    ask("a"), ask("b"), ask("c"), ask("a")
    with pytest.raises(ZeroDivisionError):
        cache.get("bad", lambda: 1 // 0)
    assert cache.stats() == {"size": 2, "hits": 1, "misses": 6, "hit_rate": 0.143, "requests": 7, "evictions": 2, "failures": 1}
    cache.flush()
    assert cache.stats()["size"] == 0


def test_upsert_batches(spark, tmp_path):
    sink = stream_events.upsert_batches(str(tmp_path / "t"), ["k"])
    batch = lambda *xs: spark.createDataFrame([(k, D(2024, 1, d), v) for k, d, v in xs], "k string, ts timestamp_ntz, v int")
    sink(batch(("a", 3, 1), ("a", 2, 2), ("b", 1, 3)), 0)
    sink(batch(("b", 5, 4), ("a", 1, 9)), 4)  # epochs were skipped, and an old row comes late
    sink(batch(("b", 5, 4), ("a", 1, 9)), 4)  # the same epoch again
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/v4")).collect()) == [("a", 1), ("b", 4)]
