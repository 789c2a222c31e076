"""Operators on small tables, nulls and ties included."""

import datetime as dt
import gzip
import time

import pytest
from pyspark.sql import functions as F

from cataloom.functions import dictionaries
from cataloom.operators import classify, events, graph, health, lookups, mutations, prices, ratelimit, resolve, search
from cataloom.sources import fetch, files
from cataloom.streaming import events as stream_events
from cataloom.streaming import state

D = dt.datetime


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hot_drops(spark):
    products = spark.createDataFrame([(1, "a", 100.0), (2, "b", 100.0), (3, "c", 100.0), (4, "d", None), (5, "e", 0.0)], "id long, name string, lowest_price double")
    at = D(2024, 1, 5)
    history = spark.createDataFrame([(1, 110.01, at), (2, 110.0, at), (3, 99.0, at), (4, 500.0, at), (5, 9.0, at), (2, 900.0, D(2023, 1, 1))], "product_id long, price double, recorded_at timestamp_ntz")
    assert [(r.id, r.drop_pct) for r in prices.hot_drops(history, products, "2024-01-06 00:00:00").collect()] == [(1, 9.1)]


def test_daily_series(spark):
    products = spark.createDataFrame([(1, "a", 5.0), (2, "b", 7.0)], "id long, name string, lowest_price double")
    history = spark.createDataFrame([(1, 9, 12.0, D(2024, 1, 2, 18)), (1, 8, 10.0, D(2024, 1, 2, 9)), (1, 8, 3.0, D(2023, 12, 1))], "product_id long, site_id long, price double, recorded_at timestamp_ntz")
    got = prices.daily_series(history, products, "2024-01-03 00:00:00", 3).orderBy("product_id", "day")
    assert [r.price for r in got.collect()] == [None, 10.0, 10.0, 7.0, 7.0, 7.0]
    assert prices.daily_series(history, products, "2024-01-03 00:00:00", 0).count() == 60 and prices.daily_series(history, products, "2024-01-03 00:00:00", 999).count() == 730


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 100.0, 4.25, None), (1, None, None, None), (1, 80.0, None, None), (2, None, None, 0)], "product_id long, price double, rating double, review_count int")
    assert sorted(rows(prices.product_aggregates(df))) == [(1, 80.0, 100.0, 4.3, None), (2, None, None, None, None)]


EVENT = "id long, type string, actor string, product_id long, shop_id long, query string, result_count int, latency_ms long, ts timestamp_ntz"


def test_event_statistics(spark):
    now = "2024-01-31 00:00:00"
    t = lambda s: D(2024, 1, 31) - dt.timedelta(seconds=s)
    df = spark.createDataFrame(
        [(i, "search", None if i == 3 else f"u{i % 2}", None, None, q, n, ms, t(s)) for i, (q, n, ms, s) in enumerate([("tv", 1, 10, 5), ("tv", 0, 20, 61), (None, 0, 30, 100), ("x", 0, 40, 100), ("ac", None, None, 86400), ("ac", 0, -1, 86399)])]
        + [(10, "view", "u1", 1, None, None, None, None, t(10)), (11, "click", "u1", 1, 7, None, None, None, t(10)), (12, "view", "u9", 2, None, None, None, None, t(10 * 86400))],
        EVENT,
    )
    assert rows(events.active_users(df, now, ["search", "view"])) == [(2, 3)]
    assert rows(events.live_counters(df, now)) == [(2, 1, 5, 1)]
    assert rows(events.trending(df, now)) == [("tv", 2, 1), ("ac", 1, 0)]
    assert rows(events.zero_results(df, now)) == [("ac", 1), ("tv", 1), ("x", 1)]
    assert rows(events.latency_percentiles(df, now, ["search"])) == [(4, 30, 40, 40)]
    assert rows(events.latency_percentiles(df.limit(0), now, ["search"])) == [(0, None, None, None)]
    listings = spark.createDataFrame([(1, 7), (1, 8), (1, 7)], "product_id long, site_id long")
    assert rows(events.shop_ctr(df, listings, now)) == [(7, 1, 1, 100.0), (8, 1, 0, 0.0)]
    assert rows(events.shop_ctr(df, listings, now, first_views=0)) == [(7, 0, 1, 0.0)]
    products = spark.createDataFrame([(2, "b")], "id long, name string")
    assert rows(events.top_products(df, products, now)) == [(1, 1, None)]
    assert rows(mutations.live(df, now, 7).select(F.count("*"))) == [(8,)]


@pytest.mark.parametrize(
    "oks, want",
    [([1], ("degraded", 0, False, False)), ([1, 1, 1, 1], ("active", 0, False, False)), ([0, 0, 0], ("dormant", 3, True, True)), ([0, 0, 1], ("degraded", 0, False, False)), ([1] * 5 + [0] * 7, ("dormant", 7, True, True))],
)
def test_shop_health(spark, oks, want):
    runs = spark.createDataFrame([(1, D(2024, 1, 1 + i), i, ok) for i, ok in enumerate(oks)], "shop_id long, at timestamp_ntz, run_id long, ok int")
    last = health.shop_health(runs).orderBy(F.desc("run_id")).first()
    assert (last.health, last.failures, last.needs_retry, last.blocked) == want
    shop = state.Health()
    for ok in oks:
        kind, failures, status = shop.run(ok)
    assert (kind, failures, status == "blocked") == (want[0], want[1], want[3])


def test_rate_limit(spark):
    def run(stream, capacity, per_second):
        df = spark.createDataFrame([(i, k, D(2024, 1, 1) + dt.timedelta(milliseconds=ms)) for i, (k, ms) in enumerate(stream)], "id long, actor string, ts timestamp_ntz")
        return [r.allowed for r in ratelimit.rate_limit(df, capacity, per_second).orderBy("id").collect()]

    assert run([("a", 0)] * 4, 3, 0.0001) == [True, True, True, False]
    assert run([("a", 0), ("b", 0), ("a", 0), ("b", 0)], 1, 0.0001) == [True, True, False, False]
    assert run([("a", 0), ("a", 0), ("a", 60)], 1, 50) == [True, False, True]
    for bad in ((0, 1.0), (1, 0.0)):
        with pytest.raises(ValueError):
            ratelimit.TokenBucket(*bad)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 600 + i) for i in range(300)] + [(7, 7), (None, 1)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(chain, "src long, dst long"))))
    assert {got[i] for i in range(101)} == {0} and {got[i] for i in range(600, 900)} == {500} and len(got) == 101 + 301
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def classified(spark, *queries):
    df = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = classify.classify(df, dictionaries.keyword_dim(spark), dictionaries.brand_dim(spark), dictionaries.category_dim(spark))
    return [(r.categories, r.confidence) for r in got.orderBy("query_id").collect()]


def test_classify(spark):
    got = classified(spark, "gaming laptop", "", "zzz", "Phone, PHONE!", "wh-1000", None)
    assert got[0] == (["LAPTOP"], 1.0)
    assert got[1:3] == [(["GENERAL"], 0.0)] * 2 and got[3] == (["SMARTPHONE"], 0.8) and got[4][0] == ["GENERAL"] and got[5] == (["GENERAL"], 0.0)


def test_trigrams(spark):
    asked = spark.createDataFrame([(1, "ipone")], "query_id int, query string")
    names = spark.createDataFrame([(5, "iphone"), (6, "IPHONE"), (7, "zzz")], "id long, name string")
    got = search.trigram_top(asked, names, 3).collect()
    assert [(r.id, r.score) for r in got] == [(5, 3 / 8)]


def test_search_and_validate(spark):
    products = spark.createDataFrame([(1, "Red bolt", 5.0), (2, "Bolt of red", None), (3, "Boltred", 1.0), (4, "Nut", 2.0)], "id long, name string, lowest_price double")
    assert [(r.id, r["pass"]) for r in search.search(products, "red BOLT").collect()] == [(3, 2), (1, 1), (2, 1)]
    assert search.search(products, " ").count() == search.search(products, "").count() == search.autocomplete(products, " ").count() == 0
    assert [r.id for r in search.search(products, "bolts").collect()] == [1, 2]  # by their stem
    assert [r.id for r in search.autocomplete(products, "bolt", 2).collect()] == [1, 2]
    results = spark.createDataFrame([(1, "Red bolt", 5.0, True), (1, "Red bolt case", 5.0, True), (1, "Nut", 5.0, True), (1, "Red bolt", None, True), (1, " ", 5.0, None), (1, "red bolt big", 5.0, False)], "query_id int, name string, price double, in_stock boolean")
    intents = spark.createDataFrame([(1, "red bolt", ["GENERAL"], [])], "query_id int, query string, categories array<string>, model_tokens array<string>")
    assert [r.name for r in search.validate(results, intents, dictionaries.category_dim(spark)).collect()] == ["Red bolt", "red bolt big"]
    assert [r.id for r in search.fuzzy_name_search(products, "rad").collect()] == [1, 2]


def test_resolve(spark):
    catalog = spark.createDataFrame([(1, "Acme Super Phone 12 Pro", "u1"), (2, "Other Washing Machine 7kg", "u2")], "id long, name string, url string")
    offers = spark.createDataFrame([(1, "u1", "whatever", 1.0), (1, "x1", "Acme Super Phone 12 Pro (128GB) Black", 2.0), (2, "x2", "Garden Chair Wooden Large", 3.0), (3, "x3", "Garden Chair Wooden Large Blue", 3.5), (4, "x3", "Garden Chair Wooden Large", 4.0)], "shop_id long, url string, name string, price double")
    got = {r.url: (r.product_id, r.how) for r in resolve.resolve(catalog, offers).collect()}
    assert got["u1"] == ("1", "url") and got["x1"] == ("1", "name") and got["x2"] == got["x3"] == ("new:garden chair wooden large", "new")


def test_lookups(spark):
    t = spark.createDataFrame([(1, "one", "Tv", "TV", ["TV"], "Dhaka", True), (2, "1", "Ac", "AC", ["AC", "TV"], "dhaka", None)], "id long, slug string, name string, category string, categories array<string>, city string, verified boolean")
    assert lookups.by_id_or_slug(t, "1").first().id == 1 and lookups.by_id_or_slug(t, "one").first().id == 1 and lookups.by_id_or_slug(t, " ").count() == 0
    assert [r.id for r in lookups.by_ids(t, [2, " ", 9, 1, 2]).collect()] == [2, 1, 2]
    assert lookups.sellers(t, "tv", "dhaka", True).count() == 1 and lookups.sellers(t, "tv").count() == 2 and lookups.sellers(t, city="DHAKA").count() == 2 and lookups.sellers(t).count() == 2
    assert rows(lookups.listing(t, "T", None, 0, 0).select("id", "total")) == [(1, 1)]


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, image string")
    assert sorted(rows(mutations.upsert(base, base.where("id = 2").withColumn("name", F.lit("c")), ["id"]))) == [(1, "a", "x"), (2, "c", None)]
    change = spark.createDataFrame([(1, None, True, "z", False)], "id long, name string, has_name boolean, image string, has_image boolean")
    assert sorted(rows(mutations.patch(base, change, "id", ["name", "image"])))[0] == (1, None, "x")
    shops = spark.createDataFrame([("a", "dormant", 4, "https://A.test/"), ("b", "blocked", 5, "https://b.test")], "slug string, status string, consecutive_failures int, base_url string")
    done = {r.slug: (r.status, r.consecutive_failures) for r in mutations.set_status(shops, shops.where("slug = 'b'"), "active").collect()}
    assert done == {"a": ("dormant", 4), "b": ("active", 0)}
    with pytest.raises(ValueError):
        mutations.set_status(shops, shops, "odd")
    pending = spark.createDataFrame([("https://p.test",)], "base_url string")
    asked = spark.createDataFrame([(None, "https://n.test"), ("Shop", "not-a-url"), ("Shop", "https://new.test/"), ("Shop", "https://p.test/"), ("Shop", "HTTPS://a.test")], "name string, base_url string")
    assert [r.code for r in mutations.shop_submissions(asked, shops, pending).orderBy("base_url").collect()].count(409) == 2
    codes = {r.base_url: r.code for r in mutations.shop_submissions(asked, shops, pending).collect()}
    assert codes == {"https://n.test": 400, "not-a-url": 400, "https://new.test/": 202, "https://p.test/": 409, "HTTPS://a.test": 409}
    prices_ = spark.createDataFrame([("u", "s", 9.0), ("v", "t", 5.0)], "product_url string, site_slug string, price double")
    cells = spark.createDataFrame([(1, "aa", "TK 20", "u"), (2, "aa", "30", "u"), (3, "x", "40", "w"), (4, "bb", "9", "w"), (5, "cc", "50", None)], "line int, name string, price string, product_url string")
    assert sorted(rows(mutations.inventory_upsert(prices_, cells, "s", "home"))) == [("home", "s", 50.0), ("u", "s", 30.0), ("v", "t", 5.0)]
    seeded = mutations.seed(shops, spark.createDataFrame([("a", "https://n"), ("c", "https://c")], "slug string, base_url string"), ["base_url"])
    assert {(r.slug, r.base_url, r.status) for r in seeded.collect()} == {("a", "https://n", "dormant"), ("b", "https://b.test", "blocked"), ("c", "https://c", "active")}


def test_sources(spark, tmp_path):
    (tmp_path / "shops.json").write_text('[{"slug":"a","name":"A","baseUrl":"https://a","platform":"custom","categories":["tv"]},{"slug":"b","requiresJs":true}]')
    assert [(r.slug, r.requiresJs) for r in files.shop_catalog(spark, str(tmp_path / "shops.json")).collect()] == [("a", False), ("b", True)]
    (tmp_path / "i.csv").write_text('Name,PRICE,productUrl\n"TV ""big"", 4k",100,u\nAC,5,\n')
    got = files.inventory(spark, str(tmp_path / "i.csv")).collect()
    assert [(r.line, r.name, r.price, r.product_url, r.image_url) for r in got] == [(1, 'TV "big", 4k', "100", "u", None), (2, "AC", "5", None, None)]
    maps = {
        "s": "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b.gz</loc></sitemap><sitemap><loc>s</loc></sitemap></sitemapindex>",
        "a": "<urlset><url><loc>https://x.test/product/1&amp;2</loc></url><url><loc>https://x.test/blog/1</loc></url></urlset>",
        "b.gz": gzip.compress(b"<urlset><url><loc>https://x.test/p/9</loc></url><url><loc>https://x.test/product/1&amp;2</loc></url></urlset>"),
    }
    assert [r.url for r in files.crawl_sitemap("s", maps.get, spark).collect()] == ["https://x.test/product/1&2", "https://x.test/p/9"]
    products = spark.createDataFrame([(1, " ", "n"), (2, "a&b", "n")], "id long, slug string, name string")
    lines = [r.line for r in files.sitemap_lines(products, "https://s", "2024-02-01").orderBy("pos").collect()]
    assert len(lines) == 6 and "    <loc>https://s/product/1</loc>\n" in lines[-2] and "    <loc>https://s/product/a&amp;b</loc>\n" in lines[-1]
    files.write_sitemap(products, "https://s/", "2024-02-01", str(tmp_path / "map"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "map").glob("*.txt")))
    assert written.startswith("<?xml") and written.endswith("</urlset>\n") and written.count("<priority>0.7</priority>") == 2
    (tmp_path / "large.csv").write_text("name,price\n" + "x,1\n" * 300_000)
    with pytest.raises(ValueError):
        files.inventory(spark, str(tmp_path / "large.csv"))
    calls = []

    def get(url, agent):
        calls.append(agent)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert fetch.fetch("u", get, sleep=lambda s: None) == "ok" and len(set(calls)) == 2
    assert fetch.fetch("u", lambda u, a: (_ for _ in ()).throw(OSError()), sleep=lambda s: None) is None


def test_streams(spark, tmp_path):
    raw = "type string, query string, result_count int, product_id string, seller_slug string, anon_id string, user_id string, latency_ms long, ip string, ts timestamp"
    t = D(2024, 1, 1, 10)
    data = [("search", "  IPhone ", 1, None, None, "a", None, 5, "1.1.1.1", t), ("search", " ", 0, None, None, None, None, None, None, t), ("view", None, None, " ", None, None, None, None, None, t), ("view", None, None, "p1", None, None, None, None, None, t), ("click", None, None, None, "s", None, None, None, None, t), ("click", None, None, None, " ", None, None, None, None, t)]
    spark.createDataFrame(data, raw).write.parquet(str(tmp_path / "in"))
    got = stream_events.accepted(spark.readStream.schema(raw).parquet(str(tmp_path / "in")))
    run = lambda df, name: df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
    assert run(got, "accepted")
    assert sorted((r.type, r.query) for r in spark.table("accepted").collect()) == [("click", None), ("search", "iphone"), ("view", None)]
    runs = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([0, 0, 0, -1, 0, 1])], "shop_id long, run_id long, ok int")
    runs.write.parquet(str(tmp_path / "runs"))
    assert run(state.health_stream(spark.readStream.schema(runs.schema).parquet(str(tmp_path / "runs"))), "health")
    assert [(r.run_id, r.failures, r.status) for r in spark.table("health").orderBy("run_id").collect()] == [(0, 1, "active"), (1, 2, "active"), (2, 3, "blocked"), (4, 1, "active"), (5, 0, "active")]
    ev = spark.createDataFrame([("k", i, t) for i in range(4)], "key string, id long, ts timestamp")
    ev.write.parquet(str(tmp_path / "ev"))
    # a stream with time-outs goes on for ever: stop it when its rows are there
    q = state.rate_limited(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), 3, 0.001).writeStream.format("memory").queryName("limited").start()
    for _ in range(120):
        if spark.table("limited").count() == 4:
            break
        time.sleep(0.5)
    q.stop()
    assert [r.allowed for r in spark.table("limited").orderBy("id").collect()] == [True, True, True, False]
    ev = ev.withColumn("type", F.lit("view")).withColumnRenamed("key", "actor")
    assert stream_events.rolling_counts(ev).agg(F.max("n")).first()[0] == 4


def test_console(spark):
    shops = spark.createDataFrame([("b", "B", "active"), ("generic", "G", None)], "slug string, name string, status string")
    got = lookups.shop_console(shops)
    assert got.columns == lookups.CONSOLE and [r.slug for r in got.collect()] == ["b", "generic"]
    assert [r.kind for r in lookups.site_kinds(shops).orderBy("slug").collect()] == ["site-specific", "generic"]
    checks = spark.createDataFrame([("tv", 3, 10, None), ("ac", 0, 30, None)], "query string, total int, latency_ms int, error string")
    assert rows(lookups.canary_summary(checks)) == [(2, 1, 30, False)] and rows(lookups.canary_summary(checks.limit(0))) == [(0, 0, None, False)]
    assert rows(lookups.catalog_totals(shops, checks, shops)) == [(2, 2, 2)]
    assert [r.query for r in lookups.newest(checks, "latency_ms", "query", 0, 9).collect()] == ["ac"]
