"""More named queries: finders, change operators, scalar library, file sources and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import numbers, text, urls
from cataloom.operators import classify, events, health, lookups, mutations, prices, search
from cataloom.plans.queries import E_END, EVENT, ROUND1, query
from cataloom.session import scratch_path, table
from cataloom.sources import files, fixtures, html
from cataloom.sources.fixtures import EVENTS_AS_OF
from cataloom.streaming import events as stream_events
from cataloom.streaming import state

_WORDS = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 0)"


def _say(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# -- finders


@query("SELECT l_partkey AS product_id FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1) WHERE (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1) = 1")
def product_by_url(spark, d):
    listed = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), _say("https://s.test/", F.col("l_orderkey"), "/", F.col("l_linenumber")).alias("product_url"))
    return lookups.by_price_url(listed, "https://s.test/7/1")


def _sellers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    named = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # a dimension of 25 rows
    cats = F.when(k % 3 == 0, F.array(F.lit("TV"), F.lit("AC"))).when(k % 3 == 1, F.array(F.lit("AC"))).otherwise(F.array().cast("array<string>"))
    return named.select(k.alias("id"), cats.alias("categories"), F.col("n_name").alias("city"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("verified"))


@query("""WITH s AS (SELECT s_suppkey AS k, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 'verified' AS asked, k AS id FROM s WHERE k % 4 = 0 UNION ALL SELECT 'category', k FROM s WHERE k % 3 <= 1 UNION ALL SELECT 'city', k FROM s WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation) UNION ALL SELECT 'all', k FROM s""")
def seller_directory(spark, d):
    sellers = _sellers(spark, d)
    city = table(spark, d, "nation").agg(F.min("n_name")).first()[0].upper()
    asked = [("verified", lookups.sellers(sellers, "tv", city, True)), ("category", lookups.sellers(sellers, "ac", city)), ("city", lookups.sellers(sellers, None, city)), ("all", lookups.sellers(sellers))]
    found = None
    for name, rows in asked:
        part = rows.select(F.lit(name).alias("asked"), "id")
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT s_suppkey AS product_id, s_suppkey % 3 <> 0 AS missing FROM supplier")
def wishlist(spark, d):
    k = F.col("s_suppkey")
    items = table(spark, d, "supplier").select(k.alias("product_id"))
    there = table(spark, d, "supplier").where(k % 3 == 0).select(k.alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("name"))
    return lookups.wishlist(items, there).select("product_id", "missing")


@query("SELECT c_custkey AS user_id, p_partkey AS product_id, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE p_retailprice END AS price_at_add FROM customer JOIN part ON p_partkey = c_custkey % 50 + 1")
def wishlist_added(spark, d):
    k = F.col("c_custkey")
    wanted = table(spark, d, "customer").select(k.alias("user_id"), (k % 50 + 1).alias("product_id"))
    held = wanted.where(F.col("user_id") % 2 == 0).withColumn("price_at_add", F.lit(1.0))
    return mutations.wishlist_add(held, wanted, fixtures.product(spark, d))


@query("SELECT 's' || s_suppkey AS slug, s_name AS name, CASE WHEN s_suppkey = 3 THEN 'generic' ELSE 'site-specific' END AS kind FROM supplier")
def site_kinds(spark, d):
    k = F.col("s_suppkey")
    found = lookups.site_kinds(table(spark, d, "supplier").select(F.when(k == 3, "generic").otherwise(_say("s", k)).alias("slug"), F.col("s_name").alias("name")))
    return found.withColumn("slug", F.when(F.col("slug") == "generic", "s3").otherwise(F.col("slug")))


@query("SELECT 's' || s_suppkey AS slug, s_name AS name, 'active' AS status, NULL::VARCHAR AS last_error FROM supplier")
def shop_console(spark, d):
    shops = table(spark, d, "supplier").select(_say("s", F.col("s_suppkey")).alias("slug"), F.col("s_name").alias("name"), F.lit("active").alias("status"))
    return lookups.shop_console(shops).select("slug", "name", "status", "last_error")


@query("SELECT count(*) AS checks, count(*) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0) AS failed, max(o_orderkey % 97) AS slowest_ms, false AS ok FROM orders")
def canary_summary(spark, d):
    k = F.col("o_orderkey")
    checks = table(spark, d, "orders").select(F.lit("q").alias("query"), (k % 5).alias("total"), (k % 97).alias("latency_ms"), F.when(k % 3 == 0, "timeout").alias("error"))
    return lookups.canary_summary(checks)


@query("SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM orders) AS reviews, (SELECT count(*) FROM lineitem) AS history")
def catalog_totals(spark, d):
    return lookups.catalog_totals(table(spark, d, "part"), table(spark, d, "orders"), table(spark, d, "lineitem"))


@query("SELECT o_orderkey AS id, o_orderdate AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def newest_entries(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return lookups.newest(rows, "at", "id", 1000, 200)


@query("SELECT 's' || s_suppkey AS slug FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0")
def shops_to_retry(spark, d):
    k = F.col("s_suppkey")
    shops = table(spark, d, "supplier").select(_say("s", k).alias("slug"), F.when(k % 3 == 0, True).alias("needs_retry"), F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "active").alias("status"))
    return health.to_retry(shops).select("slug")


# -- changes


@query("SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'https://new' ELSE 'https://old' END || s_suppkey AS base_url, CASE WHEN s_suppkey % 3 = 0 THEN 'blocked' ELSE 'active' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 4.0::DOUBLE END AS consecutive_failures FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0")
def seeded_shops(spark, d):
    k = F.col("s_suppkey")
    shops = table(spark, d, "supplier").where(k % 3 == 0).select(_say("s", k).alias("slug"), _say("https://old", k).alias("base_url"), F.lit("blocked").alias("status"), F.lit(4.0).alias("consecutive_failures"))
    catalog = table(spark, d, "supplier").where(k % 2 == 0).select(_say("s", k).alias("slug"), _say("https://new", k).alias("base_url"))
    return mutations.seed(shops, catalog, ["base_url"])


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'named' WHEN 1 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'filed' ELSE p_type END AS category FROM part")
def patched_products(spark, d):
    i = F.col("id")
    products = fixtures.product(spark, d).select("id", "name", "category")
    change = products.where(i % 4 != 3).select("id", F.when(i % 4 == 0, "named").alias("name"), (i % 4 <= 1).alias("has_name"), F.lit("filed").alias("category"), (i % 4 == 0).alias("has_category"))
    return mutations.patch(products, change, "id", ["name", "category"])


@query("SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'active' ELSE 'blocked' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 5 END AS consecutive_failures FROM supplier")
def shop_statuses(spark, d):
    shops = table(spark, d, "supplier").select(_say("s", F.col("s_suppkey")).alias("slug"), F.lit("blocked").alias("status"), F.lit(5).alias("consecutive_failures"))
    named = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(_say("s", F.col("s_suppkey")).alias("slug"))
    return mutations.set_status(shops, named, "active")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 400 WHEN c_custkey <= 40 AND c_custkey % 4 = 0 THEN 409 WHEN c_custkey <= 40 AND c_custkey % 4 = 1 THEN 409 ELSE 202 END AS code FROM customer""")
def shop_submissions(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 7 == 0, " x ").otherwise(F.col("c_name")).alias("name"), F.when(k % 5 == 0, "not-a-url").otherwise(_say("https://Shop", k, ".test/")).alias("base_url"))
    few = table(spark, d, "customer").where("c_custkey <= 40")
    shops = few.where(k % 4 == 0).select(_say("HTTPS://shop", k, ".TEST").alias("base_url"))
    pending = few.where(k % 4 == 1).select(_say("https://Shop", k, ".test").alias("base_url"))
    return mutations.shop_submissions(rows, shops, pending).select("id", "code")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 6 = 1 THEN 400 WHEN c_custkey % 6 = 2 THEN 409 ELSE 202 END AS code FROM customer")
def seller_submissions(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 6 == 1, "ftp://x").when(k % 6 == 3, "facebook.com/shop").when(k % 6 == 4, "instagram.com/shop").otherwise("https://x")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 6 == 0, "x").otherwise(F.col("c_name")).alias("name"), _say("s", k).alias("slug"), url.alias("url"))
    sellers = table(spark, d, "customer").where(k % 6 == 2).select(_say("s", k).alias("slug"))
    return mutations.seller_submissions(rows, sellers).select("id", "code")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'conflict' ELSE 'approved' END AS status FROM supplier")
def approved_shops(spark, d):
    k = F.col("s_suppkey")
    pending = table(spark, d, "supplier").select(k.alias("id"), _say("s", k).alias("slug"))
    return mutations.approve(pending, pending.where("id % 4 = 0").select("slug")).select("id", "status")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 409 ELSE 200 END AS code, CASE WHEN s_suppkey % 4 = 0 THEN 'pending' WHEN s_suppkey % 4 = 1 THEN 'rejected' ELSE 'approved' END AS status, CASE WHEN s_suppkey % 4 = 1 THEN 'spam' END AS review_note FROM supplier""")
def reviewed_shops(spark, d):
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    pending = table(spark, d, "supplier").select(k.alias("id"), _say("Shop ", k).alias("name"), F.lit("https://x").alias("base_url"), none.alias("sitemap_url"), none.alias("platform"), F.lit(None).cast("array<string>").alias("categories"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), none.alias("review_note"))
    shops = table(spark, d, "supplier").where(k % 4 == 0).select(_say("shop-", k).alias("slug"), F.lit("active").alias("status"))
    decisions = pending.select("id", (F.col("id") % 4 != 1).alias("approve"), F.lit("spam").alias("note"))
    after, _, codes = mutations.review(pending, shops, decisions, EVENTS_AS_OF)
    return after.join(codes, "id").select("id", "code", "status", "review_note")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS inserted, count(*) FILTER (o_orderstatus = 'P') AS merged, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus <> 'F') AS extracted FROM orders")
def run_summary(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "O", "inserted").when(F.col("o_orderstatus") == "P", "merged").otherwise("failed")
    return mutations.run_summary(table(spark, d, "orders").select(outcome.alias("outcome")))


# -- scalar library


@query(f"""WITH w AS (SELECT p_partkey, p_name, p_type, lower(p_name) AS l, {_WORDS("p_name || ' the best x ' || p_type")} AS w FROM part), s AS (SELECT *, list_distinct(list_filter(w, lambda t: length(t) >= 2)) AS ws FROM w)
SELECT p_partkey AS id, array_to_string(list_sort(ws), ',') AS words, array_to_string(list_sort(list_filter(ws, lambda t: length(t) >= 3 AND t NOT IN ('the', 'best', 'new'))), ',') AS significant, list_contains({_WORDS("p_name")}, 'bolt') AS has_word,
contains(l, 'red') AND contains(l, 'bolt') AS has_all, l AS cache_key, CASE WHEN length(p_name) < length(p_type) THEN p_type ELSE p_name END AS better, CASE WHEN p_partkey % 2 = 0 THEN 'a|b c' END AS listed FROM s""")
def text_library(spark, d):
    n, kind, k = F.col("p_name"), F.col("p_type"), F.col("p_partkey")
    words = text.word_set(_say(n, " the best x ", kind))
    tokens = F.array(F.lit("red"), F.lit("bolt"))
    return table(spark, d, "part").select(
        k.alias("id"), F.array_join(F.array_sort(words), ",").alias("words"), F.array_join(F.array_sort(text.significant(words)), ",").alias("significant"), text.contains_word(n, F.lit("Bolt")).alias("has_word"),
        text.has_all_tokens(n, tokens).alias("has_all"), text.cache_key(_say("  ", F.replace(n, F.lit(" "), F.lit("  ")))).alias("cache_key"), text.better_name(n, kind).alias("better"),
        F.array_join(text.string_list(F.when(k % 2 == 0, " a , b c,, ")), "|").alias("listed"),
    )


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, floor(l_extendedprice)::DOUBLE AS e, floor(l_extendedprice * (1 - l_discount))::DOUBLE AS c, l_tax AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(e, q)::DOUBLE AS largest, e + 0.25 AS csv, {ROUND1("CASE WHEN q <= 5 THEN q ELSE q / 20.0::DOUBLE END")} AS stars, CASE WHEN e > c THEN {ROUND1("(e - c) / e * 100.0")} END AS off,
round(CASE WHEN c BETWEEN 100 AND 50000 THEN greatest(0.4::DOUBLE, 1 - abs(ln(c) - ln(sqrt(100.0::DOUBLE * 50000.0))) / 5.0) ELSE 0 END, 6) AS sure FROM p""")
def number_library(spark, d):
    q, e, c = F.col("l_quantity").cast("long"), F.floor("l_extendedprice").cast("double"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double")
    whole = lambda x: x.cast("long").cast("string")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.largest_price(_say("TK ", q, " now ", whole(e))).alias("largest"), numbers.csv_price(_say("TK ", whole(e), ".25/=")).alias("csv"),
        numbers.rating(_say("Rated ", q, " of all")).alias("stars"), numbers.discount_percent(e, c).alias("off"), F.round(numbers.price_confidence(c, F.lit(100.0), F.lit(50000.0)), 6).alias("sure"),
    )


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE '9.9.9.9' END AS ip, CASE WHEN event_id % 2 = 0 THEN 'a' || user_id ELSE 'ip:x' END AS actor FROM events")
def visitors(spark, d):
    k, user = F.col("event_id"), F.col("user_id")
    ip = urls.client_ip(F.when(k % 3 == 0, _say(" 10.0.0.", user, " , 8.8.8.8")).when(k % 3 == 1, ""), F.lit("9.9.9.9"))
    return table(spark, d, "events").select(k.alias("id"), ip.alias("ip"), events.actor(F.when(k % 2 == 0, _say("a", user)), F.lit("x")).alias("actor"))


@query(r"""SELECT p_partkey AS id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name || '-X' || p_size), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: length(t) >= 2 AND regexp_matches(t, '^[a-z0-9]*[0-9]+[a-z0-9]*$')), ',') AS tokens,
CASE p_partkey % 3 WHEN 0 THEN 'TV' WHEN 1 THEN 'AC' ELSE 'GENERAL' END AS first, p_partkey % 3 = 0 AS tv, p_partkey % 3 <> 2 AS any_cooling FROM part""")
def intent_helpers(spark, d):
    k = F.col("p_partkey")
    cats = F.when(k % 3 == 0, F.array(F.lit("TV"), F.lit("AC"))).when(k % 3 == 1, F.array(F.lit("AC"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(
        k.alias("id"), F.array_join(classify.model_tokens(text.normalise_query(_say(F.col("p_name"), "-X", F.col("p_size")))), ",").alias("tokens"),
        classify.primary_category(cats).alias("first"), classify.has_category(cats, "TV").alias("tv"), classify.has_any_category(cats, ["AC", "REFRIGERATOR"]).alias("any_cooling"),
    )


@query("SELECT query, sites, detected_category, categories, brands, confidence, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'walton') AND contains(lower(p_name), 'tv')) AS total_results FROM (VALUES ('walton tv', '', 'TVs', 'TVs', 'walton', 0.6::DOUBLE)) AS t(query, sites, detected_category, categories, brands, confidence)")
def search_intent(spark, d):
    from cataloom.functions import dictionaries

    found = search.search(fixtures.product(spark, d), "walton tv")
    got = search.response(found, fixtures.site_price(spark, d), "walton tv", dictionaries.keyword_dim(spark), dictionaries.brand_dim(spark), dictionaries.category_dim(spark))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return got.select("query", listed("sites"), "detected_category", listed("categories"), listed("brands"), "confidence", "total_results")


# -- pages and files


@query("""WITH a AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*') AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
l AS (SELECT page_id, base, unnest(hrefs) AS href, unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM a)
SELECT page_id, CAST(pos AS INT) AS pos, base || replace(split_part(href, '#', 1), '&amp;', '&') AS url FROM l WHERE href[1] = '/' AND href[2] <> '/'""")
def page_anchors(spark, d):
    """The links to pages of the page's own shop that are written from its root, which is all of them in these pages."""
    return html.links(fixtures.page(spark, d)).select("page_id", "pos", "url")


@query("SELECT DISTINCT 'shop' || s_suppkey || '.test' AS host FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def discovered_shops(spark, d):
    k = F.col("s_suppkey")
    anchors = _say('<a href="https://www.shop', k, '.test/x">s</a><a href="https://facebook.com/', k, '">f</a><a href="/local">l</a><a href="mailto:a@b">m</a>')
    pages = table(spark, d, "supplier").select(k.alias("page_id"), F.lit("https://directory.test/list").alias("url"), anchors.alias("html"))
    known = table(spark, d, "supplier").where(k % 3 == 0).select(_say("https://shop", k, ".test/").alias("base_url"))
    pending = table(spark, d, "supplier").where(k % 5 == 0).select(_say("https://www.shop", k, ".test").alias("base_url"))
    return html.discover(pages, known, pending)


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '/(p|item|product)/[^/?#]+') OR page_id % 2 = 0")
def sitemap_products(spark, d):
    page = F.when(F.col("page_id") % 2 == 0, _say("https://a.test/product/x%20", F.col("page_id"))).when(F.col("page_id") % 4 == 1, _say("https://a.test/product/tag/", F.col("page_id"))).otherwise(F.col("url"))
    return fixtures.page(spark, d).where(urls.is_sitemap_product(page)).select("page_id")


@query("SELECT CAST(s_suppkey AS INT) AS pos, 'https://x.test/product/' || s_suppkey AS url FROM supplier WHERE s_suppkey < 1500")
def sitemap_walk(spark, d):
    n = table(spark, d, "supplier").count()
    page = lambda i: f"<url><loc> https://x.test/product/{i} </loc></url>"
    half = n // 2
    maps = {"root": "<sitemapindex><sitemap><loc>one</loc></sitemap><sitemap><loc>two</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>", "one": f"<urlset>{''.join(map(page, range(half)))}</urlset>", "two": f"<urlset>{''.join(map(page, range(half, n)))}<url><loc>https://x.test/blog/1</loc></url></urlset>"}
    return files.crawl_sitemap("root", maps.get, spark)


@query("SELECT CAST(p_partkey + 1 AS INT) AS line, p_name AS name, CAST(p_size AS VARCHAR) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'say \"hi\", ok' ELSE 'plain' END AS description FROM part WHERE p_partkey < 500")
def uploaded_lines(spark, d):
    k = F.col("p_partkey")
    line = _say(F.col("p_name"), ",", F.col("p_size"), ",", F.when(k % 2 == 0, '"say ""hi"", ok"').otherwise("plain"))
    path = scratch_path(spark, "upload")
    rows = table(spark, d, "part").select(k, line.alias("value")).orderBy("p_partkey").limit(600)
    spark.createDataFrame([(-1, "Name,PRICE,Description")], "p_partkey long, value string").unionByName(rows).coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(path)
    return files.inventory(spark, path).select("line", "name", "price", "description")


@query("SELECT 's' || s_suppkey AS slug, s_name AS name, s_suppkey % 2 = 0 AS requiresJs FROM supplier")
def shop_catalog(spark, d):
    k = F.col("s_suppkey")
    shop = F.struct(_say("s", k).alias("slug"), F.col("s_name").alias("name"), F.when(k % 2 == 0, True).alias("requiresJs"))
    path = scratch_path(spark, "shops")
    listed = table(spark, d, "supplier").agg(F.to_json(F.sort_array(F.collect_list(shop))).alias("value"))  # a catalog of some dozens of shops
    listed.write.text(path)
    return files.shop_catalog(spark, path).select("slug", "name", "requiresJs")


@query("SELECT strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)), (VALUES (DATE '2001-11-04'), (DATE '2001-11-05')) AS d(day)")
def history_by_day(spark, d):
    """Two days' snapshots of all prices, appended to a table by day."""
    path = scratch_path(spark, "history")
    for day in ("2001-11-04 04:00:00", "2001-11-05 04:00:00"):
        files.append_by_day(prices.snapshot(fixtures.site_price(spark, d), day), path, "recorded_at")
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


# -- streams


def _streamed(spark: SparkSession, source: DataFrame, run, name: str) -> DataFrame:
    """What a stream makes of source's rows, through files on both sides."""
    into, out = scratch_path(spark, f"{name}-in"), scratch_path(spark, name)
    source.write.parquet(into)
    stream = run(spark.readStream.schema(source.schema).parquet(into))
    query_ = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-log")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT event_id AS id, event_type AS type FROM events WHERE event_type IN ('view', 'click')")
def accepted_stream(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit(" Q ").alias("query"), F.lit("p").alias("product_id"), F.lit(None).cast("string").alias("seller_slug"),
        F.lit("a").alias("anon_id"), F.lit(None).cast("string").alias("user_id"), F.lit("1.1.1.1").alias("ip"),
    )
    return _streamed(spark, raw, lambda s: stream_events.accepted(s).select("id", "type"), "accepted")


@query("""WITH r AS (SELECT o_custkey AS shop_id, o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS ok FROM orders),
i AS (SELECT *, sum(ok) OVER (PARTITION BY shop_id ORDER BY run_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s7, sum(ok) OVER (PARTITION BY shop_id ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS isl FROM r),
f AS (SELECT *, CASE WHEN ok = 1 THEN 0 ELSE row_number() OVER (PARTITION BY shop_id, isl ORDER BY run_id) - CASE WHEN isl > 0 THEN 1 ELSE 0 END END AS cf FROM i)
SELECT shop_id, run_id, CASE WHEN s7 >= 4 THEN 'active' WHEN s7 >= 1 THEN 'degraded' ELSE 'dormant' END AS health, CAST(cf AS INT) AS failures, CASE WHEN bool_or(cf >= 3) OVER (PARTITION BY shop_id ORDER BY run_id ROWS UNBOUNDED PRECEDING) THEN 'blocked' ELSE 'active' END AS status FROM f""")
def health_stream(spark, d):
    runs = fixtures.shop_run(spark, d).select("shop_id", "run_id", "ok").coalesce(1)  # one file, so that each shop's runs come in one batch
    return _streamed(spark, runs, state.health_stream, "health")


@query(f"SELECT type, count(*) AS n FROM ({EVENT}) WHERE ts >= {E_END} - INTERVAL 1 DAY AND ts < {E_END} GROUP BY 1")
def rolling_day(spark, d):
    """Rolling counts of the day that ends with the events, as a watermarked window of a day."""
    found = stream_events.rolling_counts(fixtures.event(spark, d), "1 day", "1 day")
    return found.where(F.col("end") == F.lit(EVENTS_AS_OF).cast("timestamp")).select("type", "n")
