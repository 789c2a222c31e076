"""Named queries over the driver's tables, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions import dictionaries, minhash, numbers, text, urls
from cataloom.operators import classify, events, health, lifecycle, lookups, mutations, prices, ratelimit, resolve, search
from cataloom.session import table
from cataloom.sources import files, fixtures, html
from cataloom.sources.fixtures import EVENTS_AS_OF, PRICES_AS_OF
from cataloom.streaming import events as stream_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


P_END, E_END = f"TIMESTAMP '{PRICES_AS_OF}'", f"TIMESTAMP '{EVENTS_AS_OF}'"
ROUND1 = lambda x: f"floor(({x}) * 10 + 0.5) / 10"
HISTORY = "SELECT l_partkey AS product_id, l_suppkey AS site_id, l_extendedprice / l_quantity AS price, l_shipdate AS recorded_at, l_orderkey AS order_id, l_linenumber AS line FROM lineitem"
SITE_PRICE = """SELECT l_partkey AS product_id, l_suppkey AS site_id, l_extendedprice / l_quantity AS price, l_discount AS discount, l_tax * 50 AS rating, CAST(l_quantity AS INT) AS review_count,
 l_linestatus = 'O' AS in_stock, l_shipdate AS last_updated FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1"""
_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
EVENT = "SELECT event_id AS id, event_type AS type, user_id AS actor, k AS product_id, k % 10 AS shop_id, 'term ' || k AS query, k % 4 AS result_count, CAST(floor(value) AS BIGINT) AS latency_ms, ts FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


# -- prices


@query(f"""WITH h AS ({HISTORY}), p AS (SELECT product_id, max(price) AS peak FROM h WHERE recorded_at >= {P_END} - INTERVAL 7 DAY GROUP BY 1)
SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, peak, {ROUND1("(peak - p_retailprice) / peak * 100.0")} AS drop_pct
FROM part JOIN p ON p_partkey = product_id WHERE p_retailprice > 0 AND peak > p_retailprice AND peak >= p_retailprice * CAST(1.1 AS DOUBLE) ORDER BY drop_pct DESC, id LIMIT 24""")
def hot_drops(spark, d):
    return prices.hot_drops(fixtures.price_history(spark, d), fixtures.product(spark, d), PRICES_AS_OF)


@query(f"""WITH h AS ({HISTORY}), p AS (SELECT product_id, max(price) AS peak FROM h WHERE recorded_at >= {P_END} - INTERVAL 7 DAY GROUP BY 1)
SELECT coalesce(p_type, 'other') AS category, count(*) AS n FROM (SELECT p_type, {ROUND1("(peak - p_retailprice) / peak * 100.0")} AS drop_pct FROM part JOIN p ON p_partkey = product_id
WHERE p_retailprice > 0 AND peak > p_retailprice AND peak >= p_retailprice * CAST(1.1 AS DOUBLE) ORDER BY drop_pct DESC, p_partkey LIMIT 24) GROUP BY 1""")
def drop_categories(spark, d):
    drops = prices.hot_drops(fixtures.price_history(spark, d), fixtures.product(spark, d), PRICES_AS_OF)
    return prices.drop_categories(drops.join(fixtures.product(spark, d).select("id", "category"), "id"))


@query(f"""WITH h AS ({HISTORY}), days AS (SELECT CAST(unnest(generate_series(DATE '2001-10-07', DATE '2001-11-05', INTERVAL 1 DAY)) AS DATE) AS day),
v AS (SELECT product_id, CAST(recorded_at AS DATE) AS day, arg_min(price, row(recorded_at, site_id, order_id, line)) AS seen FROM h WHERE CAST(recorded_at AS DATE) BETWEEN DATE '2001-10-07' AND DATE '2001-11-05' GROUP BY 1, 2),
g AS (SELECT p_partkey AS product_id, p_retailprice, days.day, seen FROM part CROSS JOIN days LEFT JOIN v ON v.product_id = p_partkey AND v.day = days.day)
SELECT product_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN count(seen) OVER (PARTITION BY product_id) = 0 THEN p_retailprice ELSE last_value(seen IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY day ROWS UNBOUNDED PRECEDING) END AS price FROM g""")
def daily_price_series(spark, d):
    series = prices.daily_series(fixtures.price_history(spark, d), fixtures.product(spark, d), PRICES_AS_OF, 30)
    return series.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_AGG = f"""SELECT product_id, min(price) AS lowest_price, nullif(max(price), 0) AS highest_price, {ROUND1("CAST(sum(CAST(rating AS DECIMAL(18,6))) AS DOUBLE) / count(rating)")} AS average_rating, CAST(nullif(sum(review_count), 0) AS BIGINT) AS total_reviews FROM s GROUP BY 1"""


@query(f"WITH s AS ({SITE_PRICE}) {_AGG}")
def product_aggregates(spark, d):
    return prices.product_aggregates(fixtures.site_price(spark, d))


@query(f"WITH s AS ({SITE_PRICE}) SELECT product_id, count(*) AS seller_count, CASE WHEN count(discount) > 0 THEN greatest(0, max(discount)) END AS best_discount, coalesce(bool_or(in_stock), false) AS any_in_stock FROM s GROUP BY 1")
def offer_summary(spark, d):
    return prices.offer_summary(fixtures.site_price(spark, d))


COMPARED = [7, 3, 12, 5]


@query(f"""WITH s AS ({SITE_PRICE}), a AS ({_AGG}), o AS (SELECT product_id, count(*) AS n, greatest(0, max(discount)) AS bd, bool_or(in_stock) AS st FROM s GROUP BY 1),
w AS (SELECT CAST(c.pos AS INT) AS pos, p_partkey AS product_id, p_type, a.*, o.n, bd, st FROM (VALUES (7, 0), (3, 1), (12, 2), (5, 3)) AS c(id, pos) JOIN part ON p_partkey = c.id LEFT JOIN a ON a.product_id = c.id LEFT JOIN o ON o.product_id = c.id),
l AS (SELECT 'lowestPrice' AS attribute, pos, product_id, lowest_price AS number, NULL AS text, false AS up FROM w
UNION ALL SELECT 'highestPrice', pos, product_id, highest_price, NULL, false FROM w UNION ALL SELECT 'averageRating', pos, product_id, average_rating, NULL, true FROM w
UNION ALL SELECT 'totalReviews', pos, product_id, CAST(total_reviews AS DOUBLE), NULL, true FROM w UNION ALL SELECT 'sellerCount', pos, product_id, CAST(coalesce(n, 0) AS DOUBLE), NULL, true FROM w
UNION ALL SELECT 'category', pos, product_id, NULL, p_type, NULL FROM w UNION ALL SELECT 'savings', pos, product_id, greatest(0, highest_price - lowest_price), NULL, true FROM w
UNION ALL SELECT 'discount', pos, product_id, bd, NULL, true FROM w UNION ALL SELECT 'anyInStock', pos, product_id, CASE WHEN coalesce(st, false) THEN 1.0 ELSE 0.0 END, NULL, true FROM w)
SELECT attribute, pos, product_id, CAST(number AS DOUBLE) AS number, text, row_number() OVER (PARTITION BY attribute ORDER BY CASE WHEN up THEN -number ELSE number END NULLS LAST, pos) = 1 AND number IS NOT NULL AND up IS NOT NULL AS best FROM l""")
def compare_matrix(spark, d):
    return prices.compare_matrix(fixtures.product(spark, d), fixtures.site_price(spark, d), COMPARED)


@query(f"WITH s AS ({SITE_PRICE}) SELECT s_suppkey AS shop_id, s_name AS name, coalesce(n, 0) AS n_products, CASE WHEN n > 0 THEN 'active' ELSE 'dormant' END AS status FROM supplier LEFT JOIN (SELECT site_id, count(DISTINCT product_id) AS n FROM s GROUP BY 1) ON site_id = s_suppkey")
def site_dashboard(spark, d):
    return prices.site_dashboard(fixtures.site_price(spark, d), fixtures.shop(spark, d))


@query(f"WITH s AS ({SITE_PRICE}) SELECT product_id, site_id, price, 'BDT' AS currency, {P_END} AS recorded_at FROM s WHERE price IS NOT NULL")
def price_snapshot(spark, d):
    return prices.snapshot(fixtures.site_price(spark, d), PRICES_AS_OF)


@query(f"WITH h AS ({HISTORY}) SELECT * FROM h WHERE product_id = 17")
def price_series(spark, d):
    return prices.series(fixtures.price_history(spark, d), 17)


@query(f"WITH s AS ({SITE_PRICE}), m AS (SELECT CASE WHEN product_id % 10 = 3 THEN product_id - 1 ELSE product_id END AS product_id, site_id, price, product_id % 10 = 3 AS side FROM s), k AS (SELECT product_id, site_id, arg_min(price, row(side, price)) AS price FROM m GROUP BY 1, 2) SELECT *, min(price) OVER (PARTITION BY product_id) AS lowest_price, max(price) OVER (PARTITION BY product_id) AS highest_price FROM k")
def merge_products(spark, d):
    pairs = fixtures.product(spark, d).where("id % 10 = 3").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("to_id"))
    return mutations.merge_products(fixtures.site_price(spark, d), pairs)


# -- events


@query(f"WITH e AS ({EVENT}), u AS (SELECT actor, max(ts) AS ts FROM e WHERE type IN ('view', 'click') AND ts > {E_END} - INTERVAL 30 DAY AND actor IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (ts > {E_END} - INTERVAL 1 DAY) AS dau, count(*) AS mau FROM u")
def active_users(spark, d):
    return events.active_users(fixtures.event(spark, d), EVENTS_AS_OF, ["view", "click"])


@query(f"""WITH e AS (SELECT * FROM ({EVENT}) WHERE ts > {E_END} - INTERVAL 1 DAY AND type IN ('click', 'view')) SELECT count(DISTINCT actor) FILTER (ts > {E_END} - INTERVAL 3600 SECOND) AS active_now,
count(*) FILTER (type = 'click' AND ts > {E_END} - INTERVAL 3600 SECOND) AS searches_now, count(*) FILTER (type = 'click') AS searches_day, count(*) FILTER (type = 'view') AS views_day FROM e""")
def live_counters(spark, d):
    return events.live_counters(fixtures.event(spark, d), EVENTS_AS_OF, search="click", seconds=3600)


@query(f"WITH e AS ({EVENT}) SELECT query, count(*) AS hits, count(*) FILTER (result_count > 0) AS hits_with_results FROM e WHERE type = 'view' AND ts > {E_END} - INTERVAL 1 DAY AND length(query) >= 2 GROUP BY 1 ORDER BY hits DESC, query LIMIT 10")
def trending(spark, d):
    return events.trending(fixtures.event(spark, d), EVENTS_AS_OF, search="view")


@query(f"WITH e AS ({EVENT}) SELECT query, count(*) AS hits FROM e WHERE type = 'view' AND ts > {E_END} - INTERVAL 7 DAY AND query IS NOT NULL AND result_count <= 0 GROUP BY 1 ORDER BY hits DESC, query LIMIT 20")
def zero_results(spark, d):
    return events.zero_results(fixtures.event(spark, d), EVENTS_AS_OF, search="view")


@query(f"""WITH e AS (SELECT * FROM ({EVENT}) WHERE ts > {E_END} - INTERVAL 7 DAY), l AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS shop_id FROM lineitem),
v AS (SELECT shop_id, count(*) AS views FROM (SELECT product_id FROM e WHERE type = 'view') JOIN l USING (product_id) GROUP BY 1), c AS (SELECT shop_id, count(*) AS clicks FROM e WHERE type = 'click' AND shop_id IS NOT NULL GROUP BY 1)
SELECT shop_id, coalesce(views, 0)::BIGINT AS views, coalesce(clicks, 0) AS clicks, CASE WHEN coalesce(views, 0) = 0 THEN 0.0 ELSE floor(coalesce(clicks, 0)::DOUBLE / views * 1000.0 + 0.5) / 10 END AS ctr_pct FROM v FULL JOIN c USING (shop_id) ORDER BY ctr_pct DESC, shop_id LIMIT 20""")
def shop_ctr(spark, d):
    return events.shop_ctr(fixtures.event(spark, d), fixtures.price_history(spark, d), EVENTS_AS_OF)


@query(f"WITH v AS (SELECT list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n FROM ({EVENT}) WHERE type IN ('view', 'click') AND ts > {E_END} - INTERVAL 1 DAY AND latency_ms >= 0) SELECT n, v[least(n - 1, n // 2) + 1] AS p50, v[CAST(least(n - 1, floor(n * 0.95::DOUBLE + 0.5)) AS BIGINT) + 1] AS p95, v[CAST(least(n - 1, floor(n * 0.99::DOUBLE + 0.5)) AS BIGINT) + 1] AS p99 FROM v")
def latency_percentiles(spark, d):
    return events.latency_percentiles(fixtures.event(spark, d), EVENTS_AS_OF, ["view", "click"])


@query(f"WITH e AS ({EVENT}), t AS (SELECT product_id, count(*) AS n FROM e WHERE type = 'view' AND ts > {E_END} - INTERVAL 7 DAY AND product_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, product_id LIMIT 20) SELECT product_id, n, p_name AS name FROM t LEFT JOIN part ON p_partkey = product_id")
def top_products(spark, d):
    return events.top_products(fixtures.event(spark, d), fixtures.product(spark, d), EVENTS_AS_OF)


@query(f"WITH e AS ({EVENT}) SELECT id, type, actor, ts FROM e WHERE type IN ('view', 'click') AND ts > {E_END} - INTERVAL 7 DAY ORDER BY ts DESC, id DESC LIMIT 100")
def recent_events(spark, d):
    return events.recent(fixtures.event(spark, d), EVENTS_AS_OF, ["view", "click"])


@query(f"WITH e AS ({EVENT}) SELECT id, query, result_count, ts FROM e WHERE type = 'view' AND actor = 5 AND ts > {E_END} - INTERVAL 30 DAY ORDER BY ts DESC, id DESC LIMIT 50")
def user_history(spark, d):
    return events.user_history(fixtures.event(spark, d), EVENTS_AS_OF, 5, "view")


@query(f"WITH e AS ({EVENT}) SELECT type, count(*) AS n FROM e WHERE ts > {E_END} - INTERVAL 10 DAY GROUP BY 1")
def ttl_filter(spark, d):
    return mutations.live(fixtures.event(spark, d), EVENTS_AS_OF, 10).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH e AS ({EVENT}) SELECT id, actor, ts FROM e WHERE type = 'purchase' AND ts > TIMESTAMP '2024-01-20 12:00:00'")
def events_after(spark, d):
    return events.by_type_after(fixtures.event(spark, d), "purchase", "2024-01-20 12:00:00").select("id", "actor", "ts")


@query("""WITH r AS (SELECT o_custkey AS shop_id, o_orderdate AS "at", o_orderkey AS run_id, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS ok FROM orders),
i AS (SELECT *, sum(ok) OVER (PARTITION BY shop_id ORDER BY "at", run_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s7, sum(ok) OVER (PARTITION BY shop_id ORDER BY "at", run_id ROWS UNBOUNDED PRECEDING) AS isl FROM r),
f AS (SELECT *, CASE WHEN ok = 1 THEN 0 ELSE row_number() OVER (PARTITION BY shop_id, isl ORDER BY "at", run_id) - CASE WHEN isl > 0 THEN 1 ELSE 0 END END AS cf FROM i)
SELECT shop_id, "at", run_id, CAST(s7 AS BIGINT) AS recent_ok, CASE WHEN s7 >= 4 THEN 'active' WHEN s7 >= 1 THEN 'degraded' ELSE 'dormant' END AS health, CAST(cf AS BIGINT) AS failures, ok = 0 AS needs_retry,
bool_or(cf >= 3) OVER (PARTITION BY shop_id ORDER BY "at", run_id ROWS UNBOUNDED PRECEDING) AS blocked FROM f""")
def shop_health(spark, d):
    return health.shop_health(fixtures.shop_run(spark, d))


@query("SELECT o_custkey AS shop_id, o_orderdate AS at, o_orderkey AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 7")
def last_runs(spark, d):
    return health.last_runs(fixtures.shop_run(spark, d)).select("shop_id", "at", "run_id")


@query(f"""WITH e AS (SELECT actor AS host, ts, id, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY actor ORDER BY ts, id)) AS gap FROM ({EVENT}))
SELECT host, id, ts, coalesce(gap < 600000, false) AS too_soon FROM e""")
def host_gaps(spark, d):
    return health.host_gaps(fixtures.event(spark, d).withColumnRenamed("actor", "host"), 600_000).select("host", "id", "ts", "too_soon")


_REFILLED = "least(3.0::DOUBLE, f.tokens + greatest(0.0::DOUBLE, e.s - f.s) * (1.0::DOUBLE / 86400.0::DOUBLE))"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts, epoch_us(ts) / 1000000.0::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
f AS (SELECT key, id, ts, s, n, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE n = 1
UNION ALL SELECT e.key, e.id, e.ts, e.s, e.n, {_REFILLED} >= 1, {_REFILLED} - CASE WHEN {_REFILLED} >= 1 THEN 1 ELSE 0 END FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, id, ts, allowed FROM f""")
def rate_limit_fold(spark, d):
    return ratelimit.rate_limit(fixtures.event(spark, d), 3, 1 / 86400)


# -- lookups


@query("SELECT p_partkey AS id, p_name AS name, CAST(pos AS INT) AS pos FROM (VALUES (9, 0), (4, 1), (9, 2), (150, 4)) AS a(id, pos) JOIN part ON p_partkey = a.id")
def bulk_lookup(spark, d):
    return lookups.by_ids(fixtures.product(spark, d), [9, 4, 9, -1, 150]).select("id", "name", "pos")


@query("WITH m AS (SELECT * FROM part WHERE contains(lower(p_name), 'red') AND p_type = (SELECT min(p_type) FROM part WHERE contains(lower(p_name), 'red'))) SELECT p_partkey AS id, p_name AS name, (SELECT count(*) FROM m) AS total FROM m ORDER BY id LIMIT 20 OFFSET 20")
def catalog_page(spark, d):
    products = fixtures.product(spark, d)
    category = products.where(F.contains(F.lower("name"), F.lit("red"))).agg(F.min("category")).first()[0]
    return lookups.listing(products, "RED", category, page=1).select("id", "name", F.col("total").cast("long").alias("total"))


@query(f"WITH s AS ({SITE_PRICE}) SELECT p_partkey AS id, p_name AS name, {_SLUG} AS slug, p_type AS category, p_retailprice AS lowest_price, coalesce(n, 0) AS seller_count, CASE WHEN p_partkey % 3 = 0 THEN 'https://img.test/' || p_partkey END AS image_url FROM part LEFT JOIN (SELECT product_id, count(*) AS n FROM s GROUP BY 1) ON product_id = p_partkey")
def suggestions(spark, d):
    image = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://img.test/"), F.col("id").cast("string")))
    products = fixtures.product(spark, d).withColumns({"slug": text.slug(F.col("name")), "image_url": image})
    return lookups.suggest(products, fixtures.site_price(spark, d))


@query(f"WITH s AS ({SITE_PRICE}) SELECT p_partkey AS id, p_name AS name, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN coalesce(n, 0) > 1 THEN n || ' sellers' END AS badge, upper(p_type) AS category FROM part LEFT JOIN (SELECT product_id, count(*) AS n FROM s GROUP BY 1) ON product_id = p_partkey")
def previews(spark, d):
    return lookups.preview(lookups.suggest(fixtures.product(spark, d), fixtures.site_price(spark, d)))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey = 42")
def point_lookup(spark, d):
    return lookups.by_id_or_slug(fixtures.product(spark, d).withColumn("slug", text.slug(F.col("name"))), "42").select("id", "name")


@query("SELECT DISTINCT ps_query AS query, CAST(rank AS INT) AS rank FROM (SELECT 'status ' || o_orderpriority AS ps_query, min(rn) AS rank FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 10 GROUP BY 1) ORDER BY rank LIMIT 5")
def recent_searches(spark, d):
    jobs = table(spark, d, "orders").select(F.concat(F.lit("status "), F.col("o_orderpriority")).alias("query"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("id"))
    return lookups.recent_queries(jobs)


# -- search and classification


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS lowest_price FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM (SELECT * FROM part WHERE contains(lower(p_name), 'bl') ORDER BY p_partkey LIMIT 8)) WHERE rn = 1")
def autocomplete(spark, d):
    return search.autocomplete(fixtures.product(spark, d), "Bl")


_SEARCH_TOKENS = "['red', 'bolt']"


@query(f"""WITH n AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS lowest_price, lower(p_name) AS low FROM part), t AS (SELECT *, list_has_any(string_split(regexp_replace(low, '[^a-z0-9]+', ' ', 'g'), ' '), {_SEARCH_TOKENS}) AS one,
contains(low, 'red') AND contains(low, 'bolt') AS two, contains(low, 'red bolt') AS three FROM n),
a AS (SELECT *, 1 AS pass FROM t WHERE one ORDER BY id LIMIT 30), b AS (SELECT *, 2 AS pass FROM t WHERE two ORDER BY id LIMIT 30),
m2 AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) < 30), m3 AS (SELECT * FROM m2 UNION ALL SELECT *, 3 FROM t WHERE three AND (SELECT count(DISTINCT id) FROM m2) < 30)
SELECT id, name, lowest_price, CAST(min(pass) AS INT) AS pass, (CASE WHEN contains(low, 'red') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'bolt') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS coverage FROM m3 GROUP BY id, name, lowest_price, low""")
def catalog_search(spark, d):
    return search.search(fixtures.product(spark, d), "Red, BOLT!")


@query(f"""WITH r AS (SELECT p_partkey FROM part WHERE list_has_any(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), {_SEARCH_TOKENS}) ORDER BY 1 LIMIT 30) SELECT DISTINCT l_suppkey AS site_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM r)""")
def sites_searched(spark, d):
    return search.sites_searched(search.search(fixtures.product(spark, d), "red bolt"), fixtures.site_price(spark, d))


@query("""WITH n AS (SELECT lower(p_name) AS t, min(p_partkey) AS id FROM part GROUP BY 1), q AS (SELECT * FROM (VALUES (1, 'rde bolt'), (2, 'blu widgit'), (3, 'gear')) AS q(query_id, query)),
ng AS (SELECT id, list_distinct(list_transform(generate_series(1, length(t)), lambda i: substr(' ' || t || ' ', i, 3))) AS g FROM n), qg AS (SELECT query_id, list_distinct(list_transform(generate_series(1, length(query)), lambda i: substr(' ' || query || ' ', i, 3))) AS g FROM q),
s AS (SELECT query_id, id, len(list_intersect(qg.g, ng.g))::DOUBLE / (len(qg.g) + len(ng.g) - len(list_intersect(qg.g, ng.g))) AS score FROM qg, ng WHERE len(list_intersect(qg.g, ng.g)) > 0)
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def trigram_topk(spark, d):
    asked = spark.createDataFrame([(1, "rde bolt"), (2, "blu widgit"), (3, "gear")], "query_id int, query string")
    return search.trigram_top(asked, fixtures.product(spark, d), 5)


_WORDS = "string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' ')"
_FUZZY = " + ".join(f"CASE WHEN len(list_filter(w, lambda x: levenshtein(x, '{t}') <= 1)) > 0 THEN 3 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: starts_with(x, '{t}'))) > 0 THEN 2 ELSE 0 END" for t in ("rad", "bolt"))


@query(f"SELECT id, name, CAST(score AS INT) AS score FROM (SELECT p_partkey AS id, p_name AS name, {_FUZZY} AS score FROM (SELECT *, {_WORDS} AS w FROM part)) WHERE score > 0 ORDER BY score DESC, id LIMIT 30")
def fuzzy_search(spark, d):
    return search.fuzzy_name_search(fixtures.product(spark, d), "rad bolt")


_KW = ", ".join(f"('{c}', '{k}')" for c, ks in dictionaries.KEYWORDS.items() for k in ks)
_BR = ", ".join(f"('{b}', '{c}')" for b, cs in dictionaries.BRANDS.items() for c in cs)
_CAT = ", ".join(f"('{c[0]}', {i})" for i, c in enumerate(dictionaries.CATEGORIES))
#: A text of every document's kind that mentions products: queries made of dictionary words, two for each customer.
_TERMS = [k for ks in dictionaries.KEYWORDS.values() for k in ks] + list(dictionaries.BRANDS)
_TERM_SQL = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"


def customer_queries(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query): three dictionary words for each customer."""
    terms = F.array(*map(F.lit, _TERMS))
    pick = lambda m, a: F.get(terms, ((F.col("c_custkey") * m + a) % len(_TERMS)).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", pick(7, 1), pick(13, 5), pick(29, 3)).alias("query"))


@query(f"""WITH kw(category, gram) AS (VALUES {_KW}), br(gram, category) AS (VALUES {_BR}), cat(category, ordinal) AS (VALUES {_CAT}), terms AS (SELECT {_TERM_SQL} AS t),
q AS (SELECT c_custkey AS query_id, t[(c_custkey * 7 + 1) % {len(_TERMS)} + 1] || ' ' || t[(c_custkey * 13 + 5) % {len(_TERMS)} + 1] || ' ' || t[(c_custkey * 29 + 3) % {len(_TERMS)} + 1] AS query FROM customer, terms),
tok AS (SELECT query_id, string_split(trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS t FROM q),
g AS (SELECT query_id, unnest(t) AS gram, 1 AS words FROM tok UNION ALL SELECT query_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])), 2 FROM tok),
s AS (SELECT query_id, category, sum(p) AS score FROM (SELECT query_id, category, CASE WHEN words > 1 THEN 3 ELSE 2 END AS p FROM g JOIN kw USING (gram) UNION ALL SELECT DISTINCT query_id, category, 1 FROM g JOIN br USING (gram)) GROUP BY 1, 2),
r AS (SELECT query_id, category, score, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rk FROM s JOIN cat USING (category)),
a AS (SELECT query_id, string_agg(category, ',' ORDER BY rk) FILTER (2 * score >= top) AS categories, max(top) AS top, max(score) FILTER (rk = 2) AS second FROM r GROUP BY 1)
SELECT query_id, coalesce(categories, 'GENERAL') AS categories, CASE WHEN top IS NULL THEN 0.0 ELSE least(1.0, CASE WHEN second IS NULL THEN top ELSE top - second + 1 END::DOUBLE / 5.0) END AS confidence FROM q LEFT JOIN a USING (query_id)""")
def classify_terms(spark, d):
    found = classify.classify(customer_queries(spark, d), dictionaries.keyword_dim(spark), dictionaries.brand_dim(spark), dictionaries.category_dim(spark))
    return found.select("query_id", F.array_join("categories", ",").alias("categories"), "confidence")


_QUERY_SQL = f"""q AS (SELECT c_custkey AS query_id, t[(c_custkey * 7 + 1) % {len(_TERMS)} + 1] || ' ' || t[(c_custkey * 13 + 5) % {len(_TERMS)} + 1] || ' ' || t[(c_custkey * 29 + 3) % {len(_TERMS)} + 1] AS query FROM customer, (SELECT {_TERM_SQL} AS t)),
tok AS (SELECT query_id, string_split(trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS t FROM q),
g AS (SELECT query_id, unnest(t) AS gram, generate_subscripts(t, 1) AS place FROM tok UNION ALL SELECT query_id, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])), unnest(generate_series(2, len(t))) FROM tok)"""


@query(f"""WITH br(gram) AS (SELECT DISTINCT x FROM (VALUES {", ".join(f"('{b}')" for b in dictionaries.BRANDS)}) AS v(x)), {_QUERY_SQL} SELECT query_id, string_agg(gram, ',' ORDER BY place, gram) AS brands FROM g JOIN br USING (gram) GROUP BY 1""")
def brand_mentions(spark, d):
    found = classify.brand_mentions(customer_queries(spark, d), dictionaries.brand_dim(spark))
    return found.select("query_id", F.array_join("brands", ",").alias("brands"))


#: Queries of the validator, each of one category without model words but the last.
VALIDATED = [(1, "red bolt", "GENERAL", []), (2, "blue gear case", "KITCHEN", []), (3, "the green widget", "GENERAL", []), (4, "steel x9", "GENERAL", ["bolt"])]
_INTENTS = ", ".join(f"({i}, '{q}', '{c}', [{', '.join(repr(t) for t in m)}]::VARCHAR[])" for i, q, c, m in VALIDATED)
_SPANS = ", ".join(f"('{c}', {low}::DOUBLE, {high}::DOUBLE)" for c, _, low, high in dictionaries.CATEGORIES)
_SQL_WORDS = lambda x: f"list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2))"
_SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH i(query_id, query, category, model) AS (VALUES {_INTENTS}), span(category, low, high) AS (VALUES {_SPANS}),
n AS (SELECT p_name AS name, min(p_retailprice) AS price FROM part GROUP BY 1),
r AS (SELECT query_id, name, price, low, high, model, {_SQL_WORDS("query")} AS a, {_SQL_WORDS("name")} AS t, lower(name) AS l, CASE WHEN query_id % 2 = 0 AND length(name) % 2 = 0 THEN 0.0 ELSE 1.0 END AS stock FROM n, i JOIN span USING (category) WHERE trim(name) <> ''),
k AS (SELECT *, list_has_any(t, model) AS m, len(list_intersect(a, t)) AS s FROM r WHERE price BETWEEN low AND high
 AND (list_has_any(t, model) OR len(list_filter(a, lambda x: length(x) >= 3 AND NOT list_contains({_SQL_LIST(dictionaries.STOP_WORDS)}, x) AND NOT contains(l, x))) = 0)
 AND len(list_filter(string_split(regexp_replace(l, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: list_contains({_SQL_LIST(dictionaries.ACCESSORY_WORDS)}, x) AND NOT list_contains(a, x))) = 0),
z AS (SELECT *, CASE WHEN m THEN 1.0 ELSE least(1.0, 0.55::DOUBLE * s / greatest(len(a) + len(t) - s, 1) + 0.45::DOUBLE * s / greatest(len(a), 1)) END AS sim, greatest(0.4::DOUBLE, 1 - abs(ln(price) - ln(sqrt(low * least(high, low * 1000)))) / 5.0) AS near FROM k)
SELECT query_id, name, price, round(sim::DOUBLE, 6) AS similarity, round(0.7::DOUBLE * sim + 0.2::DOUBLE * near + 0.1::DOUBLE * stock, 6) AS score FROM z""")
def validated_results(spark, d):
    names = fixtures.product(spark, d).groupBy("name").agg(F.min("lowest_price").alias("price"))
    asked = F.explode(F.array(*[F.lit(i) for i, *_ in VALIDATED])).alias("query_id")
    results = names.select(asked, "name", "price").withColumn("in_stock", ~((F.col("query_id") % 2 == 0) & (F.length("name") % 2 == 0)))
    intents = spark.createDataFrame([(i, q, [c], m) for i, q, c, m in VALIDATED], "query_id int, query string, categories array<string>, model_tokens array<string>")
    found = search.validate(results, intents, dictionaries.category_dim(spark))
    return found.select("query_id", "name", "price", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


# -- scalar library


@query("""WITH f AS (SELECT DISTINCT p_name AS name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS s FROM part)
SELECT DISTINCT name, unnest(CASE WHEN length(s) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(length(s) - 3, 1)), lambda i: substr(s, i, 4))) END) AS shingle FROM f""")
def name_shingles(spark, d):
    names = fixtures.product(spark, d).select("name").distinct()
    return names.select("name", F.explode(text.shingles(text.shingle_form(F.col("name")), 4)).alias("shingle"))


# Written out once more, so that a slip in the library's patterns shows.
_KEY = "lower(p_name)"
for _p in (
    r"\([^)]*\)", r"\[[^\]]*\]", r"\b(with|w/?)\s+(retractable\s+)?(usb[- ]?c\s+)?cable\b", r"\bwith\s+charging\s+case\b", r"\b(price|in)\s+bangladesh\b",
    r"\b\d+\s*[/\\]\s*\d+\s*(gb|tb|mb)\b", r"\b\d{2,4}\s*(gb|tb)\b", r"\b\d{1,2}\s*gb\b",
    r"\b(titanium|black|white|silver|gold|blue|red|green|graphite|onyx|natural|desert|midnight)\b",
):
    _KEY = f"regexp_replace({_KEY}, '{_p}', ' ', 'g')"
_KEY = f"trim(regexp_replace(regexp_replace({_KEY}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT p_partkey AS id, CASE WHEN {_KEY} = '' THEN lower(p_name) ELSE {_KEY} END AS key FROM part")
def match_key(spark, d):
    return fixtures.product(spark, d).select("id", text.match_key(F.col("name")).alias("key"))


@query(r"SELECT p_partkey AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugify(spark, d):
    return fixtures.product(spark, d).select("id", text.slug(F.concat_ws(" ", "name", "brand")).alias("slug"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN e >= 10 THEN e + 0.5 WHEN q >= 5 THEN q END::DOUBLE AS price FROM p""")
def price_parse(spark, d):
    rows = table(spark, d, "lineitem")
    label = F.concat(F.lit("now "), F.floor("l_extendedprice").cast("long").cast("string"), F.lit(".5 or TK "), F.col("l_quantity").cast("long").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", numbers.first_price(label).alias("price"))


@query("SELECT user_id, left(sha256('10.0.0.' || user_id), 16) AS hash FROM (SELECT DISTINCT user_id FROM events)")
def ip_hash(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", text.ip_hash(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("hash"))


# Written out once more, as above.
_JUNK = r"(?i)/(login|register|cart|checkout|account|wishlist|track|order|wp-admin|wp-content|wp-includes|wp-json|feed|comments?|tag/|tags/|author/|page/[0-9]|blog/|news/|press/|about|contact|privacy|terms|policy|help|faq|support|sale\.php|search|return|refund|career)/?"
_PRODUCT, _CATEGORY = r"(?i)/(product|products|p|item|sku|book|catalog/product)/[^/?#]+", r"(?i)/(category|categories|cat|c|shop|brand|brands|department|collection|collections)/[^/?#]+"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(rf"""WITH u AS (SELECT page_id, {_PATH} AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, url FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '{_JUNK}') THEN 'drop' WHEN regexp_matches(path, '{_PRODUCT}') OR regexp_matches(q, '(?i)route=product/product') THEN 'product'
WHEN regexp_matches(path, '{_CATEGORY}') OR regexp_matches(q, '(?i)route=product/category') THEN 'category' WHEN regexp_matches(path, '(?i)^/[a-z0-9][a-z0-9-]{{19,}}$') AND length(path) - length(replace(path, '-', '')) >= 4 THEN 'product' ELSE 'drop' END AS class,
lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_replace(split_part(url, '#', 1), '/$', '') AS canon FROM u""")
def url_classify(spark, d):
    u = F.col("url")
    return fixtures.page(spark, d).select("page_id", urls.link_class(u).alias("class"), urls.host_of(u).alias("host"), urls.canonical(urls.strip_fragment(u)).alias("canon"))


@query("SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages WHERE NOT list_bool_or(list_transform([" + ", ".join(f"'{b}'" for b in dictionaries.BLOCKED_HOSTS) + "], lambda b: contains(lower(regexp_extract(url, '://([^/?#:]*)', 1)), b))) AND regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') NOT IN (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') FROM pages WHERE page_id % 3 = 0)")
def known_host_anti(spark, d):
    pages = fixtures.page(spark, d)
    host = urls.host_of(F.col("url"))
    hosts = pages.where(~urls.is_blocked(host)).select(urls.strip_www(host).alias("host"))
    known = pages.where("page_id % 3 = 0").select(urls.strip_www(host).alias("host"))
    return mutations.unknown_hosts(hosts, known)


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark, d):
    return fixtures.page(spark, d).select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query()
def page_links(spark, d):
    return html.links(fixtures.page(spark, d))


def product_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html): a page for each product, whose offer is in JSON-LD, OpenGraph, microdata or plain markup in turn."""
    c, text_of = F.col, lambda x: F.col(x).cast("string")
    price, size = F.format_string("%.2f", "p_retailprice"), text_of("p_size")
    stock = F.when(c("p_size") % 2 == 0, "InStock").otherwise("OutOfStock")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    ld = say('<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"', c("p_name"), '","image":["/i/', text_of("p_partkey"), '.png"],"offers":{"price":"', price, '","highPrice":"9,999","availability":"http://schema.org/', stock, '"},"aggregateRating":{"ratingValue":4.4,"reviewCount":', size, "}}]}</script>")
    og = say('<meta property="og:type" content="product"><meta property="og:title" content="', c("p_name"), '"><meta property="product:price:amount" content="', price, '"><meta property="og:image" content="https://img.test/', text_of("p_partkey"), '.png">')
    micro = say('<div itemscope><b itemprop="name">', c("p_name"), '</b><meta itemprop="price" content="', price, '"><img itemprop="image" src="i.png"></div>')
    css = say('<h1 class="product_title">', c("p_name"), '</h1><p class="price"><ins><span class="woocommerce-Price-amount"><bdi>TK ', price, '</bdi></span></ins></p><div class="star-rating"><span style="width: 90%"></span></div><a class="woocommerce-review-link">(', size, " reviews)</a>")
    kind = c("p_partkey") % 4
    html_of = say("<html><body>", F.when(kind == 0, ld).when(kind == 1, og).when(kind == 2, micro).otherwise(css), "</body></html>")
    return table(spark, d, "part").select(c("p_partkey").alias("page_id"), say("https://shop.test/product/", text_of("p_partkey")).alias("url"), html_of.alias("html"))


@query("""SELECT p_partkey AS page_id, p_name AS name, round(p_retailprice, 2) AS price, CASE k WHEN 0 THEN CASE WHEN round(p_retailprice, 2) < 9999 THEN 9999.0 END END AS original_price,
CASE k WHEN 0 THEN 'https://shop.test/i/' || p_partkey || '.png' WHEN 1 THEN 'https://img.test/' || p_partkey || '.png' WHEN 2 THEN 'https://shop.test/product/i.png' END AS image_url,
CASE k WHEN 0 THEN 4.4 WHEN 3 THEN 4.5 END::DOUBLE AS rating, CASE WHEN k IN (0, 3) THEN p_size END::DOUBLE AS review_count, k <> 0 OR p_size % 2 = 0 AS in_stock FROM (SELECT *, p_partkey % 4 AS k FROM part) WHERE round(p_retailprice, 2) >= 10""")
def page_offers(spark, d):
    found = html.offers(product_pages(spark, d))
    return found.select("page_id", "name", "price", "original_price", "image_url", "rating", F.col("review_count").cast("double").alias("review_count"), "in_stock")


def shop_fronts(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html): a front page and two category pages for each supplier."""
    base = F.concat(F.lit("https://www.shop"), F.col("s_suppkey").cast("string"), F.lit(".test/"))
    item = lambda k: f'<a href="/product/item-{k}">x</a>'
    pages = [
        ("", item(0) + '<a href="/category/a#top">a</a><a href="category/b">b</a><a href="/login/">l</a><a href="mailto:x">m</a><a href="https://other.test/product/9">o</a>'),
        ("category/a", item(1) + item(2)),
        ("category/b", item(2) + '<a href="/blog/x">y</a>' + item(0)),
    ]
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.concat(base, F.lit(p)).alias("url"), F.lit(h).alias("html")) for i, (p, h) in enumerate(pages)])).alias("p")
    return table(spark, d, "supplier").select("s_suppkey", made).select((F.col("s_suppkey") * 10 + F.col("p.n")).alias("page_id"), "p.url", "p.html")


@query("SELECT s_suppkey * 10 + n AS page_id, 'https://www.shop' || s_suppkey || '.test/product/item-' || k AS url FROM supplier, (VALUES (0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 0)) AS v(n, k)")
def front_crawl(spark, d):
    return html.crawl_front(shop_fronts(spark, d))


def _entry(loc: str, freq: str, priority: str) -> str:
    tags = "".join(f"    <{t}>{x}</{t}>\n" for t, x in (("loc", loc), ("lastmod", "2024-02-01"), ("changefreq", freq), ("priority", priority)))
    return f"  <url>\n{tags}  </url>"


@query(f"""SELECT p_partkey AS pos, replace('{_entry("https://shop.test/product/@", "daily", "0.7")}', '@', {_SLUG}) AS line FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 50000)
UNION ALL SELECT * FROM (VALUES (-4, '{_entry("https://shop.test/", "daily", "1.0")}'), (-3, '{_entry("https://shop.test/sellers", "weekly", "0.5")}'), (-2, '{_entry("https://shop.test/compare", "monthly", "0.3")}'), (-1, '{_entry("https://shop.test/submit-shop", "monthly", "0.3")}'))
UNION ALL SELECT * FROM (VALUES (-6, '<?xml version="1.0" encoding="UTF-8"?>'), (-5, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), (9223372036854775807, '</urlset>'))""")
def sitemap(spark, d):
    return files.sitemap_document(fixtures.product(spark, d).withColumn("slug", text.slug(F.col("name"))), "https://shop.test/", "2024-02-01")


@query("SELECT * FROM (VALUES (0, 'User-agent: *'), (1, 'Allow: /'), (2, 'Disallow: /admin'), (3, 'Disallow: /api/admin/'), (4, ''), (5, 'Sitemap: https://shop.test/sitemap.xml')) AS r(pos, line)")
def robots(spark, d):
    return files.robots(spark, "https://shop.test/")


# -- entity resolution

# The generator's draws in SQL: each hash takes the low 31 bits of every second draw, first a, made odd, then b.
_DRAWS = """lcg AS (SELECT 0 AS i, xor(12648430, 25214903917)::HUGEINT AS s UNION ALL SELECT i + 1, (s * 25214903917 + 11) % 281474976710656 FROM lcg WHERE i < 512),
d AS (SELECT i, ((s // 65536) % 2147483648)::BIGINT AS v FROM lcg), co AS (SELECT (x.i - 2) // 4 AS k, x.v + 1 - x.v % 2 AS a, y.v AS b FROM d x JOIN d y ON y.i = x.i + 2 WHERE x.i % 4 = 2)"""
_SIG = ", ".join(f"min(v) FILTER (k = {i}) AS h{i}" for i in range(8))
_SHINGLE_SQL = f"""k AS (SELECT DISTINCT CASE WHEN {_KEY} = '' THEN lower(p_name) ELSE {_KEY} END AS key FROM part), f AS (SELECT key, trim(regexp_replace(lower(key), '[^a-z0-9]+', ' ', 'g')) AS s FROM k),
sh AS (SELECT key, unnest(list_distinct(list_transform(generate_series(1, greatest(length(s) - 3, 1)), lambda i: substr(s, i, 4)))) AS g FROM f), hs AS (SELECT key, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM sh), sg AS (SELECT key, k, min((a * h + b) % 2147483647) AS v FROM hs, co GROUP BY 1, 2)"""
_PAIR_SQL = """bd AS (SELECT key, k // 4 AS band, string_agg(v, ',' ORDER BY k) AS slice FROM sg GROUP BY 1, 2), pr AS (SELECT DISTINCT x.key, y.key AS other FROM bd x JOIN bd y USING (band, slice) WHERE x.key <> y.key),
sc AS (SELECT pr.key, other, count(*) FILTER (x.v = y.v) / 128.0::DOUBLE AS score FROM pr JOIN sg x ON x.key = pr.key JOIN sg y ON y.key = other AND y.k = x.k GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_DRAWS}, {_SHINGLE_SQL} SELECT key, {_SIG} FROM sg GROUP BY key")
def minhash_signature(spark, d):
    keyed = resolve.name_shingles(fixtures.product(spark, d)).select("key", minhash.signature_sql(resolve.shingle_hashes(F.col("shingles")), 8).alias("sig"))
    return keyed.select("key", *[F.get("sig", F.lit(i)).alias(f"h{i}") for i in range(8)])


@query(f"""WITH RECURSIVE {_DRAWS}, {_SHINGLE_SQL}, sig AS (SELECT key, {_SIG} FROM sg GROUP BY key), b AS (SELECT key, 0 AS band, [h0, h1] AS s FROM sig UNION ALL SELECT key, 1, [h2, h3] FROM sig UNION ALL SELECT key, 2, [h4, h5] FROM sig UNION ALL SELECT key, 3, [h6, h7] FROM sig)
SELECT DISTINCT x.key, y.key AS other FROM b x JOIN b y USING (band, s) WHERE x.key < y.key""")
def lsh_candidates(spark, d):
    sigs = resolve.name_shingles(fixtures.product(spark, d)).select("key", minhash.signature_sql(resolve.shingle_hashes(F.col("shingles")), 8).alias("sig"))
    a, b = resolve.bands(sigs, 4, 2), resolve.bands(sigs, 4, 2).withColumnRenamed("key", "other")
    return a.join(b, ["band", "slice"]).where("key < other").select("key", "other").distinct()


@query(f"WITH RECURSIVE {_DRAWS}, {_SHINGLE_SQL} SELECT key, string_agg(v, ',' ORDER BY k) AS sig FROM sg GROUP BY 1")
def minhash_signature_full(spark, d):
    """minhash_signature with all hashes."""
    return resolve.signatures(fixtures.product(spark, d)).select("key", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@query(f"WITH RECURSIVE {_DRAWS}, {_SHINGLE_SQL}, {_PAIR_SQL} SELECT key, other FROM pr WHERE key < other")
def lsh_candidates_full(spark, d):
    """lsh_candidates with all hashes and bands."""
    sigs = resolve.signatures(fixtures.product(spark, d))
    return resolve.candidates(sigs, sigs).where("key < other")


@query(f"WITH RECURSIVE {_DRAWS}, {_SHINGLE_SQL}, {_PAIR_SQL} SELECT key, other, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, other) AS rn FROM sc WHERE score >= 0.42) WHERE rn = 1")
def near_dup_best(spark, d):
    sigs = resolve.signatures(fixtures.product(spark, d))
    return resolve.best_matches(sigs, sigs)


@query(f"WITH RECURSIVE {_DRAWS}, {_SHINGLE_SQL}, {_PAIR_SQL}, reach AS (SELECT DISTINCT key, key AS other FROM sg UNION SELECT reach.key, sc.other FROM reach JOIN sc ON sc.key = reach.other WHERE score >= 0.42) SELECT key, min(other) AS low FROM reach GROUP BY 1")
def name_groups(spark, d):
    groups = resolve.groups_by_name(fixtures.product(spark, d))
    return groups.join(groups.groupBy("root").agg(F.min("key").alias("low")), "root").select("key", "low")


@query()
def resolved_offers(spark, d):
    products = fixtures.product(spark, d)
    url = lambda host: F.concat(F.lit(f"https://{host}/p/"), F.col("id").cast("string"))
    catalog = products.select("id", "name", url("shop.test").alias("url"))
    # all products are offered: a quarter under the catalog's URL, a quarter each under equal, similar and unlike names
    kind = F.pmod("id", F.lit(4))
    name = F.when(kind == 3, F.reverse("name")).when(kind == 2, F.concat_ws(" ", "name", F.lit("bundle"))).otherwise(F.concat_ws(" ", "name", F.lit("(128GB) Black")))
    offers = products.select(F.lit(1).alias("shop_id"), F.when(kind == 0, url("shop.test")).otherwise(url("other.test")).alias("url"), name.alias("name"), F.col("lowest_price").alias("price"))
    return resolve.resolve(catalog, offers)


# -- ingest rules as a table


@query("SELECT event_id AS id, event_type AS type, left(sha256('10.1.1.' || user_id), 16) AS ip_hash, 'k' || CAST(json_extract(props, '$.k') AS BIGINT) AS product_id FROM events WHERE event_type IN ('view', 'click')")
def accepted_events(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("query"), F.concat(F.lit(" k"), F.get_json_object("props", "$.k")).alias("product_id"),
        F.lit("").alias("seller_slug"), F.col("user_id").cast("string").alias("anon_id"), F.lit(None).cast("string").alias("user_id"), F.concat(F.lit("10.1.1."), F.col("user_id").cast("string")).alias("ip"), "ts",
    )
    return stream_events.accepted(raw).select("id", "type", "ip_hash", "product_id")


@query(f"WITH s AS ({SITE_PRICE}) SELECT product_id, site_id, CASE WHEN product_id % 7 = 0 THEN price * 2 ELSE price END AS price FROM s WHERE NOT (product_id % 7 = 1)")
def upsert_and_delete(spark, d):
    base = fixtures.site_price(spark, d).select("product_id", "site_id", "price")
    changed = base.where("product_id % 7 = 0").withColumn("price", F.col("price") * 2)
    return mutations.delete(mutations.upsert(base, changed, ["product_id", "site_id"]), base.where("product_id % 7 = 1").select("product_id"))


# -- changes of the catalog, runs and finders


_MERGE_PAIRS = "SELECT p_partkey AS from_id, CASE p_partkey % 10 WHEN 3 THEN p_partkey - 1 WHEN 5 THEN p_partkey WHEN 7 THEN -1 END AS to_id FROM part WHERE p_partkey % 10 IN (3, 5, 7)"
_CATALOG = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 2 THEN p_type END AS category, CASE WHEN p_partkey % 2 = 1 THEN 'i' || p_partkey END AS image_url, NULL::VARCHAR AS description, p_retailprice AS lowest_price, p_retailprice AS highest_price FROM part"


def _merge_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("id")
    products = fixtures.product(spark, d).select(
        "id", F.when(i % 4 != 2, F.col("category")).alias("category"), F.when(i % 2 == 1, F.concat(F.lit("i"), i.cast("string"))).alias("image_url"),
        F.lit(None).cast("string").alias("description"), "lowest_price", F.col("lowest_price").alias("highest_price"),
    )
    site_prices = fixtures.site_price(spark, d).select("product_id", F.concat(F.lit("u"), (F.col("site_id") % 5).cast("string"), F.lit("-"), F.col("site_id").cast("string")).alias("product_url"), "price")
    to = F.when(i % 10 == 3, i - 1).when(i % 10 == 5, i).when(i % 10 == 7, F.lit(-1))
    return products, site_prices, products.where(to.isNotNull()).select(i.alias("from_id"), to.cast("long").alias("to_id"))


@query(f"""WITH s AS ({SITE_PRICE}), c AS ({_CATALOG}), g AS (SELECT * FROM ({_MERGE_PAIRS}) WHERE to_id = from_id - 1),
m AS (SELECT coalesce(to_id, product_id) AS id, site_id, arg_min(price, to_id IS NOT NULL) AS price FROM s LEFT JOIN g ON product_id = from_id GROUP BY 1, 2), x AS (SELECT id, min(price) AS low, max(price) AS high, count(*) AS n FROM m GROUP BY 1)
SELECT c.id, coalesce(c.category, f.category) AS category, coalesce(c.image_url, f.image_url) AS image_url, CASE WHEN g.to_id IS NULL THEN c.lowest_price ELSE x.low END AS lowest_price, CASE WHEN g.to_id IS NULL THEN c.highest_price ELSE x.high END AS highest_price, coalesce(x.n, 0) AS sellers
FROM c LEFT JOIN g ON g.to_id = c.id LEFT JOIN c f ON f.id = g.from_id LEFT JOIN x ON x.id = c.id WHERE c.id NOT IN (SELECT from_id FROM g)""")
def merge_catalog(spark, d):
    products, site_prices = mutations.merge_catalog(*_merge_inputs(spark, d))
    sellers = site_prices.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("sellers"))
    return products.join(sellers, "id", "left").select("id", "category", "image_url", "lowest_price", "highest_price", F.coalesce("sellers", F.lit(0)).alias("sellers"))


@query(f"SELECT *, CASE WHEN to_id = from_id THEN 400 WHEN to_id = -1 THEN 404 ELSE 200 END AS code FROM ({_MERGE_PAIRS})")
def merge_codes(spark, d):
    products, _, pairs = _merge_inputs(spark, d)
    return mutations.merge_codes(products, pairs)


def _upload(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, prices and sellers, and an upload whose lines are all products: every other one is listed already."""
    i = F.col("id")
    url = F.concat(F.lit("https://shop.test/p/"), i.cast("string"))
    products = fixtures.product(spark, d).select("id", "name", text.slug(F.col("name")).alias("slug"), "category", F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("description"), "lowest_price")
    listed = products.select(i.alias("product_id"), F.lit("shop").alias("site_slug"), url.alias("product_url"), F.col("lowest_price").alias("price"), F.lit(True).alias("in_stock"))
    cell = F.when(i % 10 == 9, F.lit("n/a")).otherwise(F.concat(F.lit("TK "), F.floor(F.col("lowest_price") * 0.9).cast("string")))
    none = F.lit(None).cast("string")
    cells = products.select(i.cast("int").alias("line"), "name", cell.alias("price"), none.alias("image_url"), F.when(i % 2 == 0, url).otherwise(F.concat(F.lit("https://fb.test/"), i.cast("string"))).alias("product_url"), none.alias("category"), none.alias("description"), none.alias("in_stock"))
    sellers = spark.createDataFrame([("fb", "https://fb.test/")], "slug string, url string")
    return mutations.inventory_load(products, listed, sellers, "fb", cells)


_UPLOADED = "SELECT *, floor(p_retailprice * 0.9)::DOUBLE AS p FROM part WHERE p_partkey <= 500 AND p_partkey % 10 <> 9 AND floor(p_retailprice * 0.9) >= 10"


@query(f"""WITH u AS ({_UPLOADED}) SELECT CAST(part.p_partkey AS VARCHAR) AS id, part.p_name AS name, least(part.p_retailprice, u.p) AS lowest_price FROM part LEFT JOIN u ON u.p_partkey = part.p_partkey AND u.p_partkey % 2 = 0
UNION ALL SELECT 'new:https://fb.test/' || p_partkey, p_name, p FROM u WHERE p_partkey % 2 = 1""")
def inventory_products(spark, d):
    return _upload(spark, d)[0].select("id", "name", "lowest_price")


@query(f"""WITH u AS ({_UPLOADED}) SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'shop' AS site_slug, 'https://shop.test/p/' || p_partkey AS product_url, p_retailprice AS price FROM part
UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'new:https://fb.test/' END || p_partkey, 'fb', CASE WHEN p_partkey % 2 = 0 THEN 'https://shop.test/p/' ELSE 'https://fb.test/' END || p_partkey, p FROM u""")
def inventory_prices(spark, d):
    return _upload(spark, d)[1].select("product_id", "site_slug", "product_url", "price")


@query(f"WITH u AS ({_UPLOADED}) SELECT count(*) FILTER (p_partkey % 2 = 1) AS created, count(*) FILTER (p_partkey % 2 = 0) AS merged, (SELECT count(*) FROM part WHERE p_partkey <= 500) - count(*) AS skipped FROM u")
def inventory_counts(spark, d):
    return _upload(spark, d)[2]


def _shops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.when(k % 5 == 0, "blocked").when(k % 7 == 0, "paused").otherwise("active")
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("slug"), status.alias("status"), (k % 3 == 0).alias("needs_retry"))


@query("SELECT mode, slug FROM (SELECT 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 5 = 0 THEN 'blocked' WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS status, s_suppkey FROM supplier), (VALUES ('full'), ('retry'), ('single')) AS m(mode) WHERE CASE mode WHEN 'full' THEN status = 'active' WHEN 'retry' THEN s_suppkey % 3 = 0 AND status <> 'blocked' ELSE slug = 's4' END")
def index_runs(spark, d):
    runs = [lifecycle.run_shops(_shops(spark, d), mode, "s4").select(F.lit(mode).alias("mode"), "slug") for mode in lifecycle.MODES]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


_OUTCOME = "SELECT o_orderkey % 7 AS urls, o_orderkey % 3 AS inserted, o_orderkey % 2 AS merged, o_orderstatus = 'F' AS failed FROM orders"


@query(f"SELECT 'full' AS mode, count(*) AS shops_attempted, count(*) FILTER (NOT failed) AS shops_succeeded, count(*) FILTER (failed) AS shops_failed, CAST(sum(urls) AS BIGINT) AS urls, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(merged) AS BIGINT) AS merged, 5400 AS seconds FROM ({_OUTCOME})")
def run_record(spark, d):
    k = F.col("o_orderkey")
    outcomes = table(spark, d, "orders").select((k % 7).alias("urls"), (k % 3).alias("inserted"), (k % 2).alias("merged"), F.when(F.col("o_orderstatus") == "F", "timeout").alias("error"))
    return lifecycle.run_record(outcomes, "full", "2024-01-01 03:00:00", "2024-01-01 04:30:00")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN '(full reindex)' ELSE 'q' || o_custkey END AS query, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'PENDING' END ELSE 'COMPLETED' END AS status,
o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at, CASE WHEN o_orderstatus = 'F' THEN 'timeout' END AS error FROM orders""")
def job_states(spark, d):
    o = table(spark, d, "orders")
    state, k = F.col("o_orderstatus"), F.col("o_orderkey")
    at = lambda hours: F.col("o_orderdate") + F.expr(f"interval {hours} minutes")
    none, query_ = F.lit(None).cast("string"), F.when(k % 5 != 0, F.concat(F.lit("q"), F.col("o_custkey").cast("string")))
    step = lambda name, minutes, error=none: F.struct(F.lit(name).alias("step"), at(minutes).alias("at"), error.alias("error"))
    taken = F.array(
        step("ask", 0), F.when((state != "O") | (k % 2 == 0), step("start", 5)),
        F.when(state == "F", step("fail", 60, F.lit("timeout"))), F.when(state == "P", step("finish", 60)), F.when(state == "F", step("finish", 90)),
    )
    steps = o.select(k.alias("job_id"), query_.alias("query"), F.explode(F.array_compact(taken)).alias("s")).select("job_id", "query", "s.step", "s.at", "s.error")
    return lifecycle.job_states(steps)


@query("""SELECT * FROM (VALUES ('index', TIMESTAMP '2024-01-30 02:59:00', TIMESTAMP '2024-01-30 03:00:00', true), ('retry', TIMESTAMP '2024-01-31 04:00:00', TIMESTAMP '2024-02-01 04:00:00', false), ('snapshot', NULL, NULL, true),
('hot_drops', TIMESTAMP '2024-01-30 23:00:00', TIMESTAMP '2024-01-31 05:00:00', false), ('canary', TIMESTAMP '2024-01-31 04:14:59', TIMESTAMP '2024-01-31 04:15:00', true)) AS t(task, last_at, next_at, due)""")
def due_tasks(spark, d):
    last = spark.createDataFrame([("index", "2024-01-30 02:59:00"), ("retry", "2024-01-31 04:00:00"), ("snapshot", None), ("hot_drops", "2024-01-30 23:00:00"), ("canary", "2024-01-31 04:14:59")], "task string, at string")
    return lifecycle.due(last.select("task", F.col("at").cast("timestamp_ntz").alias("last_at")), "2024-01-31 04:20:00")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def customers_by_segment(spark, d):
    return lookups.find_by(table(spark, d, "customer"), "c_mktsegment", "BUILDING").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def pending_count(spark, d):
    return lookups.count_by(table(spark, d, "orders"), "o_orderstatus", "P")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 17 AND l_linestatus = 'O'")
def product_reviews(spark, d):
    return lookups.children(table(spark, d, "lineitem"), l_partkey=17, l_linestatus="O").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey AS user_id, trim(q) AS query, CASE WHEN c_custkey IS NULL THEN 401 WHEN length(trim(q)) < 2 THEN 400 ELSE 200 END AS code FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' x ' WHEN 1 THEN ' tv set ' ELSE 'ac' END AS q FROM customer)")
def saved_searches(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("user_id"), F.when(k % 3 == 0, " x ").when(k % 3 == 1, " tv set ").otherwise("ac").alias("query"))
    return mutations.add_saved_searches(rows)


from cataloom.plans import library  # noqa: E402, F401  registers its queries here
