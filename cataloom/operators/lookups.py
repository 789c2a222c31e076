"""Point lookups, finders and pages over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_id_or_slug(table: DataFrame, value: str) -> DataFrame:
    """The row of that id, else the one of that slug; none for a blank."""
    if not value or not value.strip():
        return table.limit(0)
    rank = F.when(F.col("id").cast("string") == value, 1).when(F.col("slug") == value, 2)
    return table.withColumn("match", rank).where("match is not null").orderBy("match", "id").limit(1).drop("match")


def by_ids(table: DataFrame, ids: list, most: int = 50) -> DataFrame:
    """Rows of the ids in the order asked, repeated as asked, with pos; missing ones are skipped. Blanks are dropped first."""
    asked = [str(i).strip() for i in ids if str(i).strip()][:most]
    wanted = table.sparkSession.createDataFrame(list(enumerate(asked)), "pos int, wanted string")
    return table.join(F.broadcast(wanted), F.col("id").cast("string") == F.col("wanted")).drop("wanted").orderBy("pos")


def by_price_url(site_prices: DataFrame, url: str) -> DataFrame:
    """The product that lists the url; none if several do."""
    hits = site_prices.where(F.col("product_url") == url).select("product_id").distinct()
    return hits.groupBy().agg(F.count("*").alias("n"), F.min("product_id").alias("product_id")).where("n = 1").select("product_id")


def find_by(table: DataFrame, column: str, value) -> DataFrame:
    """Rows by a secondary key: slug, status, username, email, base URL or category; a null value finds nothing."""
    return table.where(F.col(column) == F.lit(value))


def count_by(table: DataFrame, column: str, value) -> DataFrame:
    """(n): how many rows have that secondary key."""
    return find_by(table, column, value).agg(F.count("*").alias("n"))


def children(rows: DataFrame, **keys) -> DataFrame:
    """Rows of one parent, by one key or several: reviews of a product or of its site, a user's wishlist or saved searches, pending ones by status."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def listing(table: DataFrame, text: str | None = None, category: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """A page by id of the rows whose name holds the text and whose category is that, with their total number."""
    if text:
        table = table.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if category:
        table = table.where(F.col("category") == category)
    size = max(1, min(100, size))
    total = table.count()
    return table.orderBy("id").offset(max(0, page) * size).limit(size).withColumn("total", F.lit(total))


def sellers(table: DataFrame, category: str | None = None, city: str | None = None, verified: bool | None = None) -> DataFrame:
    """The first filter given wins: verified, else category in capitals, else city in any case, else all."""
    if verified:
        return table.where("verified = true")
    if category:
        return table.where(F.array_contains("categories", category.upper()))
    if city:
        return table.where(F.lower("city") == city.lower())
    return table


def suggest(products: DataFrame, site_prices: DataFrame) -> DataFrame:
    """(id, name, slug, category, lowest_price, seller_count, image_url); a slug or image that the table has no column for is null."""
    n = site_prices.groupBy("product_id").agg(F.count("*").alias("n"))
    held = {c: F.col(c) if c in products.columns else F.lit(None).cast("string").alias(c) for c in ("slug", "image_url")}
    return products.join(n, F.col("id") == F.col("product_id"), "left").select("id", "name", held["slug"], "category", "lowest_price", F.coalesce("n", F.lit(0)).alias("seller_count"), held["image_url"])


def preview(products: DataFrame) -> DataFrame:
    """(id, name, price, badge, category): whole price, a badge for more than one seller, category in capitals."""
    badge = F.when(F.col("seller_count") > 1, F.concat(F.col("seller_count").cast("string"), F.lit(" sellers")))
    return products.select("id", "name", F.floor("lowest_price").cast("long").alias("price"), badge.alias("badge"), F.upper("category").alias("category"))


def recent_queries(jobs: DataFrame, jobs_read: int = 10, most: int = 5) -> DataFrame:
    """Distinct queries of the newest jobs (query, started_at, id), newest first."""
    newest = jobs.orderBy(F.desc("started_at"), F.desc("id")).limit(jobs_read).where("query is not null")
    rank = F.row_number().over(Window.orderBy(F.desc("started_at"), F.desc("id")))  # ten rows
    return newest.withColumn("rank", rank).groupBy("query").agg(F.min("rank").alias("rank")).orderBy("rank").limit(most)


def wishlist(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with their product; missing marks products that are gone, not those without a name."""
    found = products.withColumnRenamed("id", "product_id").withColumn("missing", F.lit(False))
    return items.join(found, "product_id", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))


#: What an operator's console shows of a shop; columns that a table lacks are null.
CONSOLE = ["slug", "name", "base_url", "sitemap_url", "platform", "requires_js", "categories", "status", "health", "consecutive_failures", "needs_retry", "last_indexed_at", "last_indexed_count", "last_error"]


def shop_console(shops: DataFrame) -> DataFrame:
    """The console's fourteen columns of each shop, by slug."""
    return shops.select(*[F.col(c) if c in shops.columns else F.lit(None).cast("string").alias(c) for c in CONSOLE]).orderBy("slug")


def site_kinds(sites: DataFrame) -> DataFrame:
    """(slug, name, kind): generic for the extractor of that slug, else site-specific."""
    return sites.select("slug", "name", F.when(F.col("slug") == "generic", "generic").otherwise("site-specific").alias("kind"))


def newest(rows: DataFrame, column: str, key: str, limit: int, most: int) -> DataFrame:
    """The newest rows by an instant and a key that breaks ties, 1 to most of them: audit entries, index runs, searches."""
    return rows.orderBy(F.desc(column), F.desc(key)).limit(max(1, min(most, limit)))


def canary_summary(checks: DataFrame) -> DataFrame:
    """(checks, failed, slowest_ms, ok) of probe searches (query, total, latency_ms, error): ok if each found something without an error."""
    good = F.col("error").isNull() & (F.coalesce("total", F.lit(0)) > 0)
    return checks.agg(F.count("*").alias("checks"), F.count_if(~good).alias("failed"), F.max("latency_ms").alias("slowest_ms"), F.coalesce(F.bool_and(good), F.lit(False)).alias("ok"))


def catalog_totals(products: DataFrame, reviews: DataFrame, history: DataFrame) -> DataFrame:
    """(products, reviews, history): row counts, from file footers where nothing else is read."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = F.lit(1).alias("one")
    return count(products, "products").select(one, "products").join(count(reviews, "reviews").select(one, "reviews"), "one").join(count(history, "history").select(one, "history"), "one").drop("one")
