"""File sources and sinks: shop catalog, sitemaps, seller inventories, partitioned history."""

from __future__ import annotations

import gzip
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.functions.text import xml_escape
from cataloom.functions.urls import is_sitemap_product

SHOP = "slug string, name string, baseUrl string, sitemapUrl string, searchUrlTemplate string, platform string, categories array<string>, requiresJs boolean"


def shop_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of shops; requiresJs defaults to false."""
    rows = spark.read.schema(SHOP).option("multiLine", True).json(path)
    return rows.withColumn("requiresJs", F.coalesce("requiresJs", F.lit(False)))


#: Size of a seller's upload.
MOST_BYTES = 1_000_000


def inventory(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """(line, name, price, image_url, product_url, category, description, in_stock) of a seller's CSV, first most lines.

    Header in any case; name and price are required; "" stands for a quote in a quoted cell, and a cell ends with its line.
    Missing columns are null. A file is 1 MB at most (ValueError beyond that), so it is one split and its lines keep their order.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() > MOST_BYTES:
        raise ValueError("an inventory has 1 MB at most")
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    if not {"name", "price"} <= set(names):
        raise ValueError("name and price columns are required")
    cell = lambda c: F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")
    order = Window.orderBy(F.monotonically_increasing_id())  # an upload has 1 MB at most
    pairs = (("name", "name"), ("price", "price"), ("imageurl", "image_url"), ("producturl", "product_url"), ("category", "category"), ("description", "description"), ("instock", "in_stock"))
    return raw.select(F.row_number().over(order).alias("line"), *[cell(c).alias(n) for c, n in pairs]).where(F.col("line") <= most)


def sitemap_locations(body: bytes | str | None) -> tuple[list[str], list[str]]:
    """(child sitemaps, page URLs) of a sitemap; gzip is known by its first bytes; what can't be read is empty."""
    import re
    from html import unescape

    if not body:
        return [], []
    raw = body.encode() if isinstance(body, str) else body
    try:
        text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace")
    except OSError:
        return [], []
    found = lambda tag: [unescape(m.strip()) for m in re.findall(rf"<{tag}\b.*?<loc>\s*(.*?)\s*</loc>", text, re.S | re.I)]
    return found("sitemap"), found("url")


def crawl_sitemap(url: str, fetch: Callable[[str], bytes | str | None], spark: SparkSession, most: int = 1500, depth: int = 3) -> DataFrame:
    """(pos, url): product pages of a site's map, children first to last, three levels down, each once.

    The walk is a few requests; what it finds is filtered as a DataFrame.
    """
    seen: set[str] = set()
    pages: list[str] = []

    def walk(at: str, level: int) -> None:
        if at in seen or level > depth:
            return
        seen.add(at)
        children, urls = sitemap_locations(fetch(at))
        for child in children:
            walk(child, level + 1)
        pages.extend(urls)

    walk(url, 0)
    rows = spark.createDataFrame(list(enumerate(pages)), "pos int, url string").where(is_sitemap_product(F.col("url")))
    return rows.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos").limit(most).select("pos", "url")


# Pages of every sitemap with how often they change and their priority; what holds for products.
FIXED_PAGES = [("/", "daily", "1.0"), ("/sellers", "weekly", "0.5"), ("/compare", "monthly", "0.3"), ("/submit-shop", "monthly", "0.3")]
PRODUCT_PAGE = ("daily", "0.7")


def sitemap_lines(products: DataFrame, base: str, day: str, most: int = 50_000) -> DataFrame:
    """(pos, line): <url> entries, of five indented lines each, of the fixed pages and of the first most products by id, by slug or else id, escaped."""
    key = F.coalesce(F.nullif(F.trim("slug"), F.lit("")), F.col("id").cast("string"))
    row = lambda freq, priority: [F.lit(freq).alias("freq"), F.lit(priority).alias("priority")]
    chosen = products.select(F.col("id").cast("long").alias("pos"), F.concat(F.lit(f"{base}/product/"), key).alias("loc"), *row(*PRODUCT_PAGE)).orderBy("pos").limit(most)
    fixed = products.sparkSession.createDataFrame([(i - len(FIXED_PAGES), base + p, f, w) for i, (p, f, w) in enumerate(FIXED_PAGES)], "pos long, loc string, freq string, priority string")
    tag = lambda name, x: F.concat(F.lit(f"    <{name}>"), x, F.lit(f"</{name}>\n"))
    entry = F.concat(F.lit("  <url>\n"), tag("loc", xml_escape(F.col("loc"))), tag("lastmod", F.lit(day)), tag("changefreq", F.col("freq")), tag("priority", F.col("priority")), F.lit("  </url>"))
    return fixed.unionByName(chosen).select("pos", entry.alias("line"))


def append_by_day(rows: DataFrame, path: str, instant: str) -> None:
    """Append rows to a table partitioned by the day of a column, so that relative windows and expiry prune partitions."""
    rows.withColumn("day", F.to_date(instant)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def sitemap_document(products: DataFrame, base: str, day: str) -> DataFrame:
    """(pos, line): sitemap_lines() between the XML head, the opened urlset and its end."""
    frame = [(-6, '<?xml version="1.0" encoding="UTF-8"?>'), (-5, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), ((1 << 63) - 1, "</urlset>")]
    return products.sparkSession.createDataFrame(frame, "pos long, line string").unionByName(sitemap_lines(products, base.rstrip("/"), day))


def robots(spark: SparkSession, base: str) -> DataFrame:
    """(pos, line) of robots.txt: everything is open but the admin's paths, and where the sitemap is."""
    lines = ["User-agent: *", "Allow: /", "Disallow: /admin", "Disallow: /api/admin/", "", f"Sitemap: {base.rstrip('/')}/sitemap.xml"]
    return spark.createDataFrame(list(enumerate(lines)), "pos int, line string")


def write_sitemap(products: DataFrame, base: str, day: str, path: str) -> None:
    """The sitemap as text files; a map has 50,000 entries at most, so one sorted task writes it."""
    sitemap_document(products, base, day).orderBy("pos").select("line").coalesce(1).write.mode("overwrite").text(path)
