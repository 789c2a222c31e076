"""Changes as table rewrites: a new version of a table from the old one and the change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.numbers import csv_price
from cataloom.functions.text import better_name, blank_to_null
from cataloom.functions.text import slug as slug_of
from cataloom.operators.prices import at


def upsert(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows replace base's rows of their key."""
    return base.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    """base without the rows of the keys, by all columns of keys."""
    return base.join(keys.distinct(), keys.columns, "left_anti")


def live(rows: DataFrame, as_of: str, days: int = 30, column: str = "ts") -> DataFrame:
    """What a time-to-live of that many days keeps."""
    return rows.where(F.col(column) > at(as_of) - F.expr(f"interval {int(days)} days"))


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set columns of the rows that changes name; a column changes where has_<column> is true, to null as well."""
    renamed = changes.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in columns], *[F.coalesce(f"has_{c}", F.lit(False)).alias(f"has_{c}") for c in columns])
    new = [F.when(F.col(f"has_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return base.join(renamed, key, "left").select(*new)


STATUSES = ["active", "paused", "blocked", "dormant", "degraded"]


def set_status(shops: DataFrame, slugs: DataFrame, status: str) -> DataFrame:
    """Set the status of the shops named; active also clears consecutive_failures."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    hit = F.col("hit").isNotNull()
    failures = F.when(hit & F.lit(status == "active"), 0).otherwise(F.col("consecutive_failures"))
    marked = shops.join(slugs.select("slug").distinct().withColumn("hit", F.lit(1)), "slug", "left")
    return marked.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("consecutive_failures", failures).select(*shops.columns)


def seed(shops: DataFrame, catalog: DataFrame, fixed: list[str]) -> DataFrame:
    """Shops after seeding by slug: catalog sets the fixed columns, crawl state stays, new shops are active."""
    state = [c for c in shops.columns if c not in fixed and c != "slug"]
    both = shops.alias("s").join(catalog.alias("c"), "slug", "full_outer")
    columns = [F.coalesce(f"c.{c}", f"s.{c}").alias(c) for c in fixed]
    columns += [(F.coalesce("s.status", F.lit("active")) if c == "status" else F.col(f"s.{c}")).alias(c) for c in state]
    return both.select("slug", *columns)


def merge_products(site_prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(product_id, site_id, price, lowest_price, highest_price) after merging pairs (from_id, to_id), where a site lists a product once.

    Prices of both are united, the target's row wins for a site, and only the extremes are computed again.
    """
    to = F.coalesce("to_id", "product_id")
    moved = site_prices.join(pairs, F.col("product_id") == F.col("from_id"), "left").select(to.alias("product_id"), "site_id", "price", F.col("to_id").isNotNull().cast("int").alias("side"))
    kept = moved.groupBy("product_id", "site_id").agg(F.min_by("price", F.struct("side", "price")).alias("price"))
    everything = Window.partitionBy("product_id")
    return kept.withColumn("lowest_price", F.min("price").over(everything)).withColumn("highest_price", F.max("price").over(everything))


def merge_codes(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (from_id, to_id) with code: 400 without a source or of a product with itself, 404 for unknown ones, 409 where the target is itself merged away, 200 else."""
    ids = products.select("id").distinct()
    sources = pairs.where("from_id is not null and from_id <> to_id").select(F.col("from_id").alias("chained")).distinct()
    known = pairs.join(ids.select(F.col("id").alias("from_known")), F.col("from_id") == F.col("from_known"), "left").join(ids.select(F.col("id").alias("to_known")), F.col("to_id") == F.col("to_known"), "left")
    known = known.join(sources, F.col("to_id") == F.col("chained"), "left")
    code = F.when(F.col("from_id").isNull() | (F.col("from_id") == F.col("to_id")), 400).when(F.col("from_known").isNull() | F.col("to_known").isNull(), 404).when(F.col("chained").isNotNull(), 409)
    return known.select(*pairs.columns, code.otherwise(200).alias("code"))


def merge_catalog(products: DataFrame, site_prices: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products (id, category, image_url, description, lowest_price, highest_price, ...) and their prices (product_id, product_url, price, ...) after merging pairs (from_id, to_id).

    Only pairs of code 200 count (merge_codes); of several targets of one source the smallest id does. A target keeps its own
    prices and gets those of its sources whose URL it lacks, each URL once, that of the smallest source; a missing URL is
    an URL like others. Its extremes are computed again; image, description and category come from the smallest source that has
    one where the target has none. Sources are deleted.
    """
    good = merge_codes(products, pairs).where("code = 200").groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    moved = site_prices.join(good, F.col("product_id") == F.col("from_id"))
    names = site_prices.columns
    row = F.struct(*[F.col(c) for c in names])
    once = moved.groupBy("to_id", "product_url").agg(F.min_by(row, F.struct("from_id", "price")).alias("r")).select("to_id", "r.*")
    targets = good.select("to_id").distinct()
    held = site_prices.join(targets, F.col("product_id") == F.col("to_id"), "left_semi").select(F.col("product_id").alias("has_id"), F.col("product_url").alias("has_url")).distinct()
    added = once.join(held, (F.col("to_id") == F.col("has_id")) & F.col("product_url").eqNullSafe(F.col("has_url")), "left_anti")
    added = added.select(*[F.col("to_id").alias(c) if c == "product_id" else F.col(c) for c in names])
    prices = site_prices.join(good, F.col("product_id") == F.col("from_id"), "left_anti").unionByName(added)
    extremes = prices.join(targets, F.col("product_id") == F.col("to_id"), "left_semi").groupBy(F.col("product_id").alias("x_id")).agg(F.min("price").alias("low"), F.nullif(F.max("price"), F.lit(0.0)).alias("high"))
    filled = ["image_url", "description", "category"]
    lent = good.join(products, F.col("from_id") == F.col("id")).groupBy(F.col("to_id").alias("l_id")).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("from_id"))).alias(f"lent_{c}") for c in filled])
    left = products.join(good, F.col("id") == F.col("from_id"), "left_anti").join(targets, F.col("id") == F.col("to_id"), "left").join(lent, F.col("id") == F.col("l_id"), "left").join(extremes, F.col("id") == F.col("x_id"), "left")
    merged = F.col("to_id").isNotNull()
    new = {c: F.coalesce(c, f"lent_{c}") for c in filled} | {"lowest_price": F.when(merged, F.col("low")).otherwise(F.col("lowest_price")), "highest_price": F.when(merged, F.col("high")).otherwise(F.col("highest_price"))}
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in products.columns]), prices


def inventory_upsert(site_prices: DataFrame, cells: DataFrame, seller: str, seller_url: str, most: int = 500) -> DataFrame:
    """(product_url, site_slug, price) after a seller's upload (line, name, price, product_url).

    The first most lines count. Lines without a name or with a price under 10 are skipped. A line without the url column is at
    the seller's url. The last line of a url wins and replaces the seller's price there.
    """
    good = _good_lines(cells, seller_url, most)
    last = good.groupBy("product_url").agg(F.max_by("price", "line").alias("price")).withColumn("site_slug", F.lit(seller))
    return upsert(site_prices.select("product_url", "site_slug", "price"), last.select("product_url", "site_slug", "price"), ["product_url", "site_slug"])


def _good_lines(cells: DataFrame, seller_url, most: int) -> DataFrame:
    rows = cells.where(F.col("line") <= most)
    rows = rows.withColumn("name", blank_to_null(F.col("name"))).withColumn("price", csv_price(F.col("price"))).withColumn("product_url", F.coalesce("product_url", F.lit(seller_url)))
    return rows.where((F.length("name") >= 2) & (F.col("price") >= 10))


def inventory_load(products: DataFrame, site_prices: DataFrame, sellers: DataFrame, slug: str, cells: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products (id, name, slug, category, image_url, description, lowest_price), prices (product_id, site_slug, product_url, price, in_stock) and the counts (created, merged, skipped) after a seller's upload.

    cells are lines (line, name, price, image_url, product_url, category, description, in_stock). The seller is the one of slug; an unknown slug
    raises LookupError. A line whose URL a product lists replaces this seller's prices there; the others make a product for
    each URL, from its first line, and its later lines replace the price. Of a product's lines the last one's price stays, and
    the lowest price only falls. Sellers are few: one is read by the driver.
    """
    found = sellers.where(F.col("slug") == slug).select("slug", "url").first()
    if found is None:
        raise LookupError(f"unknown seller {slug}")
    good = _good_lines(cells, found["url"], most)
    listed = site_prices.groupBy("product_url").agg(F.min("product_id").cast("string").alias("known_id"))
    lines = good.join(listed, "product_url", "left").withColumn("target", F.coalesce("known_id", F.concat(F.lit("new:"), "product_url")))
    stock = ~F.coalesce(F.lower("in_stock") == "false", F.lit(False))
    last = F.struct("product_url", "price", stock.alias("in_stock"))
    first = F.struct("name", "category", "image_url", "description")
    done = lines.groupBy("target").agg(F.max_by(last, "line").alias("l"), F.min_by(first, "line").alias("f"), F.min("price").alias("low"), F.max("known_id").alias("known_id"), F.count("*").alias("n"))
    touched = done.select(F.col("target").alias("product_id"), F.lit(slug).alias("site_slug"))
    old = site_prices.withColumn("product_id", F.col("product_id").cast("string"))
    prices = old.join(touched, ["product_id", "site_slug"], "left_anti").unionByName(done.select(F.col("target").alias("product_id"), F.lit(slug).alias("site_slug"), "l.product_url", "l.price", "l.in_stock"), allowMissingColumns=True)
    lows = done.where("known_id is not null").select(F.col("target").alias("id"), "low")
    kept = products.withColumn("id", F.col("id").cast("string")).join(lows, "id", "left").withColumn("lowest_price", F.least("lowest_price", "low")).drop("low")
    new = done.where("known_id is null").select(
        F.col("target").alias("id"), "f.name", slug_of(F.concat(F.lit(f"{slug}-"), F.col("f.name"))).alias("slug"),
        *[blank_to_null(F.col(f"f.{c}")).alias(c) for c in ("category", "image_url", "description")], F.col("low").alias("lowest_price"),
    )
    created = F.coalesce(F.count_if(F.col("known_id").isNull()), F.lit(0))
    counts = done.agg(created.alias("created"), (F.coalesce(F.sum("n"), F.lit(0)) - created).alias("merged")).crossJoin(cells.where(F.col("line") <= most).agg(F.count("*").alias("lines")))  # one row each
    return kept.unionByName(new, allowMissingColumns=True), prices, counts.select("created", "merged", (F.col("lines") - F.col("created") - F.col("merged")).alias("skipped"))


def load_offers(products: DataFrame, site_prices: DataFrame, resolved: DataFrame, intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and prices after the offers of a run, which are resolved already (operators.resolve).

    products (id, name, slug, category, brands, image_url), prices (product_id, site_slug, product_url, price), resolved (product_id,
    how, shop_id, url, name, price, image_url), intents (name, category, brands) of the new names. An offer whose URL is known replaces that URL's price; one
    found by name replaces its shop's price of that product; other groups are new products, named by their first offer and
    classified. The longest name of 200 characters at most wins, an image is taken only where there is none.
    """
    priced = resolved.where("name is not null and price >= 10")
    row = F.struct("url", "price")
    by_url = priced.where("how = 'url'").select("product_id", F.col("shop_id").cast("string").alias("site_slug"), F.col("url").alias("product_url"), "price")
    by_name = priced.where("how <> 'url'").groupBy("product_id", F.col("shop_id").cast("string").alias("site_slug")).agg(F.max_by(row, row).alias("r")).select("product_id", "site_slug", F.col("r.url").alias("product_url"), "r.price")
    old = site_prices.withColumn("product_id", F.col("product_id").cast("string")).withColumn("site_slug", F.col("site_slug").cast("string"))
    kept = old.join(by_url.select("product_id", "product_url"), ["product_id", "product_url"], "left_anti").join(by_name.select("product_id", "site_slug"), ["product_id", "site_slug"], "left_anti")
    prices = kept.select("product_id", "site_slug", "product_url", "price").unionByName(by_url).unionByName(by_name)
    order = F.struct("shop_id", "url")
    said = priced.groupBy("product_id").agg(
        F.max_by("name", F.when(F.length("name") <= 200, F.struct(F.length("name").alias("n"), "name"))).alias("best"), F.min_by("name", order).alias("first_name"),
        F.min_by("image_url", F.when(F.col("image_url").isNotNull(), order)).alias("image"), F.min("how").alias("how"),
    )
    base = products.withColumn("id", F.col("id").cast("string")).join(said.select(F.col("product_id").alias("id"), "best", "image"), "id", "left")
    base = base.withColumn("name", better_name(F.col("name"), F.col("best"))).withColumn("image_url", F.coalesce("image_url", "image")).select(*products.columns)
    fresh = said.where("how = 'new'").join(intents.select(F.col("name").alias("first_name"), "category", "brands").dropDuplicates(["first_name"]), "first_name", "left")
    new = fresh.select(F.col("product_id").alias("id"), better_name(F.col("first_name"), F.col("best")).alias("name"), slug_of(F.col("first_name")).alias("slug"), "category", "brands", F.col("image").alias("image_url"))
    return base.unionByName(new, allowMissingColumns=True), prices


def shop_submissions(rows: DataFrame, shops: DataFrame, pending: DataFrame) -> DataFrame:
    """rows (name, base_url, ...) with code: 400 for a bad name or url, 409 for a known one, 202 else.

    A base url without its trailing slash must differ from shops' in any case and from pending ones' as written.
    """
    base = F.regexp_replace(F.trim("base_url"), "/$", "")
    valid = F.length(F.trim("name")).between(2, 80) & base.rlike(r"^(?i)https?://[^/?#\s]+")
    known = shops.select(F.lower(F.regexp_replace("base_url", "/$", "")).alias("shop_url")).distinct()
    waiting = pending.select(F.col("base_url").alias("pending_url")).distinct()
    joined = rows.withColumn("base", base).join(known, F.lower("base") == F.col("shop_url"), "left").join(waiting, F.col("base") == F.col("pending_url"), "left")
    code = F.when(~F.coalesce(valid, F.lit(False)), 400).when(F.col("shop_url").isNotNull() | F.col("pending_url").isNotNull(), 409).otherwise(202)
    return joined.withColumn("code", code).drop("base", "shop_url", "pending_url")


def seller_submissions(rows: DataFrame, sellers: DataFrame) -> DataFrame:
    """rows (name, slug, url) with code: 400 for a short name or an url that is none, 409 for a known slug, 202 else."""
    ok = (F.length(F.trim("name")) >= 2) & (F.col("url").rlike("facebook|instagram") | F.col("url").startswith("http"))
    joined = rows.join(sellers.select(F.col("slug").alias("known")).distinct(), F.col("slug") == F.col("known"), "left")
    return joined.withColumn("code", F.when(~F.coalesce(ok, F.lit(False)), 400).when(F.col("known").isNotNull(), 409).otherwise(202)).drop("known")


def wishlist_add(items: DataFrame, wanted: DataFrame, products: DataFrame) -> DataFrame:
    """items with wanted (user_id, product_id) added once, at the product's lowest price."""
    new = wanted.select("user_id", "product_id").distinct().join(items.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
    priced = new.join(products.select(F.col("id").alias("product_id"), F.col("lowest_price").alias("price_at_add")), "product_id", "left")
    return items.unionByName(priced.select(*items.columns))


def approve(pending: DataFrame, shops: DataFrame) -> DataFrame:
    """pending with status: conflict where the slug is taken, else approved."""
    taken = shops.select(F.col("slug").alias("taken")).distinct()
    return pending.join(taken, F.col("slug") == F.col("taken"), "left").withColumn("status", F.when(F.col("taken").isNotNull(), "conflict").otherwise("approved")).drop("taken")


def review(pending: DataFrame, shops: DataFrame, decisions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pending, shops, codes) after decisions (id, approve, note) on pending shops (id, name, base_url, sitemap_url, platform, categories, status, reviewed_at, review_note).

    An approved shop is inserted under the slug of its name, or of its URL without one, active and healthy; where the slug is taken, or an
    earlier decision takes it, the code is 409 and nothing changes. Unknown ids are 404. A rejection keeps its note.
    """
    found = decisions.join(pending, "id", "left").withColumn("slug", slug_of(F.coalesce("name", "base_url")))
    taken = shops.select(F.col("slug").alias("taken")).distinct()
    found = found.join(taken, F.col("slug") == F.col("taken"), "left")
    unknown = F.col("base_url").isNull() & F.col("name").isNull()
    free = found.where(F.col("approve") & F.col("taken").isNull() & ~unknown).groupBy("slug").agg(F.min("id").alias("winner"))
    found = found.join(free.withColumnRenamed("slug", "free_slug"), F.col("slug") == F.col("free_slug"), "left")
    code = F.when(unknown, 404).when(F.col("approve") & ~F.coalesce(F.col("winner") == F.col("id"), F.lit(False)), 409).otherwise(200)
    coded = found.withColumn("code", code)
    done = coded.where("code = 200").select("id", F.when(F.col("approve"), "approved").otherwise("rejected").alias("new_status"), F.when(~F.col("approve"), F.col("note")).alias("new_note"))
    after = pending.join(done, "id", "left").withColumn("status", F.coalesce("new_status", "status")).withColumn("review_note", F.coalesce("new_note", "review_note"))
    after = after.withColumn("reviewed_at", F.when(F.col("new_status").isNotNull(), at(as_of)).otherwise(F.col("reviewed_at"))).select(*pending.columns)
    new = coded.where("code = 200 and approve").select("slug", "name", "base_url", "sitemap_url", "platform", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.lit("active").alias("status"), F.lit("active").alias("health"))
    return after, shops.unionByName(new, allowMissingColumns=True), coded.select("id", "code")


def add_saved_searches(rows: DataFrame) -> DataFrame:
    """Searches to be saved (user_id, query, email) with code: 401 without a user, 400 for a query under two characters, 200 else; queries are trimmed."""
    query = F.trim("query")
    code = F.when(F.col("user_id").isNull(), 401).when(F.coalesce(F.length(query), F.lit(0)) < 2, 400).otherwise(200)
    return rows.withColumn("query", query).withColumn("code", code)


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(inserted, merged, failed, extracted) of an index run's outcomes."""
    return outcomes.agg(
        F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "merged").alias("merged"),
        F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") != "failed").alias("extracted"),
    )


def unknown_hosts(hosts: DataFrame, *known: DataFrame) -> DataFrame:
    """Distinct hosts that no known table has."""
    found = hosts.select("host").where("host is not null").distinct()
    for table in known:
        found = found.join(table.select("host").distinct(), "host", "left_anti")
    return found


