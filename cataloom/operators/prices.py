"""Price-history analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.numbers import round1


def at(instant: str) -> Column:
    """A literal instant without zone."""
    return F.to_timestamp_ntz(F.lit(instant))


def since(instant: str, days: int) -> Column:
    return at(instant) - F.expr(f"interval {int(days)} days")


def hot_drops(history: DataFrame, products: DataFrame, as_of: str, days: int = 7, limit: int = 24) -> DataFrame:
    """Products whose price is well under the window's peak: (id, name, price, peak, drop_pct), largest drops first.

    The window filter reaches the scan, and history shrinks to a row for each product before it meets them. The tenth is
    tested in double arithmetic: 110 is not enough for 100.
    """
    peaks = history.where(F.col("recorded_at") >= since(as_of, days)).groupBy("product_id").agg(F.max("price").alias("peak"))
    price = F.col("lowest_price")
    found = products.where(price > 0).join(peaks, F.col("id") == F.col("product_id")).where((F.col("peak") > price) & (F.col("peak") >= price * 1.10))
    drop = round1((F.col("peak") - price) / F.col("peak") * 100.0)
    return found.select("id", "name", price.alias("price"), "peak", drop.alias("drop_pct")).orderBy(F.desc("drop_pct"), "id").limit(max(1, min(24, limit)))


def drop_categories(drops: DataFrame) -> DataFrame:
    """(category, n) of drops; null is 'other'."""
    return drops.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


def daily_series(history: DataFrame, products: DataFrame, today: str, days: int) -> DataFrame:
    """(product_id, day, price) for each day up to today, gaps filled forward.

    A day's value is its earliest observation, ties to the smallest site. Nothing older than the window is carried in; a product
    without observations keeps its lowest price on all days. days is clamped: 30 for 0 or less, 365 at most.
    """
    days = 30 if days <= 0 else min(days, 365)
    last = F.to_date(F.lit(today))
    first = F.date_sub(last, days - 1)
    key = [c for c in ("recorded_at", "site_id", "order_id", "line") if c in history.columns]
    day = F.to_date("recorded_at")
    daily = history.where(day.between(first, last)).groupBy("product_id", day.alias("day")).agg(F.min_by("price", F.struct(*key)).alias("seen"))
    grid = products.select(F.col("id").alias("product_id"), "lowest_price", F.explode(F.sequence(first, last)).alias("day"))
    up_to = Window.partitionBy("product_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("product_id")
    filled = grid.join(daily, ["product_id", "day"], "left").withColumn("filled", F.last("seen", ignorenulls=True).over(up_to)).withColumn("n", F.count("seen").over(everything))
    return filled.select("product_id", "day", F.when(F.col("n") == 0, F.col("lowest_price")).otherwise(F.col("filled")).alias("price"))


def snapshot(site_prices: DataFrame, as_of: str, currency: str = "BDT") -> DataFrame:
    """History rows of all sites that have a price, at one shared instant."""
    coin = F.coalesce("currency", F.lit(currency)) if "currency" in site_prices.columns else F.lit(currency)
    return site_prices.where("price is not null").select("product_id", "site_id", "price", coin.alias("currency"), at(as_of).alias("recorded_at"))


def _aggregates() -> list[Column]:
    mean = F.sum(F.col("rating").cast("decimal(18,6)")).cast("double") / F.count("rating")
    return [
        F.min("price").alias("lowest_price"),
        F.nullif(F.max("price"), F.lit(0.0)).alias("highest_price"),
        round1(mean).alias("average_rating"),
        F.nullif(F.sum("review_count"), F.lit(0)).alias("total_reviews"),
    ]


def product_aggregates(site_prices: DataFrame) -> DataFrame:
    """(product_id, lowest_price, highest_price, average_rating, total_reviews); zero reviews and a zero highest price are null."""
    return site_prices.groupBy("product_id").agg(*_aggregates())


def offer_summary(site_prices: DataFrame) -> DataFrame:
    """(product_id, seller_count, best_discount, any_in_stock): best_discount is 0 at least where a discount is known."""
    return site_prices.groupBy("product_id").agg(
        F.count("*").alias("seller_count"),
        F.when(F.count("discount") > 0, F.greatest(F.lit(0.0), F.max("discount"))).alias("best_discount"),
        F.coalesce(F.bool_or("in_stock"), F.lit(False)).alias("any_in_stock"),
    )


#: Compared attributes: key, whether higher is better, null for text.
COMPARED = [("lowestPrice", False), ("highestPrice", False), ("averageRating", True), ("totalReviews", True), ("sellerCount", True), ("category", None), ("savings", True), ("discount", True), ("anyInStock", True)]


def compare_matrix(products: DataFrame, site_prices: DataFrame, ids: list[int]) -> DataFrame:
    """(attribute, pos, product_id, number, text, best): up to four products side by side; missing ids are skipped.

    best marks the first product with an attribute's best value; text attributes have none.
    """
    spark = products.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "asked int, id long")
    offers = site_prices.join(F.broadcast(asked.select(F.col("id").alias("product_id")).distinct()), "product_id")
    facts = product_aggregates(offers).join(offer_summary(offers), "product_id")
    order = Window.orderBy("asked")  # four rows
    chosen = products.drop("lowest_price").join(F.broadcast(asked), "id").withColumn("pos", F.row_number().over(order) - 1).where("pos < 4")
    wide = chosen.join(facts, F.col("id") == F.col("product_id"), "left")
    savings = F.when(F.col("highest_price").isNotNull() & F.col("lowest_price").isNotNull(), F.greatest(F.lit(0.0), F.col("highest_price") - F.col("lowest_price")))
    value = {
        "lowestPrice": F.col("lowest_price"), "highestPrice": F.col("highest_price"), "averageRating": F.col("average_rating"), "totalReviews": F.col("total_reviews").cast("double"),
        "sellerCount": F.coalesce("seller_count", F.lit(0)).cast("double"), "savings": savings, "discount": F.col("best_discount"), "anyInStock": F.coalesce("any_in_stock", F.lit(False)).cast("double"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("attribute"), value.get(k, F.lit(None).cast("double")).alias("number"), (F.col("category") if up is None else F.lit(None).cast("string")).alias("text"), F.lit(up).cast("boolean").alias("up")) for k, up in COMPARED])
    long = wide.select("pos", F.col("id").alias("product_id"), F.explode(rows).alias("r")).select("pos", "product_id", "r.*")
    ranked = F.row_number().over(Window.partitionBy("attribute").orderBy(F.when(F.col("up"), -F.col("number")).otherwise(F.col("number")).asc_nulls_last(), "pos"))
    best = (ranked == 1) & F.col("number").isNotNull() & F.col("up").isNotNull()
    return long.withColumn("best", best).select("attribute", "pos", "product_id", "number", "text", "best")


def site_dashboard(site_prices: DataFrame, shops: DataFrame) -> DataFrame:
    """(shop_id, name, n_products, status): distinct products listed by each shop; active, down (an error is known) or dormant."""
    counts = site_prices.groupBy("site_id").agg(F.countDistinct("product_id").alias("n"))
    error = F.col("last_error").isNotNull() if "last_error" in shops.columns else F.lit(False)
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 0, "active").when(error, "down").otherwise("dormant")
    return shops.join(counts, F.col("id") == F.col("site_id"), "left").select(F.col("id").alias("shop_id"), "name", n.alias("n_products"), status.alias("status")).orderBy(F.desc("n_products"), "shop_id")


def series(history: DataFrame, product_id: int, newest_first: bool = True) -> DataFrame:
    """A product's history; the argument is an id and no slug."""
    key = [F.desc(c) if newest_first else F.asc(c) for c in ("recorded_at", "order_id", "line")]
    return history.where(F.col("product_id") == product_id).orderBy(*key)
