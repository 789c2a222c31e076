"""Click-stream statistics. Types and the end of relative windows are parameters; bounds are strict, as ts > end - window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.numbers import round1
from cataloom.operators.prices import at


def after(as_of: str, seconds: int) -> Column:
    return F.col("ts") > at(as_of) - F.expr(f"interval {int(seconds)} seconds")


DAY = 86400


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def actor(anon: Column, ip: Column) -> Column:
    """The visitor: the anonymous id, else the address hash behind 'ip:'; null if neither is known."""
    return F.coalesce(anon, F.concat(F.lit("ip:"), ip))


def active_users(events: DataFrame, as_of: str, types: list[str]) -> DataFrame:
    """(dau, mau): distinct actors of one and thirty days, one scan.

    Actors are made distinct first with their newest event, so no set of actors meets in one task.
    """
    seen = events.where(F.col("type").isin(types) & after(as_of, 30 * DAY) & F.col("actor").isNotNull()).groupBy("actor").agg(F.max("ts").alias("ts"))
    return seen.agg(F.count_if(after(as_of, DAY)).alias("dau"), F.count("*").alias("mau"))


def live_counters(events: DataFrame, as_of: str, search: str = "search", view: str = "view", seconds: int = 60) -> DataFrame:
    """(active_now, searches_now, searches_day, views_day) in one scan of a day."""
    day = events.where(F.col("type").isin(search, view) & after(as_of, DAY))
    by_actor = day.groupBy("actor").agg(
        F.max(after(as_of, seconds)).alias("now"),
        F.count_if((F.col("type") == search) & after(as_of, seconds)).alias("searches_now"),
        F.count_if(F.col("type") == search).alias("searches_day"),
        F.count_if(F.col("type") == view).alias("views_day"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by_actor.agg(F.count_if(F.col("now") & F.col("actor").isNotNull()).alias("active_now"), total("searches_now"), total("searches_day"), total("views_day"))


def trending(events: DataFrame, as_of: str, search: str = "search", limit: int = 10) -> DataFrame:
    """(query, hits, hits_with_results) of a day's queries of two characters or more, most first."""
    day = events.where((F.col("type") == search) & after(as_of, DAY) & (F.length("query") >= 2))
    return day.groupBy("query").agg(F.count("*").alias("hits"), F.count_if(F.col("result_count") > 0).alias("hits_with_results")).orderBy(F.desc("hits"), "query").limit(clamp(limit, 1, 50))


def zero_results(events: DataFrame, as_of: str, search: str = "search", limit: int = 20) -> DataFrame:
    """(query, hits) of a week's queries that found nothing."""
    week = events.where((F.col("type") == search) & after(as_of, 7 * DAY) & F.col("query").isNotNull() & (F.col("result_count") <= 0))
    return week.groupBy("query").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "query").limit(clamp(limit, 1, 100))


def shop_ctr(events: DataFrame, listings: DataFrame, as_of: str, limit: int = 20, first_views: int | None = None) -> DataFrame:
    """(shop_id, views, clicks, ctr_pct) of a week: a view counts for every shop that lists its product.

    Views are counted by product before they fan out to shops. first_views takes only the first so many, by ts and id.
    """
    week = events.where(after(as_of, 7 * DAY))
    views = week.where((F.col("type") == "view") & F.col("product_id").isNotNull())
    if first_views is not None:
        views = views.orderBy("ts", "id").limit(first_views)
    per_product = views.groupBy("product_id").agg(F.count("*").alias("n"))
    shown = listings.select("product_id", F.col("site_id").alias("shop_id")).distinct().join(per_product, "product_id").groupBy("shop_id").agg(F.sum("n").alias("views"))
    clicked = week.where((F.col("type") == "click") & F.col("shop_id").isNotNull()).groupBy("shop_id").agg(F.count("*").alias("clicks"))
    v, c = F.coalesce("views", F.lit(0)), F.coalesce("clicks", F.lit(0))
    rate = F.when(v == 0, 0.0).otherwise(F.floor(c / v * 1000.0 + 0.5) / 10)
    return clicked.join(shown, "shop_id", "full_outer").select("shop_id", v.alias("views"), c.alias("clicks"), rate.alias("ctr_pct")).orderBy(F.desc("ctr_pct"), "shop_id").limit(clamp(limit, 1, 100))


def latency_percentiles(events: DataFrame, as_of: str, types: list[str]) -> DataFrame:
    """(n, p50, p95, p99) of a day by place in sorted order, null without events; no interpolation.

    Equal latencies are counted first: the running total goes over distinct values, not over events.
    """
    day = events.where(F.col("type").isin(types) & after(as_of, DAY) & (F.col("latency_ms") >= 0))
    counts = day.groupBy("latency_ms").agg(F.count("*").alias("k"))
    upto = Window.orderBy("latency_ms")
    everything = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.select("latency_ms", F.sum("k").over(upto).alias("upto"), F.sum("k").over(everything).alias("n"))
    place = {"p50": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95 + 0.5), "p99": F.floor(F.col("n") * 0.99 + 0.5)}
    value = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, p), F.col("latency_ms")))
    return ranked.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[value(p).alias(k) for k, p in place.items()])


def top_products(events: DataFrame, products: DataFrame, as_of: str, kind: str = "view", limit: int = 20) -> DataFrame:
    """(product_id, n, name) of a week; a product that is gone keeps its id and count."""
    week = events.where((F.col("type") == kind) & after(as_of, 7 * DAY) & F.col("product_id").isNotNull())
    top = week.groupBy("product_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_id").limit(clamp(limit, 1, 50))
    return top.join(products.select(F.col("id").alias("product_id"), "name"), "product_id", "left")


def recent(events: DataFrame, as_of: str, types: list[str], limit: int = 100) -> DataFrame:
    """The newest events of a week."""
    week = events.where(F.col("type").isin(types) & after(as_of, 7 * DAY))
    return week.select("id", "type", "actor", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(clamp(limit, 1, 1000))


def user_history(events: DataFrame, as_of: str, user: int, kind: str = "search", limit: int = 50) -> DataFrame:
    """A user's newest events of thirty days."""
    mine = events.where((F.col("type") == kind) & after(as_of, 30 * DAY) & (F.col("actor") == user))
    return mine.select("id", "query", "result_count", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def by_type_after(events: DataFrame, kind: str, instant: str) -> DataFrame:
    """Events of a type strictly after an instant; both tests reach the scan."""
    return events.where((F.col("type") == kind) & (F.col("ts") > at(instant)))


def rate_percent(part: Column, whole: Column) -> Column:
    return round1(part / whole * 100.0)
