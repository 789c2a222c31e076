"""Adapters from the driver's tables to the catalog model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.session import table

#: The instants that relative windows end at.
PRICES_AS_OF, EVENTS_AS_OF = "2001-11-05 00:00:00", "2024-01-31 00:00:00"


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, brand, category, lowest_price) from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("lowest_price")
    )


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, site_id, price, recorded_at, order_id, line) from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("site_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("recorded_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
    )


def site_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, site_id, price, discount, rating, review_count, in_stock, last_updated): the latest line of each product and site.

    max_by over one ordering key combines in the map tasks and needs no sort, unlike a window.
    """
    latest = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    row = F.struct("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    picked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("site_id")).agg(F.max_by(row, latest).alias("r"))
    return picked.select(
        "product_id",
        "site_id",
        (F.col("r.l_extendedprice") / F.col("r.l_quantity")).alias("price"),
        F.col("r.l_discount").alias("discount"),
        (F.col("r.l_tax") * 50).alias("rating"),
        F.col("r.l_quantity").cast("int").alias("review_count"),
        (F.col("r.l_linestatus") == "O").alias("in_stock"),
        F.col("r.l_shipdate").alias("last_updated"),
    )


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, nation_id, balance) from supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("balance"))


def shop_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shop_id, at, run_id, ok) from orders: a run fails for status F."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shop_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") != "F").cast("int").alias("ok"))


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, actor, product_id, shop_id, query, result_count, latency_ms, ts) from events; props' k stands for product, shop and query."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        F.col("user_id").alias("actor"),
        k.alias("product_id"),
        (k % 10).alias("shop_id"),
        F.concat(F.lit("term "), k.cast("string")).alias("query"),
        (k % 4).alias("result_count"),
        F.floor(F.col("value")).cast("long").alias("latency_ms"),
        "ts",
    )


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")
