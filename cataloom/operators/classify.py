"""Query classification: dictionary hits as an equality join of token n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.text import normalise_query
from cataloom.session import small_side

MODEL_TOKEN = r"^[a-z0-9]*\d+[a-z0-9]*$"


#: Rows of a dictionary that is broadcast (some 10 MB); a larger one is joined by a shuffle.
BROADCAST_TERMS = 100_000


def longest(terms: DataFrame, column: str) -> int:
    """How many words the longest term of a dictionary has; 1 for an empty one."""
    return terms.agg(F.max(F.size(F.split(F.trim(column), r"\s+")))).first()[0] or 1


def ngrams(queries: DataFrame, longest: int) -> DataFrame:
    """(query_id, place, gram, words): all runs of up to longest tokens of the normalised query; a word-bounded hit is one of them."""
    tokens = queries.select("query_id", F.filter(F.split(normalise_query(F.col("query")), " "), lambda t: F.length(t) > 0).alias("t"))
    exploded = None
    for n in range(1, longest + 1):
        at = tokens.where(F.size("t") >= n).select("query_id", F.explode(F.sequence(F.lit(1), F.size("t") - (n - 1))).alias("start"), "t")
        part = at.select("query_id", (F.col("start") + (n - 1)).alias("place"), F.array_join(F.slice("t", F.col("start"), n), " ").alias("gram"), F.lit(n).alias("words"))
        exploded = part if exploded is None else exploded.unionByName(part)
    return exploded


def scores(queries: DataFrame, keywords: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """(query_id, category, ordinal, score): 3 for each hit of several words, 2 for each of one, 1 for a brand's leaning, once.

    Runs of tokens are as long as the longest term of the dictionaries.
    """
    grams = ngrams(queries, max(longest(keywords, "keyword"), longest(brands, "brand")))
    hit = grams.join(small_side(keywords.withColumnRenamed("keyword", "gram"), BROADCAST_TERMS), "gram").select("query_id", "category", F.when(F.col("words") > 1, 3).otherwise(2).alias("points"))
    leaning = grams.join(small_side(brands.withColumnRenamed("brand", "gram"), BROADCAST_TERMS), "gram").select("query_id", "category").distinct().withColumn("points", F.lit(1))
    total = hit.unionByName(leaning).groupBy("query_id", "category").agg(F.sum("points").alias("score"))
    return total.join(F.broadcast(categories.select(F.col("name").alias("category"), "ordinal")), "category")


def classify(queries: DataFrame, keywords: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """(query_id, categories, confidence): categories of half the best score or more, best first, GENERAL without any.

    Ties go by the categories' order. Confidence is 0 without a hit; a fifth of the best score with one category scored; else a
    fifth of the lead over the second plus one; 1 at most.
    """
    found = scores(queries, keywords, brands, categories)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    everything = Window.partitionBy("query_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("top", F.max("score").over(everything))
    per_query = ranked.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(2 * F.col("score") >= F.col("top"), F.struct("rank", "category")))), lambda x: x["category"]).alias("categories"),
        F.max("top").alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    lead = F.when(F.col("second").isNull(), F.col("top")).otherwise(F.col("top") - F.col("second") + 1)
    confidence = F.least(F.lit(1.0), lead / 5.0)
    return queries.select("query_id").join(per_query, "query_id", "left").select(
        "query_id", F.coalesce("categories", F.array(F.lit("GENERAL"))).alias("categories"), F.when(F.col("top").isNull(), 0.0).otherwise(confidence).alias("confidence")
    )


def brand_mentions(queries: DataFrame, brands: DataFrame) -> DataFrame:
    """(query_id, brands): every occurrence, by where it ends."""
    names = brands.select(F.col("brand").alias("gram")).distinct()
    hits = ngrams(queries, longest(brands, "brand")).join(small_side(names, BROADCAST_TERMS), "gram")
    return hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("brands"))


def model_tokens(normalised):
    """Tokens of two characters or more that hold a digit, as an expression."""
    return F.filter(F.split(normalised, " "), lambda t: (F.length(t) >= 2) & t.rlike(MODEL_TOKEN))


def primary_category(categories):
    """The first category, or GENERAL."""
    return F.coalesce(F.get(categories, F.lit(0)), F.lit("GENERAL"))


def has_category(categories, name: str):
    return F.array_contains(categories, name)


def has_any_category(categories, names: list[str]):
    return F.arrays_overlap(categories, F.array(*map(F.lit, names)))
