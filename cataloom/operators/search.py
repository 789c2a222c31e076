"""Catalog search in passes, autocomplete, typo search and the result validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions.dictionaries import ACCESSORY_WORDS
from cataloom.functions.numbers import price_confidence
from cataloom.functions.text import has_all_tokens, normalise_query, query_tokens, significant, stem, token_coverage, trigrams, word_set
from cataloom.operators.classify import brand_mentions, classify

PAGE = 30


def search(products: DataFrame, query: str, page: int = PAGE) -> DataFrame:
    """(id, name, lowest_price, pass, coverage), ranked: coverage, price with null last, pass, id.

    Pass 1 takes page products that share a token, pass 2 page ones whose name holds all tokens, pass 3 all whose name holds the
    query; a pass counts only while earlier ones have found fewer than page. One scan labels each product with its passes;
    early exit is a comparison with the passes' sizes, not a second scan. Words are compared by their stems. A blank query finds
    nothing.
    """
    spark = products.sparkSession
    asked = spark.range(1).select(query_tokens(normalise_query(F.lit(query))).alias("t"), F.trim(F.lower(F.lit(query))).alias("q")).first()
    tokens = F.array(*map(F.lit, asked["t"])) if asked["t"] else F.array().cast("array<string>")
    name = F.lower("name")
    text = F.concat_ws(" ", name, F.lower("description")) if "description" in products.columns else name
    shares = F.arrays_overlap(F.transform(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), stem), F.transform(tokens, stem))
    holds = F.lit(bool(asked["t"])) & has_all_tokens(F.col("name"), tokens)
    raw = F.contains(name, F.lit(asked["q"])) & F.lit(bool(asked["q"]))
    found = products.select("id", "name", "lowest_price", F.array_compact(F.array(F.when(shares, 1), F.when(holds, 2), F.when(raw, 3))).alias("passes")).where(F.size("passes") > 0)
    one = found.where(F.array_contains("passes", 1)).orderBy("id").limit(page).withColumn("pass", F.lit(1))
    two = found.where(F.array_contains("passes", 2)).orderBy("id").limit(page).withColumn("pass", F.lit(2))
    three = found.where(F.array_contains("passes", 3)).withColumn("pass", F.lit(3))
    n1 = one.count()
    merged = one
    if n1 < page:
        merged = merged.unionByName(two)
        if merged.select("id").distinct().count() < page:
            merged = merged.unionByName(three)
    first = merged.groupBy("id", "name", "lowest_price").agg(F.min("pass").alias("pass"))
    ranked = first.withColumn("coverage", token_coverage(F.col("name"), tokens))
    return ranked.orderBy(F.desc("coverage"), F.col("lowest_price").asc_nulls_last(), "pass", "id")


def sites_searched(results: DataFrame, site_prices: DataFrame) -> DataFrame:
    """Distinct sites over the result products."""
    return site_prices.join(results.select(F.col("id").alias("product_id")), "product_id", "left_semi").select("site_id").where("site_id is not null").distinct()


def response(found: DataFrame, site_prices: DataFrame, query: str, keywords: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """One row (query, total_results, sites, detected_category, categories, brands, confidence) beside the results of search().

    sites are the sites of the results in the order in which the ranked results show them, a product's own by id. Categories are
    labels, best first.
    """
    rank = F.struct((-F.col("coverage")).alias("c"), F.col("lowest_price").isNull().alias("none"), "lowest_price", "pass", "id")
    seen = found.select(F.col("id").alias("product_id"), rank.alias("rank")).join(site_prices.select("product_id", "site_id"), "product_id").where("site_id is not null")
    first = seen.groupBy("site_id").agg(F.min("rank").alias("at"))
    sites = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "site_id"))), lambda x: x["site_id"]).alias("sites"))  # a page's sites
    asked = found.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    intent = classify(asked, keywords, brands, categories).join(brand_mentions(asked, brands), "query_id", "left")
    label = F.map_from_entries(F.array(*[F.struct(F.lit(r["name"]), F.lit(r["label"])) for r in categories.select("name", "label").collect()]))  # a dimension of some twenty rows
    one = intent.crossJoin(found.agg(F.count("*").alias("total_results"))).crossJoin(sites)  # one row each
    labels = F.transform("categories", lambda c: label[c])
    none = F.array().cast("array<string>")
    return one.select(F.lit(query).alias("query"), "total_results", "sites", F.coalesce(F.get(labels, F.lit(0)), F.lit("General")).alias("detected_category"), labels.alias("categories"), F.coalesce("brands", none).alias("brands"), "confidence")


def autocomplete(products: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """(id, name, lowest_price): the first names that hold the text anywhere, 1 to 20, of which each lower-cased name stays once; none for a blank."""
    typed = prefix.strip().lower()
    hits = products.where(F.contains(F.lower("name"), F.lit(typed)) & F.lit(bool(typed))).orderBy("id").limit(max(1, min(20, limit)))
    return hits.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct("id", "name", "lowest_price"), "id").alias("p")).select("p.*").orderBy("id")


def in_stock_names(results: DataFrame) -> DataFrame:
    """Rows with a name that is not blank and a price: what the validator looks at."""
    return results.where(F.col("price").isNotNull() & (F.trim("name") != ""))


def trigram_top(queries: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): names most alike by shared trigrams over all of both.

    An inverted index as a join on the trigram. Names of equal text are joined once. Ties go to the smaller id.
    """
    texts = names.groupBy(F.lower("name").alias("text")).agg(F.min("id").alias("text_id"))
    posting = texts.select("text_id", F.size(trigrams(F.col("text"))).alias("d"), F.explode(trigrams(F.col("text"))).alias("g"))
    asked = queries.select("query_id", F.size(trigrams(F.lower("query"))).alias("q"), F.explode(trigrams(F.lower("query"))).alias("g"))
    shared = asked.join(posting, "g").groupBy("query_id", "text_id", "q", "d").agg(F.count("*").alias("n"))
    scored = shared.select("query_id", "text_id", (F.col("n") / (F.col("q") + F.col("d") - F.col("n"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "text_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("text_id", "id")


def fuzzy_name_search(products: DataFrame, query: str, limit: int = PAGE) -> DataFrame:
    """(id, name, score): tokens within one edit of a name's tokens weigh 3, tokens that begin a name's token weigh 2.

    Stands in for a search server's fuzzy pass; its scores are its own.
    """
    spark = products.sparkSession
    tokens = spark.range(1).select(query_tokens(normalise_query(F.lit(query))).alias("t")).first()["t"]
    words = F.split(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "), " ")
    score = F.lit(0)
    for t in tokens:
        score = score + F.when(F.exists(words, _near(t)), 3).otherwise(0) + F.when(F.exists(words, _starts(t)), 2).otherwise(0)
    return products.select("id", "name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def _near(token: str):
    return lambda w: F.levenshtein(w, F.lit(token), 1) >= 0


def _starts(token: str):
    return lambda w: w.startswith(token)


def validate(results: DataFrame, intents: DataFrame, categories: DataFrame) -> DataFrame:
    """(query_id, name, price, similarity, score) of results worth showing, best first.

    results (query_id, name, price, in_stock), intents (query_id, query, categories, model_tokens). Dropped: blank names; null
    prices; prices that neither the first category nor any other finds plausible; names that share no model token and
    lack a significant query word; names with an accessory word that the query has not.
    """
    accessory = F.array(*map(F.lit, ACCESSORY_WORDS))
    rows = in_stock_names(results).join(intents, "query_id")
    spans = categories.select(F.col("name").alias("c"), "min_price", "max_price").collect()  # a dimension of some twenty rows
    bounds = F.create_map(*[x for r in spans for x in (F.lit(r["c"]), F.struct(F.lit(r["min_price"]).alias("low"), F.lit(r["max_price"]).alias("high")))])
    plausible = F.exists("categories", lambda c: F.col("price").between(bounds[c]["low"], bounds[c]["high"]))
    asked, tokens, low = word_set(F.col("query")), word_set(F.col("name")), F.lower("name")
    model = F.arrays_overlap(tokens, F.col("model_tokens"))
    model = F.coalesce(model, F.lit(False))
    gate = model | F.forall(significant(asked), lambda t: F.contains(low, t))
    extra = F.size(F.array_intersect(F.split(low, "[^a-z0-9]+"), F.array_except(accessory, asked))) > 0
    kept = rows.where(plausible & gate & ~extra)
    shared = F.size(F.array_intersect(asked, tokens))
    jaccard = shared / F.greatest(F.size(F.array_union(asked, tokens)), F.lit(1))
    inside = shared / F.greatest(F.size(asked), F.lit(1))
    similarity = F.when(model, 1.0).otherwise(F.least(F.lit(1.0), 0.55 * jaccard + 0.45 * inside))
    first = bounds[F.get("categories", F.lit(0))]
    stock = F.when(F.col("in_stock").eqNullSafe(False), 0.0).otherwise(1.0)
    score = 0.7 * similarity + 0.2 * price_confidence(F.col("price"), first["low"], first["high"]) + 0.1 * stock
    return kept.select("query_id", "name", "price", similarity.alias("similarity"), score.alias("score")).orderBy("query_id", F.desc("score"), "name")
