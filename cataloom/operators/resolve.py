"""Entity resolution: the same product across shops by MinHash and banding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions import minhash
from cataloom.functions.text import match_key, shingle_form, shingles, string_hash
from cataloom.operators.graph import connected_components
from cataloom.session import materialize

THRESHOLD, SHINGLE = 0.42, 4


def name_shingles(names: DataFrame) -> DataFrame:
    """(key, shingles): one row for each distinct match key, so a name that thousands share is hashed once."""
    keys = names.select(match_key(F.col("name")).alias("key")).distinct()
    return keys.select("key", shingles(shingle_form(F.col("key")), SHINGLE).alias("shingles"))


def shingle_hashes(column):
    return F.transform(column, string_hash)


def signatures(names: DataFrame, hashes: int = minhash.HASHES) -> DataFrame:
    """(key, sig) of the distinct match keys."""
    udf = minhash.signature_udf(hashes)
    return name_shingles(names).select("key", udf(shingle_hashes(F.col("shingles"))).alias("sig"))


def bands(sigs: DataFrame, n: int = minhash.BANDS, rows: int = minhash.ROWS) -> DataFrame:
    """(band, slice, key): buckets are equal slices; no hash of the slice stands in for it."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.slice("sig", b * rows + 1, rows))
    return sigs.select(F.posexplode(cut).alias("band", "slice"), "key")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, other) that share a bucket, each once, without equal keys."""
    a, b = bands(left), bands(right).withColumnRenamed("key", "other")
    return a.join(b, ["band", "slice"]).where("key <> other").select("key", "other").distinct()


def alike_components(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the nodes of sigs (node, key, sig) that are alike, directly or through others.

    Members of a bucket are compared with its smallest node first, and these links contracted; only buckets that still
    hold two components are compared further, and only across them. k names that are alike thus give k pairs, not k squared.
    """
    cut = materialize(bands(sigs.select(F.col("node").alias("key"), "sig")).withColumnRenamed("key", "node"), "bands")
    low = cut.groupBy("band", "slice").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialize(cut.join(low, ["band", "slice"]), "buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (src, dst) whose signatures are alike enough."""
        one, two = sigs.select(F.col("node").alias("src"), F.col("sig").alias("s1")), sigs.select(F.col("node").alias("dst"), F.col("sig").alias("s2"))
        return pairs.join(one, "src").join(two, "dst").where(minhash.estimated_jaccard(F.col("s1"), F.col("s2")) >= threshold)

    stars = buckets.where("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst")).distinct()
    first = connected_components(linked(stars).select("src", "dst"))
    member = materialize(buckets.join(first, "node", "left").select("band", "slice", "node", F.coalesce("root", "node").alias("root")), "members")
    mixed = member.groupBy("band", "slice").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band", "slice")
    rest = materialize(member.join(mixed, ["band", "slice"], "left_semi"), "mixed")
    other = rest.select("band", "slice", F.col("node").alias("dst"), F.col("root").alias("root2"))
    across = rest.withColumnRenamed("node", "src").join(other, ["band", "slice"]).where("root < root2").select("src", "dst", "root", "root2").distinct()
    second = connected_components(linked(across).select(F.col("root").alias("src"), F.col("root2").alias("dst")))
    labelled = sigs.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return labelled.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def best_matches(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, other, score): the most alike key of right for each of left, by estimated Jaccard; ties to the smaller key."""
    pairs = candidates(left, right)
    scored = pairs.join(left.withColumnRenamed("sig", "s1"), "key").join(right.select(F.col("key").alias("other"), F.col("sig").alias("s2")), "other")
    scored = scored.withColumn("score", minhash.estimated_jaccard(F.col("s1"), F.col("s2"))).where(F.col("score") >= threshold)
    return scored.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("cost"), "other")).alias("b")).select("key", F.col("b.other").alias("other"), (-F.col("b.cost")).alias("score"))


def resolve(catalog: DataFrame, offers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(shop_id, url, product_id, how) for each offer (shop_id, url, name, price) against the catalog (id, name, url).

    Offers are ordered by shop and url, the last of a url wins. A url the catalog knows settles it. Else the offer's name is
    matched with catalog names; what is left is grouped with its like by connected components, and each group gets the
    id 'new:' and its smallest key. how is url, name or new.
    """
    last = Window.partitionBy("url").orderBy(F.desc("shop_id"), F.desc("name"))
    unique = offers.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n").withColumn("key", match_key(F.col("name")))
    by_url = catalog.where("url is not null").groupBy("url").agg(F.min("id").alias("url_id"))
    known = materialize(unique.join(by_url, "url", "left"), "offers")
    rest = known.where("url_id is null")
    left, right = materialize(signatures(rest), "left"), materialize(signatures(catalog), "right")
    by_key = catalog.groupBy(match_key(F.col("name")).alias("key")).agg(F.min("id").alias("id"))
    equal = left.select("key").join(by_key, "key")
    best = best_matches(left.join(by_key, "key", "left_anti"), right, threshold)
    named = materialize(equal.select("key", "id").unionByName(best.join(by_key.withColumnRenamed("key", "other"), "other").select("key", "id")), "named")
    fresh = materialize(left.join(named, "key", "left_anti").withColumn("node", F.xxhash64("key")), "fresh")
    roots = fresh.join(alike_components(fresh, threshold), "node")
    groups = roots.join(roots.groupBy("root").agg(F.min("key").alias("low")), "root").select("key", F.concat(F.lit("new:"), "low").alias("new_id"))
    out = known.join(named.select("key", F.col("id").alias("name_id")), "key", "left").join(groups, "key", "left")
    how = F.when(F.col("url_id").isNotNull(), "url").when(F.col("name_id").isNotNull(), "name").otherwise("new")
    text = lambda c: F.col(c).cast("string")
    return out.select("shop_id", "url", "name", "price", F.coalesce(text("url_id"), text("name_id"), F.col("new_id")).alias("product_id"), how.alias("how"))


def groups_by_name(names: DataFrame, threshold: float = THRESHOLD, hashes: int = minhash.HASHES) -> DataFrame:
    """(key, root): match keys that are alike, directly or through others, under their smallest node."""
    sigs = materialize(signatures(names, hashes).withColumn("node", F.xxhash64("key")), "sigs")
    return sigs.select("key", "node").join(alike_components(sigs, threshold), "node").select("key", "root")
