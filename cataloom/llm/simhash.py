"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link when they differ in at most 3. Cut into two halves, one half of linked fingerprints
differs in at most one bit. Each half is indexed 32 times, once with each bit wild, so linked fingerprints share an
index key exactly; equal keys are joined and the whole distance is verified.

A bucket of k fingerprints never gives its k squared pairs. First each member is compared with the bucket's smallest;
these verified links are contracted. Only fingerprints in buckets that still hold two components are compared further, each
once, and only across components, which cannot miss a link that matters: any linked pair shares a bucket, and either it is
joined already or it is compared. There variants with any three of the eight bytes deleted are the finer index: fingerprints
that differ in at most three bits share at least five bytes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, materialize, small_side
from cataloom.operators.graph import connected_components

BITS, SEGMENT_BITS, MAX_DISTANCE, SHINGLE_WORDS, SEED = 64, 32, 3, 3, 42
_STEP = 1 << 15
#: Fingerprints whose variants one task makes.
FINGERPRINTS_PER_TASK = 20_000
#: Ids that are broadcast (some 20 MB).
BROADCAST_IDS = 500_000


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text: a bit is set if it is set in over half of the shingles' XXH64; no words give zero."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    if len(found) <= shingle_words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(shingle_words)]))
    n = max(1, len(found) - shingle_words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        ones += np.unpackbits(hashes[k : k + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of each row; null texts count as empty."""
    batches_of(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def deletion_variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): 64 rows for each fp. A key packs the half's number, the wild bit's place and the half with that bit cleared."""
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("fp", 32)
    halves = [(0, low), (1, high)]
    keys = F.array(*[half.bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << bit))).bitwiseOR(F.lit((side << 37) | (bit << 32))) for side, half in halves for bit in range(32)])
    return distinct.select(F.explode(keys).alias("key"), "fp")


def byte_variants(distinct: DataFrame) -> DataFrame:
    """The rows of distinct with (place, part): 56 rows for each fp, part being fp with three of its bytes cleared and place saying which."""
    masks = [sum(255 << 8 * k for k in kept) for kept in combinations(range(8), 8 - MAX_DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    found = distinct.select("*", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("place", "mask"))
    return found.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")


def links(a, b):
    """Whether two fingerprints differ in at most MAX_DISTANCE bits, as a column."""
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, component): component is the smallest fp reachable over links, for each distinct fp."""
    distinct = materialize(fps.select("fp").distinct(), "fps")
    # 64 rows come of each, so the few files of fingerprints are dealt to as many tasks as that needs
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // FINGERPRINTS_PER_TASK))
    distinct = distinct.repartition(parts, "fp")
    variants = deletion_variants(distinct)
    shared = variants.groupBy("key").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Spark's estimates leave out that variants are 64 times the fingerprints, so without the hint it broadcasts all of them
    buckets = materialize(variants.join(shared.hint("merge"), "key"), "buckets")
    stars = buckets.where((F.col("fp") != F.col("low")) & links(F.col("fp"), F.col("low"))).select(F.col("fp").alias("src"), F.col("low").alias("dst"))
    first = connected_components(stars)
    member = materialize(
        buckets.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "members"
    )
    mixed = member.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    rest = materialize(member.join(mixed, "key", "left_semi").select("fp", "root").distinct(), "mixed")
    finer = byte_variants(rest)
    crowded = finer.groupBy("place", "part").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").drop("b")
    # of two components one is not the bucket's smallest, so the smallest's members meet the others but not each other
    later = finer.join(crowded.hint("merge"), ["place", "part"]).where("root > a").select("place", "part", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    across = finer.join(later.hint("merge"), ["place", "part"]).where((F.col("root") < F.col("root2")) & links(F.col("fp"), F.col("fp2")))
    second = connected_components(across.select(F.col("root").alias("src"), F.col("root2").alias("dst")))
    labelled = distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    top = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return labelled.join(top, "root", "left").select("fp", F.coalesce("top", "root").alias("component"))


def near_duplicates(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over fingerprints that link.

    Equal fingerprints are one node, so thousands of copies cost one row in the index. Null texts are empty texts,
    whose fingerprint is zero and links like any other. Rows with a null doc_id get the component of their text, null if
    no other row is in it. Repeated rows stay. Empty tables give no rows.
    """
    fps = materialize(fingerprints(docs, **columns), "fingerprints")
    components = materialize(fingerprint_components(fps), "components")
    smallest = fps.groupBy("fp").agg(F.min("doc_id").alias("low")).join(components, "fp")
    ids = smallest.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = materialize(components.join(ids, "component").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their component's smallest, with docs' own columns, whatever their names.

    Rows of one id stay or go together, rows without an id stay. Null texts are empty ones. Ids to be dropped are broadcast
    if they are few; else the join shuffles the texts.
    """
    names = docs.columns
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = inner.join(small_side(materialize(gone, "gone"), BROADCAST_IDS), F.col(f"c{names.index(id_col)}") == F.col("gone"), "left_anti")
    return kept.toDF(*names)
