"""Token counts through a cache of content digests.

A cache holds (digest, n_tokens) for each tokenizer version, whose name is a digest of the vocabulary file and of the
library's version. Documents are reduced to digests of their normalised content (null is empty; nothing else is changed,
as a tokenizer may see any change), joined with the cache, and only one document of each unknown digest is encoded. New
counts are appended, so a later run over the same texts encodes nothing.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, materialize, small_side

#: Digests of unknown texts that are broadcast (some 10 MB).
BROADCAST_MISSES = 200_000
#: Loaded tokenizers of this worker, by file.
_LOADED: dict[str, object] = {}


def counter(model: str):
    """A function from texts to token counts: tokenizers for .json, sentencepiece for .model; nothing added, nothing cut."""
    if model not in _LOADED:
        if model.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(model)
            t.no_truncation()
            t.no_padding()
            _LOADED[model] = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=model)
            _LOADED[model] = lambda texts: [len(ids) for ids in s.encode(texts, num_threads=1)]
    return _LOADED[model]


def tokenizer_version(model: str) -> str:
    """Name of what the file and its library do, for the cache."""
    if model.endswith(".json"):
        import tokenizers as library
    else:
        import sentencepiece as library
    with open(model, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()[:16]
    return f"{library.__name__}-{library.__version__}-{digest}"


class DigestCache:
    """Stored counts under one folder: <folder>/<tokenizer version>/ of Parquet files (digest binary, n_tokens long)."""

    schema = "digest binary, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, version: str) -> DataFrame:
        """The counts of a version, one row for each digest though two runs may have appended it."""
        path = f"{self.folder}/{version}"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(f"{self.folder}/{version}")


def token_counts(docs: DataFrame, cache: DigestCache, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, n_tokens) of each row; unknown texts are encoded once and appended to the cache.

    Null texts are empty ones and have no tokens. Rows of one text are encoded once, however many they are: the one of the
    smallest id goes to the tokenizer, chosen by partial aggregation, so a hot text is no hot task. Repeated rows stay,
    null ids are allowed, empty tables give no rows.
    """
    batches_of(docs.sparkSession)
    version = tokenizer_version(model)

    def encode(batches):
        count = counter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    keyed = materialize(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")), "digests")
    asked = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    known = materialize(cache.read(version).join(asked.select("digest"), "digest", "left_semi"), "known")
    misses = materialize(asked.join(known, "digest", "left_anti").select(F.col("digest").alias("d"), "first_id"), "misses")
    texts = docs.select(F.col(id_col).alias("doc_id"), content.alias("content"), digest.alias("digest"))
    # few misses are broadcast and no text is moved; many are joined by a shuffle of the texts
    chosen = texts.join(small_side(misses, BROADCAST_MISSES), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    counts = chosen.select("digest", "content").mapInArrow(encode, cache.schema)
    new = materialize(counts.dropDuplicates(["digest"]), "counts")  # equal rows, id and all, are encoded each
    cache.append(new, version)
    # plain tables beside the hot digests, so their join can be split
    return keyed.join(known.unionByName(new), "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
