"""What the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cataloom.session import materialize, scratch_path, shared_folder, small_side, table

__all__ = ["BYTES_PER_BATCH", "ROWS_PER_BATCH", "WORD", "batches_of", "give_back", "larger", "lower_ascii", "materialize", "scratch_path", "shared_folder", "small_side", "split_words", "table", "words"]

#: A word, as a pattern: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in an Arrow batch: whichever is met first ends it, so long texts make no large batches.
ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 4 << 20


def batches_of(spark: SparkSession) -> None:
    """Hold Arrow batches small, for tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def larger(batches, size: int = 8 << 20):
    """The same rows in batches of at least so many bytes, but for the last: what their texts share is looked up once."""
    held, got = [], 0
    for batch in batches:
        held.append(batch)
        got += batch.nbytes
        if got >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, got = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def give_back() -> None:
    """Return memory that this worker's allocators hold but do not use: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the place of each word there in order, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    found = pc.dictionary_encode(parts.flatten())
    at = found.indices.to_numpy()
    kept = at != pc.index(found.dictionary, "").as_py()  # white space at a text's ends leaves empty words
    sizes = np.add.reduceat(kept, parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py(), dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return found.dictionary, at[kept], sizes


def lower_ascii(column):
    """A-Z lower-cased and no other letter, as a column."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """The words of WORD, as UTF-8: bytes.split() parts at just these six characters."""
    return text.encode().split() if text else []
