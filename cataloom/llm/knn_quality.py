"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents is turned into tf-idf vectors of hashed terms: words, the forms of words (how capitals,
letters, digits and signs follow each other in them) and repeats of a word by itself. A truncated singular value
decomposition gives the latent space. The sample's vectors and labels are broadcast. Every document is projected into the space and
compared with all of them, block by block, exactly; the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, split_words


@dataclass(frozen=True)
class KnnParams:
    #: Labelled documents that the space is fitted to and that vote: those of the smallest hash. Bounds what is broadcast
    #: (sample * rank + slots * rank floats, 3 MB) and what the driver holds (sample * slots floats, 16 MB).
    sample: int = 2048
    #: Slots that terms are hashed into, and how many of them, the last ones, are for forms of words and repeats.
    slots: int = 2048
    form_slots: int = 512
    rank: int = 64
    neighbours: int = 15
    #: Votes weigh similarity to this power.
    sharpness: int = 4
    threshold: float = 0.3
    seed: int = 7


def forms(words: pa.Array) -> pa.Array:
    """Words with runs of capitals, other letters and digits as A, a and 0; other signs as they are."""
    for pattern, form in ((r"\p{Lu}+", "A"), (r"(?:\p{Ll}|\p{Lt}|\p{Lm}|\p{Lo}|\p{M})+", "a"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, form)
    return words


def _hashed(words: pa.Array, slots: int) -> np.ndarray:
    found = words.cast(pa.binary()).to_pylist()
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % slots


def features(texts: pa.Array, p: KnnParams) -> np.ndarray:
    """A row of damped term counts for each whole text; null texts are empty ones."""
    n, plain = len(texts), p.slots - p.form_slots
    words, at, sizes = split_words(texts)
    row = np.repeat(np.arange(n), sizes)
    term = _hashed(pc.ascii_lower(words), plain)
    kinds = pc.dictionary_encode(forms(words))
    form = plain + _hashed(kinds.dictionary, p.form_slots - 1)[kinds.indices.to_numpy()]
    again = np.flatnonzero((at[1:] == at[:-1]) & (row[1:] == row[:-1])) + 1
    place = np.concatenate([row * p.slots + term[at], row * p.slots + form[at], row[again] * p.slots + p.slots - 1])
    return np.log1p(np.bincount(place, minlength=n * p.slots).reshape(n, p.slots)).astype(np.float32)


@dataclass
class Space:
    """A fitted space: term weights, projection, and the voters' unit vectors and labels."""

    params: KnnParams
    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        x = x * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        y = x @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest voters; without voters a half."""
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = self.project(x) @ self.voters.T
        k = min(self.params.neighbours, near.shape[1])
        blank = ~x.any(1)
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(np.float64) ** self.params.sharpness
        return np.where(blank, self.labels.mean(), np.clip((weight * self.labels[at]).sum(1) / weight.sum(1), 0.0, 1.0))


def fit(x: np.ndarray, labels: list[int], p: KnnParams) -> Space:
    """The latent space of labelled texts' features, by a randomised singular value decomposition with a fixed seed."""
    x = x.copy()
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rank = min(p.rank, max(1, len(x)))
    probe = np.random.default_rng(p.seed).standard_normal((p.slots, rank + 8)).astype(np.float32)
    q = np.linalg.qr(x @ probe)[0] if len(x) else np.zeros((0, rank))
    for _ in range(3 if len(x) else 0):
        q = np.linalg.qr(x @ (x.T @ q))[0]
    axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T if len(x) else np.zeros((p.slots, 1), np.float32)
    y = x @ axes
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    return Space(p, idf, np.ascontiguousarray(axes, np.float32), np.ascontiguousarray(y, np.float32), np.array(labels, np.float64))


def is_held_out(id_col: str):
    """Whether crc32 of the id as text divides by 5; null ids too, which no label can name."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, p: KnnParams = KnnParams(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space:
    """Fit the space to labelled documents that are not held out, sample of them at most.

    Null labels are left out; a document labelled twice takes its smallest label, rows of one id give the smallest text. The
    sampled ids are broadcast to find their texts, which are turned into features where they are: only those come to the driver.
    """
    spark = docs.sparkSession
    batches_of(spark)
    named = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    chosen = named.orderBy(F.xxhash64("__id", F.lit(p.seed)), "__id").limit(p.sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = texts.schema["__id"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            x = features(batch.column(2), p)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), p.slots).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["id", "label", "x"])

    one = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    rows = one.mapInArrow(measure, f"id {kind}, label int, x array<float>").orderBy("id").toArrow()  # sample rows at most
    x = np.concatenate([c.flatten().to_numpy() for c in rows.column("x").chunks] or [np.zeros(0, np.float32)]).reshape(len(rows), p.slots)
    return fit(x, rows.column("label").to_pylist(), p)


def score(docs: DataFrame, space: Space, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, whole texts. Null and empty texts have no terms: all voters are alike to them, and the share of label 1 is what they get.

    Repeated rows stay, null ids are allowed, empty tables give no rows. No other column is read.
    """
    spark = docs.sparkSession
    batches_of(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(space)

    def run(batches):
        s = sent.value
        for batch in batches:
            got = s.vote(features(batch.column("text"), s.params))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= s.params.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
