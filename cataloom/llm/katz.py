"""Katz backoff with Good-Turing discounts and exactly normalised backoff weights.

All word bigrams and unigrams of the training texts are counted. A bigram that was seen keeps its discounted share of its
history; one that was not backs off, by its history's weight, to the unigram; a word that was never seen gets an even part
of what the unigrams' discounts free, shared among as many unseen words as there seem to be (Chao's estimate from the
words found once and twice). So the probabilities of a history's words, the unseen ones included, sum to one.

Unigrams and bigrams grow with the corpus. They are dealt into buckets, as packed columns: a bigram by its history, or by
both words where the history is frequent and so may be hot. Words go by keys: a small number for those of HOT_SHARE or
more, else 62 bits of a hash.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, larger, split_words

#: Least relative frequency of a history that is split over buckets; of a word whose count is broadcast; of a bigram that is broadcast.
SPLIT_SHARE, HOT_SHARE, HOT_PAIR = 1 / 2048, 2e-6, 1e-5
#: Counts up to this are discounted.
K = 5
#: The end of a text, among words: no word is empty.
END = ""
#: Keys of words that are not broadcast start here; the key of a text's start; tokens that a bucket may hold.
_COLD, _BEGIN, _BUCKET_TOKENS = 1 << 62, -1, 2_000_000


def good_turing(n_r: dict[int, int]) -> dict[int, float]:
    """Katz's discounts d_r for r up to K, from the numbers n_r of n-grams found r times.

    Where those numbers are too few to give ratios in (0, 1], absolute discounting takes their place.
    """
    n = [n_r.get(r, 0) for r in range(K + 2)]
    if all(n[1:]):
        a = (K + 1) * n[K + 1] / n[1]
        if a < 1:
            d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, K + 1)}
            if all(0 < x <= 1 for x in d.values()):
                return d
    step = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
    step = min(max(step, 0.05), 0.95)
    return {r: 1 - step / r for r in range(1, K + 1)}


def unseen_types(once: int, twice: int) -> float:
    """How many words the texts lack, from the numbers of those found once and twice; one at least."""
    return 1 + once * max(once - 1, 0) / (2 * (twice + 1))


@dataclass
class Model:
    """A trained model: its folder of tables and what is bounded of it."""

    folder: str
    tokens: int
    types: int
    discounts: dict[int, float]
    #: The share of all unseen words together, and their estimated number.
    unseen: float
    unseen_words: float
    #: What counts keep where nothing was discounted, else 1.
    keep: float
    #: Frequent words, most frequent first, and their counts; histories that are split, which come first; the number of buckets.
    names: list[str]
    counts: np.ndarray
    split: int
    buckets: int
    #: The table order=2 as packed columns; discounts of bigrams.
    bigrams: DataFrame | None
    discounts2: dict[int, float]
    #: (log10 of the factor of what was seen, log10 backoff) of split histories; log10 P(w | h) - log10 P(w) of hot bigrams.
    histories: dict[int, tuple[float, float]]
    gains: dict[tuple[int, int], float]

    def log_unseen(self) -> float:
        return math.log10(self.unseen / self.unseen_words)


def _hashed(words: pa.Array) -> np.ndarray:
    found = words.cast(pa.binary()).to_pylist()
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) >> np.uint64(2)).astype(np.int64) | _COLD


def _coded(texts: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, line, sizes): all texts as places in keys, each between the places of _BEGIN, the last, and END, the one before it; sizes are those of the texts with both."""
    words, at, sizes = split_words(pc.ascii_lower(texts))
    words = pa.concat_arrays([words, pa.array([END], words.type)])
    keys = pc.index_in(words, value_set=names).fill_null(-1).to_numpy().astype(np.int64)
    cold = keys < 0
    keys[cold] = _hashed(words.filter(pa.array(cold)))
    m = len(keys)
    sizes = sizes + 2
    ends = np.cumsum(sizes)
    line = np.empty(ends[-1] if len(ends) else 0, np.int64)
    inner = np.ones(len(line), bool)
    inner[ends - 1] = inner[ends - sizes] = False
    line[inner], line[ends - 1], line[ends - sizes] = at, m - 1, m
    return np.r_[keys, _BEGIN], line, sizes


_PACKED = "bucket int, kind int, n long, blob binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of eight bytes, byte by byte, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, width: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 8 * n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, 8, n)
    return [np.ascontiguousarray(x.T).view(np.int64).ravel() for x in raw]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _bucket(h: np.ndarray, w: np.ndarray, split: int, n: int) -> np.ndarray:
    """The bucket of bigrams: a history's, and for split histories the pair's."""
    x = _mixed(h)
    return np.where(h < split, _mixed(x + _mixed(w)), x) % np.uint64(n)


def _dealt(kind: int, bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, kind, n, blob) of each bucket."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable") if not len(bucket) or int(bucket.max()) < 1 << 16 else np.argsort(bucket, kind="stable")  # 16 bits sort by radix
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    columns = [c[order] for c in columns]
    for x, y in zip(first, [*first[1:], len(bucket)]):
        yield int(bucket[x]), kind, int(y - x), _pack(*[c[x:y] for c in columns])


def _batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "kind", "n", "blob"])


def _of_kind(rows: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """The columns of all blobs of a kind."""
    parts = [_unpack(b, n, width) for k, n, b in zip(*[rows.column(c).to_pylist() for c in ("kind", "n", "blob")]) if k == kind]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * width


def _unigram_blobs(rare_words: DataFrame, buckets: int) -> DataFrame:
    """(key, count) of the words that are not broadcast, by key."""

    def deal(batches):
        for batch in larger(batches):
            keys = _hashed(batch.column(0))
            yield _batch(_dealt(0, _mixed(keys) % np.uint64(buckets), keys, batch.column(1).to_numpy()))

    return rare_words.select("word", "c").mapInArrow(deal, _PACKED)


def _place(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Where each key is among sorted_keys (not empty), or any place if it is not there."""
    return np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)


def _counts_of(keys: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """The counts of keys by (key, count); 0 where there is none."""
    k, c = known
    if not len(k):
        return np.zeros(len(keys), np.int64)
    order = np.argsort(k)
    k, c = k[order], c[order]
    at = _place(keys, k)
    return np.where(k[at] == keys, c[at], 0)


def _full_counts(w: np.ndarray, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of second words: those of broadcast words are not moved, 0 stands for them."""
    return np.where(w < _COLD, counts[np.where(w < _COLD, w, 0)], c)


def _merged(h: np.ndarray, w: np.ndarray, *columns: np.ndarray):
    """Each (h, w) once, sorted, and where it starts among the sorted columns."""
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[start], w[start], start, [c[order] for c in columns]


def _factors(d: dict[int, float], c: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.array([d.get(r, 1.0) for r in range(K + 2)])[np.minimum(c, K + 1)] * c


def _weights(total, kept, lower):
    """(log10 of the factor of seen bigrams, log10 backoff) of histories, from counts, discounted counts and the unigram share of what was seen."""
    left, over = 1 - kept / total, 1 - lower
    none = over <= 1e-12  # every word was seen: nothing to back off to
    factor = np.where(none, total / kept, np.where(left <= 1e-12, total / (total + 0.5), 1.0))  # nothing was freed: half a count is
    left = np.maximum(1 - factor * kept / total, 1e-300)
    return np.log10(factor), np.where(none, 0.0, np.log10(left / np.where(none, 1.0, over)))


def _count_words(batches):
    for batch in larger(batches, 32 << 20):
        words, at, _ = split_words(pc.ascii_lower(batch.column(0)))
        counts = np.bincount(at, minlength=len(words))
        words = words.filter(pa.array(counts > 0))  # white space at an end leaves an empty word
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], words.type)]), pa.array(np.r_[counts[counts > 0], batch.num_rows])], ["word", "c"])


def is_held_out(id_col: str):
    """Whether crc32 of the id as text leaves 1 when divided by 5; null ids train."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def train(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count all texts that are not held out and write the tables order=1 (word, c) and order=2, packed bigrams of words by bucket.

    Null and empty texts are an end alone. Without training texts every word is unseen. Words are counted in each task and
    then by key; no key is hot, as a task sends a word once for each 32 MB.
    """
    spark = docs.sparkSession
    batches_of(spark)
    texts = docs.where(~is_held_out(id_col)).select(F.col(text_col).alias("text"))
    texts.mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).write.parquet(f"{folder}/order=1")
    counted = spark.read.schema("word string, c long").parquet(f"{folder}/order=1")
    sums = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v"), *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2)]).first()
    n, v = sums["n"] or 0, sums["v"]
    d = good_turing({r: sums[f"n{r}"] for r in range(1, K + 2)})
    freed = sum((1 - d[r]) * r * sums[f"n{r}"] for r in d)
    unseen = freed / n if n else 1.0
    if n and not unseen:
        unseen = 1 / (n + 1)  # no word is rare enough to be discounted; all give a little
    keep = 1.0 if freed else 1 - unseen
    share = lambda x: max(1, math.ceil(x * n))
    frequent = counted.where(F.col("c") >= share(HOT_SHARE)).toArrow()  # 1 / HOT_SHARE rows at most
    hot = sorted(zip(frequent.column("c").to_pylist(), frequent.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    counts = np.array([c for c, _ in hot] + [0], np.int64)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // _BUCKET_TOKENS))
    model = Model(folder, n, v, d, unseen, unseen_types(sums["n1"], sums["n2"]), keep, [w for _, w in hot], counts, int((counts >= share(SPLIT_SHARE)).sum()), buckets, None, {}, {}, {})
    _bigrams(texts, counted.where(F.col("c") < share(HOT_SHARE)), model)
    return model


def _bigrams(texts: DataFrame, rare_words: DataFrame, model: Model) -> None:
    """Count the word bigrams into the table order=2 and set what is bounded of them.

    Tasks combine equal pairs first. Those whose second word is not broadcast meet that word's count in its bucket. Then
    all pairs of a bucket are summed. Split histories are summed from one row of each bucket.
    """
    spark = texts.sparkSession
    n, split, buckets, d, keep = model.tokens, model.split, model.buckets, model.discounts, model.keep
    hot_pair = max(1, math.ceil(HOT_PAIR * n))
    sent = spark.sparkContext.broadcast((pa.array(model.names, pa.string()), model.counts))

    def pairs(cold: bool):
        def deal(batches):
            for batch in larger(batches):
                keys, line, _ = _coded(batch.column(0), sent.value[0])
                m, old = len(keys), keys >= _COLD
                here = np.flatnonzero((line[1:] != m - 1) & (old[line[1:]] == cold))
                both, c = np.unique(line[here] * m + line[here + 1], return_counts=True)
                h, w = keys[both // m], keys[both % m]
                if cold:
                    yield _batch(_dealt(1, _mixed(w) % np.uint64(buckets), h, w, c))
                else:
                    yield _batch(_dealt(2, _bucket(h, w, split, buckets), h, w, c, np.zeros(len(w), np.int64)))

        return texts.mapInArrow(deal, _PACKED)

    def meet(rows: pa.Table) -> pa.Table:
        h, w, start, (c,) = _merged(*_of_kind(rows, 1, 3))
        c = np.add.reduceat(c, start) if len(start) else c
        return pa.Table.from_batches([_batch(_dealt(2, _bucket(h, w, split, buckets), h, w, c, _counts_of(w, _of_kind(rows, 0, 2))))])

    def total(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        h, w, start, (c, wc) = _merged(*_of_kind(rows, 2, 4))
        c, wc = np.add.reduceat(c, start), wc[start]
        lower = _factors(d, _full_counts(w, wc, sent.value[1])) / n * keep
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sums = [np.add.reduceat(x.astype(np.float64), first) for x in (c, lower, *[c == r for r in range(1, K + 2)])]
        many = c >= hot_pair
        told = (h[first] < split) | np.isin(h[first], h[many])
        out = [(bucket, 3, int(h[first][i]), None, [float(x[i]) for x in sums], None) for i in np.flatnonzero(told)]
        out += [(bucket, 4, int(h[i]), int(w[i]), [float(c[i]), float(lower[i])], None) for i in np.flatnonzero(many)]
        out += [(bucket, 5, None, None, [float(x.sum()) for x in sums], None), (bucket, 6, len(h), None, None, _pack(h, w, c, wc))]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["bucket", "kind", "h", "w", "sums", "blob"])

    cold = pairs(True).unionByName(_unigram_blobs(rare_words, buckets)).groupBy("bucket").applyInArrow(meet, _PACKED)
    found = pairs(False).unionByName(cold).groupBy("bucket").applyInArrow(total, "bucket int, kind int, h long, w long, sums array<double>, blob binary")
    found.write.parquet(f"{model.folder}/order=2")
    found = spark.read.schema(found.schema).parquet(f"{model.folder}/order=2")
    model.bigrams = found.where("kind = 6").select("bucket", "kind", F.col("h").alias("n"), "blob")
    at = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(K + 3)]
    rest = found.where("kind = 5").agg(*at).first()
    model.discounts2 = d2 = good_turing({r: int(rest[r + 1] or 0) for r in range(1, K + 2)})
    sums = found.where("kind = 3").groupBy("h").agg(*at).toArrow()  # the split ones, and those of hot bigrams: 1 / HOT_PAIR rows at most
    h = sums.column("h").to_pylist()
    c, lower, *of = (sums.column(f"s{i}").to_numpy() for i in range(K + 3))
    factor, backoff = _weights(c, c - sum((1 - d2[r]) * r * of[r - 1] for r in range(1, K + 1)), lower)
    count = dict(zip(h, c))
    factors = dict(zip(h, factor))
    model.histories = {k: (f - math.log10(x), b) for k, f, b, x in zip(h, factor, backoff, c) if k < split}
    for r in found.where("kind = 4").select("h", "w", "sums").toArrow().to_pylist():  # 1 / HOT_PAIR rows at most
        x, low = r["sums"]
        model.gains[r["h"], r["w"]] = math.log10(d2.get(int(x), 1.0) * x / count[r["h"]] / low) + factors[r["h"]]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens, score the model's log10 probability of the text, end
    included. Null and empty texts are an end alone. Repeated rows stay, null ids are allowed, empty tables give no rows.
    Frequent words and hot bigrams are scored in place; the others, none of which can be hot, go to the buckets of the
    unigrams and bigrams, each as its key and its row. A bucket's sums go back to the chunk of rows that asked.
    """
    spark = docs.sparkSession
    batches_of(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    n, v, split, buckets, d, d2, keep = model.tokens, model.types, model.split, model.buckets, model.discounts, model.discounts2, model.keep
    unseen = model.log_unseen()
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    log_of = lambda c: np.where(c > 0, np.log10(np.maximum(_factors(d, c), 1e-300) / max(n, 1) * keep), unseen)
    m = len(model.counts)
    hot = sorted(((h + 1) * m + w, x) for (h, w), x in model.gains.items())
    hot_keys, hot_gains = np.array([k for k, _ in hot] + [1 << 62], np.int64), np.array([x for _, x in hot] + [0.0])
    sent = spark.sparkContext.broadcast((pa.array(model.names, pa.string()), model.counts, hot_keys, hot_gains, model.histories))
    names = ["bucket", "kind", "n", "blob", "chunk"]
    schema = f"{_PACKED}, chunk long"

    def local(batches):
        known, counts, hot_keys, hot_gains, _ = sent.value
        base, log_p = base_of(counts), log_of(counts)
        base[-1] = log_p[-1] = 0.0  # words that are not broadcast are added by their buckets
        chunk = TaskContext.get().partitionId() << 24
        for batch in larger(batches, 6 << 20):
            keys, line, sizes = _coded(batch.column(2), known)
            a, size = keys[line], batch.num_rows
            here = np.flatnonzero(a != _BEGIN)
            h, w, at = a[here - 1], a[here], np.repeat(np.arange(size), sizes - 1)
            del a, line, here
            cold = w >= _COLD
            i = np.where(cold, m - 1, w)
            score = log_p[i]
            k = np.where(cold | (h >= _COLD), -1, (h + 1) * m + i)
            spot = _place(k, hot_keys)
            done = hot_keys[spot] == k
            score[done] += hot_gains[spot[done]]
            del k, spot
            sums = lambda x: np.bincount(at, x, size)  # noqa: E731, B023
            own = [batch.column(0), batch.column(1), pa.array(sizes - 1), pa.array(sums(~cold).astype(np.int64)), pa.array(sums(base[i])), pa.array(sums(score))]
            out = io.BytesIO()
            own = pa.RecordBatch.from_arrays(own, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])
            with pa.ipc.new_stream(out, own.schema) as stream:
                stream.write_batch(own)
            rows = [(chunk % buckets, 9, size, out.getvalue()), *_dealt(7, _mixed(w[cold]) % np.uint64(buckets), w[cold], at[cold])]
            h, w, at = h[~done], w[~done], at[~done]
            order = np.argsort(h, kind="stable")  # equal histories side by side take little room
            h, w, at = h[order], w[order], at[order]
            rows += _dealt(8, _bucket(h, w, split, buckets), h, w, at)
            packed = _batch(rows)
            yield pa.RecordBatch.from_arrays([*packed.columns, pa.array(np.full(len(rows), chunk))], names)
            chunk += 1

    def score_bucket(rows: pa.Table) -> pa.Table:
        _, counts, _, _, histories = sent.value
        unigrams = _of_kind(rows, 0, 2)
        order = np.argsort(unigrams[0])
        words, word_counts = (x[order] for x in unigrams)
        split_backoff = np.array([histories[k][1] if k in histories else 0.0 for k in range(-1, split)])
        h, w, c, wc = _of_kind(rows, 6, 4)
        if len(h):
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            kept = _factors(d2, c)
            log_p = log_of(_full_counts(w, wc, counts))
            total = np.add.reduceat(c, first)
            factor, backoff = _weights(total, np.add.reduceat(kept, first), np.add.reduceat(10**log_p, first))
            factor -= np.log10(total)
            ids = h[first]
            there = np.flatnonzero(ids < split)  # split histories are in many buckets
            if len(there):
                factor[there], backoff[there] = np.array([histories[int(x)] for x in ids[there]]).T
            gain = np.log10(kept) + np.repeat(factor, np.diff(np.r_[first, len(h)])) - log_p
            second, place = np.unique(w, return_inverse=True)
            codes = np.repeat(np.arange(len(ids)), np.diff(np.r_[first, len(h)])) * len(second) + place
        out = []
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k, size, blob, chunk in zip(*[rows.column(x).to_pylist() for x in ("kind", "n", "blob", "chunk")]):
            if k == 9:
                out.append((0, 9, size, blob, chunk))
            elif k == 7:
                qw, at = _unpack(blob, size, 2)
                x = np.zeros(size, np.int64)
                if len(words):
                    spot = _place(qw, words)
                    x = np.where(words[spot] == qw, word_counts[spot], 0)
                parts.setdefault(chunk, []).append((at, x > 0, base_of(x), log_of(x)))
            elif k == 8:
                qh, qw, at = _unpack(blob, size, 3)
                x = np.zeros(size)
                x[qh < split] = split_backoff[qh[qh < split] + 1]
                if len(h):
                    who, what = _place(qh, ids), _place(qw, second)
                    same = ids[who] == qh
                    x[same] = backoff[who[same]]
                    code = who * len(second) + what
                    spot = _place(code, codes)
                    hit = same & (second[what] == qw) & (codes[spot] == code)
                    x[hit] = gain[spot[hit]]
                parts.setdefault(chunk, []).append((at, np.zeros(size), np.zeros(size), x))
        for chunk, found in parts.items():
            at, *sums = (np.concatenate(c) for c in zip(*found))
            at, place = np.unique(at, return_inverse=True)
            known, base, score = (np.bincount(place, x, len(at)) for x in sums)
            out.append((0, 10, len(at), _pack(at, known.astype(np.int64), base, score), chunk))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, kinds)], names)

    def finish(rows: pa.Table) -> pa.Table:
        found = dict(zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist()))
        own = pa.ipc.open_stream(found[9]).read_all()
        sums = [own.column(x).to_numpy().astype(np.float64) for x in ("n_known", "base", "score")]
        for k, size, blob in zip(*[rows.column(x).to_pylist() for x in ("kind", "n", "blob")]):
            if k == 10:
                at, known, base, score = _unpack(blob, size, 4)
                for total, x in zip(sums, (known, base.view(np.float64), score.view(np.float64))):
                    total[at] += x
        known, base, score = sums
        told = [own.column("doc_id"), own.column("held_out"), own.column("n_tokens"), pa.array(known.astype(np.int64)), pa.array(np.full(len(known), n)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(told, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(local, schema)
    words = spark.read.schema("word string, c long").parquet(f"{model.folder}/order=1").where(F.col("c") < max(1, math.ceil(HOT_SHARE * n)))
    rows = rows.unionByName(_unigram_blobs(words, buckets), allowMissingColumns=True).unionByName(model.bigrams, allowMissingColumns=True)
    parts = rows.groupBy("bucket").applyInArrow(score_bucket, schema)
    return parts.groupBy("chunk").applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
