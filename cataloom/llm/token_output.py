"""Token ids as ORC: stripes with integer run-length encoding, row indexes, and Bloom filters on document ids.

A written set is a folder of data/ (doc_id, part, local_start, n_tokens, token_ids), rows in ascending doc_id within
and across parts or in the order given, and manifest/ (part, base). A document starts at its part's base plus its local start, so
stripes are read in parallel and none needs another to know where it is.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cataloom.llm.common import batches_of, give_back, larger, small_side

END_ID = 2
#: What the ORC writer is told.
ORC = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
#: Parts of a manifest that are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 200_000

#: White space of any kind, as a class of RE2 patterns.
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
#: Texts that are not cut: three or more white spaces in a row, or two at the end, may be one piece of the pre-tokenizer.
_UNCUT = rf"[{_WHITE}]{{3}}|[{_WHITE}]{{2}}\z"
_PLAIN = rf"\A ?[^{_WHITE}]+\z"
#: Words that the pre-tokenizer leaves whole: a space or none, then letters of these blocks, which all versions of Unicode agree on.
_LETTERS = r"\A ?[A-Za-zªµºÀ-ÖØ-öø-ſ]+\z"
_ENDS_PLAIN = r"[\p{L}\p{N}]\z"
_MARKS = ".,;:!?"
#: Words that the library encodes in one call, and bytes of text that are worked on at once; both bound a worker's memory.
_WORDS_PER_CALL, _AT_ONCE = 10_000, 3 << 20
#: Batches after which a worker returns unused memory, as it does at a task's end; pages that come and go cost time.
_GIVE_BACK = 8


def _gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs at of a ragged array, one after another, and their sizes."""
    n = sizes[at]
    ends = np.cumsum(n)
    where = np.repeat(starts[at] - (ends - n), n)
    where += np.arange(len(where))
    return flat[where], n


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, from its bytes and their places."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    sizes = np.diff(offsets)
    place = np.arange(len(raw))
    place -= np.repeat(offsets[:-1] - offsets[0], sizes)
    factors = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    raw += np.uint64(1)
    raw *= factors[place]
    sums = np.r_[np.uint64(0), np.cumsum(raw)]
    at = offsets - offsets[0]
    return sums[at[1:]] - sums[at[:-1]]


class _Known:
    """Ids of words met before, as columns, found by hashes of the words. A word whose hash another one has is encoded each time.

    When there are too many, words that were met in one batch only go, and if that is not enough, all but those of the
    batch at hand.
    """

    MOST = 500_000

    def __init__(self, encode):
        self.encode = encode
        self.words = pa.array([], pa.string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.uint8)  # batches that met a word again, halved each time that words go
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in ascending order of the hashes

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Where the words are, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.where(self.hashes[near] == hashes, self.places[near], -1)
        hit = np.flatnonzero(at >= 0)
        other = pc.not_equal(self.words.take(pa.array(at[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        at[hit[other]] = -1
        return at

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and their number for each word."""
        hashes = _hashes(words)
        order = np.argsort(hashes)
        words, hashes = words.take(pa.array(order)), hashes[order]  # neighbours are looked up near each other
        at = self._find(words, hashes)
        new = at < 0
        unknown, old = words.filter(pa.array(new)), at[~new]
        flat, sizes = self.encode(unknown)
        self.met[old] = np.minimum(self.met[old] + 1, 15)
        if len(self.words) + len(sizes) > self.MOST:
            kept = self.met > 0
            if np.count_nonzero(kept) + len(sizes) > self.MOST:
                kept = np.zeros(len(self.words), bool)
                kept[old] = True
            self.flat, self.sizes = self.flat[np.repeat(kept, self.sizes)], self.sizes[kept]
            self.words, self.met = self.words.filter(pa.array(kept)), self.met[kept] // 2
            moved, still = np.cumsum(kept) - 1, kept[self.places]
            self.hashes, self.places = self.hashes[still], moved[self.places[still]]
            at[~new] = moved[old]
        at[new] = len(self.words) + np.arange(len(sizes))
        self.words = pa.concat_arrays([self.words, unknown])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(sizes), np.uint8)])
        into = np.searchsorted(self.hashes, hashes[new])
        self.hashes, self.places = np.insert(self.hashes, into, hashes[new]), np.insert(self.places, into, at[new])
        back = np.empty(len(order), np.int64)
        back[order] = at
        return _gather(_starts(self.sizes), self.sizes, self.flat, back)


class Encoder:
    """The tokenizers library's ids of whole texts, with words remembered.

    A byte-level pre-tokenizer gives a line break between two words a piece of its own and a space to the word after it, as
    long as white space stands in runs of two at most. So texts are cut at line breaks and spaces, and their distinct words
    are encoded by the library once while they are remembered, many in one call with a line break after each. Words of letters
    alone are one piece, so they pass by the pre-tokenizer's pattern: the library's model gets them cut at the line breaks. Marks at
    a word's end are pieces of their own too. Texts with longer runs or added tokens, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(model)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.cut = isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.library.pre_tokenizer.add_prefix_space and self.library.pre_tokenizer.use_regex and self.library.normalizer is None
        self.cut = self.cut and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"[\s.,;:!?]", t.content) or t.content[-1:].isalnum() for t in added)
        line = self._whole(["\n"])[0]
        self.line = line[0] if len(line) == 1 else None
        self.cut = self.cut and self.line is not None
        #: Added tokens part a text before all else, so texts that hold one are not cut either.
        self.uncut = "|".join([_UNCUT, *[re.escape(t.content) for t in added]])
        self.letters = Tokenizer(self.library.model)  # the same model, not a copy
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.Split("Ċ", "isolated")])
        self.known = _Known(self._encode_words)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with the space before it if it has one."""
        letters = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) & ~letters
        places, found = [], []
        for library, which in ((self.letters, letters), (self.library, plain)):
            places.append(np.flatnonzero(which))
            found.append(self._joined(library, words.filter(pa.array(which))))
        places.append(np.flatnonzero(~letters & ~plain))
        odd = self._whole(words.take(pa.array(places[-1])).to_pylist())
        found.append((np.array([i for x in odd for i in x], np.uint32), np.array([len(x) for x in odd], np.int64)))
        moved = np.concatenate([n for _, n in found])
        return _gather(_starts(moved), moved, np.concatenate([x for x, _ in found]), np.argsort(np.concatenate(places), kind="stable"))

    def _joined(self, library, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without white space but the space before them, many in a call with a line break after each."""
        ids = [np.zeros(0, np.uint32)]
        for k in range(0, len(words), _WORDS_PER_CALL):
            some = words.slice(k, _WORDS_PER_CALL)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), "\n")[0].as_py() + "\n"
            ids.append(np.frombuffer(array("I", library.encode_batch_fast([text], add_special_tokens=False)[0].ids), np.uint32))
        flat = np.concatenate(ids)
        line = flat == self.line
        return flat[~line], np.diff(np.flatnonzero(line), prepend=-1) - 1

    def _word_ids(self, words: pa.Array, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a space but those that are bare: those of its stem, then those of its marks."""
        stems = pc.ascii_rtrim(words, _MARKS)
        cut = pc.match_substring_regex(stems, _ENDS_PLAIN)
        stems = pc.if_else(cut, stems, words)
        marked = pc.not_equal(stems, words)
        marks = pc.struct_field(pc.extract_regex(words.filter(marked), rf"(?P<m>[{_MARKS}]*)\z"), 0)
        stems = pc.if_else(pa.array(bare), stems, pc.binary_join_element_wise(" ", stems, ""))
        both = pc.dictionary_encode(pa.concat_arrays([stems, marks, pa.array([""])]))
        flat, sizes = self.known.ids(both.dictionary)
        found = both.indices.to_numpy()
        at = np.full((len(words), 2), found[-1], np.int64)
        at[:, 0] = found[: len(words)]
        at[marked.to_numpy(zero_copy_only=False), 1] = found[len(words) : -1]
        flat, _ = _gather(_starts(sizes), sizes, flat, at.ravel())
        return flat, sizes[at].sum(1)

    def ragged(self, texts: pa.Array, last: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (no nulls), each followed by last, one after another, and their number for each text."""
        tail = np.array(last, np.uint32)
        if not self.cut or len(texts) and pc.any(pc.match_substring_regex(texts, self.uncut)).as_py():
            return self._mixed(texts, tail)
        lines = pc.split_pattern(texts, "\n")
        of_text = np.diff(lines.offsets.to_numpy())
        parts = pc.split_pattern(lines.flatten(), " ")
        first = parts.offsets.to_numpy().astype(np.int64)
        words = pc.dictionary_encode(parts.flatten())
        at, n_lines = words.indices.to_numpy().astype(np.int64) * 2, len(first) - 1
        first -= first[0]
        at[first[:-1]] += 1  # bare: nothing but a line's start before it
        used = np.flatnonzero(np.bincount(at, minlength=2 * len(words.dictionary)))
        flat, sizes = self._word_ids(words.dictionary.take(pa.array(used // 2)), used % 2 == 1)
        place = np.zeros(2 * len(words.dictionary), np.int64)
        place[used] = np.arange(len(used))
        n = len(used)
        flat, sizes = np.concatenate([flat, [self.line], tail]).astype(np.uint32), np.r_[sizes, 1, len(tail)]
        items = np.empty(len(at) + n_lines, np.int64)
        items[np.arange(len(at)) + np.repeat(np.arange(n_lines), np.diff(first))] = place[at]
        after = first[1:] + np.arange(n_lines)  # a line break after each line, last after each text
        items[after] = n
        ends = after[np.cumsum(of_text) - 1]
        items[ends] = n + 1
        flat, sizes = _gather(_starts(sizes), sizes, flat, items)
        return flat, np.diff(np.cumsum(sizes)[ends], prepend=0)

    def _mixed(self, texts: pa.Array, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where some texts are not cut."""
        whole = pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False) if self.cut else np.ones(len(texts), bool)
        found = [np.r_[np.array(x, np.uint32), tail] for x in self._whole(texts.filter(pa.array(whole)).to_pylist())]
        cut, sizes = self.ragged(texts.filter(pa.array(~whole)), tail.tolist()) if not whole.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        every = np.r_[[len(x) for x in found], sizes].astype(np.int64)
        order = np.argsort(np.r_[np.flatnonzero(whole), np.flatnonzero(~whole)], kind="stable")
        return _gather(_starts(every), every, np.concatenate([*found, cut]).astype(np.uint32), order)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        flat, sizes = self.ragged(pa.array(texts, pa.string()), [])
        return [x.astype("<u4").tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []


_LOADED: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in _LOADED:
        _LOADED[model] = Encoder(model)
    return _LOADED[model]


_DATA = "doc_id long, part string, local_start long, n_tokens long, token_ids array<int>"


def write_tokens(docs: DataFrame, folder: str, model: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_order: bool = False) -> None:
    """Encode whole texts and write them to folder in ascending doc_id, end_id after each document.

    Null texts are empty and give the end id alone. Ids are whole numbers: what can't be cast to one counts as no id. Rows
    without an id come first. Rows of one id are ordered by a hash of
    their text; equal rows keep any order, as they are equal. Empty tables give a folder without rows. Ranges of doc_id
    are dealt by sampled bounds, and ties are broken by the hash, so a repeated id is no hot part. With keep_order rows stay
    in the order of the files that docs was read from (file by file in the order of their names), and no text is moved.
    """
    spark = docs.sparkSession
    batches_of(spark)

    def encode(batches):
        e, task = encoder(model), f"{TaskContext.get().partitionId():09d}"
        starts: dict[str, int] = {}
        for k, batch in enumerate(larger(batches, _AT_ONCE)):
            flat, sizes = e.ragged(batch.column("text").fill_null(""), [end_id])
            ends, n = np.cumsum(sizes), batch.num_rows
            starts_at = ends - sizes
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat.view(np.int32)))
            names = batch.column("part").to_pylist() if keep_order else [task] * n
            cuts = [i for i in range(n) if not i or names[i] != names[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], n]):  # a run of rows of one part
                start = starts.get(names[a], 0)
                starts[names[a]] = start + int(ends[b - 1] - starts_at[a])
                starts_at[a:b] += start - starts_at[a]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(starts_at), pa.array(sizes), ids], ["doc_id", "part", "local_start", "n_tokens", "token_ids"])
            del flat, ids
            if k % _GIVE_BACK == _GIVE_BACK - 1:
                give_back()
        give_back()

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if keep_order:
        part = F.concat(F.col("_metadata.file_path"), F.lit(":"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0"))
        rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"), part.alias("part"))
    else:
        tie = F.xxhash64("text")
        rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(encode, _DATA).write.options(**ORC).orc(f"{folder}/data")
    totals = spark.read.schema(_DATA).orc(f"{folder}/data").groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")).write.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) of a written set. A filter on doc_id reaches the row indexes and Bloom filters."""
    data = spark.read.schema(_DATA).orc(f"{folder}/data")
    bases = small_side(spark.read.schema("part string, base long").parquet(f"{folder}/manifest"), BROADCAST_PARTS)
    return data.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "token_ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column("token_ids")
        at = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crcs = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of a written set, read from its files."""
    batches_of(spark)
    return read_tokens(spark, folder).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
