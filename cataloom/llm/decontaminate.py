"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits holds one of its k + 1 pieces unchanged. Pieces of all items are
found in one pass of an Aho-Corasick automaton, and the neighbourhood of each hit is searched for the whole item with
Myers' bit-parallel distance, so every occurrence within the budget is found and nothing else is reported. The budget is a
share of the item's length, with no least or greatest length; items so short that it is zero are found unchanged, where no
letter or digit goes on at either end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cataloom.llm.common import batches_of, materialize


@dataclass(frozen=True)
class EditBudget:
    """How many edits an item may have: a share of its length, rounded down."""

    error_rate: float = 0.08
    #: Items are sent to the executors in blocks of at most so many code points, one pass over the documents for each.
    block_chars: int = 4_000_000

    def edits(self, length: int) -> int:
        return min(int(length * self.error_rate), max(0, length - 1))


def normalised(text: str | None) -> str:
    """Words with A-Z lower-cased, one space between them."""
    return b" ".join(text.encode().lower().split()).decode() if text else ""


def myers_search(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least distance of pattern to any part of text, and where the first such part ends; null if over most."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = most + 1, -1
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return (best, end) if best <= most else None


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no word of text goes on over start or end."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


class ItemMatcher:
    """The automaton of a block of items [(item_id, normalised text)]."""

    def __init__(self, items: list[tuple[object, str]], budget: EditBudget):
        self.items = [(item, text, budget.edits(len(text))) for item, text in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((i, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item_id, distance, end, budget) for each item within budget, at its best place; end is in normalised(text)."""
        starts: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for i, offset in places:
                starts.setdefault(i, set()).add(end + 1 - offset)
        for i, found in starts.items():
            item, pattern, k = self.items[i]
            if not k:
                ends = [s + len(pattern) for s in found if _stands_alone(text, s, s + len(pattern))]
                if ends:
                    yield item, 0, min(ends), k
                continue
            best = None
            reach = -1
            spans: list[list[int]] = []
            for s in sorted(found):
                a, b = max(0, s - k), s + len(pattern) + k
                if spans and a <= reach:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
                reach = b
            for a, b in spans:
                hit = myers_search(pattern, text[a:b], k if best is None else best[0] - 1)
                if hit:
                    best = hit[0], a + hit[1]
                    if not best[0]:
                        break
            if best:
                yield item, best[0], best[1], k


#: The automaton that this worker used last, by its broadcast.
_LAST: dict[tuple[str, EditBudget], ItemMatcher] = {}


def _matcher(sent, budget: EditBudget) -> ItemMatcher:
    """A broadcast block's automaton, built once in each worker."""
    name, block = sent.value
    if (name, budget) not in _LAST:
        _LAST.clear()
        _LAST[name, budget] = ItemMatcher(block, budget)
    return _LAST[name, budget]


def blocks(items: DataFrame, budget: EditBudget, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items, read one by one and dealt into blocks of bounded size."""
    block: list[tuple[object, str]] = []
    size = 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        text = normalised(row.t)
        if not text:
            continue
        if block and size + len(text) > budget.block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, budget: EditBudget = EditBudget(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end, budget): one row for each document row and item that it holds within budget.

    distance is the least number of edits between the normalised item and a part of the normalised text, end where that
    part ends. Clean documents have no row. Null and empty texts hold nothing; null and empty items are not
    searched. Repeated document rows repeat their rows. Empty tables give no rows. Items in any number are searched, block
    after block; what is broadcast is bounded by block_chars.
    """
    spark = docs.sparkSession
    batches_of(spark)
    doc_kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = StructType([StructField("doc_id", doc_kind), StructField("item_id", item_kind), StructField("distance", IntegerType()), StructField("end", LongType()), StructField("budget", IntegerType())])
    arrow = to_arrow_schema(schema)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    found = None
    for block in blocks(items, budget, item_col, item_text_col):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def search(batches, sent=sent):
            matcher = _matcher(sent, budget)
            for batch in batches:
                ids, rows = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for row in matcher.matches(normalised(text)):
                        ids.append(doc_id)
                        rows.append(row)
                columns = [ids, *(zip(*rows) if rows else ((), (), (), ()))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

        hits = materialize(texts.mapInArrow(search, schema), "hits")
        sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, budget: EditBudget = EditBudget(), *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item, with docs' own columns; rows are judged one by one and none is moved.

    Null and empty texts stay. Each block of items is one more filter over the rows that earlier ones kept.
    """
    spark = docs.sparkSession
    batches_of(spark)
    names = docs.columns
    kept = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    for block in blocks(items, budget, item_col, item_text_col):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def clean(batches, sent=sent):
            matcher = _matcher(sent, budget)
            for batch in batches:
                yield batch.filter(pa.array([next(matcher.matches(normalised(t)), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept.toDF(*names)
