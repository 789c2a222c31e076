"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of each source are dealt into blocks by a permuting hash. The mix takes every block a whole number of times
and so many blocks once more that the source comes to its target. The taken blocks of all sources are then split among
output shards: at each node of a binary tree the numbers of blocks of each source that go left are drawn from the
multivariate hypergeometric distribution, so quotas are exact and each shard is a fair sample of the mix. Blocks are
drawn without overlap in permuted order, and rows are shuffled inside their shard. All of it is DataFrame expressions, and
what is not per document is a row for each source and block, whose number a parameter bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import WORD, materialize, small_side


@dataclass(frozen=True)
class MixPlan:
    """Weights go round over the sources in order; no source is repeated more than most_repeats times."""

    weights: tuple[int, ...] = (5, 2, 1)
    most_repeats: int = 3
    #: There are 2 ** levels output shards: so many that one has about shard_words words, 2 ** least_levels at least.
    shard_words: int = 64_000_000
    least_levels: int = 3
    #: Blocks of a source for each shard, blocks at least, parts of a block that is cut, blocks that may be cut to meet the target,
    #: and walks through the blocks (one for each that is too large, passed over).
    shard_blocks: int = 32
    least_blocks: int = 256
    parts: int = 256
    cut_blocks: int = 8
    passes: int = 4
    seed: int = 17

    def levels(self, words: int) -> int:
        return max(self.least_levels, math.ceil(math.log2(max(1, words) / self.shard_words)))

    def blocks(self, words: int) -> int:
        return max(self.least_blocks, self.shard_blocks << self.levels(words))


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key): words of each row's whole text; null texts have none. key tells rows apart."""
    key = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"))


def _uniform(*columns: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in columns]), 11) / float(1 << 53)


def targets(by_source: DataFrame, plan: MixPlan) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, weigh plan.weights in turn and share all words. A target over most_repeats
    times its source stops there and the excess is reshared by weight among the rest, until none is above. The source list
    is one row for each source; shares are found by SQL aggregates, one pass for each time that a source is stopped.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.get(F.array(*map(F.lit, plan.weights)), ((F.row_number().over(order) - 1) % len(plan.weights)))
    state = materialize(by_source.withColumn("weight", w.cast("double")).withColumn("stopped", F.lit(False)), "sources")
    while True:
        room = F.col("source_size") * float(plan.most_repeats)
        total = state.agg(
            F.sum("source_size").cast("double").alias("all"),
            F.sum(F.when(F.col("stopped"), room)).alias("fixed"),
            F.sum(F.when(~F.col("stopped"), F.col("weight"))).alias("weight"),
        ).first()
        if not total["weight"]:
            share = F.lit(0.0)
        else:
            share = F.lit(((total["all"] or 0.0) - (total["fixed"] or 0.0)) / total["weight"]) * F.col("weight")
        priced = state.withColumn("target", F.when(F.col("stopped"), room).otherwise(share))
        over = priced.where(~F.col("stopped") & (F.col("target") > room))
        if over.isEmpty():
            return priced.drop("stopped")
        state = materialize(priced.withColumn("stopped", F.col("stopped") | (F.col("target") > room)).drop("target"), "sources")


def _left_draw(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """A hypergeometric draw by its inverse distribution: how many of the marked are among the drawn of total."""
    low = F.greatest(F.lit(0), drawn + marked - total)
    high = F.least(marked, drawn)
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    ratios = F.transform(steps, lambda k: F.log(((marked - k) * (drawn - k)).cast("double")) - F.log(((k + 1) * (total - marked - drawn + k + 1)).cast("double")))

    def grow(a: Column, x: Column) -> Column:
        now = a["now"] + x
        top = F.greatest(a["top"], now)
        return F.struct(now.alias("now"), top.alias("top"), (a["sum"] * F.exp(a["top"] - top) + F.exp(now - top)).alias("sum"))

    def count(r: Column) -> Column:
        all_ = F.aggregate(r, F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum")), grow)
        return _let(all_["top"] + F.log(all_["sum"]), lambda norm: below(r, norm))

    def below(r: Column, norm: Column) -> Column:
        first = F.exp(-norm)
        start = F.struct(F.lit(0.0).alias("now"), first.alias("sum"), F.when(first <= u, 1).otherwise(0).cast("bigint").alias("n"))

        def step(a: Column, x: Column) -> Column:
            upto = a["sum"] + F.exp(a["now"] + x - norm)
            return F.struct((a["now"] + x).alias("now"), upto.alias("sum"), (a["n"] + F.when(upto <= u, 1).otherwise(0)).alias("n"))

        return F.aggregate(r, start, step)["n"]

    return F.least(low + _let(ratios, count), high)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw_source(seed: int, level: int):
    """The step that draws one source's part of a node's left half from what earlier draws left."""

    def draw(a: Column, s: Column) -> Column:
        got = _left_draw(s["quota"], a["total"], a["left"], _uniform(seed, level, F.col("shard"), s["source"]))
        return _let(got, lambda n: F.struct((a["total"] - s["quota"]).alias("total"), (a["left"] - n).alias("left"), F.concat(a["out"], F.array(n)).alias("out")))

    return draw


def _left_part(s: Column, n: Column) -> Column:
    return F.struct(s["source"].alias("source"), n.alias("quota"))


def _right_part(s: Column, n: Column) -> Column:
    return F.struct(s["source"].alias("source"), (s["quota"] - n).alias("quota"))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, shard, quota): exact numbers of blocks (source, quota), divided among 2 ** levels shards.

    Every node halves its blocks; the halves' composition is drawn source by source, each from what earlier draws left, which
    is the multivariate hypergeometric distribution. A node is one row with an array of its sources.
    """
    pair = F.struct(F.col("source"), F.col("quota").cast("bigint").alias("quota"))
    node = quotas.agg(F.array_sort(F.collect_list(pair)).alias("sources")).withColumn("shard", F.lit(0))
    for level in range(levels):
        total = F.aggregate("sources", F.lit(0).cast("bigint"), lambda a, s: a + s["quota"])
        half = F.floor((total + F.pmod(F.col("shard"), F.lit(2))) / 2).cast("bigint")
        none = F.array().cast("array<bigint>")
        start = F.struct(total.alias("total"), half.alias("left"), none.alias("out"))
        drawn = node.withColumn("left", F.aggregate("sources", start, _draw_source(seed, level))["out"])
        sides = F.array(*[F.struct((2 * F.col("shard") + side).alias("shard"), F.zip_with("sources", "left", pick).alias("sources")) for side, pick in enumerate((_left_part, _right_part))])
        node = materialize(drawn.select(F.explode(sides).alias("x")).select("x.sources", "x.shard"), "nodes")
    return node.select("shard", F.explode("sources").alias("s")).select("s.source", "shard", "s.quota")


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _dealt(rows: DataFrame, plan: MixPlan, words: int) -> DataFrame:
    """rows (with key) and the block and part that their key falls into."""
    block = F.pmod(F.xxhash64("key", F.lit(plan.seed)), F.lit(plan.blocks(words))).cast("int")
    part = F.pmod(F.xxhash64("key", F.lit(plan.seed + 1)), F.lit(plan.parts)).cast("int")
    return rows.withColumn("block", block).withColumn("part", part)


def _taken(blocks: DataFrame, plan: MixPlan) -> DataFrame:
    """blocks (source, order, words, rest) with extra: taken whole, need: what is left of rest, and cut: whose parts are to fill it.

    Blocks are walked through in order as long as they fit; one that does not is passed over and the walk goes on behind it, passes
    times. All are windows over the few rows of a source, in one order.
    """
    everything = Window.partitionBy("source")
    walk = everything.orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumns({"extra": F.lit(False), "need": F.col("rest").cast("double"), "behind": F.lit(0)})
    for _ in range(plan.passes):
        open_ = ~F.col("extra") & (F.col("order") > F.col("behind"))
        out = out.withColumn("open", open_).withColumn("upto", F.sum(F.when(F.col("open"), F.col("words")).otherwise(0)).over(walk))
        out = out.withColumn("fits", F.col("open") & (F.col("upto") <= F.col("need")))
        passed = F.min(F.when(F.col("open") & ~F.col("fits"), F.col("order"))).over(everything)
        got = F.sum(F.when(F.col("fits"), F.col("words")).otherwise(0)).over(everything)
        out = out.withColumns({"behind": F.coalesce(passed, F.lit(1 << 30)), "need": F.col("need") - got, "extra": F.col("extra") | F.col("fits")})
    rank = F.sum(F.when(F.col("extra"), 0).otherwise(1)).over(walk)
    return out.withColumn("cut", ~F.col("extra") & (F.col("need") > 0) & (rank <= plan.cut_blocks)).drop("open", "upto", "fits", "behind")


def _fill(parts: Column, need: Column) -> Column:
    """Those of parts (order, part, words, block), in order, that fit into what is still needed; then the smallest other one, if that comes nearer."""
    none = parts[0]
    start = F.struct(need.cast("double").alias("left"), F.filter(parts, lambda x: F.lit(False)).alias("taken"), F.lit(None).cast("struct<words:bigint,block:int,part:int>").alias("spare"))

    def step(a: Column, x: Column) -> Column:
        fits = x["words"] <= a["left"]
        spare = F.struct(x["words"].alias("words"), x["block"].alias("block"), x["part"].alias("part"))
        return F.struct(
            F.when(fits, a["left"] - x["words"]).otherwise(a["left"]).alias("left"), F.when(fits, F.concat(a["taken"], F.array(x))).otherwise(a["taken"]).alias("taken"),
            F.when(fits, a["spare"]).otherwise(F.least(a["spare"], spare)).alias("spare"),
        )

    def finish(a: Column) -> Column:
        last = F.struct(none["order"].alias("order"), a["spare"]["part"].alias("part"), a["spare"]["words"].alias("words"), a["spare"]["block"].alias("block"))
        return F.when(a["spare"]["words"] < 2 * a["left"], F.concat(a["taken"], F.array(last))).otherwise(a["taken"])

    return F.aggregate(parts, start, step, finish)


def block_fates(rows: DataFrame, plan: MixPlan, words: int) -> tuple[DataFrame, DataFrame]:
    """What befalls each block, from rows (source, block, part, size) of so many words.

    The first table is (source, block, source_size, target, base, extra, cut, shards): copies that all rows take, one more
    for the whole block or for the parts in the second table, and the shard of each copy. The second is (source, block,
    part). They hold blocks and cut_blocks * parts rows for each source at most, whatever the number of documents.
    """
    blocks = materialize(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    aims = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), plan)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(plan.most_repeats))).otherwise(0)
    aims = aims.withColumn("base", whole.cast("int")).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")).withColumnRenamed("source", "s")
    permuted = Window.partitionBy("source").orderBy(_uniform(plan.seed, F.col("source"), F.col("block")), "block")
    upto = _taken(blocks.join(aims, _same_source("source", "s")).withColumn("order", F.row_number().over(permuted)), plan)
    upto = materialize(upto.drop("s"), "upto")
    cut = small_side(upto.where("cut").select(F.col("source").alias("s"), F.col("block").alias("b"), "order", "need"), BROADCAST_ROWS)
    parts = rows.join(cut, _same_source("source", "s") & (F.col("block") == F.col("b"))).groupBy("source", "block", "part").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("order").alias("order"))
    listed = parts.groupBy("source").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("order", "part", "words", "block"))).alias("parts"))
    parts = materialize(listed.select("source", F.explode(_fill(F.col("parts"), F.col("need"))).alias("p")).select("source", "p.block", "p.part"), "parts")
    touched = parts.select(F.col("source").alias("s"), F.col("block").alias("b"), F.lit(True).alias("some")).distinct()
    units = upto.join(touched, _same_source("source", "s") & (F.col("block") == F.col("b")), "left")
    copies = F.col("base") + (F.col("extra") | F.coalesce("some", F.lit(False))).cast("int")
    units = units.withColumn("copies", copies).where("copies > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    shares = split_quotas(units.groupBy("source").agg(F.count("*").alias("quota")), plan.levels(words), plan.seed)
    shares = shares.withColumn("last", F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))).where("quota > 0").withColumnRenamed("source", "s")
    drawn = Window.partitionBy("source").orderBy(_uniform(plan.seed + 3, F.col("source"), F.col("block"), F.col("copy")), "block", "copy")
    units = units.withColumn("rank", F.row_number().over(drawn))
    units = units.join(shares, _same_source("source", "s") & (F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("quota")))
    shards = units.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    shards = shards.select(F.col("source").alias("s"), F.col("block").alias("b"), "shards")
    fate = upto.join(shards, _same_source("source", "s") & (F.col("block") == F.col("b")), "left")
    return materialize(fate.select("source", "block", "source_size", "target", "base", "extra", "cut", "shards"), "fates"), parts


#: Rows of a table by source and block that are broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _with_fates(rows: DataFrame, fates: DataFrame, parts: DataFrame, plan: MixPlan) -> DataFrame:
    """rows (source, block, part, key and others) with source_size, target, copies, shards and place."""
    fates = small_side(fates.withColumnRenamed("source", "fs").withColumnRenamed("block", "fb"), BROADCAST_ROWS)
    parts = small_side(parts.select(F.col("source").alias("ps"), F.col("block").alias("pb"), F.col("part").alias("pp"), F.lit(True).alias("in_part")), BROADCAST_ROWS)
    found = rows.join(fates, _same_source("source", "fs") & (F.col("block") == F.col("fb")))
    found = found.join(parts, _same_source("source", "ps") & (F.col("block") == F.col("pb")) & (F.col("part") == F.col("pp")), "left")
    more = (F.col("extra") | (F.col("cut") & F.coalesce("in_part", F.lit(False)))).cast("int")
    return found.withColumn("copies", F.least(F.col("base") + more, F.lit(plan.most_repeats))).withColumn("place", F.xxhash64("key", F.lit(plan.seed + 2)))


def _words(rows: DataFrame) -> int:
    return rows.agg(F.sum("size")).first()[0] or 0


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), **columns: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, shards, place) of each row.

    copies is how often the mix takes the row, from 0 to most_repeats; taken is copies * size; shards are where its copies
    go, place is the row's permuted place there. A source's words come to its target as near as the parts of its cut blocks do.
    Null sources are one source, the last; null texts have size 0. Repeated rows share a block and a fate. Empty tables give
    no rows. Reruns agree, as all draws are hashes of content and seed.
    """
    sized = materialize(sizes(docs, **columns), "sizes")
    words = _words(sized)
    rows = _dealt(sized, plan, words)
    found = _with_fates(rows, *block_fates(rows, plan, words), plan)
    shards = F.when(F.col("copies") > 0, F.slice("shards", F.lit(1), F.greatest("copies", F.lit(1))))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), shards.alias("shards"), "place")


def _copied(docs: DataFrame, plan: MixPlan, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(c0, c1, ..., shard, order): docs' columns by number, a row for each copy, and where the copy goes."""
    names = docs.columns
    sized = materialize(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col), "sizes")
    words = _words(sized)
    fates, parts = block_fates(_dealt(sized, plan, words), plan, words)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {name: F.col(f"c{names.index(name)}") for name in (id_col, source_col, text_col)}
    inner = inner.withColumn("source", at[source_col].cast("string")).withColumn("key", F.xxhash64(at[id_col], at[source_col], at[text_col]))
    found = _with_fates(_dealt(inner, plan, words), fates, parts, plan).where("copies > 0")
    copied = found.withColumn("shard", F.explode(F.slice("shards", F.lit(1), F.col("copies"))))
    return copied.select(*inner.columns[: len(names)], "shard", F.xxhash64("place", "shard").alias("order"))


def mixed_rows(docs: DataFrame, plan: MixPlan = MixPlan(), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' own columns, whatever their names: shard after shard, shuffled inside each.

    Partitions are ranges of (shard, order), so files written from them follow each other in the mix's order, and a
    large shard is many tasks. Nulls and empty tables are as in mix().
    """
    copied = _copied(docs, plan, id_col, text_col, source_col)
    names = docs.columns
    return copied.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])


def write_shards(docs: DataFrame, folder: str, plan: MixPlan = MixPlan(), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """The mix as Parquet, a folder shard=N for each output shard, with files in the shard's order; a column of docs must not be called shard."""
    names = docs.columns
    copied = _copied(docs, plan, id_col, text_col, source_col).repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
    copied.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], "shard").write.partitionBy("shard").parquet(folder)
