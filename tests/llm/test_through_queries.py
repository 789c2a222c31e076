"""The corpus queries on tables made to show what their methods do: bad hosts, second batches, shards, clashing columns."""

import functools
import itertools
import json
import math
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cataloom.llm import decontaminate, knn_quality, line_dedup, mixing, quality_rules, queries, simhash, token_counts, token_output, url_filter
from cataloom.session import scratch_path, table

from .test_filters import got, plain_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def bad_host(spark, tmp_path_factory):
    """Documents of eleven hosts: one of them is mostly boilerplate lines, which no base rule minds, another small one looks bad by chance."""
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(70))
    boiler = lambda i: "\n".join(["home about contact us", "all rights are kept here"] * 3 + [good(i)])
    rows = [(h * 1000 + i, good(h * 1000 + i) if (i * 7 + h) % 25 else "x y", "en", f"host{h}", 0) for h in range(10) for i in range(120)]
    rows += [(20_000 + i, boiler(i) if i % 10 else good(i), "en", "spam", 0) for i in range(200)] + [(30_000, boiler(1), "en", "tiny", 0), (30_001, good(7), "en", "tiny", 0), (30_002, None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("hosts"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_bad_host_goes_through_the_query(spark, bad_host):
    found = {r.doc_id: r for r in queries.op1_quality_rules(spark, bad_host).collect()}
    spam = [r for i, r in found.items() if 20_000 <= i < 30_000]
    assert all(r.host_rejected and not r.kept for r in spam) and not any(r.base_failed for r in spam)
    assert all(r.kept == (not r.base_failed) for i, r in found.items() if not 20_000 <= i < 30_000)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{bad_host}/documents.parquet/*.parquet')")
    want = con.execute(queries.OP1_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[n] for n in names) for r in found.values()) == sorted(want)
    kept = corpus_pipeline.quality(spark, table(spark, bad_host, "documents"), bad_host)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_pipeline_of_bad_host_and_empty_tables(spark, bad_host, empty, tmp_path):
    spark.conf.set(corpus_pipeline.OUTPUT, f"file://{tmp_path}/out")
    try:
        found = corpus_pipeline.run(spark, bad_host).collect()
    finally:
        spark.conf.unset(corpus_pipeline.OUTPUT)
    assert found and not any(20_000 <= r.doc_id < 30_000 for r in found)
    (kept,) = (tmp_path / "out").glob("tokens-*")  # what it makes stays in the caller's folder
    assert sorted(map(tuple, token_output.token_digest(spark, f"file://{kept}").collect())) == sorted(map(tuple, found))
    folder = str(tmp_path)
    empty.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_keep_clashing_columns(spark, docs, rows, tmp_path):
    names = ["gone", "__gone", "c0", "part", "shard", "order", "host", "key", "__text", "c1", "copies", "place"]
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    folder = str(tmp_path)
    spark.createDataFrame([(1, "no such passage in any of these texts")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}
    assert simhash.drop_near_duplicates(wide).where("doc_id is null").count() == 2


# -- token counts


def test_second_batch_finds_the_first(spark, docs, rows, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(queries.COUNT_MODEL)
    for most in (token_counts.BROADCAST_MISSES, 0):  # broadcast misses, then shuffled ones
        monkeypatch.setattr(token_counts, "BROADCAST_MISSES", most)
        cache = token_counts.DigestCache(spark, scratch_path(spark, "cache"))
        first, second = queries._arrivals(docs)
        assert first.count() and second.count() and first.count() + second.count() == len(rows)
        parts = [token_counts.token_counts(x, cache, path) for x in (first, second)]
        version = token_counts.tokenizer_version(path)
        stored = spark.read.parquet(f"{cache.folder}/{version}")
        assert stored.count() == stored.distinct().count() == len({r[1] or "" for r in rows})
        count = token_counts.counter(path)
        assert sorted(map(repr, ((r.doc_id, r.n_tokens) for p in parts for r in p.collect()))) == sorted(repr((r[0], count([r[1] or ""])[0])) for r in rows)


# -- line index


def test_index_opens_again_and_survives_failures(spark, docs, rows, monkeypatch):
    folder = scratch_path(spark, "t")
    first = line_dedup.LineIndex(spark, folder)
    first.insert(docs.where("doc_id < 30"))
    before = got(first.refs())

    def broken(self, state):
        raise OSError("no manifest")

    with monkeypatch.context() as m:
        m.setattr(line_dedup.LineIndex, "_commit", broken)
        with pytest.raises(OSError):
            line_dedup.LineIndex(spark, folder).insert(docs)
    again = line_dedup.LineIndex(spark, folder)
    assert again.version == 1 and got(again.refs()) == before
    again.insert(docs)
    assert got(line_dedup.cleaned(docs, line_dedup.LineIndex(spark, folder), digest=True)) == plain_lines(rows)


def test_index_compacts_and_deals_anew(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_SEGMENTS", 2)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 8)
    index = line_dedup.LineIndex(spark, scratch_path(spark, "t"))
    index.insert(docs.where("doc_id < 20"))
    shards = index.state["shards"]
    for low, high in ((20, 40), (40, 99)):
        index.insert(docs.where(f"doc_id >= {low} and doc_id < {high}"))
    assert index.state["shards"] > shards and len(index.state["refs"]) <= 2
    before = got(index.refs())
    index.delete(docs.where("doc_id >= 40").select("doc_id").unionByName(spark.createDataFrame([(10**9,), (None,)], "doc_id long")))
    held = index.filters().agg(F.sum("held")).first()[0]
    assert held == index.refs().count()  # dead keys have left the filters
    index.insert(docs)
    assert got(index.refs()) == before
    assert got(line_dedup.cleaned(docs, index, digest=True)) == plain_lines(rows)


def test_filters_decide_which_keys_meet_the_counts(spark, docs):
    """A filter that holds nothing makes all keys new, so its answers do reach the counts."""
    index = line_dedup.LineIndex(spark, scratch_path(spark, "t"))
    index.insert(docs.where("doc_id < 60"))
    probe = lambda: index._probed(index.refs().select(index._shard(index.state["shards"]), "k1", "k2", "refs", "first_doc"), index.state["shards"])
    assert probe().where("not maybe").count() == 0
    index.state = index.state | {"filters": []}
    assert probe().where("maybe").count() == 0


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("a", "one long line here\nanother"), ("7", "one long line here"), ("9", "one long line here")], "doc_id string, text string")
    index = line_dedup.LineIndex(spark, scratch_path(spark, "t"))
    index.insert(df)
    assert sorted(((r.doc_id, r.n_dropped) for r in line_dedup.cleaned(df, index).collect()), key=repr) == [(7, 0), (9, 1), (None, 0)]


# -- decontamination


def test_no_item_is_too_short_or_too_long(spark):
    words = ["river", "stone", "lamp", "cloud", "paper", "green"]
    long = " ".join(words[(i * i) % 6] + str(i) for i in range(700))
    items = [(1, "abc"), (2, "x"), (3, "a thirteen ch"), (4, long), (5, "seven words stand in this short item")]
    docs = [(0, "one ABC, two"), (1, "abcd"), (2, "y x z"), (3, "say a thirteem ch now"), (4, long[:50] + "qq" + long[52:]), (5, "seven words stood in this short item"), (6, "seven wxrds stxxd ix this shxrt item"), (7, "clean text")]
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(0, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 2), (5, 5, 2)}


# -- URL filter


def labelled():
    lines = (url_filter.Path(url_filter.__file__).parent / "seed_urls.txt").read_text().splitlines()
    return [(line[2:], int(line[0])) for line in lines if line and line[0] != "#"]


def plain_url_model(spark, pairs, grams):
    """The same gradient descent in numpy."""
    df = spark.createDataFrame(pairs, "url string, label int")
    rows = df.select(F.xxhash64("url", "label").alias("h"), url_filter.slots(url_filter.host(F.col("url")), url_filter.path(F.col("url")), grams).alias("s"), "label").orderBy("h").collect()
    x = np.zeros((len(rows), grams.slots))
    for i, r in enumerate(rows):
        np.add.at(x[i], r.s, 1 / math.sqrt(max(1, len(r.s))))
    y, w, b = np.array([r.label for r in rows], float), np.zeros(grams.slots), 0.0
    for _ in range(grams.epochs):
        e = y - 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w * (1 - grams.shrink) + grams.rate * (x.T @ e) / len(rows), b + url_filter._BIAS * grams.rate * e.sum() / len(rows)
    return w, b


def test_url_training_against_numpy(spark):
    grams = url_filter.Ngrams(slots=256, epochs=15)
    pairs = [p for k, p in enumerate(labelled()) if k % 4 == 0]
    w, b = plain_url_model(spark, pairs, grams)
    weights, bias = url_filter.train(spark.createDataFrame([*pairs, (None, 1), ("http://x", None)], "url string, label int").where("url is not null"), grams)
    assert np.allclose(weights, w) and bias == pytest.approx(b)


def test_url_held_out(spark):
    """Two quarters of the rows are judged by models that have not seen them."""
    pairs = labelled()
    assert len(pairs) == len(set(pairs)) <= 200
    right = wrong = 0
    for fold in range(2):
        inside = [p for p in pairs if zlib.crc32(p[0].encode()) % 4 != fold]
        outside = [p for p in pairs if zlib.crc32(p[0].encode()) % 4 == fold]
        model = url_filter.train(spark.createDataFrame(inside, "url string, label int"))
        found = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(outside)], "page_id long, url string"), model, [])
        hits = sum((r.verdict == "block") == bool(outside[r.page_id][1]) for r in found.collect())
        right, wrong = right + hits, wrong + len(outside) - hits
    assert right / (right + wrong) > 0.85, (right, wrong)


# -- mixing


def test_shards_hold_their_quotas(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, COLUMNS)
    plan = mixing.MixPlan(least_blocks=64, parts=16)
    found = mixing.mix(docs, plan).collect()
    units = Counter()
    for r in found:
        assert len(r.shards or []) == r.copies
        for shard in r.shards or []:
            units[shard] += 1
    assert set(units) == set(range(8))
    mixing.write_shards(docs, f"file://{tmp_path}/mix", plan)
    written = spark.read.parquet(f"file://{tmp_path}/mix")
    assert Counter((r.doc_id, r.shard) for r in written.collect()) == Counter((r.doc_id, s) for r in found for s in r.shards or [])
    # a source's share of each shard is near its share of the mix, as blocks are drawn from all of it
    every = Counter(r.source for r in found for _ in r.shards or [])
    for s in range(8):
        here = Counter(r.source for r in written.where(f"shard = {s}").collect())
        assert abs(here["hot"] / units[s] - every["hot"] / sum(every.values())) < 0.15
    # mixed_rows() goes shard after shard, and not in the order of ids within one
    order = {r.doc_id: r.shards for r in found}
    files = mixing.mixed_rows(docs, plan).select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    ids = [r.doc_id for r in files]
    at = 0
    for i in ids:  # some way through the shards exists that never goes back
        at = next(s for s in sorted(order[i]) if s >= at)
    assert ids != sorted(ids)


def test_targets_are_met_beside_long_documents(spark):
    """One document much longer than what is needed is passed over; shorter ones fill the gap."""
    rows = [(i, " ".join(["w"] * (5_000 if i % 1000 == 5 else 10)), "en", "a" if i < 3000 else "b", 0) for i in range(3400)]
    found = mixing.mix(spark.createDataFrame(rows, COLUMNS)).collect()
    for s in ("a", "b"):
        mine = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target
        assert all(r.taken <= 3 * r.size for r in mine)


def test_more_words_make_more_shards():
    plan = mixing.MixPlan()
    assert [plan.levels(n) for n in (0, 1, 64_000_000 * 8, 64_000_000 * 9, 64_000_000 * 1024)] == [3, 3, 3, 4, 10]
    assert plan.blocks(0) == 256 and plan.blocks(64_000_000 * 1024) == 32 * 1024


# -- classifier


@functools.cache
def plain_form(word):
    kind = lambda c: "A" if (k := unicodedata.category(c)) == "Lu" else "a" if k[0] in "LM" else "0" if k[0] == "N" else c
    return "".join(c if c in "Aa0" else "".join(same) for c, same in itertools.groupby(map(kind, word)))


def test_votes_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    p = knn_quality.KnnParams(rank=8, neighbours=5)
    space = knn_quality.train(docs, labels, p)
    texts = {r.doc_id: r.text for r in docs.collect()}
    named = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert sorted(space.labels.tolist()) == sorted(float(named[i]) for i in named if i in texts)
    x = knn_quality.features(pa.array([texts[i] for i in sorted(texts)]), p).astype(np.float64)
    for k, text in enumerate(texts[i] for i in sorted(texts)):  # terms counted one by one
        words, want = (text or "").encode().split(), np.zeros(p.slots)
        for w, before in zip(words, [None, *words]):
            want[zlib.crc32(w.lower()) % (p.slots - p.form_slots)] += 1
            form = plain_form(w.decode())
            want[p.slots - p.form_slots + zlib.crc32(form.encode()) % (p.form_slots - 1)] += 1
            want[-1] += w == before
        assert np.allclose(x[k], np.log1p(want), atol=1e-4)
    y = (x * space.idf) @ space.axes
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    near = y @ space.voters.T.astype(np.float64)
    for r in knn_quality.score(docs, space).collect():
        sims = near[sorted(texts).index(r.doc_id)]
        best = np.argsort(-sims)[:5]
        if sims[best[-1]] - np.sort(sims)[-6] < 1e-4:
            continue  # a tie that rounding decides
        weight = np.maximum(sims[best], 1e-6) ** p.sharpness
        assert r.score == pytest.approx(float((weight * space.labels[best]).sum() / weight.sum()), abs=1e-2)


def test_latent_vectors_carry_the_vote(spark):
    """Held-out balanced accuracy of all terms, and of words alone, without the forms of words."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    space = knn_quality.train(docs, labels)
    held = knn_quality.score(docs, space).where("held_out").join(labels, "doc_id").collect()
    rate = lambda q: sum(r.predicted == q for r in held if r.quality == q) / max(1, sum(r.quality == q for r in held))
    assert rate(1) > 0.95 and rate(0) > 0.7, json.dumps([rate(0), rate(1)])


def test_repeated_ids_are_one_voter(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a a"), (2, "c")] + [(1, "z z")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, quality int")
    one, two = (knn_quality.train(docs.repartition(n), labels) for n in (1, 3))
    assert len(one.labels) == len(two.labels) <= 2 and np.array_equal(one.idf, two.idf)


def test_registered_columns(spark):
    sf = "/root/testdata/sf0.001"
    mixed = queries.op8_mixing(spark, sf)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken", "shards", "place"] and mixed.where("taken > 0 and shards = ''").count() == 0
    assert quality_rules.HostRules().max_excess > 0
