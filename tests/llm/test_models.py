"""Operators 2, 6, 7, 8, 9 and 10, and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from cataloom.llm import katz, knn_quality, mixing, queries, token_counts, token_output, url_filter
from cataloom.session import scratch_path, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, docs, rows, model):
    path = public_tokenizers.path(model)
    cache = token_counts.DigestCache(spark, scratch_path(spark, "cache"))
    count = token_counts.counter(path)
    want = sorted(((r[0], len((r[1] or "").encode()), count([r[1] or ""])[0]) for r in rows), key=repr)
    found = token_counts.token_counts(docs, cache, path).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=repr) == want
    version = token_counts.tokenizer_version(path)
    n = cache.read(version).count()
    assert n == len({r[1] or "" for r in rows}) == spark.read.parquet(f"{cache.folder}/{version}").count()
    again = token_counts.token_counts(docs, cache, path).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, found), key=repr)
    assert spark.read.parquet(f"{cache.folder}/{version}").count() == n


def test_url_parts_and_rules(spark):
    urls = ["http://Example.NET/en/a?b", "https://x.example.net/de/", "http://a.org/fr/1", "http://a.org/de/", "https://www.example.com/de/x#y", "http://example.com", "net://net/", "http://a.net", None, "", "no scheme", "HTTP://A.NET?x=/", "http://badnet/x", "http://h/" + "p" * 50_000]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, None)], "page_id long, url string")
    model = url_filter.train(url_filter.seed_table(spark))
    found = url_filter.judge(pages, model).collect()
    assert len(found) == len(urls) + 2
    by = {r.page_id: r for r in found}
    want = {0: "example.net/en/", 1: "net/", 2: "org/fr/", 3: None, 4: "example.com/de/", 5: None, 6: "net/", 7: None, 8: None, 11: None, 12: None}
    assert {k: by[k].rule for k in want} == want
    assert (by[0].host, by[0].path, by[0].verdict, by[1].verdict) == ("example.net", "/en/a", "allow", "block")
    assert (by[8].host, by[8].path, by[5].path, by[11].host) == ("", "", "", "a.net")


def test_url_model(spark):
    model = url_filter.train(url_filter.seed_table(spark))
    fresh = [("http://casino-win.test/jackpot", "block"), ("http://free-porn-video.test/sex", "block"), ("https://library.test/articles/history", "allow"), ("https://museum.test/en/rivers", "allow")]
    found = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string"), model, [])
    assert [r.verdict for r in found.orderBy("page_id").collect()] == [v for _, v in fresh]
    assert url_filter.train(url_filter.seed_table(spark).limit(0))[1] == 0.0


def test_katz(spark, docs, rows):
    model = katz.train(docs, scratch_path(spark, "katz"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    toks = lambda t: [*WORD.findall(lower(t or "")), ""]
    c = Counter(w for r in rows if not held(r[0]) for w in toks(r[1]))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    found = katz.score(docs, model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    for r in rows:
        g = by[r[0]]
        if r[0] is None:
            continue
        t = toks(r[1])
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r[0]), len(t), sum(w in c for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert -math.inf < g.score < 0
    unigrams = spark.read.parquet(f"{model.folder}/order=1").collect()
    assert sum(model.discounts.get(r.c, 1.0) * r.c / model.tokens * model.keep for r in unigrams) + model.unseen == pytest.approx(1)


def test_good_turing():
    assert all(0 < x <= 1 for x in katz.good_turing({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}).values())
    assert all(0 < x < 1 for x in katz.good_turing({}).values())


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plain_targets(sizes)
    taken = Counter()
    for g in found:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source])
        assert g.taken % max(1, g.size) == 0 and g.taken <= 3 * g.size and len(g.shards or []) == g.copies
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(g.size for g in found if g.source == s)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    copies = Counter()
    for g in found:
        copies[g.doc_id] += g.copies
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == +copies


def test_split_is_exact(spark):
    quotas = {"a": 300, "b": 7, None: 41, "c": 0}
    shares = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 3, 17).collect()
    for s, q in quotas.items():
        assert sum(r.quota for r in shares if r.source == s) == q
    per_shard = Counter()
    for r in shares:
        assert r.quota >= 0
        per_shard[r.shard] += r.quota
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 1


def test_hypergeometric_mean(spark):
    from pyspark.sql import functions as F

    u = spark.createDataFrame([((i + 0.5) / 4000,) for i in range(4000)], "u double")
    n = u.select(mixing._left_draw(F.lit(30), F.lit(100), F.lit(40), F.col("u")).alias("n")).agg(F.avg("n"), F.var_samp("n"), F.min("n"), F.max("n")).first()
    assert n[0] == pytest.approx(12, abs=0.2) and n[1] == pytest.approx(12 * 0.7 * 60 / 99, rel=0.1) and n[2] >= 0 and n[3] <= 30


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for x in texts]


def test_token_output(spark, docs, rows):
    folder = scratch_path(spark, "tokens")
    token_output.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    found = sorted(token_output.token_digest(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    ids = dict(zip([r[0] for r in rows if r[0] is not None], plain_ids([r[1] for r in rows if r[0] is not None])))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]) // 4, zlib.crc32(ids[r.doc_id]))
    one = token_output.read_tokens(spark, folder).where("doc_id = 5").collect()
    assert np.array(one[0].token_ids, "<u4").tobytes() == ids[5]


def test_stripes_and_bloom_filters(spark):
    """Row indexes and Bloom filters are in the files, and a search for an id reads a row group, or none where it is absent."""
    base = 1 << 33
    docs = spark.range(20_000).selectExpr(f"id * 2 + {base} AS doc_id", "concat('text number ', id) AS text")
    token_output.write_tokens(docs, folder := scratch_path(spark, "bloom"), public_tokenizers.path("byte_bpe_50k.json"))
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    orc, conf = jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration()
    files = [x for x in spark.read.orc(f"{folder}/data").inputFiles() if x.endswith(".orc")]
    path = jvm.org.apache.hadoop.fs.Path(files[0])
    reader = orc.createReader(path, orc.readerOptions(conf))
    assert (reader.getRowIndexStride(), reader.getCompressionKind().toString()) == (1000, "ZSTD") and reader.getStripes().size() >= 1
    every = new(jvm.boolean, 7)
    for i in range(7):
        every[i] = True
    index = reader.rows().readRowIndex(0, every, every)
    held = [x is not None and x.getBloomFilterCount() > 0 for x in index.getBloomFilterIndex()]
    assert held == [False, True, False, False, False, False, False] and index.getRowGroupIndex()[1].getEntryCount() > 1

    def rows_read(doc_id):
        sargs = jvm.org.apache.hadoop.hive.ql.io.sarg
        wanted = sargs.SearchArgumentFactory.newBuilder().equals("doc_id", getattr(sargs.PredicateLeaf, "Type").LONG, doc_id).build()
        rows, batch, n = reader.rows(reader.options().searchArgument(wanted, new(jvm.java.lang.String, 0))), reader.getSchema().createRowBatch(), 0
        while rows.nextBatch(batch):
            n += batch.count()
        return n

    ids = [r.doc_id for r in spark.read.orc(files[0]).select("doc_id").collect()]
    assert all(0 < rows_read(i) <= 1000 < len(ids) for i in ids[1500:1510])
    assert sum(rows_read(i + 1) > 0 for i in ids[1500:1600]) < 10  # Bloom filters err for one in a hundred


def test_encoder_agrees(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()]
    texts += ["", " ", "  a", "a  b", "a   b\n c", "x\n\n y", "don't 's I'll", "a\tb \n c", "<|endoftext|> hi<|endoftext|>", "日本 語。 foo", "foo.\nBar, x", "foo.\n Bar", "a ", "a  ", "é\n\nb", "12.5 abc123 _x", "ª º µ"]
    e = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.known.MOST = 500
    got = [x for k in range(0, len(texts), 20) for x in e.encode(texts[k : k + 20])]
    assert [g + b"\2\0\0\0" for g in got] == plain_ids(texts)
    other = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.cut and len(other.encode(["Hello there"])[0]) == 8


def test_encoder_remembers():
    """Words met in several batches stay when there are too many, where only those of the batch at hand did."""
    e, encoded = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    plain, e.known.MOST = e.known.encode, 300
    e.known.encode = lambda words: (encoded.extend(words.to_pylist()), plain(words))[1]
    common = " ".join(f"often{chr(97 + k)}" for k in range(20))
    texts = [common, common, *[" ".join(f"rare{k}x{i}" for i in range(100)) for k in range(3)], common]
    assert [g + b"\2\0\0\0" for t in texts for g in e.encode([t])] == plain_ids(texts)
    assert encoded.count(" oftenc") == 1 and encoded.count(" rare0x5") == 1 and len(e.known.words) <= 300


def test_encoder_same_hashes(spark, sf, monkeypatch):
    """Words of one hash are told apart, and words of letters alone have the library's ids."""
    texts = [r.text for r in table(spark, sf, "documents").select("text").limit(60).collect()]
    texts += ["", "Ċ ĊĊ Ġa", "straße, Ærø ÿ ſ µm ªº × ÷ ×a a÷", "e\u0301t\u00e9 ﬁx", "don't 'tis 's", "日本 Ελλάδα слово", "a1 1a A", "x" * 5000, "é" * 3000]
    plain = token_output._hashes
    monkeypatch.setattr(token_output, "_hashes", lambda words: plain(words) % np.uint64(97))
    e = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for most in (500, 50):
        e.known.MOST = most
        got = [x for k in range(0, len(texts), 7) for x in e.encode(texts[k : k + 7])]
        assert [g + b"\2\0\0\0" for g in got] == plain_ids(texts)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    space = knn_quality.train(docs, labels)
    held = knn_quality.score(docs, space).where("held_out").join(labels, "doc_id").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in held) / len(held)
    assert right > 0.9 and all(0 <= r.score <= 1 for r in held)


def test_quality_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (15, 0), (16, 0), (3, None), (None, 1), (999, 1)], "doc_id long, quality int")
    space = knn_quality.train(docs, labels)
    found = knn_quality.score(docs, space).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert knn_quality.score(docs, knn_quality.train(docs, labels.limit(0))).count() == len(rows)


def test_empty(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(empty, token_counts.DigestCache(spark, scratch_path(spark, "c")), path).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), ([0.0] * url_filter.Ngrams().slots, 0.0)).count() == 0
    assert katz.score(empty, katz.train(empty, scratch_path(spark, "k"))).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    token_output.write_tokens(empty, folder := scratch_path(spark, "o"), path)
    assert token_output.token_digest(spark, folder).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert knn_quality.score(empty, knn_quality.train(empty, labels)).count() == 0


def test_registered():
    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())


def test_pipeline(spark, sf):
    """The pipeline against plain versions of its stages; the mix itself is checked by its own tests."""
    import corpus_pipeline

    from .test_filters import plain_components, plain_distance, plain_fingerprint  # noqa: F401
    from cataloom.llm import decontaminate, quality_rules

    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in quality_rules.host_quality(docs).where("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    roots = plain_components(set(fps.values()))
    low = {}
    for i, f in fps.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    items = [decontaminate.normalised(r.text) for r in table(spark, sf, "benchmark").collect()]
    rows = [r for r in rows if low[roots[fps[r.doc_id]]] == r.doc_id and not any(i in decontaminate.normalised(r.text) for i in items)]
    mixed = Counter({r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect() if r.copies})
    found = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in found) == mixed
    ids = dict(zip([r.doc_id for r in rows], plain_ids([r.text for r in rows])))
    at = 0
    for r in found:
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[r.doc_id]))
        at += r.n_tokens
