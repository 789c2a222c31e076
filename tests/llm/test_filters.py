"""Operators 1, 3, 4 and 5 against plain versions."""

import hashlib
import re

import xxhash

from cataloom.llm import decontaminate, line_dedup, quality_rules, simhash
from cataloom.llm.cuckoo import CuckooFilter
from cataloom.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_stats(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    held = {i + k for i, g in enumerate(windows) if len(windows) > 1 and windows.count(g) > 1 for k in range(3)} if len(w) < 3000 else None
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), None if held is None else len(held)


def test_quality_measures(docs, rows):
    found = {}
    for r in quality_rules.host_quality(docs).collect():
        found.setdefault(r.doc_id, r)
    for r in rows:
        want = plain_stats(r[1])
        if r[0] is None:
            continue
        g = found[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines) == want[:4]
        if want[4] is not None:
            assert g.n_repeat_words == want[4]
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)
    assert quality_rules.host_quality(docs).count() == len(rows)


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "x"
    rows = [(i, good if i % 50 else bad, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(200)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    found = {r.doc_id: r for r in quality_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[1].kept and not found[0].kept
    assert not found[1000].kept and found[1000].host_rejected and not found[1000].base_failed
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept == {k for k, r in found.items() if r.kept}


def test_keep_good_keeps_columns(docs):
    assert quality_rules.keep_good(docs).columns == docs.columns


def plain_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for r in rows:
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                if len(key(line)) >= 10:
                    holders.setdefault(key(line), set()).add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_and_undo(spark, docs, rows):
    index = line_dedup.LineIndex(spark, scratch_path(spark, "t"))
    index.insert(docs.where("doc_id < 40"))
    before = got(index.refs())
    index.insert(docs)
    assert got(line_dedup.cleaned(docs, index, digest=True)) == plain_lines(rows)
    index.delete(docs.where("doc_id >= 40").select("doc_id"))
    assert got(index.refs()) == before
    index.insert(docs)
    assert got(line_dedup.cleaned(docs, index, digest=True)) == plain_lines(rows)


def test_lines_text(spark, docs):
    index = line_dedup.LineIndex(spark, scratch_path(spark, "t"))
    index.insert(docs)
    found = {r.doc_id: r.text for r in line_dedup.cleaned(docs, index).collect()}
    assert found[17] == " " and found[18] == "\n\n"


def test_cuckoo():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    f = CuckooFilter.for_keys(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    others = np.random.default_rng(2).integers(0, 2**63, 50_000).astype(np.uint64)
    assert f.contains(others).mean() < 0.001
    f = CuckooFilter.loads(f.dumps(), f.held)
    f.remove(keys[:20_000])
    assert f.contains(keys[20_000:]).all() and f.contains(keys[:20_000]).mean() < 0.001 and f.held == 30_000


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps):
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def test_simhash(docs, rows, spark):
    short = [r for r in rows if len(r[1] or "") < 20_000]
    fps = [(r[0], plain_fingerprint(r[1])) for r in short]
    roots = plain_components({f for _, f in fps})
    low = {}
    for i, f in fps:
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    want = sorted(((i, f, low.get(roots[f])) for i, f in fps), key=repr)
    found = simhash.near_duplicates(spark.createDataFrame(short, docs.schema)).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=repr) == want


def test_simhash_links(spark):
    """Fingerprints around centres, at most so many bits away: every component is found, none is split or joined."""
    import random

    rng = random.Random(3)
    fps = set()
    for _ in range(20):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = {r.fp % 2**64: r.component for r in simhash.fingerprint_components(spark.createDataFrame(signed, "fp long")).collect()}
    want = plain_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(found) == groups(want)


def _steps(monkeypatch):
    """What fingerprint_components writes, by name."""
    seen, write = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: seen.setdefault(name, df) and write(df, name))
    return seen


def test_simhash_broadcasts_no_variants(spark, monkeypatch):
    """Estimates leave out that there are 64 variants of each fingerprint; a broadcast of them ends a small driver."""
    steps = _steps(monkeypatch)
    fps = spark.range(3000).selectExpr("xxhash64(id div 2) ^ (id % 2) as fp")
    assert simhash.fingerprint_components(fps).select("component").distinct().count() == 1500
    buckets = steps["buckets"]
    assert buckets.count() == 3000 * 33  # one wild bit of the half that differs, all 32 of the other
    buckets.collect()
    assert "Broadcast" not in buckets._jdf.queryExecution().executedPlan().toString()


def test_pipeline_broadcasts_no_variants(spark, monkeypatch):
    """The pipeline's second stage: copies are dropped, and no join on the way broadcasts the variants."""
    import corpus_pipeline

    steps = _steps(monkeypatch)
    texts = [" ".join(f"w{(7 * i + k * k) % 997}" for k in range(300)) for i in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts[:50]])], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").where("doc_id >= 200").isEmpty()
    steps["buckets"].collect()
    assert "Broadcast" not in steps["buckets"]._jdf.queryExecution().executedPlan().toString()


def test_simhash_compares_each_once(spark, monkeypatch):
    """A large group of near copies: what its mixed buckets hold is compared once a fingerprint, not once a bucket."""
    import random

    rng, steps = random.Random(4), _steps(monkeypatch)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(2, 7))) for _ in range(700)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = {r.fp % 2**64: r.component for r in simhash.fingerprint_components(spark.createDataFrame(signed, "fp long")).collect()}
    want = plain_components(fps)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(found) == groups(want) and len(groups(want)) > 1
    assert 0 < steps["mixed"].count() <= len(fps)


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_decontamination(spark):
    import random

    rng = random.Random(2)
    vocabulary = ["river", "stone", "lamp", "cloud", "paper", "green", "house", "walk"]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(n))
    items = [(i, text(25)) for i in range(8)] + [(90, None), (91, ""), (92, "short")]
    docs = []
    for i in range(60):
        body = text(60)
        if i % 3 == 0:
            item = list(items[i % 8][1])
            for _ in range(i % 16):
                item[rng.randrange(len(item))] = rng.choice("qxz")
            body = body + "\n " + "".join(item).upper() + "  " + text(10)
        docs.append((i, body))
    docs += [(60, None), (61, ""), (None, items[2][1])]
    budget = decontaminate.EditBudget()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, p in items[:8]:
            dist = plain_distance(decontaminate.normalised(p), decontaminate.normalised(t))
            if dist <= budget.edits(len(p)):
                want.add((d, i, dist))
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(df, bench).collect()} == want
    small = decontaminate.EditBudget(block_chars=300)
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(df, bench, small).collect()} == want
    bad = {(d, t) for d, t in docs if any(d == x for x, _, _ in want)}
    assert {tuple(r) for r in decontaminate.drop_contaminated(df, bench, small).collect()} == set(docs) - bad


def test_empty(empty, spark):
    assert quality_rules.host_quality(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0
    index = line_dedup.LineIndex(spark, scratch_path(spark, "t"))
    index.insert(empty)
    assert line_dedup.cleaned(empty, index).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(empty, items).count() == 0
