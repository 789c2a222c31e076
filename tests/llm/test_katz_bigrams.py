"""Operator 7 against a plain count of all words and pairs."""

import math
import random
import zlib
from collections import Counter

import pytest

from cataloom.llm import katz
from cataloom.session import scratch_path

held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
toks = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [""]


def plain_model(texts):
    """log10 P(w | h) of training texts, and the words."""
    c = Counter(w for t in texts for w in toks(t))
    n = sum(c.values())
    d1, freed = katz.good_turing(Counter(c.values())), 0.0
    freed = sum((1 - d1.get(x, 1.0)) * x for x in c.values()) / n
    unseen = freed or 1 / (n + 1)
    keep = 1.0 if freed else 1 - unseen
    many = Counter(c.values())
    others = 1 + many[1] * max(many[1] - 1, 0) / (2 * (many[2] + 1))
    one = lambda w: d1.get(c[w], 1.0) * c[w] / n * keep if w in c else unseen / others
    by = {}
    for t in texts:
        for h, w in zip([None, *toks(t)], toks(t)):
            by.setdefault(h, Counter())[w] += 1
    d2 = katz.good_turing(Counter(x for seen in by.values() for x in seen.values()))

    def log_p(h, w):
        seen = by.get(h)
        if not seen:
            return math.log10(one(w))
        total = sum(seen.values())
        p = {x: d2.get(k, 1.0) * k / total for x, k in seen.items()}
        if 1 - sum(p.values()) <= 1e-12:
            p = {x: y * total / (total + 0.5) for x, y in p.items()}
        if w in p:
            return math.log10(p[w])
        return math.log10((1 - sum(p.values())) / (1 - sum(map(one, p))) * one(w))

    return log_p, c, others


@pytest.mark.parametrize("shares", [(1 / 2048, 2e-6, 1e-5), (0.03, 0.004, 0.006), (0.2, 0.02, 0.2)])
def test_every_word_bigram_counts(spark, docs, rows, monkeypatch, shares):
    for name, x in zip(("SPLIT_SHARE", "HOT_SHARE", "HOT_PAIR"), shares):
        monkeypatch.setattr(katz, name, x)
    model = katz.train(docs, scratch_path(spark, "katz"))
    log_p, c, others = plain_model([r[1] for r in rows if not held(r[0])])
    assert (model.tokens, model.types, model.unseen_words) == (sum(c.values()), len(c), pytest.approx(others))
    # one history's words and all unseen ones sum to 1
    for h in [None, *list(c)[:5], c.most_common(1)[0][0], "\0never"]:
        assert sum(10 ** log_p(h, w) for w in c) + others * 10 ** log_p(h, "\0never") == pytest.approx(1)
    want = sorted((str(r[0]), sum(log_p(*p) for p in zip([None, *toks(r[1])], toks(r[1])))) for r in rows)
    found = sorted((str(r.doc_id), r.score) for r in katz.score(docs, model).collect())
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [x for _, x in found] == pytest.approx([x for _, x in want])


def test_held_out_perplexity(spark, sf):
    """Held-out texts: word bigrams beat the base score a token, and random letters come out below all prose."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rng = random.Random(4)
    noise = [(10**6 + i, " ".join("".join(rng.choice("bcdfgklmprstvz") for _ in range(7)) for _ in range(200))) for i in range(30)]
    model = katz.train(docs, scratch_path(spark, "katz"))
    found = katz.score(docs.unionByName(spark.createDataFrame([r for r in noise if held(r[0])], "doc_id long, text string")), model).where("held_out and n_tokens > 50").collect()
    prose = [r for r in found if r.doc_id < 10**6]
    assert sum(r.score for r in prose) > sum(r.base_score for r in prose)
    mean = sum(r.score / r.n_tokens for r in prose) / len(prose)
    assert max(r.score / r.n_tokens for r in found if r.doc_id >= 10**6) < mean


def test_empty_and_untrained(spark, empty, docs):
    model = katz.train(empty, scratch_path(spark, "katz"))
    assert katz.score(empty, model).count() == 0
    assert {r.n_known for r in katz.score(docs, model).collect()} == {0}
