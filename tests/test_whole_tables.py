"""Queries without SQL run over whole tables."""

from pyspark.sql import functions as F

import __spark_entry__ as driver
from cataloom.functions import minhash
from cataloom.functions.text import match_key
from cataloom.operators import resolve
from cataloom.sources import fixtures


def test_every_product_is_resolved(spark, sf):
    found = driver.queries()["resolved_offers"](spark, sf).collect()
    ids = {r.id: r.key for r in fixtures.product(spark, sf).select("id", match_key(F.col("name")).alias("key")).collect()}
    by = {int(r.url.rsplit("/", 1)[1]): r for r in found}
    assert len(found) == len(ids) and set(by) == set(ids)
    assert {r.how for r in found} == {"url", "name", "new"}
    assert all(by[i].product_id == str(i) and by[i].how == "url" for i in ids if i % 4 == 0)
    for i in ids:
        if i % 4 == 1:  # the same match key, so the smallest id of that key
            assert by[i].how == "name" and int(by[i].product_id) == min(j for j in ids if ids[j] == ids[i])


def test_full_signatures_and_candidates(spark, sf):
    names = resolve.name_shingles(fixtures.product(spark, sf)).select("key", resolve.shingle_hashes(F.col("shingles")).alias("h")).collect()
    sigs = {r.key: tuple(min(((a * h + b) % minhash.PRIME for h in r.h), default=minhash.PRIME) for a, b in minhash.coefficients(128)) for r in names}
    assert {r.key: tuple(map(int, r.sig.split(","))) for r in driver.queries()["minhash_signature_full"](spark, sf).collect()} == sigs
    alike = lambda x, y: any(x[i : i + 4] == y[i : i + 4] for i in range(0, 128, 4))
    want = sorted((a, b) for a in sigs for b in sigs if a < b and alike(sigs[a], sigs[b]))
    found = sorted(map(tuple, driver.queries()["lsh_candidates_full"](spark, sf).collect()))
    assert found == want
