"""MinHash over shingle hashes with a seeded generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, HASHES, BANDS, ROWS, SEED = (1 << 31) - 1, 128, 32, 4, 0xC0FFEE


def coefficients(n: int = HASHES, seed: int = SEED) -> list[tuple[int, int]]:
    """(a, b) of each hash: alternate draws of the 48-bit linear congruential generator, low 31 bits, a made odd."""
    mask = (1 << 48) - 1
    state = (seed ^ 0x5DEECE66D) & mask

    def bits32() -> int:
        nonlocal state
        state = (state * 0x5DEECE66D + 0xB) & mask
        return state >> 16

    def low31() -> int:
        high, low = bits32(), bits32()
        low -= (low >> 31) << 32
        return ((high << 32) + low) & 0x7FFFFFFF

    return [(low31() | 1, low31()) for _ in range(n)]


def signature_udf(n: int = HASHES):
    """An Arrow function from an array of shingle hashes (unsigned 32 bits) to the signature; no shingles give PRIME everywhere."""
    pairs = coefficients(n)

    @F.pandas_udf("array<long>")
    def signature(hashes: pd.Series) -> pd.Series:
        sizes = np.array([0 if h is None else len(h) for h in hashes], np.int64)
        out = np.full((len(hashes), n), PRIME, np.int64)
        some = np.flatnonzero(sizes)
        if len(some):  # all rows' shingles at once, one hash after another
            flat = np.concatenate([np.asarray(hashes.iloc[i], np.int64) for i in some])
            starts = np.cumsum(sizes[some]) - sizes[some]
            for k, (a, b) in enumerate(pairs):
                out[some, k] = np.minimum.reduceat((a * flat + b) % PRIME, starts)
        return pd.Series(list(out))

    return signature


def signature_sql(hashes: Column, n: int) -> Column:
    """The same as an expression, for few hashes."""
    def least(a: int, b: int) -> Column:
        return F.coalesce(F.array_min(F.transform(hashes, lambda h: (h * F.lit(a) + F.lit(b)) % F.lit(PRIME))), F.lit(PRIME).cast("long"))

    return F.array(*[least(a, b) for a, b in coefficients(n)])


def estimated_jaccard(one: Column, two: Column) -> Column:
    """Share of equal places of two signatures."""
    same = F.aggregate(F.zip_with(one, two, lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    return same / F.size(one)
