import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key int, fp long, size long, block int"


def _prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, a hot source and hot lines."""
    rng = random.Random(5)
    base = _prose(rng, 120)
    near = base.replace("zeta", "zetta", 1)
    texts = [base] * 12 + [near, near + " more"] + [None, None, "", " ", "\n\n", "a", "one two", "# * $ %", "the end\nthe end\nthe end of all"]
    texts += [_prose(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += ["Common Line Here\n" + _prose(rng, 60) + "\n  common line here\t" for _ in range(15)]
    texts += [_prose(rng, 20_000), "x" * 50_000, "spam spam " * 300, "a  b   c\n\n d\t e", "日本 語。 <|endoftext|> don't", "<s> hello </s>"]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 3 else "hot" if i % 3 else f"src{i % 5}", None, "clash", 1, 2, 3, 4) for i, t in enumerate(texts)]
    out += [out[3], out[20], (None, "no id at all", "en", "hot", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
