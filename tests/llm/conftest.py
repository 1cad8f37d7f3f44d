import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, `Text Size` string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        out += [rng.choice(WORDS).capitalize(), *(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(k - 2)), rng.choice(WORDS) + "."]
    return " ".join(out[:n])


def rows(seed=1, n=40):
    """Plain texts, copies, near copies, repeated rows, nulls in every column, empty, blank and very long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(n)]
    out = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    out += [(100 + i, texts[0], "en", "s0", len(texts[0])) for i in range(8)]
    words = texts[1].split()
    out += [(200 + i, " ".join([*words[: 5 * i], "changed", *words[5 * i + 1 :]]), "en", "s1", None) for i in range(4)]
    out += [(300, None, None, None, None), (None, "a null id of some words", "en", "s2", 3), (None, None, None, None, None), (301, "", "en", None, 0), (302, " \n\t ", None, "s0", 4)]
    out += [(303, prose(rng, 30_000), "en", "s0", 1), (304, "x" * 200_000, "en", "s1", 2), (305, "é ñ ü 漢字 🙂", "fr", "s1", 9)]
    out += [(5, texts[5], "en", "s2", len(texts[5]))] * 3
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 0.5, "clash") for r in rows()], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
