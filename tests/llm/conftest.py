import random

import pytest

WORDS = "the of and a to in is that it for was on are as with his they at be this have from or had by".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))))
        if k % 14 == 13:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, repeated rows and ids, near copies, shared passages, odd characters, a long text."""
    r = random.Random(11)
    base, passage = prose(r, 150), prose(r, 60)
    near = base.split(" ")
    near[70] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, base), (6, base), (6, base), (7, " ".join(near)), (None, base), (None, None),
            (8, prose(r, 40) + passage + prose(r, 30)), (9, prose(r, 20) + passage), (10, "é" * 250), (11, "xé" + "é" * 180), (12, "ab" * 300),
            (13, "Same Words here we go"), (14, "same words HERE we go"), (15, prose(r, 3000) + passage + passage), (16, "\U0001F642 smile <|endoftext|> x"),
            (17, "\x1c \x85 odd　space"), (8, prose(r, 25) + passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    """The odd rows with labels of clashing names for columns that operators use inside."""
    extra = [(i, t, "en" if k % 3 else "fr", None if k % 5 == 4 else f"s{k % 4}", len(t or ""), k, k, k, k, k) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "block long, size long, label int, digest int, rest int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
