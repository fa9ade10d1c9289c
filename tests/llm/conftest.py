import random

import pytest

#: Rows that every document operator must bear: nulls, empty and white texts, ties, repeated rows, long texts.
WORDS = ["the", "Of", "AND", "été", "Straße", "x1", "don't", "a|b", "#tag", "ΣΑΣ", "日本語", "😀ok", "end.", "--"]


def odd_documents(n: int = 60, seed: int = 7) -> list[tuple]:
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    shared = ["  Shared line number one that is certainly long enough to count \t", "another passage which returns in many documents, over and over again"]
    rows = [(None, "no id " + line(30), "en", "s0"), (None, None, None, None), (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \t\n\r\x0b\x0c ", None, "s1"), (4, "one", "de", None), (5, line(3000), "en", "s0"), (5, "same id, other text " + line(20), "en", "s0")]
    for i in range(10, 10 + n):
        text = "\n".join([line(r.randint(1, 40)) for _ in range(r.randint(1, 6))] + r.sample(shared, r.randint(0, 2)) + ([shared[0].upper()] if i % 5 == 0 else []))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None])))
    return rows + rows[-5:] + [(1000 + i, *x[1:]) for i, x in enumerate(rows[-7:])]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with a column that clashes with names used inside."""
    rows = odd_documents()
    schema = "doc_id bigint, text string, lang string, source string, n_words string, bucket int, _w int, h1 int, value int, n int, ids int, window int"
    return spark.createDataFrame([(*x, "clash", 1, 1, 1, 1, 1, 1, 1) for x in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
