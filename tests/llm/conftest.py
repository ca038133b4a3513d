import random

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()
#: Names that the operators use inside or return, all of the wrong type.
CLASH = "fp string, score string, h string, tokens string, length string, uid string, host string, k string, batch string, kind string, rep string, copy string, point string, spans string, shift string, a string, deal string, p string, x string, html string, page_id string, ids string"


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, odd characters."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (0, base, "en", "s0"), (1, base, "en", "s0"), (2, " ".join(near), "en", "s0"), (3, None, None, None), (4, "", "en", "s1"), (5, " \t\n", "fr", None), (6, "one", "en", "s1"), (7, "one two", None, "s1"), (None, "no id here at all", "en", "s0"),
        (8, prose(2, 30_000), "en", "s0"), (9, "é ü Straße\x0bx\x85y 😀 " * 40, "de", "s2"), (10, "aaaa" * 500, "en", "s2"), (10, "aaaa" * 500, "en", "s2"), (11, prose(3, 80) + "\n" + base[300:1500] + "\n" + prose(4, 80), "en", "s0"), (12, "Mail bob@example.com or +1 (743) 555-3824, 10.0.0.1, 4111 1111 1111 1111.", "en", "s0"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    n = len(CLASH.split(","))
    return spark.createDataFrame([(*r, len(r[1] or ""), *["?"] * n) for r in odd_rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 1, 0), (4, 0, 0), (6, 0, 1), (11, 1, 0), (12, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
