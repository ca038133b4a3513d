"""Phrase collocations against a dictionary version, at any width of the sketch."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from segquery.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=5, least=100, limit=2000):
    """All n-grams of all pieces, counted in a dictionary."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in candidates.items():
        inside = any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 100 * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in candidates.items())
        if not inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:limit]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [*"abcdefgh", "É", "été", "A", "x\x0bY", " ", "o'clock"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "! ", "\n", "\r"]) for _ in range(r.randrange(60))), r.choice(["en", "en", "fr", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("b a c a b. " * 30, "en"), ("b a c a b. " * 30, "en"), ("z " * 200, "fr")]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "limit"), [(3, 2000), (12, 2000), (12, 4)])
def test_equals_dictionary(spark, least, limit):
    rows = corpus(least)
    docs = spark.createDataFrame([(t, la, i % 3) for i, (t, la) in enumerate(rows)], "text string, lang string, score int").repartition(5)
    got = rows_of(collocations.top_collocations(docs, limit, min_count=least))
    assert got == plain(rows, least=least, limit=limit) and len(got) > 8


def test_any_width_and_cut(spark, monkeypatch):
    """A sketch full of collisions, and texts cut and flushed every few words, give the same rows."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = rows_of(collocations.top_collocations(docs, min_count=9))
    assert want == plain(rows, least=9)
    for name, small in (("HELD_WORDS", 50), ("HELD_BYTES", 20), ("VOCABULARY", 8), ("BLOCK", 3), ("GROUPS", 1)):
        monkeypatch.setattr(collocations, name, small)
    assert rows_of(collocations.top_collocations(docs.repartition(2), min_count=9, bits=6)) == want


def test_sketch_never_undercounts(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "text string, lang string")
    counts, totals = collocations.phrase_counts(docs, 3, 4, bits=16)
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or ("und" if lang is None else "")] += len(words)
            f.update((lang if lang is not None else "und", " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == {k: v for k, v in f.items() if v >= 4}
    assert {r.lang: r.n for r in totals.collect()} == dict(n)


def test_equal_hashes_are_told_apart():
    """Words of one hash stay different words."""
    ids = np.array([1, 2, 0, 1, 3, 0, 1, 2, 0])
    places = np.array([0, 3, 6])
    index, counts = collocations._distinct(2, ids, places, np.array([5, 5, 5], np.uint64))
    assert sorted(zip(ids[places[index] + 1].tolist(), counts.tolist(), strict=True)) == [(2, 2), (3, 1)]


def test_products_beyond_64_bits(spark):
    """a * n * 1000 and l * r pass 64 bits."""
    big = 3 * 10**12
    df = spark.createDataFrame([(big, 4 * big, big + 1, big + 3)], "a long, n long, l long, r long")
    got = df.selectExpr("cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as s").first().s
    assert got == 1000 * big * 4 * big // ((big + 1) * (big + 3))


def test_odd_rows(spark, odd, empty, odd_rows):
    want = plain([(r[1], r[2]) for r in odd_rows], least=5)
    assert rows_of(collocations.top_collocations(odd, min_count=5)) == want and want
    assert collocations.top_collocations(empty, min_count=5).count() == 0
    with pytest.raises(ValueError, match="at least"):
        collocations.phrase_counts(odd, min_count=0)
