import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from segquery.llm import pii

#: The contract's patterns, applied plainly.
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_on_random_texts():
    r = random.Random(0)
    parts = ["a@b.c", "@", "a@b", ".", "..", "x.y@z-1.co.uk", "+1 (743) 555-3824", "+", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "007.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "12345", "0", "é", "\n", "%", "_", "a", "(", ")", "５５"]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "1 " * 20_000, "." * 100_000 + "@x.y"):
        pii.all_spans(t, {})


def test_best_segmentation_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(80):
        n = int(rng.integers(1, 7))
        cand = [(i, j, k, float(rng.normal())) for i in range(n) for j in range(i + 1, n + 1) for k in range(4) if rng.random() < 0.3]
        sets = [c for m in range(n + 1) for c in itertools.combinations(cand, m) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))] if len(cand) < 14 else None
        if sets is None:
            continue
        got = {c[:3]: c[3] for c in cand}
        assert sum(got[s] for s in pii.best_segments(n, cand)) == pytest.approx(max(sum(c[3] for c in s) for s in sets))
        log_z, p = pii.expected_counts(n, cand)
        assert log_z == pytest.approx(np.log(sum(np.exp(sum(c[3] for c in s)) for s in sets)))
        for c, x in zip(cand, p, strict=True):
            assert x == pytest.approx(sum(np.exp(sum(y[3] for y in s)) for s in sets if c in s) / np.exp(log_z))


def test_held_out_accuracy():
    w = pii.trained_weights()
    hit = said = real = 0
    for text, gold in pii._made(np.random.default_rng(99), 400):
        got = set(pii.all_spans(text, w)[1])
        hit, said, real = hit + len(got & set(gold)), said + len(got), real + len(gold)
    assert hit / real > 0.9 and hit / said > 0.9


@pytest.mark.parametrize(("text", "spans"), [("call (743) 555-3824 now", [(3, 5, 19)]), ("bob [at] foo [dot] com", [(0, 0, 22)]), ("on 2024-05-06 we", []), ("version 2.1.3 of 1999", []), ("write bob at example dot com today", [(0, 6, 28)]), ("bob at example dot co dot uk", [(0, 0, 28)]), ("meet at noon dot", []), ("on 12 May at home", [])])
def test_added_spans(text, spans):
    assert pii.all_spans(text, pii.trained_weights())[1] == spans


def test_odd_rows(odd, odd_rows):
    rows = {str(r.doc_id): r for r in pii.pii_spans(odd).collect()}
    for i, t, *_ in odd_rows:
        r, base = rows[str(i)], plain(t or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(said.split(",")) <= set(r.spans.split(",")) | {""}
    assert rows["12"].n_email == rows["12"].n_ip == rows["12"].n_card == rows["12"].n_phone == 1


def test_redaction(odd, odd_rows, empty):
    out = pii.redacted(odd)
    assert out.columns == odd.columns and pii.redacted(empty).count() == 0
    rows = out.collect()
    assert [r.text for r in rows if r.doc_id == 12] == ["Mail <email> or <phone>, <ip>, <card>."] and [r.text for r in rows if r.doc_id == 3] == [None]
    assert all(r.n_chars == len(r.text or "") for r in rows)
    weights = pii.trained_weights()
    want = [(i, None if t is None else pii.masked(t, pii.all_spans(t, weights)[1])) for i, t, *_ in odd_rows]
    assert sorted(want, key=str) == sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert pii.masked("ab", [(0, 0, 1), (1, 0, 2)]) == "<ip>"


def test_linear():
    """Very many base spans, apart or in one region, cost in proportion: four times as many some four times as much."""
    import time

    weights = pii.trained_weights()
    for sep in (" and ", " "):
        took = []
        for n in (4_000, 16_000):
            text = sep.join(f"10.{k % 256}.{k // 256}.7" for k in range(n))
            t = time.process_time()
            base, every = pii.all_spans(text, weights)
            took.append(time.process_time() - t)
            assert len(base) == n and set(base) <= set(every)
        assert took[1] < 9 * max(took[0], 0.05)
    k = 40
    text = " ".join(f"10.0.{j}.7 (743) 555-{j:04d} x{j}@y.com" for j in range(k))
    assert all(not (s < e2 and e > s2) or (s, e) == (s2, e2) for _, s, e in pii.all_spans(text, weights)[1] for _, s2, e2 in pii.base_spans(text))


def test_empty(empty):
    assert pii.pii_spans(empty).count() == 0
