"""PII: a semi-Markov conditional random field over whole candidate spans.

Fixed patterns give the base spans, which always stay. Around digits and ``@`` a text is cut to
regions of tokens; a segmentation of a region is a sequence of entities (bounded length, one of
four kinds) and single outside tokens, scored by weights of whole-span features (shape, counts
of digits and separators, check sums, neighbours). Dynamic programming finds the best
segmentation; entities that meet no base span are added. Weights maximise the conditional
likelihood of generated, labelled regions (forward and backward sums over all segmentations).

Defined results: null text is empty and has no spans; repeated rows get equal spans; other
columns are ignored; base spans of different kinds may overlap, added ones overlap nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of an entity, so that a region's programme is linear in its length.
MAX_TOKENS = 28

#: Fixed patterns of the base spans; those of a long run are written so that each run is read once.
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, host with a dot: whether an @ matches depends on its own sides only."""
    at, done = text.find("@"), 0
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := EMAIL_HOST.match(text, at + 1)):
            yield s, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start: leftmost matches, failing ones dropped."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 5 else not p.strip("0") or int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------- regions and candidates

_TOKEN = re.compile(r"[0-9]+|[A-Za-zÀ-￿]+|[ \t]|[^\s]|\s")
_QUICK = re.compile(r"[0-9@]|[\[(][aA][tT][\])]| (?:at|AT) (?=[A-Za-z0-9-]+ (?:dot|DOT) )")
_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+()@[]-")
#: A region goes on over one blank before a number or a spelt-out sign.
_REST = re.compile(r"[A-Za-z0-9._%+()@\[\]-]*(?: (?=[0-9@(+\[.-])[A-Za-z0-9._%+()@\[\]-]+| (?:at|dot|AT|DOT) [A-Za-z0-9._%+()@\[\]-]+|(?<=[\])]) [A-Za-z0-9._%+-]+)*")
_WORD_AT = re.compile(r"^(at|dot)$", re.I)

@cache
def _shape_class(s: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) > 4 else "9" * len(m[0]), s)
    return re.sub(r"[A-Za-zÀ-￿]+", "a", s)[:40]


def span_features(kind: int, s: str, before: str, after: str) -> list[str]:
    """Names of the features of one candidate span as a whole."""
    d = _digits(s)
    n, k = len(d), KINDS[kind]
    out = [f"{k}|bias"]
    if kind == 0:
        low = s.lower()
        plain = "@" in low
        host = re.split(r"@|[\[( ]at[\]) ]", low, maxsplit=1)[-1]
        out += [f"{k}|at={plain}", f"{k}|words={bool(re.search(r'[\[( ]at[\]) ]', low))}", f"{k}|dots={min(3, len(re.findall(r'[.]|[\[( ]dot[\]) ]', host)))}", f"{k}|tld={bool(re.search(r'(?:[.]|[\[( ]dot[\]) ])\s*[a-z]{2,6}$', low))}"]
    elif kind == 1:
        parts = re.split(r"[^0-9]+", s)
        out += [f"{k}|parts={min(6, len(parts))}", f"{k}|fit={all(p and len(p) < 4 and int(p) <= 255 for p in parts)}", f"{k}|sep={''.join(sorted(set(re.sub(r'[0-9]', '', s))))[:4]}"]
    elif kind == 2:
        out += [f"{k}|n={n if 12 <= n <= 20 else 0}", f"{k}|luhn={13 <= n <= 19 and luhn(d)}", f"{k}|sep={''.join(sorted(set(re.sub(r'[0-9]', '', s))))[:4]}", f"{k}|groups={bool(re.fullmatch(r'[0-9]{4}([^0-9][0-9]{4}){2,3}([^0-9][0-9]{1,4})?|[0-9]{4}[^0-9][0-9]{6}[^0-9][0-9]{5}|[0-9]+', s))}"]
    else:
        out += [f"{k}|n={n if 7 <= n <= 15 else 0}", f"{k}|plus={s[:1] == '+'}", f"{k}|area={bool(re.search(r'[(][0-9]{2,4}[)]', s))}", f"{k}|shape={_shape_class(s)}", f"{k}|date={bool(re.fullmatch(r'(19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}.*', s))}", f"{k}|dots={s.count('.') > 1}"]
    return out + [f"{k}|before={_side(before)}", f"{k}|after={_side(after)}"]


def _side(c: str) -> str:
    return "none" if not c or c.isspace() else "9" if c.isdigit() else "a" if c.isalpha() else c if c in ".,;:()+-@[]/%_=#" else "other"


def _allowed(kind: int, tok: str) -> bool:
    if tok.isspace():
        return tok == " " and kind != 1
    if kind == 0:
        return tok[0].isalnum() or tok in "._%+-@[]()"
    if not tok.isascii():
        return False
    return tok.isdigit() or tok in (".", "..") if kind == 1 else tok.isdigit() or tok in "- ." if kind == 2 else tok.isdigit() or tok in "-. ()+"


def _edges(kind: int, toks: list[str], i: int, j: int) -> bool:
    """Whether tokens i..j can be an entity of the kind at all."""
    a, b = toks[i], toks[j - 1]
    if kind == 0:
        if not a[0].isalnum() or not b[0].isalnum():
            return False
        part = toks[i:j]
        return "@" in part or any(_WORD_AT.match(t) for t in part[1:-1]) and ("." in part or any(t.lower() == "dot" for t in part))
    if not b.isdigit() or not (a.isdigit() or kind == 3 and a in "+("):
        return False
    n = sum(len(t) for t in toks[i:j] if t.isdigit())
    return (j - i == 7 and n <= 12) if kind == 1 else 12 <= n <= 20 if kind == 2 else 7 <= n <= 15


def candidates(text: str, spans: list[tuple[int, int]], toks: list[str], taken: list[bool] | None = None) -> list[tuple[int, int, int, list[str]]]:
    """(first token, end token, kind, features) of every admissible entity of a region that holds no ``taken`` token."""
    out = []
    for i in range(len(toks)):
        for kind in range(4):
            j = i
            while j < len(toks) and j - i < MAX_TOKENS and not (taken and taken[j]) and _allowed(kind, toks[j]):
                j += 1
                if _edges(kind, toks, i, j):
                    s, e = spans[i][0], spans[j - 1][1]
                    out.append((i, j, kind, span_features(kind, text[s:e], text[s - 1 : s] if s else "", text[e : e + 1])))
    return out


def regions(text: str) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """Stretches around digits and at signs, as token spans and tokens; one pass over the text."""
    done = 0
    hit = _QUICK.search(text)
    while hit:
        s = hit.start()
        while s > done and text[s - 1] in _PART:
            s -= 1
        spelt = text[s] == " "  # "name at host dot com"
        if spelt or text[s] in "[(" and s > done and text[s - 1] == " ":  # "name [at] host"
            s -= not spelt
            while s > done and text[s - 1] in _PART:
                s -= 1
        done = max(_REST.match(text, s).end(), hit.end())
        spans = [t.span() for t in _TOKEN.finditer(text, s, done)]
        yield spans, [text[a:b] for a, b in spans]
        hit = _QUICK.search(text, done)


# ---------------------------------------------------------------- the random field


def best_segments(n: int, cand: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Entities of the best segmentation; an outside token scores 0, ties prefer fewer entities."""
    ending: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for i, j, kind, score in cand:
        ending[j].append((i, kind, score))
    best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], (j - 1, -1)
        for i, kind, score in ending[j]:
            if best[i] + score > best[j] + 1e-12:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        i, kind = back[j]
        if kind >= 0:
            out.append((i, j, kind))
        j = i
    return out[::-1]


def expected_counts(n: int, cand: list[tuple[int, int, int, float]]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations, and each candidate's probability."""
    fwd, bwd = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    fwd[0] = bwd[n] = 0.0
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    by_start: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, _, score in cand:
        by_end[j].append((i, score))
        by_start[i].append((j, score))
    for j in range(1, n + 1):
        fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[i] + s for i, s in by_end[j])])
    for i in range(n - 1, -1, -1):
        bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[j] + s for j, s in by_start[i])])
    return float(fwd[n]), [float(np.exp(fwd[i] + s + bwd[j] - fwd[n])) for i, j, _, s in cand]


def _made(rng: np.random.Generator, n: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated regions: entities in many spellings, and numbers that are none."""
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 8)))
    num = lambda a, b=None: "".join(map(str, rng.integers(0, 10, rng.integers(a, (b or a) + 1))))
    pick = lambda *x: x[rng.integers(len(x))]

    def email() -> str:
        at, dot = pick(("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."))
        return word() + pick("", "." + word(), "_" + num(1, 3), num(1, 3)) + at + word() + dot + pick("com", "org", "net", "example" + dot + "com", "co" + dot + "uk")

    def card() -> str:
        n = pick(16, 16, 16, 15, 13, 19)
        d = pick("4", "5", "3", "6") + num(n - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = pick("", " ", "-", "", ".")
        return sep.join(d[k : k + 4] for k in range(0, n, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(1, 3)} {a} {b} {c}", f"+{num(1, 2)}{num(9, 10)}", f"1-{a}-{b}-{c}", f"+{num(2)}-{num(2)}-{num(4)}-{num(4)}")

    def ip() -> str:
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))

    def none() -> str:
        return pick(
            num(1, 6), num(7, 12), num(14, 18), f"{num(1, 4)}.{num(1, 4)}", f"{rng.integers(1950, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{num(1)}.{num(1, 2)}.{num(1, 2)}", f"{num(1, 2)}:{num(2)}",
            f"{num(3)} {num(3)} {num(2)}", f"{word()}{num(2, 5)}", f"({num(1, 2)})", f"{num(3)},{num(3)}", f"{word()}@{word()}", f"{rng.integers(256, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(4)}-{num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(2)}-{num(2)}-{num(4)}", f"{num(8)}-{num(8)}", word() + " at " + word(), f"{num(1, 2)}.{num(1, 2)}.{num(4)}",
        )

    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.integers(1, 4)):
            kind = int(rng.choice([-1, -1, 0, 1, 2, 3]))
            piece = none() if kind < 0 else (email, ip, card, phone)[kind]()
            if kind == 2 and len(_digits(piece)) not in range(13, 20):
                kind = -1
            text += (pick(" ", " ", ", ", ". ", ": ") + word() + pick(" ", " ", ": ", " (")) if text or rng.random() < 0.7 else ""
            if kind >= 0:
                gold.append((kind, len(text), len(text) + len(piece)))
            text += piece
        yield text + pick("", ".", " " + word(), ", " + word()), gold


@cache
def trained_weights(n: int = 1200, epochs: int = 6, seed: int = 5) -> dict[str, float]:
    """Weights by stochastic ascent of the conditional log likelihood (Adagrad, small L2)."""
    data = []
    for text, gold in _made(np.random.default_rng(seed), n):
        for spans, toks in regions(text):
            cand = candidates(text, spans, toks)
            if cand:
                data.append((len(toks), cand, [float((k, spans[i][0], spans[j - 1][1]) in gold) for i, j, k, _ in cand]))
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for x in rng.permutation(len(data)):
            length, cand, gold = data[x]
            scored = [(i, j, k, sum(w.get(f, 0.0) for f in fs)) for i, j, k, fs in cand]
            p = expected_counts(length, scored)[1]
            step: dict[str, float] = {}
            for (_, _, _, fs), want, have in zip(cand, gold, p, strict=True):
                if abs(want - have) > 1e-4:
                    for f in fs:
                        step[f] = step.get(f, 0.0) + want - have
            for f, g in step.items():
                g -= 1e-3 * w.get(f, 0.0)
                g2[f] = g2.get(f, 1e-2) + g * g
                w[f] = w.get(f, 0.0) + 0.3 * g / g2[f] ** 0.5
    return w


def all_spans(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with added ones, each by kind and start."""
    base = base_spans(text)
    added = []
    # spans of one kind neither overlap nor change order, so two searches find those of a region
    of_kind = [([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in range(4)]
    for spans, toks in regions(text):
        lo, hi = spans[0][0], spans[-1][1]
        begins = [s for s, _ in spans]
        taken = [0] * (len(spans) + 1)  # how many base spans cover the token; then, up to the token
        for starts, ends in of_kind:
            for k in range(bisect_right(ends, lo), bisect_left(starts, hi)):
                taken[max(0, bisect_right(begins, starts[k]) - 1)] += 1
                taken[bisect_left(begins, ends[k])] -= 1
        # an entity that meets a base span cannot be added, so it is no candidate
        cand = candidates(text, spans, toks, [c > 0 for c in accumulate(taken[:-1])])
        if cand:
            scored = [(i, j, k, sum(weights.get(f, 0.0) for f in fs)) for i, j, k, fs in cand]
            added += [(k, spans[i][0], spans[j - 1][1]) for i, j, k in best_segments(len(toks), scored)]
    return base, sorted({*base, *added})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are of base spans."""
    weights = trained_weights()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, every = all_spans(text, weights)
            counts = [0] * 4
            for k, _, _ in base:
                counts[k] += 1
            yield doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)

    return map_rows(text_or_empty(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", 1024)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` counted anew; null texts stay null."""
    weights = trained_weights()
    names = docs.columns
    ti, ni = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            if row[ti]:
                spans = all_spans(row[ti], weights)[1]
                if spans:
                    row = list(row)
                    row[ti] = masked(row[ti], spans)
                    if ni is not None:
                        row[ni] = len(row[ti])
            yield tuple(row)

    return map_rows(docs, run, docs.schema, 512)
