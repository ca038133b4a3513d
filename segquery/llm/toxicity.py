"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to two rows of one embedding table, filters of widths 1 to 3 slide over the
whole text and are max-pooled, once over the text and once over each window of 16 words, whose
maxima are averaged (a long text with one hit differs from one full of them). The table's first
column starts on the smoothed log odds of a word's hash and half of the filters on that column
(``evidence``); then the table, the filters and the output layer are trained by Adagrad on a
bounded sample of labelled rows. The start matters: a few hundred toxic texts are too few to
learn word vectors from nothing (figures with and without it are in the README). The cut-off is
calibrated for each language, which is told from function words of the text itself. A score
depends on the text alone.

Defined results: null text is empty; a text without words gets the score of no evidence;
repeated rows get equal scores; without labelled rows of both classes every score is 0; other
columns are ignored. Labels are read for training rows only; an id with both labels is toxic, and
where texts of one id differ, one of them is learned from (the least by word hashes).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored, text_or_empty

#: Most training rows of each class; a quarter of them calibrates.
SAMPLE = 3_000
TABLE_BITS, DIM, FILTERS, WIDTHS, WINDOW = 17, 8, 8, (1, 2, 3), 16
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.1, 1e-4

#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be by this from or at",
    "fr": "le la les de des du et un une est que qui pour dans en par sur au avec pas",
    "de": "der die das und ist in den von zu mit dem nicht ein eine im des auf als auch sich",
    "es": "el la los las de del que y en un una por con para es se no al lo como",
}
LANGUAGES = tuple(FUNCTION_WORDS)

_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class _Ids(dict):
    """Word to its 34-bit hash: two rows of the table. Emptied when large, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = zlib.crc32(word) | (zlib.crc32(word, 0x9E3779B9) << 32)
        got = (h & ((1 << TABLE_BITS) - 1)) | ((h >> 32 & ((1 << TABLE_BITS) - 1)) << 32)
        self[word] = got
        return got


def word_ids(text: str, ids: _Ids) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(_KEEP).split()
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


_STOP_IDS = [frozenset(_Ids()[w.encode()] for w in FUNCTION_WORDS[k].split()) for k in LANGUAGES]
_STOP_ALL = np.array(sorted(set().union(*_STOP_IDS)), np.int64)
_STOP_HIT = np.array([[x in s for s in _STOP_IDS] for x in _STOP_ALL.tolist()], np.float64)


def language_of(ids: np.ndarray) -> int:
    """Index of the language with the most function words; without any, of the first."""
    at = np.searchsorted(_STOP_ALL, ids)
    at[at == len(_STOP_ALL)] = 0
    hit = at[_STOP_ALL[at] == ids]
    return int(np.argmax(np.bincount(hit, minlength=len(_STOP_ALL)) @ _STOP_HIT)) if len(hit) else 0


class ToxicCNN:
    """Parameters and arithmetic; small enough (about 4 MB) to go with a task."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (0.01 * rng.standard_normal((1 << TABLE_BITS, DIM))).astype(np.float32)
        self.filters = {w: (0.3 * rng.standard_normal((w, DIM, FILTERS))).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.filters[w][:, 0, : FILTERS // 2] += 1.0 / w  # half of the filters start on the evidence direction
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (0.1 * rng.standard_normal(2 * FILTERS * len(WIDTHS))).astype(np.float32)
        self.out0 = np.float32(0)
        self.scale = np.ones(len(LANGUAGES))
        self.shift = np.zeros(len(LANGUAGES))

    def evidence(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """First column of the table: smoothed log odds of a hash by class, from presence in texts."""
        size = 1 << TABLE_BITS
        seen = np.zeros((2, size))
        for ids, label in zip(docs, y, strict=True):
            u = np.unique(ids)
            seen[int(label), np.unique(np.r_[u & 0xFFFFFFFF, u >> 32])] += 1
        n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        sure = (seen.sum(0) / (seen.sum(0) + 4.0)) * (seen.sum(0) > 0)
        self.table[:, 0] = (0.25 * odds * sure).astype(np.float32)

    def _embed(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of all documents, each behind zeros that keep it out of the reach of the one before, filled to whole windows; window starts of documents."""
        lead = max(WIDTHS) - 1
        spans = [-(-(len(d) + lead) // WINDOW) * WINDOW for d in docs]
        starts = np.r_[0, np.cumsum(spans)]
        x = np.zeros((int(starts[-1]) + lead, DIM), np.float32)
        where = np.concatenate([np.arange(s + lead, s + lead + len(d)) for s, d in zip(starts, docs, strict=False)]) if docs else np.zeros(0, int)
        ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        if len(ids):
            x[where] = self.table[ids & 0xFFFFFFFF] + self.table[ids >> 32]
        return x, where, starts // WINDOW

    def _pool(self, x: np.ndarray, win: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        n = int(win[-1]) * WINDOW
        y = x[:n] @ self.filters[w][0]
        for j in range(1, w):
            y += x[j : n + j] @ self.filters[w][j]
        y += self.bias[w]
        np.maximum(y, 0, out=y)
        return y, y.reshape(-1, WINDOW, FILTERS).max(1)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        x, _, win = self._embed(docs)
        got = []
        for w in WIDTHS:
            m = self._pool(x, win, w)[1]
            got += [np.maximum.reduceat(m, win[:-1]), np.add.reduceat(m, win[:-1]) / np.diff(win)[:, None]]
        return np.concatenate(got, 1)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.pooled(docs) @ self.out + self.out0

    def train(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        g2 = {"table": np.full(len(self.table), 1e-3, np.float32), "out": np.full(self.out.shape, 1e-3), "out0": 1e-3} | {("f", w): np.full(self.filters[w].shape, 1e-3) for w in WIDTHS} | {("b", w): np.full(FILTERS, 1e-3) for w in WIDTHS}
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for k in range(0, len(docs), BATCH):
                self._step([docs[i] for i in order[k : k + BATCH]], y[order[k : k + BATCH]], g2)

    def _step(self, docs: list[np.ndarray], y: np.ndarray, g2: dict) -> None:
        x, where, win = self._embed(docs)
        n_win = np.diff(win)
        doc_of = np.repeat(np.arange(len(docs)), n_win)
        feats, kept = [], []
        for w in WIDTHS:
            act, m = self._pool(x, win, w)
            top = np.maximum.reduceat(m, win[:-1])
            feats += [top, np.add.reduceat(m, win[:-1]) / n_win[:, None]]
            kept.append((act.reshape(-1, WINDOW, FILTERS).argmax(1), m, top))
        h = np.concatenate(feats, 1)
        d = (1 / (1 + np.exp(-np.clip(h @ self.out + self.out0, -30, 30))) - y).astype(np.float32) / len(docs)
        gh = d[:, None] * self.out[None, :]
        gx = np.zeros_like(x)
        for i, w in enumerate(WIDTHS):
            arg, m, top = kept[i]
            g_top, g_mean = gh[:, 2 * i * FILTERS : (2 * i + 1) * FILTERS], gh[:, (2 * i + 1) * FILTERS : (2 * i + 2) * FILTERS]
            g = (g_mean / n_win[:, None])[doc_of] + np.where(m == top[doc_of], g_top[doc_of], 0)
            g = np.where(m > 0, g, 0).astype(np.float32)  # the rectifier passes nothing below zero
            at = arg + (np.arange(len(m)) * WINDOW)[:, None]
            gf = np.zeros_like(self.filters[w])
            for f in range(FILTERS):
                on = np.nonzero(g[:, f])[0]
                p, gv = at[on, f], g[on, f]
                for j in range(w):
                    gf[j, :, f] = gv @ x[p + j]
                    np.add.at(gx, p + j, gv[:, None] * self.filters[w][j, :, f][None, :])
            self._move(self.filters[w], gf + DECAY * self.filters[w], g2[("f", w)])
            self._move(self.bias[w], g.sum(0), g2[("b", w)])
        self._move(self.out, h.T @ d + DECAY * self.out, g2["out"])
        g2["out0"] += float(d.sum()) ** 2
        self.out0 -= np.float32(RATE * d.sum() / g2["out0"] ** 0.5)
        ids = np.concatenate(docs)
        hit = np.abs(gx[where]).sum(1) > 0
        rows, inv = np.unique(np.r_[ids[hit] & 0xFFFFFFFF, ids[hit] >> 32], return_inverse=True)
        if len(rows):
            gt = np.zeros((len(rows), DIM), np.float32)
            np.add.at(gt, inv, np.tile(gx[where][hit], (2, 1)))
            g2["table"][rows] += (gt * gt).mean(1)
            self.table[rows] -= 0.5 * RATE * gt / np.sqrt(g2["table"][rows])[:, None]

    @staticmethod
    def _move(p: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
        s += g * g
        p -= (RATE * g / np.sqrt(s)).astype(p.dtype)

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """For each language, slope and offset of the log odds; few rows borrow from all rows."""
        z = self.logits(docs)
        lang = np.array([language_of(d) for d in docs])
        whole = _platt(z, y, weight, 1.0, 0.0, 1.0)
        for k in range(len(LANGUAGES)):
            on = lang == k
            enough = min(int((y[on] == 1).sum()), int((y[on] == 0).sum()))
            self.scale[k], self.shift[k] = _platt(z[on], y[on], weight[on], *whole, 20.0) if enough >= 15 else whole

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        lang = np.array([language_of(d) for d in docs])
        return 1 / (1 + np.exp(-np.clip(self.scale[lang] * self.logits(docs) + self.shift[lang], -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, a0: float, b0: float, hold: float) -> tuple[float, float]:
    """Weighted logistic fit of y on z by Newton steps, drawn to (a0, b0) by ``hold`` rows; the slope stays positive."""
    a, b = a0, b0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, v = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + (hold + 1e-3) * (a - a0), r.sum() + hold * 0.25 * (b - b0)])
        h = np.array([[(v * z * z).sum() + hold + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + hold * 0.25 + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), (-0.2, -0.5), (0.2, 0.5))  # far from the optimum a full Newton step overshoots
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (float(a), float(b)) if a > 1e-3 else (a0, b0)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicCNN | None:
    """Train on at most ``sample`` labelled rows of each class, none of them held out."""
    known = labels.where("toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_of = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n_of.get(0) or not n_of.get(1):
        return None
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]))

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids = _Ids()
        for doc_id, text in rows:
            yield doc_id, word_ids(text, ids).tobytes()

    own = text_or_empty(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most 2 * sample ids
    got = map_rows(own, hashed, "doc_id long, ids binary", 256).groupBy("doc_id").agg(F.min("ids").alias("ids")).join(chosen, "doc_id")
    rows = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.ids, r.toxic) for r in got.collect())
    if len({r[3] for r in rows}) < 2:
        return None
    ids, y = [np.frombuffer(r[2], np.int64) for r in rows], np.array([r[3] for r in rows], np.float32)
    cal = np.arange(len(rows)) % 4 == 0
    model = ToxicCNN()
    fit = np.nonzero(~cal)[0]
    model.evidence([ids[i] for i in fit], y[fit])
    model.train([ids[i] for i in fit], y[fit])
    w = np.where(y == 1, n_of[1] / max(1, (y == 1).sum()), n_of[0] / max(1, (y == 0).sum()))
    model.calibrate([ids[i] for i in np.nonzero(cal)[0]], y[cal], (w * len(y) / w.sum())[cal])
    return model


def toxic_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""
    model = fit_toxic(docs, labels, sample)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids = _Ids()
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[tuple]:
            s = model.scores([h[1] for h in held]) if model else np.zeros(len(held))
            for (doc_id, _), v in zip(held, s.tolist(), strict=True):
                yield doc_id, v, int(v >= 0.5)

        for doc_id, text in rows:
            held.append((doc_id, word_ids(text, ids)))
            size += len(held[-1][1])
            if size > 30_000 or len(held) >= 256:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()

    return map_rows(text_or_empty(docs), run, "doc_id long, score double, predicted int", 1024)
