"""Column builders: keys, text, intervals, vectors and hash randomness. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- keys


def item_id(path: Column | str) -> Column:
    """Base name without its extension."""
    return F.regexp_extract(col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def event_ordinal(event_id: Column | str) -> Column:
    """Integer after the last underscore."""
    return F.substring_index(col(event_id), "_", -1).cast("long")


def seg_key(video: Column | str, ts_cs: Column | str, te_cs: Column | str) -> Column:
    """Key of a segment from integer centiseconds, so equal to 0.01 s means equal."""
    return F.concat(col(video).cast("string"), F.lit("__"), col(ts_cs).cast("string"), F.lit("_"), col(te_cs).cast("string"))


def _scaled(x: Column, digits: int) -> Column:
    """The double ``x`` times 10^digits, rounded to an integer as if the product were exact, ties to even.

    Twice the product is the sum of a rounded product and its error (Veltkamp and Dekker's splitting), so it is known on which side of a
    tie it lies.
    """
    by = 2.0 * 10**digits

    def parts(v: Column) -> Column:
        c = v * 134217729.0
        return F.struct(v.alias("v"), (c - (c - v)).alias("high"), (v * by).alias("p"))

    def rounded(s: Column) -> Column:
        p, error = s["p"], (s["high"] * by - s["p"]) + (s["v"] - s["high"]) * by
        odd = (p == F.floor(p)) & (F.pmod(p, F.lit(2.0)) == 1)
        return F.when(odd & (error > 0), (p + 1) / 2).when(odd & (error < 0), (p - 1) / 2).otherwise(F.rint(p / 2))

    # lambdas name what is used more than once
    return F.transform(F.transform(F.array(x), parts), rounded)[0]


def round_exact(x: Column | str, digits: int) -> Column:
    """A double rounded to ``digits`` decimals by its exact binary value, ties to even: not by its shortest decimal, as ``round`` does."""
    return _scaled(col(x).cast("double"), digits) / F.lit(10.0**digits)


def decimals(x: Column | str, digits: int = 2) -> Column:
    """A double as text with ``digits`` decimals, rounded by its exact binary value."""
    by = 10**digits

    def text(n: Column) -> Column:
        whole = F.abs(n).cast("long")
        return F.concat(F.when((n < 0) | (n.cast("string") == "-0.0"), "-").otherwise(""), (whole / by).cast("long").cast("string"), F.lit("."), F.lpad((whole % by).cast("string"), digits, "0"))

    return F.transform(F.array(_scaled(col(x).cast("double"), digits)), text)[0]


def seg_key_seconds(video: Column | str, ts: Column | str, te: Column | str) -> Column:
    """Key of a segment from seconds with two decimals."""
    return F.concat(col(video).cast("string"), F.lit("__"), decimals(ts), F.lit("_"), decimals(te))


def text_key(text: Column | str) -> Column:
    return F.concat(F.lit("q_"), F.substring(F.md5(F.trim(col(text)).cast("binary")), 1, 12))


# ---------------------------------------------------------------- text


def normalise_caption(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", " "))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != "")).cast("long")


#: Words that no token set holds.
STOP = ("the", "and", "with", "into", "onto", "some", "then", "for", "from", "until", "that", "this", "them", "over")


def token_set(text: Column | str, stop: tuple[str, ...] = STOP, least: int = 3) -> Column:
    """Distinct lower-case runs of letters and digits with ``least`` characters and no stop word."""
    words = F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+")
    keep = lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least
    return F.array_distinct(F.filter(words, keep))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets as arrays; two empty sets give 0."""
    both, either = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(either == 0, 0.0).otherwise(both / F.greatest(either, F.lit(1)))


# ---------------------------------------------------------------- intervals


def intersection(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(col(a1), col(b1)) - F.greatest(col(a0), col(b0)))


def tiou_hull(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Intersection over the convex hull; a hull without length gives 0."""
    hull = F.greatest(col(a1), col(b1)) - F.least(col(a0), col(b0))
    return F.when(hull <= 0, 0.0).otherwise(intersection(a0, a1, b0, b1).cast("double") / F.when(hull > 0, hull))


def tiou_union(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Intersection over the true union; without length 0."""
    inter = intersection(a0, a1, b0, b1)
    union = (col(a1) - col(a0)) + (col(b1) - col(b0)) - inter
    return F.when(union <= 0, 0.0).otherwise(inter.cast("double") / F.when(union > 0, union))


def grid_step(n: Column | str, fps: int = 16, stride: int = 16, window: int = 16, steps: int = 256) -> Column:
    """Seconds of one grid step when the span of ``n`` rows is resampled to ``steps``."""
    return ((col(n) - 1) * F.lit(float(stride)) + F.lit(float(window))) / F.lit(float(steps)) / F.lit(float(fps))


def grid_to_sec(g: Column | str, n: Column | str, dur: Column | str | None = None, **grid: int) -> Column:
    """Grid coordinate to seconds: the middle of its step; clipped to [0, duration] where one is given."""
    t = (col(g) + F.lit(0.5)) * grid_step(n, **grid)
    return t if dur is None else F.greatest(F.lit(0.0), F.least(t, col(dur).cast("double")))


def sec_to_grid(t: Column | str, n: Column | str, **grid: int) -> Column:
    """The inverse without the clipping; null where a step has no length."""
    step = grid_step(n, **grid)
    return col(t) / F.when(step > 0, step) - F.lit(0.5)


def level_times(n: Column | str, level: int = 0, steps: int = 256, **grid: int) -> Column:
    """Array of the middles of the steps of a pyramid level: every ``2 ** level``-th grid coordinate."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 2**level), F.lit(2**level)), lambda g: grid_to_sec(g, n, steps=steps, **grid))


def round_capped(ts: Column | str, te: Column | str, dur: Column | str, digits: int = 2) -> tuple[Column, Column]:
    """Start and end rounded; the end never behind the duration."""
    return F.round(col(ts).cast("double"), digits), F.least(F.round(col(te).cast("double"), digits), col(dur).cast("double"))


def frame_index(ts: Column | str, te: Column | str, fps: Column | float, n: Column | str, k: int = 8) -> Column:
    """``k`` equally spaced frame numbers between the frames nearest to start and end, the last clipped to n - 1; a start behind it raises."""
    fps = fps if isinstance(fps, Column) else F.lit(fps)
    first = F.rint(col(ts) * fps)
    end = F.least(F.rint(col(te) * fps), (col(n) - 1).cast("double"))
    step = (end - first) / F.lit(max(k - 1, 1))
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when((i == k - 1) & F.lit(k > 1), end).otherwise(first + i * step).cast("long"))
    return F.when(first > end, F.raise_error(F.lit("the segment starts behind the last frame"))).otherwise(at)


# ---------------------------------------------------------------- vectors


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector over its length, which counts as 1e-12 at least."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(col(a), lambda x: x.cast("double") / n)


def quantised(a: Column | str) -> tuple[Column, Column]:
    """(codes, scale): symmetric 8-bit codes, scale = largest magnitude / 127 (1 for a zero vector)."""
    top = F.array_max(F.transform(col(a), lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return F.transform(col(a), lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("tinyint")), scale


# ---------------------------------------------------------------- randomness


def hash_uniform(seed: object, key: Column | str, i: Column | int = 0) -> Column:
    """Uniform on [0, 1) from md5 of seed#key#i: equal on every engine and in every order."""
    i = F.lit(i) if isinstance(i, int) else i
    text = F.concat_ws("#", F.lit(str(seed)), col(key).cast("string"), i.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_exponential(seed: object, key: Column | str, i: Column | int = 0) -> Column:
    return -F.log(F.greatest(hash_uniform(seed, key, i), F.lit(1e-12)))


def hash_normal(seed: object, key: Column | str, i: int = 0) -> Column:
    """Box-Muller on two uniforms."""
    u, v = F.greatest(hash_uniform(seed, key, 2 * i), F.lit(1e-12)), hash_uniform(seed, key, 2 * i + 1)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
