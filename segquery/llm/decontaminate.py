"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask is a fixed pattern of kept and ignored token positions. Every position of every document
and of every benchmark item is hashed under each mask; equal hashes put an item at an offset in
a document. Around such a hit the two token sequences are compared on the whole overlap: equal
tokens count 1, others -1, and a document is contaminated where some stretch reaches
``MIN_SCORE``. So passages with substituted tokens are found as long as one mask fits between.

Defined results: null or empty texts have no tokens and are clean; items with fewer tokens than
a mask's span are too short to tell and match nothing; items with fewer than ``MIN_SCORE``
tokens must match wholly; repeated rows get equal results; null ids are clean; an empty
benchmark leaves every document clean. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MASKS = ("11011011", "11100111", "10111101")
MIN_SCORE = 10
#: Most rows of the benchmark's hash table that are broadcast (about 40 bytes each); a larger one is shuffled.
BROADCAST_ROWS = 2_000_000


def tokens(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits; only the first may be empty."""
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): hashes of the tokens in order."""
    own = df.select(F.col(key), tokens(text).alias("tokens"))
    return own.select(key, F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))


def _seeds(hashed: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """(key, pos, seed): one row for each position and mask."""
    span = max(map(len, masks))

    def at(i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(m), *[F.get("h", i + k) for k, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(masks)])

    every = F.when(F.size("h") >= span, F.transform(F.sequence(F.lit(0), F.size("h") - span), at))
    flat = hashed.select(key, F.posexplode(every).alias("pos", "seeds"))
    return flat.select(key, "pos", F.explode("seeds").alias("seed"))


def contamination(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score): for every verified pair the best stretch's score, equal less unequal tokens."""
    items = stored(benchmark.where("item_id is not null and text is not null").select("item_id", F.filter(tokens(), lambda t: t != "").alias("tokens")).select("item_id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")))
    seeds = stored(_seeds(items, "item_id", masks).select("item_id", F.col("pos").alias("item_pos"), "seed"))
    held = seeds.select("item_id", "item_pos", "seed")
    if seeds.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    named = docs.where("doc_id is not null")
    hits = _seeds(_hashed(named, "doc_id", "text"), "doc_id", masks).join(held, "seed")
    hits = stored(hits.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    whole = _hashed(named.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text")
    # a document's hashes are cut to the stretch beside the item before they are paired: no pair holds a whole document
    sized = hits.join(items.select("item_id", F.size("h").alias("n")), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "n")).alias("hits"))  # at most a document's own hits
    beside = whole.join(sized, "doc_id")
    lo, hi = lambda x: F.greatest(F.lit(0), -x["shift"]), lambda x: F.least(x["n"], F.size("h") - x["shift"])
    cut = F.transform(F.filter("hits", lambda x: hi(x) > lo(x)), lambda x: F.struct(x["item_id"].alias("item_id"), lo(x).alias("lo"), F.slice("h", lo(x) + x["shift"] + 1, hi(x) - lo(x)).alias("part")))
    pair = beside.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*").join(items.withColumnRenamed("h", "g"), "item_id")
    gains = F.transform(F.sequence(F.lit(0), F.size("part") - 1), lambda j: F.when(F.get("g", j + F.col("lo")) == F.get("part", j), 1).otherwise(-1))
    # best stretch: running sum that starts anew where it falls below zero
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda a, g: F.struct(F.greatest(F.lit(0), a["now"] + g).alias("now"), F.greatest(a["best"], a["now"] + g).alias("best"))
    scored = pair.select("doc_id", "item_id", F.size("g").alias("n"), gains.alias("gains")).select("doc_id", "item_id", "n", F.aggregate("gains", start, step, lambda a: a["best"]).alias("score"))
    return scored.where(F.col("score") >= F.least(F.lit(min_score), F.col("n"))).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, score), one row for each row of ``docs``."""
    found = contamination(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("score").alias("score"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("score", F.lit(0)).alias("score"))
