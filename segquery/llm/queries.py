"""The queries ``opN_<name>`` and ``pipeline`` with their SQL, where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, katz, media_tiff, packing, pii, prefix_trie, quality, simhash, suffix_dedup, toxicity, wrapper
from .common import table


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiff.tiff_digests(media_tiff.tiff_media(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_suffix": op2_suffix,
    "op3_tiff": op3_tiff,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_wrapper": op8_wrapper,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_bpe": op12_bpe,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}


def _mask_sql(m: int, mask: str) -> str:
    """Seeds of one mask: its number and the words that it keeps of eight that follow one another."""
    kept = ", ".join(f"w{k}" for k, c in enumerate(mask) if c == "1")
    return f"SELECT *, {m} AS mask, concat_ws(' ', {kept}) AS seed FROM {{0}} WHERE w7 IS NOT NULL"


def _seed_sql(tokens: str) -> str:
    return " UNION ALL ".join(_mask_sql(m, mask).format(tokens) for m, mask in enumerate(decontaminate.MASKS))


def _words_sql(name: str, key: str) -> str:
    """(key, row, p, w0, ..., w7): every token with the seven after it; p counts from 0."""
    after = ", ".join(f"lead(w0, {k}) OVER (PARTITION BY row ORDER BY p) AS w{k}" for k in range(1, 8))
    return f"""
      {name}_rows AS (SELECT {key}, row_number() OVER () AS row, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {name} WHERE {key} IS NOT NULL AND text IS NOT NULL),
      {name}_flat AS (SELECT {key}, row, len(t) AS n, unnest(t) AS w0, generate_subscripts(t, 1) - 1 AS p FROM {name}_rows),
      {name}_words AS (SELECT *, {after} FROM {name}_flat)"""


#: Tokens themselves instead of their hashes, and the best stretch from running sums instead of a fold.
DECONTAMINATION_SQL = f"""
WITH {_words_sql("documents", "doc_id")}, {_words_sql("benchmark", "item_id")},
  hits AS (SELECT DISTINCT d.doc_id, b.item_id, d.p - b.p AS shift FROM ({_seed_sql("documents_words")}) d JOIN ({_seed_sql("benchmark_words")}) b USING (mask, seed)),
  gains AS (
    SELECT h.doc_id, h.item_id, h.shift, d.row AS dr, b.row AS br, b.n, b.p, sum(CASE WHEN d.w0 = b.w0 THEN 1 ELSE -1 END) OVER (PARTITION BY d.row, b.row, h.shift ORDER BY b.p) AS total
    FROM hits h JOIN benchmark_flat b USING (item_id) JOIN documents_flat d ON d.doc_id = h.doc_id AND d.p = b.p + h.shift
  ),
  runs AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY dr, br, shift ORDER BY p)) AS stretch FROM gains),
  pairs AS (SELECT doc_id, item_id, dr, br, shift, any_value(n) AS n, max(stretch) AS score FROM runs GROUP BY ALL),
  found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(score) AS score FROM pairs WHERE score >= least({decontaminate.MIN_SCORE}, n) GROUP BY doc_id)
SELECT d.doc_id, f.n_items IS NOT NULL AS contaminated, coalesce(f.n_items, 0)::BIGINT AS n_items, coalesce(f.score, 0)::INTEGER AS score
FROM documents d LEFT JOIN found f USING (doc_id)
"""

#: The programme itself as a recursive query over the exact histogram. Equal to the operator while a bucket
#: is one shard (up to 1.5 times SHARD_ROWS rows): DuckDB has no XXH64, by which more shards are dealt.
PACKING_SQL = f"""
WITH RECURSIVE given AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS length FROM documents),
  hist AS (SELECT length AS x, count(*) AS c FROM given GROUP BY length),
  pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x) AS j, x, (sum(c) OVER (ORDER BY x))::BIGINT AS n, (sum(c * x) OVER (ORDER BY x))::BIGINT AS s FROM hist),
  dp AS (
    SELECT 1 AS k, j, x * n - s AS cost, 0::BIGINT AS i FROM pts
    UNION ALL
    SELECT k + 1, j, m.cost, -m.i FROM (
      SELECT a.k, q.j, min({{'cost': a.cost + q.x * (q.n - p.n) - (q.s - p.s), 'i': -a.j}}) AS m
      FROM dp a JOIN pts p ON p.j = a.j JOIN pts q ON q.j > a.j WHERE a.k < {packing.BUCKETS} GROUP BY a.k, q.j
    )
  ),
  layers AS MATERIALIZED (SELECT * FROM dp),
  last AS MATERIALIZED (SELECT k, j, i FROM layers WHERE j = (SELECT max(j) FROM pts) ORDER BY cost, k LIMIT 1),
  ends AS (SELECT k, j, i FROM last UNION ALL SELECT d.k, d.j, d.i FROM ends e JOIN layers d ON d.k = e.k - 1 AND d.j = e.i),
  bounds AS (SELECT x AS boundary, coalesce(lag(x) OVER (ORDER BY x), -1) AS below FROM ends JOIN pts USING (j)),
  placed AS (
    SELECT doc_id, length, boundary, greatest(1, {packing.BUDGET} // boundary) AS fits, row_number() OVER (PARTITION BY boundary ORDER BY length, doc_id NULLS FIRST) - 1 AS place
    FROM given JOIN bounds ON length > below AND length <= boundary
  )
SELECT doc_id, length, boundary, boundary - length AS padding, concat(boundary, '-0-', place // fits) AS batch_id, (place % fits)::INTEGER AS slot FROM placed
"""

#: All n-grams of all pieces counted at once, without a sketch; every part of a longer phrase instead of its two ends.
COLLOCATIONS_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
  ),
  words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
  total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
  grams AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m)),
  counted AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
  candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE m > 1),
  cuts AS (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
  scored AS (
    SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f), k) AS place
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = head JOIN counted y ON y.lang = c.lang AND y.phrase = tail JOIN total t ON t.lang = c.lang
  ),
  parts AS (SELECT lang, f, w, m, s, unnest(range(1, m - s + 2)) AS i FROM candidates, range(2, 5) t(s) WHERE s < m),
  inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS f FROM parts GROUP BY ALL),
  kept AS (SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE place = 1 AND (i.f IS NULL OR 100 * i.f < 100 * a)),
  ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""

#: Prefixes as lists of turns instead of digests; CRC-32 bit by bit.
TRIE_SQL = """
WITH given AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns,
      xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295)) AS crc
    FROM given GROUP BY conv_id
  ),
  paths AS (SELECT c.conv_id, coalesce(b.turns[:h], []) || c.turns[h + 1:] AS path FROM (SELECT *, (crc % 6)::BIGINT AS h FROM convs) c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
  steps AS (SELECT conv_id, len(path) AS size, d, path[:d] AS node FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
  nodes AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM steps GROUP BY d, node),
  children AS (SELECT node[:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
  whole AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node),
  below AS (
    SELECT up, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(node[d].text) END)::BIGINT AS saved_tokens
    FROM (SELECT d, n_convs, n_children, node, node[:j] AS up FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM whole)) GROUP BY up
  )
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens, w.ends_sha256
FROM whole w JOIN below b ON b.up = w.node LEFT JOIN whole p ON p.d = w.d - 1 AND p.node = w.node[:w.d - 1]
"""

SQL: dict[str, str] = {"op5_decontamination": DECONTAMINATION_SQL, "op9_packing": PACKING_SQL, "op11_collocations": COLLOCATIONS_SQL, "op13_prefix_trie": TRIE_SQL}
