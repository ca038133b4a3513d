"""Queries on vectors: scoring, ranks, metrics, statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X
from segquery.operators import analysis as A
from segquery.operators import block_search as B
from segquery.operators import losses as L
from segquery.operators import reports as P
from segquery.operators import retrieval as R
from segquery.operators import stats as S
from segquery.operators import vectors as V

from . import fixtures as D
from .fixtures import VEC, u_sql
from .registry import query, r6, rounded


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs: for the queries whose result they are, and for a sample of them."""
    return V.pair_scores(D.vec_queries(spark, d), D.gallery(spark, d))


def best(spark: SparkSession, d: str, k: int = 1, where: str = "true") -> DataFrame:
    """States with the k best segments of each (query, item)."""
    return V.item_pairs(D.vec_queries(spark, d), D.gallery(spark, d).where(where), k)


def top(spark: SparkSession, d: str, k: int) -> DataFrame:
    """States with the k best segments of each query."""
    return V.query_pairs(D.vec_queries(spark, d), D.gallery(spark, d), k)


def sums(spark: SparkSession, d: str) -> DataFrame:
    """Log-sum-exp states at 0.1."""
    return V.item_sums(D.vec_queries(spark, d), D.gallery(spark, d), 0.1)


def near(spark: SparkSession, d: str, least: float) -> DataFrame:
    """(query_id, n): segments that score ``least`` or more."""
    return V.counts(D.vec_queries(spark, d), D.gallery(spark, d), least).groupBy("query_id").agg(F.sum("n").alias("n"))


def ranks(spark: SparkSession, d: str, scores: DataFrame | None = None) -> DataFrame:
    g = D.gallery(spark, d)
    size = g.select("video_id").distinct().count()
    return R.strict_ranks(V.max_scores(best(spark, d)) if scores is None else scores, D.vec_queries(spark, d), size)


METRICS = """count(*) as n, 100 * avg((rank <= 1)::int::double) as r1, 100 * avg((rank <= 5)::int::double) as r5, 100 * avg((rank <= 10)::int::double) as r10,
quantile_cont(rank::double, 0.5) as median_rank, avg(rank::double) as mean_rank"""
METRICS6 = METRICS.replace("100 * avg((rank <= 1)::int::double)", "round(100 * avg((rank <= 1)::int::double), 6)").replace("100 * avg((rank <= 5)::int::double)", "round(100 * avg((rank <= 5)::int::double), 6)").replace("100 * avg((rank <= 10)::int::double)", "round(100 * avg((rank <= 10)::int::double), 6)").replace("quantile_cont(rank::double, 0.5)", "round(quantile_cont(rank::double, 0.5), 6)").replace("avg(rank::double)", "round(avg(rank::double), 6)")


@query(VEC + f"select {METRICS6} from rk")
def maxsim_rank_metrics(spark, d):
    return rounded(R.rank_metrics(ranks(spark, d)))


@query(VEC + "select query_id, seg_row, round(score, 6) as score from pr")
def cosine_pairs(spark, d):
    return pairs(spark, d).select("query_id", "seg_row", r6("score"))


@query(VEC + "select query_id, seg_row, round(score, 6) as score from pr")
def cosine_pairs_join(spark, d):
    """The join form of the pair scores."""
    return V.pair_scores(D.vec_queries(spark, d), D.gallery(spark, d), "join").select("query_id", "seg_row", r6("score"))


@query("select vec_id, round(sqrt(list_sum([x * x for x in v])), 6) as norm_before, round(v[1] / greatest(sqrt(list_sum([x * x for x in v])), 1e-12), 6) as first from (select vec_id, [x * 3 for x in embedding::double[]] as v from embeddings)")
def l2_normalise(spark, d):
    e = D.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return e.select("vec_id", r6(X.norm("v"), "norm_before"), r6(X.unit("v")[0], "first"))


@query(VEC + "select query_id, video_id, round(score, 6) as score from ms")
def maxsim_scores(spark, d):
    return V.max_scores(best(spark, d)).select("query_id", "video_id", r6("score"))


@query(VEC + "select query_id, video_id, seg_row, ts, te, round(score, 6) as score from (select *, row_number() over (partition by query_id, video_id order by score desc, ts, seg_row) as r from pr) where r = 1")
def maxsim_argmax(spark, d):
    return V.maxsim(best(spark, d)).select("query_id", "video_id", "seg_row", "ts", "te", r6("score"))


@query(VEC + "select query_id, video_id, round(avg(score), 6) as score from (select *, row_number() over (partition by query_id, video_id order by score desc, seg_row) as r from pr) where r <= 3 group by all")
def topk_mean_scores(spark, d):
    return V.topk_mean(best(spark, d, 3), 3).select("query_id", "video_id", r6("score"))


@query(VEC + "select query_id, video_id, round(0.1 * ln(avg(exp(score / 0.1))), 6) as score from pr group by all")
def lse_scores(spark, d):
    return V.lse(sums(spark, d), 0.1).select("query_id", "video_id", r6("score"))


@query(VEC + "select query_id, video_id, round(max(score + 0.05 * ln(conf)), 6) as score from pr group by all")
def biased_maxsim(spark, d):
    g = V.with_bias(D.gallery(spark, d), D.conf(spark, d))
    s = V.item_pairs(D.vec_queries(spark, d), g, variants=[{"emb": 1.0, "bias": 0.05}])
    return V.max_scores(s).select("query_id", "video_id", r6("score"))


POOLED = """, flat as (select video_id, pos, sum(x) as x from (select video_id, unnest(emb) as x, generate_subscripts(emb, 1) as pos from gal) group by all),
nrm as (select video_id, sqrt(sum(x * x)) as n from flat group by 1)"""


@query(VEC + POOLED + "select video_id, pos::int as pos, round(x / greatest(n, 1e-12), 6) as x, t.ts, t.te from flat join nrm using (video_id) join (select video_id, min(ts) as ts, max(te) as te from gal group by 1) t using (video_id)")
def mean_pooled_vectors(spark, d):
    return V.mean_pooled(D.gallery(spark, d)).select("video_id", "ts", "te", F.posexplode("emb").alias("p", "x")).select("video_id", (F.col("p") + 1).alias("pos"), r6("x"), "ts", "te")


@query(VEC + ", bs as (select *, row_number() over (partition by query_id, video_id order by score desc, ts, seg_row) as r from pr) select * from (select query_id, video_id, seg_row, round(score, 6) as score, row_number() over (partition by query_id order by score desc, video_id)::int as place from bs where r = 1) where place <= 5")
def video_topk_search(spark, d):
    return V.video_topk(best(spark, d), 5).select("query_id", "video_id", "seg_row", r6("score"), "place")


EVENTS_TOP = VEC + "select * from (select query_id, seg_row, round(score, 6) as score, row_number() over (partition by query_id order by score desc, seg_row)::int as place from pr) where place <= 10"


@query(EVENTS_TOP)
def event_topk_search(spark, d):
    return V.event_topk(top(spark, d, 10), 10).select("query_id", "seg_row", r6("score"), "place")


@query(EVENTS_TOP)
def block_topk_search(spark, d):
    """The same by an index of blocks; blocks whose bound is below the tenth score are not read."""
    blocks = B.vector_blocks(D.gallery(spark, d), 64).persist()
    return B.block_topk(D.vec_queries(spark, d), blocks, 10).select("query_id", "seg_row", r6("score"), "place")


@query(VEC + "select count(*) as n, round(avg(score), 6) as mean, round(sqrt(greatest(var_pop(score), 1e-12)), 6) as std from pr where positive >= 7 and video_id >= 7")
def zscore_stats(spark, d):
    return rounded(V.score_stats(D.vec_queries(spark, d).where("positive >= 7"), D.gallery(spark, d).where("video_id >= 7")).select("n", "mean", "std"))


@query(VEC + ", hf as (select q.query_id, gal.video_id, list_dot_product(q_emb, emb) as s, list_dot_product(q_emb[1:32], emb[1:32]) as h from q cross join gal), z as (select avg(s) as ms, sqrt(greatest(var_pop(s), 1e-12)) as ss, avg(h) as mh, sqrt(greatest(var_pop(h), 1e-12)) as sh from hf) select query_id, video_id, round(max((s - ms) / ss + 0.25 * (h - mh) / sh), 6) as score from hf, z group by all")
def zscored_two_source(spark, d):
    q, g = D.vec_queries(spark, d).withColumn("q_half", F.slice("q_emb", 1, 32)), D.gallery(spark, d).withColumn("half", F.slice("emb", 1, 32))
    sources = {"emb": "q_emb", "half": "q_half"}
    a, b = (V.score_stats(q, g, sources=sources, variants=[{name: 1.0}]).first() for name in sources)
    z = V.zscored([("emb", 1.0, a.mean, a.std), ("half", 0.25, b.mean, b.std)])
    return V.max_scores(V.item_pairs(q, g, sources=sources, variants=[z])).select("query_id", "video_id", r6("score"))


@query(VEC + ", a as (select query_id, video_id, max(score) as own from pr where seg_row % 3 <> 0 group by all), b as (select query_id, video_id, max(score) - 0.02 as other from pr where seg_row % 3 = 0 group by all) select query_id, video_id, round(greatest(own, other), 6) as score, coalesce(own >= other, own is not null) as from_main from a full join b using (query_id, video_id)")
def score_union(spark, d):
    main, window = (V.max_scores(best(spark, d, where=w)) for w in ("seg_row % 3 <> 0", "seg_row % 3 = 0"))
    return V.score_union(main, window, -0.02).select("query_id", "video_id", r6("score"), "from_main")


@query("with v as (select vec_id, embedding::double[] as e, list_max([abs(x) for x in embedding::double[]]) as top from embeddings), s as (select *, (case when top > 0 then top / 127 else 1.0 end) as scale from v) select vec_id, round(scale, 6) as scale, list_sum([abs(round_even(x / scale, 0)) for x in e])::bigint as magnitude, round(list_max([abs(x - round_even(x / scale, 0) * scale) for x in e]) / scale, 6) as worst from s")
def int8_roundtrip(spark, d):
    codes, scale = X.quantised("embedding")
    e = D.table(spark, d, "embeddings").select("vec_id", "embedding", codes.alias("c"), scale.alias("sc"))
    mag = F.aggregate("c", F.lit(0).cast("long"), lambda t, x: t + F.abs(x.cast("long")))
    worst = F.array_max(F.zip_with("embedding", "c", lambda x, c: F.abs(x.cast("double") - c * F.col("sc")))) / F.col("sc")
    return e.select("vec_id", r6("sc", "scale"), mag.alias("magnitude"), r6(worst, "worst"))


@query(VEC + POOLED + ", more as (select -row_number() over (order by video_id) as seg_row, video_id, list(x / greatest(n, 1e-12) order by pos) as emb from flat join nrm using (video_id) group by video_id), every as (select seg_row, video_id, emb from gal union all select * from more) select video_id, count(*) as n, round(sum(emb[1]), 6) as first_sum from every group by 1")
def global_vector_append(spark, d):
    g = V.with_global(D.gallery(spark, d))
    return g.groupBy("video_id").agg(F.count("*").alias("n"), r6(F.sum(F.col("emb")[0]), "first_sum"))


@query(VEC + "select round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(min(score), 6) as least, round(max(score), 6) as most from pr")
def cos_spread(spark, d):
    return rounded(V.score_stats(D.vec_queries(spark, d), D.gallery(spark, d)).select("mean", "std", "least", "most"))


# ---------------------------------------------------------------- ranks and metrics


@query(VEC + "select query_id, rank from rk")
def strict_rank(spark, d):
    return ranks(spark, d)


@query(VEC + f""", bs as (select *, row_number() over (partition by query_id, video_id order by score desc, ts, seg_row) as r from pr),
x as (select rk.query_id, rank, coalesce(greatest(0, least(te, gt_te) - greatest(ts, gt_ts)) / nullif(greatest(te, gt_te) - least(ts, gt_ts), 0) >= 0.5, false) and rank = 1 as hit
      from rk left join bs on bs.query_id = rk.query_id and bs.video_id = rk.video_id and bs.r = 1)
select {METRICS6}, round(100 * sum(hit::int)::double / nullif(sum((rank = 1)::int), 0), 6) as moment_given_top1, round(100 * avg(hit::int::double), 6) as vcmr_r1,
(select round(avg(k), 6) from (select count(*) as k from gal group by video_id)) as vectors_per_item from x""")
def partition_eval(spark, d):
    g = D.gallery(spark, d)
    return rounded(R.partition_eval(V.maxsim(best(spark, d)), D.vec_queries(spark, d).drop("q_emb"), g))


@query(VEC + f", own as (select * from ms where video_id < 7), rr as (select query_id, case when positive < 7 then 1 + (select count(*) from own b where b.query_id = q.query_id and b.score > (select score from own c where c.query_id = q.query_id and c.video_id = q.positive)) else (select count(distinct video_id) from own) + 1 end as rank from q) select {METRICS6} from rr")
def gallery_restricted_eval(spark, d):
    keep = D.gallery(spark, d).where("video_id < 7").select("video_id").distinct()
    g = D.gallery(spark, d).join(keep, "video_id", "left_semi")
    s = V.max_scores(V.item_pairs(D.vec_queries(spark, d), g))
    return rounded(R.rank_metrics(R.strict_ranks(s, D.vec_queries(spark, d), keep.count())))


EVENT = """, tr as (select query_id, positive, gt_ts, gt_te, (select min(seg_row) from gal where video_id = positive and seg_row > query_id) as own_row from q),
ev as (select *, rank() over (partition by query_id order by score desc) as rank, row_number() over (partition by query_id order by score desc, seg_row) as place from pr),
er as (select tr.query_id, max(case when seg_row = own_row then rank end) as rank, bool_or(place = 1 and video_id = tr.positive) as video1, bool_or(place <= 5 and video_id = tr.positive) as video5,
              bool_or(place = 1 and video_id = tr.positive and greatest(0, least(te, tr.gt_te) - greatest(ts, tr.gt_ts)) / nullif(greatest(te, tr.gt_te) - least(ts, tr.gt_ts), 0) >= 0.1) as tiou1
       from tr join ev using (query_id) where own_row is not null group by 1)"""


def event_rows(spark, d):
    q, g = D.vec_queries(spark, d).drop("q_emb"), D.gallery(spark, d).select("seg_row", "video_id")
    own = q.join(g, (g.video_id == q.positive) & (g.seg_row > q.query_id)).groupBy("query_id").agg(F.min("seg_row").alias("own_row"))
    return R.event_eval(D.vec_queries(spark, d), D.gallery(spark, d), q.join(own, "query_id"), 5, 0.1)


@query(VEC + EVENT + "select query_id, rank, video1, video5, tiou1 from er")
def event_per_query(spark, d):
    return event_rows(spark, d)


@query(VEC + EVENT + f"select {METRICS6}, round(avg(1.0::double / rank), 6) as mrr, round(100 * avg(video1::int::double), 6) as video1, round(100 * avg(video5::int::double), 6) as video5, round(100 * avg(tiou1::int::double), 6) as tiou1 from er")
def event_eval(spark, d):
    return rounded(R.event_summary(event_rows(spark, d)))


@query(VEC + EVENT + f"select {METRICS6}, round(avg(1.0::double / rank), 6) as mrr from (select query_id, 1 + (select count(*) from pr b where b.query_id = er.query_id and b.seg_row in (select own_row from tr) and b.score > (select score from pr c, tr where c.query_id = er.query_id and tr.query_id = er.query_id and c.seg_row = tr.own_row)) as rank from er)")
def text_to_clip_subset(spark, d):
    """Gallery of the queries' own clips only, each once."""
    q, g = D.vec_queries(spark, d), D.gallery(spark, d)
    own = q.join(g.select("seg_row", "video_id"), (g.video_id == q.positive) & (g.seg_row > q.query_id)).groupBy("query_id").agg(F.min("seg_row").alias("positive"))
    clips = g.join(own.select(F.col("positive").alias("seg_row")).distinct(), "seg_row", "left_semi")
    asked = q.join(own, "query_id").join(clips.select(F.col("seg_row").alias("positive_row"), "emb"), F.col("positive_row") == own.positive).select("query_id", "q_emb", X.dot("q_emb", "emb").alias("own"))
    r = V.counts(asked, clips, "own").groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))
    return rounded(r.agg(*R.metric_columns(), F.avg(1 / F.col("rank")).alias("mrr")))


@query(VEC + f", qq as (select a.query_id, b.query_id as other, list_dot_product(a.q_emb, b.q_emb) + case when a.positive = b.positive then 0.1 else 0 end as score from q a cross join q b) select {METRICS6} from (select a.query_id, 1 + (select count(*) from qq b where b.query_id = a.query_id and b.score > a.score) as rank from qq a where a.query_id = a.other)")
def text_to_clip_diagonal(spark, d):
    """Each caption's own clip is its row's vector: a square relation, ranks on its diagonal."""
    q = D.vec_queries(spark, d)
    clips = q.select(F.col("query_id").alias("seg_row"), F.col("positive").alias("video_id"), "gt_ts", "gt_te", "q_emb").toDF("seg_row", "video_id", "ts", "te", "emb")
    asked = q.select("query_id", "q_emb", "positive", (X.dot("q_emb", "q_emb") + 0.1).alias("own"))
    better = V.counts(asked, clips, "own", same=("positive", 0.1)).groupBy("query_id").agg(F.sum("n").alias("n"))
    return rounded(R.rank_metrics(better.select("query_id", (F.col("n") + 1).alias("rank"))))


@query(VEC + f", dr as (select r.rep, video_id from (select distinct video_id from gal) v cross join range(5) r(rep) qualify row_number() over (partition by r.rep order by {u_sql('match', 'r.rep', 'video_id')}, video_id) <= 4), rr as (select dr.rep, q.query_id, 1 + (select count(*) from ms b join dr e on e.rep = dr.rep and e.video_id = b.video_id where b.query_id = q.query_id and b.score > c.score) as rank from q join dr on dr.video_id = q.positive join ms c on c.query_id = q.query_id and c.video_id = q.positive) select rep, {METRICS6} from rr group by rep")
def text_to_clip_matched(spark, d):
    """Galleries of matched size: per repetition, four items drawn by hash, queries of those items."""
    v = D.gallery(spark, d).select("video_id").distinct().crossJoin(spark.range(5).withColumnRenamed("id", "rep"))
    w = Window.partitionBy("rep").orderBy(X.hash_uniform("match", "rep", F.col("video_id")), "video_id")
    drawn = v.withColumn("_r", F.row_number().over(w)).where("_r <= 4").drop("_r")
    s = V.max_scores(best(spark, d)).join(drawn, "video_id")
    return rounded(R.rank_metrics(R.strict_ranks(s, D.vec_queries(spark, d), 0, "rep"), "rep"))


@query(VEC + f"select case when video_id < 7 then 'val' else 'dev' end as split, {METRICS6} from rk group by 1 union all select 'all', {METRICS6} from rk")
def eval_table_splits(spark, d):
    r = ranks(spark, d).join(D.vec_queries(spark, d).select("query_id", "positive"), "query_id").withColumn("split", F.when(F.col("positive") < 7, "val").otherwise("dev"))
    return rounded(R.rank_metrics(r, "split").unionByName(r.agg(*R.metric_columns()).withColumn("split", F.lit("all"))))


BETAS = (0.0, 0.01, 0.05, 0.2)
SWEEP = ", bt as (select unnest([0.0::double, 0.01, 0.05, 0.2]) as beta), bm as (select beta, query_id, video_id, max(score + beta * ln(conf)) as score from pr, bt group by all), br as (select beta, q.query_id, 1 + (select count(*) from bm b where b.beta = bt.beta and b.query_id = q.query_id and b.score > (select score from bm c where c.beta = bt.beta and c.query_id = q.query_id and c.video_id = q.positive)) as rank from q, bt)"


def sweep(spark, d):
    """All betas in one pass over the vectors."""
    g = V.with_bias(D.gallery(spark, d), D.conf(spark, d))
    s = V.item_pairs(D.vec_queries(spark, d), g, variants=[{"emb": 1.0, "bias": b} for b in BETAS])
    s = s.groupBy("variant", "query_id", "video_id").agg(F.max("score").alias("score"))
    beta = F.element_at(F.array(*map(F.lit, BETAS)), F.col("variant") + 1).alias("beta")
    return R.strict_ranks(s, D.vec_queries(spark, d), 0, "variant").select(beta, "query_id", "rank")


@query(VEC + SWEEP + f"select beta, {METRICS6} from br group by beta")
def beta_sweep(spark, d):
    return rounded(R.rank_metrics(sweep(spark, d), "beta"))


@query(VEC + SWEEP + "select beta, round(r1, 6) as r1 from (select beta, 100 * avg((rank <= 1)::int::double) as r1 from br group by beta) order by round(r1, 6) desc, beta limit 1")
def pick_beta(spark, d):
    return rounded(S.pick_best(R.rank_metrics(sweep(spark, d), "beta"), "r1", F.asc("beta")).select("beta", "r1"))


@query(VEC + f""", ag as (select 'max' as how, query_id, video_id, max(score) as score from pr group by all union all
select 'topk_mean', query_id, video_id, avg(score) from (select *, row_number() over (partition by query_id, video_id order by score desc, seg_row) as r from pr) where r <= 3 group by all union all
select 'lse', query_id, video_id, 0.1 * ln(avg(exp(score / 0.1))) from pr group by all),
ar as (select how, q.query_id, 1 + (select count(*) from ag b where b.how = h.how and b.query_id = q.query_id and b.score > (select score from ag c where c.how = h.how and c.query_id = q.query_id and c.video_id = q.positive)) as rank from q, (select distinct how from ag) h)
select how, {METRICS6} from ar group by how""")
def agg_comparison(spark, d):
    states = {"max": best(spark, d), "topk_mean": best(spark, d, 3), "lse": sums(spark, d)}
    return rounded(reduce(DataFrame.unionByName, [R.rank_metrics(ranks(spark, d, V.aggregated(s, how))).withColumn("how", F.lit(how)) for how, s in states.items()]))


# ---------------------------------------------------------------- statistics


def two_runs(spark, d, unit: str) -> DataFrame:
    """Hits at rank 1 of maximum and of top-3 mean, summed up by unit."""
    p, q = best(spark, d, 3), D.vec_queries(spark, d).select("query_id", "positive")
    a, b = ranks(spark, d, V.max_scores(p)).withColumnRenamed("rank", "a"), ranks(spark, d, V.topk_mean(p, 3)).withColumnRenamed("rank", "b")
    rows = a.join(b, "query_id").join(q, "query_id").select(F.col(unit).alias("unit"), (F.col("a") <= 1).cast("long").alias("x"), (F.col("b") <= 1).cast("long").alias("y"))
    return rows.groupBy("unit").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))


RUNS = """, tk as (select query_id, video_id, avg(score) as score from (select *, row_number() over (partition by query_id, video_id order by score desc, seg_row) as r from pr) where r <= 3 group by all),
tr2 as (select q.query_id, q.positive, 1 + (select count(*) from tk b where b.query_id = q.query_id and b.score > (select score from tk c where c.query_id = q.query_id and c.video_id = q.positive)) as rank from q),
ab as (select rk.query_id, tr2.positive, (rk.rank <= 1)::int as x, (tr2.rank <= 1)::int as y from rk join tr2 using (query_id))"""


def boot_sql(unit: str, n: int, seed: str, source: str = "ab", x: str = "x", y: str = "y") -> str:
    return f""", un as (select {unit} as unit, sum({x}) as x, sum({y}) as y, count(*) as n from {source} group by 1), pl as (select *, row_number() over (order by unit) - 1 as place, count(*) over () as units from un),
dw as (select b, floor({u_sql(seed, 'b', 'i')} * (select count(*) from un)) as place from range({n}) t(b) cross join range((select count(*) from un)) s(i)),
bs2 as (select b, 100 * (sum(x) - sum(y))::double / sum(n) as d from dw join pl using (place) group by b)
select (select round(100 * (sum(x) - sum(y))::double / sum(n), 6) from un) as diff, round(quantile_cont(d, 0.025), 6) as ci_low, round(quantile_cont(d, 0.975), 6) as ci_high, round(avg((d <= 0)::int::double), 6) as p from bs2"""


@query(VEC + RUNS + boot_sql("query_id", 100, "bq"))
def bootstrap_query(spark, d):
    return rounded(S.bootstrap(two_runs(spark, d, "query_id"), 100, "bq"))


#: Upper ends of the chances of 0, 1, ... copies under Poisson(1).
POISSON_SQL = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k))!r}::double)::int" for k in range(1, 13))


@query(VEC + RUNS + f""", un as (select positive as unit, sum(x) as x, sum(y) as y, count(*) as n from ab group by 1),
dw as (select b, x, y, n, {POISSON_SQL} as c from (select b, un.*, {u_sql('bp', 'unit', 'b')} as u from un cross join range(100) t(b))),
bs2 as (select b, 100 * (sum(x * c) - sum(y * c))::double / sum(n * c) as d from dw where c > 0 group by b)
select (select round(100 * (sum(x) - sum(y))::double / sum(n), 6) from un) as diff, round(quantile_cont(d, 0.025), 6) as ci_low, round(quantile_cont(d, 0.975), 6) as ci_high, round(avg((d <= 0)::int::double), 6) as p from bs2""")
def bootstrap_poisson(spark, d):
    """All resamples in one pass: each unit's copies in a resample are a hashed Poisson number."""
    return rounded(S.poisson_bootstrap(two_runs(spark, d, "positive"), 100, "bp"))


@query(VEC + RUNS + boot_sql("positive", 100, "bg"))
def bootstrap_group(spark, d):
    return rounded(S.bootstrap(two_runs(spark, d, "positive"), 100, "bg"))


@query(VEC + RUNS + ", sm as (select query_id, positive, (x + y) / 2.0::double as m, 0.5::double as z from ab)" + boot_sql("positive", 100, "bs", "sm", "m", "z"))
def bootstrap_seed_mean(spark, d):
    """Mean hits of two runs against a fixed half."""
    u = two_runs(spark, d, "positive")
    return rounded(S.bootstrap(u.select("unit", ((F.col("x") + F.col("y")) / 2.0).alias("x"), (F.col("n") * 0.5).alias("y"), "n"), 100, "bs"))


@query(VEC + RUNS + """, pv as (select positive, count(*) as w, 100 * avg((x - y)::double) as d, avg(query_id)::double / 1000 as c from ab group by 1),
s as (select count(*) as n, sum(w)::double as s, sum(w * c) as sx, sum(w * d) as sy, sum(w * c * c) as sxx, sum(w * c * d) as sxy from pv)
select round((sxx * sy - sx * sxy) / (s * sxx - sx * sx), 6) as a, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 6) as b, n from s""")
def coverage_regression(spark, d):
    """Weighted line of an item's difference on a covariate of it, weights the numbers of its queries."""
    p, q = best(spark, d, 3), D.vec_queries(spark, d).select("query_id", "positive")
    a, b = ranks(spark, d, V.max_scores(p)).withColumnRenamed("rank", "a"), ranks(spark, d, V.topk_mean(p, 3)).withColumnRenamed("rank", "b")
    diff = F.when(F.col("a") <= 1, 1.0).otherwise(0.0) - F.when(F.col("b") <= 1, 1.0).otherwise(0.0)
    per = a.join(b, "query_id").join(q, "query_id").groupBy("positive").agg(F.count("*").alias("w"), (100 * F.avg(diff)).alias("d"), (F.avg("query_id") / 1000).alias("c"))
    return rounded(S.weighted_line(per, "c", "d", "w"))


FOLD = f", fo as (select query_id, (ntile(2) over (order by {u_sql('fold', 'query_id')}, query_id) - 1)::bigint as fold from q)"


@query(VEC + FOLD + "select query_id, fold from fo")
def fold_split(spark, d):
    return S.folds(D.vec_queries(spark, d), "query_id", "fold")


def cv_hits(spark, d):
    f = S.folds(D.vec_queries(spark, d), "query_id", "fold")
    return sweep(spark, d).join(f, "query_id").select("query_id", "fold", F.col("beta").alias("candidate"), (F.col("rank") <= 1).cast("long").alias("hit"))


CV = FOLD + SWEEP + ", ht as (select br.query_id, fold, beta as candidate, (rank <= 1)::int as hit from br join fo using (query_id)), hs as (select fold, candidate, sum(hit)::bigint as hits from ht group by fold, candidate), pk as (select fold, candidate, hits from (select *, row_number() over (partition by fold order by hits desc, candidate) as r from hs) where r = 1)"


@query(VEC + CV + "select fold, candidate, hits from pk")
def cv_pick(spark, d):
    return S.cv_pick(cv_hits(spark, d))


@query(VEC + CV + "select ht.query_id, ht.fold, ht.candidate, ht.hit::bigint as hit from ht join pk on pk.fold = 1 - ht.fold and pk.candidate = ht.candidate")
def out_of_fold(spark, d):
    return S.out_of_fold(cv_hits(spark, d))


@query(VEC + CV + "select round(100 * avg(ht.hit::double), 6) as r1, count(*) as n from ht join pk on pk.fold = 1 - ht.fold and pk.candidate = ht.candidate")
def cv_beta(spark, d):
    o = S.out_of_fold(cv_hits(spark, d))
    return rounded(o.agg((100 * F.avg(F.col("hit").cast("double"))).alias("r1"), F.count("*").alias("n")))


TWO = """, gl as (select distinct 'all' as gallery, video_id from gal union all select distinct 'low', video_id from gal where video_id < 7),
sc as (select 'max' as "column", * from ms union all select 'topk_mean', query_id, video_id, avg(score) from (select *, row_number() over (partition by query_id, video_id order by score desc, seg_row) as r from pr) where r <= 3 group by all),
rk2 as (select g.gallery, c."column", q.query_id, case when o.score is null then 1 + (select count(*) from gl x where x.gallery = g.gallery) else 1 + (select count(*) from sc b join gl x on x.gallery = g.gallery and x.video_id = b.video_id where b."column" = c."column" and b.query_id = q.query_id and b.score > o.score) end as rank
  from q cross join (select distinct gallery from gl) g cross join (select distinct "column" from sc) c left join gl i on i.gallery = g.gallery and i.video_id = q.positive left join sc o on o."column" = c."column" and o.query_id = q.query_id and o.video_id = i.video_id)"""


@query(VEC + TWO + f'select gallery, "column", {METRICS6} from rk2 group by 1, 2')
def two_column_report(spark, d):
    """Two aggregates in two galleries."""
    g = D.gallery(spark, d).select("video_id").distinct()
    s = best(spark, d, 3)
    ranks_ = P.gallery_ranks({"max": V.max_scores(s), "topk_mean": V.topk_mean(s, 3)}, D.vec_queries(spark, d), {"all": g, "low": g.where("video_id < 7")})
    return rounded(R.rank_metrics(ranks_, "gallery", "column"))


@query(VEC + """, bs as (select *, row_number() over (partition by query_id, video_id order by score desc, ts, seg_row) as r from pr),
ab as (select rk.query_id, q.positive, (rank = 1 and coalesce(greatest(0, least(te, q.gt_te) - greatest(ts, q.gt_ts)) / nullif(greatest(te, q.gt_te) - least(ts, q.gt_ts), 0) >= 0.1, false))::int as x, (rank <= 3)::int as y
       from rk join q using (query_id) left join bs on bs.query_id = rk.query_id and bs.video_id = rk.video_id and bs.r = 1)""" + boot_sql("positive", 100, "vc"))
def vcmr_bootstrap(spark, d):
    """Right moments at rank 1 against items within three."""
    q = D.vec_queries(spark, d).drop("q_emb")
    own = V.maxsim(best(spark, d)).withColumnRenamed("video_id", "positive").select("query_id", "positive", "ts", "te")
    rows = ranks(spark, d).join(q, "query_id").join(own, ["query_id", "positive"], "left")
    hit = (F.col("rank") == 1) & F.coalesce(X.tiou_hull("ts", "te", "gt_ts", "gt_te") >= 0.1, F.lit(False))
    u = rows.groupBy(F.col("positive").alias("unit")).agg(F.sum(hit.cast("long")).alias("x"), F.sum((F.col("rank") <= 3).cast("long")).alias("y"), F.count("*").alias("n"))
    return rounded(S.bootstrap(u, 100, "vc"))


@query(VEC + RUNS + "select positive as video_id, round(100 * avg(y::double), 6) as old, round(100 * avg(x::double), 6) as new, round(100 * avg((x - y)::double), 6) as diff from ab group by 1")
def run_comparison(spark, d):
    u = two_runs(spark, d, "positive")
    return rounded(u.select(F.col("unit").alias("video_id"), (100 * F.col("y") / F.col("n")).alias("old"), (100 * F.col("x") / F.col("n")).alias("new"), (100 * (F.col("x") - F.col("y")) / F.col("n")).alias("diff")))


# ---------------------------------------------------------------- analysis


@query(VEC + f"select case when query_id < 100 then 0 when query_id < 300 then 1 else 2 end::bigint as grp, {METRICS6} from rk group by 1")
def group_table_query_len(spark, d):
    return rounded(A.group_table(ranks(spark, d), A.bin_label(F.col("query_id"), [0, 100, 300])))


@query(VEC + f"select (n >= 2)::int::bigint as grp, {METRICS6} from rk join (select query_id, sum((score >= 0.3)::int) as n from pr group by 1) using (query_id) group by 1")
def group_table_duplicates(spark, d):
    n = near(spark, d, 0.3)
    return rounded(A.group_table(ranks(spark, d).join(n, "query_id"), (F.col("n") >= 2).cast("long")))


HUB = ", pl as (select *, row_number() over (partition by query_id order by score desc, seg_row) as place from pr), hb as (select gal.seg_row, gal.video_id, coalesce(sum((place = 1)::int), 0)::bigint as top1, coalesce(sum((place <= 10)::int), 0)::bigint as topk from gal left join pl on pl.seg_row = gal.seg_row and place <= 10 group by all)"


@query(VEC + HUB + "select seg_row, top1, topk from hb")
def hub_events(spark, d):
    return A.hub_counts(V.event_topk(top(spark, d, 10), 10), D.gallery(spark, d), 10)


@query(VEC + HUB + "select video_id % 3 as grp, count(*) as events, round(100 * count(*)::double / (select count(*) from hb), 6) as event_share, round(100 * sum(topk)::double / (select sum(topk) from hb), 6) as slot_share, round(100 * avg((topk = 0)::int::double), 6) as never from hb group by 1")
def hub_by_duration(spark, d):
    g = D.gallery(spark, d)
    h = A.hub_counts(V.event_topk(top(spark, d, 10), 10), g, 10).join(g.select("seg_row", (F.col("video_id") % 3).alias("grp")), "seg_row")
    return rounded(A.hub_shares(h, "grp"))


@query(VEC + "select query_id, sum((score >= 0.25)::int)::bigint as n_dup, sum((score >= 0.25 and video_id <> positive)::int)::bigint as n_dup_other from pr group by 1")
def near_duplicates(spark, d):
    return A.near_duplicates(D.vec_queries(spark, d).select("query_id", "q_emb", F.col("positive").alias("query_video")), D.gallery(spark, d), 0.25)


TOP = ", tp as (select * from (select query_id, positive, video_id, seg_row, score, row_number() over (partition by query_id order by score desc, seg_row) as place from pr) where place <= 5), sh as (select query_id, bool_or(place = 1 and video_id = positive) as exact1, bool_or(video_id = positive) as exactk, bool_or(place = 1 and (video_id = positive or score >= 0.35)) as sem1, bool_or(video_id = positive or score >= 0.35) as semk, bool_or(place = 1 and video_id % 2 = positive % 2) as same_video from tp group by 1)"


def _hits(spark, d):
    t = V.event_topk(top(spark, d, 5), 5).join(D.vec_queries(spark, d).select("query_id", "positive"), "query_id")
    t = t.withColumn("exact", F.col("video_id") == F.col("positive")).withColumn("meaning", F.col("score"))
    same = t.where("place = 1").select("query_id", (F.col("video_id") % 2 == F.col("positive") % 2).alias("same_video"))
    return A.semantic_hits(t, 0.35, 5).join(same, "query_id")


@query(VEC + TOP + "select query_id, exact1, exactk, sem1, semk from sh")
def semantic_hits(spark, d):
    return _hits(spark, d).drop("same_video")


@query(VEC + TOP + "select case when exact1 then 'right' when same_video then 'same video' when sem1 then 'same meaning' else 'other' end as kind, count(*) as n, round(100 * count(*)::double / (select count(*) from sh), 6) as share from sh group by 1")
def error_types(spark, d):
    return rounded(A.error_types(_hits(spark, d)))


@query(VEC + TOP + "select round(100 * avg(exact1::int::double), 6) as exact1, round(100 * avg(semk::int::double), 6) as semk, round(100 * avg(case when not exact1 then sem1::int::double end), 6) as misses_same_meaning from sh")
def semantic_recall(spark, d):
    h = _hits(spark, d)
    return rounded(h.agg(R.pct(F.col("exact1")).alias("exact1"), R.pct(F.col("semk")).alias("semk"), (100 * F.avg(F.when(~F.col("exact1"), F.col("sem1").cast("int").cast("double")))).alias("misses_same_meaning")))


@query(VEC + f"select query_id, seg_row, bin from (select query_id, seg_row, case when score >= 0.2 then 2 when score >= 0 then 1 else 0 end::bigint as bin, row_number() over (partition by case when score >= 0.2 then 2 when score >= 0 then 1 else 0 end order by {u_sql('cal', 'query_id::varchar || chr(95) || seg_row::varchar')}, query_id::varchar || chr(95) || seg_row::varchar) as r from pr) where r <= 20")
def calibration_sample(spark, d):
    return A.pair_sample(D.vec_queries(spark, d), D.gallery(spark, d), [-math.inf, 0.0, 0.2], 20, "cal")


@query(VEC + "select query_id, rank from rk where rank > 5")
def long_tail(spark, d):
    return ranks(spark, d).where("rank > 5")


@query(VEC + RUNS + "select rk.query_id, rk.rank as rank_max, tr2.rank as rank_topk, round(greatest(0.0::double, least(1.0::double, rk.query_id / 400.0::double)), 6) as rel_pos from rk join tr2 using (query_id)")
def per_query_wide(spark, d):
    p = best(spark, d, 3)
    long = ranks(spark, d).withColumn("run", F.lit("rank_max")).unionByName(ranks(spark, d, V.topk_mean(p, 3)).withColumn("run", F.lit("rank_topk")))
    wide = long.groupBy("query_id").pivot("run", ["rank_max", "rank_topk"]).agg(F.first("rank"))
    return wide.withColumn("rel_pos", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("query_id") / 400.0))))


@query(VEC + "select grp, count(*) as n, round(quantile_cont(rank::double, 0.5), 6) as rank_median, round(avg(rank), 6) as rank_mean from (select 'first' as grp, rank from rk where rank = 1 union all select 'top5', rank from rk where rank <= 5 union all select 'late', rank from rk where rank > 5) group by 1")
def flip_profile(spark, d):
    r = ranks(spark, d).withColumn("first", F.col("rank") == 1).withColumn("top5", F.col("rank") <= 5).withColumn("late", F.col("rank") > 5)
    return rounded(A.flip_profile(r, ["first", "top5", "late"], ["rank"]))


@query(VEC + RUNS + "select query_id, rk.rank as rank_max, tr2.rank as rank_topk from rk join tr2 using (query_id) where rk.rank = 1 order by tr2.rank desc, query_id limit 5")
def wins_over(spark, d):
    """Five queries that the maximum wins most clearly (a report of five)."""
    w = per_query_wide(spark, d)
    return w.where("rank_max = 1").orderBy(F.desc("rank_topk"), "query_id").limit(5).select("query_id", "rank_max", "rank_topk")


@query(VEC + ", bs as (select *, row_number() over (partition by query_id, video_id order by score desc, ts, seg_row) as r from pr), x as (select rk.query_id, seg_row, coalesce(greatest(0, least(te, q.gt_te) - greatest(ts, q.gt_ts)) / nullif(greatest(te, q.gt_te) - least(ts, q.gt_ts), 0), 0) as fit from rk join q using (query_id) join bs on bs.query_id = rk.query_id and bs.video_id = rk.video_id and r = 1 where rank = 1) select query_id, seg_row, round(fit, 6) as fit from x where fit < 0.5")
def same_video_wrong_event(spark, d):
    q, own = D.vec_queries(spark, d).drop("q_emb"), V.maxsim(best(spark, d)).withColumnRenamed("video_id", "positive")
    rows = ranks(spark, d).where("rank = 1").join(q, "query_id").join(own, ["query_id", "positive"]).withColumn("fit", X.tiou_hull("ts", "te", "gt_ts", "gt_te"))
    return rows.where("fit < 0.5").select("query_id", "seg_row", r6("fit"))


@query(VEC + f", nd as (select query_id, sum((score >= 0.25)::int) as n from pr group by 1), pk2 as (select query_id from nd where n >= 1 order by {u_sql('ex', 'query_id')}, query_id limit 5) select * from (select query_id, video_id, row_number() over (partition by query_id order by score desc, video_id)::int as place from ms where query_id in (select query_id from pk2)) where place <= 3")
def near_dup_examples(spark, d):
    """Five queries with near-duplicates, drawn by hash, and their best three items (a report)."""
    few = A.sample(near(spark, d, 0.25).where("n >= 1"), "query_id", 5, "ex").select("query_id")
    return V.video_topk(best(spark, d).join(few, "query_id", "left_semi"), 3).select("query_id", "video_id", "place")


@query(VEC + RUNS + "select (ab.query_id % 3 = 0) as missed, count(*) as n, round(100 * avg(x::double), 6) as r1, round(100 * sum(x - y)::double / (select count(*) from ab), 6) as contribution from ab group by 1")
def missed_group_contribution(spark, d):
    u = two_runs(spark, d, "query_id").withColumn("missed", F.col("unit") % 3 == 0)
    total = u.agg(F.sum("n").alias("total"))
    per = u.groupBy("missed").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).crossJoin(total)
    return rounded(per.select("missed", "n", (100 * F.col("x") / F.col("n")).alias("r1"), (100 * (F.col("x") - F.col("y")) / F.col("total")).alias("contribution")))


@query(VEC + "select case when video_id < 7 then 'val' else 'dev' end as split, round(avg(case when query_id % 3 = 0 then rank end), 6) as p0, round(avg(case when query_id % 3 = 1 then rank end), 6) as p1, round(avg(case when query_id % 3 = 2 then rank end), 6) as p2 from rk group by 1")
def metric_pivot(spark, d):
    r = ranks(spark, d).join(D.vec_queries(spark, d).select("query_id", "positive"), "query_id").withColumn("split", F.when(F.col("positive") < 7, "val").otherwise("dev"))
    return rounded(r.withColumn("p", F.concat(F.lit("p"), F.col("query_id") % 3)).groupBy("split").pivot("p", ["p0", "p1", "p2"]).agg(F.avg("rank")))


@query(VEC + "select video_id, count(*) as vectors, (count(*) * 64 * 4)::bigint as fp32_bytes, (count(*) * 64 * 2)::bigint as fp16_bytes, (count(*) * (64 + 4))::bigint as int8_bytes from gal group by 1")
def index_bytes(spark, d):
    n = F.count("*")
    return D.gallery(spark, d).groupBy("video_id").agg(n.alias("vectors"), (n * 64 * 4).alias("fp32_bytes"), (n * 64 * 2).alias("fp16_bytes"), (n * 68).alias("int8_bytes"))


@query("with a as (select vec_id, label, embedding::double[] as e from embeddings), b as (select vec_id, label, [round(x, 2) for x in embedding::double[]] as f from embeddings), c as (select a.label as video_id, list_dot_product(e, f) / greatest(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f)), 1e-12) as cos from a join b using (vec_id)) select video_id, count(*) as n, round(min(cos), 6) as least, round(avg(cos), 6) as mean, min(cos) >= 0.99 as ok from c group by 1")
def feature_parity(spark, d):
    e = D.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("video_id"), F.col("embedding").alias("e"))
    o = e.select("vec_id", F.transform("e", lambda x: F.round(x.cast("double"), 2)).alias("f"))
    c = e.join(o, "vec_id").withColumn("cos", X.dot("e", "f") / F.greatest(X.norm("e") * X.norm("f"), F.lit(1e-12)))
    return rounded(c.groupBy("video_id").agg(F.count("*").alias("n"), F.min("cos").alias("least"), F.avg("cos").alias("mean"), (F.min("cos") >= 0.99).alias("ok")))


# ---------------------------------------------------------------- losses


@query(VEC + "select query_id, round(ln(sum(exp(score / 0.1))) - ln(sum(case when video_id = positive then exp(score / 0.1) else 0 end)), 6) as loss from ms join q using (query_id) group by 1 having sum((video_id = positive)::int) > 0")
def infonce_loss(spark, d):
    s = V.max_scores(best(spark, d)).join(D.vec_queries(spark, d).select("query_id", "positive"), "query_id")
    return rounded(L.softmax_loss(s.withColumn("is_positive", F.col("video_id") == F.col("positive")), 0.1))


@query(VEC + "select query_id, round(ln(sum(exp(score / 0.1))) - ln(sum(case when seg_row % 5 = 1 then exp(score / 0.1) else 0 end)), 6) as loss from pr where video_id = positive group by 1 having sum((seg_row % 5 = 1)::int) > 0")
def event_loss(spark, d):
    """Within a query's own item."""
    return rounded(L.own_item_loss(D.vec_queries(spark, d), D.gallery(spark, d), "positive", F.col("seg_row") % 5 == 1, 0.1))


@query(VEC + "select query_id, video_id, round(exp(score / 0.1) / sum(exp(score / 0.1)) over (partition by query_id), 6) as target from ms")
def soft_targets(spark, d):
    return L.soft_targets(V.max_scores(best(spark, d)), 0.1).select("query_id", "video_id", r6("target"))


@query(VEC + f"select query_id, coalesce(lead(query_id) over (order by {u_sql('der', 'query_id')}, query_id), first_value(query_id) over (order by {u_sql('der', 'query_id')}, query_id)) as partner from q")
def derangement(spark, d):
    return L.derangement(D.vec_queries(spark, d), "query_id", "der")


@query()
def one_per_video_batches(spark, d):
    return L.one_per_video_batches(D.gallery(spark, d).select(F.col("seg_row").alias("caption_id"), "video_id"), 8, "batch")


# ---------------------------------------------------------------- cross-validated unions and pairs of weights


GAMMAS = (-0.05, 0.0, 0.05)
E3 = FOLD + """, gm as (select unnest([-0.05::double, 0.0, 0.05]) as candidate), a as (select query_id, video_id, max(score) as own from pr where seg_row % 3 <> 0 group by all), b as (select query_id, video_id, max(score) as other from pr where seg_row % 3 = 0 group by all),
us as (select candidate, query_id, video_id, greatest(own, other + candidate) as score from (a full join b using (query_id, video_id)) cross join gm),
ur as (select candidate, q.query_id, 1 + (select count(*) from us b2 where b2.candidate = gm.candidate and b2.query_id = q.query_id and b2.score > (select score from us c where c.candidate = gm.candidate and c.query_id = q.query_id and c.video_id = q.positive)) as rank from q, gm),
ht as (select ur.query_id, fold, candidate, (rank <= 1)::int as hit from ur join fo using (query_id)), hs as (select fold, candidate, sum(hit)::bigint as hits from ht group by fold, candidate), pk as (select fold, candidate from (select *, row_number() over (partition by fold order by hits desc, candidate) as r from hs) where r = 1)"""


@query(VEC + E3 + "select ht.query_id, ht.fold, ht.candidate, ht.hit::bigint as hit from ht join pk on pk.fold = 1 - ht.fold and pk.candidate = ht.candidate")
def cv_e3(spark, d):
    """The offset of the window source, chosen on the other fold; all candidates in one pass."""
    main, win = (V.max_scores(best(spark, d, where=w)) for w in ("seg_row % 3 <> 0", "seg_row % 3 = 0"))
    s = reduce(DataFrame.unionByName, [V.score_union(main, win, g).withColumn("candidate", F.lit(g)) for g in GAMMAS])
    own = R.strict_ranks(s, D.vec_queries(spark, d), 0, "candidate")
    f = S.folds(D.vec_queries(spark, d), "query_id", "fold")
    return S.out_of_fold(own.join(f, "query_id").select("query_id", "fold", "candidate", (F.col("rank") <= 1).cast("long").alias("hit")))


@query(VEC + ", hf as (select q.query_id, q.positive, gal.video_id, list_dot_product(q_emb, emb) as s, list_dot_product(q_emb[1:32], emb[1:32]) as h, list_dot_product(q_emb[33:64], emb[33:64]) as k from q cross join gal), gr as (select a, b, (row_number() over (order by a + b, b))::bigint as candidate from (select unnest([0.0::double, 0.5]) as a) cross join (select unnest([0.0::double, 0.25]) as b)), sc as (select candidate, query_id, positive, video_id, max(s + a * h + b * k) as score from hf cross join gr group by all), rr as (select candidate, query_id, 1 + (select count(*) from sc y where y.candidate = x.candidate and y.query_id = x.query_id and y.score > x.score) as rank from sc x where positive = video_id) select candidate, sum((rank <= 1)::int)::bigint as hits from rr group by 1")
def cv_beta_ab(spark, d):
    """Hits at rank 1 on a grid of two weights, ordered by their sum, then by the second."""
    q, g, sources = D.vec_queries(spark, d), D.gallery(spark, d), {"emb": "q_emb", "first": "q_first", "second": "q_second"}
    for k, half in enumerate(("first", "second")):
        q, g = q.withColumn(f"q_{half}", F.slice("q_emb", 32 * k + 1, 32)), g.withColumn(half, F.slice("emb", 32 * k + 1, 32))
    grid = sorted(((a, b) for a in (0.0, 0.5) for b in (0.0, 0.25)), key=lambda x: (x[0] + x[1], x[1]))
    s = V.item_pairs(q, g, sources=sources, variants=[{"emb": 1.0, "first": a, "second": b} for a, b in grid])
    s = s.groupBy((F.col("variant") + 1).cast("long").alias("candidate"), "query_id", "video_id").agg(F.max("score").alias("score"))
    return R.strict_ranks(s, q, 0, "candidate").groupBy("candidate").agg(F.sum((F.col("rank") <= 1).cast("long")).alias("hits"))
