"""Queries on segments: interval algebra, generators, keys, localisation, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segquery.functions import exprs as X
from segquery.functions import sql
from segquery.operators import analysis as A
from segquery.operators import evaluation as E
from segquery.operators import intervals as I
from segquery.operators import localize as L
from segquery.operators import partitions as P
from segquery.operators import prepare as Q
from segquery.operators import reports as M
from segquery.operators import retrieval as R
from segquery.operators import stats as S
from segquery.sources import sinks
from segquery.streaming import streams

from . import fixtures as D
from .fixtures import SEG, normal_sql, u_sql
from .registry import query, r6, rounded


def parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = D.segments(spark, d)
    return s, D.truths(s), D.predictions(s), D.videos(s)


# ---------------------------------------------------------------- intervals


@query(SEG + "select event_id, greatest(0, ts - 500)::bigint as ts, least(te, dur - 2000)::bigint as te from seg where least(te, dur - 2000) > greatest(0, ts - 500) and greatest(0, ts - 500) <= dur - 2000 - 100")
def clamp_segments(spark, d):
    s = parts(spark, d)[0].withColumn("ts", F.col("ts") - 500).withColumn("dur", F.col("dur") - 2000)
    return I.clamp(s, 100).select("event_id", F.col("ts").cast("long").alias("ts"), F.col("te").cast("long").alias("te"))


@query(SEG + "select gt_id, pred_id, round(inter / (greatest(g1, p1) - least(g0, p0)), 6) as tiou from pp where inter > 0")
def tiou_hull(spark, d):
    _, g, p, _ = parts(spark, d)
    return I.pairs(g, p).where("tiou > 0").select("gt_id", "pred_id", r6(X.tiou_hull("g0", "g1", "p0", "p1"), "tiou"))


@query(SEG + "select gt_id, pred_id, round(tiou, 6) as tiou from pt where tiou > 0")
def tiou_union(spark, d):
    _, g, p, _ = parts(spark, d)
    return I.pairs(g, p).where("tiou > 0").select("gt_id", "pred_id", r6("tiou"))


@query(SEG + "select video_id, gt_id, round(best, 6) as best from bt")
def best_tiou(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(I.best_tiou(g, p))


@query(SEG + "select video_id % 10 as grp, count(*) as n, round(100 * avg((best < 0.3)::int::double), 6) as miss from bt group by 1")
def miss_rate(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(I.best_tiou(g, p).groupBy((F.col("video_id") % 10).alias("grp")).agg(F.count("*").alias("n"), R.pct(F.col("best") < 0.3).alias("miss")))


BEST = ", bm as (select gt_id, pred_id, tiou from (select *, row_number() over (partition by gt_id order by tiou desc, p0, pred_id) as r from pt) where r = 1)"


@query(SEG + BEST + "select gt.event_id as gt_id, pred_id, round(tiou, 6) as tiou from gt left join bm on gt_id = event_id")
def best_match(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(I.best_match(g, p))


@query(SEG + "select gt.event_id as gt_id, case when tiou >= 0.5 then pred_id end as pred_id, round(tiou, 6) as tiou, case when n is null then 'item not in the database' when tiou >= 0.5 then 'found' else 'no event overlaps enough' end as status from gt left join (select video_id, count(*) as n from pred where video_id % 7 <> 0 group by 1) k using (video_id) left join (select gt_id, pred_id, tiou from (select *, row_number() over (partition by gt_id order by tiou desc, p0, pred_id) as r from pt where video_id % 7 <> 0) where r = 1) b on b.gt_id = gt.event_id")
def resolve_gt(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(I.resolve(g, p.where("video_id % 7 <> 0"), 0.5))


COVER = """, cv as (select video_id, dur, sum(greatest(0, te - greatest(ts, coalesce(prev, ts))))::bigint as covered, sum(te - ts)::bigint as total
from (select *, max(te) over (partition by video_id order by ts, te rows between unbounded preceding and 1 preceding) as prev from pred) group by all)"""


@query(SEG + COVER + "select video_id, dur, covered, round(covered::double / dur, 6) as coverage from cv")
def coverage(spark, d):
    return rounded(I.coverage(parts(spark, d)[2]).withColumn("covered", F.col("covered").cast("long")))


@query(SEG + COVER + "select video_id, round(1 - covered::double / total, 6) as overlap from cv")
def overlap_ratio(spark, d):
    return rounded(I.overlap_ratio(parts(spark, d)[2]))


GAP = """, ev as (select video_id, ts, te, dur from pred union all select video_id, dur, dur, dur from (select distinct video_id, dur from pred)),
gp as (select video_id, greatest(0, coalesce(max(te) over (partition by video_id order by ts, te rows between unbounded preceding and 1 preceding), 0)) as g0, ts as g1, dur from ev),
gaps as (select video_id, g0 as ts, g1 as te, dur from gp where g1 > g0)"""


@query(SEG + GAP + "select video_id, ts::bigint as ts, te::bigint as te from gaps")
def uncovered_gaps(spark, d):
    return I.gaps(parts(spark, d)[2]).select("video_id", F.col("ts").cast("long").alias("ts"), F.col("te").cast("long").alias("te"))


@query(SEG + GAP + ", fg as (select *, greatest(1, floor((te - ts) / 30000.0::double + 0.5))::int as m from gaps where te - ts >= 20000) select video_id, k::int as k, round(ts + (te - ts) * k::double / m, 6) as ts, round(ts + (te - ts) * (k + 1)::double / m, 6) as te from (select *, unnest(range(m)) as k from fg)")
def fill_gaps(spark, d):
    return rounded(I.fill_gaps(parts(spark, d)[2], 20000, 30000).select("video_id", "k", "ts", "te"))


ISLE = """, io as (select *, sum(case when ts <= prev then 0 else 1 end) over (partition by video_id order by ts, te rows between unbounded preceding and current row) as island
from (select *, max(te) over (partition by video_id order by ts, te rows between unbounded preceding and 1 preceding) as prev from pred)),
isl as (select video_id, island, min(ts) as ts, max(te) as te, count(*) as members from io group by video_id, island)"""


@query(SEG + ISLE + "select video_id, ts, te, members from isl")
def merged_islands(spark, d):
    return I.islands(parts(spark, d)[2]).select("video_id", "ts", "te", "members")


OUT = ISLE + ", wo as (select w.video_id, w.event_id as window_id, 1 - coalesce(sum(case when isl.ts is not null then greatest(0, least(w.te, isl.te) - greatest(w.ts, isl.ts)) end), 0)::double / (w.te - w.ts) as outside from gt w left join isl on isl.video_id = w.video_id and isl.ts < w.te and isl.te > w.ts group by w.video_id, w.event_id, w.te, w.ts)"


def _outside(spark, d, share=None):
    _, g, p, _ = parts(spark, d)
    w = g.select("video_id", F.col("gt_id").alias("window_id"), "ts", "te")
    got = I.outside_fraction(w, p) if share is None else I.gap_windows(w, p, share)
    return got.select("video_id", "window_id", r6("outside"))


@query(SEG + OUT + "select video_id, window_id, round(outside, 6) as outside from wo")
def outside_fraction(spark, d):
    return _outside(spark, d)


@query(SEG + OUT + "select video_id, window_id, round(outside, 6) as outside from wo where outside >= 0.5")
def gap_windows(spark, d):
    return _outside(spark, d, 0.5)


@query(SEG + OUT + "select count(*) as items, round(avg(n), 6) as mean_gap, round(quantile_cont(n, 0.5), 6) as median_gap, sum((n = 0)::int)::bigint as without from (select video_id, sum((outside >= 0.5)::int)::double as n from wo group by 1)")
def gap_stats(spark, d):
    per = _outside(spark, d).groupBy("video_id").agg(F.sum((F.col("outside") >= 0.5).cast("double")).alias("n"))
    return rounded(per.agg(F.count("*").alias("items"), F.avg("n").alias("mean_gap"), F.percentile("n", F.lit(0.5)).alias("median_gap"), F.sum((F.col("n") == 0).cast("long")).alias("without")))


@query(SEG + "select event_id, te - ts < 6000 as extended, round(case when te - ts >= 6000 then ts when 6000 >= dur then 0 else greatest(0, least((ts + te) / 2.0::double - 3000, dur - 6000)) end, 6) as ts, round(case when te - ts >= 6000 then te when 6000 >= dur then dur else greatest(0, least((ts + te) / 2.0::double - 3000, dur - 6000)) + 6000 end, 6) as te from seg")
def extend_short(spark, d):
    return rounded(I.extend_short(parts(spark, d)[0], 6000.0).select("event_id", "ts", "te", "extended"))


@query(SEG + "select event_id, round(greatest(0, least(greatest(ts, 0), dur) - dur / 16.0::double), 6) as ts, round(least(dur, least(greatest(ts, 0), dur) + dur / 16.0::double), 6) as te from seg")
def centred_windows(spark, d):
    a, b = I.centred(F.col("ts").cast("double"), F.col("dur"), F.lit(8))
    return rounded(parts(spark, d)[0].select("event_id", a.alias("ts"), b.alias("te")))


@query(SEG + "select event_id, round(greatest(0, least(ts - 7000.0::double, dur - least(14000, dur))), 6) as ts, round(greatest(0, least(ts - 7000.0::double, dur - least(14000, dur))) + least(14000, dur), 6) as te from seg")
def medoid_window(spark, d):
    a, b = I.window_around(F.col("ts").cast("double"), F.col("dur").cast("double"), F.lit(7000.0))
    return rounded(parts(spark, d)[0].select("event_id", a.alias("ts"), b.alias("te")))


# n rows of a series are resampled to 256 steps; a coordinate stands for the middle of its step
@query(SEG + "select event_id, round(greatest(0, least(((event_id % 256) + 0.5::double) * ceil(dur / 100.0::double) / 256, dur / 200.0::double)), 6) as sec from seg")
def grid_to_sec(spark, d):
    s = parts(spark, d)[0]
    return s.select("event_id", r6(X.grid_to_sec(F.col("event_id") % 256, F.ceil(F.col("dur") / 100.0), F.col("dur") / 200.0), "sec"))


@query(SEG + "select event_id, round((ts / 100.0::double) * 256 / ceil(dur / 100.0::double) - 0.5, 6) as grid from seg")
def sec_to_grid(spark, d):
    return parts(spark, d)[0].select("event_id", r6(X.sec_to_grid(F.col("ts") / 100.0, F.ceil(F.col("dur") / 100.0)), "grid"))


@query(SEG + "select video_id, j::int as step, round((j * 8 + 0.5::double) * ceil(dur / 100.0::double) / 256, 6) as t from (select video_id, dur, unnest(range(32)) as j from vid)")
def level_times(spark, d):
    v = parts(spark, d)[3]
    return v.select("video_id", F.posexplode(X.level_times(F.ceil(F.col("dur") / 100.0), 3)).alias("step", "t")).select("video_id", "step", r6("t"))


@query(SEG + "select event_id, i::int as i, trunc(f + i * (e - f) / 7.0::double)::bigint as frame from (select *, unnest(range(8)) as i from (select *, round_even(ts * 0.3::double, 0) as f, least(round_even(te * 0.3::double, 0), floor(dur * 0.3::double) - 1) as e from seg) where f <= e)")
def frame_index(spark, d):
    s = parts(spark, d)[0].withColumn("n", F.floor(F.col("dur") * 0.3)).where(F.rint(F.col("ts") * 0.3) <= F.col("n") - 1)
    return s.select("event_id", F.posexplode(X.frame_index("ts", "te", 0.3, "n")).alias("i", "frame"))


@query(SEG + """, st as (select video_id, step, (step + 0.5) * dur / 32.0::double as t from (select video_id, dur, unnest(range(32)) as step from vid)),
jn as (select gt.event_id as seg_id, step, t, ts, te, row_number() over (partition by gt.event_id order by abs(t - (ts + te) / 2.0::double), step) as n from gt join st using (video_id))
select seg_id, step::int as step, case when t < ts then 0 when t > te then 2 else 1 end as relation from jn where (t >= ts - 1000 and t <= te + 1000) or n = 1""")
def series_window_membership(spark, d):
    _, g, _, v = parts(spark, d)
    st = v.select("video_id", "dur", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("step")).select("video_id", "step", ((F.col("step") + 0.5) * F.col("dur") / 32.0).alias("t"))
    return I.series_windows(g.withColumnRenamed("gt_id", "seg_id"), st, 1000)


@query("select label::bigint as video_id, vec_id as step, round(1 - list_dot_product(e, p) / greatest(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p)), 1e-12), 6) as distance from (select label, vec_id, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as p from embeddings)")
def consecutive_distance(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("step"), F.col("embedding").alias("emb"))
    return rounded(I.consecutive_distance(e))


# ---------------------------------------------------------------- generators


@query(SEG + "select video_id, 0 as k, 0.0::double as ts, dur::double as te from vid")
def partition_global(spark, d):
    return P.whole(parts(spark, d)[3]).select("video_id", "k", "ts", "te")


@query(SEG + "select video_id, ts::bigint as ts, te::bigint as te from gt where te > ts and ts <= dur - 100")
def partition_gt(spark, d):
    _, g, _, v = parts(spark, d)
    return P.given(g, v, 100).select("video_id", F.col("ts").cast("long").alias("ts"), F.col("te").cast("long").alias("te"))


@query(SEG + "select video_id, k::int as k, round(dur * k / 12.0::double, 6) as ts, round(dur * (k + 1) / 12.0::double, 6) as te from (select *, unnest(range(12)) as k from vid)")
def partition_uniform(spark, d):
    return rounded(P.uniform(parts(spark, d)[3], 12).select("video_id", "k", "ts", "te"))


@query(SEG + "select video_id, k::int as k, round(dur * k::double / n, 6) as ts, round(dur * (k + 1)::double / n, 6) as te from (select video_id, dur, n, unnest(range(n)) as k from vid join (select video_id, count(*) as n from pred group by 1) using (video_id))")
def partition_uniform_k(spark, d):
    _, _, p, v = parts(spark, d)
    return rounded(P.uniform_like(v, p).select("video_id", "k", "ts", "te"))


@query(SEG + ", c as (select *, greatest(1, ceil(dur / 14000.0::double))::int as n from vid), c2 as (select *, case when n > 1 and dur - (n - 1) * 14000 <= 2000 then n - 1 else n end as m from c) select video_id, k::int as k, k * 14000.0::double as ts, case when k = m - 1 then dur else (k + 1) * 14000 end::double as te from (select *, unnest(range(m)) as k from c2)")
def partition_chunk(spark, d):
    return P.chunks(parts(spark, d)[3], 14000.0, 2000.0).select("video_id", "k", "ts", "te")


RAND = f""", rw as (select video_id, dur, n, k, -ln(greatest({u_sql('rand', 'video_id', 'k')}, 1e-12::double)) as w from (select video_id, dur, n, unnest(range(n)) as k from vid join (select video_id, count(*) as n from pred group by 1) using (video_id))),
rl as (select *, case when dur - n * 200 < 0 then dur::double / n else 200 + (dur - n * 200) * w / sum(w) over (partition by video_id) end as l from rw),
rp as (select video_id, k, sum(l) over (partition by video_id order by k rows unbounded preceding) as te, l, dur from rl)"""


def rand_parts(spark, d) -> DataFrame:
    _, _, p, v = parts(spark, d)
    return P.random_contiguous(v.join(p.groupBy("video_id").agg(F.count("*").alias("n")), "video_id"), F.col("n"), 200.0, "rand")


@query(SEG + RAND + "select video_id, k::int as k, round(te - l, 4) as ts, round(te, 4) as te from rp")
def partition_random(spark, d):
    return rand_parts(spark, d).select("video_id", "k", F.round("ts", 4).alias("ts"), F.round("te", 4).alias("te"))


GTK = ", gk as (select video_id, event_id, ts, te, dur, row_number() over (partition by video_id order by ts, te, event_id) - 1 as k from gt)"


def gt_k(spark, d) -> DataFrame:
    w = Window.partitionBy("video_id").orderBy("ts", "te", "gt_id")
    return parts(spark, d)[1].withColumn("k", F.row_number().over(w) - 1).select("video_id", "k", "ts", "te", "dur")


SHIFT = f", sf as (select video_id, k, {u_sql('shift', 'video_id::varchar || chr(35) || k::varchar')} * greatest(0, least(dur - (te - ts), dur - 100)) as s, te - ts as l from gk)"


@query(SEG + GTK + SHIFT + "select video_id, k::int as k, round(s, 4) as ts, round(s + l, 4) as te from sf")
def partition_shift(spark, d):
    s = P.shifted(gt_k(spark, d), "shift", 100)
    return s.select("video_id", "k", F.round("ts", 4).alias("ts"), F.round("te", 4).alias("te"))


@query(SEG + "select video_id, src, ts::double as ts, te::double as te from (select *, row_number() over (partition by video_id, ts, te order by src) as r from (select distinct video_id, ts, te, case when event_type in ('purchase', 'signup') then 0 else 1 end as src from seg union all select video_id, 0, dur, 2 from vid)) where r = 1")
def partition_union(spark, d):
    _, g, p, v = parts(spark, d)
    return P.union_of([g, p, P.whole(v)], 1.0).select("video_id", "src", "ts", "te")


def dense_sql(w: int) -> str:
    return f"select video_id, {w}.0::double as level, k::int as k, k * {w / 2}::double as ts, least(k * {w / 2}::double + {w}, dur) as te from (select *, unnest(range(greatest(1, ceil((dur - {w / 2}::double) / {w / 2}::double))::int)) as k from vid)"


@query(SEG + f"select video_id, k, ts, te from ({dense_sql(80000)})")
def dense_windows(spark, d):
    return P.dense(parts(spark, d)[3], 80000.0).select("video_id", "k", "ts", "te")


@query(SEG + " union all ".join(dense_sql(w) for w in (40000, 80000, 160000)))
def multi_level_windows(spark, d):
    return P.multi_level(parts(spark, d)[3], (40000.0, 80000.0, 160000.0)).select("video_id", "level", "k", "ts", "te")


KEY = "video_id::varchar || chr(35) || k::varchar"


@query(SEG + GTK + f""", nz as (select *, (ts + te) / 2.0::double + 0.3::double * (te - ts) * {normal_sql('noise', KEY, 0)} as c, (te - ts) * exp(0.3::double * {normal_sql('noise', KEY, 1)}) / 2 as h from gk),
n2 as (select *, greatest(0, c - h) as lo, least(dur, c + h) as hi, greatest(0, least(c, dur)) as mid from nz)
select video_id, k::int as k, round(case when hi - lo < 200 then greatest(0, least(mid - 100, dur - 200)) else lo end, 2) as ts, least(round(case when hi - lo < 200 then least(greatest(0, least(mid - 100, dur - 200)) + 200, dur) else hi end, 2), dur::double) as te from n2""")
def boundary_noise(spark, d):
    return P.perturbed(gt_k(spark, d), 0.3, 200.0, "noise").select("video_id", "k", "ts", "te")


@query(SEG + "select count(*) as n, count(distinct video_id) as items, 0::bigint as outside, 0::bigint as unsorted, sum((te - ts < 200)::int)::bigint as short, 0::bigint as loose, (select count(*) from vid where video_id not in (select video_id from gt)) as missing from gt")
def partition_checks(spark, d):
    return P.checks(gt_k(spark, d), parts(spark, d)[3], 200.0, tol=0.0)


@query(SEG + "select video_id, count(*) as n, true as same from gt group by 1")
def shift_check(spark, d):
    g = gt_k(spark, d)
    return P.same_lengths(g, P.shifted(g, "shift", 100))


@query(SEG + "select role, count(*) as n, count(distinct video_id) as items, round(avg(te - ts), 6) as mean_length, round(quantile_cont((te - ts)::double, 0.5), 6) as median_length, round(quantile_cont((te - ts)::double, 0.1), 6) as p10_length, round(quantile_cont((te - ts)::double, 0.9), 6) as p90_length from seg group by 1")
def partition_shape(spark, d):
    return rounded(P.shape(parts(spark, d)[0], "role"))


@query()
def kmedoids(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("step"), F.col("embedding").alias("emb"))
    return L.kmedoid_steps(e, 4)


@query()
def calibrate_sigma(spark, d):
    s = gt_k(spark, d)
    sigma = P.calibrated_sigma(s, 0.7, 200.0, "cal")
    return spark.createDataFrame([(0.7, round(sigma, 6))], "target double, sigma double")


# ---------------------------------------------------------------- keys, logs, sets


@query(SEG + "select event_id, video_id::varchar || '__' || ts::varchar || '_' || te::varchar as seg_key from seg")
def seg_key(spark, d):
    return parts(spark, d)[0].select("event_id", X.seg_key("video_id", "ts", "te").alias("seg_key"))


@query("select doc_id, 'q_' || substr(md5(trim(text)), 1, 12) as key from documents")
def text_key(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.text_key("text").alias("key"))


@query("select event_id, user_id::varchar || '_' || event_id::varchar as item, event_id as ordinal from events")
def item_id(spark, d):
    e = D.table(spark, d, "events").select("event_id", F.concat(F.lit("/data/v.1/"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"))
    return e.select("event_id", X.item_id("path").alias("item"), X.event_ordinal(X.item_id("path")).alias("ordinal"))


@query("select event_id, event_id as ordinal from events")
def event_ordinal(spark, d):
    return D.table(spark, d, "events").select("event_id", X.event_ordinal(F.concat_ws("_", "event_type", "event_id")).alias("ordinal"))


@query(SEG + "select video_id::varchar || '__' || (ts // 20000)::varchar as key, count(*) as n, string_agg(event_id::varchar, ',' order by event_id::varchar) as refs from seg group by 1")
def unique_segments(spark, d):
    s = parts(spark, d)[0].withColumn("key", F.concat(F.col("video_id").cast("string"), F.lit("__"), F.floor(F.col("ts") / 20000).cast("string")))
    return A.unique_segments(s, "key", "event_id")


@query("select distinct user_id from events where event_type = 'purchase' and user_id not in (select user_id from events where event_type = 'signup')")
def work_list(spark, d):
    e = D.table(spark, d, "events")
    return A.work_list(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'").select("user_id").distinct(), "user_id")


@query("select event_id from events where event_id not in (select event_id from events where event_type = 'view' or event_type = 'click') order by event_id limit 50")
def pending_limit(spark, d):
    """The first fifty pending keys: the limit is the feature."""
    e = D.table(spark, d, "events")
    return A.work_list(e, e.where("event_type in ('view', 'click')"), "event_id", 50)


@query("select doc_id as caption_id, lang as video_id, text as sentence, case when quality = 1 then 'val' when quality = 0 then 'dev' else 'train' end as split from documents left join labels using (doc_id)")
def caption_table(spark, d):
    t, lab = D.table(spark, d, "documents"), D.table(spark, d, "labels")
    split = F.when(F.col("quality") == 1, "val").when(F.col("quality") == 0, "dev").otherwise("train")
    return t.join(lab, "doc_id", "left").select(F.col("doc_id").alias("caption_id"), F.col("lang").alias("video_id"), F.col("text").alias("sentence"), split.alias("split"))


@query(SEG + "select video_id, ts // 50000 as ts, string_agg(event_type, ' | ' order by event_id) as captions, count(*) as n from seg group by 1, 2")
def event_table(spark, d):
    s = parts(spark, d)[0].select("video_id", F.floor(F.col("ts") / 50000).alias("ts"), F.lit(0).alias("te"), "event_id", F.col("event_type").alias("caption"))
    return sinks.events_table(s).select("video_id", "ts", "captions", "n")


@query("select event_id, vec_id, label from (select event_id, event_id % (select count(*) from embeddings) as vec_id from events) join embeddings using (vec_id)")
def collect_segments(spark, d):
    store = D.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("emb"))
    n = store.count()
    rows = D.table(spark, d, "events").select("event_id", (F.col("event_id") % n).alias("vec_id"))
    return sinks.collect_vectors(rows, store, "vec_id").select("event_id", "vec_id", "label")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc, role, text) as r from conversations) where r = 1")
def latest_by_key(spark, d):
    c = D.table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("conv_id", "turn", "role")


@query("select user_id from (select distinct user_id from events where event_type = 'purchase') where user_id in (select user_id from events where event_type = 'click') and user_id not in (select user_id from events where event_type = 'error')")
def subset_selection(spark, d):
    e = D.table(spark, d, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id").distinct()
    return of("purchase").join(of("click"), "user_id", "left_semi").join(of("error"), "user_id", "left_anti")


@query("select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem) where r <= 3")
def first_n_annotations(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return D.table(spark, d, "lineitem").withColumn("_r", F.row_number().over(w)).where("_r <= 3").select("l_orderkey", "l_linenumber")


@query("select doc_id, coalesce(quality, toxic_fallback) as value, case when quality is not null then 'labels' when toxic_fallback is not null then 'documents' else 'missing' end as status from (select doc_id, quality, case when n_chars > 500 then 1 end as toxic_fallback from documents left join labels using (doc_id))")
def gt_fallback(spark, d):
    t = D.table(spark, d, "documents").join(D.table(spark, d, "labels"), "doc_id", "left").withColumn("second", F.when(F.col("n_chars") > 500, 1))
    status = F.when(F.col("quality").isNotNull(), "labels").when(F.col("second").isNotNull(), "documents").otherwise("missing")
    return t.select("doc_id", F.coalesce("quality", "second").alias("value"), status.alias("status"))


@query(SEG + "select video_id, max(te) as longest, max(ts) > dur - 1000 as late from seg group by video_id, dur")
def duration_checks(spark, d):
    return parts(spark, d)[0].groupBy("video_id", "dur").agg(F.max("te").alias("longest"), (F.max("ts") > F.col("dur") - 1000).alias("late")).drop("dur")


@query("with h as (select sha256(event_id::varchar || ':' || event_type) as h from events), p as (select substr(h, 1, 2) as g, count(*) as n, sha256(string_agg(h, '' order by h)) as d from h group by 1) select sum(n)::bigint as n, sha256(string_agg(d, '' order by g)) as digest from p")
def content_fingerprint(spark, d):
    return A.fingerprint(D.table(spark, d, "events"), F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type")))


@query(SEG + "select video_id, count(*) as n_cached, count(*) as n_source, sum((event_id % 5 = 0)::int)::bigint as bad from gt group by 1")
def conf_alignment(spark, d):
    g = parts(spark, d)[1]
    src = g.withColumn("te", F.col("te") + F.when(F.col("gt_id") % 5 == 0, 0.5).otherwise(0.0)).withColumn("ts", F.col("ts") + F.col("gt_id") * 1e-9)
    return A.conf_alignment(g.withColumn("ts", F.col("ts") + F.col("gt_id") * 1e-9), src)


@query("select task, count(*) as new_clips, round(count(*) * 0.26::double, 6) as seconds from (select l_partkey as seg_key, min(l_linenumber) as task from lineitem group by 1) where seg_key not in (select p_partkey from part where p_partkey % 10 = 0) group by 1")
def cost_estimate(spark, d):
    t = D.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("task"), F.col("l_partkey").alias("seg_key"))
    done = D.table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("seg_key"))
    return rounded(A.cost_estimate(t, done, 0.26))


@query("select event_type as phase, count(*) as n, round(avg(value), 6) as mean, round(60 * sum(value) / sum(event_id + 1), 6) as ratio from events where value is not null group by 1")
def timing_summary(spark, d):
    e = D.table(spark, d, "events").where("value is not null")
    return rounded(e.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (60 * F.sum("value") / F.sum(F.col("event_id") + 1)).alias("ratio")))


# ---------------------------------------------------------------- localisation


@query(SEG + ", rk as (select *, row_number() over (partition by video_id order by conf desc, event_id) as r from pred), bb as (select gt.event_id, coalesce(max(greatest(0, least(gt.te, rk.te) - greatest(gt.ts, rk.ts))::double / ((gt.te - gt.ts) + (rk.te - rk.ts) - greatest(0, least(gt.te, rk.te) - greatest(gt.ts, rk.ts)))), 0) as best from gt left join rk on rk.video_id = gt.video_id and r <= 10 group by 1) select count(*) as n_gt, round(avg((best >= 0.3)::int::double), 6) as recall, round(avg(best), 6) as mean_best from bb")
def recall_at_n(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.recall_at(g, p, 10, 0.3))


@query(SEG + ", k as (select video_id, count(*) as n from gt group by 1), rk as (select *, row_number() over (partition by video_id order by conf desc, event_id) as r from pred join k using (video_id)), bb as (select gt.event_id, coalesce(max(greatest(0, least(gt.te, rk.te) - greatest(gt.ts, rk.ts))::double / ((gt.te - gt.ts) + (rk.te - rk.ts) - greatest(0, least(gt.te, rk.te) - greatest(gt.ts, rk.ts)))), 0) as best from gt left join rk on rk.video_id = gt.video_id and r <= n group by 1) select count(*) as n_gt, round(avg((best >= 0.3)::int::double), 6) as recall, round(avg(best), 6) as mean_best from bb")
def mean_best_tiou(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.recall_at(g, p, "gt", 0.3))


@query(SEG + ", x as (select g, coalesce(p, 0) as p from (select video_id, count(*) as g from gt group by 1) left join (select video_id, count(*) as p from pred group by 1) using (video_id)) select count(*) as items, round(avg(g), 6) as mean_gt, round(avg(p), 6) as mean_pred, round(quantile_cont(g::double, 0.5), 6) as median_gt, round(quantile_cont(p::double, 0.5), 6) as median_pred, round(avg(p::double / g), 6) as mean_ratio, round(avg(abs(p - g)), 6) as mean_abs_diff, round(100 * avg((p < g)::int::double), 6) as fewer, round(100 * avg((p = g)::int::double), 6) as equal, round(100 * avg((p > g)::int::double), 6) as more, round(100 * avg((p::double / g < 0.5)::int::double), 6) as under_half, round(100 * avg((p::double / g > 2)::int::double), 6) as over_twice from x")
def count_stats(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.count_stats(g, p))


@query(SEG + "select count(*) as n, round(avg(p0 - g0), 6) as start_mean, round(quantile_cont((p0 - g0)::double, 0.5), 6) as start_median, round(avg(abs(p0 - g0)), 6) as start_abs, round(stddev_pop(p0 - g0), 6) as start_std, round(avg(p1 - g1), 6) as end_mean, round(quantile_cont((p1 - g1)::double, 0.5), 6) as end_median, round(avg(abs(p1 - g1)), 6) as end_abs, round(stddev_pop(p1 - g1), 6) as end_std from pt where tiou >= 0.3")
def offset_stats(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.offset_stats(I.pairs(g, p).where("tiou >= 0.3")))


BINS = "(values (0, 0.0::double, 2000.0::double), (1, 2000.0, 8000.0), (2, 8000.0, 16000.0), (3, 16000.0, 90000.0), (4, 90000.0, null)) b(bin, lo, hi)"
EDGES = [0.0, 2000.0, 8000.0, 16000.0, 90000.0]


@query(SEG + f"select bin, count(gt.event_id) as n, round(avg(bt.best), 6) as mean_best from {BINS} left join gt on te - ts >= lo and (hi is null or te - ts < hi) left join bt on bt.gt_id = gt.event_id group by 1")
def duration_bins(spark, d):
    _, g, p, _ = parts(spark, d)
    rows = g.join(I.best_tiou(g, p).select("gt_id", "best"), "gt_id").withColumn("length", (F.col("te") - F.col("ts")).cast("double"))
    return rounded(L.binned(rows, "length", EDGES).groupBy("bin").agg(F.count("gt_id").alias("n"), F.avg("best").alias("mean_best")))


@query(SEG + f"select bin, sum((role = 'gt')::int)::bigint as n_gt, sum((role = 'pred')::int)::bigint as n_pred, round(100 * sum((role = 'gt')::int)::double / (select count(*) from gt), 6) as pct_gt, round(100 * sum((role = 'pred')::int)::double / (select count(*) from pred), 6) as pct_pred from {BINS} join seg on te - ts >= lo and (hi is null or te - ts < hi) group by 1")
def length_hist(spark, d):
    s, g, p, _ = parts(spark, d)
    rows = s.withColumn("length", (F.col("te") - F.col("ts")).cast("double"))
    b = L.binned(rows, "length", EDGES, False).groupBy("bin").agg(F.sum((F.col("role") == "gt").cast("long")).alias("n_gt"), F.sum((F.col("role") == "pred").cast("long")).alias("n_pred"))
    every = Window.partitionBy()
    return rounded(b.select("bin", "n_gt", "n_pred", (100 * F.col("n_gt") / F.sum("n_gt").over(every)).alias("pct_gt"), (100 * F.col("n_pred") / F.sum("n_pred").over(every)).alias("pct_pred")))


@query(SEG + "select case when te - ts < 2000 then 0 when te - ts < 8000 then 1 when te - ts < 16000 then 2 else 3 end::bigint as grp, count(*) as n, round(100 * avg((best >= 0.3)::int::double), 6) as hit from gt join bt on bt.gt_id = gt.event_id group by 1")
def group_table_duration(spark, d):
    _, g, p, _ = parts(spark, d)
    rows = g.join(I.best_tiou(g, p).select("gt_id", "best"), "gt_id")
    return rounded(rows.groupBy(A.bin_label(F.col("te") - F.col("ts"), [0, 2000, 8000, 16000]).alias("grp")).agg(F.count("*").alias("n"), R.pct(F.col("best") >= 0.3).alias("hit")))


@query(SEG + """, hd as (select pred_id, count(*) as n from pp where inter > 0 and inter >= 0.5 * (g1 - g0) group by 1),
ef as (select gt_id, max(tiou) as best, sum((inter > 0 and inter >= 0.5 * (p1 - p0))::int)::bigint as parts, bool_or(inter > 0 and inter >= 0.5 * (g1 - g0) and coalesce(n, 0) > 1) as in_merged from pt left join hd using (pred_id) group by 1)
select gt.event_id as gt_id, round(coalesce(best, 0), 6) as best, coalesce(parts, 0)::bigint as parts, coalesce(in_merged, false) as in_merged, coalesce(best, 0) <= 0 as missed, coalesce(parts, 0) >= 2 as fragmented from gt left join ef on ef.gt_id = gt.event_id""")
def video_error_flags(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.error_flags(g, p))


@query(SEG + ", un as (select video_id, k, dur * k::double / n as a, dur * (k + 1)::double / n as z from (select video_id, dur, n, unnest(range(n)) as k from vid join (select video_id, count(*) as n from gt group by 1) using (video_id))), bb as (select gt.event_id, max(greatest(0, least(te, z) - greatest(ts, a)) / ((te - ts) + (z - a) - greatest(0, least(te, z) - greatest(ts, a)))) as best from gt join un using (video_id) group by 1) select count(*) as n, round(avg(best), 6) as mean_best from bb")
def uniform_baseline(spark, d):
    _, g, _, v = parts(spark, d)
    u = P.uniform_like(v, g).withColumn("pred_id", F.col("k")).withColumn("conf", F.lit(1.0))
    return rounded(I.best_tiou(g, u).agg(F.count("*").alias("n"), F.avg("best").alias("mean_best")))


THETA = ", th as (select unnest([0.2::double, 0.4, 0.6, 0.8]) as theta), tk as (select theta, count(*)::double / (select count(*) from vid) as mean_k from th join pred on conf >= theta group by 1)"


@query(SEG + THETA + "select theta, round(mean_k, 6) as mean_k from tk order by round(abs(mean_k - (select count(*)::double / (select count(*) from vid) from gt)), 9), theta limit 1")
def choose_theta(spark, d):
    _, g, p, v = parts(spark, d)
    n, target = v.count(), g.count() / v.count()
    t = F.broadcast(spark.createDataFrame([(x,) for x in (0.2, 0.4, 0.6, 0.8)], "theta double"))
    k = p.join(t, p.conf >= t.theta).groupBy("theta").agg((F.count("*") / n).alias("mean_k"))
    return rounded(S.choose_closest(k, F.col("mean_k"), target, F.asc("theta")))


@query(SEG + "select event_id as pred_id from (select *, row_number() over (partition by video_id order by conf desc, event_id) as r from pred) where conf >= 0.4 and r <= 8")
def theta_filter_topk(spark, d):
    return L.theta_topk(parts(spark, d)[2], 0.4, 8).select("pred_id")


def forced_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    f = D.forced(D.segments(spark, d))
    return D.truths(f), D.predictions(f)


@query(SEG + "select video_id, gt_id, pred_id, round(tiou, 6) as tiou from fm where tiou >= 0.55")
def matching_forced(spark, d):
    return rounded(L.hungarian(*forced_parts(spark, d), 0.55))


@query(SEG + ", c as (select (select count(*) from fgt) as n_gt, (select count(*) from fpred) as n_pred, (select count(*) from fm where tiou >= 0.55) as n_match) select n_gt, n_pred, n_match, round(n_match::double / n_pred, 6) as precision, round(n_match::double / n_gt, 6) as recall, round(2.0::double * n_match / (n_gt + n_pred), 6) as f1 from c")
def prf_forced(spark, d):
    g, p = forced_parts(spark, d)
    return rounded(L.prf(g, p, L.hungarian(g, p, 0.55)))


@query(SEG + ", fl as (select p.event_id as pred_id, p.conf, (exists (select 1 from fm where fm.pred_id = p.event_id and tiou >= 0.55))::int as tp from fpred p where p.video_id in (select video_id from fgt)), c as (select *, row_number() over (order by conf desc, pred_id) as r, sum(tp) over (order by conf desc, pred_id rows unbounded preceding) as cum from fl), e as (select *, max(cum::double / r) over (order by r rows between current row and unbounded following) as best from c) select round(sum(tp * best) / (select count(*) from fgt), 6) as ap from e")
def ap_forced(spark, d):
    g, p = forced_parts(spark, d)
    return rounded(L.average_precision(g, p, 0.55))


@query(SEG + "select video_id, count(*) as n from fm where tiou >= 0.55 group by 1")
def match_count_sql(spark, d):
    """The assignment as a grouped aggregate that SQL calls."""
    sql.register(spark)
    close = I.pairs(*forced_parts(spark, d)).where("tiou >= 0.55")
    return spark.sql("select video_id, seg_matches(gt_id, pred_id, tiou) as n from {close} group by video_id", close=close)


#: Events and predictions without rivals, two methods, splits by parity: item rows of every method.
SPLITS_SQL = """, me as (select 'every' as method, * from fpred union all select 'strong', * from fpred where conf >= 0.5),
it as (select method, video_id, case when video_id % 2 = 0 then 'even' else 'odd' end as split from (select distinct video_id from fgt) cross join (select distinct method from me)),
cl as (select me.method, fm.* from fm join me on me.event_id = fm.pred_id)"""


@query(SEG + SPLITS_SQL + """, be as (select it.method, it.video_id, it.split, g.event_id, coalesce(max(tiou), 0) as best from it join fgt g using (video_id) left join cl on cl.method = it.method and cl.gt_id = g.event_id group by all),
ro as (select method, video_id, split, count(*) as n_gt, sum(best) as best, sum((best >= 0.55)::int) as c1, sum((best >= 0.7)::int) as c2,
  (select count(*) from me where me.method = be.method and me.video_id = be.video_id) as n_pred, (select count(*) from cl where cl.method = be.method and cl.video_id = be.video_id and tiou >= 0.55) as m1, (select count(*) from cl where cl.method = be.method and cl.video_id = be.video_id and tiou >= 0.7) as m2 from be group by all),
su as (select coalesce(split, 'all') as split, method, count(*) as items, sum(n_gt)::bigint as n_gt, sum(n_pred)::bigint as n_pred, sum(best) as best, sum(c1) as c1, sum(c2) as c2, sum(m1)::double as m1, sum(m2)::double as m2 from ro group by grouping sets ((split, method), (method)))
select split, method, items, n_gt, n_pred, round(n_pred::double / items, 6) as seg_per_video, round(best / n_gt, 6) as mean_tiou, round(c1::double / n_gt, 6) as cover_55, round(m1 / n_pred, 6) as p_55, round(m1 / n_gt, 6) as r_55, round(2 * m1 / (n_gt + n_pred), 6) as f1_55,
  round(c2::double / n_gt, 6) as cover_70, round(m2 / n_pred, 6) as p_70, round(m2 / n_gt, 6) as r_70, round(2 * m2 / (n_gt + n_pred), 6) as f1_70 from su""")
def split_blocks(spark, d):
    """Two methods, two splits and all, two thresholds: one matching."""
    g, p = forced_parts(spark, d)
    return rounded(E.split_blocks(g, {"every": p, "strong": p.where("conf >= 0.5")}, parity(g), (0.55, 0.7)))


def parity(g: DataFrame) -> DataFrame:
    """(video_id, split)."""
    return g.select("video_id").distinct().withColumn("split", F.when(F.col("video_id") % 2 == 0, "even").otherwise("odd"))


@query(SEG + SPLITS_SQL + """, th as (select unnest([0.55::double, 0.7]) as threshold), sp as (select unnest(['even', 'odd', 'all']) as split),
fl as (select sp.split, me.method, threshold, me.event_id as pred_id, me.conf, (exists (select 1 from fm where fm.pred_id = me.event_id and tiou >= threshold))::int as tp from me join it using (method, video_id) join sp on sp.split = 'all' or sp.split = it.split cross join th),
c as (select *, row_number() over (partition by split, method, threshold order by conf desc, pred_id) as r, sum(tp) over (partition by split, method, threshold order by conf desc, pred_id rows unbounded preceding) as cum from fl),
e as (select *, max(cum::double / r) over (partition by split, method, threshold order by r rows between current row and unbounded following) as best from c),
ng as (select sp.split, count(*) as n_gt from fgt join sp on sp.split = 'all' or sp.split = case when video_id % 2 = 0 then 'even' else 'odd' end group by 1)
select split, method, threshold, round(coalesce(sum(tp * best), 0) / any_value(n_gt), 6) as ap from e join ng using (split) group by all""")
def split_average_precision(spark, d):
    g, p = forced_parts(spark, d)
    return rounded(E.average_precisions(g, {"every": p, "strong": p.where("conf >= 0.5")}, parity(g), (0.55, 0.7)))


@query()
def merge_overlaps(spark, d):
    return L.merge_overlaps(parts(spark, d)[2], 0.5)


@query()
def postprocess(spark, d):
    return L.postprocess(parts(spark, d)[2], 0.4, 16, 0.5, 6000.0)


@query()
def greedy_nms(spark, d):
    return L.greedy_nms(parts(spark, d)[2], 0.4, 0.3, 30)


@query()
def hungarian(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.hungarian(g, p, 0.3))


@query()
def prf(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.prf(g, p, L.hungarian(g, p, 0.3)))


@query()
def average_precision(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.average_precision(g, p, 0.3))


@query()
def theta_sweep(spark, d):
    _, g, p, _ = parts(spark, d)
    return rounded(L.theta_sweep(g, p, [0.2, 0.4, 0.6, 0.8], 0.3))


# ---------------------------------------------------------------- text


@query("select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as caption from documents")
def normalize_caption(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.normalise_caption("text").alias("caption"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint as words from documents")
def word_count(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.word_count("text").alias("words"))


TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 and x not in {X.STOP}))"


@query(f"select doc_id, len({TOKENS})::int as n from documents")
def token_set(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.size(X.token_set("text")).alias("n"))


@query(f"with b as (select item_id, {TOKENS} as w from benchmark), c as (select doc_id, {TOKENS} as w from documents), p as (select doc_id, item_id, len(list_intersect(b.w, c.w)) as i, len(b.w) + len(c.w) as n from b cross join c) select doc_id, item_id, round(i::double / (n - i), 6) as jaccard from p where i > 0 and i >= 0.15 * (n - i)")
def jaccard_pairs(spark, d):
    """All pairs of a document and an item with similar sets of words."""
    b = D.table(spark, d, "benchmark").select("item_id", X.token_set("text").alias("w"))
    c = D.table(spark, d, "documents").select("doc_id", X.token_set("text").alias("w"))
    return A.jaccard_join(c, b, "doc_id", "item_id", "w", 0.15).select("doc_id", "item_id", r6("jaccard"))


@query("select md5(c) as key, count(*) as n from (select trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as c from documents) group by c having count(*) > 1")
def exact_caption_groups(spark, d):
    g = D.table(spark, d, "documents").select(X.normalise_caption("text").alias("c")).groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    return g.select(F.md5(F.col("c").cast("binary")).alias("key"), "n")


# ---------------------------------------------------------------- streams


def _stream(spark, d) -> DataFrame:
    return streams.events_stream(spark, f"{d}/events.parquet")


@query("select epoch_us(time_bucket(interval 14 minutes, ts, timestamp '1970-01-01')) as start_us, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by 1")
def stream_chunks(spark, d):
    return streams.finished(streams.tumbling(_stream(spark, d), "14 minutes"), "stream_chunks")


@query("with w as (select epoch_us(time_bucket(interval 4 hours, ts, timestamp '1970-01-01')) as a, epoch_us(ts) as us from events), x as (select unnest([a, a - 14400000000]) as start_us, us from w) select start_us, count(*) as n from x where us >= start_us and us < start_us + 28800000000 group by 1")
def stream_dense(spark, d):
    return streams.finished(streams.sliding(_stream(spark, d), "8 hours", "4 hours"), "stream_dense")


@query("with b as (select user_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as p from events), c as (select *, sum(case when p is null or us - p >= 14400000000 then 1 else 0 end) over (partition by user_id order by us rows unbounded preceding) as g from b) select user_id, min(us) as start_us, count(*) as n from c group by user_id, g")
def stream_sessions(spark, d):
    return streams.finished(streams.sessions(_stream(spark, d), "4 hours"), "stream_sessions")


@query("select user_id, max(event_id) as event_id from events group by 1")
def stream_latest(spark, d):
    return streams.finished(streams.latest(_stream(spark, d)), "stream_latest")


@query("select user_id, event_id, event_type, round(value, 6) as value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1")
def stream_latest_record(spark, d):
    """The last record of each key, upserted batch by batch."""
    rows = _stream(spark, d).select("user_id", "event_id", "event_type", r6("value"))
    return streams.finished_latest(rows, "stream_latest_record", "user_id", "event_id")


# ---------------------------------------------------------------- levels and curves


THETAS, KS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), (1, 2, 3, 4, 5, 6)
LEVEL_SQL = f""", th as (select unnest({list(THETAS)}::double[]) as theta), ks as (select unnest({list(KS)}) as k), nv as (select count(*)::double as n from vid),
lv as (select 'theta' as kind, theta as value, (select count(*) from pred where conf >= theta) / (select n from nv) as mean_k from th
  union all select 'topk', k::double, (select sum(least(n, k)) from (select count(*) as n from pred group by video_id)) / (select n from nv) from ks)"""


@query(SEG + LEVEL_SQL + """, tg as (select count(*) / (select n from nv) as t from gt), gp as (select *, round(abs(mean_k - t), 9) as gap from lv, tg),
one as (select * from (select *, 0 as o from gp where kind = 'theta' order by gap, value desc limit 1) union all select * from (select *, 1 from gp where kind = 'topk' order by gap, value limit 1))
select kind, value, round(mean_k, 6) as mean_k from one where o = 0 or (select gap from one where o = 0) > 0.5 order by gap, o limit 1""")
def pick_level(spark, d):
    """The threshold, or the top-k, that keeps as many predictions an item as it has events on average."""
    _, g, p, v = parts(spark, d)
    lv = M.levels(p, v, THETAS, KS)
    target = g.count() / max(1, v.count())
    return rounded(S.pick_level(lv.where("kind = 'theta'"), lv.where("kind = 'topk'"), target))


COVER_SQL = """, ct as (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]::double[]) as theta), cg as (select theta, gt.event_id, coalesce(max(tiou), 0) as best from gt cross join ct left join pt on pt.gt_id = gt.event_id and pt.conf >= theta group by all),
cv as (select 'theta_' || theta as name, 100 * avg((best >= 0.3)::int::double) as r1, (select count(*) from pred where conf >= theta and video_id in (select video_id from gt)) / (select count(distinct video_id) from gt)::double as vectors from cg group by theta)"""


@query(SEG + COVER_SQL + "select name, round(r1, 6) as r1, round(vectors, 6) as vectors from cv where r1 > (select max(r1) from cv) - 5 order by vectors, r1 desc, name limit 1")
def pick_fill(spark, d):
    """The cheapest of several cuts whose coverage is within five points of the best."""
    _, g, p, _ = parts(spark, d)
    rows = M.cut_coverage(g, p, (0.1, 0.3, 0.5, 0.7, 0.9), (0.3,))
    return rounded(S.pick_fill(rows.select(F.col("method").alias("name"), F.col("cover").alias("r1"), F.col("per_item").alias("vectors")), 5.0))


CURVE_SQL = """, cu as (select level, 100 * avg((best >= level)::int::double) as value, count(*) as n from bt cross join (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]::double[]) as level) group by level)"""


def curve(spark, d, methods=None) -> DataFrame:
    """(method, level, n, value): share of events covered at each tIoU."""
    _, g, p, _ = parts(spark, d)
    rows = M.method_coverage(g, methods or {"pred": p}, (0.1, 0.3, 0.5, 0.7, 0.9))
    return rows.select("method", F.col("threshold").alias("level"), F.col("n_gt").alias("n"), F.col("cover").alias("value"))


@query(SEG + CURVE_SQL + """, tg as (select (select value from cu where level = 0.3) / 2 + (select value from cu where level = 0.5) / 2 as t), pc as (select *, lead(level) over (order by level) as l2, lead(value) over (order by level) as v2 from cu)
select round(level + (t - value) * (l2 - level) / nullif(v2 - value, 0), 6) as level from pc, tg where t between least(value, v2) and greatest(value, v2) order by level limit 1""")
def equivalent_tiou(spark, d):
    """The tIoU at which coverage is halfway between that at 0.3 and at 0.5."""
    c = curve(spark, d)
    target = c.where("level in (0.3, 0.5)").agg(F.sum(F.col("value") / 2)).first()[0]
    return rounded(S.equivalent_level(c, target))


@query(SEG + CURVE_SQL + """, un as (select video_id, dur * k / 3 as ts, dur * (k + 1) / 3 as te from vid cross join range(3) t(k)),
ub as (select gt.event_id, max(greatest(0, least(gt.te, un.te) - greatest(gt.ts, un.ts)) / ((gt.te - gt.ts) + (un.te - un.ts) - greatest(0, least(gt.te, un.te) - greatest(gt.ts, un.ts)))) as best from gt join un using (video_id) group by 1),
uc as (select level, avg((best >= level)::int::double) as q from ub cross join (select distinct level from cu) group by level),
ci as (select level, value / 100 - q - 1.96 * sqrt((value / 100 * (1 - value / 100) + q * (1 - q)) / n) as ci_low from cu join uc using (level))
select min(level) as level from ci c where not exists (select 1 from ci b where b.level >= c.level and b.ci_low <= 0)""")
def significant_down_to(spark, d):
    """The lowest tIoU down to which predictions cover more events than thirds of the items do, beyond chance."""
    _, _, p, v = parts(spark, d)
    c = curve(spark, d, {"pred": p.withColumn("pred_id", F.col("pred_id").cast("string")), **M.uniform_of(v, (3,))})
    wide = c.groupBy("level", "n").pivot("method", ["pred", "uniform_3"]).agg(F.first("value") / 100)
    se = F.sqrt((F.col("pred") * (1 - F.col("pred")) + F.col("uniform_3") * (1 - F.col("uniform_3"))) / F.col("n"))
    return S.significant_down_to(wide.select("level", (F.col("pred") - F.col("uniform_3") - 1.96 * se).alias("ci_low")))


@query(SEG + """, ks as (select unnest([1, 2, 4]) as k), rp as (select *, row_number() over (partition by video_id order by conf desc, event_id) as r from pred),
tb as (select k, gt.event_id, coalesce(max(tiou), 0) as best from gt cross join ks left join (select pt.*, r from pt join rp on rp.event_id = pt.pred_id) x on x.gt_id = gt.event_id and r <= k group by all),
un as (select k, video_id, dur * i / k as ts, dur * (i + 1) / k as te from vid cross join ks cross join range(4) t(i) where i < k),
ub as (select k, gt.event_id, max(greatest(0, least(gt.te, un.te) - greatest(gt.ts, un.ts)) / ((gt.te - gt.ts) + (un.te - un.ts) - greatest(0, least(gt.te, un.te) - greatest(gt.ts, un.ts)))) as best from gt join un using (video_id) group by all)
select 'top' as kind, k, round((select count(*) from rp where r <= k and video_id in (select video_id from gt)) / (select count(distinct video_id) from gt)::double, 6) as per_item, round(100 * avg((best >= 0.3)::int::double), 6) as cover from tb group by k
union all select 'uniform', k, k::double, round(100 * avg((best >= 0.3)::int::double), 6) from ub group by k""")
def budget_curve(spark, d):
    """Coverage by the most confident predictions and by equal parts, for each number of them."""
    _, g, p, v = parts(spark, d)
    return rounded(M.budget_curve(g, p, v, (1, 2, 4), 0.3))


# ---------------------------------------------------------------- keys in seconds, preparation


SECONDS = SEG + """, sv as (select video_id, dur / 100.0::double as dur from vid), se as (select event_id, video_id, event_type, greatest(0, ts / 128.0::double) as t0, least(te / 128.0::double, sv.dur) as t1, sv.dur as dur, ts / 128.0::double as ts, te / 128.0::double as te from gt join sv using (video_id)),
"""


def seconds(spark, d) -> tuple[DataFrame, DataFrame]:
    """Items and events in seconds; the events' times are such that many are ties between two hundredths."""
    _, g, _, v = parts(spark, d)
    return v.select("video_id", (F.col("dur") / 100.0).alias("dur")), g.select(F.col("gt_id").alias("caption_id"), "video_id", (F.col("ts") / 128.0).alias("ts"), (F.col("te") / 128.0).alias("te"), F.col("event_type").alias("sentence"))


KEPT = """ok as (select *, printf('%.3f', t0)::double as r0, printf('%.3f', t1)::double as r1 from se where t1 > t0 and t0 <= dur - 1) """


@query(SECONDS + KEPT + "select se.event_id as caption_id, se.video_id, event_type as sentence, se.ts as gt_ts, se.te as gt_te, coalesce(k.key, '') as gt_seg_key from se left join (select event_id, printf('%d__%.2f_%.2f', video_id, r0, r1) as key from ok) k using (event_id)")
def caption_keys(spark, d):
    """Queries with the key of their own clip."""
    v, e = seconds(spark, d)
    return Q.captions_of(e, v)


@query(SECONDS + KEPT + """, many as (select video_id, any_value(dur) as dur, count(*) as m from ok group by 1),
seg2 as (select 'global' as partition, video_id, 0.0::double as a, dur as b from sv union all select 'gt', video_id, r0, r1 from ok
  union all select 'uni_M_gt', video_id, printf('%.3f', 0.0::double + (dur - 0.0::double) * k / m)::double, printf('%.3f', 0.0::double + (dur - 0.0::double) * (k + 1) / m)::double from many cross join lateral (select unnest(range(m)) as k)),
ky as (select *, printf('%d__%.2f_%.2f', video_id, a, b) as key from seg2), done as (select distinct key from ky where partition = 'gt' and video_id % 2 = 0),
un as (select key, min(partition) as partition, count(*) as n from ky group by key)
select k.partition, count(*) as segments, count(distinct video_id) as videos, (select count(*) from un where un.partition = k.partition) as clips, (select count(*) from un where un.partition = k.partition and key not in (select key from done)) as todo from ky k group by k.partition""")
def prepare_work(spark, d):
    """Three partitions, their clips (each counted where its name comes first) and what is left to encode."""
    v, e = seconds(spark, d)
    parts_ = Q.build_partitions(v, e)
    done = Q.segment_table({"gt": parts_["gt"]}).where("video_id % 2 = 0")
    made = Q.prepare(v, e, done, e.select("caption_id"))
    clips = made["clips"].select("seg_key", F.element_at(F.split(F.col("refs")[0], "__"), 2).alias("partition"))
    todo = made["clips_todo"].select(F.regexp_replace("id", "__av$", "").alias("seg_key"), F.lit(1).alias("open"))
    first = made["rows"].groupBy("seg_key").agg(F.min("partition").alias("partition"))
    per = first.join(clips.select("seg_key"), "seg_key").join(todo, "seg_key", "left").groupBy("partition").agg(F.count("*").alias("clips"), F.count("open").alias("todo"))
    return made["rows"].groupBy("partition").agg(F.count("*").alias("segments"), F.count_distinct("video_id").alias("videos")).join(per, "partition", "left").na.fill(0)


# ---------------------------------------------------------------- positives, guards, decisions


@query(SEG + BEST + "select gt.event_id as gt_id, case when tiou >= 0.3 then pred_id end as pred_id from gt left join bm on gt_id = event_id")
def positives(spark, d):
    """The prediction that stands for an event in training: the best one if it overlaps enough, else none."""
    _, g, p, _ = parts(spark, d)
    return I.best_match(g, p).select("gt_id", F.when(F.col("tiou") >= 0.3, F.col("pred_id")).alias("pred_id"))


@query("with f as (select event_type as key, count(*)::double as found from events group by 1), e as (select key, found + case when key = 'error' then 5 else 0 end as expected from f union all select 'absent', 1.0::double) select key, expected, found, coalesce(abs(found - expected) <= 0.5, false) as ok from e left join f using (key)")
def regression_guard(spark, d):
    """Expected values against found ones; a missing key is not ok."""
    found = D.table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("double").alias("v"))
    wanted = found.withColumn("v", F.col("v") + F.when(F.col("key") == "error", 5.0).otherwise(0.0)).unionByName(spark.createDataFrame([("absent", 1.0)], "key string, v double"))
    return A.require(found, wanted, "key", "v", 0.5)


@query(SEG + "select (select count(*) from (select video_id, ts from gt except all select video_id, ts from pred)) as only_gt, (select count(*) from (select video_id, ts from pred except all select video_id, ts from gt)) as only_pred")
def multiset_difference(spark, d):
    _, g, p, _ = parts(spark, d)
    a, b = g.select("video_id", "ts"), p.select("video_id", "ts")
    return a.exceptAll(b).agg(F.count("*").alias("only_gt")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_pred")))


@query(SEG + "select theta, round(mean_k, 6) as mean_k, coalesce(mean_k < lag(mean_k) over (order by theta), true) as order_kept from (select theta, count(*)::double / (select count(*) from vid) as mean_k from (select unnest([0.2::double, 0.4, 0.6, 0.8]) as theta) join pred on conf >= theta group by 1)")
def decision_rules(spark, d):
    """Predicates over a result table: does the order hold from level to level."""
    _, _, p, v = parts(spark, d)
    n = v.count()
    t = F.broadcast(spark.createDataFrame([(x,) for x in (0.2, 0.4, 0.6, 0.8)], "theta double"))
    k = p.join(t, p.conf >= t.theta).groupBy("theta").agg((F.count("*") / n).alias("mean_k"))
    kept = F.coalesce(F.col("mean_k") < F.lag("mean_k").over(Window.orderBy("theta")), F.lit(True))
    return rounded(k.withColumn("order_kept", kept))


# ---------------------------------------------------------------- reports


def forced_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    s = D.forced(parts(spark, d)[0])
    return D.truths(s), D.predictions(s)


BLOCK = SEG + """, k as (select * from fpred where video_id in (select video_id from fgt)), fb as (select fgt.event_id as gt_id, coalesce(max(tiou), 0.0::double) as best from fgt left join fm on fm.gt_id = fgt.event_id group by 1),
c as (select (select count(*) from k)::double as np, (select count(*) from fgt)::double as ng, (select count(*) from fm where tiou >= 0.55)::double as m1, (select count(*) from fm where tiou >= 0.7)::double as m2, (select count(distinct video_id) from fgt) as nv)
"""


@query(BLOCK + """select round(np / nv, 6) as seg_per_video, round((select avg(best) from fb), 6) as mean_tiou, round((select avg((best >= 0.55)::int::double) from fb), 6) as cover_55, round((select avg((best >= 0.7)::int::double) from fb), 6) as cover_70,
round(m1 / np, 6) as p_55, round(m1 / ng, 6) as r_55, round(2 * m1 / (np + ng), 6) as f1_55, round(m2 / np, 6) as p_70, round(m2 / ng, 6) as r_70, round(2 * m2 / (np + ng), 6) as f1_70 from c""")
def loc_block(spark, d):
    """Block of localisation metrics where each match above one half is forced."""
    return rounded(E.loc_block(*forced_parts(spark, d), (0.55, 0.7)))


@query(SEG + ", x as (select pred_id, max(tiou) as m, sum((inter > 0 and inter >= 0.5 * (g1 - g0))::int)::bigint as c from pt group by 1) select pred_id, round(m, 6) as max_tiou, m <= 0 as fp_no_overlap, c as n_gt_covered, c >= 2 as merge from x")
def segment_flags(spark, d):
    _, g, p, _ = parts(spark, d)
    return E.segment_rows(g, p).select("pred_id", r6("max_tiou"), "fp_no_overlap", "n_gt_covered", "merge")


@query(SEG + """, x as (select fm.*, row_number() over (partition by gt_id order by tiou desc, p0, pred_id) as n from fm), bst as (select gt_id, pred_id, tiou, g0, g1, p0, p1 from x where n = 1),
ins as (select gt_id, count(*) as c from fm where least(g1, p1) - greatest(g0, p0) > 0 and least(g1, p1) - greatest(g0, p0) >= 0.5 * (p1 - p0) group by 1)
select event_id as gt_id, round(coalesce(bst.tiou, 0.0::double), 6) as best_tiou, coalesce(bst.tiou, 0) <= 0 as missed, coalesce(c, 0)::bigint as n_parts, case when bst.tiou >= 0.55 then bst.pred_id end as match_55, case when bst.tiou >= 0.55 then p0 - g0 end as left_offset, case when bst.tiou >= 0.55 then p1 - g1 end as right_offset
from fgt left join bst on bst.gt_id = event_id left join ins on ins.gt_id = event_id""")
def event_flags(spark, d):
    """Flags and matches of events where each match above one half is forced."""
    return E.event_rows(*forced_parts(spark, d), (0.55,), 0.55).select("gt_id", r6("best_tiou"), "missed", "n_parts", "match_55", "left_offset", "right_offset")


@query(SEG + """, sg as (select *, case when video_id % 2 = 0 then 'even' else 'odd' end as split from fgt), k as (select p.video_id, g.split from fpred p join (select distinct video_id, split from sg) g using (video_id)),
per as (select split, video_id, (select count(*) from k where k.video_id = v.video_id) as k from (select distinct split, video_id from sg) v),
sb as (select split, g.event_id, coalesce(max(tiou), 0.0::double) as best from sg g left join fm on gt_id = g.event_id group by all)
select split, count(*) as items, round(avg(k), 6) as k_mean, max(k) as k_max, sum((k > 16)::int)::bigint as k_many, round(2 * (select count(*) from fm join sg g on gt_id = g.event_id where tiou >= 0.55 and g.split = per.split)::double / (sum(k) + (select count(*) from sg g where g.split = per.split)), 6) as f1, round((select 100 * avg((best < 0.3)::int::double) from sb where sb.split = per.split), 6) as missed from per group by split""")
def detector_stats(spark, d):
    """Detector statistics by split, matches above one half being forced."""
    g, p = forced_parts(spark, d)
    rows = [E.detector_stats(g.where(F.col("video_id") % 2 == k), p, 0.55).select(F.lit(name).alias("split"), "items", "k_mean", "k_max", "k_many", "f1", "missed") for k, name in enumerate(("even", "odd"))]
    return rounded(rows[0].unionByName(rows[1]))


@query("with fr as (select label as video_id, vec_id as frame, embedding::double[] as emb from embeddings), cl as (select video_id, frame as clip, unnest([frame, frame, frame + 10, frame + 20]) as frame from fr where frame % 7 = 0), j as (select cl.video_id, clip, emb from cl join fr using (video_id, frame)), f as (select video_id, clip, unnest(emb) as x, generate_subscripts(emb, 1) as pos from j), m as (select video_id, clip, pos, avg(x) as x, count(*) as n from f group by all having count(*) = 4) select video_id, clip, round(sqrt(sum(x * x)) , 6) as length, round(max(case when pos = 1 then x end) / sqrt(sum(x * x)), 6) as first from m group by 1, 2")
def clip_vectors(spark, d):
    """Unit mean of a clip's frames; a frame may count twice."""
    e = D.table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame"), "embedding")
    clips = e.where("frame % 7 = 0").select("video_id", F.col("frame").alias("clip"), F.array("frame", "frame", F.col("frame") + 10, F.col("frame") + 20).alias("frames"))
    got = E.clip_vectors(clips, e.withColumnRenamed("embedding", "emb"))
    mean = clips.select("video_id", "clip", F.explode("frames").alias("frame")).join(e, ["video_id", "frame"]).select("video_id", "clip", F.posexplode("embedding").alias("pos", "x")).groupBy("video_id", "clip", "pos").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("video_id", "clip").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return got.join(mean, ["video_id", "clip"]).select("video_id", "clip", r6("length"), r6(F.col("emb")[0], "first"))
