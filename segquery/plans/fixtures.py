"""Views over the driver's tables that carry the domain: vectors, segments, texts; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segquery.functions import exprs as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectors


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector is a query; the others are segments of the item named by their label."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 10 <> 0")
    return e.select(F.col("vec_id").alias("seg_row"), F.col("label").alias("video_id"), F.col("vec_id").cast("double").alias("ts"), (F.col("vec_id") + 1).cast("double").alias("te"), F.col("embedding").alias("emb"))


def vec_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("positive"), (F.col("vec_id") - 1).cast("double").alias("gt_ts"), (F.col("vec_id") + 0.5).cast("double").alias("gt_te"), F.col("embedding").alias("q_emb"))


def conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gallery(spark, sf_dir).select("seg_row", ((F.col("seg_row") * 7919 % 1000 + 1) / 1001.0).alias("conf"))


VEC = """
with gal as (select vec_id as seg_row, label as video_id, vec_id::double as ts, (vec_id + 1)::double as te, embedding::double[] as emb, ((vec_id * 7919) % 1000 + 1) / 1001.0::double as conf
             from embeddings where vec_id % 10 <> 0),
q as (select vec_id as query_id, label as positive, (vec_id - 1)::double as gt_ts, vec_id + 0.5::double as gt_te, embedding::double[] as q_emb from embeddings where vec_id % 10 = 0),
pr as (select query_id, positive, gt_ts, gt_te, seg_row, video_id, ts, te, conf, list_dot_product(q_emb, emb) as score from q cross join gal),
ms as (select query_id, video_id, max(score) as score from pr group by all),
rk as (select a.query_id, a.positive as video_id, 1 + (select count(*) from ms b where b.query_id = a.query_id and b.score > (select score from ms c where c.query_id = a.query_id and c.video_id = a.positive)) as rank from q a)
"""

# ---------------------------------------------------------------- segments


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User sessions as items; events as segments of centiseconds, some true, some predicted."""
    e = table(spark, sf_dir, "events")
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", us.alias("us"))
    by = Window.partitionBy("video_id")
    d = F.col("us") - F.min("us").over(by)
    e = e.withColumn("ts", F.floor(d / F.lit(1e7)).cast("long"))
    e = e.withColumn("te", (F.col("ts") + F.floor(F.col("value") * 50) + 100).cast("long"))
    role = F.when(F.col("event_type").isin("purchase", "signup"), "gt").otherwise("pred")
    e = e.withColumn("role", role).withColumn("conf", (F.col("event_id") * 7919 % 1000 + 1) / F.lit(1001.0))
    return e.withColumn("dur", F.max("te").over(by)).drop("us")


def truths(seg: DataFrame) -> DataFrame:
    return seg.where("role = 'gt'").withColumnRenamed("event_id", "gt_id")


def predictions(seg: DataFrame) -> DataFrame:
    return seg.where("role = 'pred'").withColumnRenamed("event_id", "pred_id")


def videos(seg: DataFrame) -> DataFrame:
    return seg.groupBy("video_id").agg(F.max("te").alias("dur"))


def forced(seg: DataFrame) -> DataFrame:
    """Segments of a role that start behind all earlier ones: pairwise disjoint, so matches above one half are forced."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id", "role").orderBy("ts", "te", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return seg.withColumn("_b", F.max("te").over(w)).where("_b is null or ts >= _b").drop("_b")


SEG = """
with b as (select user_id as video_id, event_id, event_type, value, epoch_us(ts) as us from events),
m as (select *, us - min(us) over (partition by video_id) as d from b),
g as (select video_id, event_id, event_type, value, floor(d / 1e7)::bigint as ts, (floor(d / 1e7) + floor(value * 50) + 100)::bigint as te,
             case when event_type in ('purchase', 'signup') then 'gt' else 'pred' end as role, ((event_id * 7919) % 1000 + 1) / 1001.0::double as conf from m),
seg as (select *, max(te) over (partition by video_id) as dur from g),
gt as (select * from seg where role = 'gt'),
pred as (select * from seg where role = 'pred'),
vid as (select video_id, max(te) as dur from seg group by video_id),
pp as (select gt.video_id, gt.event_id as gt_id, pred.event_id as pred_id, gt.ts as g0, gt.te as g1, pred.ts as p0, pred.te as p1, pred.conf,
              greatest(0, least(gt.te, pred.te) - greatest(gt.ts, pred.ts))::double as inter from gt join pred using (video_id)),
pt as (select *, inter / ((g1 - g0) + (p1 - p0) - inter) as tiou from pp),
bt as (select gt.video_id, gt.event_id as gt_id, coalesce(max(tiou), 0.0::double) as best from gt left join pt on pt.gt_id = gt.event_id group by all),
dis as (select * from (select *, max(te) over (partition by video_id, role order by ts, te, event_id rows between unbounded preceding and 1 preceding) as prev from seg) where prev is null or ts >= prev),
fgt as (select * from dis where role = 'gt'),
fpred as (select * from dis where role = 'pred'),
fm as (select a.video_id, a.event_id as gt_id, c.event_id as pred_id, a.ts as g0, a.te as g1, c.ts as p0, c.te as p1, c.conf,
              greatest(0, least(a.te, c.te) - greatest(a.ts, c.ts))::double / ((a.te - a.ts) + (c.te - c.ts) - greatest(0, least(a.te, c.te) - greatest(a.ts, c.ts))) as tiou
       from fgt a join fpred c using (video_id))
"""


def u_sql(seed: object, key: str, i: str = "0") -> str:
    """The hashed uniform as SQL."""
    return f"(('0x' || substr(md5(concat_ws('#', '{seed}', ({key})::varchar, ({i})::varchar)), 1, 8))::bigint / 4294967296.0::double)"


def normal_sql(seed: object, key: str, i: int = 0) -> str:
    return f"(sqrt(-2 * ln(greatest({u_sql(seed, key, str(2 * i))}, 1e-12::double))) * cos(6.283185307179586::double * {u_sql(seed, key, str(2 * i + 1))}))"


__all__ = ["SEG", "VEC", "X", "conf", "forced", "gallery", "normal_sql", "predictions", "segments", "table", "truths", "u_sql", "vec_queries", "videos"]
