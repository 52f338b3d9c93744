"""Watershed-level effect: control means, gaps, pre/post effect, bootstrap, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.operators import impact
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.tables import Tables

START = 1998
BY = ["idx"]


def series(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(treated, controls): unit 0 and all other units."""
    s = t.series.select("idx", "unit_id", F.col("y").alias("year"), F.col("v").alias("value"))
    return s.where("unit_id = 0").drop("unit_id"), s.where("unit_id <> 0")


CTL = "ctl as (select idx, y, avg(v) control from a_series where unit_id<>0 group by 1,2)"
GAP = f"{CTL}, gap as (select t.idx, t.y, t.v treated, c.control, t.v-c.control gap from a_series t join ctl c on t.idx=c.idx and t.y=c.y where t.unit_id=0)"


@query("control_mean", f"with {CTL} select idx, y as year, {q6('control')} control from ctl")
def control_mean(t: Tables) -> DataFrame:
    return impact.control_mean(series(t)[1], BY).withColumn("control", r6("control"))


@query("treated_control_gap", f"with {GAP} select idx, y as year, {q6('treated')} treated, {q6('control')} control, {q6('gap')} gap from gap")
def treated_control_gap(t: Tables) -> DataFrame:
    out = impact.treated_control_gap(*series(t), BY)
    return out.select("idx", "year", *[r6(c).alias(c) for c in ("treated", "control", "gap")])


EFFECT = f"""{GAP}, eff as (select idx, avg(case when y<{START} then gap end) pre, avg(case when y>={START} then gap end) post,
   string_agg(case when y<{START} then y end, ',' order by y) pre_years, string_agg(case when y>={START} then y end, ',' order by y) post_years from gap group by 1)"""


@query("pre_post_effect", f"with {EFFECT} select idx, {q6('pre')} pre_mean_gap, {q6('post')} post_mean_gap, {q6('post-pre')} effect, pre_years, post_years from eff")
def pre_post_effect(t: Tables) -> DataFrame:
    out = impact.pre_post_effect(impact.treated_control_gap(*series(t), BY), START, BY)
    numbers = [r6(c).alias(c) for c in ("pre_mean_gap", "post_mean_gap", "effect")]
    return out.select("idx", *numbers, *[F.array_join(c, ",").alias(c) for c in ("pre_years", "post_years")])


_ALPHA = (1.0 - C.BOOTSTRAP_CI) / 2.0
BOOT = f"""{EFFECT}, units as (select unit_id, row_number() over (order by unit_id)-1 k from (select distinct unit_id from a_series where unit_id<>0)),
   n as (select count(*) n from units),
   wts as (select b, ('0x'||substr(md5('42-'||b||'-'||k),1,8))::BIGINT % n.n k, count(*) w from units, n, range(0,{C.BOOTSTRAP_DRAWS}) d(b) group by 1,2),
   mean as (select s.idx, b, s.y, sum(w*v)/sum(w) control from wts join units using (k) join a_series s using (unit_id) group by 1,2,3),
   e as (select m.idx, b, avg(case when m.y>={START} then t.v-control end)-avg(case when m.y<{START} then t.v-control end) effect from mean m join a_series t on t.unit_id=0 and t.idx=m.idx and t.y=m.y group by 1,2),
   srt as (select idx, list(effect order by effect) l, count(*) m from e where effect is not null group by 1)"""


@query(
    "bootstrap_effect",
    f"""with {BOOT} select eff.idx, {q6('post-pre')} effect, {q6(f'l[cast(floor({_ALPHA!r}e0*m) as int)+1]')} ci_low,
    {q6(f'l[greatest(cast(floor({1 - _ALPHA!r}e0*m) as int)-1, cast(floor({_ALPHA!r}e0*m) as int))+1]')} ci_high, {C.BOOTSTRAP_DRAWS} n_bootstrap, n.n n_control_polygons, '' note
   from eff join srt using (idx), n""",
)
def bootstrap_effect(t: Tables) -> DataFrame:
    out = impact.bootstrap_did(*series(t), START, by=BY)
    numbers = [r6(c).alias(c) for c in ("effect", "ci_low", "ci_high")]
    return out.select("idx", *numbers, "n_bootstrap", "n_control_polygons", F.coalesce("note", F.lit("")).alias("note"))


@query(
    "effect_series",
    f"""with {CTL}, yrs as (select distinct idx, y from a_series union select idx, 2002 from a_series), rain as (select year(l_shipdate) y, avg(mm) mm from (select l_suppkey, l_shipdate, sum(l_quantity) mm from lineitem where month(l_shipdate) between 6 and 9 group by 1,2) group by 1)
   select yrs.idx, yrs.y as year, {q6('t.v')} treated, {q6('c.control')} control, {q6('r.mm')} rainfall_mm from yrs left join a_series t on t.unit_id=0 and t.idx=yrs.idx and t.y=yrs.y left join ctl c on c.idx=yrs.idx and c.y=yrs.y left join rain r on r.y=yrs.y""",
)
def effect_series(t: Tables) -> DataFrame:
    treated, controls = series(t)
    seen = t.series.select("idx", F.col("y").alias("year")).distinct()
    years = seen.unionByName(seen.select("idx", F.lit(2002).alias("year")).distinct())
    daily = t.base("lineitem").where(F.month("l_shipdate").between(6, 9)).groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").alias("mm"))
    rain = daily.groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("mm").alias("rainfall_mm"))
    out = impact.effect_series(treated, controls, rain, years, BY)
    return out.select("idx", "year", *[r6(c).alias(c) for c in ("treated", "control", "rainfall_mm")])

