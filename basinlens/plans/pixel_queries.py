"""Pixel tables: masks, indices, composites, zonal statistics, rainfall, point effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.functions import pixels, seasons
from basinlens.operators import raster, scoring
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.spatial_queries import ZONES, zones
from basinlens.plans.tables import Tables

WINDOWS = {"before": ("1995-11-01", "1998-03-01"), "after": ("1998-11-01", "2001-03-01")}
INDICES = ["ndvi", "mndwi", "ndmi"]


def nd(a: str, b: str) -> str:
    ra, rb = f"({a}*0.0000275e0-0.2e0)", f"({b}*0.0000275e0-0.2e0)"
    return f"(({ra}-{rb})/({ra}+{rb}))"


CLEAR = f"""clr as (select pixel_id, ts, {nd('b5', 'b4')} ndvi, {nd('b3', 'b6')} mndwi, {nd('b5', 'b6')} ndmi from a_obs where qa&8=0 and qa&16=0)"""
COMP = f"""{CLEAR}, tag as (select *, 'before' win from clr where ts>=date '1995-11-01' and ts<date '1998-03-01' union all select *, 'after' from clr where ts>=date '1998-11-01' and ts<date '2001-03-01'),
   comp as (select pixel_id, win, median(ndvi) ndvi, median(mndwi) mndwi, median(ndmi) ndmi, count(*) clear_obs from tag group by 1,2)"""


def composites(t: Tables) -> DataFrame:
    return raster.windowed_composites(t.obs, WINDOWS)


@query(
    "pixel_indices",
    f"with {CLEAR} select pixel_id, ts, {q6('ndvi')} ndvi, {q6('mndwi')} mndwi, {q6('ndmi')} ndmi from clr",
)
def pixel_indices(t: Tables) -> DataFrame:
    out = raster.clear_indices(t.obs)
    return out.select("pixel_id", "ts", *[r6(i).alias(i) for i in INDICES])


@query(
    "reflectance_mask",
    "select pixel_id, ts, b4, qa, round(b4*0.0000275e0-0.2e0,8)+0.0 red, qa&24=0 clear from a_obs",
)
def reflectance_mask(t: Tables) -> DataFrame:
    return t.obs.select("pixel_id", "ts", "b4", "qa", F.round(pixels.reflectance("b4"), 8).alias("red"), pixels.is_clear("qa").alias("clear"))


@query("pct_change", f"select l_orderkey, l_linenumber, case when l_discount=0 then null else {q6('(l_tax-l_discount)/l_discount*100e0')} end pct from lineitem")
def pct_change(t: Tables) -> DataFrame:
    return t.base("lineitem").select("l_orderkey", "l_linenumber", r6(pixels.pct_change("l_discount", "l_tax")).alias("pct"))


@query(
    "season_labels",
    """select o_orderkey, y season, cast(make_date(y,11,1) as date) start, last_day(make_date(y+1,2,1)) "end" from
   (select o_orderkey, case when month(o_orderdate)>=11 then year(o_orderdate) when month(o_orderdate)<=2 then year(o_orderdate)-1 end y from orders) where y is not null""",
)
def season_labels(t: Tables) -> DataFrame:
    """Dates labelled directly, with the window of their season."""
    season = F.col("season")
    labelled = t.base("orders").select("o_orderkey", seasons.season_label("o_orderdate").alias("season")).where("season is not null")
    return labelled.select("o_orderkey", "season", seasons.season_start(season).alias("start"), seasons.season_end(season).alias("end"))


@query(
    "median_composite",
    f"with {COMP} select pixel_id, win as \"window\", {q6('ndvi')} ndvi, {q6('mndwi')} mndwi, {q6('ndmi')} ndmi, clear_obs from comp",
)
def median_composite(t: Tables) -> DataFrame:
    return composites(t).select("pixel_id", "window", *[r6(i).alias(i) for i in INDICES], "clear_obs")


@query(
    "composite_change",
    f"""with {COMP} select b.pixel_id, {q6('a.ndvi-b.ndvi')} ndvi_change, {q6('a.mndwi-b.mndwi')} mndwi_change, {q6('a.ndmi-b.ndmi')} ndmi_change,
   b.mndwi>0 water_before, a.mndwi>0 water_after from comp b join comp a on a.pixel_id=b.pixel_id and b.win='before' and a.win='after'""",
)
def composite_change(t: Tables) -> DataFrame:
    out = raster.composite_change(composites(t))
    changes = [r6(f"{i}_change").alias(f"{i}_change") for i in INDICES]
    return out.select("pixel_id", *changes, "water_before", "water_after")


MEMBER = "mem as (select pixel_id, concat('Z', cast(floor(r/4) as bigint)) zone from a_grid)"


def bands_of_rows(t: Tables) -> DataFrame:
    """Zones made of four raster rows each."""
    return t.grid.select("pixel_id", F.concat(F.lit("Z"), F.floor(F.col("r") / 4)).alias("zone"))


@query(
    "zonal_mean",
    f"with {COMP}, {MEMBER} select zone, win as \"window\", {q6('avg(ndvi)')} ndvi, {q6('avg(mndwi)')} mndwi, {q6('avg(ndmi)')} ndmi, count(*) pixels from comp join mem using (pixel_id) group by 1,2",
)
def zonal_mean(t: Tables) -> DataFrame:
    out = raster.zonal_stats(composites(t), bands_of_rows(t), ["zone", "window"])
    return out.select("zone", "window", *[r6(i).alias(i) for i in INDICES], "pixels")


@query("clear_observations", f"with {COMP}, {MEMBER} select zone, win as \"window\", {q6('avg(clear_obs)')} clear_obs from comp join mem using (pixel_id) group by 1,2")
def clear_observations(t: Tables) -> DataFrame:
    out = raster.zonal_stats(composites(t), bands_of_rows(t), ["zone", "window"])
    return out.select("zone", "window", r6("clear_obs").alias("clear_obs"))


@query("water_fraction", f"with {COMP}, {MEMBER} select zone, win as \"window\", {q6('avg(case when mndwi>0 then 1e0 else 0e0 end)')} water_fraction from comp join mem using (pixel_id) group by 1,2")
def water_fraction(t: Tables) -> DataFrame:
    out = raster.zonal_stats(composites(t), bands_of_rows(t), ["zone", "window"])
    return out.select("zone", "window", r6("water_fraction").alias("water_fraction"))


@query(
    "annual_series",
    f"""with {CLEAR}, {MEMBER}, lab as (select *, case when month(ts)>=11 then year(ts) when month(ts)<=2 then year(ts)-1 end y from clr),
   comp as (select pixel_id, y, median(ndvi) ndvi, median(mndwi) mndwi from lab where y is not null and cast(ts as date)<>last_day(make_date(y+1,2,1)) group by 1,2)
   select zone, cast(y as int) as year, {q6('avg(ndvi)')} ndvi, {q6('avg(mndwi)')} mndwi, count(*) pixels from comp join mem using (pixel_id) group by 1,2""",
)
def annual_series(t: Tables) -> DataFrame:
    out = raster.annual_series(t.obs, bands_of_rows(t), "zone")
    return out.select("zone", "year", r6("ndvi").alias("ndvi"), r6("mndwi").alias("mndwi"), "pixels")


@query(
    "seasonal_rainfall",
    f"with c as (select cell_id, sum(mm) mm from a_rain where day>=date '2024-01-05' and day<date '2024-01-25' group by 1) select zone_id, {q6('avg(mm)')} rain_mm from c join a_cells using (cell_id) group by 1",
)
def seasonal_rainfall(t: Tables) -> DataFrame:
    window = raster.in_window("2024-01-05", "2024-01-25", "day")
    return raster.seasonal_rainfall(t.rain, t.cells, "zone_id", window).withColumn("rain_mm", r6("rain_mm"))


@query(
    "monsoon_rainfall",
    f"""with r as (select l_suppkey cell_id, year(l_shipdate) y, sum(l_quantity) mm from lineitem where month(l_shipdate)*100+day(l_shipdate)>=601 and month(l_shipdate)*100+day(l_shipdate)<930 group by 1,2)
   select cell_id%7 zone_id, cast(y as int) as year, {q6('avg(mm)')} rain_mm from r group by 1,2""",
)
def monsoon_rainfall(t: Tables) -> DataFrame:
    rain = t.base("lineitem").select(F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("mm"))
    cells = t.base("supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_suppkey") % 7).alias("zone_id"))
    return raster.monsoon_rainfall(rain, cells, "zone_id").withColumn("rain_mm", r6("rain_mm"))


PDID = f"""{COMP}, {ZONES}, zs as (select lon, lat, zone, win, avg(ndvi) ndvi, avg(mndwi) mndwi, avg(ndmi) ndmi, avg(clear_obs) clear_obs, avg(case when mndwi>0 then 1e0 else 0e0 end) water_fraction
     from zones join comp using (pixel_id) group by 1,2,3,4),
   w as (select lon, lat, {', '.join(f"coalesce(max(case when zone='{z}' and win='{w}' then {i} end),0) {i}_{z[0]}{w[0]}" for i in ('ndvi', 'mndwi', 'ndmi', 'water_fraction', 'clear_obs') for z in ('treated', 'control') for w in ('before', 'after'))} from zs group by 1,2),
   did as (select lon, lat, {', '.join(f"({i}_ta-{i}_tb)-({i}_ca-{i}_cb) did_{i}" for i in ('ndvi', 'mndwi', 'ndmi', 'water_fraction'))}, least(clear_obs_tb,clear_obs_ta,clear_obs_cb,clear_obs_ca) min_clear_obs from w)"""


def site_effects(t: Tables) -> DataFrame:
    """Effects per record; records on one spot share their zones."""
    membership, members = zones(t)
    stats = raster.zonal_stats(composites(t), membership, ["place_id", "zone", "window"])
    return members.join(raster.point_did(stats, "place_id"), "place_id").drop("place_id")


@query(
    "point_did",
    f"""with {PDID} select record_id, {', '.join(q6('did_' + i) + ' did_' + i for i in ('ndvi', 'mndwi', 'ndmi', 'water_fraction'))}, {q6('min_clear_obs')} min_clear_obs, min_clear_obs<3 low_confidence
   from a_records join did using (lon, lat)""",
)
def point_did(t: Tables) -> DataFrame:
    names = ["did_ndvi", "did_mndwi", "did_ndmi", "did_water_fraction", "min_clear_obs"]
    return site_effects(t).select("record_id", *[r6(n).alias(n) for n in names], "low_confidence")


@query(
    "site_satellite_scores",
    f"""with {PDID}, v as (select record_id, category, case when category in ('PT','NC','SM') then did_water_fraction when category='BN' then (did_ndvi+did_ndmi)/2 else did_ndvi end v,
     case when category in ('PT','NC','SM') then 0.15e0 else 0.08e0 end strong, case when category in ('PT','NC','SM') then 0.05e0 else 0.02e0 end weak from a_records join did using (lon, lat))
   select record_id, category, case when category in ('LS','LH','OM') then 15 when v>=strong then 30 when v>=weak then 18 when v<=-weak then 0 else 10 end satellite_score from v""",
)
def site_satellite_scores(t: Tables) -> DataFrame:
    """From pixels to scores: composites, zones, effects, class and points."""
    joined = site_effects(t).join(t.records.select("record_id", "category"), "record_id")
    return scoring.satellite_score(joined).select("record_id", "category", "satellite_score")
