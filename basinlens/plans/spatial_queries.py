"""Polygons, zones, candidate ranking and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.operators import ranking, raster, spatial
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.tables import Tables
from basinlens.session import scratch_path
from basinlens.sources import files

CELL = 1 / 64  # degrees; about the size of a parcel


def crossing(lon: str = "lon", lat: str = "lat") -> str:
    side = f"((x2-x1)*({lat}-y1)-({lon}-x1)*(y2-y1))"
    return f"""(sum(case when (y1>{lat})<>(y2>{lat}) and case when y2>y1 then {side}>0 else {side}<0 end then 1 else 0 end)%2=1
     and max(case when {side}=0 and {lon} between least(x1,x2) and greatest(x1,x2) and {lat} between least(y1,y2) and greatest(y1,y2) then 1 else 0 end)=0)"""


@query("polygon_boxes", "select polygon_id, min(x1) xmin, min(y1) ymin, max(x1) xmax, max(y1) ymax from a_parcel_edges group by 1")
def polygon_boxes(t: Tables) -> DataFrame:
    return spatial.polygon_boxes(t.parcel_edges)


AREA = """(select polygon_id, abs(sum((x1-xmin)*(y2-ymin)-(x2-xmin)*(y1-ymin)))*110574e0*111320e0/2/10000*cos(radians((max(ymin)+max(ymax))/2)) area_ha
  from a_parcel_edges join (select polygon_id, min(x1) xmin, min(y1) ymin, max(y1) ymax from a_parcel_edges group by 1) b using (polygon_id) group by 1)"""


@query("polygon_area", f"select polygon_id, {q6('area_ha')} area_ha from {AREA}")
def polygon_area(t: Tables) -> DataFrame:
    return spatial.polygon_area_ha(t.parcel_edges).withColumn("area_ha", r6("area_ha"))


@query(
    "box_scan",
    """select record_id, mws_id from a_records where lon-0.001e0<=92.3e0 and lon+0.001e0>=92.1e0 and lat-0.001e0<=26.2e0 and lat+0.001e0>=26.05e0""",
)
def box_scan(t: Tables) -> DataFrame:
    """Write boxes as plain columns, then scan with a window that Parquet can prune by."""
    path = scratch_path(t.spark, "boxes")
    e = 0.001
    boxed = t.records.select(
        "record_id", "mws_id", (F.col("lon") - e).alias("xmin"), (F.col("lat") - e).alias("ymin"),
        (F.col("lon") + e).alias("xmax"), (F.col("lat") + e).alias("ymax"),
    )
    # clustering by place gives each row group a narrow box
    boxed.repartitionByRange("xmin", "ymin").sortWithinPartitions("xmin", "ymin").write.parquet(path)
    return files.scan_box(t.spark, path, (92.1, 26.05, 92.3, 26.2), ["record_id", "mws_id"])


_SEG_D2 = """least({0}, {1}, {2}, {3})"""


def _pt_seg(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"greatest(0e0, least(1e0, (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}))))"
    return f"(pow({px}-({ax}+{t}*({bx}-{ax})),2)+pow({py}-({ay}+{t}*({by}-{ay})),2))"


def _orient(a: str, b: str, c: str) -> str:
    return f"sign(({b[0]}-{a[0]})*({c[1]}-{a[1]})-({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


_A1, _A2, _B1, _B2 = ("a.x1", "a.y1"), ("a.x2", "a.y2"), ("b.x1", "b.y1"), ("b.x2", "b.y2")
TOUCH = f"""(greatest(a.x1,a.x2)>=least(b.x1,b.x2) and greatest(b.x1,b.x2)>=least(a.x1,a.x2) and greatest(a.y1,a.y2)>=least(b.y1,b.y2) and greatest(b.y1,b.y2)>=least(a.y1,a.y2)
  and {_orient(_A1, _A2, _B1)}*{_orient(_A1, _A2, _B2)}<=0 and {_orient(_B1, _B2, _A1)}*{_orient(_B1, _B2, _A2)}<=0)"""
_NEAR2 = _SEG_D2.format(
    _pt_seg(*_A1, *_B1, *_B2), _pt_seg(*_A2, *_B1, *_B2), _pt_seg(*_B1, *_A1, *_A2), _pt_seg(*_B2, *_A1, *_A2)
)


@query(
    "polygon_neighbours",
    f"""select distinct a.polygon_id left_id, b.polygon_id right_id from a_parcel_edges a join a_parcel_edges b on a.polygon_id<>b.polygon_id
   where {TOUCH} or {_NEAR2} <= 0.01e0*0.01e0""",
)
def polygon_neighbours(t: Tables) -> DataFrame:
    return spatial.neighbours(t.parcel_edges, 0.01, CELL)


_ANCHOR = "(select polygon_id, min(x1) ax, arg_min(y1, x1*1000+y1) ay from a_parcel_edges group by 1)"


@query(
    "polygons_in_region",
    f"""with touch as (select distinct a.polygon_id left_id, b.mws_id right_id from a_parcel_edges a join a_edges b on {TOUCH}),
   ins as (select p.polygon_id left_id, e.mws_id right_id from {_ANCHOR} p, a_edges e group by 1,2 having {crossing('any_value(ax)', 'any_value(ay)').replace('any_value(ax)', 'ax').replace('any_value(ay)', 'ay')}),
   rev as (select e.polygon_id left_id, p.mws_id right_id from (select mws_id, x0 ax, y0 ay from a_mws) p, a_parcel_edges e group by 1,2 having {crossing('ax', 'ay')})
   select * from touch union select * from ins union select * from rev""",
)
def polygons_in_region(t: Tables) -> DataFrame:
    regions = t.edges.withColumnRenamed("mws_id", "polygon_id")
    return spatial.polygons_meeting(t.parcel_edges, regions, CELL)


STEP = 1 / 32  # degrees; strips in which sides meet


def _heights(alias: str) -> str:
    """Height of a side at both ends of the common stretch lo..hi."""
    line = "({0}.y1+({1}-{0}.x1)*(({0}.y2-{0}.y1)/({0}.x2-{0}.x1)))"
    return f"{line.format(alias, 'greatest(least(a.x1,a.x2),least(b.x1,b.x2))')} {alias}1, {line.format(alias, 'least(greatest(a.x1,a.x2),greatest(b.x1,b.x2))')} {alias}2"


@query(
    "largest_overlap",
    f"""with prs as (select a.polygon_id, b.mws_id, sign(a.x1-a.x2)*sign(b.x1-b.x2) s, least(greatest(a.x1,a.x2),greatest(b.x1,b.x2))-greatest(least(a.x1,a.x2),least(b.x1,b.x2)) w,
     {_heights('a')}, {_heights('b')} from a_parcel_edges a join a_edges b on a.x1<>a.x2 and b.x1<>b.x2 and least(greatest(a.x1,a.x2),greatest(b.x1,b.x2))>greatest(least(a.x1,a.x2),least(b.x1,b.x2))),
   summed as (select polygon_id, mws_id, sum(s*w*((a1+a2+b1+b2)/4-case when (a1-b1)*(a2-b2)>=0 then abs(a1-b1+a2-b2)/4 else (pow(a1-b1,2)+pow(a2-b2,2))/(4*(abs(a1-b1)+abs(a2-b2))) end)) area from prs group by 1,2),
   own as (select polygon_id, abs(sum(x1*y2-x2*y1))/2 own from a_parcel_edges group by 1),
   n as (select polygon_id, mws_id, pos, area/own share from summed join own using (polygon_id) join a_mws using (mws_id) where area/own > 1e-9),
   best as (select *, row_number() over (partition by polygon_id order by round(share, 9) desc, pos) rn from n)
   select p.polygon_id candidate_id, b.mws_id region_id, {q6('coalesce(b.share, 0)')} shared_share from a_parcels p left join best b on p.polygon_id=b.polygon_id and rn=1""",
)
def largest_overlap(t: Tables) -> DataFrame:
    regions = t.edges.withColumnRenamed("mws_id", "polygon_id")
    order = t.mws.select(F.col("mws_id").alias("polygon_id"), "pos")
    return spatial.assign_largest_overlap(t.parcel_edges, regions, order, STEP, CELL).withColumn("shared_share", r6("shared_share"))


@query(
    "dissolved_outline",
    """with e as (select concat('G', cast(floor(pos/5e0) as int)) group_id, case when x1<x2 or x1=x2 and y1<=y2 then [x1,y1,x2,y2] else [x2,y2,x1,y1] end s from a_edges join a_mws using (mws_id))
   select group_id, s[1] x1, s[2] y1, s[3] x2, s[4] y2 from e group by 1, s having count(*)=1""",
)
def dissolved_outline(t: Tables) -> DataFrame:
    groups = t.mws.select(F.concat(F.lit("G"), F.floor(F.col("pos") / 5)).alias("group_id"), "mws_id")
    return spatial.dissolve_outline(t.edges, groups, "mws_id")


@query(
    "pixels_in_parcels",
    f"select p.pixel_id, e.polygon_id from a_grid p, a_parcel_edges e group by 1,2,lon,lat having {crossing()}",
)
def pixels_in_parcels(t: Tables) -> DataFrame:
    return spatial.points_in_polygons(t.grid.select("pixel_id", "lon", "lat"), t.parcel_edges, CELL).select("pixel_id", "polygon_id")


# --- distance zones ---------------------------------------------------------------------------

_HAV = "2*6371000.0e0*asin(sqrt(pow(sin((radians(p.lat)-radians(a.lat))/2),2)+cos(radians(a.lat))*cos(radians(p.lat))*pow(sin((radians(p.lon)-radians(a.lon))/2),2)))"
ZONES = f"""places as (select distinct lon, lat from a_records), prs as (select a.lon, a.lat, p.pixel_id, {_HAV} d from places a, a_grid p where {_HAV} <= 1000),
   taken as (select distinct pixel_id from prs where d<=200),
   zones as (select lon, lat, pixel_id, 'treated' zone from prs where d<=200 union all
     select lon, lat, pixel_id, 'control' from prs where d>=350 and pixel_id not in (select pixel_id from taken))"""


def zones(t: Tables) -> tuple[DataFrame, DataFrame]:
    places, members = spatial.distinct_places(t.records.select("record_id", "lon", "lat"), "record_id")
    return spatial.build_zones(places, t.grid.select("pixel_id", "lon", "lat")), members


@query(
    "distance_zones",
    f"""with {ZONES}, z as (select lon, lat, count(case when zone='treated' then 1 end) treated_pixels, count(case when zone='control' then 1 end) control_pixels from zones group by 1,2)
   select record_id, treated_pixels, control_pixels from a_records join z using (lon, lat)""",
)
def distance_zones(t: Tables) -> DataFrame:
    membership, members = zones(t)
    counts = membership.groupBy("place_id").agg(
        F.count_if(F.col("zone") == "treated").alias("treated_pixels"),
        F.count_if(F.col("zone") == "control").alias("control_pixels"),
    )
    return members.join(counts, "place_id").select("record_id", "treated_pixels", "control_pixels")


# --- candidates ---------------------------------------------------------------------------------

DX, DY, LAT = 1 / 512, 1 / 512, 26.0


def _sql_slope() -> str:
    import math

    dx = DX * 111_320.0 * math.cos(math.radians(LAT))
    dy = DY * 110_574.0

    def grad(along: str, across: str, size: float) -> str:
        w = f"over (partition by {across} order by {along})"
        return f"""case when coalesce(lag({along}) {w}={along}-1, false) and coalesce(lead({along}) {w}={along}+1, false) then (lead(zz) {w}-lag(zz) {w})/(2*{size!r}e0)
         when coalesce(lead({along}) {w}={along}+1, false) then (lead(zz) {w}-zz)/{size!r}e0 when coalesce(lag({along}) {w}={along}-1, false) then (zz-lag(zz) {w})/{size!r}e0 end"""

    return f"""(select pixel_id, degrees(atan(sqrt(dx*dx+dy*dy))) slope_deg from (select pixel_id, {grad('c', 'r', dx)} dx, {grad('r', 'c', dy)} dy
      from (select *, case when z>=-1000 then z end zz from a_grid)))"""


SLOPE = _sql_slope()


@query("terrain_slope", f"select pixel_id, {q6('slope_deg')} slope_deg from {SLOPE}")
def terrain_slope(t: Tables) -> DataFrame:
    return raster.slope_degrees(t.grid, DX, DY, LAT).select("pixel_id", r6("slope_deg").alias("slope_deg"))


LABELS = f"""hits as (select p.pixel_id, p.lc, e.polygon_id from a_grid p, a_parcel_edges e group by 1,2,3,lon,lat having {crossing()}),
   lab as (select pixel_id, lc, arg_max(polygon_id, pos) polygon_id from hits join a_parcels using (polygon_id) group by 1,2),
   shares as (select p.polygon_id, p.pos, count(l.pixel_id) pixel_count, coalesce(avg(case when lc=40 then 1e0 when lc is not null then 0e0 end),0) crop_share, coalesce(avg(case when lc=50 then 1e0 when lc is not null then 0e0 end),0) built_up_share,
     coalesce(avg(case when lc=80 then 1e0 when lc is not null then 0e0 end),0) water_share, coalesce(avg(case when lc=10 then 1e0 when lc is not null then 0e0 end),0) tree_share
     from a_parcels p left join lab l using (polygon_id) group by 1,2)"""


def labelled(t: Tables) -> DataFrame:
    return raster.label_pixels(t.grid.select("pixel_id", "lon", "lat", "lc"), t.parcel_edges, t.parcels, CELL)


@query("class_shares", f"with {LABELS} select polygon_id, pixel_count, {', '.join(q6(c + '_share') + ' ' + c + '_share' for c in ('crop', 'built_up', 'water', 'tree'))} from shares")
def class_shares(t: Tables) -> DataFrame:
    out = raster.class_shares(labelled(t), t.parcels)
    names = ["crop_share", "built_up_share", "water_share", "tree_share"]
    return out.select("polygon_id", "pixel_count", *[r6(n).alias(n) for n in names])


def candidates(t: Tables) -> DataFrame:
    """Metrics of every parcel: area, class shares, mean slope, district."""
    label = labelled(t)
    slope = raster.mean_slope(raster.slope_degrees(t.grid, DX, DY, LAT), label.select("pixel_id", "polygon_id"))
    shares = raster.class_shares(label, t.parcels)
    base = t.parcels.select("polygon_id", "pos", "mws_code", F.concat(F.lit("D"), F.col("pos") % 3).alias("district"))
    area = spatial.polygon_area_ha(t.parcel_edges)
    return base.join(shares, "polygon_id").join(area, "polygon_id").join(slope, "polygon_id", "left")


CAND = f"""{LABELS}, slp as (select polygon_id, avg(slope_deg) mean_slope_deg from lab join {SLOPE} s using (pixel_id) group by 1),
   cand as (select s.*, area_ha, mean_slope_deg, concat('D', s.pos%3) district, 0.5e0*crop_share+0.3e0*(1-built_up_share)+0.2e0*(1-water_share) score,
     case when pixel_count<=0 then 'no valid land-cover pixels (outside fetched raster coverage)' when area_ha<50 then concat('area_ha ', printf('%.1f', area_ha), ' < MIN_AREA_HA 50.0')
       when area_ha>8000 then concat('area_ha ', printf('%.1f', area_ha), ' > MAX_AREA_HA 8000.0') when built_up_share>0.15e0 then concat('built_up_share ', printf('%.3f', built_up_share), ' > MAX_BUILT_UP_SHARE 0.15')
       when water_share>0.3e0 then concat('water_share ', printf('%.3f', water_share), ' > MAX_WATER_SHARE 0.3') end reason
     from shares s join {AREA} a using (polygon_id) left join slp using (polygon_id))"""


@query(
    "candidate_ranking",
    f"""with {CAND} select polygon_id, {q6('score')} composite_score, reason is not null excluded, reason exclusion_reason,
   case when reason is null then row_number() over (partition by reason is null order by round(score,12) desc, pos) end as rank from cand""",
)
def candidate_ranking(t: Tables) -> DataFrame:
    # shares are ratios computed two ways in the check, so ties are judged to 12 decimals
    scored = ranking.rank_candidates(candidates(t))
    return scored.select("polygon_id", r6("composite_score").alias("composite_score"), "excluded", "exclusion_reason", "rank")


@query("preferred_slope_band", f"with {CAND} select polygon_id, mean_slope_deg between 1 and 8 in_slope_band from cand")
def preferred_slope_band(t: Tables) -> DataFrame:
    return ranking.score_candidates(candidates(t)).select("polygon_id", "in_slope_band")


@query("top_treated", f"with {CAND} select polygon_id, {q6('score')} composite_score from cand where reason is null order by round(score,12) desc, pos limit 5")
def top_treated(t: Tables) -> DataFrame:
    return ranking.select_treated(ranking.score_candidates(candidates(t)), 5).select("polygon_id", r6("composite_score").alias("composite_score"))


STUDY = f"""{CAND}, tr as (select * from cand where district='D0' and reason is null order by round(score,12) desc, pos limit 5),
   mean as (select avg(crop_share) crop, avg(mean_slope_deg) slope from tr),
   ctl as (select c.*, case when slope is not null and mean_slope_deg is not null then 'true' else 'not_evaluated_missing_slope' end slope_match from cand c, mean
     where reason is null and district<>'D0' and crop>0 and abs(crop_share-crop)/crop<=0.15 and (slope is null or mean_slope_deg is null or abs(mean_slope_deg-slope)<=3))"""


@query("matched_controls", f"with {STUDY} select polygon_id, district, slope_match, 'pending' ndvi_match from ctl")
def matched_controls(t: Tables) -> DataFrame:
    _, controls = ranking.select_study_sets(ranking.score_candidates(candidates(t)), "D0", 5)
    return controls.select("polygon_id", "district", "slope_match", "ndvi_match")


@query("study_sets", f"with {STUDY} select polygon_id, 'treated' role from tr union all select polygon_id, 'control' from ctl")
def study_sets(t: Tables) -> DataFrame:
    """Treated: the best five of their district.  Controls: matched, from the other districts only."""
    treated, controls = ranking.select_study_sets(ranking.score_candidates(candidates(t)), "D0", 5)
    a = treated.select("polygon_id", F.lit("treated").alias("role"))
    return a.unionByName(controls.select("polygon_id", F.lit("control").alias("role")))
