"""The domain's tables, derived from the star-schema test tables.

Each adapter is one SELECT that reads the same in Spark and in ANSI SQL, so a query and
its check start from the same rows.  ``{name}`` stands for a base table (or, for derived
adapters, an earlier adapter).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.functions.geo import hash_from_halves

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_CODE = f"substr('{''.join(C.CATEGORY_CODES)}', cast(1+2*({{k}}%9) as int), 2)"
_RING = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0.5, 0.5), (0.5, 0.5, 0, 1), (0, 1, 0, 0)]


def _sides(width: str) -> list[dict[str, str]]:
    """Five sides of a concave ring at (x0, y0)."""
    corner = {"x1": "x0+{0}e0*{w}", "y1": "y0+{1}e0*{w}", "x2": "x0+{2}e0*{w}", "y2": "y0+{3}e0*{w}"}
    return [{"edge": str(i)} | {c: form.format(*side, w=width) for c, form in corner.items()} for i, side in enumerate(_RING)]


def _ring(key: str, source: str, width: str) -> str:
    return " union all ".join(
        f"select {key}, 0 part, 0 ring, {', '.join(f'{value} {name}' for name, value in side.items())} from {{{source}}}" for side in _sides(width)
    )


def _ring_inline(key: str, source: str, width: str) -> str:
    """The same rows for Spark, which would read the source once per select of a union."""
    structs = [f"named_struct({', '.join(f"'{name}', {value}" for name, value in side.items())})" for side in _sides(width)]
    return f"select {key}, 0 part, 0 ring, inline(array({', '.join(structs)})) from {{{source}}}"


ADAPTERS: dict[str, str] = {
    # watersheds on a 5 x 5 grid, some without a window bound
    "a_mws": """select concat('W', n_nationkey) mws_id, n_name name, concat('S', n_regionkey) state, n_nationkey pos,
        92e0+(n_nationkey%5)*0.125e0 x0, 26e0+floor(n_nationkey/5e0)*0.125e0 y0,
        case when n_nationkey%7=0 then null else date '1996-01-01' end window_start,
        case when n_nationkey%6=0 then null else date '2000-12-31' end window_end from {nation}""",
    "a_edges": _ring("mws_id", "a_mws", "0.125e0"),
    # candidate polygons, one per supplier: some overlap, touch, or leave a gap
    "a_parcels": """select concat('P', s_suppkey) polygon_id, s_suppkey pos, concat('M', s_suppkey%60) mws_code,
        92e0+(s_suppkey%20)*0.03125e0 x0, 26e0+floor(s_suppkey/20e0)*0.03125e0 y0,
        (16+s_suppkey%24)/1024e0 w from {supplier}""",
    "a_parcel_edges": _ring("polygon_id", "a_parcels", "w"),
    "a_records": f"""select o_orderkey record_id, concat('W', c_nationkey) mws_id,
        {_CODE.format(k='o_orderkey')} category,
        92e0+(c_nationkey%5)*0.125e0+((o_orderkey*37)%144-8)/1024e0 lon,
        26e0+floor(c_nationkey/5e0)*0.125e0+((o_orderkey*53)%144-8)/1024e0 lat,
        case when o_orderkey%17=0 then null else ((o_orderkey*13)%400)/10e0 end gps_accuracy_m,
        case when o_orderkey%19=0 then null else o_orderdate end captured_at,
        cast(case when o_orderkey%19=0 then null else o_orderdate end as date) captured_date,
        case when o_orderkey%11=0 then null else 26e0+floor(c_nationkey/5e0)*0.125e0+((o_orderkey*53)%144-8)/1024e0+(o_orderkey%5)*0.0004e0 end exif_lat,
        case when o_orderkey%11=0 then null else 92e0+(c_nationkey%5)*0.125e0+((o_orderkey*37)%144-8)/1024e0 end exif_lon,
        case when o_orderkey%13=0 then null when o_orderkey%3=0 then o_orderdate + interval '1' day else o_orderdate end exif_ts,
        o_orderdate created_at, o_orderpriority activity
        from {{orders}} join {{customer}} on o_custkey=c_custkey""",
    # one or two photo hashes per record as hex text; copies at distance 0, 3, 6 and 7 of a base hash
    "a_photo_hex": """select o_orderkey record_id, 1 slot, case when o_orderkey%29=0 then null else md5(cast(cast(floor(o_orderkey/3e0) as bigint) as varchar(20))) end base,
          case o_orderkey%3 when 0 then 0 when 1 then 7 else 127 end flip from {orders}
        union all select o_orderkey, 2, md5(concat('p', cast(cast(floor(o_orderkey/8e0) as bigint) as varchar(20)))), case when o_orderkey%8=0 then 0 else 63 end
          from {orders} where o_orderkey%4=0""",
    "a_obs": """select l_partkey pixel_id, l_shipdate ts, cast(l_quantity as int) qa,
        8000+(l_partkey*7+l_linenumber*131)%4000 b3, 8000+(l_orderkey*11)%5000 b4,
        9000+(l_suppkey*97+l_linenumber*17)%9000 b5, 8500+(l_orderkey*5+l_partkey)%6000 b6 from {lineitem}""",
    "a_grid": """select p_partkey pixel_id, cast(floor(p_partkey/50e0) as bigint) r, p_partkey%50 c,
        case when floor(p_partkey/800e0)%3=1 and p_partkey%3=0 then 50
          when p_partkey*7%11<5 then 40 when p_partkey*7%11=5 then 50 when p_partkey*7%11=6 then 80
          when p_partkey*7%11<9 then 10 else 90 end lc,
        case when p_partkey%211=0 then -9999e0 else p_retailprice+p_size end z,
        92e0+(p_partkey%50)/512e0+1/1024e0 lon, 26e0+floor(p_partkey/50e0)/512e0+1/1024e0 lat from {part}""",
    # two yearly indices per unit; unit 0 is treated, all others are controls
    "a_series": """select 'NDVI' idx, l_suppkey unit_id, cast(extract(year from l_shipdate) as int) y, avg(l_discount) v from {lineitem} group by 1,2,3
        union all select 'MNDWI', l_suppkey, cast(extract(year from l_shipdate) as int), avg(l_tax) from {lineitem} group by 1,2,3""",
    "a_cover": """select concat('D', c_nationkey) district, concat('S', n_regionkey) state, count(*) total_works,
        cast(sum(case when o_orderstatus<>'P' then 1 else 0 end) as bigint)+case when c_nationkey%9=0 then 30+count(*) else 0 end geotagged_works
        from {orders} join {customer} on o_custkey=c_custkey join {nation} on c_nationkey=n_nationkey group by c_nationkey, n_regionkey""",
    "a_work": """select concat('P', o_orderkey) work_code, concat('D', c_nationkey) district, o_orderkey pos, o_orderpriority head,
        case o_orderkey%10 when 0 then 'Farm Ponds' when 1 then 'Check dams' when 2 then 'Contour Bunding' when 3 then 'Irrigation/Drainage Channel'
          when 4 then 'Goatery' when 5 then 'Handloom items' when 6 then 'Borewell and Hand Pump' when 7 then 'Amrit Sarovar' when 8 then 'Bee Keeping & Dairy'
          else concat('Training ', o_orderkey%7) end activity,
        case when o_orderkey%97=0 then 'Accepted Rejected' when o_orderkey%89=0 then 'On hold' when o_orderstatus='F' then 'Accepted' when o_orderstatus='O' then 'Yet to Moderate' else '' end pre_status,
        case when o_orderkey%5=0 then 'Rejected' when o_orderstatus='F' then ' Yet To Moderate ' else '' end mid_status,
        case when o_orderkey%83=0 then 'accepted: phase 2' when o_orderkey%3=0 then 'ACCEPTED' else '' end post_status
        from {orders} join {customer} on o_custkey=c_custkey""",
    "a_ai": """select o_orderkey record_id, case o_orderkey%3 when 0 then 'yes' when 1 then 'no' else 'uncertain' end matches_declared,
        ((o_orderkey*7)%101)/100e0 confidence from {orders}""",
    # raw classifier answers; some break one rule each
    "a_raw": f"""select o_orderkey record_id, case when o_orderkey%37=0 then 'truncated' when o_orderkey%31=0 then 'enum' when o_orderkey%29=0 then 'extra'
          when o_orderkey%23=0 then 'range' when o_orderkey%19=0 then 'blank' else 'ok' end kind,
        case when o_orderkey%37=0 then '{{{{"predicted_category":"PT"' else
        concat('{{{{"predicted_category":"', {_CODE.format(k='o_orderkey')}, '","predicted_activity":"Farm Pond","construction_stage":"',
          case when o_orderkey%31=0 then 'finished' else 'completed' end, '","water_visible":"yes","vegetation_cover":"low","matches_declared":"',
          case o_orderkey%3 when 0 then 'yes' when 1 then 'no' else 'uncertain' end, '","confidence":',
          case when o_orderkey%37<>0 and o_orderkey%31<>0 and o_orderkey%29<>0 and o_orderkey%23=0 then '1.5' else cast(((o_orderkey*7)%101)/100e0 as varchar(20)) end,
          case when o_orderkey%31<>0 and o_orderkey%29=0 then ',"mood":"fine"' else '' end, ',"evidence":"',
          case when o_orderkey%31<>0 and o_orderkey%29<>0 and o_orderkey%23<>0 and o_orderkey%19=0 then '' else 'pond with water' end, '"}}}}') end raw_json
        from {{orders}}""",
    "a_eval": f"""select doc_id, doc_id%4 model, case when doc_id%10=9 then 'NONE' else substr('{''.join(C.CATEGORY_CODES)}', cast(1+2*(doc_id%10) as int), 2) end gt,
        case when doc_id%43=0 then null when (doc_id*3+quality)%10=9 then 'UNKNOWN' else substr('{''.join(C.CATEGORY_CODES)}', cast(1+2*((doc_id*3+quality)%10) as int), 2) end pred,
        case when doc_id%43=0 then 'timeout' else null end error,
        case when toxic=1 then 'Classifier response invalid after 2 attempt(s): x' else 'seen' end evidence from {{labels}}""",
    "a_stage": """select user_id asset_id, event_id, ts, case event_type when 'signup' then 'not_started' when 'click' then 'under_construction'
        when 'purchase' then 'completed' when 'error' then 'damaged' else 'unclear' end stage from {events}""",
    "a_rain": """select user_id cell_id, cast(ts as date) as day, value mm from {events}""",
    "a_cells": """select distinct user_id cell_id, user_id%10 zone_id from {events}""",
}

SPARK_FORMS = {
    "a_edges": _ring_inline("mws_id", "a_mws", "0.125e0"),
    "a_parcel_edges": _ring_inline("polygon_id", "a_parcels", "w"),
}


def _needed(text: str) -> list[str]:
    """Adapters used by ``text``, in order of definition."""
    found: list[str] = []

    def visit(name: str) -> None:
        for inner in re.findall(r"\{(\w+)\}", ADAPTERS[name]):
            if inner in ADAPTERS:
                visit(inner)
        if name not in found:
            found.append(name)

    for name in re.findall(r"\b(a_\w+)\b", text):
        if name in ADAPTERS:
            visit(name)
    return found


def _plain(name: str) -> str:
    text = ADAPTERS[name]
    return text.format(**{t: t for t in [*BASE, *ADAPTERS]})


def with_adapters(sql: str) -> str:
    """``sql`` preceded by the adapters it names, as common table expressions."""
    ctes = [f"{n} as ({_plain(n)})" for n in _needed(sql)]
    if not ctes:
        return sql
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Adapters of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _text(self, name: str) -> str:
        names = {t: f"parquet.`{self.folder}/{t}.parquet`" for t in BASE}
        names |= {a: f"({self._text(a)})" for a in ADAPTERS if a in re.findall(r"\{(\w+)\}", ADAPTERS[name])}
        return SPARK_FORMS.get(name, ADAPTERS[name]).format(**names)

    def __getattr__(self, name: str) -> DataFrame:
        """``tables.records`` is the adapter ``a_records``."""
        key = f"a_{name}"
        if name.startswith("_") or key not in ADAPTERS:
            raise AttributeError(name)
        return self.spark.sql(self._text(key))

    def record_expressions(self) -> list[str]:
        """Select list of ``a_records``, for inputs that are already joined (such as streams)."""
        body = ADAPTERS["a_records"].split("from {orders}")[0].strip()[len("select ") :]
        parts, depth, start = [], 0, 0
        for i, ch in enumerate(body):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                parts.append(body[start:i].strip())
                start = i + 1
        return [*parts, body[start:].strip()]

    def photos(self) -> DataFrame:
        """record_id, phash (bigint); one row per photo, null without a hash."""
        high = F.conv(F.substring("base", 1, 8), 16, 10).cast("bigint").bitwiseXOR(F.col("flip").cast("bigint"))
        low = F.conv(F.substring("base", 9, 8), 16, 10).cast("bigint")
        return self.photo_hex.select("record_id", hash_from_halves(high, low).alias("phash"))
