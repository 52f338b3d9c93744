"""Programme registry, report tables, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.operators import common, coverage, registry
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.tables import Tables
from basinlens.sources import report_html

PAGE_ROWS = 20  # data rows per derived report page


def paged(cells: list, rows: DataFrame, header=None) -> DataFrame:
    """Report pages made of the rows of a table: ``doc, html``, at most PAGE_ROWS rows each.

    ``rows`` needs pos (dense) and the cells' columns.  ``header`` is the text of a
    section row put before the data row, or null for none.
    """
    data = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("\n</td>")) for c in cells], F.lit("</tr>"))
    head = F.lit("") if header is None else F.when(
        header.isNotNull(), F.concat(F.lit('<tr><td colspan="7"><b>'), header, F.lit("</b></td></tr>"))
    ).otherwise("")
    lines = rows.select(F.floor(F.col("pos") / PAGE_ROWS).alias("doc"), "pos", F.concat(head, data).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    top = "<table><thead><tr><th>S.No</th></tr></thead><tbody><tr><th>1</th><th>2</th></tr>"
    return lines.groupBy("doc").agg(F.concat(F.lit(top), body, F.lit("</tbody></table><tr><td>footer</td></tr>")).alias("html"))


def work_pages(t: Tables) -> DataFrame:
    k = F.col("pos")
    header = F.when(k % PAGE_ROWS == 3, "NRM").when(k % PAGE_ROWS == 9, "EPA &amp; more")
    cells = [
        k.cast("string"),
        F.concat(F.lit("<a href='show?w="), F.col("work_code"), F.lit("&amp;v=1'>"), F.col("work_code"), F.lit("</a>")),
        F.col("head"),
        F.replace("activity", F.lit("&"), F.lit("&amp;")),
        F.concat(F.lit("<span>"), F.col("pre_status"), F.lit("</span>")),
        F.col("mid_status"),
        F.col("post_status"),
    ]
    return paged(cells, t.work, header)


GROUP = "case when pos%20>=9 then 'EPA & more' when pos%20>=3 then 'NRM' end"
CATEGORY = """case when activity like 'Farm%' or activity like 'Amrit%' then 'PT' when activity='Check dams' then 'SM' when activity='Contour Bunding' then 'BN'
  when activity like 'Irrigation%' then 'NC' when activity='Goatery' then 'LS' when activity like 'Handloom%' then 'LH' when activity like 'Bee%' then 'LS' else 'OM' end"""


def slug(c: str) -> str:
    return f"""case when trim({c})='' then 'not_submitted' when lower(trim({c}))='accepted rejected' then 'mixed' when lower({c}) like '%accepted%' then 'accepted'
      when lower({c}) like '%rejected%' then 'rejected' when lower({c}) like '%yet to moderate%' then 'yet_to_moderate' else 'other' end"""


def display(c: str) -> str:
    return f"case when trim({c})='' then 'Not Submitted' else trim({c}) end"


@query(
    "report_table_rows",
    f"""select cast(floor(pos/20e0) as bigint) doc, work_code, {GROUP} section, activity, concat('show?w=', work_code, '&v=1') href, 7 n_cells from a_work""",
)
def report_table_rows(t: Tables) -> DataFrame:
    rows = report_html.table_rows(work_pages(t))
    return rows.select(
        "doc",
        F.col("cells")[1]["text"].alias("work_code"),
        F.col("group").alias("section"),
        F.col("cells")[3]["text"].alias("activity"),
        F.col("cells")[1]["href"].alias("href"),
        F.size("cells").alias("n_cells"),
    )


@query(
    "page_list_links",
    """with l as (select page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1)) href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) label,
      generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1), 1) - 1 pos from pages)
   select page_id, cast(pos as int) pos, replace(href, '&amp;', '&') href, trim(replace(label, '&amp;', '&')) text from l""",
)
def page_list_links(t: Tables) -> DataFrame:
    return report_html.list_links(t.base("pages"))


@query(
    "workcode_table",
    f"""select work_code, head, activity, {GROUP} section, {CATEGORY} category, {display('pre_status')} pre_status, {display('mid_status')} mid_status,
   {slug('pre_status')} pre_slug, {slug('mid_status')} mid_slug, {slug('post_status')} post_slug from a_work""",
)
def workcode_table(t: Tables) -> DataFrame:
    rows = registry.workcode_rows(report_html.table_rows(work_pages(t)))
    return rows.select(
        "work_code", "head", "activity", F.col("group").alias("section"), "category", "pre_status", "mid_status",
        "pre_slug", "mid_slug", "post_slug",
    )


def level_pages(t: Tables, width: int, name_cell) -> DataFrame:
    k = F.col("pos")
    number = F.format_number((k * 37 + 1000) % 99991, 0)  # 1,037 style
    cells = [k.cast("string"), name_cell, *[F.when(k % 4 == 0, number).otherwise(F.lit(str(i))) for i in range(2, width)]]
    source = t.base("customer").select(F.col("c_custkey").alias("pos"), "c_name")
    whole = paged(cells, source)
    # a total row with merged cells has fewer cells and must be skipped
    return whole.withColumn("html", F.replace("html", F.lit("</tbody>"), F.lit("<tr><td colspan='3'>Grand Total</td><td>9</td></tr></tbody>")))


@query(
    "district_table",
    """select c_name district, cast(c_custkey as int) dcode, case when c_custkey%4=0 then cast((c_custkey*37+1000)%99991 as int) else 2 end total_projects,
   case when c_custkey%4=0 then cast((c_custkey*37+1000)%99991 as int) else 21 end non_geotagged_work_codes from customer""",
)
def district_table(t: Tables) -> DataFrame:
    name = F.concat(F.lit('<a href="level?dcode='), F.col("pos").cast("string"), F.lit('&stname=A+B">'), F.col("c_name"), F.lit("</a>"))
    rows = registry.district_rows(report_html.table_rows(level_pages(t, 22, name)))
    return rows.select("district", "dcode", "total_projects", "non_geotagged_work_codes")


@query(
    "project_table",
    """select cast(c_custkey as int) project_id, case when c_custkey%2=0 then concat('P ', c_custkey, '/A') else c_name end project_name,
   case when c_custkey%4=0 then cast((c_custkey*37+1000)%99991 as int) else 18 end total_work_codes from customer where c_custkey%5<>0""",
)
def project_table(t: Tables) -> DataFrame:
    k = F.col("pos").cast("string")
    link = F.when(F.col("pos") % 5 != 0, F.concat(F.lit("projid="), k)).otherwise("other=1")
    named = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("&projname=P+"), k, F.lit("%2FA"))).otherwise("")
    name = F.concat(F.lit('<a href="x?'), link, named, F.lit('">'), F.col("c_name"), F.lit("</a>"))
    rows = registry.project_rows(report_html.table_rows(level_pages(t, 21, name)))
    return rows.select("project_id", "project_name", "total_work_codes")


@query(
    "section_fill",
    """select event_id, last_value(case when event_type='signup' then concat('s', event_id) end ignore nulls) over (partition by user_id order by ts, event_id) section from events""",
)
def section_fill(t: Tables) -> DataFrame:
    """Carry the last section header forward per user, filled day by day."""
    e = t.base("events").withColumn("header", F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), "event_id")))
    e = e.withColumn("at", F.struct("ts", "event_id"))
    filled = common.forward_fill(e, "header", "at", ["user_id"], chunk=F.to_date("ts"), name="section")
    return filled.select("event_id", "section")


@query("activity_category", f"select work_code, activity, {CATEGORY} category from a_work")
def activity_category(t: Tables) -> DataFrame:
    return t.work.select("work_code", "activity", registry.activity_category().alias("category"))


@query(
    "status_normalisation",
    f"select work_code, {slug('pre_status')} pre_slug, {display('pre_status')} pre_display, {slug('mid_status')} mid_slug, {slug('post_status')} post_slug from a_work",
)
def status_normalisation(t: Tables) -> DataFrame:
    s = registry.status_slug
    return t.work.select(
        "work_code",
        s("pre_status").alias("pre_slug"),
        registry.status_display("pre_status").alias("pre_display"),
        s("mid_status").alias("mid_slug"),
        s("post_status").alias("post_slug"),
    )


def work_rows(t: Tables) -> DataFrame:
    slugs = {f"{s}_slug": registry.status_slug(f"{s}_status") for s in ("pre", "mid", "post")}
    return t.work.withColumns({**slugs, "category": registry.activity_category()})


_COUNTS = ", ".join(
    f"cast(sum(case when slug='{s}' then 1 else 0 end) as bigint) {s}"
    for s in ("accepted", "yet_to_moderate", "rejected", "not_submitted", "mixed", "other")
)


@query(
    "stage_backlog",
    f"""with l as (select 'pre' stage, {slug('pre_status')} slug from a_work union all select 'mid', {slug('mid_status')} from a_work
    union all select 'post', {slug('post_status')} from a_work)
  select stage, {_COUNTS}, count(*) total, round_even(sum(case when slug='yet_to_moderate' then 1 else 0 end)/count(*)*100e0, 1) yet_to_moderate_pct, true sums_to_total from l group by 1""",
)
def stage_backlog(t: Tables) -> DataFrame:
    return registry.stage_backlog(work_rows(t))


@query(
    "category_breakdown",
    f"""select {CATEGORY} category, count(*) work_code_count, round_even(count(*)/(sum(count(*)) over ())*100e0, 1) share_pct from a_work group by 1""",
)
def category_breakdown(t: Tables) -> DataFrame:
    return registry.category_breakdown(work_rows(t))


@query("unmapped_activities", f"select distinct activity from a_work where {CATEGORY}='OM'")
def unmapped_activities(t: Tables) -> DataFrame:
    return registry.unmapped_activities(work_rows(t))


def projects(t: Tables) -> DataFrame:
    return t.base("customer").select(
        F.col("c_custkey").alias("project_id"),
        F.concat("c_name", F.lit(" Block - "), F.col("c_custkey") % 3).alias("project_name"),
        (F.col("c_custkey") * 5 + 20000000).alias("total_work_codes"),
        F.lit("p").alias("doc"),
        F.col("c_custkey").alias("row"),
    )


@query(
    "programme_summary",
    """select c_custkey project_id, concat(c_name, ' Block - 1') project_name, c_custkey*5+20000000 total_work_codes, (select count(*) from a_work) geotagged_in_table,
   c_custkey*5+20000000-(select count(*) from a_work) non_geotagged from customer where c_custkey%3=1 order by c_custkey limit 1""",
)
def programme_summary(t: Tables) -> DataFrame:
    return registry.programme_summary(projects(t), t.work, "Block - 1")


# --- coverage -----------------------------------------------------------------------------

PCT = "case when total_works=0 then 0 else least(round_even(geotagged_works/total_works*100e0,1),100e0) end"


@query("coverage_pct", f"select district, state, total_works, geotagged_works, {PCT} coverage_pct from a_cover")
def coverage_pct(t: Tables) -> DataFrame:
    return t.cover.withColumn("coverage_pct", coverage.coverage_pct())


@query(
    "state_totals",
    f"""select state, cast(sum(total_works) as bigint) total_works, cast(sum(geotagged_works) as bigint) geotagged_works,
   {q6("sum(geotagged_works)/sum(total_works)*100e0")} pct from a_cover group by 1""",
)
def state_totals(t: Tables) -> DataFrame:
    return coverage.state_totals(t.cover).withColumn("pct", r6("pct"))


@query(
    "drilldown_totals",
    """select coalesce(state,'-') state, coalesce(district,'-') district, cast(2-bit_count(grouping(state,district)) as int) as level, cast(sum(total_works) as bigint) total_works,
   cast(sum(geotagged_works) as bigint) geotagged_works from a_cover group by rollup(state, district)""",
)
def drilldown_totals(t: Tables) -> DataFrame:
    out = coverage.drilldown_totals(t.cover)
    return out.fillna("-", ["state", "district"])


def boundaries(t: Tables) -> DataFrame:
    """Boundary names as another source writes them: some districts twice, some missing."""
    n = F.col("n_nationkey")
    first = t.base("nation").where("n_nationkey % 6 <> 0").select(
        n.alias("pos"),
        F.concat(F.lit(" d"), n, F.lit(" District")).alias("district"),
        F.concat(F.lit("S"), "n_regionkey").alias("state"),
        F.concat(F.lit("b"), n).alias("boundary_id"),
    )
    again = first.where("pos % 4 = 0").select((F.col("pos") + 100).alias("pos"), "district", F.lit("S0").alias("state"), F.concat("boundary_id", F.lit("x")).alias("boundary_id"))
    return first.unionByName(again)


_B = "case when n%6=0 then null when n%4=0 then concat('b',n,'x') else concat('b',n) end"


@query(
    "district_name_join",
    f"select district, state, total_works, geotagged_works, {_B} boundary_id, n%6<>0 matched from (select *, cast(substr(district,2) as int) n from a_cover)",
)
def district_name_join(t: Tables) -> DataFrame:
    return coverage.join_boundaries(t.cover, boundaries(t))


@query(
    "district_state_join",
    """select district, state, case when n%6=0 then null when n%4=0 and state='S0' then concat('b',n,'x') else concat('b',n) end boundary_id
   from (select *, cast(substr(district,2) as int) n from a_cover)""",
)
def district_state_join(t: Tables) -> DataFrame:
    return coverage.join_boundaries(t.cover, boundaries(t), match_on_state=True).select("district", "state", "boundary_id")


@query(
    "coverage_table",
    f"select district, {PCT} coverage_pct, n%6<>0 matched from (select *, cast(substr(district,2) as int) n from a_cover)",
)
def coverage_table(t: Tables) -> DataFrame:
    return coverage.coverage_table(t.cover, boundaries(t)).select("district", "coverage_pct", "matched")


@query("choropleth_class", f"select district, cast(floor({PCT}/25)*25 as int) lower_stop from a_cover")
def choropleth_class(t: Tables) -> DataFrame:
    return t.cover.select("district", coverage.choropleth_class(coverage.coverage_pct()).alias("lower_stop"))
