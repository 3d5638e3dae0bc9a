"""Queries on outlines and lines, with the SQL that states the same where SQL can; they join those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _NEXT_SQL, KINDS_SQL, PIXELS_SQL, _edge_sql, _rings, high_mask, kind_labels, palette_table, pixels, query, r6
from .functions import color
from .functions.color import LAB
from .operators import outline, pattern, skeleton, strokes, svg, vector
from .sources.lattice import THREADS_SQL, event_raster, part_threads
from .workspace import Rounds

_WAYS = "(case d when 0 then 1 when 2 then -1 else 0 end)", "(case d when 1 then 1 when 3 then -1 else 0 end)"


def _dart_sql() -> str:
    """Darts with their start (x, y), direction d, end (ex, ey), and the dart that goes on where two edges meet."""
    return f"""{_edge_sql()},
  dart as (select img, x0 as x, y0 as y, case when x1 > x0 then 0 else 1 end as d, "left", "right" from edges union all select img, x1, y1, case when x1 > x0 then 2 else 3 end, "right", "left" from edges),
  deg as (select img, x, y, count(*) as n, sum(d) as ds from dart group by all),
  fan as (select t.*, t.x + {_WAYS[0]} as ex, t.y + {_WAYS[1]} as ey, s.n as sn from dart t join deg s using (img, x, y)),
  go as (select f.*, (f.y * 1000 + f.x) * 4 + f.d as k, (f.ey * 1000 + f.ex) * 4 + (f.d + 2) % 4 as back, e.n as en, case when e.n = 2 then (f.ey * 1000 + f.ex) * 4 + e.ds - (f.d + 2) % 4 end as nxt from fan f join deg e on e.img = f.img and e.x = f.ex and e.y = f.ey)"""


@query(f"""with recursive {_dart_sql()},
  walk as (select img, k as s, sn, k, 0 as seq from go where sn <> 2 or d = 0
           union all select w.img, w.s, w.sn, g.nxt, w.seq + 1 from walk w join go g on g.img = w.img and g.k = w.k where g.nxt is not null and g.nxt <> w.s),
  fin as (select w.img, w.s, w.sn, arg_max(g.back, w.seq) as back, bool_or(g.en <> 2) as ends, min(case g.d when 0 then g.k when 2 then g.back end) as low from walk w join go g using (img, k) group by w.img, w.s, w.sn),
  arc as (select img, s, row_number() over (partition by img order by sn = 2, s) - 1 as id from fin where case when sn <> 2 then s < back else not ends and low = s end)
select a.img, a.id::integer as id, w.seq::integer as seq, g.x::integer as x0, g.y::integer as y0, g.ex::integer as x1, g.ey::integer as y1, g."left"::integer as "left", g."right"::integer as "right" from arc a join walk w using (img, s) join go g on g.img = w.img and g.k = w.k""")
def trace_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.trace_arcs(kind_labels(spark, sf_dir), "label")


@query()
def assemble_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.assemble_rings(outline.trace_arcs(kind_labels(spark, sf_dir), "label"))


@query(f"""with {_edge_sql()}, side as (select img, "left" as region from edges union all select img, "right" from edges), n as (select img, region, count(*) as points from side where region >= 0 group by all)
select n.img, n.region, n.points, (select count(*) from kinds k where k.img = n.img and k.label = n.region)::double as area, n.points::double as length from n""")
def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact outlines: what a region's rings enclose is its pixels, and their length its sides."""
    rings = outline.vectorize(kind_labels(spark, sf_dir), 0.0, 0, column="label")
    points = F.aggregate("rings", F.lit(0).cast("long"), lambda s, r: s + F.size(r))
    length = F.aggregate(F.transform("rings", lambda r: vector.polyline_length(r, True)), F.lit(0.0), lambda s, v: s + v)
    return rings.select("img", "region", points.alias("points"), r6(outline.outline_area(F.col("rings")), "area"), r6(length, "length"))


@query()
def vectorize_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines simplified and smoothed once an arc."""
    rings = outline.vectorize(kind_labels(spark, sf_dir), 0.9, 2, column="label")
    return rings.select("img", "region", F.size("rings").alias("rings"), F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r)).alias("points"), r6(outline.outline_area(F.col("rings")), "area"))


# --- lines


def _kind_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of one event type, as a mask of one component an image."""
    return kind_labels(spark, sf_dir).where("label = 0").select("img", "x", "y", F.lit(1).alias("comp"))


_EIGHT_SQL = "nb(k, dx, dy) as (values (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1))"
_STEP_SQL = f"{KINDS_SQL}, {_EIGHT_SQL}, on_ as (select img, x, y from kinds where label = 0), step as (select p.img, p.x, p.y, nb.k, q.x as ex, q.y as ey from on_ p cross join nb join on_ q on q.img = p.img and q.x = p.x + nb.dx and q.y = p.y + nb.dy)"


@query(f"with {_STEP_SQL} select p.img, p.x, p.y, count(s.k)::integer as degree from on_ p left join step s using (img, x, y) group by p.img, p.x, p.y")
def degree_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.degree_map(_kind_mask(spark, sf_dir)).select("img", "x", "y", "degree")


@query(f"""with recursive {_STEP_SQL}, deg as (select img, x, y, count(*) as n, sum(k) as ks from step group by all),
  go as (select s.*, (s.y * 1000 + s.x) * 8 + s.k as d, (s.ey * 1000 + s.ex) * 8 + (s.k + 4) % 8 as back, a.n as sn, e.n as en, case when e.n = 2 then (s.ey * 1000 + s.ex) * 8 + e.ks - (s.k + 4) % 8 end as nxt
         from step s join deg a using (img, x, y) join deg e on e.img = s.img and e.x = s.ex and e.y = s.ey),
  walk as (select img, d as s, sn, d, 0 as seq from go union all select w.img, w.s, w.sn, g.nxt, w.seq + 1 from walk w join go g on g.img = w.img and g.d = w.d where g.nxt is not null and g.nxt <> w.s),
  fin as (select w.img, w.s, w.sn, arg_max(g.back, w.seq) as back, bool_or(g.en <> 2) as ends, min(least(g.d, g.back)) as low from walk w join go g using (img, d) group by w.img, w.s, w.sn),
  arc as (select img, s, row_number() over (partition by img order by sn = 2, s) - 1 as id from fin where case when sn <> 2 then s < back else not ends and low = s end)
select a.img, a.id::integer as id, w.seq::integer as seq, g.x::integer as x0, g.y::integer as y0, g.ex::integer as x1, g.ey::integer as y1 from arc a join walk w using (img, s) join go g on g.img = w.img and g.d = w.d""")
def trace_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton.trace_skeleton(_kind_mask(spark, sf_dir), Rounds(spark, "skeleton")).select("img", "id", "seq", "x0", "y0", "x1", "y1")


@query()
def thin_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = high_mask(spark, sf_dir).where(F.col("on") == 1).select("img", "x", "y", F.lit(1).alias("comp"))
    return skeleton.degree_map(skeleton.thin(on, Rounds(spark, "thin"))).select("img", "x", "y", "degree")


@query()
def skeleton_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = high_mask(spark, sf_dir).where(F.col("on") == 1).select("img", "x", "y", F.lit(1).alias("comp"), F.lit(3).alias("spur"))
    paths = skeleton.skeleton_paths(on, 3)
    return paths.select("img", "id", F.size("line").alias("points"), r6(vector.polyline_length(F.col("line")), "length"))


@query(f"""with {KINDS_SQL}, sq(n, dx, dy) as (select row_number() over (order by b.d, a.d), a.d, b.d from (values (-1), (0), (1)) a(d), (values (-1), (0), (1)) b(d)),
  t as (select p.img, p.x, p.y, q.label as comp, min(sq.n) as n from kinds p cross join sq join kinds q on q.img = p.img and q.x = p.x + sq.dx and q.y = p.y + sq.dy where p.label is null and q.label is not null group by all)
select img, x, y, comp from (select *, row_number() over (partition by img, x, y order by n) as r from t) where r <= 2""")
def rim_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strokes.rim_touch(kind_labels(spark, sf_dir).withColumnRenamed("label", "comp"))


@query(f"""with {PIXELS_SQL}, m as (select p.img, p.i, avg(q.ok_l) as l, avg(q.ok_a) as a2, avg(q.ok_b) as b2 from px p join px q on q.img = p.img and greatest(abs(q.x - p.x), abs(q.y - p.y)) = 1 and q.a >= 128 where p.a < 128 group by p.img, p.i)
select px.img, px.i, round(coalesce(m.l, ok_l), 6) as ok_l, round(coalesce(m.a2, ok_a), 6) as ok_a, round(coalesce(m.b2, ok_b), 6) as ok_b from px left join m using (img, i)""")
def inpaint_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transparent pixels, which lie apart, take the mean of those around."""
    holes = pixels(spark, sf_dir).withColumn("hole", (F.col("a") < 128).cast("int"))
    return strokes.inpaint_colour(holes.select("img", "i", "x", "y", *LAB, "hole")).select("img", "i", *[r6(c, c) for c in LAB])


def _drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a stroke of two pixels every twenty rows, which breaks where an event's value is high, and grain."""
    ink = (F.col("y") % 20).isin(10, 11) & F.col("x").between(6, 93) & (F.col("value") < 200)
    lightness = F.when(ink, 0.2).otherwise(0.95) + F.col("value") % 7 / 1000
    return event_raster(spark, sf_dir).select("img", "i", "x", "y", lightness.alias("ok_l"), F.lit(0.0).alias("ok_a"), F.lit(0.0).alias("ok_b"))


@query()
def detect_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of pages drawn from the events."""
    found, _ = strokes.detect_strokes(_drawing(spark, sf_dir), 3.2, 6.0, 0.16, 2.0)
    return found.select("img", "comp", F.size("paths").alias("paths"), r6("width_px", "width_px"), r6("length_px", "length_px"), *[r6(c, c) for c in LAB])


@query()
def lift_thin_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the event types' regions when those that are lines are lifted."""
    left, _ = strokes.lift_thin_regions(kind_labels(spark, sf_dir), palette_table(spark, sf_dir), 4.0, 6.0, 0.1)
    return left.select("img", "i", "label")


# --- pages


def _mm(e: str) -> str:
    return f"regexp_replace(regexp_replace(cast(cast(floor(({e}) * 100e0 + 0.5e0) / 100 as decimal(18, 2)) as varchar), '0+$', ''), '\\.$', '')"


_PAGE = svg.Page(500, 300, 0.5, fabric="#FAF0E6", hoop=(510.0,))
_SHAPE_SQL = f"""{_NEXT_SQL.replace('o as (', 'po as (', 1)}, {THREADS_SQL},
  ring as (select k, string_agg({_mm('x')} || ' ' || {_mm('y')}, 'L' order by n) as d, count(*) as n from po group by k),
  reg as (select cast(k % 7 as integer) as img, k as id, cast(k % 12 as integer) as palette_idx, case when n >= 3 then 'M' || d || 'Z' else '' end as d, n / 4e0 as area from ring),
  leg as (select img, palette_idx, count(*) as regions, row_number() over (partition by img order by palette_idx) as legend_no from reg group by img, palette_idx),
  st as (select cast(s_suppkey % 7 as integer) as img, s_suppkey as id, cast(s_suppkey % 5 as varchar) as number, (s_suppkey % 90)::double as px, (s_suppkey % 31)::double as py, (s_suppkey % 8) / 8e0 as width_mm, (s_suppkey % 64) / 2e0 as length_mm from supplier),
  sewn as (select *, case when width_mm <= 0.5e0 then 'back' else 'stem' end as stitch from st),
  ll as (select img, number, stitch, sum(length_mm) as length_mm, row_number() over (partition by img order by sum(length_mm) desc, number, stitch) as line_no from sewn group by img, number, stitch),
  pl as (select img, id, case id % 4 when 0 then 'full' when 1 then 'index' when 2 then 'leader' else 'none' end as tier, cast(id % 1000 as varchar) as text, (id % 480) + 0.5e0 as x, (id % 290) + 0.25e0 as y from reg),
  counts as (select img, (select count(*) from reg r where r.img = i.img) as regions, (select count(*) from leg l where l.img = i.img) as colours, (select count(*) from sewn s where s.img = i.img) as strokes from (select distinct img from reg) i),
  hexed as (select *, printf('#%02X%02X%02X', r, g, b) as hex from threads)"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders are regions, their colours a legend, suppliers strokes, and each region has a label."""
    t = part_threads(spark, sf_dir)
    hexed = t.withColumn("hex", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))).select("number", "name", "hex")
    k = F.col("k")
    rings = _rings(spark, sf_dir).select((k % 7).cast("int").alias("img"), k.alias("id"), (k % 12).cast("int").alias("palette_idx"), F.array("ring").alias("rings"), (F.size("ring") / 4.0).alias("area_mm2"))
    regions = rings.join(t.select(F.col("ord").alias("palette_idx"), "number", "name", "r", "g", "b"), "palette_idx")
    legend = pattern.legend(rings.withColumnRenamed("area_mm2", "area")).withColumn("number", F.col("palette_idx").cast("string")).join(hexed, "number")
    n = F.col("s_suppkey")
    at = [F.struct((n % 90 + dx).cast("double").alias("x"), (n % 31 + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (4, 3))]
    raw = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((n % 7).cast("int").alias("img"), n.alias("id"), (n % 5).cast("string").alias("number"), F.array(F.array(*at)).alias("paths"), (n % 8 / 8.0).alias("width_px"), (n % 64 / 2.0).alias("length_px"))
    strokes = pattern.resolve_strokes(raw, 1.0, 0.4).join(hexed, "number")
    ident = F.col("id")
    tier = F.when(ident % 4 == 0, "full").when(ident % 4 == 1, "index").when(ident % 4 == 2, "leader").otherwise("none")
    places = rings.select("img", "id", tier.alias("tier"), (ident % 1000).cast("string").alias("text"), (ident % 480 + 0.5).cast("double").alias("x"), (ident % 290 + 0.25).cast("double").alias("y")).withColumns({"from_x": F.col("x") / 2, "from_y": F.col("y") / 2})
    return {"images": rings.select("img").distinct(), "regions": regions, "legend": legend, "strokes": strokes, "line_legend": pattern.line_legend(strokes).join(hexed, "number"), "places": places}


def _shapes_sql() -> str:
    rim = f"{svg.outline_width(_PAGE.outline) / _PAGE.mm_per_px:g}"
    tints = " || ',' || ".join(f"cast(floor(255 + ({c} - 255) * 0.16e0 + 0.5) as integer)" for c in "rgb")
    font, half = "(case tier when 'full' then 2.4e0 else 1.9e0 end)", "(length(text) * (case tier when 'full' then 2.4e0 else 1.9e0 end) * 0.31e0)"
    lead = f"""'<line x1="' || {_mm('x / 2')} || '" y1="' || {_mm('y / 2')} || '" x2="' || {_mm('x')} || '" y2="' || {_mm('y')} || '" stroke="#1a1a1a" stroke-width="0.12"/><circle cx="' || {_mm('x / 2')} || '" cy="' || {_mm('y / 2')} || '" r="0.25" fill="#1a1a1a"/><rect x="' || {_mm(f'x - {half} - 0.3e0')} || '" y="' || {_mm(f'y - {font} * 0.6e0')} || '" width="' || {_mm(f'2 * {half} + 0.6e0')} || '" height="' || {_mm(f'{font} * 1.2e0')} || '" fill="#fff" stroke="#1a1a1a" stroke-width="0.1"/>'"""
    y, ly = "(5e0 + (legend_no - 1) * 5.2e0)", "(colours * 5.2e0 + 7 + line_no * 5.2e0)"
    return f"""with {_SHAPE_SQL}
select img, {svg.REGIONS + 1} as layer, id::bigint as ord, '<path id="region-' || id || '" d="' || d || '" fill="rgb(' || {tints} || ')" stroke="#1a1a1a" stroke-width="{rim}" data-region="' || id || '" data-dmc="' || number || '" data-name="' || name || '" data-area-mm2="' || {_mm('area')} || '" data-legend="' || legend_no || '"/>' as line
  from reg join leg using (img, palette_idx) join threads t on t.ord = palette_idx
union all select img, {svg.STROKES + 1}, id, '<path id="line-' || id || '" d="M' || {_mm('px')} || ' ' || {_mm('py')} || 'L' || {_mm('px + 4')} || ' ' || {_mm('py + 3')} || '" stroke="' || hex || '" stroke-width="' || {_mm('greatest(width_mm, 0.3e0) / 0.5e0')} || '" data-line="' || id || '" data-dmc="' || number || '" data-name="' || name || '" data-stitch="' || stitch || '" data-width-mm="' || {_mm('width_mm')} || '" data-length-mm="' || {_mm('length_mm')} || '"/>'
  from sewn join hexed using (number)
union all select img, {svg.LABELS + 1}, id, case tier when 'leader' then {lead} else '' end || '<text class="' || case tier when 'full' then 'dmc' else 'idx' end || '" x="' || {_mm('x')} || '" y="' || {_mm('y')} || '" font-size="' || {_mm(font)} || '" data-region="' || id || '">' || text || '</text>' from pl where tier <> 'none'
union all select img, {svg.LEGEND + 1}, legend_no, '<rect x="0" y="' || {_mm(f'{y} - 2')} || '" width="4" height="4" fill="' || hex || '" stroke="#333" stroke-width="0.1"/><text x="5.5" y="' || {_mm(y)} || '" font-size="2.1">' || legend_no || '</text><text x="10" y="' || {_mm(y)} || '" font-size="2.1">Thread ' || number || '</text><text x="22" y="' || {_mm(y)} || '" font-size="1.8" style="font-weight:400">' || name || '</text>'
  from leg join hexed on ord = palette_idx
union all select img, {svg.LINE_LEGEND + 1}, line_no, '<line x1="0" y1="' || {_mm(ly)} || '" x2="4" y2="' || {_mm(ly)} || '" stroke="' || hex || '" stroke-width="0.8" stroke-linecap="round"/><text x="5.5" y="' || {_mm(ly)} || '" font-size="2.1">Thread ' || number || '</text><text x="19" y="' || {_mm(ly)} || '" font-size="1.8" style="font-weight:400">' || stitch || ' stitch · ' || cast(floor(length_mm + 0.5e0) as bigint) || ' mm</text>'
  from ll join hexed using (number) join counts using (img)
union all select img, {svg.FOOT}, 1, '<g id="scale"><line x1="0" y1="305" x2="50" y2="305" stroke="#111" stroke-width="0.25"/><line x1="0" y1="304" x2="0" y2="306" stroke="#111" stroke-width="0.25"/><line x1="50" y1="304" x2="50" y2="306" stroke="#111" stroke-width="0.25"/><text x="25" y="307.6" font-size="2.2">50 mm</text><text x="250" y="307.6" font-size="2.2" style="font-weight:400">500 × 300 mm · ' || regions || ' regions · ' || colours || ' colours' || case when strokes > 0 then ' · ' || strokes || ' lines' else '' end || ' · fabric #FAF0E6</text></g>' from counts"""


@query(_shapes_sql())
def svg_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of seven pages whose regions, strokes, labels and legends come from the tables, and their scale bars."""
    drawn = svg.svg_lines(_PAGE, **_tables(spark, sf_dir))
    many = [svg.REGIONS + 1, svg.STROKES + 1, svg.LABELS + 1, svg.LEGEND + 1, svg.LINE_LEGEND + 1]
    return drawn.where(F.col("layer").isin(many) | ((F.col("layer") == svg.FOOT) & (F.col("ord") == 1)))
