"""All queries over the driver's tables with the SQL that states the same.

``queries`` hold operators against rasters made from ``events`` and a catalogue made from ``part``.
Doubles are rounded on both sides; integers and strings are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color
from .functions.text import file_name, xml_escape
from .functions.color import LAB
from .operators import export, geometry, graph, islands, nearest, palette, pattern, regions, stencil, vector
from .sources import catalogue
from .sources.lattice import RASTER_SQL, THREADS_SQL, event_raster, part_threads
from .workspace import Rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- colour expressions as SQL text for the oracle


def _lin(c: str) -> str:
    return f"(case when {c} / 255e0 <= 0.04045e0 then {c} / 255e0 / 12.92e0 else pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)"


def _mul(m: tuple[tuple[float, ...], ...], v: list[str]) -> list[str]:
    return ["(" + " + ".join(f"({k!r}::double * {x})" for k, x in zip(row, v, strict=True)) + ")" for row in m]


def _enc(c: str) -> str:
    return f"cast(greatest(0, least(255, floor((case when {c} <= 0.0031308e0 then {c} * 12.92e0 else 1.055e0 * pow(greatest({c}, 0e0), {1 / 2.4!r}::double) - 0.055e0 end) * 255e0 + 0.5e0))) as integer)"


def _lab_sql(src: str, name: str, keep: str = "*") -> str:
    """CTEs that add L, A, B to a table with r, g, b."""
    lin = f"{name}_lin as (select *, {_lin('r')} as lr, {_lin('g')} as lg, {_lin('b')} as lb from {src})"
    lms = ", ".join(f"cbrt({e}) as {n}" for e, n in zip(_mul(color.TO_LMS, ["lr", "lg", "lb"]), ("ql", "qm", "qs"), strict=True))
    lab = ", ".join(f"{e} as {n}" for e, n in zip(_mul(color.TO_OKLAB, ["ql", "qm", "qs"]), LAB, strict=True))
    return f"{lin}, {name}_lms as (select *, {lms} from {name}_lin), {name} as (select * exclude (lr, lg, lb, ql, qm, qs), {lab} from {name}_lms)"


#: Raster and threads with OKLab.
PIXELS_SQL = f"{RASTER_SQL}, {_lab_sql('raster', 'px')}"
LIBRARY_SQL = f"{THREADS_SQL}, {_lab_sql('threads', 'lib')}"
_D2 = "(p.ok_l - t.ok_l) * (p.ok_l - t.ok_l) + (p.ok_a - t.ok_a) * (p.ok_a - t.ok_a) + (p.ok_b - t.ok_b) * (p.ok_b - t.ok_b)"
#: A palette of 16 catalogue colours, label = position.
PALETTE = 16


def with_lab(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lab(event_raster(spark, sf_dir))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lab(part_threads(spark, sf_dir))


def short_palette(spark: SparkSession, sf_dir: str) -> list[tuple[int, float, float, float]]:
    rows = library(spark, sf_dir).where(F.col("ord") < PALETTE).orderBy("ord").collect()  # a constant 16 rows
    return [(r["ord"], r["ok_l"], r["ok_a"], r["ok_b"]) for r in rows]


def palette_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = event_raster(spark, sf_dir).select("img").distinct()
    return images.join(F.broadcast(library(spark, sf_dir).where(F.col("ord") < PALETTE).select(F.col("ord").alias("label"), *LAB)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_literal(geometry.alpha_mask(pixels(spark, sf_dir)), short_palette(spark, sf_dir))


LABELLED_SQL = f"""{PIXELS_SQL}, {LIBRARY_SQL},
  best as (select p.img, p.i, min(struct_pack(d := round({_D2}, 9), j := t.ord)) as m from px p join lib t on t.ord < {PALETTE} where p.a >= 128 group by p.img, p.i),
  lab as (select px.*, px.a >= 128 as mask, best.m.j as label from px left join best using (img, i))"""
_KINDS = {"view": 0, "signup": 1, "purchase": 2, "error": 3, "click": 4}
_KIND_SQL = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in _KINDS.items()) + " end"


def kind_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 0-4 from the event type; pixels of alpha 0 are masked."""
    code = F.lit(None).cast("int")
    for k, v in _KINDS.items():
        code = F.when(F.col("kind") == k, v).otherwise(code)
    return event_raster(spark, sf_dir).select("img", "i", "x", "y", F.when(F.col("a") >= 128, code).alias("label"))


KINDS_SQL = f"{RASTER_SQL}, kinds as (select img, i, x, y, case when a >= 128 then {_KIND_SQL} end as label from raster)"


def high_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_raster(spark, sf_dir).select("img", "i", "x", "y", (F.col("value") > 30).cast("int").alias("on"))


MASK_SQL = f"{RASTER_SQL}, m as (select img, i, x, y, cast(value > 30 as integer) as \"on\" from raster)"


def r6(c: str | Column, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# --- colour


@query(f"with {PIXELS_SQL} select img, i, round(ok_l, 6) as l_ok, round(ok_a, 6) as a_ok, round(ok_b, 6) as b_ok, round(sqrt(ok_a * ok_a + ok_b * ok_b), 6) as chroma from px")
def pixel_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return p.select("img", "i", r6("ok_l", "l_ok"), r6("ok_a", "a_ok"), r6("ok_b", "b_ok"), r6(color.chroma(F.col("ok_a"), F.col("ok_b")), "chroma"))


def _cielab_sql(src: str, name: str) -> str:
    xyz = _mul(color.TO_XYZ, [_lin("r"), _lin("g"), _lin("b")])
    f = ", ".join(f"{e} / {w!r}::double as t{k}" for k, (e, w) in enumerate(zip(xyz, color.WHITE, strict=True)))
    g = ", ".join(f"case when t{k} > {color.LAB_EPSILON!r}::double then cbrt(t{k}) else ({color.LAB_KAPPA!r}::double * t{k} + 16e0) / 116e0 end as f{k}" for k in range(3))
    return f"{name}_t as (select *, {f} from {src}), {name}_f as (select *, {g} from {name}_t), {name} as (select * exclude (t0, t1, t2, f0, f1, f2), 116e0 * f1 - 16e0 as cl, 500e0 * (f0 - f1) as ca, 200e0 * (f1 - f2) as cb from {name}_f)"


@query(f"with {RASTER_SQL}, {_cielab_sql('raster', 'cie')} select img, i, round(cl, 5) as l_star, round(ca, 5) as a_star, round(cb, 5) as b_star from cie")
def pixel_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    light, a, b = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return event_raster(spark, sf_dir).select("img", "i", F.round(light, 5).alias("l_star"), F.round(a, 5).alias("a_star"), F.round(b, 5).alias("b_star"))


@query(f"with {RASTER_SQL} select img, i, printf('#%02X%02X%02X', r, g, b) as code, r as r_back, g as g_back, b as b_back from raster")
def hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))
    back = color.hex_to_rgb(F.col("code"))
    return event_raster(spark, sf_dir).withColumn("code", code).select("img", "i", "code", *[c.alias(f"{n}_back") for c, n in zip(back, "rgb", strict=True)])


_back = _mul(color.FROM_LMS, [f"pow({e}, 3)" for e in _mul(color.FROM_OKLAB, LAB)])


@query(f"with {PIXELS_SQL}, lin as (select img, i, {', '.join(f'{e} as {n}' for e, n in zip(_back, ('lr', 'lg', 'lb'), strict=True))} from px) select img, i, {_enc('lr')} as r, {_enc('lg')} as g, {_enc('lb')} as b from lin")
def oklab_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = color.oklab_to_rgb((F.col("ok_l"), F.col("ok_a"), F.col("ok_b")))
    return pixels(spark, sf_dir).select("img", "i", r.alias("r"), g.alias("g"), b.alias("b"))


_shade = _mul(color.FROM_LMS, [f"pow({e}, 3)" for e in _mul(color.FROM_OKLAB, ["(0.9e0 * ok_l)", "ok_a", "ok_b"])])


@query(f"with {PIXELS_SQL}, lin as (select img, i, {', '.join(f'{e} as {n}' for e, n in zip(_shade, ('lr', 'lg', 'lb'), strict=True))} from px), back as (select img, i, {_enc('lr')} as r, {_enc('lg')} as g, {_enc('lb')} as b from lin), {_cielab_sql('back', 'cie')} select img, i, round(cl, 5) as l_star, round(ca, 5) as a_star, round(cb, 5) as b_star from cie")
def lab_from_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIELAB of colours a tenth darker than the pixels."""
    light, a, b = color.lab_from_centroid((F.lit(0.9) * F.col("ok_l"), F.col("ok_a"), F.col("ok_b")))
    return pixels(spark, sf_dir).select("img", "i", F.round(light, 5).alias("l_star"), F.round(a, 5).alias("a_star"), F.round(b, 5).alias("b_star"))


_HUE = "(case when degrees(atan2({b}, {a})) < 0 then degrees(atan2({b}, {a})) + 360e0 else degrees(atan2({b}, {a})) end)"


@query(f"with {PIXELS_SQL} select img, i, round({_HUE.format(a='ok_a', b='ok_b')}, 4) as hue from px where ok_a * ok_a + ok_b * ok_b > 1e-6")
def hue_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where("ok_a * ok_a + ok_b * ok_b > 1e-6D").select("img", "i", F.round(color.hue_degrees(F.col("ok_a"), F.col("ok_b")), 4).alias("hue"))


def _adjust_sql() -> str:
    import math

    cos, sin, scale, up = math.cos(math.radians(40)), math.sin(math.radians(40)), color.chroma_scale(0.3), color.lightness_shift(-0.4)
    turned = f"adj as (select img, i, greatest(0e0, least(1e0, ok_l + {up!r}::double)) as l2, (ok_a * {cos!r}::double - ok_b * {sin!r}::double) * {scale!r}::double as a2, (ok_a * {sin!r}::double + ok_b * {cos!r}::double) * {scale!r}::double as b2 from px)"
    back = _mul(color.FROM_LMS, [f"pow({e}, 3)" for e in _mul(color.FROM_OKLAB, ["l2", "a2", "b2"])])
    lin = ", ".join(f"greatest(0e0, least(1e0, {e})) as {n}" for e, n in zip(back, ("lr", "lg", "lb"), strict=True))
    return f"with {PIXELS_SQL}, {turned}, lin as (select img, i, {lin} from adj) select img, i, {_enc('lr')} as r, {_enc('lg')} as g, {_enc('lb')} as b from lin"


@query(_adjust_sql())
def color_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = color.adjust(F.col("r"), F.col("g"), F.col("b"), 40, 0.3, -0.4)
    return event_raster(spark, sf_dir).select("img", "i", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"with {THREADS_SQL} select number, printf('#%02X%02X%02X', r, g, b) as code, {', '.join(f'cast(floor(255 + ({c} - 255) * 0.16e0 + 0.5) as integer) as {c}_tint' for c in 'rgb')} from threads")
def svg_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_threads(spark, sf_dir).select("number", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("code"), *[color.tint(F.col(c)).alias(f"{c}_tint") for c in "rgb"])


def _de_sql() -> str:
    h = "case when {c} = 0 then 0e0 when degrees(atan2({b}, {a})) < 0 then degrees(atan2({b}, {a})) + 360e0 else degrees(atan2({b}, {a})) end"
    p7 = "sqrt(pow({c}, 7) / (pow({c}, 7) + pow(25e0, 7)))"
    return f"""with {THREADS_SQL}, {_cielab_sql('threads', 'cie')},
  a as (select p.number as n1, q.number as n2, p.cl as l1, q.cl as l2, p.cb as b1, q.cb as b2, 0.5e0 * (1 - {p7.format(c='((sqrt(p.ca*p.ca+p.cb*p.cb) + sqrt(q.ca*q.ca+q.cb*q.cb)) / 2)')}) as g, p.ca as a1, q.ca as a2
        from cie p join cie q on p.ord < {PALETTE} and p.ord < q.ord),
  b as (select n1, n2, l1, l2, b1, b2, (1 + g) * a1 as a1, (1 + g) * a2 as a2 from a),
  c as (select *, sqrt(a1 * a1 + b1 * b1) as c1, sqrt(a2 * a2 + b2 * b2) as c2 from b),
  d as (select *, {h.format(a='a1', b='b1', c='c1')} as h1, {h.format(a='a2', b='b2', c='c2')} as h2 from c),
  e as (select *, case when c1 * c2 = 0 then 0 when abs(h2 - h1) <= 180 then h2 - h1 when h2 - h1 > 180 then h2 - h1 - 360 else h2 - h1 + 360 end as dh,
        case when c1 * c2 = 0 then h1 + h2 when abs(h2 - h1) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end as h, (l1 + l2) / 2 as l, (c1 + c2) / 2 as c from d),
  f as (select *, 1 - 0.17e0 * cos(radians(h - 30)) + 0.24e0 * cos(radians(2 * h)) + 0.32e0 * cos(radians(3 * h + 6)) - 0.2e0 * cos(radians(4 * h - 63)) as t from e),
  g as (select n1, n2, (l2 - l1) / (1 + 0.015e0 * pow(l - 50, 2) / sqrt(20 + pow(l - 50, 2))) as dl, (c2 - c1) / (1 + 0.045e0 * c) as dc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015e0 * c * t) as dhh,
        -sin(radians(2 * 30e0 * exp(-pow((h - 275) / 25, 2)))) * 2 * {p7.format(c='c')} as rt from f)
select n1, n2, round(sqrt(greatest(0, dl * dl + dc * dc + dhh * dhh + rt * dc * dhh)), 5) as delta_e from g"""


@query(_de_sql())
def delta_e_2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalogue colour against the palette's."""
    lab = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    t = part_threads(spark, sf_dir).select("ord", "number", *[c.alias(n) for c, n in zip(lab, ("cl", "ca", "cb"), strict=True)])
    p, q = (t.select(F.col("ord").alias(f"o{k}"), F.col("number").alias(f"n{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("cl", "ca", "cb")]) for k in (1, 2))
    one, two = (tuple(F.col(f"{c}{k}") for c in ("cl", "ca", "cb")) for k in (1, 2))
    few = F.broadcast(p.where(F.col("o1") < PALETTE))  # a constant 16 rows
    return q.join(few, F.col("o1") < F.col("o2")).select("n1", "n2", F.round(color.delta_e_2000(one, two), 5).alias("delta_e"))


# --- nearest colours and lookups


@query(f"""with {LABELLED_SQL} select img, i, label from lab""")
def assign_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("img", "i", "label")


_CUST_SQL = f"""c as (select c_custkey, cast((c_custkey * 17 + 3) % 256 as integer) as r, cast((c_custkey * 101 + 50) % 256 as integer) as g, cast((c_custkey * 67 + 29) % 256 as integer) as b from customer), {_lab_sql('c', 'cu')}, {LIBRARY_SQL}"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return with_lab(spark.read.parquet(f"{sf_dir}/customer.parquet").select(k, *[((k * m + s) % 256).cast("int").alias(c) for c, m, s in (("r", 17, 3), ("g", 101, 50), ("b", 67, 29))]))


@query(f"""with {_CUST_SQL}, m as (select c_custkey, min(struct_pack(d := round({_D2}, 9), ord := t.ord, number := t.number)) as m from cu p cross join lib t group by c_custkey)
select c_custkey, m.ord as ord, m.number as number, m.d as distance_sq from m""")
def nearest_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_thread(customers(spark, sf_dir), ["c_custkey"], library(spark, sf_dir))


@query(f"""with {_CUST_SQL}, m as (select c_custkey, min(struct_pack(d := round(1.4e0 * (p.ok_l - t.ok_l) * (p.ok_l - t.ok_l) + (p.ok_a - t.ok_a) * (p.ok_a - t.ok_a) + (p.ok_b - t.ok_b) * (p.ok_b - t.ok_b), 9), ord := t.ord, number := t.number)) as m from cu p join lib t on t.ord % 3 <> 0 group by c_custkey)
select c_custkey, m.ord as ord, m.number as number, m.d as distance_sq from m""")
def nearest_with_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = library(spark, sf_dir)
    return nearest.nearest_thread(customers(spark, sf_dir), ["c_custkey"], threads, threads.where("ord % 3 = 0"), 1.4)


@query(f"""with {_CUST_SQL}, n as (select c_custkey, min(struct_pack(d := round({_D2}, 9), ord := t.ord, number := t.number)) as m from cu p cross join lib t group by c_custkey),
  q as (select c_custkey, min(struct_pack(d := round({_D2}, 9), ord := t.ord, number := t.number)) as m from cu p join lib t on t.ord < {PALETTE} group by c_custkey)
select n.c_custkey, case when q.m.d < 0.1e0 * 0.1e0 then q.m.number else n.m.number end as number, q.m.d < 0.1e0 * 0.1e0 as from_palette from n join q using (c_custkey)""")
def radius_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = library(spark, sf_dir)
    return nearest.snap(customers(spark, sf_dir), ["c_custkey"], threads.where(F.col("ord") < PALETTE), threads, 0.1)


@query(f"""with {_CUST_SQL}, r as (select c_custkey, t.number, round({_D2}, 9) as distance_sq from cu p cross join lib t),
  k as (select *, cast(row_number() over (partition by c_custkey order by distance_sq, number) as integer) as rank from r) select c_custkey, number, distance_sq, rank from k where rank <= 12""")
def rank_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.rank_threads(customers(spark, sf_dir), ["c_custkey"], library(spark, sf_dir), 12)


@query(f"with {THREADS_SQL} select number, name, ord from threads where lower(number) like '1%' or contains(lower(name), '1') order by ord limit 12")
def search_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search_threads(part_threads(spark, sf_dir), " 1", 12).select("number", "name", "ord")


def _edits(spark: SparkSession, sf_dir: str, times: int, plus: int, every: int) -> DataFrame:
    k = F.col("ord")
    return part_threads(spark, sf_dir).where(k % every == 1).select("number", ((k * times + plus) % 600).cast("string").alias("to"))


_EDITS = "e as (select number, cast((ord * {t} + {p}) % 600 as varchar) as \"to\" from threads where ord % {e} = 1)"
_PAL = "p as (select cast(s_suppkey % 5 as integer) as img, cast(s_suppkey as integer) as idx, cast(s_suppkey * 3 % 454 as varchar) as number from supplier)"


def _supplier_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select((k % 5).cast("int").alias("img"), k.cast("int").alias("idx"), (k * 3 % 454).cast("string").alias("number"))


@query(f"with {THREADS_SQL}, {_EDITS.format(t=7, p=5, e=2)}, {_PAL} select p.img, p.idx, coalesce(k.\"to\", p.number) as number from p left join (select e.* from e join threads t on t.number = e.\"to\") k on k.number = p.number")
def effective_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.effective_threads(_supplier_palette(spark, sf_dir), _edits(spark, sf_dir, 7, 5, 2), part_threads(spark, sf_dir))


@query(f"""with recursive {THREADS_SQL}, {_EDITS.format(t=2, p=1, e=2)}, {_PAL},
  w as (select distinct number, number as target, [number] as seen, 0 as n from p union all select w.number, e."to", list_append(w.seen, e."to"), n + 1 from w join e on e.number = w.target where not list_contains(w.seen, e."to")),
  f as (select number, arg_max(target, n) as target from w group by number)
select number, case when target in (select number from p) then target else number end as target from f""")
def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.resolve_merges(_supplier_palette(spark, sf_dir), _edits(spark, sf_dir, 2, 1, 2))


@query(f"with {KINDS_SQL} select img, i, case label when 1 then 0 when 4 then 2 else label end as label from kinds")
def remap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    remap = spark.createDataFrame([(1, 0), (4, 2)], "label int, to int")
    return nearest.remap_labels(kind_labels(spark, sf_dir), remap).select("img", "i", "label")


# --- geometry


@query(f"with {RASTER_SQL} select img, cast((59 - (y - 3)) * 80 + 0 as bigint) * 0 + cast((x - 10) * 60 + (59 - (y - 3)) as bigint) as i, cast(59 - (y - 3) as integer) as x, x - 10 as y, r, g, b from raster where x between 10 and 89 and y between 3 and 62")
def crop_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.crop_rotate(event_raster(spark, sf_dir), 10, 3, 90, 63, 90).select("img", "i", "x", "y", "r", "g", "b")


@query(f"""with {RASTER_SQL}, s as (select img, x, y, a, {_lin('r')} as lr, {_lin('g')} as lg, {_lin('b')} as lb from raster),
  o as (select ox, oy from range(0, 37) t(ox), range(0, 41) u(oy)),
  w as (select s.*, ox, oy, (least((ox + 1) * (100e0 / 37), x + 1e0) - greatest(ox * (100e0 / 37), x::double)) as wx, (least((oy + 1) * (100e0 / 41), y + 1e0) - greatest(oy * (100e0 / 41), y::double)) as wy from s join o on x < (ox + 1) * (100e0 / 37) and x + 1 > ox * (100e0 / 37) and y < (oy + 1) * (100e0 / 41) and y + 1 > oy * (100e0 / 41)),
  m as (select img, ox, oy, round(sum(lr * wx * wy) / sum(wx * wy), 12) as lr, round(sum(lg * wx * wy) / sum(wx * wy), 12) as lg, round(sum(lb * wx * wy) / sum(wx * wy), 12) as lb, round(sum(a * wx * wy) / sum(wx * wy), 9) as a from w where wx > 0 and wy > 0 group by all)
select img, cast(oy * 37 + ox as bigint) as i, {_enc('lr')} as r, {_enc('lg')} as g, {_enc('lb')} as b, cast(floor(a + 0.5) as integer) as a from m""")
def resample_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.resample_area(event_raster(spark, sf_dir), 100, 100, 37, 41).select("img", "i", "r", "g", "b", "a")


@query(f"""with {RASTER_SQL}, f as (select * from raster where (x < 3 or y < 3 or x >= 97 or y >= 97) and a >= 128),
  m as (select img, {', '.join(f'list_sort(list({c}))[count(*) // 2 + 1] as {c}' for c in 'rgb')} from f group by img)
select d.img, coalesce(printf('#%02X%02X%02X', r, g, b), '#000000') as hex from (select distinct img from raster) d left join m using (img)""")
def border_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.border_median(event_raster(spark, sf_dir), 100, 100)


# --- stencils


def _cc_sql(src: str, near: str) -> str:
    return f"""reach(img, i, root) as (select img, i, i from {src} where label is not null union select q.img, q.i, r.root from reach r join {src} p on p.img = r.img and p.i = r.i join {src} q on q.img = p.img and {near} and q.label = p.label where r.root < q.i),
  roots as (select img, i, min(root) as root from reach group by img, i), cc as (select s.*, cast(dense_rank() over (partition by s.img order by root) - 1 as integer) as comp from {src} s join roots using (img, i))"""


_N4 = "abs(q.x - p.x) + abs(q.y - p.y) = 1"
_N8 = "greatest(abs(q.x - p.x), abs(q.y - p.y)) = 1"
_CC_HAT = _cc_sql("hat", _N8)


def _square(f: str, c: str, r: int, src: str, out: str, name: str) -> str:
    return f"{name}_x as (select *, {f}({c}) over (partition by img, y order by x rows between {r} preceding and {r} following) as sq_ from {src}), {name} as (select * exclude (sq_), {f}(sq_) over (partition by img, x order by y rows between {r} preceding and {r} following) as {out} from {name}_x)"


@query(f"with {RASTER_SQL}, {_square('min', 'g', 2, 'raster', 'low', 's1')}, {_square('max', 'g', 2, 's1', 'high', 's2')} select img, i, low, high from s2")
def square_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.square_filter(stencil.square_filter(event_raster(spark, sf_dir), "g", 2, "min", "low"), "g", 2, "max", "high").select("img", "i", "low", "high")


@query(f"with {PIXELS_SQL}, {_square('max', 'ok_l', 2, 'px', 'c1', 's1')}, {_square('min', 'c1', 2, 's1', 'c2', 's2')}, {_square('min', 'ok_l', 2, 's2', 'o1', 's3')}, {_square('max', 'o1', 2, 's3', 'o2', 's4')} select img, i, round(c2 - ok_l, 6) as dark, round(ok_l - o2, 6) as light from s4")
def top_hat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.top_hat(pixels(spark, sf_dir), "ok_l", 2).select("img", "i", r6("dark", "dark"), r6("light", "light"))


@query(f"with {MASK_SQL} select p.img, p.i, cast(sum(q.\"on\") * 2 >= count(*) as integer) as major from m p join m q on q.img = p.img and abs(q.x - p.x) <= 2 and abs(q.y - p.y) <= 2 group by p.img, p.i")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.majority(high_mask(spark, sf_dir), "on", 2).select("img", "i", "major")


@query(f"with {MASK_SQL} select p.img, p.i, min(q.\"on\") as eroded from m p join m q on q.img = p.img and abs(q.x - p.x) + abs(q.y - p.y) <= 1 group by p.img, p.i")
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.erode4(high_mask(spark, sf_dir), "on").select("img", "i", "eroded")


@query(f"with {MASK_SQL} select p.img, p.i, max(q.\"on\") as dilated from m p join m q on q.img = p.img and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 group by p.img, p.i")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.dilate8(high_mask(spark, sf_dir), "on").select("img", "i", "dilated")


@query(f"with {MASK_SQL}, r as (select *, sum(\"on\") over (partition by img, y order by x) as s from m) select img, i, cast(sum(s) over (partition by img, x order by y) as bigint) as integral from r")
def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.integral_image(high_mask(spark, sf_dir), "on").select("img", "i", F.col("integral").cast("bigint").alias("integral"))


def _sobel_sql(cols: str) -> str:
    """CTE g with gx*gx + gy*gy summed over columns, by nine joins on clamped places."""
    gx = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}
    gy = {(-1, -1): -1, (0, -1): -2, (1, -1): -1, (-1, 1): 1, (0, 1): 2, (1, 1): 1}
    case = lambda w: "case " + " ".join(f"when dx = {dx} and dy = {dy} then {v}" for (dx, dy), v in w.items()) + " else 0 end"
    sums = ", ".join(f"sum(({case(gx)}) * q.{c}) as gx_{c}, sum(({case(gy)}) * q.{c}) as gy_{c}" for c in cols)
    total = " + ".join(f"gx_{c} * gx_{c} + gy_{c} * gy_{c}" for c in cols)
    return f"""k as (select img, i, x, y, dx, dy, greatest(0, least(99, x + dx)) as qx, greatest(0, least(h, y + dy)) as qy from (select *, max(y) over (partition by img) as h from px), range(-1, 2) a(dx), range(-1, 2) b(dy)),
  gs as (select k.img, k.i, {sums} from k join px q on q.img = k.img and q.x = qx and q.y = qy group by k.img, k.i), g as (select img, i, {total} as g2 from gs)"""


@query(f"with {PIXELS_SQL}, {_sobel_sql(LAB[:1])} select img, i, round(least(1, sqrt(g2) / (greatest(1e-6, max(sqrt(g2)) over (partition by img)) * 0.5)), 6) as contrast from g")
def sobel_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.contrast(pixels(spark, sf_dir)).select("img", "i", r6("contrast", "contrast"))


@query(f"with {PIXELS_SQL}, {_sobel_sql(LAB)} select img, i, g2 > 4.0 as ramp from g")
def ramp_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.ramp_mask(pixels(spark, sf_dir), threshold=0.25).select("img", "i", "ramp")


@query(f"""with {KINDS_SQL}, v as (select p.img, p.i, p.label as own, q.label as vote, count(*) as n from kinds p join kinds q on q.img = p.img and (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) <= 4 and q.label is not null where p.label is not null group by all),
  b as (select img, i, arg_max(vote, (n, cast(vote = own as integer), -vote)) as label from v group by img, i) select k.img, k.i, b.label from kinds k left join b using (img, i)""")
def mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.mode_filter(kind_labels(spark, sf_dir), 2).select("img", "i", "label")


@query(f"""with {LABELLED_SQL}, s as (select *, i % 3 = 0 as ramp from lab), c as (select distinct p.img, p.i, q.label from s p join s q on q.img = p.img and abs(q.x - p.x) <= 2 and abs(q.y - p.y) <= 2 and not q.ramp and q.label is not null where p.ramp and p.label is not null),
  m as (select p.img, p.i, min(struct_pack(d := round({_D2}, 9), j := t.ord)) as m from c join s p using (img, i) join lib t on t.ord = c.label group by p.img, p.i) select s.img, s.i, coalesce(m.m.j, s.label) as label from s left join m using (img, i)""")
def ramp_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    steep = labelled(spark, sf_dir).withColumn("ramp", F.col("i") % 3 == 0)
    return stencil.ramp_reassign(steep, palette_table(spark, sf_dir), 2).select("img", "i", "label")


@query(f"""with {PIXELS_SQL}, n as (select p.img, p.i, exp(-((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) / {2 * 1.2**2!r}::double) as ws, (p.ok_l - q.ok_l) * (p.ok_l - q.ok_l) + (p.ok_a - q.ok_a) * (p.ok_a - q.ok_a) + (p.ok_b - q.ok_b) * (p.ok_b - q.ok_b) as d2, q.ok_l, q.ok_a, q.ok_b
  from px p join px q on q.img = p.img and abs(q.x - p.x) <= 2 and abs(q.y - p.y) <= 2), w as (select *, ws * exp(-d2 / {2 * 0.3**2!r}::double) as w from n where d2 < {(4 * 0.3) ** 2!r}::double)
select img, i, round(sum(ok_l * w) / sum(w), 6) as l_ok, round(sum(ok_a * w) / sum(w), 6) as a_ok, round(sum(ok_b * w) / sum(w), 6) as b_ok from w group by img, i""")
def bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.bilateral(pixels(spark, sf_dir), LAB, 1.2, 0.3).select("img", "i", r6("ok_l", "l_ok"), r6("ok_a", "a_ok"), r6("ok_b", "b_ok"))


@query(f"""with {PIXELS_SQL}, {LIBRARY_SQL}, f as (select p.img, p.i, p.x, p.y, p.a, cast({_D2} > 0.09 as integer) as "on" from px p join lib t on t.ord = 7),
  m as (select p.img, p.i, p.x, p.y, p.a, cast(sum(q."on") * 2 >= count(*) as integer) as "on" from f p join f q on q.img = p.img and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 group by all)
select p.img, p.i, min(q."on") = 1 and p.a >= 128 as mask from m p join m q on q.img = p.img and abs(q.x - p.x) + abs(q.y - p.y) <= 1 group by p.img, p.i, p.a""")
def fabric_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloth = library(spark, sf_dir).where("ord = 7").select(*[F.col(c).alias(f"c{c}") for c in LAB])
    far = color.distance_sq((F.col("ok_l"), F.col("ok_a"), F.col("ok_b")), tuple(F.col(f"c{c}") for c in LAB)) > 0.09
    kept = stencil.erode4(stencil.majority(pixels(spark, sf_dir).join(F.broadcast(cloth)).withColumn("on", far.cast("int")), "on", 1), "major")
    return kept.select("img", "i", ((F.col("eroded") == 1) & (F.col("a") >= 128)).alias("mask"))


_KERNEL = [math.exp(-(d * d) / 2) for d in range(-3, 4)]
_KERNEL_SQL = "kern(d, k) as (values " + ", ".join(f"({d}, {k / sum(_KERNEL)!r}::double)" for d, k in zip(range(-3, 4), _KERNEL, strict=True)) + ")"


def _blur_sql(src: str, name: str, at: str) -> str:
    sums = ", ".join(f"sum(k * q.{c}) as {c}" for c in LAB)
    return f"{name} as (select p.img, p.i, p.x, p.y, p.h, {sums} from {src} p cross join kern join {src} q on q.img = p.img and {at} group by all)"


@query(f"""with {PIXELS_SQL}, {_KERNEL_SQL}, g0 as (select *, max(y) over (partition by img) as h from px), {_blur_sql('g0', 'g1', 'q.y = p.y and q.x = greatest(0, least(99, p.x + d))')}, {_blur_sql('g1', 'g2', 'q.x = p.x and q.y = greatest(0, least(p.h, p.y + d))')}
select img, i, round(ok_l, 6) as l_ok, round(ok_a, 6) as a_ok, round(ok_b, 6) as b_ok from g2""")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.gaussian(pixels(spark, sf_dir), LAB, 1.0).select("img", "i", r6("ok_l", "l_ok"), r6("ok_a", "a_ok"), r6("ok_b", "b_ok"))


@query(f"""with {RASTER_SQL}, g0 as (select *, max(y) over (partition by img) as h from raster),
  w as (select p.img, p.i, q.g from g0 p cross join range(-2, 3) a(dx) cross join range(-2, 3) b(dy) join g0 q on q.img = p.img and q.x = greatest(0, least(99, p.x + dx)) and q.y = greatest(0, least(p.h, p.y + dy)))
select img, i, round(list_sort(list(g))[13] / 255e0, 9) as median from w group by img, i""")
def local_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.median_at(event_raster(spark, sf_dir), "g", 2).select("img", "i", F.round("g", 9).alias("median"))


@query(f"""with recursive {PIXELS_SQL}, {_square('max', 'ok_l', 2, 'px', 'c1', 's1')}, {_square('min', 'c1', 2, 's1', 'c2', 's2')}, {_square('min', 'ok_l', 2, 's2', 'o1', 's3')}, {_square('max', 'o1', 2, 's3', 'o2', 's4')},
  hat as (select img, i, x, y, ok_l, c2 - ok_l as dark, ok_l - o2 as light, case when greatest(c2 - ok_l, ok_l - o2) > 0.3 then 1 end as label from s4),
  {_CC_HAT}, pk as (select *, max(greatest(dark, light)) over (partition by img, comp) as peak from cc), core as (select * from pk where greatest(dark, light) >= 0.5 * peak)
select img, comp, count(*) as core_pixels, round(avg(ok_l), 6) as lightness, sum(cast(dark >= light as integer)) * 2 >= count(*) as is_dark from core group by img, comp""")
def line_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hat = stencil.top_hat(pixels(spark, sf_dir), "ok_l", 2).withColumn("response", F.greatest("dark", "light")).withColumn("label", F.when(F.col("response") > 0.3, 1))
    hat = Rounds(spark, "hat").keep(hat.select("img", "i", "x", "y", "ok_l", "dark", "light", "response", "label"))  # read three times
    comps = graph.components(hat.select("img", "i", "x", "y", "label"), corners=True).where("comp is not null").select("img", "i", "comp")
    cores = regions.component_core(hat.join(comps, ["img", "i"]))
    return regions.component_polarity(cores).select("img", "comp", "core_pixels", r6("lightness", "lightness"), "is_dark")


# --- graph and regions


_ADJ = """sides as (select p.img, p.{c} as p, q.{c} as q from {t} p join {t} q on q.img = p.img and ((q.x = p.x + 1 and q.y = p.y) or (q.x = p.x and q.y = p.y + 1)) where p.{c} <> q.{c}),
  adj as (select img, least(p, q) as a, greatest(p, q) as b, count(*) as shared from sides group by 1, 2, 3)"""


@query(f"with {KINDS_SQL}, {_ADJ.format(c='label', t='kinds')} select * from adj")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(kind_labels(spark, sf_dir), "label")


@query(f"with recursive {KINDS_SQL}, {_cc_sql('kinds', _N4)} select k.img, k.i, cc.comp from kinds k left join cc using (img, i)")
def cc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(kind_labels(spark, sf_dir)).select("img", "i", "comp")


_DARK = "dark as (select img, i, x, y, case when \"on\" = 0 then 1 end as label from m)"


@query(f"with recursive {MASK_SQL}, {_DARK}, {_cc_sql('dark', _N8)} select img, comp, count(*) as area, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from cc group by img, comp")
def cc8(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = high_mask(spark, sf_dir).select("img", "i", "x", "y", F.when(F.col("on") == 0, 1).alias("label"))
    return regions.region_stats(graph.components(dark, corners=True)).select("img", "comp", "area", "x0", "y0", "x1", "y1")


@query(f"""with recursive {KINDS_SQL}, {_cc_sql('kinds', _N4)}, s as (select img, comp, min(label) as label, count(*) as area, round(avg(x + 0.5), 6) as cx, round(avg(y + 0.5), 6) as cy from cc group by img, comp)
select *, cast(row_number() over (partition by img order by area desc, comp) - 1 as integer) as id from s""")
def region_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = regions.area_rank(regions.region_stats(graph.components(kind_labels(spark, sf_dir))))
    return s.select("img", "comp", "label", "area", r6("cx", "cx"), r6("cy", "cy"), "id")


@query(f"""with recursive {KINDS_SQL}, {_cc_sql('kinds', _N4)}, {_ADJ.format(c='comp', t='cc')}, e as (select img, a as comp, b as other, shared from adj union all select img, b, a, shared from adj)
select img, comp, count(*) as neighbours, arg_min(other, (-shared, other)) as closest, case when count(*) = 1 then min(other) end as enclosed_by from e group by img, comp""")
def region_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.adjacency(graph.components(kind_labels(spark, sf_dir)))
    listed = graph.neighbours(edges).select("img", F.col("id").alias("comp"), F.size("neighbours").cast("bigint").alias("neighbours"), F.col("neighbours")[0]["id"].alias("closest"))
    return listed.join(regions.enclosed_by(edges), ["img", "comp"])


@query(f"""with recursive {LABELLED_SQL}, q as (select img, i, x, y, label % 3 as label from lab), {_cc_sql('q', _N4)}, {_ADJ.format(c='comp', t='cc')},
  z as (select img, comp, min(label) as label from cc group by img, comp), e as (select img, a as comp, b as other, shared from adj union all select img, b, a, shared from adj),
  d as (select e.img, e.comp, e.shared, sqrt({_D2}) as d from e join z m on m.img = e.img and m.comp = e.comp join z o on o.img = e.img and o.comp = e.other join lib p on p.ord = m.label join lib t on t.ord = o.label)
select img, comp, round(least(1, sum(d * shared) / sum(shared) / 0.25), 6) as importance from d group by img, comp""")
def region_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = graph.components(labelled(spark, sf_dir).select("img", "i", "x", "y", (F.col("label") % 3).alias("label")))
    out = regions.importance(graph.adjacency(comps), regions.region_stats(comps), palette_table(spark, sf_dir))
    return out.select("img", "comp", r6("importance", "importance"))


_EDGE_SQL = "e as (select k.*, coalesce(bool_or(n.v is distinct from k.v), false) or count(n.i) < 4 as edge from {t} k left join {t} n on n.img = k.img and abs(n.x - k.x) + abs(n.y - k.y) = 1 group by all)"
_STEPS = "min({seed} + greatest(abs(q.x - p.x), abs(q.y - p.y)) + 0.4142e0 * least(abs(q.x - p.x), abs(q.y - p.y)))"


@query(f"with {KINDS_SQL}, k as (select img, i, x, y, coalesce(label, -1) as v from kinds), {_EDGE_SQL.format(t='k')} select p.img, p.i, round({_STEPS.format(seed='0.5e0')}, 6) as dist from e p join e q on q.img = p.img and q.edge group by p.img, p.i")
def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chamfer(kind_labels(spark, sf_dir), "label").select("img", "i", r6("dist", "dist"))


@query(f"""with {MASK_SQL}, k as (select img, i, x, y, "on" as v from m), {_EDGE_SQL.format(t='k')}
select p.img, p.i, round(case when p.v = 0 then 0 else {_STEPS.format(seed='(case when q.v = 0 then 0 else 0.5e0 end)')} end, 6) as dist from e p join e q on q.img = p.img and (q.v = 0 or q.edge) group by p.img, p.i, p.v""")
def mask_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mask_distance(high_mask(spark, sf_dir)).select("img", "i", r6("dist", "dist"))


@query()
def inpaint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = kind_labels(spark, sf_dir)
    return graph.inpaint_labels(labels, labels.where("label = 0")).select("img", "i", "label")


@query()
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types' regions under six pixels absorbed, smallest first, until nothing changes."""
    left, _ = islands.merge_islands(kind_labels(spark, sf_dir), palette_table(spark, sf_dir), 6, 0.5)
    return left.select("img", "i", "label")


# --- palette


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    steep = stencil.contrast(geometry.alpha_mask(pixels(spark, sf_dir))).withColumn("ramp", F.col("i") % 5 == 0)
    return palette.samples(steep, 2, 1.45, 0.35)


_SAMPLES_SQL = f"""{PIXELS_SQL}, {_sobel_sql(LAB[:1])}, con as (select img, i, least(1, sqrt(g2) / (greatest(1e-6, max(sqrt(g2)) over (partition by img)) * 0.5)) as contrast from g),
  sam as (select img, i, ok_l, ok_a, ok_b, i % 5 = 0 as ramp, case when i % 5 = 0 then 0.35e0 else 1 + 1.45e0 * contrast end as w from px join con using (img, i) where i % 2 = 0 and a >= 128)"""


@query(f"with {_SAMPLES_SQL} select img, i, ramp, round(w, 6) as w from sam")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("img", "i", "ramp", r6("w", "w"))


@query(f"""with {_SAMPLES_SQL}, {LIBRARY_SQL}, m as (select p.img, p.i, min(struct_pack(d := round({_D2}, 9), j := t.ord)) as m from sam p join lib t on t.ord < {PALETTE} group by p.img, p.i), s as (select sam.*, m.m.j as slot from sam join m using (img, i))
select img, slot, round(sum(w), 6) as weight, round(sum(ok_l * w) / sum(w), 6) as l_ok, round(sum(ok_a * w) / sum(w), 6) as a_ok, round(sum(ok_b * w) / sum(w), 6) as b_ok, round(avg(ramp::integer), 6) as ramp_share, round(sum(w) / sum(sum(w)) over (partition by img), 6) as share from s group by img, slot""")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the weighted k-means: assignment, means, shares and halo shares."""
    means = palette.slot_means(nearest.nearest_literal(_weighted(spark, sf_dir), short_palette(spark, sf_dir), "slot"))
    return means.select("img", "slot", r6("weight", "weight"), r6("ok_l", "l_ok"), r6("ok_a", "a_ok"), r6("ok_b", "b_ok"), r6("ramp_share", "ramp_share"), r6("share", "share"))


@query(f"""with {LIBRARY_SQL}, p as (select cast(floor(ord / 32) as integer) as img, ord as idx, ord % 4 = 0 as locked, ok_l, ok_a, ok_b from lib),
  d as (select p.img, p.idx as i, t.idx as j, round(sqrt(1.96e0 * (p.ok_l - t.ok_l) * (p.ok_l - t.ok_l) + (p.ok_a - t.ok_a) * (p.ok_a - t.ok_a) + (p.ok_b - t.ok_b) * (p.ok_b - t.ok_b)), 9) as distance from p join p t on t.img = p.img and p.idx < t.idx and not (p.locked and t.locked)), m as (select img, min(struct_pack(distance := distance, i := i, j := j)) as m from d group by img)
select img, m.i as i, m.j as j, round(m.distance, 6) as distance from m""")
def closest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = library(spark, sf_dir).select(F.floor(F.col("ord") / 32).cast("int").alias("img"), F.col("ord").alias("idx"), (F.col("ord") % 4 == 0).alias("locked"), *LAB)
    return palette.closest_pair(p).select("img", "i", "j", r6("distance", "distance"))


@query()
def palette_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole palette loop on every image."""
    found = palette.merge_close(palette.extract_palettes(_weighted(spark, sf_dir), library(spark, sf_dir), 8, ("3",)), 0.05)
    return found.select("img", "idx", "number", r6("share", "share"), "locked")


# --- pattern


@query(f"""with {LABELLED_SQL}, s as (select img, label as palette_idx, count(*) as area from lab where label is not null group by all)
select img, palette_idx, cast(row_number() over (partition by img order by palette_idx) as integer) as legend_no, cast(area as bigint) as area, round(area / sum(area) over (partition by img), 6) as share from s""")
def legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to OKLab to the nearest of the palette to a legend with dense numbers and shares."""
    rows = labelled(spark, sf_dir).where("label is not null").select("img", F.col("label").alias("palette_idx"), F.lit(1).cast("bigint").alias("area"))
    return pattern.legend(rows).select("img", "palette_idx", "legend_no", "area", r6("share", "share"))


@query(f"""with {LABELLED_SQL}, {''} e as (select p.img, sqrt({_D2}) as d from lab p join lib t on t.ord = p.label) select img, round(avg(d), 6) as error from e group by img""")
def assignment_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.assignment_error(labelled(spark, sf_dir), palette_table(spark, sf_dir)).select("img", r6("error", "error"))


_STROKES_SQL = "st as (select cast(l_suppkey % 4 as integer) as img, cast(l_partkey % 30 as varchar) as number, l_quantity / 10e0 as width_px, l_extendedprice / 100e0 as length_px from lineitem)"


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    raw = li.select((F.col("l_suppkey") % 4).cast("int").alias("img"), (F.col("l_partkey") % 30).cast("string").alias("number"), (F.col("l_quantity") / 10.0).alias("width_px"), (F.col("l_extendedprice") / 100.0).alias("length_px"))
    return pattern.resolve_strokes(raw, 0.25, 0.4)


@query(f"""with {_STROKES_SQL}, s as (select img, number, case when width_px * 0.25e0 <= 1.25e0 * 0.4e0 then 'back' else 'stem' end as stitch, length_px * 0.25e0 as length_mm from st),
  g as (select img, number, stitch, count(*) as strokes, sum(length_mm) as length_mm from s group by all) select img, number, stitch, strokes, round(length_mm, 1) as length_mm from g""")
def line_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.line_legend(_strokes(spark, sf_dir)).select("img", "number", "stitch", "strokes", F.round("length_mm", 1).alias("length_mm"))


_REG_SQL = "reg as (select cast(o_custkey % 6 as integer) as img, cast(o_orderkey as integer) as id, o_totalprice / 5e4 as area_mm2, sqrt(o_totalprice) / 1e2 as radius_mm, sqrt(o_totalprice) / 10 as ring_mm, cast(o_custkey % 454 as varchar) as number, cast(o_custkey % 40 as integer) as legend_no from orders)"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, cust = F.col("o_totalprice"), F.col("o_custkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select((cust % 6).cast("int").alias("img"), F.col("o_orderkey").cast("int").alias("id"), (price / 5e4).alias("area_mm2"), (F.sqrt(price) / 100.0).alias("radius_mm"), (F.sqrt(price) / 10.0).alias("ring_mm"), (cust % 454).cast("string").alias("number"), (cust % 40).cast("int").alias("legend_no"))


@query(f"""with {_REG_SQL}, h as (select *, sqrt(pow(length(number) * {2.4 * 0.62!r}::double + {2.4 * 0.4!r}::double, 2) + pow({2.4 * 1.2!r}::double, 2)) / 2 as f, sqrt(pow(length(legend_no::varchar) * {1.9 * 0.62!r}::double + {1.9 * 0.4!r}::double, 2) + pow({1.9 * 1.2!r}::double, 2)) / 2 as x from reg where area_mm2 >= 1.5)
select img, id, case when f + 0.25 <= radius_mm then 'full' when x + 0.15 <= radius_mm then 'index' else 'leader' end as tier from h""")
def label_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.label_tiers(_regions(spark, sf_dir)).select("img", "id", "tier")


@query(f"""with {_REG_SQL}, {_STROKES_SQL}, a as (select img, count(*) as regions, sum(area_mm2) as area_mm2, sum(ring_mm) / 2 as boundary_mm from reg group by img), l as (select img, count(*) as strokes, sum(length_px * 0.25e0) as line_mm, count(distinct number) as line_threads from st group by img),
  j as (select a.img, regions, area_mm2, boundary_mm, coalesce(strokes, 0) as strokes, coalesce(line_mm, 0) as line_mm, coalesce(line_threads, 0) as line_threads from a left join l using (img)),
  s as (select *, cast(floor(round((area_mm2 / 1.05 + boundary_mm / 3 * 0.5 + line_mm / 2.5) / 50, 9) + 0.5) * 50 as bigint) as stitches from j)
select img, regions, strokes, round(area_mm2, 4) as area_mm2, round(boundary_mm, 4) as boundary_mm, stitches,
  cast(least(100, floor(round(100 * least(1, 0.35 * ln(1 + regions) / ln(401) + 0.3 * ln(1 + stitches) / ln(200001) + 0.2 * 16 / 40 + 0.15 * ln(1 + boundary_mm) / ln(5001)), 9) + 0.5) + floor(line_threads * 0.5 + 0.5)) as integer) as score from s""")
def estimate_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pattern.estimate_effort(_regions(spark, sf_dir), _strokes(spark, sf_dir), 16, 1)
    return out.select("img", "regions", "strokes", F.round("area_mm2", 4).alias("area_mm2"), F.round("boundary_mm", 4).alias("boundary_mm"), "stitches", "score")


@query()
def leader_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label places of a few hundred regions an image, leaders included."""
    rows = pattern.label_tiers(_regions(spark, sf_dir).withColumns({"radius_mm": F.col("radius_mm") / 3, "number": F.col("number")})).withColumns({"x": (F.col("id") % 97) * 2.0 + 3, "y": (F.col("id") % 89) * 2.0 + 3, "text": F.col("legend_no").cast("string")})
    return pattern.place_leaders(rows, pattern.leader_candidates(rows, 200.0, 200.0))


# --- vectors


def _edge_sql() -> str:
    return f"""{KINDS_SQL}, d as (select img, x, y, coalesce(label, -1) as me, max(y) over (partition by img, x) as h from kinds),
  v as (select p.img, p.x as x0, p.y as y0, p.x as x1, p.y + 1 as y1, coalesce(q.me, -1) as p, p.me as q from d p left join d q on q.img = p.img and q.x = p.x - 1 and q.y = p.y
        union all select img, x + 1, y, x + 1, y + 1, me, -1 from d where x = 99),
  w as (select p.img, p.x as x0, p.y as y0, p.x + 1 as x1, p.y as y1, coalesce(q.me, -1) as p, p.me as q from d p left join d q on q.img = p.img and q.x = p.x and q.y = p.y - 1
        union all select img, x, y + 1, x + 1, y + 1, me, -1 from d where y = h),
  edges as (select img, x0, y0, x1, y1, q as "left", p as "right" from v where p <> q union all select img, x0, y0, x1, y1, p as "left", q as "right" from w where p <> q)"""


@query(f"with {_edge_sql()} select * from edges")
def crack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.crack_edges(kind_labels(spark, sf_dir), "label")


@query(f"with {_edge_sql()}, e as (select img, x0 as x, y0 as y from edges union all select img, x1, y1 from edges) select img, x, y, count(*) as degree from e group by all")
def vertex_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.vertex_degrees(vector.crack_edges(kind_labels(spark, sf_dir), "label"))


_LINE_SQL = "pt as (select l_orderkey as k, l_linenumber as seq, (l_partkey % 500)::double as x, (l_suppkey * 7 % 300)::double as y from lineitem)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 300).cast("double").alias("y"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line an order: its items' places by line number, ties by place."""
    return _points(spark, sf_dir).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select("k", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("ring"))


_NEXT_SQL = f"{_LINE_SQL}, o as (select *, row_number() over w as n, count(*) over (partition by k) as c, lead(x) over w as nx, lead(y) over w as ny, first_value(x) over w as fx, first_value(y) over w as fy from pt window w as (partition by k order by seq, x, y))"


@query(f"with {_NEXT_SQL} select k, round(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2, 4) as area from o group by k")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("k", F.round(vector.signed_area(F.col("ring")), 4).alias("area"))


@query(f"with {_NEXT_SQL} select k, round(coalesce(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 0), 5) as length from o group by k")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("k", F.round(vector.polyline_length(F.col("ring")), 5).alias("length"))


_TURN = "abs(degrees(atan2((x - px) * (ny - y) - (y - py) * (nx - x) + 0e0, (x - px) * (nx - x) + (y - py) * (ny - y) + 0e0)))"  # + 0 makes -0 a 0


@query(f"""with {_LINE_SQL}, o as (select *, row_number() over w as n, count(*) over (partition by k) as c, lag(x) over w as px, lag(y) over w as py, lead(x) over w as nx, lead(y) over w as ny from pt window w as (partition by k order by seq, x, y)),
  t as (select *, n = 1 or n = c or c < 3 or coalesce({_TURN}, 0) >= 80 as stays from o),
  s as (select k, 2 * n as s, x, y from t where stays union all select k, 2 * n, x + (px - x) * 0.25e0, y + (py - y) * 0.25e0 from t where not stays union all select k, 2 * n + 1, x + (nx - x) * 0.25e0, y + (ny - y) * 0.25e0 from t where not stays),
  l as (select k, s, x, y, lead(x) over (partition by k order by s) as bx, lead(y) over (partition by k order by s) as by_ from s)
select k, cast(count(*) as integer) as points, round(coalesce(sum(sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y))), 0), 5) as length from l group by k""")
def chaikin(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = _rings(spark, sf_dir).select("k", vector.chaikin(F.col("ring")).alias("line"))
    return smooth.select("k", F.size("line").alias("points"), F.round(vector.polyline_length(F.col("line")), 5).alias("length"))


@query()
def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _points(spark, sf_dir).groupBy("k", "seq").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return vector.simplify(places, ["k"], 40.0).select("k", "seq", "x", "y")


# --- the catalogue


_ABBREVIATED = "p_name || ' Vy?Dk  ' || p_type || ' Lt Grn M'"


def _cleaned_sql() -> str:
    e = f"regexp_replace(trim({_ABBREVIATED}), '\\s+', ' ', 'g')"
    for short, full in catalogue.ABBREVIATIONS:
        e = f"regexp_replace({e}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim(regexp_replace(regexp_replace({e}, '\\?', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"select p_partkey, {_cleaned_sql()} as name from part")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", catalogue.clean_name(F.concat("p_name", F.lit(" Vy?Dk  "), "p_type", F.lit(" Lt Grn M"))).alias("name"))


@query(f"with {THREADS_SQL} select number, cast(row_number() over (order by ord * 7 % 23, ord % 5, number) - 1 as integer) as ord from threads")
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord")
    rows = part_threads(spark, sf_dir).select("number", F.concat((k * 7 % 23).cast("string"), F.lit("-"), (k % 5).cast("string")).alias("card_row"))
    return catalogue.ordered(rows).select("number", "ord")


@query(f"with {THREADS_SQL}, {_lab_sql('threads', 'lib')}, {_cielab_sql('lib', 'cie')} select number, round(cl, 5) as l_star, round(ca, 5) as a_star, round(cb, 5) as b_star, round(ok_l, 6) as l_ok, round(ok_a, 6) as a_ok, round(ok_b, 6) as b_ok from cie")
def thread_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = catalogue.build_library(part_threads(spark, sf_dir))
    return built.select("number", *[F.round(F.col("lab")[n], 5).alias(f"{n.lower()}_star") for n in "Lab"], r6("ok_l", "l_ok"), r6("ok_a", "a_ok"), r6("ok_b", "b_ok"))


# --- exports


_LEG_SQL = f"""{THREADS_SQL}, {_STROKES_SQL}, lg as (select img, number, count(*) as regions, sum(width_px) as area from st group by all),
  le as (select lg.img, lg.number, t.name, printf('#%02X%02X%02X', t.r, t.g, t.b) as hex, regions, area, area / sum(area) over (partition by lg.img) as share, cast(row_number() over (partition by lg.img order by t.ord) as integer) as legend_no from lg join threads t using (number))"""


def _legend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = part_threads(spark, sf_dir).withColumn("hex", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    rows = _strokes(spark, sf_dir).join(t.select("number", "ord"), "number").select("img", F.col("ord").alias("palette_idx"), F.col("width_px").alias("area"))
    return pattern.legend(rows).join(t.select(F.col("ord").alias("palette_idx"), "number", "name", "hex"), "palette_idx")


@query(f"""with {_LEG_SQL} select img, legend_no as no, legend_no || ',"' || replace(number, '"', '""') || '","' || replace(name, '"', '""') || '",' || hex || ',' || regions || ',' || printf('%.1f', round(area, 1)) || ',' || printf('%.4f', round(share, 4)) as line from le union all select distinct img, 0, 'legend_index,dmc,name,hex,regions,area_mm2,share' from le""")
def thread_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _legend_rows(spark, sf_dir).withColumns({"area": F.round("area", 1), "share": F.round("share", 4)})
    return export.thread_csv_file(rows)


@query(f"""with {_LEG_SQL} select img, cast(row_number() over (partition by img order by round(area, 4) desc, legend_no) as integer) as no, 'Thread ' || rpad(number, greatest(6, length(number))::integer, ' ') || ' ' || rpad(name, greatest(34, length(name))::integer, ' ') || ' ~' || cast(floor(round(share, 6) * 100 + 0.5) as integer) || '% of area, ' || regions || ' region' || case when regions = 1 then '' else 's' end as line from le
union all select distinct img, -1, 'pattern — Thread list' from le union all select distinct img, 0, '' from le
union all select img, cast(count(*) + 1 as integer), '' from le group by img union all select img, cast(count(*) + 2 as integer), count(*) || ' colours. Area shares are approximate.' from le group by img""")
def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.thread_list(_legend_rows(spark, sf_dir).withColumns({"area": F.round("area", 4), "share": F.round("share", 6)}), "pattern")


@query(f"""with {_NEXT_SQL} select k, 'M' || string_agg(cast(cast(x as bigint) as varchar) || ' ' || cast(cast(y as bigint) as varchar), 'L' order by n) || 'Z' as d from o where c >= 3 group by k""")
def svg_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("k", export.path_data(F.array("ring"), True).alias("d")).where("d <> ''")


@query("select c_custkey, replace(replace(replace(replace(c_name || ' <&> \"' || c_mktsegment || '\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped, coalesce(nullif(trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g')), ''), 'pattern') as file from customer")
def text_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", xml_escape(F.concat("c_name", F.lit(' <&> "'), "c_mktsegment", F.lit('"'))).alias("escaped"), file_name(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("file"))


@query(f"with {LABELLED_SQL} select lab.img, lab.i, coalesce(t.r, 0) as r, coalesce(t.g, 0) as g, coalesce(t.b, 0) as b, case when lab.label is null then 0 else 255 end as a from lab left join lib t on t.ord = lab.label")
def paint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = F.broadcast(part_threads(spark, sf_dir).where(F.col("ord") < PALETTE).select(F.col("ord").alias("label"), *[F.col(c).alias(f"t{c}") for c in "rgb"]))
    rows = labelled(spark, sf_dir).select("img", "i", "label").join(colours, "label", "left")
    return rows.select("img", "i", *[F.coalesce(f"t{c}", F.lit(0)).alias(c) for c in "rgb"], F.when(F.col("label").isNull(), 0).otherwise(255).alias("a"))
