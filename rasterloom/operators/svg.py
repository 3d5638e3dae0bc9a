"""The printed plan as SVG, one row a line: as many pages as there are images, in one plan.

A page is the union of its layers; every layer is a projection of the table that it draws, and only counts and the
legends (palette-sized) are aggregated.  Written in the order of (layer, ord), a page's lines are its document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import rgb_to_hex, tint
from ..functions.text import two_decimals, xml_escape
from .export import outline_width
from .pattern import CHAR_WIDTH, FULL_FONT, INDEX_FONT

# Margins and rows of the page in millimetres, ink colours, the least width of a drawn stroke.
MARGIN_MM, LEGEND_MM, FOOT_MM, ROW_MM = 8, 58, 10, 5.2
INK, GREY, HATCH, FRAME = "#1a1a1a", "#888", "#bbb", "#333"
LEAST_STROKE_MM = 0.3
STYLE = "text{font-family:Helvetica,Arial,sans-serif;font-weight:600;text-anchor:middle;dominant-baseline:central;fill:#111}.legend text{text-anchor:start}"
PLAIN = "font-weight:400"
# Layers in the order of drawing; those with many rows have places of their own.
SHEET, REGIONS, STROKES, LABELS, FOOT, LEGEND, LINE_LEGEND, END = range(0, 80, 10)


@dataclass(frozen=True)
class Page:
    """What does not differ between the images of a run."""

    width_mm: float
    height_mm: float
    mm_per_px: float
    project: str = "pattern"
    library: str = "Thread"
    mode: str = "pattern"  # or "color": filled regions without outlines and labels
    labels: bool = True
    legend: bool = True
    outline: float = 0.5
    fabric: str | None = None
    hoop: tuple[float, ...] | None = None  # a diameter, or width and height
    namespace: str = "urn:stitching-plan:1"

    @property
    def margin(self) -> int:
        """Room around the artwork, wider where the hoop is larger than it."""
        over = 0.0
        if self.hoop:
            wide, high = (self.hoop * 2)[:2]
            over = max(0.0, (wide - self.width_mm) / 2, (high - self.height_mm) / 2)
        return MARGIN_MM + int(-(-over // 1))


def _value(v: object) -> Column:
    """An attribute or text: columns of numbers with two decimals, of strings escaped, and constants likewise."""
    if isinstance(v, Column):
        return v
    if isinstance(v, float | int):
        return two_decimals(F.lit(float(v)))
    return xml_escape(F.lit(v))


def mm(c: Column) -> Column:
    return two_decimals(c.cast("double"))


def tag(name: str, body: Column | str | None = None, /, **attributes: object) -> Column:
    """An element; an underscore in a name stands for a hyphen, one at its end for nothing, attributes that are None go."""
    parts = [F.lit(f"<{name}")]
    for key, v in attributes.items():
        if v is not None:
            parts += [F.lit(f' {key.rstrip("_").replace("_", "-")}="'), _value(v), F.lit('"')]
    return F.concat(*parts, *([F.lit("/>")] if body is None else [F.lit(">"), _value(body), F.lit(f"</{name}>")]))


def opening(name: str, **attributes: object) -> Column:
    return F.regexp_replace(tag(name, **attributes), "/>$", ">")


def path_of(points: Column, closed: bool) -> Column:
    """The path data of lines: array<array<struct<x, y>>>."""
    point = F.transform(points, lambda line: F.concat(F.lit("M"), F.array_join(F.transform(line, lambda q: F.concat(mm(q["x"]), F.lit(" "), mm(q["y"]))), "L"), F.lit("Z" if closed else "")))
    return F.array_join(point, "")


def _facts(images: DataFrame, counted: dict[str, DataFrame | None]) -> DataFrame:
    """images with the number of rows that each table has for them."""
    for name, table in counted.items():
        if table is None:
            images = images.withColumn(name, F.lit(0).cast("bigint"))
        else:
            images = images.join(table.groupBy("img").agg(F.count("*").alias(name)), "img", "left").fillna(0, [name])
    return images


def _metadata(page: Page, images: DataFrame, legend: DataFrame, line_legend: DataFrame | None, effort: DataFrame | None) -> DataFrame:
    """img, json: what the page says of itself; the legends are lists of palette size."""
    def listed(table: DataFrame, order: str, name: str, *fields: Column) -> DataFrame:
        return table.groupBy("img").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*fields).alias("row")))), lambda e: e["row"]).alias(name))

    out = images.join(listed(legend, "legend_no", "legend", F.col("legend_no").alias("index"), F.col("number").alias("dmc"), "name", "hex", "regions", F.round("area", 1).alias("areaMm2")), "img", "left")
    lines = F.array()
    if line_legend is not None:
        out = out.join(listed(line_legend, "line_no", "lines", F.col("number").alias("dmc"), "name", "hex", "stitch", "strokes", F.round("length_mm", 1).alias("lengthMm")), "img", "left")
        lines = F.col("lines")
    estimates = F.lit(None).cast("string")
    if effort is not None:
        out = out.join(effort.select("img", F.struct(*[c for c in effort.columns if c != "img"]).alias("estimates")), "img", "left")
        estimates = F.col("estimates")
    fields = {"project": page.project, "widthMm": float(page.width_mm), "heightMm": float(page.height_mm), "mmPerPx": float(page.mm_per_px), "mode": page.mode, "fabric": page.fabric}
    record = F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], F.coalesce("legend", F.array()).alias("legend"), lines.alias("lines"), estimates.alias("estimates"))
    return out.select("img", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def svg_lines(page: Page, images: DataFrame, regions: DataFrame, legend: DataFrame, strokes: DataFrame | None = None, line_legend: DataFrame | None = None, places: DataFrame | None = None, effort: DataFrame | None = None) -> DataFrame:
    """img, layer, ord, line of the pages of images(img).

    regions(img, id, rings, palette_idx, number, name, r, g, b, area_mm2) and strokes(img, id, paths, number, name, hex,
    stitch, width_mm, length_mm) are in pixels; legend(img, palette_idx, legend_no, number, name, hex, regions, area),
    line_legend(img, line_no, number, name, hex, stitch, strokes, length_mm) and places(img, id, tier, text, x, y, from_x,
    from_y) in millimetres.  Images without rows of a table have a page without that layer's rows.  Null names are empty.
    """
    w, h, s, margin, colour = float(page.width_mm), float(page.height_mm), page.mm_per_px, page.margin, page.mode == "color"
    facts = _facts(images.select("img").distinct(), {"regions": regions, "colours": legend, "strokes": strokes, "line_rows": line_legend})
    rows = F.col("colours") + F.when(F.col("line_rows") > 0, F.col("line_rows") + 1).otherwise(0)
    tall = F.lit(h + 2 * margin + FOOT_MM)
    if page.legend:
        tall = F.greatest(tall, rows * ROW_MM + 2 * margin + 6)
    wide = w + 2 * margin + (LEGEND_MM if page.legend else 0)
    facts = facts.withColumn("tall", tall)
    group = {"transform": f"scale({s:g})"}

    def once(layer: int, *lines: Column) -> DataFrame:
        """Lines that every page has; null ones are left out."""
        each = F.posexplode(F.array(*lines)).alias("ord", "line")
        return facts.select("img", F.lit(layer).alias("layer"), each).where("line is not null").select("img", "layer", F.col("ord").cast("bigint").alias("ord"), "line")

    def many(table: DataFrame, layer: int, order: str, line: Column) -> DataFrame:
        return table.select("img", F.lit(layer).alias("layer"), F.col(order).cast("bigint").alias("ord"), line.alias("line"))

    def text(column: str) -> Column:
        return xml_escape(F.coalesce(F.col(column).cast("string"), F.lit("")))

    cloth = F.lit(None).cast("string")
    if page.fabric:
        bare = tag("pattern", tag("path", d="M0 2L2 0", stroke=HATCH, stroke_width=0.12), id="bare", width=2, height=2, patternUnits="userSpaceOnUse")
        cloth = F.concat(F.lit("") if colour else tag("defs", bare), tag("rect", id="fabric", width=w, height=h, fill=page.fabric if colour else "url(#bare)", data_fabric=page.fabric))
    head = opening("svg", xmlns="http://www.w3.org/2000/svg", **{"xmlns:plan": page.namespace}, width=F.lit(f"{wide:g}mm"), height=F.concat(mm(F.col("tall")), F.lit("mm")), viewBox=F.concat(F.lit(f"0 0 {wide:g} "), mm(F.col("tall"))))
    meta = _metadata(page, facts.select("img"), legend, line_legend, effort)
    layers = [
        once(SHEET, F.lit('<?xml version="1.0" encoding="UTF-8"?>'), head, tag("title", f"{page.project} — pattern")),
        many(meta.withColumn("at", F.lit(0)), SHEET + 1, "at", tag("metadata", tag("plan:project", xml_escape(F.col("json"))))),
        once(SHEET + 2, tag("style", F.lit(STYLE)), tag("rect", width=wide, height=mm(F.col("tall")), fill="#fff"), opening("g", id="artwork", transform=f"translate({margin} {margin})"), cloth),
        once(REGIONS, opening("g", id="regions", fill_rule="evenodd", stroke_linejoin="round", **group)),
        once(REGIONS + 2, F.lit("</g>")),
        once(FOOT, *_foot(page), F.lit("</g>")),
        once(END, F.lit("</svg>")),
    ]
    named = regions.join(legend.select("img", "palette_idx", "legend_no"), ["img", "palette_idx"], "left")
    fill = rgb_to_hex(*[F.col(c) for c in "rgb"]) if colour else F.concat(F.lit("rgb("), F.concat_ws(",", *[tint(F.col(c)).cast("string") for c in "rgb"]), F.lit(")"))
    ident = F.col("id").cast("string")
    shape = tag("path", id=F.concat(F.lit("region-"), ident), d=path_of(F.filter("rings", lambda r: F.size(r) >= 3), True), fill=fill, stroke="none" if colour else INK, stroke_width=outline_width(page.outline) / s, data_region=ident, data_dmc=text("number"), data_name=text("name"), data_area_mm2=mm(F.col("area_mm2")), data_legend=text("legend_no"))
    layers.append(many(named, REGIONS + 1, "id", shape))
    if strokes is not None:
        some = F.col("strokes") > 0
        layers.append(once(STROKES, F.when(some, opening("g", id="lines", fill="none", stroke_linecap="round", stroke_linejoin="round", **group))))
        line = tag("path", id=F.concat(F.lit("line-"), ident), d=path_of(F.col("paths"), False), stroke=F.col("hex"), stroke_width=mm(F.greatest(F.col("width_mm"), F.lit(LEAST_STROKE_MM)) / s), data_line=ident, data_dmc=text("number"), data_name=text("name"), data_stitch=F.col("stitch"), data_width_mm=mm(F.col("width_mm")), data_length_mm=mm(F.col("length_mm")))
        layers += [many(strokes, STROKES + 1, "id", line), once(STROKES + 2, F.when(some, F.lit("</g>")))]
    if places is not None and page.labels and not colour:
        layers += [once(LABELS, opening("g", id="labels")), many(places.where("tier <> 'none'"), LABELS + 1, "id", _label()), once(LABELS + 2, F.lit("</g>"))]
    if page.legend:
        layers += _legends(page, once, many, text, legend, line_legend)
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionAll(layer)
    return out


def _label() -> Column:
    """A label; one that is led out of its region has a line to it, a dot and a box."""
    led = F.col("tier") == "leader"
    font = F.when(F.col("tier") == "full", FULL_FONT).otherwise(INDEX_FONT)
    half = F.length("text") * font * (CHAR_WIDTH / 2)
    x, y, fx, fy = (F.col(c) for c in ("x", "y", "from_x", "from_y"))
    lead = F.concat(tag("line", x1=mm(fx), y1=mm(fy), x2=mm(x), y2=mm(y), stroke=INK, stroke_width=0.12), tag("circle", cx=mm(fx), cy=mm(fy), r=0.25, fill=INK))
    box = tag("rect", x=mm(x - half - 0.3), y=mm(y - font * 0.6), width=mm(2 * half + 0.6), height=mm(font * 1.2), fill="#fff", stroke=INK, stroke_width=0.1)
    words = tag("text", xml_escape(F.col("text")), class_=F.when(F.col("tier") == "full", "dmc").otherwise("idx"), x=mm(x), y=mm(y), font_size=mm(font), data_region=F.col("id").cast("string"))
    return F.concat(F.when(led & fx.isNotNull(), lead).otherwise(""), F.when(led, box).otherwise(""), words)


def _foot(page: Page) -> list[Column]:
    """Hoop, scale bar and dimensions, below and around the artwork."""
    w, h = float(page.width_mm), float(page.height_mm)
    out = []
    dashed = {"fill": "none", "stroke": GREY, "stroke_width": 0.2, "stroke_dasharray": "1.2 0.8"}
    if page.hoop and len(page.hoop) == 1:
        out.append(tag("circle", id="hoop", cx=w / 2, cy=h / 2, r=page.hoop[0] / 2, **dashed))
    elif page.hoop:
        out.append(tag("rect", id="hoop", x=(w - page.hoop[0]) / 2, y=(h - page.hoop[1]) / 2, width=page.hoop[0], height=page.hoop[1], **dashed))
    bar = next(length for least, length in ((100, 50), (40, 20), (0, 10)) if w >= least)
    y = h + 5
    strokes = [tag("line", x1=a, y1=b, x2=c, y2=d, stroke="#111", stroke_width=0.25) for a, b, c, d in ((0, y, bar, y), (0, y - 1, 0, y + 1), (bar, y - 1, bar, y + 1))]
    lines = F.when(F.col("strokes") > 0, F.concat(F.lit(" · "), F.col("strokes").cast("string"), F.lit(" lines"))).otherwise("")
    said = F.concat(mm(F.lit(w)), F.lit(" × "), mm(F.lit(h)), F.lit(" mm · "), F.col("regions").cast("string"), F.lit(" regions · "), F.col("colours").cast("string"), F.lit(" colours"), lines, xml_escape(F.lit(f" · fabric {page.fabric}" if page.fabric else "")))
    out.append(F.concat(opening("g", id="scale"), *strokes, tag("text", f"{bar} mm", x=bar / 2, y=y + 2.6, font_size=2.2), tag("text", said, x=w / 2, y=y + 2.6, font_size=2.2, style=PLAIN), F.lit("</g>")))
    return out


def _legends(page, once, many, text, legend: DataFrame, line_legend: DataFrame | None) -> list[DataFrame]:
    """Beside the artwork: a row a colour, and below them a row a line of the line legend."""
    maker = page.library + " "
    y = F.lit(5.0) + (F.col("legend_no") - 1) * ROW_MM
    row = F.concat(
        tag("rect", x=0, y=mm(y - 2), width=4, height=4, fill=F.col("hex"), stroke=FRAME, stroke_width=0.1), tag("text", text("legend_no"), x=5.5, y=mm(y), font_size=2.1),
        tag("text", F.concat(xml_escape(F.lit(maker)), text("number")), x=10, y=mm(y), font_size=2.1), tag("text", text("name"), x=22, y=mm(y), font_size=1.8, style=PLAIN),
    )
    head = opening("g", id="legend", class_="legend", transform=f"translate({page.width_mm + 2 * page.margin:g} {page.margin})")
    out = [once(LEGEND, head, tag("text", page.project, x=0, y=0, font_size=2.6)), many(legend, LEGEND + 1, "legend_no", row), once(LINE_LEGEND + 2, F.lit("</g>"))]
    if line_legend is not None:
        top = F.col("colours") * ROW_MM + 7
        colours = legend.groupBy("img").agg(F.count("*").alias("colours"))
        lines = line_legend.join(colours, "img", "left").fillna(0, ["colours"])
        at = mm(top + F.col("line_no") * ROW_MM)
        said = F.concat(F.col("stitch"), F.lit(" stitch · "), F.floor(F.col("length_mm") + 0.5).cast("string"), F.lit(" mm"))
        row = F.concat(
            tag("line", x1=0, y1=at, x2=4, y2=at, stroke=F.col("hex"), stroke_width=0.8, stroke_linecap="round"), tag("text", F.concat(xml_escape(F.lit(maker)), text("number")), x=5.5, y=at, font_size=2.1),
            tag("text", said, x=19, y=at, font_size=1.8, style=PLAIN),
        )
        out += [once(LINE_LEGEND, F.when(F.col("line_rows") > 0, tag("text", "Lines", x=0, y=mm(top), font_size=2.2))), many(lines, LINE_LEGEND + 1, "line_no", row)]
    return out


def write_svg(lines: DataFrame, path: str) -> None:
    """A folder an image (img=...), whose one text file is its document; a page is sorted in the task that writes it."""
    lines.repartition("img").sortWithinPartitions("img", "layer", "ord").select("img", F.col("line").alias("value")).write.partitionBy("img").mode("overwrite").text(path)
