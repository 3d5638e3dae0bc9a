"""Text exports: shopping list, CSV and SVG, one line a row so that Spark's text writer can take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pad_end, two_decimals, xml_escape


def thread_text(legend: DataFrame, library: str = "Thread") -> DataFrame:
    """img, no, line: the shopping list of legend(img, number, name, regions, area, share), largest first."""
    plural = F.when(F.col("regions") == 1, "").otherwise("s")
    percent = F.floor(F.col("share") * 100 + 0.5).cast("string")
    line = F.concat(F.lit(library + " "), pad_end(F.col("number"), 6), F.lit(" "), pad_end(F.col("name"), 34), F.lit(" ~"), percent, F.lit("% of area, "), F.col("regions").cast("string"), F.lit(" region"), plural)
    return legend.select("img", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("area"), "legend_no")).alias("no"), line.alias("line"))


def thread_list(legend: DataFrame, project: str, library: str = "Thread") -> DataFrame:
    """img, no, line: the whole list with its title above (from no -1) and the number of colours below."""
    rows = thread_text(legend, library)
    total = rows.groupBy("img").agg(F.max("no").alias("n"))
    head = total.select("img", F.explode(F.array(F.struct(F.lit(-1).alias("no"), F.lit(f"{project} — {library} list").alias("line")), F.struct(F.lit(0).alias("no"), F.lit("").alias("line")))).alias("r"))
    foot = total.select("img", F.explode(F.array(F.struct((F.col("n") + 1).alias("no"), F.lit("").alias("line")), F.struct((F.col("n") + 2).alias("no"), F.concat(F.col("n").cast("string"), F.lit(" colours. Area shares are approximate.")).alias("line")))).alias("r"))
    return rows.unionByName(head.unionAll(foot).select("img", "r.no", "r.line"))


#: Fixed value: the header of the CSV.
CSV_HEADER = "legend_index,dmc,name,hex,regions,area_mm2,share"


def thread_csv_file(legend: DataFrame) -> DataFrame:
    """img, no, line: the CSV rows under the header (no 0)."""
    return thread_csv(legend).unionByName(legend.select("img").distinct().select("img", F.lit(0).alias("no"), F.lit(CSV_HEADER).alias("line")))


def csv_field(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def thread_csv(legend: DataFrame) -> DataFrame:
    """img, no, line: CSV rows in legend order, quotes doubled."""
    line = F.concat_ws(",", F.col("legend_no").cast("string"), csv_field(F.col("number")), csv_field(F.col("name")), "hex", F.col("regions").cast("string"), F.format_string("%.1f", F.col("area").cast("double")), F.format_string("%.4f", "share"))
    return legend.select("img", F.col("legend_no").alias("no"), line.alias("line"))


def path_data(lines: Column, closed: bool) -> Column:
    """SVG path data of array<array<struct<x, y>>>; rings of fewer than three points are left out."""
    kept = F.filter(lines, lambda p: F.size(p) >= 3) if closed else lines
    one = F.transform(kept, lambda p: F.concat(F.lit("M"), F.array_join(F.transform(p, lambda q: F.concat(two_decimals(q["x"]), F.lit(" "), two_decimals(q["y"]))), "L"), F.lit("Z" if closed else "")))
    return F.array_join(one, "")


def outline_width(strength: float) -> float:
    return 0.08 + 0.32 * strength


def svg_document(shapes: DataFrame, width_mm: float, height_mm: float) -> DataFrame:
    """img, svg from shapes(img, layer, ord, path, fill, stroke, stroke_width, text, x, y): paths and texts in
    the order of layer and ord.  An image's document is one string, as the format asks."""
    style = F.concat(F.lit('" fill="'), F.coalesce("fill", F.lit("none")), F.when(F.col("stroke").isNotNull(), F.concat(F.lit('" stroke="'), F.col("stroke"), F.lit('" stroke-width="'), two_decimals(F.col("stroke_width")))).otherwise(""))
    path = F.concat(F.lit('<path d="'), "path", style, F.lit('"/>'))
    text = F.concat(F.lit('<text x="'), two_decimals(F.col("x")), F.lit('" y="'), two_decimals(F.col("y")), F.lit('">'), xml_escape(F.col("text")), F.lit("</text>"))
    rows = shapes.select("img", F.struct("layer", "ord", F.when(F.col("path").isNotNull(), path).otherwise(text).alias("s")).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"]), "\n")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width_mm:g}mm" height="{height_mm:g}mm" viewBox="0 0 {width_mm:g} {height_mm:g}">\n'
    return rows.groupBy("img").agg(F.concat(F.lit(head), body, F.lit("\n</svg>")).alias("svg"))
