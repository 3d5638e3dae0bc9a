"""Regions of a raster: measures, rank, neighbours and what encloses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import LAB
from .graph import adjacency, neighbours
from .stencil import across, down


def area_rank(sizes: DataFrame) -> DataFrame:
    """Add id: 0 for the largest area of an image, equal areas by component."""
    return sizes.withColumn("id", F.row_number().over(Window.partitionBy("img").orderBy(F.desc("area"), "comp")).cast("int") - 1)


def region_stats(pixels: DataFrame) -> DataFrame:
    """img, comp, label, area, centre, box (x1, y1 exclusive) and, if there is dist, the pole: the pixel
    farthest from the border, the first of equals."""
    measures = [F.min("label").alias("label"), F.count("*").alias("area"), (F.sum(F.col("x") + 0.5) / F.count("*")).alias("cx"), (F.sum(F.col("y") + 0.5) / F.count("*")).alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1")]
    if "dist" in pixels.columns:
        measures.append(F.max(F.struct("dist", (-F.col("i")).alias("o"), "x", "y")).alias("pole"))
    out = pixels.where("comp is not null").groupBy("img", "comp").agg(*measures)
    if "dist" in pixels.columns:
        out = out.withColumns({"pole_x": F.col("pole.x") + 0.5, "pole_y": F.col("pole.y") + 0.5, "radius_px": F.col("pole.dist")}).drop("pole")
    return out


def importance(edges: DataFrame, sizes: DataFrame, palette: DataFrame) -> DataFrame:
    """img, comp, importance: colour contrast to the neighbours, weighted by shared sides, over 0.25, at most 1."""
    coloured = sizes.select("img", "comp", "label").join(palette, ["img", "label"])
    both = edges.select("img", F.col("a").alias("comp"), F.col("b").alias("other"), "shared").unionAll(edges.select("img", F.col("b").alias("comp"), F.col("a").alias("other"), "shared"))
    mine = coloured.select("img", "comp", *[F.col(c).alias(f"m{c}") for c in LAB])
    other = coloured.select("img", F.col("comp").alias("other"), *LAB)
    d = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in LAB), F.lit(0.0)))
    mean = F.sum(d * F.col("shared")) / F.sum("shared")
    return both.join(mine, ["img", "comp"]).join(other, ["img", "other"]).groupBy("img", "comp").agg(F.least(F.lit(1.0), mean / 0.25).alias("importance"))


def enclosed_by(edges: DataFrame) -> DataFrame:
    """img, comp, enclosed_by: the one neighbour of a region that has exactly one."""
    n = neighbours(edges)
    return n.select("img", F.col("id").alias("comp"), F.when(F.size("neighbours") == 1, F.col("neighbours")[0]["id"]).alias("enclosed_by"))


def region_graph(pixels: DataFrame, palette: DataFrame, mm_per_px: float) -> DataFrame:
    """Everything about each region in one row, ids by area."""
    stats, edges = region_stats(pixels), adjacency(pixels)
    out = area_rank(stats).join(importance(edges, stats, palette), ["img", "comp"], "left").join(enclosed_by(edges), ["img", "comp"], "left")
    return out.withColumn("area_mm2", F.col("area") * (mm_per_px * mm_per_px)).withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def outline_sides(pixels: DataFrame) -> DataFrame:
    """img, comp, sides: pixel sides of each region that face another region, the mask or the border."""
    here = F.col("comp")
    faces = [F.when(F.coalesce(f("comp").over(w) == here, F.lit(False)), 0).otherwise(1) for w in (across(), down()) for f in (F.lag, F.lead)]
    counted = pixels.select("img", "comp", sum(faces[1:], faces[0]).alias("n"))
    return counted.where("comp is not null").groupBy("img", "comp").agg(F.sum("n").alias("sides"))


def component_core(pixels: DataFrame) -> DataFrame:
    """Add peak, the largest response of the pixel's component, and core: at least half of it."""
    peaks = pixels.where("comp is not null").groupBy("img", "comp").agg(F.max("response").alias("peak"))
    return pixels.join(peaks, ["img", "comp"], "left").withColumn("core", F.coalesce(F.col("response") >= 0.5 * F.col("peak"), F.lit(False)))


def component_polarity(pixels: DataFrame) -> DataFrame:
    """img, comp, core_pixels, lightness (mean of the core), is_dark (most core pixels answer darker than
    lighter) of pixels(img, comp, core, ok_l, dark, light)."""
    votes = F.sum((F.col("dark") >= F.col("light")).cast("int"))
    by = pixels.where("core").groupBy("img", "comp").agg(F.count("*").alias("core_pixels"), F.avg("ok_l").alias("lightness"), votes.alias("votes"))
    return by.withColumn("is_dark", F.col("votes") * 2 >= F.col("core_pixels")).drop("votes")
