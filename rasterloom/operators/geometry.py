"""Cropping, turning, resampling and masking of rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import js_round, linear_to_srgb, srgb_to_linear


def crop_rotate(raster: DataFrame, x0: int, y0: int, x1: int, y1: int, rotation: int = 0) -> DataFrame:
    """Pixels of the half-open rectangle, turned clockwise by 0, 90, 180 or 270 degrees.

    The rectangle is a plain predicate on x and y, which a parquet scan can take.
    """
    w, h = x1 - x0, y1 - y0
    x, y = F.col("x") - x0, F.col("y") - y0
    turns: dict[int, tuple[Column, Column, int]] = {0: (x, y, w), 90: (h - 1 - y, x, h), 180: (w - 1 - x, h - 1 - y, w), 270: (y, w - 1 - x, h)}
    nx, ny, width = turns[rotation % 360]
    rest = [c for c in raster.columns if c not in ("i", "x", "y")]
    inside = raster.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    return inside.select(*rest, nx.cast("int").alias("x"), ny.cast("int").alias("y")).withColumn("i", (F.col("y") * width + F.col("x")).cast("bigint"))


def resample_area(raster: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Area mean in linear light at a new size: every source pixel goes to the cells that it overlaps,
    weighted by the overlap.  The same size returns the input."""
    if (width, height) == (new_width, new_height):
        return raster
    sx, sy = width / new_width, height / new_height

    def cells(at: Column, step: float, n: int) -> Column:
        return F.explode(F.sequence(F.floor(at / F.lit(step)).cast("int"), F.least(F.lit(n - 1), F.ceil((at + 1) / F.lit(step)).cast("int") - 1)))

    def overlap(cell: Column, at: Column, step: float) -> Column:
        return F.least((cell + 1) * F.lit(step), at + F.lit(1.0)) - F.greatest(cell * F.lit(step), at.cast("double"))

    spread = raster.withColumn("ox", cells(F.col("x"), sx, new_width)).withColumn("oy", cells(F.col("y"), sy, new_height))
    wx, wy = overlap(F.col("ox"), F.col("x"), sx), overlap(F.col("oy"), F.col("y"), sy)
    weighed = spread.where((wx > 0) & (wy > 0)).withColumn("w", wx * wy)
    means = [F.sum(srgb_to_linear(F.col(c)) * F.col("w")) / F.sum("w") for c in "rgb"]
    out = weighed.groupBy("img", F.col("ox").alias("x"), F.col("oy").alias("y")).agg(*[linear_to_srgb(F.round(m, 12)).alias(c) for m, c in zip(means, "rgb", strict=True)], js_round(F.round(F.sum(F.col("a") * F.col("w")) / F.sum("w"), 9)).cast("int").alias("a"))
    return out.withColumn("i", (F.col("y") * new_width + F.col("x")).cast("bigint"))


def alpha_mask(raster: DataFrame) -> DataFrame:
    """Add mask: true where the pixel is to be worked."""
    return raster.withColumn("mask", F.col("a") >= 128)


def border_median(raster: DataFrame, width: int, height: int) -> DataFrame:
    """img, hex: the upper median of each channel over the frame of 3 % of the shorter side, from a
    grid that grows coarser with the image; black where nothing is opaque."""
    band, step = max(1, int(min(width, height) * 0.03 + 0.5)), max(1, width * height // 40000)
    frame = (F.col("x") < band) | (F.col("y") < band) | (F.col("x") >= width - band) | (F.col("y") >= height - band)
    seen = raster.where(frame & (F.col("x") % step == 0) & (F.col("y") % step == 0) & (F.col("a") >= 128))
    tall = seen.select("img", F.explode(F.map_from_arrays(F.array(F.lit("r"), F.lit("g"), F.lit("b")), F.array("r", "g", "b"))).alias("c", "v"))
    counts = tall.groupBy("img", "c", "v").agg(F.count("*").alias("n"))  # at most 256 rows a channel
    ranked = counts.groupBy("img", "c").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"), F.sum("n").alias("total"))
    at = F.floor(F.col("total") / 2)
    walk = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("v")), lambda acc, b: F.struct((acc["n"] + b["n"]).alias("n"), F.coalesce(acc["v"], F.when(acc["n"] + b["n"] > at, b["v"])).alias("v")))
    medians = ranked.select("img", "c", walk["v"].alias("v")).groupBy("img").pivot("c", ["r", "g", "b"]).agg(F.first("v"))
    code = F.concat(F.lit("#"), *[F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0") for c in "rgb"])
    return raster.select("img").distinct().join(medians, "img", "left").select("img", F.coalesce(code, F.lit("#000000")).alias("hex"))
