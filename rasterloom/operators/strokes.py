"""The line layer: strokes lifted off the picture before it is segmented, and thin regions after."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import LAB
from ..workspace import Rounds
from . import graph, regions, skeleton, stencil


def inpaint_colour(pixels: DataFrame, hole: str = "hole", columns: tuple[str, ...] = LAB, layers: int = 64) -> DataFrame:
    """Fill the columns of pixels where ``hole`` is 1 from outside: each layer takes the mean of the known among its eight
    neighbours.  A round of tiles fills sixteen layers; holes deeper than ``layers`` keep their values inside."""
    step = 16
    rounds = Rounds(pixels.sparkSession, "colours")

    def fill(planes: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        value = {c: planes[c].copy() for c in columns}
        known = there & (planes["__open"] == 0)
        for _ in range(step):
            n = sum(stencil._moved(known, dx, dy, False).astype(int) for dx, dy in skeleton.AROUND)
            now = there & ~known & (n > 0)
            if not now.any():
                break
            for c in columns:
                total = sum(stencil._moved(np.where(known, value[c], 0.0), dx, dy, 0.0) for dx, dy in skeleton.AROUND)
                value[c] = np.where(now, total / np.maximum(n, 1), value[c])
            known = known | now
        return value | {"__open": np.where(known, 0.0, 1.0)}

    now = pixels.withColumn("__open", F.coalesce(F.col(hole).cast("int"), F.lit(0)))
    left = None
    for _ in range(layers // step):
        now = rounds.keep(stencil.tiled(now, step, dict.fromkeys(columns, "double") | {"__open": "int"}, fill))
        was, left = left, now.agg(F.sum("__open")).first()[0] or 0
        if not left or left == was:
            break
    return now.drop("__open")


def rim_touch(pixels: DataFrame) -> DataFrame:
    """img, x, y, comp: outside pixels (comp null) with the components that they touch, at most the first two distinct
    ones in scan order of the three by three square around."""
    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    step = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, (dx, dy) in enumerate(around) if (dx, dy) != (0, 0)])).alias("d")
    inside = pixels.where("comp is not null").select("img", "x", "y", "comp", step)
    seen = inside.select("img", (F.col("x") - F.col("d.dx")).alias("x"), (F.col("y") - F.col("d.dy")).alias("y"), F.struct(F.col("d.n").alias("n"), "comp").alias("c"))
    outside = pixels.where("comp is null").select("img", "x", "y")
    listed = seen.groupBy("img", "x", "y").agg(F.sort_array(F.collect_list("c")).alias("all"))  # at most eight
    first = F.col("all")[0]["comp"]
    second = F.get(F.filter("all", lambda c: c["comp"] != F.col("all")[0]["comp"]), F.lit(0))["comp"]
    return listed.join(outside, ["img", "x", "y"]).select("img", "x", "y", F.explode(F.array_compact(F.array(first, second))).alias("comp"))


def _is_line(min_length: float) -> Column:
    """One or two long paths; many short ones are a cluster of specks."""
    return (F.col("longest_px") >= min_length) & (F.col("n_paths") <= 1 + F.col("length_px") / min_length)


def detect_strokes(pixels: DataFrame, max_width: float, min_length: float, contrast: float, speck_width: float) -> tuple[DataFrame, DataFrame]:
    """(strokes, pixels) of pixels(img, i, x, y, ok_*): thin marks that contrast with their ground on all sides.

    strokes: img, comp, paths, width_px, length_px, ok_*, source; components count by first pixel.  The pixels
    come back with lifted (strokes, specks and a rim of one pixel) filled from around, and feature (cores of small marks, which
    keep their boost).  A candidate answers a top-hat on lightness by more than ``contrast`` and differs from the median
    around; its core answers at least half as much as its peak.  It is left alone if its core is wider than ``max_width`` or
    less than four fifths of its rim contrast with it, and a stroke if its extent is ``min_length`` and its centre lines are those of a line; what
    is neither, and no wider than ``speck_width``, is erased.
    """
    rounds = Rounds(pixels.sparkSession, "strokes")
    hat = stencil.top_hat(pixels.select("img", "i", "x", "y", *LAB), "ok_l", max(1, math.ceil(max_width / 2))).withColumn("response", F.greatest("dark", "light"))
    grey = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(F.col("ok_l") * 255 + 0.5)))
    median = stencil.median_at(hat.withColumn("median", grey), "median", max(2, math.ceil(max_width)))
    candidate = (F.col("response") > contrast) & (F.abs(F.col("ok_l") - F.col("median")) > contrast * 0.75)
    marked = rounds.keep(median.withColumn("label", F.when(candidate, 1)))
    comps = graph.components(marked.select("img", "i", "x", "y", "label"), corners=True).select("img", "i", "comp")
    cores = rounds.keep(regions.component_core(marked.drop("label").join(comps, ["img", "i"])))
    far = graph.mask_distance(cores.select("img", "i", "x", "y", "comp", F.col("core").cast("int").alias("on"))).where("on = 1 and comp is not null").groupBy("img", "comp").agg(F.max("dist").alias("deep"))
    weight = F.col("response") * F.col("response")
    colours = cores.where("core and comp is not null").groupBy("img", "comp").agg(*[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in LAB])
    polarity = regions.component_polarity(cores.where("comp is not null"))
    rim = rim_touch(cores).join(cores.select("img", "x", "y", "ok_l"), ["img", "x", "y"]).join(polarity, ["img", "comp"])
    opposed = F.when(F.col("is_dark"), F.col("ok_l") >= F.col("lightness") + contrast * 0.5).otherwise(F.col("ok_l") <= F.col("lightness") - contrast * 0.5)
    rims = rim.groupBy("img", "comp").agg(F.count("*").alias("rim"), F.sum(opposed.cast("int")).alias("rim_ok"))
    boxes = cores.where("comp is not null").groupBy("img", "comp").agg(F.hypot(F.max("x") + 1 - F.min("x"), F.max("y") + 1 - F.min("y")).alias("extent"))
    facts = boxes.join(far, ["img", "comp"]).join(polarity.select("img", "comp", "core_pixels"), ["img", "comp"]).join(colours, ["img", "comp"]).join(rims, ["img", "comp"], "left")
    gate = F.col("deep") * 2
    gated = rounds.keep(facts.withColumn("gate", gate).withColumn("open", (gate <= max_width) & (F.coalesce("rim", F.lit(0)) == 0) | (gate <= max_width) & (F.col("rim_ok") >= F.col("rim") * 0.8)))
    long = gated.where(F.col("open") & (F.col("extent") >= min_length)).select("img", "comp", skeleton.spur_length(F.col("gate")).alias("spur"))
    paths = skeleton.skeleton_paths(cores.where("core and comp is not null").select("img", "x", "y", "comp").join(long, ["img", "comp"]), skeleton.longest_spur(max_width))
    width = F.when(F.col("length_px") > 0, F.col("core_pixels") / F.col("length_px")).otherwise(F.col("gate"))
    found = skeleton.path_measures(paths).join(gated, ["img", "comp"]).withColumn("width_px", width)
    strokes = rounds.keep(found.where(_is_line(min_length) & (F.col("width_px") <= max_width + 0.25)).select("img", "comp", "paths", "width_px", "length_px", *LAB, F.lit("image").alias("source")))
    lines = strokes.select("img", "comp", F.lit(True).alias("line"))
    fate = gated.join(lines, ["img", "comp"], "left").select("img", "comp", (F.col("open") & (F.coalesce("line", F.lit(False)) | (F.col("gate") <= speck_width))).alias("lift"), (F.col("gate") <= max_width * 1.5).alias("small"))
    told = cores.join(fate, ["img", "comp"], "left").withColumn("lift", F.coalesce("lift", F.lit(False)).cast("int")).withColumn("feature", (F.col("core") & F.coalesce("small", F.lit(False))).cast("int"))
    lifted = stencil.dilate8(told, "lift", "lifted").select("img", "i", "x", "y", *LAB, "lifted", "feature")
    return strokes, inpaint_colour(lifted, "lifted")


def lift_thin_regions(labels: DataFrame, palette: DataFrame, max_width: float, min_length: float, keep_delta: float, colours: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, strokes): regions too thin to be filled that contrast with all around become strokes.

    A region of labels(img, i, x, y, label) is lifted if its inscribed width is at most ``max_width``, its extent at least
    ``min_length``, every neighbour differs by ``keep_delta`` in palette(img, label, ok_*) and its centre lines are a line's.  Its
    pixels take the labels around.  A stroke has the mean of colours(img, i, ok_*) under it, if given, or its label's colour.
    """
    rounds = Rounds(labels.sparkSession, "thin")
    told = rounds.keep(graph.thin_parts(labels, max_width, min_length))
    parts = rounds.keep(graph.whole_parts(told, rounds).withColumnRenamed("whole", "comp"))
    measured = parts.groupBy("img", "comp").agg(F.max("deep").alias("deep"), F.hypot(F.max("x1") + 1 - F.min("x0"), F.max("y1") + 1 - F.min("y0")).alias("extent"), F.sum("area").alias("area"), F.first("label").alias("label"))
    gate = F.col("deep") * 2
    slim = measured.join(palette.select("img", "label", *LAB), ["img", "label"]).withColumn("gate", gate).where((F.col("gate") <= max_width) & (F.col("extent") >= min_length))
    beside = parts.select("img", "comp", F.explode(F.array_distinct(F.transform("rim", lambda p: p["label"]))).alias("label")).distinct()  # neighbours of a component have other labels
    other = palette.select("img", "label", *[F.col(c).alias(f"o{c}") for c in LAB])
    d = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in LAB), F.lit(0.0)))
    near = slim.select("img", "comp", *LAB).join(beside, ["img", "comp"]).join(other, ["img", "label"]).groupBy("img", "comp").agg(F.min(d).alias("nearest"))
    chosen = rounds.keep(slim.join(near, ["img", "comp"]).where(F.col("nearest") >= keep_delta))
    mask = parts.join(chosen.select("img", "comp", skeleton.spur_length(F.col("gate")).alias("spur")), ["img", "comp"]).select("img", "comp", "spur", F.inline("pixels"))
    found = skeleton.path_measures(skeleton.skeleton_paths(mask, skeleton.longest_spur(max_width))).join(chosen, ["img", "comp"]).withColumn("width_px", F.col("area") / F.col("length_px"))
    lines = rounds.keep(found.where(_is_line(min_length) & (F.col("width_px") <= max_width + 0.25)).select("img", "comp", "paths", "width_px", "length_px", *LAB, F.lit("region").alias("source")))
    lifted = parts.join(lines.select("img", "comp"), ["img", "comp"])
    under = rounds.keep(lifted.select("img", "comp", F.inline("pixels")))
    if colours is not None:
        mean = under.join(colours.select("img", "i", *LAB), ["img", "i"]).groupBy("img", "comp").agg(*[F.avg(c).alias(c) for c in LAB])
        lines = lines.drop(*LAB).join(mean, ["img", "comp"]).select("img", "comp", "paths", "width_px", "length_px", *LAB, "source")
    # holes and the pixels beside them are all that filling reads
    at = ["img", "x", "y"]
    holes = under.select(*at)
    rim = lifted.select("img", F.inline("rim")).distinct().join(holes, at, "left_anti")
    label = dict(labels.dtypes)["label"]
    gaps = holes.select(*at, F.lit(None).cast(label).alias("label"), F.lit(1).alias("hole")).unionByName(rim.select(*at, "label", F.lit(0).alias("hole")))
    taken = graph.fill_labels(rounds.keep(gaps.withColumn("gap", F.col("hole") == 1)), rounds).where("gap").select(*at, F.col("label").alias("taken"), "gap")
    left = labels.select("img", "i", "x", "y", "label").join(taken, at, "left").withColumn("label", F.when(F.col("gap"), F.col("taken")).otherwise(F.col("label")))
    # components count from 0 by first pixel
    roots = told.where("root is null").select("img", F.explode("roots").alias("comp")).unionAll(parts.where("open").select("img", "comp").distinct())
    order = roots.withColumn("number", F.row_number().over(Window.partitionBy("img").orderBy("comp")) - 1)
    lines = lines.join(order, ["img", "comp"]).select("img", F.col("number").cast("int").alias("comp"), *[c for c in lines.columns if c not in ("img", "comp")])
    return left.select("img", "i", "x", "y", "label"), lines
