"""From a raster to a plan in stages, each a DataFrame; stages whose inputs did not change are reused."""

from __future__ import annotations

import json
import time
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..operators import geometry, graph, islands, nearest, outline, palette, pattern, regions, stencil, strokes, svg, vector
from ..functions.color import LAB
from ..workspace import Rounds
from . import params as P


class Plan:
    """Runs the stages for all images of a raster and keeps each stage's table by the key of all it depends on."""

    def __init__(self, raster: DataFrame, width: int, height: int, library: DataFrame):
        self.raster, self.width, self.height, self.library = raster, width, height, library
        self.rounds = Rounds(raster.sparkSession, "plan")
        self.kept: dict[str, tuple[str, Any]] = {}
        self.timings: dict[str, float] = {}

    def _stage(self, name: str, key: Any, make: Any) -> Any:
        text = json.dumps(key, sort_keys=True)
        if name not in self.kept or self.kept[name][0] != text:
            began = time.perf_counter()
            made = make()
            self.kept[name] = text, self.rounds.keep(made) if isinstance(made, DataFrame) else made
            self.timings[name] = time.perf_counter() - began
        return self.kept[name][1]

    def run(self, settings: P.Settings) -> dict[str, Any]:
        self.timings = {}
        s = P.preset_settings(settings)
        p = P.derive(s)
        w, h, mm = P.working_resolution(s, p.px_per_mm)
        size = [w, h]
        small = self._stage("resample", size, lambda: geometry.resample_area(self.raster, self.width, self.height, w, h))
        grade = [*size, s.hue, s.saturation, s.lightness]

        def coloured() -> DataFrame:
            r, g, b = color.adjust(F.col("r"), F.col("g"), F.col("b"), s.hue, s.saturation, s.lightness)
            return geometry.alpha_mask(small.withColumns({"r": r, "g": g, "b": b})).withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))

        graded = self._stage("grade", grade, coloured)
        line = [p.line_max_mm / mm, p.line_min_mm / mm, p.line_contrast, p.speck_mm / mm]
        marks, lifted = self._stage("lines", [grade, line], lambda: strokes.detect_strokes(graded, *line))

        def working() -> DataFrame:
            """Contrast, ramps and the blur of the picture without its strokes; marks and what was lifted are no ramps."""
            without = lifted.join(graded.select("img", "i", "mask"), ["img", "i"]).withColumn("marked", F.greatest("lifted", "feature"))
            return stencil.bilateral(stencil.ramp_mask(stencil.contrast(without), feature="marked"), LAB, p.blur_mm / mm)

        prepared = self._stage("prepare", [grade, line, p.blur_mm], working)
        stride = max(1, w * h // 60_000)
        look = [grade, line, p.blur_mm, s.thread_count, p.contrast_weight, p.merge_delta, p.lightness_weight, list(s.locked)]
        chosen = self._stage("palette", look, lambda: palette.merge_close(palette.extract_palettes(palette.samples(prepared, stride, p.contrast_weight, p.ramp_weight), self.library, s.thread_count, s.locked, p.halo), p.merge_delta, p.lightness_weight))
        table = chosen.select("img", F.col("idx").alias("label"), *LAB)
        min_area = max(1, int(p.min_area_mm2 / (mm * mm)))

        def segment() -> DataFrame:
            labelled = palette.nearest_slot(prepared, table, "label", "label")
            labelled = stencil.ramp_reassign(labelled, table)
            labelled = stencil.mode_filter(labelled.select("img", "i", "x", "y", "label"), max(0, min(6, int(p.mode_radius_mm / mm + 0.5))))
            return islands.merge_islands(labelled, table, min_area, p.keep_delta, p.max_regions)[0]

        shape = [look, min_area, p.mode_radius_mm, p.keep_delta, p.max_regions]
        merged = self._stage("segment", shape, segment)
        clean, thin = self._stage("thin", shape, lambda: strokes.lift_thin_regions(merged, table, line[0], line[1], p.keep_delta, prepared))
        pixels = self._stage("regions", shape, lambda: graph.chamfer(graph.components(clean)))
        graph_rows = self._stage("graph", shape, lambda: regions.region_graph(pixels, table, mm))
        rings = self._stage("outlines", [shape, p.simplify_mm, p.smoothing, p.corner_degrees], lambda: outline.vectorize(pixels, p.simplify_mm / mm, p.smoothing, p.corner_degrees).withColumnRenamed("region", "comp"))
        lines = self._stage("strokes", shape, lambda: self._sewn(marks.unionByName(thin), chosen, mm, s.strands))
        legend = pattern.legend(graph_rows.select("img", F.col("label").alias("palette_idx"), F.col("area_mm2").alias("area")))
        around = F.aggregate(F.transform("rings", lambda r: vector.polyline_length(r, True)), F.lit(0.0), lambda a, v: a + v) * mm
        effort = pattern.estimate_effort(graph_rows.join(rings.select("img", "comp", around.alias("ring_mm")), ["img", "comp"]), lines, s.thread_count, s.strands)
        labels = self._stage("labels", [shape, s.width_mm, s.height_mm], lambda: self._labels(graph_rows, legend, chosen, mm, s))
        return {
            "settings": asdict(s), "size": (w, h), "palette": chosen, "labels": clean, "regions": graph_rows, "outlines": rings, "legend": legend, "strokes": lines, "line_legend": pattern.line_legend(lines),
            "places": labels, "effort": effort, "timings": dict(self.timings) | {"total": sum(self.timings.values())},
        }

    def _sewn(self, raw: DataFrame, chosen: DataFrame, mm: float, strands: int) -> DataFrame:
        """Strokes with their thread, the nearest of the image's palette if it is near and else of the catalogue, and their stitch."""
        own = F.sqrt(sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in LAB), F.lit(0.0)))
        entries = chosen.select("img", "idx", F.col("number").alias("own"), *[F.col(c).alias(f"p{c}") for c in LAB])
        near = raw.join(entries, "img").withColumn("d", own).where(f"d < {pattern.SNAP_DELTA}").groupBy("img", "source", "comp").agg(F.min(F.struct("d", "idx", "own")).alias("m"))
        whole = nearest.nearest_thread(raw, ["img", "source", "comp"], self.library)
        threads = whole.select("img", "source", "comp", "number").join(near.select("img", "source", "comp", "m.own"), ["img", "source", "comp"], "left")
        sewn = raw.join(threads, ["img", "source", "comp"]).withColumn("number", F.coalesce("own", "number")).drop("own")
        return pattern.resolve_strokes(sewn, mm, P.STITCH_WIDTH_MM[strands])

    def _labels(self, rows: DataFrame, legend: DataFrame, chosen: DataFrame, mm: float, s: P.Settings) -> DataFrame:
        """Places of the regions' labels: at their poles, or led out of them."""
        named = rows.join(legend.select("img", F.col("palette_idx").alias("label"), "legend_no"), ["img", "label"]).join(chosen.select("img", F.col("idx").alias("label"), "number"), ["img", "label"])
        placed = named.select("img", "id", "area_mm2", "number", "legend_no", (F.col("radius_px") * mm).alias("radius_mm"), (F.col("pole_x") * mm).alias("x"), (F.col("pole_y") * mm).alias("y"))
        tiers = pattern.label_tiers(placed)
        texts = tiers.withColumn("text", F.when(F.col("tier") == "full", F.col("number")).otherwise(F.col("legend_no").cast("string")))
        places = pattern.place_leaders(texts, pattern.leader_candidates(texts, s.width_mm, s.height_mm))
        return places.join(texts.select("img", "id", "text", F.col("x").alias("from_x"), F.col("y").alias("from_y")), ["img", "id"])

    def pages(self, out: dict[str, Any], **options: Any) -> DataFrame:
        """The result of ``run`` as lines of SVG pages; options are those of ``svg.Page``."""
        s = out["settings"]
        _, _, mm = P.working_resolution(P.Settings(**s), P.derive(P.Settings(**s)).px_per_mm)
        page = svg.Page(s["width_mm"], s["height_mm"], mm, **options)
        colours = self.library.select("number", "name", "r", "g", "b")
        named = out["palette"].select("img", F.col("idx").alias("palette_idx"), "number").join(colours, "number")
        hexed = colours.select("number", "name", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
        regions = out["regions"].join(out["outlines"], ["img", "comp"]).withColumnRenamed("label", "palette_idx").join(named, ["img", "palette_idx"])
        legend = out["legend"].join(named.select("img", "palette_idx", "number"), ["img", "palette_idx"]).join(hexed, "number")
        strokes = out["strokes"].join(hexed, "number").withColumn("id", F.row_number().over(Window.partitionBy("img").orderBy("source", "comp")) - 1)
        return svg.svg_lines(page, out["regions"].select("img"), regions, legend, strokes, out["line_legend"].join(hexed, "number"), out["places"], out["effort"])
