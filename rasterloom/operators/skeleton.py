"""Centre lines of masks: thinning, spurs, chains and paths.

A mask is the table of its pixels (img, x, y, comp): pixels are neighbours only within a component.  Thinning and
pruning go tile by tile with a margin as wide as a round can see, so a shuffle serves many steps; chains are ranked by
pointer doubling.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Rounds
from .chains import directed_chains, tile_of
from .outline import arc_points
from .stencil import _moved, extent, tiled
from .vector import polyline_length, simplify

#: The eight neighbours clockwise from north; a code has bit k for neighbour k.
AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
#: Neighbours that come before a pixel in raster order.
_EARLIER = [k for k, (dx, dy) in enumerate(AROUND) if dy < 0 or (dy == 0 and dx < 0)]
#: Thinning iterations, and steps of other rules, that one round of tiles makes.
ITERATIONS, STEPS = 8, 16
_LOOP = 1 << 61


def _bits(code: int) -> list[int]:
    return [code >> k & 1 for k in range(8)]


def _thins(code: int, half: int) -> bool:
    """Zhang and Suen's rule for the first (0) and second (1) half of an iteration."""
    p = _bits(code)
    turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
    n, e, s, w = p[0], p[2], p[4], p[6]
    sides = (n * e * s, e * s * w) if half == 0 else (n * e * w, n * s * w)
    return 2 <= sum(p) <= 6 and turns == 1 and not any(sides)


def _one_group(code: int) -> bool:
    """Whether there are at least two neighbours and all of them touch each other, directly or in turn."""
    on = [k for k, v in enumerate(_bits(code)) if v]
    group = set(on[:1])
    while True:
        more = {k for k in on for j in group if max(abs(AROUND[k][0] - AROUND[j][0]), abs(AROUND[k][1] - AROUND[j][1])) <= 1} - group
        if not more:
            return len(on) >= 2 and len(group) == len(on)
        group |= more


_THIN = [np.array([_thins(c, half) for c in range(256)]) for half in (0, 1)]
_REDUNDANT = np.array([_one_group(c) for c in range(256)])


def _code(on: np.ndarray, comp: np.ndarray, earlier: np.ndarray | None = None) -> np.ndarray:
    """Codes of all places; ``earlier`` is the state of neighbours that come before, if it is another."""
    code = np.zeros(on.shape, np.int64)
    for k, (dx, dy) in enumerate(AROUND):
        state = on if earlier is None or k not in _EARLIER else earlier
        code |= (_moved(state, dx, dy, False) & (_moved(comp, dx, dy, np.nan) == comp)).astype(np.int64) << k
    return code


def _total(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def thin(mask: DataFrame, rounds: Rounds, longest: int = 64) -> DataFrame:
    """The pixels of mask(img, x, y, comp, ...) that thinning leaves: lines about one pixel wide."""

    def peel(planes: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        on, comp = planes["on"] == 1, planes["comp"]
        for _ in range(ITERATIONS):
            before = on
            for half in (0, 1):
                on = on & ~_THIN[half][_code(on, comp)]
            if (on == before).all():
                break
        return {"on": on.astype(float), "comp": comp}

    kind = dict(mask.dtypes)["comp"]
    now = rounds.keep(mask.withColumn("on", F.lit(1)))
    size = extent(now)
    for _ in range(longest // ITERATIONS):
        now = rounds.keep(tiled(now, 2 * ITERATIONS, {"on": "int", "comp": kind}, peel, **size, tight=True).where("on = 1"))
        was, size = size, extent(now)
        if size["rows"] == was["rows"]:
            break

    def settle(planes: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        on, comp, gone = planes["on"] == 1, planes["comp"], planes["gone"] == 1
        moved = gone
        for _ in range(STEPS):
            before = gone
            gone = on & _REDUNDANT[_code(on, comp, on & ~gone)]
            moved = gone != before
            if not moved.any():
                break
        return {"on": on.astype(float), "comp": comp, "gone": gone.astype(float), "moved": moved.astype(float)}

    # pixels whose neighbours hold together without them go in raster order: what a pixel sees of those before it is
    # followed until nothing moves
    for _ in range(4):
        now = now.withColumn("gone", F.lit(0)).withColumn("moved", F.lit(1))
        while True:
            now = rounds.keep(tiled(now, STEPS, {"on": "int", "comp": kind, "gone": "int", "moved": "int"}, settle, **size, tight=True))
            if not _total(now, "moved"):
                break
        gone = _total(now, "gone")
        now = now.where("gone = 0").drop("gone", "moved")
        if not gone:
            break
    return now.drop("on")


def degree_map(skeleton: DataFrame) -> DataFrame:
    """Add degree: how many of the eight neighbours are on the skeleton, in the same component."""

    def count(planes: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        code = _code(there, planes["comp"])
        return {"comp": planes["comp"], "degree": sum((code >> k & 1) for k in range(8)).astype(float)}

    return tiled(skeleton.withColumn("degree", F.lit(0)), 1, {"comp": dict(skeleton.dtypes)["comp"], "degree": "int"}, count, **extent(skeleton), tight=True)


def prune_spurs(skeleton: DataFrame, longest: int, rounds: Rounds) -> DataFrame:
    """skeleton(img, x, y, comp, spur) without end branches of at most ``spur`` pixels that hang off a junction; at
    most three rounds.  ``longest`` bounds spur."""

    def prune(planes: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
        on, comp, spur = planes["on"] == 1, planes["comp"], planes["spur"]
        code = _code(on, comp)
        degree = sum((code >> k & 1) for k in range(8))
        h, w = on.shape
        cur = np.flatnonzero((on & (degree == 1)).ravel())
        most = spur.ravel()[cur]
        path = np.full((len(cur), longest + 1), -1, np.int64)
        path[:, 0] = cur
        length, hit, going = np.ones(len(cur), np.int64), np.zeros(len(cur), bool), np.ones(len(cur), bool)
        flat, deep = code.ravel(), degree.ravel()
        while True:
            of = np.flatnonzero(going & (length <= most))
            if not len(of):
                break
            here = path[of, length[of] - 1]
            then = np.full(len(of), -1, np.int64)
            for k, (dx, dy) in enumerate(AROUND):
                to = here + dy * w + dx
                may = (then < 0) & (flat[here] >> k & 1 == 1)
                may &= ~(path[of] == to[:, None]).any(1)
                then[may] = to[may]
            going[of[then < 0]] = False
            end = (then >= 0) & (deep[np.maximum(then, 0)] >= 3)
            hit[of[end]], going[of[end]] = True, False
            on_ = (then >= 0) & ~end
            more = of[on_]
            length[more] += 1
            fits = length[more] <= longest
            path[more[fits], length[more[fits]] - 1] = then[on_][fits]
            going[more[~fits]] = False
        cut = hit & (length <= most)
        gone = path[cut].ravel()
        out = on.ravel().copy()
        out[gone[gone >= 0]] = False
        return {"on": out.reshape(h, w).astype(float), "comp": comp, "spur": spur}

    kinds = {"on": "int", "comp": dict(skeleton.dtypes)["comp"], "spur": "int"}
    now = rounds.keep(skeleton.withColumn("on", F.lit(1)).withColumn("spur", F.col("spur").cast("int")))
    size = extent(now)
    for _ in range(3):
        now = rounds.keep(tiled(now, 2 * longest + 2, kinds, prune, **size, tight=True).where("on = 1"))
        was, size = size, extent(now)
        if size["rows"] == was["rows"]:
            break
    return now.drop("on")


def _pixel(x: Column, y: Column) -> Column:
    return y.cast("bigint") * (1 << 30) + x.cast("bigint") * 8


def trace_skeleton(skeleton: DataFrame, rounds: Rounds) -> DataFrame:
    """img, comp, id, seq, x0, y0, x1, y1: the steps of every chain, split where other than two neighbours are.

    Chains between such pixels start at the first one in raster order, towards the first neighbour clockwise from north; closed
    chains come last and start at their first pixel."""
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(AROUND)])).alias("d")
    out = skeleton.select("img", "x", "y", "comp", step).select("img", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("d.dx")).alias("x1"), (F.col("y") + F.col("d.dy")).alias("y1"), "comp", F.col("d.k").alias("k"))
    ends = skeleton.select("img", F.col("x").alias("x1"), F.col("y").alias("y1"), "comp")
    each = out.join(ends, ["img", "x1", "y1", "comp"])
    at = Window.partitionBy("img", "x0", "y0")
    n, other = F.count("*").over(at), F.sum("k").over(at).cast("int") - F.col("k")
    met = each.withColumn("n", n).withColumn("other", F.when(F.col("n") == 2, other))
    here = _pixel(F.col("x0"), F.col("y0"))
    shift = F.element_at(F.array(*[F.lit(dy * (1 << 30) + dx * 8) for dx, dy in AROUND]), F.coalesce("other", F.lit(0)) + 1)
    prev = F.when(F.col("n") == 2, here + shift + (F.col("other") + 4) % 8)
    node = here + F.col("k")
    twin = _pixel(F.col("x1"), F.col("y1")) + (F.col("k") + 4) % 8
    linked = met.select("img", node.alias("node"), twin.alias("twin"), prev.alias("prev"), F.when(F.col("n") == 2, node + _LOOP).otherwise(node).alias("key"), tile_of(F.col("x0"), F.col("y0")).alias("tile"), "x0", "y0", "x1", "y1", "comp")
    return directed_chains(linked, rounds)


def skeleton_paths(mask: DataFrame, longest_spur: int, tolerance: float = 0.7) -> DataFrame:
    """img, comp, id, line: centre lines of mask(img, x, y, comp, spur) through pixel centres, simplified."""
    rounds = Rounds(mask.sparkSession, "skeleton")
    chains = rounds.keep(trace_skeleton(prune_spurs(thin(mask.select("img", "x", "y", "comp", "spur"), rounds), longest_spur, rounds), rounds))
    points = arc_points(chains).select("img", "id", "seq", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    kept = simplify(points, ["img", "id"], tolerance)
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    lines = kept.groupBy("img", "id").agg(line.alias("line")).where("size(line) >= 2")
    return rounds.keep(lines.join(chains.where("seq = 0").select("img", "id", "comp"), ["img", "id"]))


def path_measures(paths: DataFrame) -> DataFrame:
    """img, comp, paths, length_px, longest_px and number of paths of every component."""
    each = paths.withColumn("length", polyline_length(F.col("line")))
    return each.groupBy("img", "comp").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]).alias("paths"), F.sum("length").alias("length_px"), F.max("length").alias("longest_px"), F.count("*").alias("n_paths"))


def spur_length(gate_width: Column) -> Column:
    """How long a spur may be to be taken for an artefact of thinning: about the width of the stroke."""
    return F.greatest(F.lit(1), F.floor(F.greatest(F.lit(2.0), gate_width + 1) + 0.5)).cast("int")


def longest_spur(max_width: float) -> int:
    return max(1, math.floor(max(2.0, max_width + 1) + 0.5))
