"""Region outlines: arcs between junctions, closed rings, and boundaries that neighbours share.

An edge between two pixels of different regions is two darts, one a direction.  A dart is named by its
start corner and direction (0 east, 1 south, 2 west, 3 north); its region is the one on the left.  Arcs and rings are
chains of darts and of arcs, ranked by pointer doubling, so no image is walked by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Rounds
from .chains import WALKED, named_chains, rank_chains, rank_walked, tile_of, walk_darts
from .stencil import TILE, dealt
from .vector import chaikin, ring_sort, signed_area, simplify

_ROW, _LOOP = 1 << 30, 1 << 60


def _corner(x: Column, y: Column) -> Column:
    return y.cast("bigint") * _ROW + x.cast("bigint") * 4


def _x(corner: Column) -> Column:
    return (corner % _ROW / 4).cast("int")


def _y(corner: Column) -> Column:
    return F.floor(corner / _ROW).cast("int")


def trace_arcs(pixels: DataFrame, column: str = "comp") -> DataFrame:
    """img, id, seq, x0, y0, x1, y1, left, right: the unit edges of every arc of a full raster, in order; -1 is outside or masked.

    An arc ends where other than two edges meet; it runs from the end whose (corner in raster order, direction) is
    smaller.  Loops without such a corner start east at their first horizontal edge.  ids count an image's
    arcs from 0 by that start, loops last.
    """
    rounds = Rounds(pixels.sparkSession, "arcs")
    kind = dict(pixels.dtypes)[column]
    img = dict(pixels.dtypes)["img"]

    def walk(table: pa.Table) -> pa.Table:
        """The darts that start at a tile's corners, walked as far as the tile goes."""
        tx, ty = table.column("__tx")[0].as_py(), table.column("__ty")[0].as_py()
        at_x, at_y = (table.column(c).to_numpy() - t * TILE + 1 for c, t in (("x", tx), ("y", ty)))
        me = np.full((TILE + 1, TILE + 1), -1, np.int64)  # the tile's pixels, and those before its corners
        me[at_y, at_x] = pc.fill_null(table.column("me"), -1).to_numpy()
        nw, ne, sw, se = me[:-1, :-1], me[:-1, 1:], me[1:, :-1], me[1:, 1:]
        sides = ((ne, se), (se, sw), (sw, nw), (nw, ne))  # left and right of the darts east, south, west and north
        there = np.stack([p != q for p, q in sides])
        n, total = there.sum(0), (there * np.arange(4)[:, None, None]).sum(0)
        way, row, col = np.nonzero(there)
        left, right = (np.stack([s[k] for s in sides])[way, row, col] for k in (0, 1))
        x, y = col + tx * TILE, row + ty * TILE
        corner, ahead = y * _ROW + x * 4, np.array([4, _ROW, -4, -_ROW])
        node, twin = corner + way, corner + ahead[way] + (way + 2) % 4
        # where two edges meet, the dart before this one is the reverse of the other that starts here
        met = n[row, col] == 2
        other = np.where(met, total[row, col] - way, 0)
        prev = corner + ahead[other] + (other + 2) % 4
        key = np.where(~met, node, np.where(way == 0, node + _LOOP, -1))
        found, stay = walk_darts(node, prev, met, key, twin)
        dx, dy = np.array([1, 0, -1, 0])[way], np.array([0, 1, 0, -1])[way]
        said = {"node": node, "twin": twin, "x0": x, "y0": y, "x1": x + dx, "y1": y + dy, "left": left, "right": right}
        types = {"node": pa.int64(), "twin": pa.int64(), "left": table.schema.field("me").type, "right": table.schema.field("me").type}
        rows = {c: pa.array(v[stay]).cast(types.get(c, pa.int32())) for c, v in said.items()}
        rows["img"] = pa.repeat(table.column("img")[0], int(stay.sum()))
        rows["mine"] = found.pop("mine")
        return pa.table({c: rows[c] for c in ("img", "node", "twin", "x0", "y0", "x1", "y1", "left", "right", "mine")} | found)

    def spread(c: str) -> Column:
        """The tiles that corners of a pixel lie in."""
        return F.explode(F.sequence(F.floor(F.col(c) / TILE), F.floor((F.col(c) + 1) / TILE)))

    sent = pixels.select("img", "x", "y", F.col(column).alias("me")).withColumn("__tx", spread("x")).withColumn("__ty", spread("y"))
    schema = f"img {img}, node long, twin long, x0 int, y0 int, x1 int, y1 int, left {kind}, right {kind}, mine boolean, {WALKED}"
    walked = rounds.keep(dealt(sent, 4 * pixels.count(), "img", "__tx", "__ty").groupBy("img", "__tx", "__ty").applyInArrow(walk, schema))
    return named_chains(rank_walked(walked, rounds), rounds).select("img", "id", "seq", "x0", "y0", "x1", "y1", "left", "right")


def arc_points(arcs: DataFrame) -> DataFrame:
    """img, id, seq, x, y of the corners along every arc of trace_arcs, from its start to its end."""
    last = arcs.groupBy("img", "id").agg(F.max(F.struct("seq", "x1", "y1")).alias("e"))
    return arcs.select("img", "id", "seq", F.col("x0").alias("x"), F.col("y0").alias("y")).unionAll(last.select("img", "id", F.col("e.seq") + 1, F.col("e.x1"), F.col("e.y1")))


def assemble_rings(arcs: DataFrame) -> DataFrame:
    """img, region, ring, seq, id, forward: the arcs of each region's rings in order, the region on their left.

    At a corner where a region meets itself the leftmost turn goes on, so a ring hugs its region.  A ring starts
    with its smallest arc and ends where it comes back to that arc's start corner; what is left of the way from there
    is a ring of its own.  Rings of a region count from 0 by their first arc.
    """
    rounds = Rounds(arcs.sparkSession, "rings")
    a, z = _corner(F.col("x0"), F.col("y0")), _corner(F.col("x1"), F.col("y1"))
    way = F.when(F.col("x1") > F.col("x0"), 0).when(F.col("y1") > F.col("y0"), 1).when(F.col("x1") < F.col("x0"), 2).otherwise(3)
    ends = arcs.select("img", "id", "left", "right", "seq", a.alias("a"), z.alias("z"), way.alias("way")).groupBy("img", "id").agg(
        F.first("left").alias("left"), F.first("right").alias("right"), F.min(F.struct("seq", "a", "way")).alias("s"), F.max(F.struct("seq", "z", "way")).alias("e"))
    there = ends.where("left >= 0").select("img", F.col("left").alias("region"), "id", F.lit(True).alias("forward"), F.col("s.a").alias("start"), F.col("s.way").alias("out"), F.col("e.z").alias("end"), F.col("e.way").alias("in"))
    back = ends.where("right >= 0").select("img", F.col("right").alias("region"), "id", F.lit(False).alias("forward"), F.col("e.z").alias("start"), ((F.col("e.way") + 2) % 4).alias("out"), F.col("s.a").alias("end"), ((F.col("s.way") + 2) % 4).alias("in"))
    oriented = rounds.keep(there.unionAll(back).withColumn("node", F.col("id") * F.lit(2).cast("bigint") + F.when(F.col("forward"), 0).otherwise(1)))
    # next at the corner: left is one direction less, straight the same, right one more, back two more
    leaving = oriented.select("img", "region", F.col("start").alias("end"), F.col("out").alias("leave"), F.col("node").alias("next"))
    turn = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(2), F.lit(0)), (F.col("leave") - F.col("in") + 4) % 4 + 1)
    follows = oriented.join(leaving, ["img", "region", "end"]).groupBy("img", "node").agg(F.min(F.struct(turn.alias("turn"), F.col("next"), F.col("end"))).alias("m"))
    links = follows.select("img", F.col("m.next").alias("node"), F.col("node").alias("prev"), F.col("m.next").alias("key"), tile_of(_x(F.col("m.end")), _y(F.col("m.end"))).alias("tile"))
    ranked = rank_chains(links, rounds)
    now = rounds.keep(oriented.join(ranked.select("img", "node", F.col("head").alias("ring"), F.col("rank").alias("seq")), ["img", "node"]).select("img", "region", "ring", "seq", "id", "forward", "start", "node"))
    by = Window.partitionBy("img", "region", "ring")
    whole: list[DataFrame] = []
    while True:  # cut rings where they come back to their first corner
        first = F.first("start").over(by.orderBy("seq"))
        cut = now.withColumn("again", F.when((F.col("seq") > 0) & (F.col("start") == first), F.col("seq"))).withColumn("cut", F.min("again").over(by))
        cut = rounds.keep(cut)
        whole.append(cut.where("cut is null or seq < cut").select("img", "region", "ring", "seq", "id", "forward"))
        rest = cut.where("seq >= cut")
        if rest.isEmpty():
            break
        lead = F.min(F.struct("node", "seq")).over(by)
        size = F.count("*").over(by)
        moved = rest.withColumn("lead", lead).withColumn("size", size)
        now = rounds.keep(moved.select("img", "region", F.col("lead.node").alias("ring"), ((F.col("seq") - F.col("lead.seq") + F.col("size")) % F.col("size")).alias("seq"), "id", "forward", "start", "node"))
    out = whole[0]
    for w in whole[1:]:
        out = out.unionAll(w)
    names = out.where("seq = 0").select("img", "region", "ring", (F.row_number().over(Window.partitionBy("img", "region").orderBy("ring")).cast("int") - 1).alias("number"))
    return out.join(names, ["img", "region", "ring"]).select("img", "region", F.col("number").alias("ring"), F.col("seq").cast("int").alias("seq"), "id", "forward")


def ring_lines(rings: DataFrame, lines: DataFrame) -> DataFrame:
    """img, region, rings: every region's rings as points, the largest first; rings under three points are left out.

    lines(img, id, line) has each arc's points once; both regions beside an arc read the same ones.
    """
    along = rings.join(lines, ["img", "id"])
    way = F.when(F.col("forward"), F.col("line")).otherwise(F.reverse("line"))
    open_end = F.slice(way, 1, F.greatest(F.size("line") - 1, F.lit(0)))
    each = along.groupBy("img", "region", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", open_end.alias("p")))).alias("parts"))
    points = each.select("img", "region", "ring", F.flatten(F.transform("parts", lambda s: s["p"])).alias("points")).where("size(points) >= 3")
    listed = points.groupBy("img", "region").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("all"))
    return listed.select("img", "region", ring_sort(F.transform("all", lambda s: s["points"])).alias("rings"))


def vectorize(pixels: DataFrame, tolerance: float, passes: int = 2, corner_degrees: float = 80.0, column: str = "comp") -> DataFrame:
    """img, region, rings: outlines with each arc simplified and smoothed once, so neighbours share their boundary."""
    rounds = Rounds(pixels.sparkSession, "outlines")
    arcs = rounds.keep(trace_arcs(pixels, column))
    points = arc_points(arcs).select("img", "id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kept = simplify(points, ["img", "id"], tolerance) if tolerance > 0 else points
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    lines = kept.groupBy("img", "id").agg(line.alias("line"))
    for _ in range(passes):
        lines = lines.select("img", "id", chaikin(F.col("line"), corner_degrees).alias("line"))
    return ring_lines(assemble_rings(arcs), rounds.keep(lines))


def outline_area(rings: Column) -> Column:
    """Area inside a region's rings, holes taken off (a region's rings run with it on their left)."""
    return F.abs(F.aggregate(F.transform(rings, signed_area), F.lit(0.0), lambda s, a: s + a))
