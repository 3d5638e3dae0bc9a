"""Region outlines: crack edges by windows, and array expressions over polylines.

A polyline is array<struct<x: double, y: double>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import across, dealt, down


def crack_edges(pixels: DataFrame, column: str = "comp") -> DataFrame:
    """img, x0, y0, x1, y1, left, right: unit edges between different regions; -1 is outside or masked.

    Vertical edges run down and horizontal ones right; left and right are as seen along the edge.
    """
    me = F.coalesce(F.col(column), F.lit(-1))
    base, rows = pixels.select("img", "x", "y", me.alias("me")), pixels.count()

    def pair(w, line: str, at: Column, far: Column, along: tuple[Column, Column, Column, Column], first_is_left: bool) -> DataFrame:
        before = dealt(base, rows, "img", line).withColumn("near", F.lag("me").over(w)).withColumn("last", F.lead("me").over(w).isNull())
        inner = before.select("img", *along, F.coalesce("near", F.lit(-1)).alias("p"), F.col("me").alias("q"))
        ends = tuple(c.alias(n) for c, n in zip(far, ("x0", "y0", "x1", "y1"), strict=True))
        outer = before.where("last").select("img", *ends, F.col("me").alias("p"), F.lit(-1).alias("q"))
        both = inner.unionAll(outer).where("p <> q")
        left, right = ("p", "q") if first_is_left else ("q", "p")
        return both.select("img", "x0", "y0", "x1", "y1", F.col(left).alias("left"), F.col(right).alias("right"))

    x, y = F.col("x"), F.col("y")
    upright = pair(across(), "y", x, (x + 1, y, x + 1, y + 1), tuple(c.alias(n) for c, n in zip((x, y, x, y + 1), ("x0", "y0", "x1", "y1"), strict=True)), False)
    level = pair(down(), "x", y, (x, y + 1, x + 1, y + 1), tuple(c.alias(n) for c, n in zip((x, y, x + 1, y), ("x0", "y0", "x1", "y1"), strict=True)), True)
    return upright.unionAll(level)


def vertex_degrees(edges: DataFrame) -> DataFrame:
    """img, x, y, degree of every corner that an edge touches.  Both ends of an edge come from one reading."""
    ends = F.inline(F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)]))
    sent = edges.select("img", ends)
    return dealt(sent, 2 * edges.count(), "img", "x", "y").groupBy("img", "x", "y").agg(F.count("*").alias("degree"))


def _steps(ring: Column, closed: bool) -> Column:
    """Pairs of neighbouring points."""
    rest = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    if closed:
        rest = F.concat(rest, F.slice(ring, 1, 1))
    return F.filter(F.zip_with(ring, rest, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda s: s["p"].isNotNull() & s["q"].isNotNull())


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    return F.aggregate(_steps(ring, True), F.lit(0.0), lambda acc, s: acc + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]) / F.lit(2.0)


def ring_sort(rings: Column) -> Column:
    """Rings of a region with the largest absolute area, the outer one, first."""
    keyed = F.transform(rings, lambda r, i: F.struct((-F.abs(signed_area(r))).alias("a"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda k: k["r"])


def polyline_length(line: Column, closed: bool = False) -> Column:
    return F.aggregate(_steps(line, closed), F.lit(0.0), lambda acc, s: acc + F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]))


def turn_degrees(a: Column, b: Column, c: Column) -> Column:
    """How far the way turns at b, 0 (straight) to 180."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
    return F.abs(F.degrees(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)))


def _mix(p: Column, q: Column, t: float) -> Column:
    return F.struct((p["x"] + (q["x"] - p["x"]) * F.lit(t)).alias("x"), (p["y"] + (q["y"] - p["y"]) * F.lit(t)).alias("y"))


def chaikin(line: Column, corner_degrees: float = 80.0) -> Column:
    """One round of corner cutting on an open line; ends and sharp corners stay."""
    n = F.size(line)
    inner = F.transform(
        F.sequence(F.lit(2), n - 1),
        lambda i: F.when(
            turn_degrees(F.element_at(line, i - 1), F.element_at(line, i), F.element_at(line, i + 1)) >= corner_degrees,
            F.array(F.element_at(line, i)),
        ).otherwise(F.array(_mix(F.element_at(line, i), F.element_at(line, i - 1), 0.25), _mix(F.element_at(line, i), F.element_at(line, i + 1), 0.25))),
    )
    return F.when(n < 3, line).otherwise(F.concat(F.slice(line, 1, 1), F.flatten(inner), F.slice(line, -1, 1)))


def simplify(lines: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Douglas-Peucker on points(key..., seq, x, y): the points that stay.

    All lines split at once: a round finds, between two neighbouring kept points, the farthest point by
    a window and keeps it if it is farther than the tolerance; lines that no longer change cost nothing
    but their rows.  Ends always stay.
    """
    from pyspark.sql import Window

    from ..workspace import Rounds

    table = Rounds(lines.sparkSession, "simplify")
    by = Window.partitionBy(*key)
    along = by.orderBy("seq")
    now = table.keep(lines.select(*key, "seq", "x", "y").withColumn("kept", (F.col("seq") == F.min("seq").over(by)) | (F.col("seq") == F.max("seq").over(by))))
    while True:  # each round keeps at least one point more, or is the last
        here = F.struct("seq", "x", "y")
        spans = now.withColumn("a", F.last(F.when(F.col("kept"), here), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(F.when(F.col("kept"), here), ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing)))
        dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        size = dx * dx + dy * dy
        t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / size)))
        off = F.round(F.hypot(F.col("x") - F.col("a.x") - t * dx, F.col("y") - F.col("a.y") - t * dy), 9)
        measured = spans.withColumn("off", F.when(F.col("kept"), F.lit(0.0)).otherwise(off)).withColumn("span", F.col("a.seq"))
        top = F.max(F.struct("off", (-F.col("seq")).alias("o"))).over(Window.partitionBy(*key, "span"))
        after = table.keep(measured.withColumn("new", ~F.col("kept") & (F.col("off") > tolerance) & (top["o"] == -F.col("seq"))).select(*key, "seq", "x", "y", (F.col("kept") | F.col("new")).alias("kept"), "new"))
        now = after.drop("new")
        if after.where("new").isEmpty():
            break
    return now.where("kept").drop("kept")
