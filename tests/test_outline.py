"""Arcs, rings and outlines against a plain walk over the pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import outline

STEP = [(1, 0), (0, 1), (-1, 0), (0, -1)]


def plain_arcs(a):
    """[(points, left, right)] of a walk along unit edges; a is rows of region numbers, -1 masked."""
    h, w = a.shape

    def at(x, y):
        return int(a[y, x]) if 0 <= x < w and 0 <= y < h else -1

    def sides(x, y, d):
        return [(at(x, y - 1), at(x, y)), (at(x, y), at(x - 1, y)), (at(x - 1, y), at(x - 1, y - 1)), (at(x - 1, y - 1), at(x, y - 1))][d]

    ways = {(x, y): [d for d in range(4) if sides(x, y, d)[0] != sides(x, y, d)[1]] for y in range(h + 1) for x in range(w + 1)}
    seen, arcs = set(), []

    def walk(x, y, d):
        start, points, (left, right) = (x, y), [(x, y)], sides(x, y, d)
        while True:
            seen.add((x, y, d))
            x, y = x + STEP[d][0], y + STEP[d][1]
            seen.add((x, y, (d + 2) % 4))
            points.append((x, y))
            if len(ways[x, y]) != 2 or (x, y) == start:
                break
            d = next(k for k in ways[x, y] if k != (d + 2) % 4)
        arcs.append((points, left, right))

    for junctions in (True, False):
        for y in range(h + 1):
            for x in range(w + 1):
                for d in ways[x, y]:
                    if (x, y, d) not in seen and ((len(ways[x, y]) != 2) if junctions else d == 0):
                        walk(x, y, d)
    return arcs


def plain_rings(arcs, region):
    """[[(arc, forward)]] of one region: end to start, the leftmost turn first, until back at the first corner."""
    mine = [(k, True) for k, (_, left, _) in enumerate(arcs) if left == region] + [(k, False) for k, (_, _, right) in enumerate(arcs) if right == region]
    mine.sort()
    points = {(k, f): arcs[k][0] if f else arcs[k][0][::-1] for k, f in mine}
    used, rings = set(), []
    for first in mine:
        if first in used:
            continue
        ring, now = [first], first
        used.add(first)
        while points[now][-1] != points[first][0]:
            (ax, ay), (bx, by) = points[now][-2:]
            din = (bx - ax, by - ay)
            best = None
            for o in mine:
                if o not in used and points[o][0] == points[now][-1]:
                    dx, dy = points[o][1][0] - bx, points[o][1][1] - by
                    cross, dot = din[0] * dy - din[1] * dx, din[0] * dx + din[1] * dy
                    key = -2 if cross < 0 else 2 if cross > 0 else 0 if dot > 0 else 1
                    if best is None or key < best[0]:
                        best = (key, o)
            now = best[1]
            used.add(now)
            ring.append(now)
        rings.append(ring)
    return rings


def images():
    rng = np.random.default_rng(4)
    out = [np.zeros((1, 1), int), np.full((3, 4), -1), np.repeat([[0] * 5 + [1] * 5], 8, 0)]
    island = np.zeros((12, 12), int)
    island[3:9, 3:9] = 1
    island[5:7, 5:7] = 0
    pinch = np.zeros((7, 7), int)
    pinch[1:6, 1:6] = 1
    pinch[2, 2] = pinch[3, 3] = pinch[4, 4] = 0
    out += [island, pinch]
    out += [rng.integers(-1, 3, (9, 13)), rng.integers(0, 2, (14, 11)), (np.add.outer(np.arange(20), np.arange(30)) // 7 + rng.integers(0, 2, (20, 30))) % 4]
    return out


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(k, int(y * a.shape[1] + x), x, y, None if a[y, x] < 0 else int(a[y, x])) for k, a in enumerate(images()) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "img int, i long, x int, y int, comp int").cache()


@pytest.fixture(scope="module")
def arcs(pixels):
    return outline.trace_arcs(pixels).cache()


def test_arcs_equal_plain_walk(pixels, arcs):
    got = {}
    for r in outline.arc_points(arcs).orderBy("img", "id", "seq").collect():
        got.setdefault((r["img"], r["id"]), []).append((r["x"], r["y"]))
    sides = {(r["img"], r["id"]): (r["left"], r["right"]) for r in arcs.select("img", "id", "left", "right").distinct().collect()}
    want = {(k, n): arc for k, a in enumerate(images()) for n, arc in enumerate(plain_arcs(a))}
    assert set(got) == set(want) == set(sides)
    for key, (points, left, right) in want.items():
        assert (got[key], sides[key]) == (points, (left, right)), key


def test_rings_equal_plain_chains(arcs):
    got = {}
    for r in outline.assemble_rings(arcs).orderBy("img", "region", "ring", "seq").collect():
        got.setdefault((r["img"], r["region"]), {}).setdefault(r["ring"], []).append((r["id"], r["forward"]))
    want = {}
    for k, a in enumerate(images()):
        lines = plain_arcs(a)
        for region in sorted(set(a.ravel().tolist()) - {-1}):
            want[k, region] = plain_rings(lines, region)
    assert {key: [rings[n] for n in sorted(rings)] for key, rings in got.items()} == want


def test_outlines_cover_each_region_and_leave_no_sliver(pixels):
    exact = outline.vectorize(pixels, 0.0, passes=0)
    area = {(r["img"], r["comp"]): r["n"] for r in pixels.where("comp is not null").groupBy("img", "comp").agg(F.count("*").alias("n")).collect()}
    rings = {(r["img"], r["region"]): r for r in exact.withColumn("area", outline.outline_area(F.col("rings"))).collect()}
    assert {k: round(r["area"]) for k, r in rings.items()} == area
    for r in rings.values():  # the outer ring is first
        sizes = [abs(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:] + ring[:1]))) for ring in r["rings"]]
        assert sizes == sorted(sizes, reverse=True) and min(map(len, r["rings"])) >= 3
    smooth = outline.vectorize(pixels, 0.8)
    total = {}
    for r in smooth.collect():
        signed = sum(sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:] + ring[:1])) / 2 for ring in r["rings"] if len(ring) > 2)
        total[r["img"]] = total.get(r["img"], 0) + abs(signed)
    # images without masked pixels: whatever the boundaries became, regions still tile the page
    for k in (2, 3):
        assert math.isclose(total[k], images()[k].size, abs_tol=1e-6)
