import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import geometry, graph, regions, stencil, vector


def raster(spark, grid, name="label"):
    grid = np.asarray(grid)
    h, w = grid.shape
    rows = [(0, y * w + x, x, y, None if grid[y, x] < 0 else int(grid[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, f"img int, i bigint, x int, y int, {name} int")


def back(df, name, shape, none=-1):
    out = np.full(shape, none, float)
    for r in df.select("x", "y", name).collect():
        if r[name] is not None:
            out[r["y"], r["x"]] = r[name]
    return out


def neighbours(y, x, shape, corners):
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy or dx) and (corners or not (dy and dx)) and 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]:
                yield y + dy, x + dx


def flood(grid, corners):
    out = np.full(grid.shape, -1)
    n = 0
    for y in range(grid.shape[0]):
        for x in range(grid.shape[1]):
            if grid[y, x] >= 0 and out[y, x] < 0:
                stack, out[y, x] = [(y, x)], n
                while stack:
                    p = stack.pop()
                    for q in neighbours(*p, grid.shape, corners):
                        if grid[q] == grid[p] and out[q] < 0:
                            out[q] = n
                            stack.append(q)
                n += 1
    return out


@pytest.mark.parametrize("corners", [False, True])
def test_components_match_flood_fill(spark, corners):
    grid = np.random.default_rng(3).integers(-1, 3, (14, 17))
    got = back(graph.components(raster(spark, grid), corners), "comp", grid.shape)
    assert (got == flood(grid, corners)).all()


def test_chamfer_matches_relaxation(spark):
    grid = np.zeros((13, 15), int)
    grid[3:11, 4:13] = 1
    grid[6, 7] = -1
    d = np.full(grid.shape, np.inf)
    for y in range(13):
        for x in range(15):
            if y in (0, 12) or x in (0, 14) or any(grid[q] != grid[y, x] for q in neighbours(y, x, grid.shape, False)):
                d[y, x] = 0.5
    for _ in range(20):
        for y in range(13):
            for x in range(15):
                for q in neighbours(y, x, grid.shape, True):
                    d[y, x] = min(d[y, x], d[q] + (1.4142 if q[0] != y and q[1] != x else 1))
    got = back(graph.chamfer(raster(spark, grid), "label"), "dist", grid.shape)
    assert np.allclose(got, d)


def test_islands_merge_and_highlights_stay(spark):
    grid = np.zeros((12, 12), int)
    grid[2, 2] = 1
    grid[7:10, 7:10] = 2
    colours = spark.createDataFrame([(0, 0, 0.5, 0.0, 0.0), (0, 1, 0.52, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0)], "img int, label int, ok_l double, ok_a double, ok_b double")
    got = back(graph.absorb_islands(raster(spark, grid), colours, 16, 0.3), "label", grid.shape)
    assert got[2, 2] == 0 and (got[7:10, 7:10] == 2).all()


def test_inpaint_takes_the_lowest_of_the_most_frequent(spark):
    grid = np.array([[1, 1, 1, 1], [2, 9, 9, 1], [2, 2, 1, 1]])
    df = raster(spark, grid)
    got = back(graph.inpaint_labels(df, df.where("label = 9")), "label", grid.shape)
    assert got[1, 1] == 2 and got[1, 2] == 1


def test_mode_filter_keeps_edges(spark):
    grid = np.zeros((10, 10), int)
    grid[:, 5:] = 1
    grid[2, 2], grid[7, 8] = 1, 0
    want = np.zeros((10, 10))
    want[:, 5:] = 1
    assert (back(stencil.mode_filter(raster(spark, grid), 1), "label", grid.shape) == want).all()


def test_majority_erode_dilate_against_numpy(spark):
    on = np.random.default_rng(5).integers(0, 2, (9, 11))
    df = raster(spark, on, "on")
    box = lambda y, x, r: on[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
    want = [[int(2 * box(y, x, 1).sum() >= box(y, x, 1).size) for x in range(11)] for y in range(9)]
    assert (back(stencil.majority(df, "on", 1), "major", on.shape) == want).all()
    want = [[box(y, x, 1).max() for x in range(11)] for y in range(9)]
    assert (back(stencil.dilate8(df, "on"), "dilated", on.shape) == want).all()
    assert (back(stencil.integral_image(df, "on"), "integral", on.shape) == on.cumsum(0).cumsum(1)).all()


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_crop_and_turn(spark, rotation):
    grid = np.arange(30).reshape(5, 6)
    got = geometry.crop_rotate(raster(spark, grid, "v"), 1, 1, 5, 4, rotation)
    want = np.rot90(grid[1:4, 1:5], -rotation // 90)
    assert (back(got, "v", want.shape) == want).all()
    assert [r["i"] for r in got.orderBy("y", "x").collect()] == list(range(12))


def test_resample_keeps_a_flat_colour(spark):
    rows = [(0, y * 7 + x, x, y, 10, 200, 90, 255) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(rows, "img int, i bigint, x int, y int, r int, g int, b int, a int")
    got = geometry.resample_area(df, 7, 5, 3, 2).select("r", "g", "b", "a").distinct().collect()
    assert [tuple(r) for r in got] == [(10, 200, 90, 255)] and geometry.resample_area(df, 7, 5, 7, 5) is df


def test_region_measures_and_neighbours(spark):
    grid = np.zeros((6, 8), int)
    grid[2:4, 3:6] = 1
    comps = graph.components(raster(spark, grid))
    stats = {r["comp"]: r for r in regions.area_rank(regions.region_stats(comps)).collect()}
    assert stats[0]["area"] == 42 and stats[1]["area"] == 6 and stats[0]["id"] == 0
    assert (stats[1]["x0"], stats[1]["y0"], stats[1]["x1"], stats[1]["y1"]) == (3, 2, 6, 4)
    edges = graph.adjacency(comps)
    assert [(r["a"], r["b"], r["shared"]) for r in edges.collect()] == [(0, 1, 10)]
    assert {r["comp"]: r["enclosed_by"] for r in regions.enclosed_by(edges).collect()} == {0: 1, 1: 0}


def test_crack_edges_close_around_regions(spark):
    grid = np.zeros((4, 5), int)
    grid[1:3, 1:4] = 1
    edges = vector.crack_edges(raster(spark, grid), "label")
    assert edges.where("left = 1 or right = 1").count() == 10
    assert edges.where("left = -1 or right = -1").count() == 18
    assert vector.vertex_degrees(edges).where("degree % 2 = 1").count() == 0


def test_polylines(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(square,)], "p array<struct<x double, y double>>")
    area, closed, open_ = df.select(vector.signed_area(F.col("p")), vector.polyline_length(F.col("p"), True), vector.polyline_length(F.col("p"))).first()
    assert (area, closed, open_) == (4.0, 8.0, 6.0)
    line = df.select(vector.chaikin(F.col("p"), 95).alias("l")).first()["l"]
    assert (line[0].x, line[0].y, line[-1].x, line[-1].y) == (0, 0, 0, 2) and len(line) == 6
    assert len(df.select(vector.chaikin(F.col("p"), 80).alias("l")).first()["l"]) == 4


def test_simplify_against_recursion(spark):
    rng = np.random.default_rng(2)
    pts = [(k, s, float(s * 3), float(v)) for k in (1, 2) for s, v in enumerate(rng.integers(0, 20, 25))]

    def keep(p, tol):
        if len(p) < 3:
            return {p[0][1], p[-1][1]}
        (ax, ay), (bx, by) = p[0][2:], p[-1][2:]
        n = (bx - ax) ** 2 + (by - ay) ** 2
        off = []
        for q in p[1:-1]:
            t = max(0, min(1, ((q[2] - ax) * (bx - ax) + (q[3] - ay) * (by - ay)) / n)) if n else 0
            off.append((round(np.hypot(q[2] - ax - t * (bx - ax), q[3] - ay - t * (by - ay)), 9), -q[1]))
        top = max(off)
        if top[0] <= tol:
            return {p[0][1], p[-1][1]}
        cut = -top[1] - p[0][1]
        return keep(p[: cut + 1], tol) | keep(p[cut:], tol)

    got = vector.simplify(spark.createDataFrame(pts, "k int, seq int, x double, y double"), ["k"], 4.0).collect()
    for k in (1, 2):
        assert {r["seq"] for r in got if r["k"] == k} == keep([p for p in pts if p[0] == k], 4.0)


def test_tiles_meet_without_seams(spark, monkeypatch):
    """Filters over several tiles equal what numpy gives on the whole raster."""
    monkeypatch.setattr(stencil, "TILE", 8)
    grid = np.random.default_rng(5).integers(0, 256, (19, 23))
    got = back(stencil.median_at(raster(spark, grid, "v"), "v", 2), "v", grid.shape)
    wide = np.pad(grid, 2, mode="edge")
    want = np.array([[np.median(wide[y : y + 5, x : x + 5]) for x in range(23)] for y in range(19)]) / 255
    assert np.allclose(got, want)
    labels = grid % 3
    voted = back(stencil.mode_filter(raster(spark, labels), 1), "label", grid.shape)
    for y in range(19):
        for x in range(23):
            near = [labels[p] for p in neighbours(y, x, grid.shape, False)] + [labels[y, x]]
            top = max(near.count(v) for v in near)
            best = [v for v in set(near) if near.count(v) == top]
            assert voted[y, x] == (labels[y, x] if labels[y, x] in best else min(best))


def test_mask_distance_is_zero_outside(spark):
    grid = np.zeros((7, 9), int)
    grid[1:6, 2:8] = 1
    got = back(graph.mask_distance(raster(spark, grid, "on")), "dist", grid.shape)
    assert (got[grid == 0] == 0).all() and got[1, 2] == 0.5 and got[2, 3] == pytest.approx(1.5) and got[3, 5] == pytest.approx(2.5)


def test_cores_and_polarity(spark):
    rows = [(0, 0, 0, 1.0, 0.9, 0.1, 0.2), (0, 1, 0, 0.4, 0.4, 0.0, 0.3), (0, 2, 0, 0.6, 0.1, 0.6, 0.4), (0, 3, 1, 0.2, 0.0, 0.2, 0.9), (0, 4, None, 0.9, 0.9, 0.0, 0.1)]
    cores = regions.component_core(spark.createDataFrame(rows, "img int, i int, comp int, response double, dark double, light double, ok_l double"))
    assert {r["i"] for r in cores.where("core").collect()} == {0, 2, 3}
    got = {r["comp"]: r for r in regions.component_polarity(cores).collect()}
    assert got[0]["is_dark"] and got[0]["core_pixels"] == 2 and got[0]["lightness"] == pytest.approx(0.3) and not got[1]["is_dark"]


def test_outer_ring_comes_first(spark):
    small, big = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(0.0, 0.0), (0.0, 5.0), (5.0, 0.0)]
    df = spark.createDataFrame([([small, big],)], "r array<array<struct<x double, y double>>>")
    assert len(df.select(vector.ring_sort(F.col("r")).alias("r")).first()["r"][0]) == 3 and df.select(vector.ring_sort(F.col("r"))[0][1]["y"]).first()[0] == 5.0
