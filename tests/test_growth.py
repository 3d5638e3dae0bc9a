"""Steps whose cost must go with the input, by their plans."""

import math

from pyspark.sql import functions as F

from rasterloom.operators import graph, nearest, palette, skeleton, stencil, strokes, vector
from rasterloom.workspace import Rounds


def test_closest_pair_sorts_no_pairs(spark):
    rows = [(k, n, n % 4 == 0, (n * 37 + k) % 101 / 101, (n * 53) % 89 / 89, (n * 71) % 97 / 97) for k in range(3) for n in range(12)] + [(9, 1, False, 0.1, 0.1, 0.1), (8, 1, True, 0.1, 0.1, 0.1), (8, 2, True, 0.1, 0.1, 0.1)]
    found = palette.closest_pair(spark.createDataFrame(rows, "img int, idx int, locked boolean, ok_l double, ok_a double, ok_b double"))
    want = {}
    for img, i, li, *p in rows:
        for other, j, lj, *q in rows:
            if img == other and i < j and not (li and lj):
                d = round(sum(((a - b) * w) ** 2 for a, b, w in zip(p, q, (1.4, 1, 1), strict=True)) ** 0.5, 9)
                want[img] = min(want.get(img, (9.0, 0, 0)), (d, i, j))
    assert {r["img"]: (r["distance"], r["i"], r["j"]) for r in found.collect()} == want and set(want) == {0, 1, 2}
    assert "Join" not in found._jdf.queryExecution().toString()


def test_top_hat_shares_its_sorts(spark):
    raster = spark.range(100).selectExpr("0 as img", "cast(id % 10 as int) as x", "cast(id div 10 as int) as y", "cast(id * id % 13 as double) as v")
    plan = stencil.top_hat(raster, "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 4


def _pixels(spark):
    return spark.range(900).selectExpr("0 as img", "id as i", "cast(id % 30 as int) as x", "cast(id div 30 as int) as y", "cast(id * id * 7 % 11 % 3 as int) as comp")


def test_corners_are_dealt_by_their_number(spark, monkeypatch):
    pixels = _pixels(spark)
    whole = sorted(map(tuple, vector.vertex_degrees(vector.crack_edges(pixels)).collect()))
    monkeypatch.setattr(stencil, "ROWS", 100)
    edges = vector.crack_edges(pixels)
    found = vector.vertex_degrees(edges)
    assert sorted(map(tuple, found.collect())) == whole
    assert f", {-(-2 * edges.count() // 100)})" in found._jdf.queryExecution().executedPlan().toString()  # partitions of the exchange


def test_degrees_of_a_skeleton_send_each_pixel_once(spark):
    on = _pixels(spark).where("comp > 0").select("img", "x", "y", "comp")
    found = skeleton.degree_map(on)
    there = {(r["x"], r["y"]): r["comp"] for r in on.collect()}
    want = {(x, y): sum(there.get((x + dx, y + dy)) == c for dx, dy in skeleton.AROUND) for (x, y), c in there.items()}
    assert {(r["x"], r["y"]): r["degree"] for r in found.collect()} == want
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_like_colours_are_measured_once(spark, monkeypatch):
    rows = [(n, str(n * 7919 % 1000), n * 3 % 5 / 5, n % 4 / 4, 0.5) for n in range(300)]  # twenty colours
    threads = spark.createDataFrame(rows, "ord int, number string, ok_l double, ok_a double, ok_b double")
    asked = [(i, i % 7 / 7, i % 3 / 3, i % 2 / 2) for i in range(40)] + [(40, 0.5, 0.375, 0.5), (41, None, 0.1, 0.1)]
    sizes = []
    made = nearest.Colours.__init__
    monkeypatch.setattr(nearest.Colours, "__init__", lambda self, lab, *a: (sizes.append(len(lab)), made(self, lab, *a))[1])
    for k in (1, 3, 30, 400):
        got = {}
        for r in nearest.rank_threads(spark.createDataFrame(asked, "k int, ok_l double, ok_a double, ok_b double"), ["k"], threads, k).collect():
            got.setdefault(r["k"], []).append((r["rank"], r["number"]))
        order = {n: i for i, n in enumerate(r["number"] for r in threads.select("number").orderBy(F.collate("number", "UNICODE"), "number").collect())}
        d = lambda p, t: math.floor(sum((a - b) ** 2 for a, b in zip(p, t[2:], strict=True)) * 1e9 + 0.5)
        want = {i: [(j + 1, t[1]) for j, t in enumerate(sorted(rows, key=lambda t: (d(p, t), order[t[1]]))[:k])] for i, *p in asked if p[0] is not None}
        assert {i: sorted(v) for i, v in got.items()} == want
    assert sizes == [20] * 4


def test_palette_rounds_leave_the_whole_catalogue_alone(spark, monkeypatch):
    """A catalogue of few colours: rounds read its first rows of each colour, so what is broadcast does not grow with its rows."""
    threads = spark.range(600).selectExpr("cast(id as int) as ord", "cast(id as string) as number", "id % 12 / 12D as ok_l", "id % 5 / 5D as ok_a", "id % 3 / 3D as ok_b")
    pixels = spark.range(400).selectExpr("cast(id % 2 as int) as img", "id as i", "id % 10 / 10D as ok_l", "id % 7 / 7D as ok_a", "id % 3 / 3D as ok_b", "false as ramp", "1D as w")
    reads = []
    keep = Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df: (reads.append(any("/0002/" in f for f in df.inputFiles())), keep(self, df))[1])
    found = palette.extract_palettes(pixels, threads, 4, ("599",)).collect()
    assert len(found) == 8 and {r["number"] for r in found if r["locked"]} == {"599"}
    assert sum(reads) <= 3 and len(reads) > 8


def test_thin_regions_keep_what_may_be_lifted(spark, monkeypatch):
    """Lines over several tiles and inside one: rounds write candidates and what is beside them, not the raster over and over."""
    w, h, lines = 300, 140, {(5, 290, 60): 1, (20, 60, 20): 2, (140, 170, 100): 1}
    plane = {(x, y): n for (x0, x1, y0), n in lines.items() for y in (y0, y0 + 1) for x in range(x0, x1)}
    wide = {(x, y): 1 for x in range(100, 150) for y in range(110, 130)}  # too wide, goes on in another tile
    rows = [(0, y * w + x, x, y, plane.get((x, y), wide.get((x, y), None if (x, y) == (0, 0) else 0))) for y in range(h) for x in range(w)]
    labels = spark.createDataFrame(rows, "img int, i long, x int, y int, label int").repartition(3)
    colours = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (0, 2, 0.5)], "img int, label int, ok_l double").selectExpr("*", "0D as ok_a", "0D as ok_b")
    kept, sent = [], []
    keep, tiled = Rounds.keep, stencil.dealt_tiles
    monkeypatch.setattr(Rounds, "keep", lambda self, df: (lambda t: (kept.append(t.count()), t)[1])(keep(self, df)))
    monkeypatch.setattr(graph, "dealt_tiles", lambda df, n: (sent.append(df.count()), tiled(df, n))[1])
    left, found = strokes.lift_thin_regions(labels, colours, 4.0, 6.0, 0.1)
    assert max(kept) < len(rows) / 8 and sum(kept) < len(rows)
    assert len(rows) < sent[0] < len(rows) * 1.1  # a pixel goes to its tile, and margins to tiles that have pixels
    got = {(r["x"], r["y"]): r["label"] for r in left.collect()}
    assert len(got) == len(rows) and all(got[x, y] == (0 if (x, y) in plane else label) for _, _, x, y, label in rows)
    monkeypatch.undo()
    comps = {(r["x"], r["y"]): r["comp"] for r in graph.components(labels).collect()}
    strips = {r["comp"]: (r["length_px"], r["ok_l"]) for r in found.collect()}
    assert {c: ok_l for c, (_, ok_l) in strips.items()} == {comps[x0, y]: (0.1, 0.5)[n - 1] for (x0, _, y), n in lines.items()}
    assert all(0 < x1 - x0 - strips[comps[x0, y]][0] < 5 for x0, x1, y in lines)  # thinning takes the ends
    assert dict(found.dtypes)["comp"] == "int"


def test_label_filling_equals_plain_layers(spark):
    """Holes wider than a round of tiles reaches, over a tile's border, with masked pixels that never get a label."""
    w, h = 150, 50
    value = lambda x, y: None if (x + y) % 37 == 0 else (x * 7 + y * 3) % 11 % 4
    hole = {(x, y) for x in range(100, 140) for y in range(4, 46)}
    start = {(x, y): None if (x, y) in hole else value(x, y) for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(0, x, y, value(x, y)) for x, y in start], "img int, x int, y int, label int")
    for layers in (18, 256):
        now, open_ = dict(start), set(hole)
        for _ in range(layers):
            near = {(x, y): [v for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (v := now.get((x + dx, y + dy))) is not None] for x, y in open_}
            took = {p: min(v, key=lambda c: (-v.count(c), c)) for p, v in near.items() if v}
            now.update(took)
            open_ -= set(took)
        found = graph.inpaint_labels(df, df.where("x between 100 and 139 and y between 4 and 45"), layers)
        assert {(r["x"], r["y"]): r["label"] for r in found.collect()} == now and bool(open_) == (layers == 18)
