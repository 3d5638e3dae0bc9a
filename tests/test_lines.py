"""Skeletons and strokes against plain versions that go pixel by pixel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import skeleton, strokes
from rasterloom.workspace import Rounds

AROUND = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def plain_thin(a):
    a = {(int(x), int(y)) for y, x in zip(*np.nonzero(a))}

    def code(p):
        return [int((p[0] + dx, p[1] + dy) in a) for dx, dy in AROUND]

    while True:
        size = len(a)
        for half in (0, 1):
            gone = set()
            for p in a:
                c = code(p)
                n, e, s, w = c[0], c[2], c[4], c[6]
                sides = n * e * s + e * s * w if half == 0 else n * e * w + n * s * w
                if 2 <= sum(c) <= 6 and sum(c[k] < c[(k + 1) % 8] for k in range(8)) == 1 and not sides:
                    gone.add(p)
            a -= gone
        if len(a) == size:
            break
    for _ in range(4):
        size = len(a)
        for p in sorted(a, key=lambda p: (p[1], p[0])):
            on = {d for d, v in zip(AROUND, code(p)) if v}
            if len(on) >= 2:
                group, todo = set(), [next(iter(on))]
                while todo:
                    d = todo.pop()
                    group.add(d)
                    todo += [o for o in on - group if abs(o[0] - d[0]) <= 1 and abs(o[1] - d[1]) <= 1]
                if group == on:
                    a.discard(p)
        if len(a) == size:
            break
    return a


def beside(a, p):
    return [(p[0] + dx, p[1] + dy) for dx, dy in AROUND if (p[0] + dx, p[1] + dy) in a]


def plain_prune(a, longest):
    a = set(a)
    for _ in range(3):
        degree = {p: len(beside(a, p)) for p in a}
        size = len(a)
        for start in sorted(degree, key=lambda p: (p[1], p[0])):
            if start not in a or degree[start] != 1:
                continue
            path, hit = [start], False
            while len(path) <= longest:
                then = [q for q in beside(a, path[-1]) if q not in path]
                if not then:
                    break
                if degree[then[0]] >= 3:
                    hit = True
                    break
                path.append(then[0])
            if hit and len(path) <= longest:
                a -= set(path)
        if len(a) == size:
            break
    return a


def plain_chains(a):
    seen, out = set(), []
    order = sorted(a, key=lambda p: (p[1], p[0]))

    def walk(p, q):
        chain = [p, q]
        seen.add(frozenset((p, q)))
        while len(beside(a, chain[-1])) == 2 and chain[-1] != p:
            then = next(n for n in beside(a, chain[-1]) if n != chain[-2])
            if frozenset((chain[-1], then)) in seen:
                break
            seen.add(frozenset((chain[-1], then)))
            chain.append(then)
        out.append(chain)

    for ring in (False, True):
        for p in order:
            if (len(beside(a, p)) == 2) == ring:
                for q in beside(a, p):
                    if frozenset((p, q)) not in seen:
                        walk(p, q)
    return out


def masks():
    rng = np.random.default_rng(9)
    y, x = np.mgrid[0:40, 0:40] + 0.5
    d = np.hypot(x - 20, y - 20)
    ring = (d <= 12) & (d >= 9.5)
    blob = rng.random((60, 50)) < 0.5
    blob = sum(np.roll(np.roll(blob, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)) >= 5
    wide = np.zeros((150, 160), bool)
    wide[3:140, 100:131] = wide[60:64, 5:155] = wide[2:9, 4:150] = True
    cross = np.zeros((30, 30), bool)
    cross[14:16, 2:28] = cross[2:28, 14:16] = True
    return [ring, blob, wide, cross, rng.random((25, 25)) < 0.6, np.zeros((5, 5), bool)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, int(x), int(y), 1, 4) for k, m in enumerate(masks()) for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "img int, x int, y int, comp int, spur int").cache()


def pixels_of(df):
    out = {k: set() for k in range(len(masks()))}
    for r in df.collect():
        out[r["img"]].add((r["x"], r["y"]))
    return out


def test_thinning_pruning_and_chains_equal_plain_ones(spark, table):
    rounds = Rounds(spark, "test")
    thinned = skeleton.thin(table, rounds)
    want = {k: plain_thin(m) for k, m in enumerate(masks())}
    assert pixels_of(thinned) == want
    degrees = {(r["img"], r["x"], r["y"]): r["degree"] for r in skeleton.degree_map(thinned).collect()}
    assert degrees == {(k, *p): len(beside(a, p)) for k, a in want.items() for p in a}
    pruned = skeleton.prune_spurs(thinned, 4, rounds)
    want = {k: plain_prune(a, 4) for k, a in want.items()}
    assert pixels_of(pruned) == want
    got = {}
    for r in skeleton.trace_skeleton(pruned, rounds).orderBy("img", "id", "seq").collect():
        got.setdefault(r["img"], {}).setdefault(r["id"], [(r["x0"], r["y0"])]).append((r["x1"], r["y1"]))
    assert {k: [chains[n] for n in sorted(chains)] for k, chains in got.items()} == {k: c for k, a in want.items() if (c := plain_chains(a))}


def test_ring_becomes_one_closed_path(table):
    paths = [r["line"] for r in skeleton.skeleton_paths(table.where("img = 0"), 4).collect()]
    assert len(paths) <= 2
    length = sum(math.dist(p, q) for line in paths for p, q in zip(line, line[1:]))
    assert 0.85 < length / (2 * math.pi * 10.75) < 1.1
    assert all(abs(math.hypot(p["x"] - 20, p["y"] - 20) - 10.75) < 1.6 for line in paths for p in line)


def drawing(spark, planes):
    rows = [(k, y * a.shape[1] + x, x, y, float(a[y, x]), 0.0, 0.0) for k, a in enumerate(planes) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "img int, i long, x int, y int, ok_l double, ok_a double, ok_b double")


def test_strokes_are_lifted_and_wide_marks_stay(spark):
    page = np.full((40, 80), 0.97)
    page[19:21, 10:70] = 0.2  # a stroke of two pixels
    page[30:32, 30:32] = 0.2  # a speck
    block = np.full((60, 60), 0.97)
    block[10:50, 10:50] = 0.2
    found, filled = strokes.detect_strokes(drawing(spark, [page, block]), 3.2, 6.0, 0.16, 2.0)
    (line,) = found.collect()
    assert line["img"] == 0 and 1.2 < line["width_px"] < 3 and 52 < line["length_px"] < 66 and line["ok_l"] < 0.3 and line["source"] == "image"
    at = {(r["img"], r["x"], r["y"]): r for r in filled.collect()}
    assert at[0, 40, 20]["ok_l"] > 0.9 and at[0, 31, 31]["ok_l"] > 0.9 and at[1, 30, 30]["ok_l"] < 0.3
    assert (at[0, 40, 20]["lifted"], at[0, 5, 5]["lifted"], at[1, 30, 30]["lifted"]) == (1, 0, 0)
    assert len(at) == page.size + block.size


def test_rim_touch_takes_the_first_two(spark):
    rng = np.random.default_rng(2)
    comp = rng.integers(-3, 6, (20, 20))
    rows = [(0, x, y, int(comp[y, x]) if comp[y, x] >= 0 else None) for y in range(20) for x in range(20)]
    want = set()
    for y in range(20):
        for x in range(20):
            if comp[y, x] < 0:
                seen = []
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if 0 <= x + dx < 20 and 0 <= y + dy < 20 and (c := int(comp[y + dy, x + dx])) >= 0 and c not in seen:
                            seen.append(c)
                want |= {(x, y, c) for c in seen[:2]}
    got = strokes.rim_touch(spark.createDataFrame(rows, "img int, x int, y int, comp int")).collect()
    assert len(got) == len(want) and {(r["x"], r["y"], r["comp"]) for r in got} == want


def test_colour_filling_equals_plain_layers(spark):
    rng = np.random.default_rng(3)
    plane, hole = rng.random((40, 45)), np.zeros((40, 45), bool)
    hole[2:39, 3:42] = True
    known, want = ~hole, plane.copy()
    for _ in range(64):
        now, value = [], want.copy()
        for y, x in zip(*np.nonzero(~known)):
            near = [want[y + dy, x + dx] for dx, dy in AROUND if 0 <= x + dx < 45 and 0 <= y + dy < 40 and known[y + dy, x + dx]]
            if near:
                value[y, x] = sum(near) / len(near)
                now.append((y, x))
        for p in now:
            known[p] = True
        want = value
    df = drawing(spark, [plane]).join(spark.createDataFrame([(0, int(x), int(y), 1) for y, x in zip(*np.nonzero(hole))], "img int, x int, y int, hole int"), ["img", "x", "y"], "left")
    got = strokes.inpaint_colour(df, "hole").collect()
    assert len(got) == plane.size and all(abs(r["ok_l"] - want[r["y"], r["x"]]) < 1e-9 for r in got)


def test_thin_regions_become_strokes(spark):
    bar = np.zeros((30, 60), int)
    bar[14:16, 8:52] = 1
    weak = np.zeros((30, 60), int)
    weak[14:16, 8:52] = 2
    weak[20:28, 8:20] = 1
    planes = [bar, weak]
    rows = [(k, y * 60 + x, x, y, int(a[y, x])) for k, a in enumerate(planes) for y in range(30) for x in range(60)]
    labels = spark.createDataFrame(rows, "img int, i long, x int, y int, label int")
    colours = [(k, n, *c) for k in (0, 1) for n, c in enumerate([(0.95, 0.0, 0.0), (0.1, 0.0, 0.0), (0.93, 0.01, 0.0)])]
    palette = spark.createDataFrame(colours, "img int, label int, ok_l double, ok_a double, ok_b double")
    left, lines = strokes.lift_thin_regions(labels, palette, 3.2, 6.0, 0.2)
    (line,) = lines.collect()
    assert line["img"] == 0 and 1.2 < line["width_px"] < 3 and line["length_px"] > 36 and line["source"] == "region" and line["ok_l"] == 0.1
    got = {(r["img"], r["x"], r["y"]): r["label"] for r in left.collect()}
    assert {v for k, v in got.items() if k[0] == 0} == {0}
    assert all(got[1, x, y] == weak[y, x] for y in range(30) for x in range(60))
