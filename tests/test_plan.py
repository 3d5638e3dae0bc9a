import struct

import numpy as np
import pytest
import random

from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.functions.color import LAB
from rasterloom.operators import export, nearest, palette, pattern
from rasterloom.plans import params as P
from rasterloom.plans.pipeline import Plan
from rasterloom.sources import catalogue, images, projects

COLOURS = [("310", 0, 0, 0), ("B1", 255, 255, 255), ("321", 200, 20, 40), ("798", 20, 60, 190), ("800", 25, 65, 185)]


@pytest.fixture(scope="module")
def threads(spark):
    t = spark.createDataFrame([(i, n, f"Name {n}", r, g, b) for i, (n, r, g, b) in enumerate(COLOURS)], "ord int, number string, name string, r int, g int, b int")
    return t.withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def quadrants(spark, n=24):
    h = n // 2
    rows = [(0, y * n + x, x, y, *COLOURS[2 * (y >= h) + (x >= h)][1:], 255) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "img int, i bigint, x int, y int, r int, g int, b int, a int")


def test_every_thread_is_its_own_nearest(spark, threads):
    got = nearest.nearest_thread(threads.withColumnRenamed("number", "own"), ["own"], threads).collect()
    assert all(r["own"] == r["number"] and r["distance_sq"] == 0 for r in got)
    ranked = nearest.rank_threads(threads.where("number = '798'").withColumnRenamed("number", "own"), ["own"], threads, 3).orderBy("rank").collect()
    assert [r["number"] for r in ranked][:2] == ["798", "800"]
    none = nearest.nearest_thread(threads.withColumnRenamed("number", "own"), ["own"], threads, threads).collect()
    assert all(r["number"] is None for r in none)


def test_merge_chains_stop_at_cycles_and_outside(spark):
    p = spark.createDataFrame([(n,) for n in "abcd"], "number string")
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "z")], "number string, to string")
    got = {r["number"]: r["target"] for r in nearest.resolve_merges(p, merges).collect()}
    assert got == {"a": "c", "b": "a", "c": "b", "d": "d"}


def test_palette_recovers_flat_colours(spark, threads):
    px = quadrants(spark).withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True))).withColumn("mask", F.lit(True)).withColumn("ramp", F.lit(False)).withColumn("contrast", F.lit(0.0))
    sample = palette.samples(px, 1, 1.0, 0.35)
    found = palette.extract_palettes(sample, threads, 4).orderBy("idx").collect()
    assert {r["number"] for r in found} == {"310", "B1", "321", "798"} and all(abs(r["share"] - 0.25) < 1e-9 for r in found)
    assert [r["ok_l"] for r in found] == sorted((r["ok_l"] for r in found), reverse=True)
    locked = palette.extract_palettes(sample, threads, 4, ("800", "800", "nope")).collect()
    assert any(r["number"] == "800" and r["locked"] for r in locked) and len({r["number"] for r in locked}) == len(locked)
    assert palette.extract_palettes(sample.where("i < 0"), threads, 4).collect() == []
    lab = {r["number"]: [r[c] for c in LAB] for r in threads.collect()}
    rows = [(0, j, j, n, *lab[n], share, fixed) for j, (n, share, fixed) in enumerate([("798", 0.3, False), ("800", 0.7, False), ("310", 0.0, True)])]
    merged = palette.merge_close(spark.createDataFrame(rows, "img int, idx int, ord int, number string, ok_l double, ok_a double, ok_b double, share double, locked boolean"), 0.05).orderBy("idx").collect()
    assert [r["number"] for r in merged] == ["800", "310"] and merged[0]["share"] == pytest.approx(1.0)


def test_draws_are_those_of_the_generator():
    """Against the generator written with plain 32-bit steps."""
    s, want = 1234567, []
    for _ in range(5):
        s = (s ^ s << 13) % 2**32
        s ^= s >> 17
        s = (s ^ s << 5) % 2**32
        want.append(s / 2**32)
    draws = palette.xorshift32(1234567)
    assert [next(draws) for _ in range(5)] == want and 0 < next(palette.xorshift32(0)) < 1


def test_weighted_draw_is_where_the_running_sum_gets_there(spark):
    rng = random.Random(3)
    rows = [(img, i, float(i), 0.0, 0.0, rng.choice([0.0, rng.random()])) for img in (0, 1) for i in range(0, 30_000, 3)] + [(2, 5, 1.0, 0.0, 0.0, 0.0)]
    weighted = spark.createDataFrame(rows, "img int, i long, ok_l double, ok_a double, ok_b double, mass double")
    for draw in (0.0, 0.3, 0.77, 1.0):
        got = {r["img"]: r["i"] for r in palette.weighted_draw(weighted, draw).collect()}
        assert set(got) == {0, 1}
        for img in (0, 1):
            mine = [(i, m) for g, i, *_, m in rows if g == img]
            left = draw * sum(m for _, m in mine)
            for i, m in mine:
                left -= m
                if left <= 1e-9:
                    break
            assert abs(got[img] - i) <= 6  # the sums' last bits may tip it to a neighbour


def test_merging_weighs_lightness_and_blends_means(spark):
    rows = [(0, 0, 0, "a", 0.5, 0.0, 0.0, 0.3, False, 0.5, 0.0, 0.0), (0, 1, 1, "b", 0.54, 0.0, 0.0, 0.1, False, 0.6, 0.0, 0.0), (0, 2, 2, "c", 0.5, 0.045, 0.0, 0.2, False, 0.5, 0.06, 0.0)]
    entries = spark.createDataFrame(rows, "img int, idx int, ord int, number string, ok_l double, ok_a double, ok_b double, share double, locked boolean, mean_l double, mean_a double, mean_b double")
    (pair,) = palette.closest_pair(entries).collect()
    assert (pair["i"], pair["j"]) == (0, 2)  # 0.045 beside 1.4 times 0.04
    (first, last) = palette.merge_close(entries, 0.05).orderBy("idx").collect()
    assert (first["number"], last["number"]) == ("a", "b") and abs(first["share"] - 0.5) < 1e-9 and abs(first["mean_a"] - 0.06 * 0.4) < 1e-9


def test_numbers_rank_in_locale_order(spark):
    threads = spark.createDataFrame([(0, "Ecru", 0.5, 0.0, 0.0), (1, "blanc", 0.5, 0.0, 0.0), (2, "B5200", 0.5, 0.0, 0.0), (3, "310", 0.5, 0.0, 0.0)], "ord int, number string, ok_l double, ok_a double, ok_b double")
    row = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, None, 0.0, 0.0)], "k int, ok_l double, ok_a double, ok_b double")
    for limit in (nearest.CHUNK, 2):  # as one matrix, and dealt in parts
        nearest.CHUNK, kept = limit, nearest.CHUNK
        try:
            got = nearest.rank_threads(row, ["k"], threads, 3).where("k = 1").orderBy("rank").collect()
        finally:
            nearest.CHUNK = kept
        assert [r["number"] for r in got] == ["310", "B5200", "blanc"]


def test_images_have_palettes_of_their_own(spark, threads):
    one = quadrants(spark, 12)
    two = one.where("y < 6").withColumn("img", F.lit(1))
    both = one.unionAll(two).withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True))).withColumn("mask", F.lit(True)).withColumn("ramp", F.lit(False)).withColumn("contrast", F.lit(0.0))
    got = palette.extract_palettes(palette.samples(both, 1, 1.0), threads, 4).where("share > 0").collect()
    assert {(r["img"], r["number"]) for r in got} == {(0, n) for n in ("310", "B1", "321", "798")} | {(1, "310"), (1, "B1")}


def test_large_catalogues_are_dealt(spark, threads, monkeypatch):
    want = [sorted(map(tuple, f.collect())) for f in (nearest.nearest_thread(threads.withColumnRenamed("number", "own"), ["own"], threads), nearest.rank_threads(threads.withColumnRenamed("number", "own"), ["own"], threads, 3))]
    monkeypatch.setattr(nearest, "CHUNK", 2)
    assert [sorted(map(tuple, f.collect())) for f in (nearest.nearest_thread(threads.withColumnRenamed("number", "own"), ["own"], threads), nearest.rank_threads(threads.withColumnRenamed("number", "own"), ["own"], threads, 3))] == want


def test_repeated_colours_count_once_and_rank_whole(spark, threads):
    """A catalogue of many rows of few colours, against a plain search over all rows."""
    rng = random.Random(5)
    lab = [tuple(rng.random() for _ in range(3)) for _ in range(6)]
    rows = [(i, f"{i * 37 % 101:03d}", *lab[rng.randrange(6)]) for i in range(101)]
    many = spark.createDataFrame(rows, "ord int, number string, ok_l double, ok_a double, ok_b double")
    asked = [(k, *(rng.random() for _ in range(3))) for k in range(9)]
    at = spark.createDataFrame(asked, "k int, ok_l double, ok_a double, ok_b double")

    def far(q, t):
        return int(sum((x - y) ** 2 for x, y in zip(q[1:], t[2:], strict=True)) * 1e9 + 0.5)

    assert nearest.first_of_colour(many, [F.col("ord")], 2).count() == 12
    near = {r["k"]: r["ord"] for r in nearest.nearest_thread(at, ["k"], many).collect()}
    assert near == {q[0]: min(rows, key=lambda t: (far(q, t), t[0]))[0] for q in asked}
    ranked = {(r["k"], r["rank"]): r["number"] for r in nearest.rank_threads(at, ["k"], many, 20).collect()}
    assert ranked == {(q[0], n + 1): t[1] for q in asked for n, t in enumerate(sorted(rows, key=lambda t: (far(q, t), t[1]))[:20])}


def test_palettes_of_large_catalogues_are_dealt(spark, threads, monkeypatch):
    px = quadrants(spark, 8).withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True))).withColumn("mask", F.lit(True)).withColumn("ramp", F.lit(False)).withColumn("contrast", F.lit(0.0))
    sample = palette.samples(px, 1, 1.0)
    copies = threads.unionByName(threads.withColumns({"ord": F.col("ord") + 10, "number": F.concat(F.lit("x"), "number")}))

    def found():
        return sorted((r["idx"], r["number"], round(r["share"], 9)) for r in palette.extract_palettes(sample, copies, 6, ("x800",)).collect())

    want = found()
    assert {n for _, n, _ in want} == {"310", "B1", "321", "798", "x800"}
    monkeypatch.setattr(nearest, "CHUNK", 3)
    assert found() == want


def test_cards_of_any_shape_have_places(spark):
    rows = [("a", "2-1"), ("b", "10-1"), ("c", "2-10"), ("d", None), ("e", "2"), ("f", "x-3"), ("g", "2-1"), ("h", "")]
    got = {r["number"]: r["ord"] for r in catalogue.ordered(spark.createDataFrame(rows, "number string, card_row string")).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda t: t[1])] == ["d", "h", "f", "e", "a", "g", "c", "b"] and sorted(got.values()) == list(range(8))


def test_strokes_and_locks(spark):
    p = spark.createDataFrame([(0, "1"), (0, "2")], "img int, number string")
    s = spark.createDataFrame([(0, "2"), (0, "3"), (0, "3")], "img int, number string")
    assert sorted(r["number"] for r in palette.union_strokes(p, s).collect()) == ["1", "2", "3"]
    one, two = (spark.createDataFrame([(n,) for n in x], "number string") for x in ("ab", "bc"))
    assert sorted(r["number"] for r in palette.toggle_lock(one, two).collect()) == ["a", "c"]


def test_plan_runs_reuses_stages_and_keeps_the_area(spark, threads):
    plan = Plan(quadrants(spark), 24, 24, threads)
    settings = P.Settings(thread_count=4, width_mm=40, height_mm=40, min_detail_mm=1.0, color_fidelity=1.0)
    out = plan.run(settings)
    w, h = out["size"]
    assert (w, h) == (256, 256) and {r["number"] for r in out["palette"].collect()} == {"310", "B1", "321", "798"}
    legend = out["legend"].collect()
    assert len(legend) == 4 and sum(r["share"] for r in legend) == pytest.approx(1) and sum(r["area"] for r in legend) == pytest.approx(1600)
    assert out["effort"].first()["strokes"] == out["strokes"].count() == 0 and out["line_legend"].count() == 0
    rings = {r["comp"]: r["rings"] for r in out["outlines"].collect()}
    assert len(rings) == 4 and all(len(r) == 1 for r in rings.values())
    assert sorted((r["tier"], r["id"]) for r in out["places"].collect()) == [("full", k) for k in range(4)]
    assert set(plan.run(settings)["timings"]) == {"total"}


def test_params():
    flat = P.derive(P.preset_settings(P.Settings(preset="flat")))
    assert (flat.blur_mm, flat.mode_radius_mm, flat.smoothing, flat.keep_delta) == (0.0, 0.0, 0, 0.12)
    assert P.derive(P.Settings()).max_regions == 220 and P.rotate_dims(3, 4, 270, 90) == (4, 3, 0)
    assert P.working_resolution(P.Settings(width_mm=150, height_mm=75), 4) == (600, 300, 0.25)


def test_labels_and_leaders(spark):
    rows = [(0, 1, 50.0, 9.0, "321", 1, 20.0, 20.0, "1"), (0, 2, 40.0, 0.5, "798", 2, 21.0, 20.0, "2"), (0, 3, 30.0, 0.5, "310", 3, 21.0, 20.0, "3"), (0, 4, 1.0, 9.0, "310", 4, 5.0, 5.0, "4")]
    df = pattern.label_tiers(spark.createDataFrame(rows, "img int, id int, area_mm2 double, radius_mm double, number string, legend_no int, x double, y double, text string"))
    got = {r["id"]: r for r in pattern.place_leaders(df, pattern.leader_candidates(df, 60, 60)).collect()}
    assert got[1]["tier"] == "full" and got[2]["tier"] == got[3]["tier"] == "leader" and 4 not in got
    assert abs(got[2]["x"] - got[3]["x"]) >= 1 or abs(got[2]["y"] - got[3]["y"]) >= 1


def test_exports(spark):
    legend = spark.createDataFrame([(0, 1, "321", 'Red "deep"', "#C81428", 1, 12.34, 0.75), (0, 2, "1234567", "x", "#000000", 2, 4.0, 0.25)], "img int, legend_no int, number string, name string, hex string, regions int, area double, share double")
    assert [r["line"] for r in export.thread_csv(legend).orderBy("no").collect()] == ['1,"321","Red ""deep""",#C81428,1,12.3,0.7500', '2,"1234567","x",#000000,2,4.0,0.2500']
    first, second = (r["line"] for r in export.thread_text(legend).orderBy("no").collect())
    assert first.endswith("~75% of area, 1 region") and "1234567 x" in second and second.endswith("2 regions")
    ring = [[(0.0, 0.0), (1.5, 0.0), (1.25, 2.004)], [(0.0, 0.0), (1.0, 1.0)]]
    df = spark.createDataFrame([(ring,)], "p array<array<struct<x double, y double>>>")
    assert df.select(export.path_data(F.col("p"), True)).first()[0] == "M0 0L1.5 0L1.25 2Z"
    shapes = spark.createDataFrame([(0, 2, 0, None, None, None, None, "a<b", 1.0, 2.0), (0, 1, 0, "M0 0", "#fff", None, None, None, None, None)], "img int, layer int, ord int, path string, fill string, stroke string, stroke_width double, text string, x double, y double")
    svg = export.svg_document(shapes, 10, 20).first()["svg"]
    assert svg.index("<path") < svg.index("<text") and "a&lt;b" in svg and svg.endswith("</svg>")


def test_catalogue(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Floss#,Description,Red,Green,Blue,RGB code,Row\n310,Black,0,0,0,0,row 10-02\n666,Xmas Red,227,29,66,E31D42,row 2-01\n999,Grn Vy?Dk,1,2,3,010204,row 2-10\n")
    got = {r["number"]: r for r in catalogue.build_library(catalogue.ordered(catalogue.clean_catalogue(catalogue.read_catalogue_csv(spark, str(path))))).collect()}
    assert got["666"]["name"] == "Bright Red" and got["999"]["name"] == "Green Very Dark" and got["999"]["disagrees"] and not got["310"]["disagrees"]
    assert [got[n]["ord"] for n in ("666", "999", "310")] == [0, 1, 2] and got["666"]["hex"] == "#E31D42"
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        catalogue.read_catalogue_csv(spark, str(path))


def test_bmp(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    stride = (5 * 3 + 3) // 4 * 4
    body = b"".join(row[:, ::-1].tobytes().ljust(stride, b"\0") for row in rgb[::-1])
    (tmp_path / "x.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(body), 0, 0, 0, 0) + body)
    got = images.read_bmp(spark, str(tmp_path / "*.bmp")).orderBy("i").collect()
    assert [(r["r"], r["g"], r["b"]) for r in got] == [tuple(map(int, p)) for p in rgb.reshape(-1, 3)] and {r["a"] for r in got} == {255}
    via_spark = images.read_images(spark, str(tmp_path / "*.bmp")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in via_spark] == [tuple(r)[1:] for r in got]


def test_projects_are_replaced_and_pruned(spark, tmp_path):
    at, kind = f"file://{tmp_path}/projects", "id string, settings string, source string"
    assert projects.load_last(spark, at).count() == 0
    projects.save_projects(spark, at, spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], kind))
    projects.save_projects(spark, at, spark.createDataFrame([("a", "3", "x")], kind))
    assert {(r["id"], r["settings"]) for r in projects.load_projects(spark, at).collect()} == {("a", "3"), ("b", "2")}
    assert projects.load_last(spark, at).first()["id"] == "a"
    projects.prune_others(spark, at, spark.createDataFrame([("b",)], "id string"))
    assert [r["id"] for r in projects.load_projects(spark, at).collect()] == ["b"]


def test_list_files(spark):
    legend = spark.createDataFrame([(0, 1, "321", "Red", "#C81428", 1, 12.34, 0.75), (0, 2, "310", "Black", "#000000", 2, 4.0, 0.25)], "img int, legend_no int, number string, name string, hex string, regions int, area double, share double")
    lines = [r["line"] for r in export.thread_list(legend, "Bird").orderBy("no").collect()]
    assert lines[0] == "Bird — Thread list" and lines[1] == lines[-2] == "" and lines[-1] == "2 colours. Area shares are approximate." and len(lines) == 6
    assert export.thread_csv_file(legend).orderBy("no").first()["line"] == export.CSV_HEADER
