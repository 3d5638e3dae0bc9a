import math

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_white_and_black_in_oklab(spark):
    lab = color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    white, black = values(spark, [(255, 255, 255), (0, 0, 0)], "r int, g int, b int", *lab)
    assert white[0] == pytest.approx(1, abs=1e-4) and abs(white[1]) < 1e-4 and abs(white[2]) < 1e-4
    assert black == pytest.approx((0, 0, 0), abs=1e-9)


def test_round_trip_through_oklab(spark):
    rows = [(r, g, b) for r in (0, 37, 128, 255) for g in (0, 99, 255) for b in (3, 200, 255)]
    back = color.oklab_to_rgb(color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")))
    for row, got in zip(rows, values(spark, rows, "r int, g int, b int", *back), strict=True):
        assert max(abs(a - b) for a, b in zip(row, got, strict=True)) <= 1


def test_ciede2000_published_pairs(spark):
    rows = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, -1.0, 2.0, 50.0, 0.0, 0.0, 2.3669), (50.0, 0.0, 0.0, 50.0, 0.0, 0.0, 0.0)]
    one, two = (tuple(F.col(f"{c}{k}") for c in "lab") for k in (1, 2))
    for want, got in values(spark, rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double", "want", color.delta_e_2000(one, two)):
        assert got == pytest.approx(want, abs=1e-4)


def test_hex_and_hue(spark):
    got = values(spark, [(1, 171, 255)], "r int, g int, b int", color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    assert got == [("#01ABFF",)]
    assert values(spark, [("#01ABFF",)], "h string", *color.hex_to_rgb(F.col("h"))) == [(1, 171, 255)]
    hues = [h for (h,) in values(spark, [(1.0, 0.0), (0.0, -1.0)], "a double, b double", color.hue_degrees(F.col("a"), F.col("b")))]
    assert hues == [0.0, 270.0]


def test_adjust_identity_and_grey(spark):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    assert color.adjust(r, g, b) == (r, g, b)
    grey = values(spark, [(200, 30, 90)], "r int, g int, b int", *color.adjust(r, g, b, saturation=-1))[0]
    assert max(grey) - min(grey) <= 1
    assert color.chroma_scale(1) == 2.5 and math.isclose(color.lightness_shift(1), 0.3)
