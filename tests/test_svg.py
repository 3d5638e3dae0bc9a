import xml.etree.ElementTree as ET

from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.functions.color import LAB
from rasterloom.operators import graph, outline, pattern, regions, svg
from rasterloom.plans import params as P
from rasterloom.plans.pipeline import Plan

NS = {"s": "http://www.w3.org/2000/svg"}


@pytest.fixture(scope="module")
def tables(spark):
    square, hole = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (2.0, 4.0), (4.004, 4.0)]
    regions = spark.createDataFrame([(0, 0, [square, hole], 1, "310", "Black <&>", 0, 0, 0, 3.75), (0, 1, [hole, hole[:2]], 4, "321", None, 200, 20, 40, 0.25)], "img int, id int, rings array<array<struct<x double, y double>>>, palette_idx int, number string, name string, r int, g int, b int, area_mm2 double")
    legend = spark.createDataFrame([(0, 1, 1, "310", "Black <&>", "#000000", 1, 3.75), (0, 4, 2, "321", None, "#C81428", 1, 0.25)], "img int, palette_idx int, legend_no int, number string, name string, hex string, regions long, area double")
    strokes = spark.createDataFrame([(0, 0, [[(1.0, 1.0), (1.0, 6.5)]], "310", "Black", "#000000", "back", 0.2, 2.75)], "img int, id int, paths array<array<struct<x double, y double>>>, number string, name string, hex string, stitch string, width_mm double, length_mm double")
    lines = spark.createDataFrame([(0, 1, "310", "Black", "#000000", "back", 1, 2.75)], "img int, line_no int, number string, name string, hex string, stitch string, strokes long, length_mm double")
    places = spark.createDataFrame([(0, 0, "full", "310", 2.0, 2.0, None, None), (0, 1, "leader", "2", 5.0, 5.0, 1.5, 1.25), (0, 2, "none", "3", 0.0, 0.0, None, None)], "img int, id int, tier string, text string, x double, y double, from_x double, from_y double")
    images = spark.createDataFrame([(0,), (1,)], "img int")
    return images, regions, legend, strokes, lines, places


def page_of(lines, img):
    rows = sorted((r for r in lines.collect() if r["img"] == img), key=lambda r: (r["layer"], r["ord"]))
    return ET.fromstring("\n".join(r["line"] for r in rows).encode()), rows


def test_a_whole_page(tables):
    images, *rest = tables
    lines = svg.svg_lines(svg.Page(50, 40, 0.5, project='A "b"', fabric="#FAF0E6", hoop=(60.5,)), images, *rest)
    root, rows = page_of(lines, 0)
    assert root.get("width") == "146mm" and root.get("height") == "88mm" and root.find("s:title", NS).text == 'A "b" — pattern'  # margin 8 + 11 for the hoop
    assert '"areaMm2":3.8' in root.find("s:metadata", NS)[0].text and '"estimates":null' in root.find("s:metadata", NS)[0].text
    first, second = root.findall(".//s:g[@id='regions']/s:path", NS)
    assert first.get("d") == "M0 0L8 0L8 8L0 8ZM2 2L2 4L4 4Z" and first.get("data-name") == "Black <&>" and first.get("fill") == "rgb(214,214,214)" and first.get("stroke-width") == "0.48"
    assert second.get("d") == "M2 2L2 4L4 4Z" and second.get("data-legend") == "2" and second.get("data-name") == ""
    (stroke,) = root.findall(".//s:g[@id='lines']/s:path", NS)
    assert stroke.get("d") == "M1 1L1 6.5" and stroke.get("stroke-width") == "0.6" and stroke.get("data-stitch") == "back"
    labels = root.find(".//s:g[@id='labels']", NS)
    assert [e.tag.rpartition("}")[2] for e in labels] == ["text", "line", "circle", "rect", "text"] and [t.text for t in labels.findall("s:text", NS)] == ["310", "2"]
    assert labels.find("s:rect", NS).get("x") == "4.11" and labels.find("s:text", NS).get("class") == "dmc"
    assert root.find(".//s:circle[@id='hoop']", NS).get("r") == "30.25" and root.find(".//s:rect[@id='fabric']", NS).get("fill") == "url(#bare)"
    said = [t.text for t in root.findall(".//s:g[@id='scale']/s:text", NS)]
    assert said == ["20 mm", "50 × 40 mm · 2 regions · 2 colours · 1 lines · fabric #FAF0E6"]
    words = [t.text for t in root.findall("s:g[@id='legend']/s:text", NS)]
    assert words == ['A "b"', "1", "Thread 310", "Black <&>", "2", "Thread 321", None, "Lines", "Thread 310", "back stitch · 3 mm"]
    assert [t.get("y") for t in root.findall("s:g[@id='legend']/s:text", NS)][-2:] == ["22.6", "22.6"]
    empty, _ = page_of(lines, 1)  # an image of which no table has rows
    assert empty.findall(".//s:path[@id]", NS) == [] and "0 regions · 0 colours" in "".join(empty.itertext())


def test_colour_mode_and_options(tables):
    images, regions, legend, *_ , places = tables
    root, _ = page_of(svg.svg_lines(svg.Page(150, 100, 0.5, mode="color", legend=False, fabric="#FFFFFF", hoop=(10.0, 20.0)), images, regions, legend, places=places), 0)
    assert root.get("width") == "166mm" and root.get("height") == "126mm" and root.find(".//s:g[@id='labels']", NS) is None and root.find("s:g[@id='legend']", NS) is None
    first = root.find(".//s:g[@id='regions']/s:path", NS)
    assert first.get("fill") == "#000000" and first.get("stroke") == "none" and root.find(".//s:rect[@id='hoop']", NS).get("x") == "70"
    assert root.find(".//s:rect[@id='fabric']", NS).get("fill") == "#FFFFFF" and root.find(".//s:g[@id='lines']", NS) is None


def test_pages_are_written_in_order(tables, tmp_path):
    images, *rest = tables
    lines = svg.svg_lines(svg.Page(50, 40, 0.5), images, *rest)
    svg.write_svg(lines, str(tmp_path / "pages"))
    for img in (0, 1):
        (file,) = (tmp_path / "pages" / f"img={img}").glob("*.txt")
        assert file.read_text() == "".join(r["line"] + "\n" for r in page_of(lines, img)[1])


def test_pages_of_a_plan(spark):
    """The tables of a plan of 12 x 12 pixels: two regions, one stroke; their labels are placed by the plan."""
    t = spark.createDataFrame([(0, "310", "Black", 0, 0, 0), (1, "321", "Red", 200, 20, 40)], "ord int, number string, name string, r int, g int, b int")
    library = t.withColumns(dict(zip(LAB, color.rgb_to_oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    labels = spark.createDataFrame([(0, y * 12 + x, x, y, int(x >= 6)) for y in range(12) for x in range(12)], "img int, i long, x int, y int, label int")
    plan = Plan(labels, 12, 12, library)
    s = P.Settings(width_mm=40, height_mm=40, thread_count=2)
    chosen = library.select(F.lit(0).alias("img"), F.col("ord").alias("idx"), "number", *LAB)
    table = chosen.select("img", F.col("idx").alias("label"), *LAB)
    pixels = plan.rounds.keep(graph.chamfer(graph.components(labels)))
    rows = regions.region_graph(pixels, table, 1.0)
    legend = pattern.legend(rows.select("img", F.col("label").alias("palette_idx"), F.col("area_mm2").alias("area")))
    raw = spark.createDataFrame([(0, "marks", 7, [[(1.0, 1.0), (1.0, 4.0)]], 1.0, 3.0, 0.0, 0.0, 0.0)], f"img int, source string, comp int, paths array<array<struct<x double, y double>>>, width_px double, length_px double, {', '.join(f'{c} double' for c in LAB)}")
    sewn = plan._sewn(raw, chosen, 1.0, 2)
    out = {"settings": asdict(s), "palette": chosen, "regions": rows, "outlines": outline.vectorize(pixels, 0.5, 1, 80).withColumnRenamed("region", "comp"), "legend": legend, "strokes": sewn, "line_legend": pattern.line_legend(sewn), "places": plan._labels(rows, legend, chosen, 1.0, s), "effort": None}
    root, _ = page_of(plan.pages(out, project="Bird"), 0)
    assert [e.get("data-dmc") for e in root.findall(".//s:g[@id='regions']/s:path", NS)] == ["310", "321"] and root.find(".//s:g[@id='lines']/s:path", NS).get("data-dmc") == "310"
    assert [e.text for e in root.findall(".//s:g[@id='labels']/s:text", NS)] == ["1", "2"] and "2 regions · 2 colours · 1 lines" in "".join(root.itertext())
