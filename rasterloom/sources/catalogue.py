"""The thread catalogue: reading, cleaning, ordering and its colour coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import LAB, hex_to_rgb, rgb_to_hex, rgb_to_lab, rgb_to_oklab

SCHEMA = "number string, description string, red int, green int, blue int, code string, row string"
HEADER = ["Floss#", "Description", "Red", "Green", "Blue", "RGB code", "Row"]

# Corrections of the public catalogue file, by thread number, and its abbreviations in
# the order in which they are replaced.
CHOSEN_HEX = {"309": "BA4A4A", "3609": "F4AED5", "225": "FFDFD5", "210": "C39FC3", "3755": "93B4CE", "3849": "52B3AE", "3848": "419392", "890": "174923", "3830": "B95544"}
MANGLED_HEX = {"221": "883E43", "910": "187E56", "699": "056517", "869": "835E39", "310": "000000", "434": "985E33"}
CHOSEN_NAMES = {
    "666": "Bright Red", "3846": "Turquoise Light Bright", "3845": "Turquoise Medium Bright", "3844": "Turquoise Dark Bright", "311": "Navy Blue Medium", "943": "Aquamarine Medium", "890": "Pistachio Green Ultra Dark",
    "934": "Avocado Green Black", "966": "Baby Green Medium", "561": "Jade Very Dark", "608": "Bright Orange", "407": "Desert Sand Dark", "3773": "Desert Sand Medium",
}
ABBREVIATIONS = [
    ("Ult", "Ultra"), ("Vy", "Very"), ("Vry", "Very"), ("Dk", "Dark"), ("Med", "Medium"), ("Md", "Medium"), ("Lt", "Light"), ("VD", "Very Dark"),
    ("VyDk", "Very Dark"), ("Grn", "Green"), ("Brn", "Brown"), ("M", "Medium"), ("V", "Very"), ("D", "Dark"), ("U", "Ultra"),
]


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows.  A wrong header, a short row or a repeated number is an error."""
    head = spark.read.text(path).first()
    if head is None or head[0].split(",")[:7] != HEADER:
        raise ValueError("unexpected header of the catalogue")
    raw = spark.read.csv(path, header=True, schema=SCHEMA, mode="FAILFAST", quote="").withColumn("number", F.trim("number"))
    if not raw.groupBy("number").count().where("count > 1").isEmpty():
        raise ValueError("a thread number occurs twice")
    return raw


def clean_name(name: Column) -> Column:
    name = F.regexp_replace(F.trim(name), r"\s+", " ")
    for short, full in ABBREVIATIONS:
        name = F.regexp_replace(name, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\?", " "), r"\s+", " "))


def _override(spark: SparkSession, values: dict[str, str], column: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"number string, {column} string")


def clean_catalogue(raw: DataFrame) -> DataFrame:
    """number, name, r, g, b, hex, card_row, disagrees: chosen colours and names win, then the RGB columns."""
    spark = raw.sparkSession
    joined = raw
    for values, column in ((CHOSEN_HEX, "chosen"), (MANGLED_HEX, "mangled"), (CHOSEN_NAMES, "chosen_name")):
        joined = joined.join(_override(spark, values, column), "number", "left")
    r, g, b = (F.coalesce(c, F.col(own)) for c, own in zip(hex_to_rgb(F.col("chosen")), ("red", "green", "blue"), strict=True))
    out = joined.select("number", F.coalesce("chosen_name", clean_name(F.col("description"))).alias("name"), r.alias("r"), g.alias("g"), b.alias("b"), "chosen", F.upper(F.coalesce("mangled", F.trim("code"))).alias("code"), F.trim(F.regexp_replace("row", r"(?i)^row\s*", "")).alias("card_row"))
    code = rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))
    return out.withColumn("hex", code).withColumn("disagrees", F.col("chosen").isNull() & (F.concat(F.lit("#"), "code") != code)).drop("chosen", "code")


def ordered(catalogue: DataFrame) -> DataFrame:
    """Add ord, the position by card row in natural order; ties of colour distance go by it.

    Positions are running counts over the cards (the first numbers) and ranks inside a card, so that only the table of
    cards is sorted in one place.  Rows without a first or second number come before those with one."""
    parts = F.split("card_row", "-")
    rows = catalogue.withColumns({"__card": F.try_element_at(parts, F.lit(1)).try_cast("int"), "__place": F.try_element_at(parts, F.lit(2)).try_cast("int")})
    cards = rows.groupBy("__card").agg(F.count("*").alias("n"))
    before = cards.select(F.col("__card").alias("__own"), (F.sum("n").over(Window.orderBy(F.asc_nulls_first("__card"))) - F.col("n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__card").orderBy(F.asc_nulls_first("__place"), "number")) - 1
    placed = rows.withColumn("ord", inside).join(before, F.col("__card").eqNullSafe(F.col("__own")))
    return placed.withColumn("ord", (F.col("ord") + F.col("__before")).cast("int")).drop("__card", "__place", "__own", "__before")


def build_library(catalogue: DataFrame) -> DataFrame:
    """Add Lab and OKLab coordinates (lab struct; ok_* columns)."""
    channels = F.col("r"), F.col("g"), F.col("b")
    lab, oklab = rgb_to_lab(*channels), rgb_to_oklab(*channels)
    return catalogue.withColumn("lab", F.struct(*[c.alias(n) for n, c in zip("Lab", lab, strict=True)])).withColumns(dict(zip(LAB, oklab, strict=True)))


def write_library(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").parquet(path)
