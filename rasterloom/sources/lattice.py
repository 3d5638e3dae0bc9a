"""Rasters out of ordinary tables: a dense run of ids becomes rows of a pixel lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 100, 100


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raster(img, i, x, y, r, g, b, a, kind, value): 100 x 100 images from the events table.

    Event n is pixel n mod 10,000 of image n div 10,000; channels are integer mixes of the columns.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    n, u, v = F.col("event_id"), F.col("user_id"), F.floor("value")
    i = n % (WIDTH * HEIGHT)
    return e.select(
        F.floor(n / (WIDTH * HEIGHT)).cast("int").alias("img"), i.alias("i"), (i % WIDTH).cast("int").alias("x"), F.floor(i / WIDTH).cast("int").alias("y"),
        ((u * 37 + n * 11) % 256).cast("int").alias("r"), ((u * 59 + n * 7 + 85) % 256).cast("int").alias("g"), ((v * 3 + n * 5) % 256).cast("int").alias("b"),
        F.when(n % 17 == 0, 0).otherwise(255).cast("int").alias("a"), F.col("event_type").alias("kind"), F.col("value"),
    )


RASTER_SQL = """raster as (
  select cast(floor(event_id / 10000) as integer) as img, event_id % 10000 as i, cast(event_id % 100 as integer) as x, cast(floor((event_id % 10000) / 100) as integer) as y,
    cast((user_id * 37 + event_id * 11) % 256 as integer) as r, cast((user_id * 59 + event_id * 7 + 85) % 256 as integer) as g,
    cast((cast(floor(value) as bigint) * 3 + event_id * 5) % 256 as integer) as b, case when event_id % 17 = 0 then 0 else 255 end as a, event_type as kind, value
  from events)"""


def part_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """threads(ord, number, name, r, g, b): the part table as a catalogue."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    return p.select(
        k.cast("int").alias("ord"), k.cast("string").alias("number"), F.col("p_name").alias("name"),
        ((k * 73 + 19) % 256).cast("int").alias("r"), ((k * 151 + 7) % 256).cast("int").alias("g"), ((k * 199 + 101) % 256).cast("int").alias("b"),
    )


THREADS_SQL = """threads as (
  select cast(p_partkey as integer) as ord, cast(p_partkey as varchar) as number, p_name as name,
    cast((p_partkey * 73 + 19) % 256 as integer) as r, cast((p_partkey * 151 + 7) % 256 as integer) as g, cast((p_partkey * 199 + 101) % 256 as integer) as b
  from part)"""
