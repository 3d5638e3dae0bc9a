"""Saved projects as Parquet: each save is a new version of the table, the highest is the one that counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import delete, versions

SCHEMA = "id string, saved bigint, settings string, source string"


def load_projects(spark: SparkSession, path: str) -> DataFrame:
    """All saved projects (id, saved, settings, source); empty if nothing was saved."""
    found = versions(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/v{found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def _write(spark: SparkSession, path: str, table: DataFrame) -> None:
    found = versions(spark, path)
    table.write.parquet(f"{path}/v{found[-1] + 1 if found else 0}")
    for old in found[:-1]:  # the last one stays for readers that began before
        delete(spark, f"{path}/v{old}")


def save_projects(spark: SparkSession, path: str, projects: DataFrame) -> None:
    """Insert projects(id, settings, source) or replace those with the same id."""
    before = load_projects(spark, path)
    turn = (before.agg(F.max("saved")).first()[0] or 0) + 1
    new = projects.select("id", F.lit(turn).cast("bigint").alias("saved"), "settings", "source")
    _write(spark, path, before.join(new, "id", "left_anti").select("id", "saved", "settings", "source").unionByName(new))


def load_last(spark: SparkSession, path: str) -> DataFrame:
    """The project saved last; of one save the largest id."""
    return load_projects(spark, path).orderBy(F.desc("saved"), F.desc("id")).limit(1)


def prune_others(spark: SparkSession, path: str, keep: DataFrame) -> None:
    """Delete all projects but keep(id)."""
    _write(spark, path, load_projects(spark, path).join(keep.select("id").distinct(), "id", "left_semi"))
