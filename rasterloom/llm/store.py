"""Where intermediate tables go: the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..workspace import delete, shared_dir


class Workspace:
    """A folder of its own for one run of an operator.

    ``keep`` writes a table and reads it back: lineage is cut there, so a lost executor costs at
    most the stage that was running, and the files are on storage that outlives executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        self._n += 1
        at = f"{self.path}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace that nothing reads any more."""
        for table in tables:
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                if "/" + self.path.split("/")[-1] + "/" in folder + "/":
                    delete(self.spark, folder)
