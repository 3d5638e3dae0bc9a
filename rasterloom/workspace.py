"""Written intermediate tables for the iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that have none set, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.  A session of one machine that has
    none set, as in tests, gets a temporary one; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="rasterloom-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        at = f"file://{_OWN[app]}"
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions (folders v0, v1, ... with a success marker) under a path."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    store = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(make(path)):
        return []
    names = [f.getPath().getName() for f in store.listStatus(make(path))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and store.exists(make(f"{path}/{n}/_SUCCESS")))


class Rounds:
    """Tables of an iteration: each round is written and read back, which cuts the lineage on storage
    that outlives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n:04d}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, table: DataFrame) -> None:
        """Delete a round that nothing reads any more."""
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if f"/{self.path.rpartition('/')[2]}/" in folder + "/":
                delete(self.spark, folder)
