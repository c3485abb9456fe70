"""Tables in between, written to the folder that the cluster shares, for iterative operators.

They are left in ``spark.checkpoint.dir`` when a query ends, as its result may still be read from them;
whoever owns that folder empties it between applications.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own on a local master, else an error.

    On a cluster a folder of the driver's machine would take each executor's part to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="sightline-"))
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sightline_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._sightline_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Levels:
    """A table that grows by levels: each is written once, and all are read as one, with the column ``depth``."""

    def __init__(self, first: DataFrame, label: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.add(first, 0)

    def add(self, df: DataFrame, depth: int) -> DataFrame:
        path = f"{self.path}/depth={depth}"
        df.write.parquet(path)
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def table(self) -> DataFrame:
        schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema), "depth int"]
        return self.spark.read.schema(", ".join(schema)).option("basePath", self.path).parquet(self.path)
