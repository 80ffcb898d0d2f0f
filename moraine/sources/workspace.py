"""A shared scratch folder for the steps of a query, checkpoints and stream state."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Where each table that a ``Work`` wrote lies, while it is referenced.
_PATHS: dict[int, str] = {}


def workspace(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; local sessions without it get a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="moraine-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/moraine-{tag}-{uuid.uuid4().hex}"


class Work:
    """The steps of one operator, written in the shared folder so that a lost executor costs tasks and not rounds.

    A step goes when another takes its place or when the result is written. The result's own table stays
    for whatever reads it, and goes when the driver ends, as does what a failed operator left.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.steps: list[DataFrame] = []

    def _write(self, df: DataFrame) -> DataFrame:
        path = workspace(self.spark, "step")
        df.write.parquet(path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        _PATHS[id(out)] = path
        weakref.finalize(out, _PATHS.pop, id(out), None)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables of this or an inner operator; what was not written stays."""
        for df in tables:
            if (path := _PATHS.get(id(df))) is not None:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.steps = [s for s in self.steps if not any(s is t for t in tables)]

    def cut(self, df: DataFrame, *instead_of: DataFrame | None) -> DataFrame:
        """Write a step, in the place of others that it was made from."""
        out = self._write(df)
        self.drop(*instead_of)
        self.steps.append(out)
        return out

    def counted(self, df: DataFrame, which: Column, *instead_of: DataFrame | None) -> tuple[DataFrame, int]:
        """Write a step, and count the rows that ``which`` holds for on the way."""
        seen = Observation()
        return self.cut(df.observe(seen, F.count_if(which).alias("n")), *instead_of), seen.get["n"]

    def owns(self, df: DataFrame) -> DataFrame:
        """Take over an inner operator's result, to be removed with the steps."""
        self.steps.append(df)
        return df

    def result(self, df: DataFrame) -> DataFrame:
        """Write the result and remove the steps."""
        out = self._write(df)
        self.drop(*self.steps)
        return out
