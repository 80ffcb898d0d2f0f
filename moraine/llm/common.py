"""What the training-data operators share: table access and recoverable cuts."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Words of 64 bits of a bitmap whose members are not counted: 4 MB.
WORDS = 1 << 19

#: Where each table that ``materialize`` returned lies, while it is referenced.
_PATHS: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table by the path that Spark was given."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A local-mode session without the setting gets a temporary folder of its own.
    A cluster session without it is an error: a machine-local folder would lose
    rows when another executor reads it.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="moraine-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, so a lost
    executor costs at most the tasks it was running.
    """
    path = f"{shared_root(spark)}/moraine-{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote for ``tables``, once nothing reads it any more."""
    jvm = spark._jvm
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(_PATHS[id(df)]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The tables of one query: its steps are removed once its result is written.

    The result's own table stays for whatever reads it, and goes when the driver ends, as does anything that a failed query left.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.steps: list[DataFrame] = []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Write a step."""
        self.steps.append(materialize(self.spark, df, tag))
        return self.steps[-1]

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        """Write the result and remove the steps."""
        out = materialize(self.spark, df, tag)
        discard(self.spark, *self.steps)
        self.steps.clear()
        return out


def type_of(df: DataFrame, name: str) -> str:
    """A column's type, as a schema string has it."""
    return df.schema[name].dataType.simpleString()


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    """A record batch of named columns; ids travel as Arrow columns, so nulls leave them whole."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def runs(texts: list[str | None], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``most`` characters, each with its first place."""
    run, size, at = [], 0, 0
    for k, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= most:
            yield at, run
            run, size, at = [], 0, k + 1
    if run:
        yield at, run


def bitmap(hashes: DataFrame, members: int | None = None) -> np.ndarray:
    """64-bit hashes by their low bits, as an array of words: a filter that passes all members and few others.

    ``hashes`` has one column of longs. The size follows ``members``, 256 bits each, between 4 MB
    and 32 MB, 4 MB if it is not given; a set beyond it only filters less. It is a plain
    array, so it may be sent to tasks that have nothing but numpy.
    """
    words = WORDS if members is None else min(1 << 22, max(WORDS, 1 << (4 * members).bit_length()))
    h = F.col(hashes.columns[0])
    word = F.shiftrightunsigned(h, 6).bitwiseAND(words - 1).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, cast(`{hashes.columns[0]}` & 63 as int))")
    found = hashes.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be members of a :func:`bitmap`."""
    of = words[(h >> np.uint64(6) & np.uint64(len(words) - 1)).astype(np.int64)]
    return (of >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
