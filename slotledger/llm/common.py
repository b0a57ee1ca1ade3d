"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a new temporary folder; a cluster gets an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of a batch of texts that goes to a Python worker, which holds it several times over.
SMALL = 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``SMALL`` bytes for what runs within; the session is left as it was."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, SMALL)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage and survives lost executors.

    What is written stays until ``drop``, or until the application clears the folder.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing reads it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z alone."""
    return F.translate(col, UPPER, LOWER)


#: Rows of a piece of an Arrow batch. Spark bounds a batch of texts by bytes; what is made of them may be larger.
TEXT_ROWS = 500


def slices(batches: Iterable[pd.DataFrame], rows: int = TEXT_ROWS) -> Iterator[pd.DataFrame]:
    """The batches of a mapInPandas function in pieces, so that results of few texts are held at once."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.iloc[a : a + rows]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or what ``join`` gives) of an array, by doubling steps: work grows with its size times the logarithm."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def step(acc, r):
        back = lambda i: i - F.pow(F.lit(2), r).cast("int")
        return F.transform(acc, lambda v, i: F.when(back(i) >= 0, join(v, F.get(acc, back(i)))).otherwise(v))

    return F.aggregate(steps, values, step)
