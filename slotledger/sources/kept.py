"""Intermediate tables that several parts of a query read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and read it back, where each reader would make it anew.

    Files are many times smaller than the rows in them, and Spark, which goes by the size of files, would send a whole log through the
    driver to broadcast it; so joins of rows that are as many as events or episodes ask for a merge by ``hint``.
    What is written stays until the application clears the folder. A local session without the setting gets a temporary
    folder, a cluster an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
