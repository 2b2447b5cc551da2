"""Tables in the folder that driver and executors share, to cut a plan's lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows of a few numbers that a task sorts or hashes at a time.
ROWS = 500_000


def parts(df: DataFrame) -> int:
    """How many tasks df's rows are dealt to, so that a task's share does not grow with the input."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def written(df: DataFrame) -> DataFrame:
    """df computed once and read again; a lost executor loses nothing."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = os.path.join(folder, f"facts-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
