"""Tables that a job writes for itself, to cut lineage and to fix row positions."""

from __future__ import annotations

import tempfile
from functools import reduce
from operator import add
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 128 * 1024 * 1024


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a new one only where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="repoweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and read back, so that every reader sees the same rows."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(table: DataFrame) -> bool:
    """Whether all values of a written table of plain columns stay within ``BROADCAST_BYTES``.

    Strings and binary values are measured.
    """
    measured = (T.StringType, T.BinaryType)
    widths = [
        F.octet_length(f"`{f.name}`") if isinstance(f.dataType, measured) else F.lit(8) for f in table.schema
    ]
    total = table.agg(F.sum(reduce(add, widths))).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is measured to be small enough."""
    return F.broadcast(table) if fits_broadcast(table) else table
