"""Exact duplicates by a streaming aggregation whose keyed state lives on disk and never expires.

The table is staged once with a locator for each row (its number in the staged table).  A stream
over the staged rows keeps, for every digest, the row that stays (size, stable identifier, locator)
and the number of rows in RocksDB state below the shared folder; Spark combines rows on the map
side, so a digest held by a third of all rows is a few rows per task in the shuffle.  The state is
then read as a table.  The full texts of a digest with hits are compared byte by byte, equal ones
combined before the shuffle, and a digest whose texts differ is split by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoweave.llm.common import BLANK, new_folder, stored, stored_path, wrapped
from repoweave.sources.scratch import broadcast_if_small

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the state store: all instances of an executor share this much memory, none stays open
#: after its task, and log files take no room in advance.
_STATE = {
    _PROVIDER: _ROCKSDB,
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    """The text without its ASCII blanks; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _best() -> Column:
    """Least is best: most code points, then a known and small identifier, then the locator."""
    return F.min(
        F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")
    ).alias("best")


def keyed_state(spark: SparkSession, path: str, files_per_batch: int = 1_000_000) -> DataFrame:
    """Per digest the best row and the number of rows, from the state of a finished stream over ``path``.

    A restarted run of the same checkpoint would go on from the last batch; new files add to the state.
    """
    held = new_folder(spark, "dedup-state")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    groups = rows.parquet(path).groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("group_size"))
    with _settings(spark, _STATE):
        query = (
            groups.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", held).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(held)
        return stored(_state_columns(state), "dedup-groups")


def _state_columns(state: DataFrame) -> DataFrame:
    """The aggregate's buffers have generated names; their order is that of the aggregates."""
    best, count = (f.name for f in state.schema["value"].dataType)
    return state.select(
        F.col("key").getField(state.schema["key"].dataType.names[0]).alias("digest"),
        F.col("value").getField(best).alias("best"),
        F.col("value").getField(count).alias("group_size"),
    )


def stage(docs: DataFrame, digest: Callable[[Column], Column] = text_digest) -> tuple[str, DataFrame]:
    """Whole rows with locator, digest, size and hash, written once."""
    text = normalised(F.col("text"))
    rows = wrapped(
        docs,
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(text).alias("digest"),
        F.lower(F.sha2(text, 256)).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"),
    )
    path = stored_path(rows, "dedup-staged")
    return path, docs.sparkSession.read.schema(rows.schema).parquet(path)


def find_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = text_digest) -> tuple[DataFrame, DataFrame]:
    """The staged rows, and one row per row: _row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII blanks; null text is empty, and all empty texts
    are one group.  The row with the most code points stays, then the smallest doc_id (null last);
    of rows repeated with the same doc_id exactly one stays.  No rows give no rows.
    """
    spark = docs.sparkSession
    path, staged = stage(docs, digest)
    if staged.isEmpty():
        empty = "_row long, doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
        return staged, spark.createDataFrame([], empty)
    groups = keyed_state(spark, path)
    # All texts of a digest with hits are compared in full: equal ones are combined on the map side, so a
    # group of any size is one text per task in the shuffle, and texts held once stay put.
    several = stored(groups.where("group_size > 1").select("digest"), "dedup-hits")
    texts = staged.select("digest", F.col("_doc.text").alias("text")).join(broadcast_if_small(several), "digest")
    distinct = texts.select("digest", normalised(F.col("text")).alias("same")).distinct()
    unlike = stored(
        distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-unlike"
    )
    rows = staged.select("_row", "doc_id", "digest", "text_sha256")
    found = rows.join(groups, "digest").select("_row", "doc_id", "text_sha256", "best", "group_size", "digest")
    if not unlike.isEmpty():
        whole = staged.join(unlike, "digest").withColumn("same", normalised(F.col("_doc.text")))
        split = whole.groupBy("digest", "same").agg(_best(), F.count(F.lit(1)).alias("group_size"))
        parted = whole.select("_row", "doc_id", "text_sha256", "digest", "same").join(split, ["digest", "same"])
        found = found.join(unlike, "digest", "left_anti").unionByName(parted.drop("same"))
    decided = found.select(
        "_row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("bigint"),
        (F.col("_row") == F.col("best._row")).alias("kept"), "text_sha256",
    )
    return staged, decided


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    staged, decided = find_duplicates(docs)
    gone = stored(decided.where(~F.col("kept")).select("_row"), "dedup-gone")
    return staged.join(broadcast_if_small(gone), "_row", "left_anti").select("_doc.*")
