"""Writers: indexes, logs, resumable outputs and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_index(vectors: DataFrame, path: str) -> None:
    """Vectors with their payload as Parquet, clustered by id; Spark's committer makes the write atomic."""
    vectors.repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a folder of its
    own; on a cluster that fails, as no machine's own folder would do."""
    import re
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def log_stream(rows: DataFrame, path: str, checkpoint: str):
    """Appends a stream to JSON lines: one query is the one writer, and its checkpoint makes every row appear once. Readers poll
    the folder as a stream of files."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be computed."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def same_metadata(a: dict, b: dict) -> None:
    """A resumed output has to have been made with equal settings."""
    if a != b:
        raise ValueError("settings differ: " + ", ".join(sorted(k for k in {*a, *b} if a.get(k) != b.get(k))))


def carry_over(old: DataFrame, keep: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is to be kept, and the new ones."""
    return old.join(keep.select(key).distinct(), key, "left_semi").unionByName(new)


def write_split(rows: DataFrame, good: Column, path: str, rejected: str) -> None:
    """Good rows and a side output of the others."""
    rows.where(good).write.mode("overwrite").option("header", True).csv(path)
    rows.where(~F.coalesce(good, F.lit(False))).write.mode("overwrite").option("header", True).csv(rejected)


def merge(old: DataFrame, new: DataFrame, key: str, newer: Column) -> DataFrame:
    """Rows by key: the new one where newer (over columns old and new) holds or there is no old one, else the old one."""
    o, n = old.select(key, F.struct(*old.columns).alias("old")), new.select(key, F.struct(*new.columns).alias("new"))
    row = F.when(F.col("old").isNull() | (F.col("new").isNotNull() & newer), F.col("new")).otherwise(F.col("old"))
    return o.join(n, key, "full").select(row.alias("r")).select("r.*")
