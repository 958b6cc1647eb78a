"""Pieces that several training-data operators share: words, scratch tables, streamed groups.

Words are maximal runs of anything but space and the characters 0x09 to 0x0D. A null text has no words.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Rows and bytes of an Arrow batch at most (or one row), so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z alone: other letters keep their case, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes for the session's later queries; smaller settings of the user stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a folder of
    its own; on a cluster that fails, as no machine's own folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors.

    drop() deletes a table that nothing will read again; what remains goes when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tessera-{uuid.uuid4().hex}"
        fs, at = self._fs(path)
        fs.deleteOnExit(at)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        # what the write shuffled is garbage now; Spark deletes such files once the driver has collected it
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for x in tables:
            if x is not None and id(x) in self.paths:
                fs, at = self._fs(self.paths.pop(id(x))[0])
                fs.delete(at, True)


def packs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal key, each as short as it can be with `rows` rows at least, of rows sorted by key."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        edges = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
        begin = 0
        for edge in ([0] if held and values[0] != last else []) + edges:
            if size + edge - begin >= rows:
                if edge > begin:
                    held.append(batch.slice(begin, edge - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, edge
        held.append(batch.slice(begin))
        size += batch.num_rows - begin
        last = values[-1]
    if held:
        yield pa.Table.from_batches(held)


def connected(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Labels of the connected components of edges(a, b): rows (node, component) with the smallest node of each.

    Alternates large-star and small-star steps, each a partially aggregated minimum and a join, so that a hub of any
    degree never has to sit in one task as a list. Ends when a round changes nothing. Nodes are long; a self-loop
    yields a component of its own. No edges: no rows.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = scratch.write(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seal = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    mark = seal(now)
    for _ in range(rounds):
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(now.where("a = b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        new = scratch.write(small.where("a <> b").union(now.where("a = b")).distinct())
        scratch.drop(now)
        now, before = new, mark
        mark = seal(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))
