"""Fusion of ranked lists, long lists and rerank windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse_rrf(lists: DataFrame, *, k: int = 60) -> DataFrame:
    """lists(query_id, item_id, rank from 0, ...), one row for each list and item: score = sum of 1 / (k + rank + 1)."""
    return lists.groupBy("query_id", "item_id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def fuse_max(lists: DataFrame, floor: float = -1.0) -> DataFrame:
    return lists.groupBy("query_id", "item_id").agg(F.greatest(F.max("score"), F.lit(floor)).alias("score"))


def fuse_mean(lists: DataFrame, list_col: str) -> DataFrame:
    """Mean over all lists of the query; an item that a list lacks counts 0 there."""
    n = lists.groupBy("query_id").agg(F.count_distinct(list_col).alias("n"))
    return lists.groupBy("query_id", "item_id").agg(F.sum("score").alias("s")).join(n, "query_id").select("query_id", "item_id", (F.col("s") / F.col("n")).alias("score"))


def ordered_union(segments: list[DataFrame]) -> DataFrame:
    """Lists(query_id, item_id, rank) one after another, each item where it comes first: position from 0."""
    rows = None
    for i, s in enumerate(segments):
        own = s.select("query_id", "item_id", F.lit(i).alias("segment"), F.col("rank").cast("long").alias("rank"))
        rows = own if rows is None else rows.union(own)
    first = rows.groupBy("query_id", "item_id").agg(F.min(F.struct("segment", "rank", "item_id")).alias("at"))
    return first.select("query_id", "item_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("at")) - 1).alias("position"))


def rerank_window(long_list: DataFrame, *, head: int = 25, extra: int = 25, least: float = 0.5, text_top: int = 5) -> DataFrame:
    """long_list(query_id, item_id, position, disc_hit, txt_rank): the first `head`, then outsiders whose words are
    confirmed, best first, `extra` at most, then the text's best."""
    by_hit = Window.partitionBy("query_id", F.col("position") < head).orderBy(F.col("disc_hit").desc(), "position")
    rows = long_list.withColumn("_hit", F.row_number().over(by_hit) - 1)
    inside = F.col("position") < head
    outsider = ~inside & (F.col("disc_hit") >= least) & (F.col("_hit") < extra)
    kind = F.when(inside, 0).when(outsider, 1).when(F.col("txt_rank") < text_top, 2)
    return rows.withColumn("kind", kind).where("kind is not null").drop("_hit")


def head_rerank(rows: DataFrame, *, head: int, keys: list[str]) -> DataFrame:
    """Re-orders the first `head` positions by keys, best first; the tail keeps its order."""
    order = [F.when(F.col("position") < head, F.col(k)).desc_nulls_last() for k in keys]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("position") >= head, *order, "position")) - 1)
