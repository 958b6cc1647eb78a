"""Mixing sources to target weights.

Words are summed by source. Each source aims at its share of all words by weight; a target stops at max_repeats times the
source's words, and the excess goes to the others by weight until none is above. A document is then emitted floor(rate)
times, rate = target / words of its source, plus one copy with the probability that is left over, drawn by a seeded hash
of its id. So reruns, retries and other partitionings give the same mix, and no document is ever collected.

Sources without weights of their own take weights in turn, ordered by code point with null last. A null or empty text has
size 0; a source without words has target 0 and its documents (all empty) are taken no times. Rows with equal ids draw
alike. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, words

SEED = "mix-1"
MAX_REPEATS = 3
#: Sources whose targets are sent to every executor; the targets of more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def draw(key: Column, seed: str = SEED) -> Column:
    """A value in [0, 1) that the key and the seed decide: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, *, source_col: str, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows (source, source_size, target) from rows with a source and _size.

    With caps c and weights w the targets are min(c, level * w), with the level at which they sum to all words: sources
    are filled in the order of c / w, and the level is that of the first source that stays below its cap. The table has a
    row for each source; documents never reach the ordered windows.
    """
    per = sizes.groupBy(F.col(source_col).alias("_src")).agg(F.sum("_size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("_src").isNull(), F.col("_src"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("_weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(max_repeats).cast("long") * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_src").isNull(), F.col("_src")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_weight").over(everything))
    per = per.withColumn("_filled", F.coalesce(F.sum("_cap").over(fill), F.lit(0))).withColumn("_used", F.coalesce(F.sum("_weight").over(fill), F.lit(0)))
    # the level if this source and those after it all stay below their caps; it rises up to the first that does, then falls
    per = per.withColumn("_level", (F.col("_all") - F.col("_filled")) / (F.col("_weights") - F.col("_used")))
    open_ = F.col("_level") * F.col("_weight") <= F.col("_cap")
    per = per.withColumn("_final", F.max(F.when(open_, F.col("_level"))).over(everything))
    target = F.when(F.col("_final").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_weight")))
    return per.select("_src", "source_size", target.alias("target"))


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Rows (_row, _size, _source_size, _target, _copies): each document as a struct, and how often it is emitted."""
    sized = docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("_source"), F.size(words(F.col(text_col))).cast("long").alias("_size"))
    goal = targets(sized.select("_source", "_size"), source_col="_source", weights=weights, max_repeats=max_repeats)
    goal = Scratch(docs.sparkSession).write(goal.select("_src", F.col("source_size").alias("_source_size"), F.col("target").alias("_target")))
    # a row for each source: sent, so that no document is shuffled and a hot source stays where it is read
    goal = F.broadcast(goal) if goal.count() <= BROADCAST_ROWS else goal
    rows = sized.join(goal, F.col("_source").eqNullSafe(F.col("_src")), "left")
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(draw(F.col("_row")[id_col], seed) < rate - whole, 1).otherwise(0)).cast("int")
    return rows.select("_row", "_size", "_source_size", "_target", copies.alias("_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: each document as often as it is taken, with the columns of docs."""
    return assign(docs, **options).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
