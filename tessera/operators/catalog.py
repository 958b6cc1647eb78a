"""Building and matching catalogues: uniqueness, cascades, fallbacks, differences, fuzzy matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.functions.similarity import token_set_ratio, token_set_ratio_udf

#: Choices that are sent to each executor at a time.
CHOICES = 10_000


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows, failing when they are read if a key repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))))


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return assert_unique(a, key).join(assert_unique(b, key), key)


def prefer(rows: DataFrame, first: DataFrame, second: DataFrame, key_first: str, key_second: str, value: str) -> DataFrame:
    """Adds value from a preferred match, else from a fallback, row by row."""
    a, b = first.withColumnRenamed(value, "_a"), second.withColumnRenamed(value, "_b")
    return rows.join(a, key_first, "left").join(b, key_second, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def match_files(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """files(key, path, md5): outcome exact (one file), bytes (several of equal content), ambiguous or missing."""
    per = files.groupBy(key).agg(F.count("*").alias("files"), F.count_distinct("md5").alias("kinds"), F.min("path").alias("path"))
    how = F.when(F.col("files").isNull(), "missing").when(F.col("files") == 1, "exact").when(F.col("kinds") == 1, "bytes").otherwise("ambiguous")
    return rows.join(per, key, "left").withColumn("match", how).withColumn("path", F.when(how.isin("exact", "bytes"), F.col("path"))).drop("kinds")


def added(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def changed(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on both sides whose value differs."""
    return new.join(old.select(key, F.col(value).alias(f"old_{value}")), key).where(~F.col(value).eqNullSafe(F.col(f"old_{value}")))


def sync(rows: DataFrame, present: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is present, rows to report as removed)."""
    return rows.join(present.select(key), key, "left_semi"), rows.join(present.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key; the others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def fuzzy_best(rows: DataFrame, choices: DataFrame, *, text: str, choice: str, block: Column | None = None) -> DataFrame:
    """Best choice of each row by token set ratio, ties by the larger choice; a null text has none. block narrows pairs to an equal
    key on both sides, as `block` computes it from a column named text. Without it every text is compared with all choices, which
    go out in blocks of CHOICES; only the best of a block leaves a row, so pairs are never rows."""
    c = choices.select(F.col(choice).alias("choice")).where("choice is not null").distinct()
    keys = rows.columns
    if block is not None:
        pairs = rows.withColumn("_k", block).join(c.withColumn("_k", F.expr("lower(left(choice, 1))")), "_k").drop("_k")
        scored = pairs.withColumn("score", token_set_ratio_udf(F.col(text), F.col("choice")))
        return scored.groupBy(*keys).agg(F.max(F.struct("score", "choice")).alias("b")).select(*keys, F.col("b.choice").alias("choice"), F.col("b.score").alias("score"))
    schema = StructType([*rows.schema.fields, StructField("choice", StringType()), StructField("score", DoubleType())])
    parts, found = max(1, -(-c.count() // CHOICES)), None
    for part in range(parts):
        own = [r[0] for r in c.where(F.pmod(F.xxhash64("choice"), F.lit(parts)) == part).collect()]  # one block
        sent = rows.sparkSession.sparkContext.broadcast(own)

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known: dict = {None: (None, None)}
            for batch in batches:
                for t in set(batch[text]) - known.keys():
                    known[t] = max(((token_set_ratio(t, x), x) for x in sent.value), default=(None, None))
                batch["choice"] = [known[t][1] for t in batch[text]]
                batch["score"] = pd.Series([known[t][0] for t in batch[text]], dtype="float64", index=batch.index)
                known = {None: (None, None)} if len(known) > 100_000 else known
                yield batch

        one = rows.mapInPandas(best, schema)
        found = one if found is None else found.union(one)
    if parts == 1:
        return found
    return found.groupBy(*keys).agg(F.max(F.struct("score", "choice")).alias("b")).select(*keys, F.col("b.choice").alias("choice"), F.col("b.score").alias("score"))


def import_decision(score: Column, *, in_test: Column, excluded: Column, sure: float = 90, doubtful: float = 75) -> Column:
    """(decision, reason) of a matched row: skip, train-known, check or train-unknown."""
    say = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return F.when(in_test, say("skip", "in the test set")).when(excluded, say("skip", "excluded")).when(score >= sure, say("train-known", "match")).when(score >= doubtful, say("check", "doubtful match")).otherwise(say("train-unknown", "no match"))


def is_holdout(path: Column, prefixes: list[str], parts: list[str]) -> Column:
    """Is a path below a held-out prefix, or has it a held-out part."""
    below = F.lit(False)
    for p in prefixes:
        below = below | path.startswith(p)
    return below | F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def status_counts(rows: DataFrame, query: str, columns: list[str], status: str) -> DataFrame:
    """Rows by status among those whose columns, taken together, contain a text in any case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))).groupBy(status).agg(F.count("*").alias("n"))
