"""Exact uniform shuffle into shards by a hypergeometric communication matrix.

Rows are dealt into source parts by a hash. The number of rows that each part sends to each shard is drawn from the
multivariate hypergeometric law with the exact part and shard sizes as margins, as a uniform permutation of all rows would
give. Each part is permuted locally and cut at the drawn counts; each shard is permuted again after the exchange. The
matrix needs the parts' row counts only: it has one row for each part, and parts are bounded by MAX_PARTS. Ranks are taken
within parts, and within slices of a shard, so no task sorts a whole shard.

Shard sizes differ by one row at most. The permutations order rows by seeded hashes of all given columns, so that equal
rows may swap and nothing else depends on the partitioning. Null values and empty texts are ordinary rows; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import Scratch

SHARDS = 8
PART_ROWS = 100_000
MAX_PARTS = 1 << 16


def hypergeometric(good: int, bad: int, n: int, u: float) -> int:
    """The quantile u of the number of good ones among n drawn without return: walks outward from the mode.

    Exact for counts of any size up to the rounding of doubles; takes about a standard deviation of steps.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    lf = math.lgamma
    choose = lambda a, b: lf(a + 1) - lf(b + 1) - lf(a - b + 1)
    peak = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    left = u - peak
    down, up, p, q = mode, mode, peak, peak
    while left >= 0 and (down > low or up < high):
        if up < high:
            q *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            left -= q
            if left < 0:
                return up
        if down > low:
            p *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p
            if left < 0:
                return down
        if p < 1e-300 and q < 1e-300:
            break
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows for parts, columns for shards, with exactly these margins."""
    assert sum(parts) == sum(shards)
    rng, left, out = random.Random(seed), list(shards), []
    for size in parts:
        row, rest, to_draw = [], sum(left), size
        for k in left:
            got = hypergeometric(k, rest - k, to_draw, rng.random())
            row.append(got)
            rest -= k
            to_draw -= got
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shuffle_into_shards(rows: DataFrame, *, shards: int = SHARDS, seed: int = 1, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard); columns of these names are replaced."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    names = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    cols = [f"c{i}" for i in range(len(names))]
    key = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *[F.col(c) for c in cols])
    held = scratch.write(rows.select(*names).toDF(*cols))
    total = held.count()
    parts = max(1, min(MAX_PARTS, math.ceil(total / part_rows)))
    dealt = held.withColumn("_part", F.pmod(key(1), F.lit(parts)).cast("int"))
    found = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # bounded: MAX_PARTS rows
    sizes = [found.get(p, 0) for p in range(parts)]
    matrix = communication_matrix(sizes, [total // shards + (s < total % shards) for s in range(shards)], seed)
    cuts = [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in enumerate(matrix)]
    plan = spark.createDataFrame(cuts, "_part int, _cuts array<bigint>")
    first = Window.partitionBy("_part").orderBy(key(2), *cols)
    ranked = dealt.withColumn("_r", F.row_number().over(first) - 1).join(F.broadcast(plan), "_part")  # MAX_PARTS rows of shards numbers
    sent = ranked.withColumn("shard", F.size(F.filter("_cuts", lambda x: x <= F.col("_r"))).cast("int")).drop("_part", "_r", "_cuts")
    # the second permutation: slices of a shard by the leading bits of the key, ranks within a slice
    slices = max(1, math.ceil(total / shards / part_rows))
    unit = (F.shiftrightunsigned(key(3), 11).cast("double") / F.lit(float(2**53))) * slices
    exchanged = scratch.write(sent.withColumn("_slice", F.least(F.floor(unit), F.lit(slices - 1)).cast("int")))
    counts = exchanged.groupBy("shard", "_slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_slice", before.alias("_before"))
    second = Window.partitionBy("shard", "_slice").orderBy(key(3), *cols)
    out = exchanged.withColumn("_r", F.row_number().over(second) - 1).join(starts, ["shard", "_slice"])
    scratch.drop(held)
    back = [F.col(c).alias(n) for c, n in zip(cols, names, strict=True)]
    return out.select(*back, "shard", (F.col("_before") + F.col("_r")).cast("long").alias("slot"))
