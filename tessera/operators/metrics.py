"""Retrieval, decision and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 25, 50, 100)


def ratio(part: Column, whole: Column) -> Column:
    """Null where the denominator is 0."""
    return part / F.nullif(whole, F.lit(0))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def retrieval(ranks: DataFrame, *by: str, rank: str = "rank", cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """ranks has a row for each query with the rank from 0 of its answer, null for a miss: recall at the cuts, and MRR."""
    hit = lambda k: F.coalesce(F.col(rank) < k, F.lit(False))
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *[share(hit(k)).alias(f"recall_{k}") for k in cuts], F.avg(F.coalesce(1 / (F.col(rank) + 1), F.lit(0.0))).alias("mrr"))


def tie_aware_mrr(rows: DataFrame) -> DataFrame:
    """rows(query_id, score, positive): mean of 1 / (1 + rows of a greater score than the best positive), 0 without one."""
    best = rows.groupBy("query_id").agg(F.max(F.when(F.col("positive"), F.col("score"))).alias("best"))
    above = rows.join(best, "query_id").groupBy("query_id").agg(F.first("best").alias("best"), F.count_if(F.col("score") > F.col("best")).alias("above"))
    return above.agg(F.avg(F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.col("above")))).alias("mrr"))


def outcomes(rows: DataFrame, *by: str) -> DataFrame:
    """rows(known, answered, verdict): counts, precisions and coverages. overall_answered_precision also counts answers to
    unknown queries as wrong."""
    known, answered, right = F.col("known"), F.col("answered"), F.col("verdict") == "correct"
    n = lambda c: F.count_if(c)
    return rows.groupBy(*by).agg(
        n(known).alias("n_known"),
        *[n(known & (F.col("verdict") == v)).alias(v) for v in ("correct", "twin", "other", "refused")],
        ratio(n(known & right), n(known & answered)).alias("answered_precision"),
        ratio(n(known & right), n(answered)).alias("overall_answered_precision"),
        ratio(n(known & answered), n(known)).alias("coverage"),
        ratio(n(known & right), n(known)).alias("known_correct_coverage"),
    )


def false_accepts(rows: DataFrame, group: str = "group") -> DataFrame:
    """Share of unknown queries that are answered, by group and over all (group "all")."""
    sets = rows.where(~F.col("known")).rollup(group).agg(share(F.col("answered")).alias("false_accept"), F.count("*").alias("n"), F.grouping(group).alias("_g"))
    return sets.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(group)).alias(group), "false_accept", "n")


def nearest_rank(value: Column, q: float) -> Column:
    """The sorted value at place min(floor(n * q), n - 1)."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.least(F.floor(F.size(values) * F.lit(q)), F.size(values) - 1).cast("int"))


def latency(rows: DataFrame, *by: str, value: str = "latency_ms") -> DataFrame:
    return rows.groupBy(*by).agg(F.median(value).alias("p50"), nearest_rank(F.col(value), 0.95).alias("p95"), F.count("*").alias("n"))


def latency_ranked(rows: DataFrame, by: str, value: str = "latency_ms") -> DataFrame:
    """The same p95 for groups of any size: a rank instead of a list."""
    order = Window.partitionBy(by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(by))
    at = rows.withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", n)
    return at.groupBy(by).agg(F.median(value).alias("p50"), F.max(F.when(F.col("_r") == F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1), F.col(value))).alias("p95"), F.count("*").alias("n"))


#: Ranges into which ordered values are cut, so that running sums need no single task.
RANGES = 256


def running(per: DataFrame, order: str, *values: str) -> DataFrame:
    """Adds for each value the sum over all rows of a smaller order (names with _before). per has one row for each order.

    Rows are dealt to ranges between approximate quantiles; a window within each range is added to the sums of the ranges before,
    RANGES rows that are sent."""
    cuts = per.agg(F.percentile_approx(order, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 10_000).alias("c")).first()["c"] or []  # RANGES numbers
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = per.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(order))))
    sums = ranged.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    starts = sums.select("_range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}_start") for v in values])
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_range")  # RANGES rows
    return out.select(*per.columns, *[(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_{v}_start")).alias(f"{v}_before") for v in values])


def auroc(rows: DataFrame, *, score: str = "score", positive: str = "known") -> DataFrame:
    """Area under the curve from counts by distinct score and running sums over them; ties count half."""
    per = rows.groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    return running(per.where(F.col(score).isNotNull()), score, "n").agg(ratio(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)), F.sum("p").cast("double") * F.sum("n")).alias("auroc"))


def grid(spark, count: int, step: float, first: float = 0.0) -> DataFrame:
    return spark.range(count).select((F.lit(first) + F.col("id") * step).alias("threshold"))


def threshold_curves(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows(raw, known, correct): for each threshold of a small grid the shares of known queries answered, right and wrong,
    of unknown ones accepted, and the precision of answers."""
    met = rows.crossJoin(F.broadcast(thresholds))  # a grid of a few hundred rows
    over, known = F.col("raw") >= F.col("threshold"), F.col("known")
    n = lambda c: F.count_if(c)
    return met.groupBy("threshold").agg(
        ratio(n(over & known), n(known)).alias("coverage"),
        ratio(n(over & known & F.col("correct")), n(known)).alias("right"),
        ratio(n(over & known & ~F.col("correct")), n(known)).alias("wrong"),
        ratio(n(over & ~known), n(~known)).alias("false_accept"),
        ratio(n(over & known & F.col("correct")), n(over)).alias("precision"),
    )


def budget_threshold(curves: DataFrame, most_false: float) -> DataFrame:
    """Smallest threshold whose false answers stay within a budget."""
    return curves.where(F.coalesce("false_accept", F.lit(0.0)) + F.coalesce("wrong", F.lit(0.0)) <= most_false).agg(F.min("threshold").alias("threshold"))


def utility_threshold(curves: DataFrame, *, unknown_share: float, wrong_cost: float, false_cost: float) -> DataFrame:
    """Middle of the plateau on which the utility is greatest."""
    u = (1 - unknown_share) * (F.col("right") - wrong_cost * F.col("wrong")) - unknown_share * false_cost * F.col("false_accept")
    rated = curves.withColumn("utility", u)
    best = rated.agg(F.max("utility").alias("best"))
    flat = rated.crossJoin(F.broadcast(best)).where(F.col("utility") >= F.col("best") - 1e-9)  # best is one row
    return flat.agg(F.array_sort(F.collect_list("threshold")).alias("t"), F.first("best").alias("utility")).select(F.get("t", F.floor(F.size("t") / 2).cast("int")).alias("threshold"), "utility")


def precision_at_prior(right: Column, wrong: Column, false_accept: Column, unknown_share: float) -> Column:
    good = (1 - unknown_share) * right
    return ratio(good, good + (1 - unknown_share) * wrong + unknown_share * false_accept)


def confidence(candidates: DataFrame) -> DataFrame:
    """candidates(query_id, position, probability): top1, share of the best five in the sum, margin of the first two."""
    p = lambda i: F.max(F.when(F.col("position") == i, F.col("probability")))
    five = F.sum(F.when(F.col("position") < 5, F.col("probability")))
    return candidates.groupBy("query_id").agg(p(0).alias("top1"), ratio(five, F.sum("probability")).alias("top5_share"), (p(0) - F.coalesce(p(1), F.lit(0.0))).alias("margin"))


def macro(rows: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """Micro mean over rows and macro mean over the groups' means."""
    per = rows.withColumn("_v", value.cast("double")).groupBy(group).agg(F.avg("_v").alias("m"), F.sum("_v").alias("s"), F.count("_v").alias("n"))
    return per.agg((F.sum("s") / F.sum("n")).alias(f"{name}_micro"), F.avg("m").alias(f"{name}_macro"))


def most_common(column: str, *by: str):
    """Window rows -> the most frequent value of a group, ties by value: use as per = most_common(c, k)(rows)."""

    def apply(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, column).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max_by(column, F.struct(F.col("_n"), F.col(column))).alias(f"top_{column}"))

    return apply


def family_win(rows: DataFrame) -> DataFrame:
    """rows(query_id, score, positive, sibling): is the true class ahead of its best sibling (-1 where there is none)."""
    best = lambda c: F.coalesce(F.max(F.when(F.col(c), F.col("score"))), F.lit(-1.0))
    return rows.groupBy("query_id").agg((best("positive") > best("sibling")).alias("win")).agg(share(F.col("win")).alias("family_win"))


def operating_point(rows: DataFrame, coverage: float) -> DataFrame:
    """rows(top, known, correct): the cut that covers a share of known queries, false accepts and correct answers there."""
    cut = rows.where("known").agg(F.percentile("top", F.lit(1 - coverage)).alias("cut"))
    met = rows.crossJoin(F.broadcast(cut))  # cut is one row
    over = F.col("top") >= F.col("cut")
    return met.groupBy("cut").agg(ratio(F.count_if(over & ~F.col("known")), F.count_if(~F.col("known"))).alias("false_accept"), ratio(F.count_if(over & F.col("known") & F.col("correct")), F.count_if(F.col("known"))).alias("correct"))


def crop_audit(rows: DataFrame, *by: str) -> DataFrame:
    """rows(iou, retained, clipped): mean overlap and shares."""
    iou, kept = F.col("iou"), F.col("retained")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(iou).alias("mean_iou"), share(iou >= 0.5).alias("iou_50"), share(iou >= 0.75).alias("iou_75"), share(kept >= 0.99).alias("whole"), F.count_if(kept < 0.99).alias("lost"), F.count_if(F.col("clipped")).alias("clipped"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of tie-averaged ranks, from counts by value."""

    def ranks(c: str) -> DataFrame:
        per = running(rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")), c, "_n")
        return per.select(c, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(f"_{c}"))

    return rows.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"_{x}", f"_{y}").alias("spearman"))


def mean_difference(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """Difference of two groups' means in pooled standard deviations."""
    side = lambda g, f: f(F.when(group == g, F.col(value)))
    spread = F.sqrt((side(True, F.var_samp) + side(False, F.var_samp)) / 2)
    return rows.agg(ratio(side(True, F.avg) - side(False, F.avg), spread).alias("smd"))


def crowding(nearest: DataFrame, least: float = 0.95) -> DataFrame:
    """nearest(score): share of items whose nearest other item is above a similarity, and the median similarity."""
    return nearest.agg(share(F.col("score") > least).alias("crowded"), F.median("score").alias("median"))
