"""Benchmark reports: outcomes by reason and by item, intruders, readers, detectors, judges, ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.linalg import central_weight, iou
from tessera.operators.catalog import first_per_key
from tessera.operators.metrics import ratio, share


def _ranked(column: str, q: float, *, near: bool = False) -> Column:
    """The sorted value at place floor(n * q), or (near) at the whole place that is nearest to (n - 1) * q. The report is over one
    run's images, whose values fit a list."""
    n = F.count(column)
    place = F.least(F.bround((n - 1) * F.lit(q), 0) if near else F.floor(n * F.lit(q)), n - 1)
    values = F.array_sort(F.collect_list(column))
    return F.get(values, place.cast("int"))


def counters(rows: DataFrame, reason: str, *by: str) -> DataFrame:
    """Rows by reason, the frequent ones first; a null reason counts as "none"."""
    return rows.groupBy(*by, F.coalesce(F.col(reason), F.lit("none")).alias(reason)).agg(F.count("*").alias("n")).orderBy(*by, F.col("n").desc(), reason)


def per_item(rows: DataFrame) -> DataFrame:
    """rows(wine_id, known, source, group, answered, vis_rank, txt_rank, in_window, rerank_top1, final_top1, verdict, best_id,
    seq): a row for each item. Unknown items show their most frequent answer, the one met first of equally frequent ones."""
    known = F.col("known")
    only = lambda c: F.when(F.first("known"), c)
    count = lambda c: F.count_if(c)
    first = lambda c: F.min_by(c, "seq")
    base = rows.groupBy("wine_id").agg(
        first("known").alias("known"),
        F.count("*").alias("n"),
        first("source").alias("source"),
        count(F.col("answered")).alias("answered"),
        only(F.median("vis_rank")).alias("vis_rank_median"),
        only(F.median("txt_rank")).alias("txt_rank_median"),
        *[only(count(F.col(c))).alias(a) for c, a in (("in_window", "window_hit"), ("rerank_top1", "rerank_top1"), ("final_top1", "final_top1"))],
        *[only(count(F.col("verdict") == v)).alias(v) for v in ("correct", "twin")],
        F.when(~F.first("known"), first("group")).alias("group"),
    )
    answers = rows.where(~known).groupBy("wine_id", "best_id").agg(F.count("*").alias("_n"), F.min("seq").alias("_s"))
    best = answers.groupBy("wine_id").agg(F.max_by("best_id", F.struct("_n", (-F.col("_s")).alias("s"))).alias("best"))
    return base.join(best, "wine_id", "left")


def intruders(top: DataFrame, truth: DataFrame, k: int = 50, *, prefix: str = "distractor:") -> DataFrame:
    """top(query_id, rank from 0, item_id), truth(query_id, true_id): accuracy, and how many strange items reach the best k."""
    strange = F.startswith("item_id", F.lit(prefix))
    hits = top.where(F.col("rank") < k).join(truth, "query_id", "right")
    per = hits.groupBy("query_id").agg(
        F.min(F.when(F.col("item_id") == F.col("true_id"), F.col("rank"))).alias("r"),
        F.count_if(strange).alias("strange"),
        F.coalesce(F.max((F.col("rank") == 0) & strange), F.lit(False)).alias("led"),
    )
    at = lambda n: share(F.coalesce(F.col("r") < n, F.lit(False)))
    return per.agg(F.count("*").alias("n"), at(1).alias("top1"), at(5).alias("top5"), at(k).alias("recall"), F.avg("strange").alias("intruders"), F.count_if("led").alias("led_by_intruder"))


def mode_medians(rows: DataFrame, mode: str, *values: str) -> DataFrame:
    return rows.groupBy(mode).agg(*[F.median(v).alias(v) for v in values])


def vintage_tally(rows: DataFrame, years: DataFrame, *, read: str = "read", order: str = "seq") -> DataFrame:
    """rows(query, true_id, read, seq), years(true_id, years array): first row of each query as right, silent or wrong."""
    one = first_per_key(rows, "query", order).join(years, "true_id", "left")
    silent = F.col(read).isNull() | (F.col(read) == 0)
    right = ~silent & F.coalesce(F.array_contains("years", F.col(read)), F.lit(False))
    return one.agg(F.count_if(right).alias("right"), F.count_if(silent).alias("silent"), F.count_if(~silent & ~right).alias("wrong"))


def inference_summary(rows: DataFrame) -> DataFrame:
    """rows(answered, guard, text, margin, total_ms) of images without truth: one row of counts and quantiles."""
    answered = F.col("answered")
    return rows.agg(
        F.count("*").alias("n_images"),
        F.count_if(answered).alias("answered"),
        F.count_if(~answered).alias("refused"),
        F.count_if(F.coalesce(F.contains(F.col("guard"), F.lit("twin")), F.lit(False))).alias("twin_warnings"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("text_empty"),
        F.median("margin").alias("median_margin"),
        _ranked("margin", 0.1).alias("p10_margin"),
        _ranked("total_ms", 0.5).alias("p50_ms"),
        _ranked("total_ms", 0.95).alias("p95_ms"),
    )


def judge_variants(rows: DataFrame, *by: str) -> DataFrame:
    """rows(before, after, called, applied, seconds): what a second judge mends and breaks, by variant."""
    before, after, called = F.col("before"), F.col("after"), F.col("called")
    took = F.when(called, F.col("seconds"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("frames"),
        F.count_if(called).alias("calls"),
        F.count_if(before).alias("top1_before"),
        F.count_if(after).alias("top1_after"),
        F.count_if(after & ~before).alias("fixed"),
        F.count_if(before & ~after).alias("broken"),
        *[F.count_if(called & (F.col("applied") == a)).alias(a) for a in ("unverified", "consistent")],
        F.median(took).alias("p50"),
    )


def seeds_summary(rows: DataFrame, by: str, seed: str, positive: str, score: str, query: str = "query_id") -> DataFrame:
    """Ablation: rows(variant, seed, query, score, positive) to top-1 share and MRR of each variant, mean and standard
    deviation over seeds. MRR counts the scores above the best positive one; queries without a positive one count 0."""
    best = F.max(F.when(F.col(positive), F.col(score)))
    per = rows.groupBy(by, seed, query).agg(best.alias("_b"), F.max(score).alias("_m"), F.array_sort(F.collect_list(score)).alias("_s"))
    above = F.size(F.filter("_s", lambda s: s > F.col("_b")))
    rr = F.when(F.col("_b").isNull(), 0.0).otherwise(1 / (1 + above))
    runs = per.groupBy(by, seed).agg(share(F.coalesce(F.col("_b") == F.col("_m"), F.lit(False))).alias("top1"), F.avg(rr).alias("mrr"))
    return runs.groupBy(by).agg(*[f(c).alias(f"{c}_{n}") for c in ("top1", "mrr") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def reader_comparison(rows: DataFrame, *by: str) -> DataFrame:
    """rows(rank, words, seconds, family_win or null): how well the text of each reader finds its card, and how long it took."""
    return rows.groupBy(*by).agg(
        *[share(F.coalesce(F.col("rank") < k, F.lit(False))).alias(f"text_r{k}") for k in (1, 5, 50)],
        F.count("family_win").alias("family_frames"),
        F.coalesce(F.avg(F.col("family_win").cast("double")), F.lit(0.0)).alias("family_win"),
        F.avg("words").alias("words_mean"),
        (1000 * F.median("seconds")).alias("p50_ms"),
        (1000 * _ranked("seconds", 0.95, near=True)).alias("p95_ms"),
    )


def detector_evaluation(predicted: DataFrame, truth: DataFrame, *, image: str = "image") -> DataFrame:
    """predicted(image, box, score) and truth(image, box): of each image the box that would be taken, and its best overlap
    with a true one. An image without a prediction counts 0, so a detector can't gain by silence."""
    taken = predicted.groupBy(image).agg(F.max_by("box", F.struct(central_weight(F.col("box"), F.col("score")).alias("w"), "score", "box")).alias("taken"))
    met = truth.join(taken, image, "left")
    per = met.groupBy(image).agg(F.max(F.when(F.col("taken").isNotNull(), iou(F.col("taken"), F.col("box"))).otherwise(0.0)).alias("v"), F.max(F.col("taken").isNotNull()).alias("found"))
    return per.agg(F.count("*").alias("n"), share(F.col("found")).alias("detection_rate"), F.avg("v").alias("mean_iou"), share(F.col("v") >= 0.75).alias("iou_75"))


def with_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Candidate rows with the out-of-fold predictions(query_id, item_id, probability), and the true row's family as that of
    the query."""
    truth = rows.where(F.col("item_id") == F.col("true_id")).groupBy("query_id").agg(F.max("family").alias("true_family"))
    return rows.join(predictions, ["query_id", "item_id"]).join(truth, "query_id", "left")


def not_in_test(files: DataFrame, test: DataFrame, content: Column) -> DataFrame:
    """Files whose bytes are in no test file: a semi join on SHA-256 of the content on both sides."""
    return files.withColumn("sha256", F.sha2(content, 256)).join(test.select(F.sha2(content, 256).alias("sha256")).distinct(), "sha256", "left_anti")


def outcome_dump(rows: DataFrame, path: str) -> None:
    """A JSON line for each query with its outcome, ordered within a file by query."""
    rows.sortWithinPartitions("query_id").write.mode("overwrite").json(path)


def rule_grid(rows: DataFrame, rules: DataFrame, fires: Column, *, extra_false: float) -> DataFrame:
    """All cells of a grid of label rules over rows(known, correct, answered): rows that a rule answers beyond those answered
    already. best marks the first cell of the lexicographically largest (within the budget of false ones, gain - wrong, -false).
    """
    met = rows.crossJoin(F.broadcast(rules))  # a grid of some sixty cells
    names = rules.columns
    fired = ~F.col("answered") & fires
    cells = met.groupBy(*names).agg(
        F.count_if(fired & F.col("known") & F.col("correct")).alias("gain"),
        F.count_if(fired & F.col("known") & ~F.col("correct")).alias("wrong"),
        F.count_if(fired & ~F.col("known")).alias("false"),
        F.count_if(~F.col("known")).alias("_unknown"),
    )
    cells = cells.withColumn("within", F.col("false") <= extra_false * F.col("_unknown")).drop("_unknown")
    best = cells.agg(F.max_by(F.struct(*names), F.struct("within", F.col("gain") - F.col("wrong"), -F.col("false"), *[-F.col(c) for c in names])).alias("_b"))
    return cells.crossJoin(F.broadcast(best)).withColumn("best", F.struct(*names) == F.col("_b")).drop("_b")  # best is one row


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(ratio(part, whole), digits)
