"""Features of a candidate against the other candidates of its query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = 999


def max_over_others(value: Column, by: list, key: str, default: Column) -> Column:
    """Largest value among the other rows of the group: of the two best rows the one that is not this."""
    order = Window.partitionBy(*by).orderBy(value.desc_nulls_last(), key)
    whole = Window.partitionBy(*by).orderBy(value.desc_nulls_last(), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value(value, 1).over(whole), F.nth_value(value, 2).over(whole)
    return F.coalesce(F.when(F.row_number().over(order) == 1, second).otherwise(first), default)


def min_over_others(value: Column, by: list, key: str, default: Column) -> Column:
    return -max_over_others(-value, by, key, -default)


def rerank_present(rank: str, by: str = "query_id", *tie: str) -> Column:
    """Ranks from 0 among the rows that have one; the others get MISSING."""
    present = F.col(rank) < MISSING
    order = Window.partitionBy(by, present).orderBy(rank, *tie)
    return F.when(present, F.row_number().over(order) - 1).otherwise(MISSING)


def derive(rows: DataFrame, *, rivals: str = "all") -> DataFrame:
    """Adds the cross-candidate features to rows(query_id, item_id, pos, ...). pos is the input order.

    rivals="text" measures gap and margin only against rivals that the text doesn't refute (refutes()); this pairs rows, so
    it is a join within the query; all else are windows over the query and over the query and family.
    """
    q = ["query_id"]
    w = Window.partitionBy(*q)
    seen = F.col("vis_rank") < MISSING
    geometry = F.when(F.col("homography_ok") == 1, F.col("inliers") * F.col("inlier_ratio") * F.least("geometry_query_coverage", "geometry_candidate_coverage") / (1 + F.col("geometry_normalized_error"))).otherwise(0.0)
    agree = F.col("color_match") + F.col("style_match") + F.col("grape_match")
    out = rows.withColumn("geometry_support", geometry).withColumn("attr_agree", agree)
    out = out.withColumn("_vis", rerank_present("vis_rank", "query_id", "pos")).withColumn("_txt", rerank_present("txt_rank", "query_id", "pos"))
    out = out.withColumn("_rrf", F.row_number().over(Window.partitionBy(*q).orderBy("rrf_rank", "pos")) - 1)
    visible = F.when(seen, F.col("vis_score"))
    out = out.withColumn("vis_mean", F.coalesce(F.avg(visible).over(w), F.lit(0.0))).withColumn("vis_std", F.coalesce(F.stddev_pop(visible).over(w), F.lit(0.0)))
    best = Window.partitionBy(*q).orderBy(visible.desc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.nth_value(visible, 2).over(best)
    out = out.withColumn("vis_top12_gap", F.coalesce(F.nth_value(visible, 1).over(best) - second, F.lit(0.0)))
    out = out.withColumn("vis_available", seen.cast("int")).withColumn("vis_distance", F.when(seen, 1 - F.col("vis_score")).otherwise(2.0))
    out = out.withColumn("vis_zscore", F.when(seen & (F.col("vis_std") > 1e-8), (F.col("vis_score") - F.col("vis_mean")) / F.col("vis_std")).otherwise(0.0))
    for i in range(5):
        out = out.withColumn(f"txt_top{i + 1}_score", F.coalesce(F.max(F.when(F.col("_txt") == i, F.col("txt_score"))).over(w), F.lit(-1.0)))
    out = out.withColumn("txt_in_top5", (F.col("_txt") < 5).cast("int"))
    total = F.sum("inliers").over(w)
    out = out.withColumn("inliers_share", F.col("inliers") / F.when(total == 0, 1).otherwise(total))
    margin = lambda c, d: F.col(c) - max_over_others(F.col(c), q, "pos", F.lit(d))
    out = out.withColumn("txt_margin", margin("txt_score", -1.0)).withColumn("geometry_margin", margin("geometry_support", 0.0))
    out = out.withColumn("rrf_margin", min_over_others(F.col("_rrf"), q, "pos", F.col("_rrf")) - F.col("_rrf"))
    if rivals == "all":
        out = out.withColumn("vis_gap", F.max("vis_score").over(w) - F.col("vis_score")).withColumn("inliers_gap", F.max("inliers").over(w) - F.col("inliers"))
        out = out.withColumn("vis_margin", margin("vis_score", 0.0)).withColumn("inliers_margin", margin("inliers", 0))
    else:
        out = out.join(rival_margins(out), ["query_id", "pos"])
    named = F.col("family") != ""
    f = [*q, "family"]
    out = out.withColumn("family_size", F.when(named, F.count("*").over(Window.partitionBy(*f))).otherwise(0))
    contra = max_over_others(F.col("disc_hit"), f, "pos", F.lit(0.0))
    out = out.withColumn("disc_contra", F.when(named, contra).otherwise(0.0))
    for name, c in {"vis": "vis_score", "txt": "txt_score", "inliers": "inliers", "name_cover": "name_cover", "disc": "disc_hit", "color": "color_match", "style": "style_match", "grape": "grape_match", "attr": "attr_agree"}.items():
        out = out.withColumn(f"family_{name}_margin", F.when(named, F.col(c) - max_over_others(F.col(c), f, "pos", F.col(c))).otherwise(0))
    out = out.withColumn("vis_rank", F.col("_vis")).withColumn("txt_rank", F.col("_txt")).withColumn("rrf_rank", F.col("_rrf")).drop("_vis", "_txt", "_rrf")
    return out


def refutes(rival: str, row: str, least_lines: int = 3) -> Column:
    """Does the read text rule the rival out: an axis contradicts, or none of its own words is there while the row has some."""
    r, o = (lambda c: F.col(f"{rival}.{c}")), (lambda c: F.col(f"{row}.{c}"))
    against = F.least(r("color_match"), r("style_match"), r("grape_match")) == -1
    return (r("ocr_lines") >= least_lines) & (against | ((r("disc_n") > 0) & (r("disc_hit") == 0) & (o("disc_hit") > 0)))


def rival_margins(rows: DataFrame) -> DataFrame:
    """Gap and margin against the rivals that the text leaves: rows (query_id, pos, vis_gap, ...)."""
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.pos") != F.col("b.pos")) & ~refutes("b", "a"), "left")
    found = pairs.groupBy(F.col("a.query_id").alias("query_id"), F.col("a.pos").alias("pos")).agg(
        F.first("a.vis_score").alias("_v"), F.first("a.inliers").alias("_i"), F.max("b.vis_score").alias("_bv"), F.max("b.inliers").alias("_bi")
    )
    return found.select(
        "query_id",
        "pos",
        (F.greatest("_v", "_bv") - F.col("_v")).alias("vis_gap"),
        (F.greatest("_i", "_bi") - F.col("_i")).alias("inliers_gap"),
        (F.col("_v") - F.coalesce("_bv", F.lit(0.0))).alias("vis_margin"),
        (F.col("_i") - F.coalesce("_bi", F.lit(0))).alias("inliers_margin"),
    )
