"""Rules over detected boxes: the whole for a part, and flags of doubtful crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.linalg import area, axis_iou, central_weight, contains, iou

# When a box is the whole of another, and when a crop is doubtful.
INSIDE, SAME_COLUMN, TALLER = 0.9, 0.8, 1.2
COVERAGE, EDGE, NECK, LOW_SCORE, SMALL = 0.85, 0.02, 0.45, 0.6, 120.0
OTHER_SCORE, OTHER_IOU, SAME_CROP = 0.3, 0.3, 0.8


def expand_partial(boxes: DataFrame, *, image: str = "image", least_score: float = 0.0) -> DataFrame:
    """boxes(image, box, score): of each image the box that is taken; where another one holds nearly all of it in the same
    column and is clearly taller, that one (the surest of several)."""
    one = F.struct("box", "score")
    best = boxes.groupBy(image).agg(F.max_by(one, F.struct(central_weight(F.col("box"), F.col("score")).alias("w"), "score", "box")).alias("_best"))
    met = boxes.join(best, image)
    own, b = F.col("_best.box"), F.col("box")
    tall = lambda x: x["y1"] - x["y0"]
    whole = (b != own) & (F.col("score") >= least_score) & (contains(b, own) >= INSIDE) & (axis_iou(b["x0"], b["x1"], own["x0"], own["x1"]) >= SAME_COLUMN) & (tall(b) >= TALLER * tall(own))
    out = met.groupBy(image).agg(F.first("_best").alias("_best"), F.max(F.when(whole, F.struct("score", "box"))).alias("_whole"))
    return out.select(image, F.coalesce(F.col("_whole.box"), F.col("_best.box")).alias("box"), F.col("_whole").isNotNull().alias("expanded"))


def crop_flags(bottle: Column, label: Column, score: Column, others: Column, foreground: Column, frame: Column) -> Column:
    """Flags of a reference picture: boxes are structs in pixels, null where nothing was found; frame is the whole picture;
    others are structs of box and score."""
    outer = F.coalesce(bottle, foreground, frame)
    fg = F.coalesce(foreground, frame)
    height = outer["y1"] - outer["y0"]
    covered = (F.least(bottle["y1"], foreground["y1"]) - F.greatest(bottle["y0"], foreground["y0"])) / F.nullif(foreground["y1"] - foreground["y0"], F.lit(0.0))
    margin = EDGE * height
    cut = ((label["y1"] >= bottle["y1"] - margin) & (bottle["y1"] < fg["y1"] - margin)) | ((label["y0"] <= bottle["y0"] + margin) & (bottle["y0"] > fg["y0"] + margin))
    level = ((label["y0"] + label["y1"]) / 2 - outer["y0"]) / height
    rival = F.exists(others, lambda o: (o["score"] >= OTHER_SCORE) & (iou(o["box"], label) < OTHER_IOU) & (area(o["box"]) >= area(label)))
    there = label.isNotNull()
    rules = {
        "no_bottle": bottle.isNull(),
        "bottle_truncated": bottle.isNotNull() & foreground.isNotNull() & (F.coalesce(covered, F.lit(1.0)) < COVERAGE),
        "no_label": ~there,
        "label_clipped": there & bottle.isNotNull() & cut,
        "label_on_neck": there & (level < NECK),
        "low_score": there & (score < LOW_SCORE),
        "small_label": there & (F.least(label["x1"] - label["x0"], label["y1"] - label["y0"]) < SMALL),
        "ambiguous": there & rival,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def crop_status(flags: Column, decision: Column, retry_flags: Column, same_crop: Column) -> Column:
    """ok, repaired, manual, accepted or review. decision is what a person said (accepted, a rectangle's source, or null);
    retry_flags are those after the mended bottle (null: it couldn't be mended), same_crop the overlap of both crops."""
    return (
        F.when(decision == "accepted", "accepted")
        .when(decision.isNotNull(), "manual")
        .when(F.size(flags) == 0, "ok")
        .when(retry_flags.isNull() | (F.size(retry_flags) > 0), "review")
        .when(same_crop > SAME_CROP, "ok")
        .otherwise("repaired")
    )
