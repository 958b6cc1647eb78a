"""What goes out: signals of a read text and a card, results with refusals, the second judge's verdict, review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.attributes import compare_color, compare_style
from tessera.functions.grapes import compare as compare_grapes
from tessera.functions.text import stems
from tessera.operators.search import coverage

#: Candidates that a result shows.
REPORTED = 5
STRONG_INLIERS = 30
MARGIN = 0.2
REFUSE_CONFIDENCE = 0.7
GUARD_STEP = 1e-3
SIGNALS = ("disc_hit", "disc_n", "name_cover", "winery_hit", "color_match", "style_match", "grape_match")


def signals(read: DataFrame, cards: DataFrame) -> DataFrame:
    """read(query_id, item_id, tokens, attrs, grapes) with cards(item_id, disc, disc_weights, name, name_weights, winery, attrs,
    grapes): how much of a card the text confirms, and whether colour, style and varieties agree. A card that isn't there is
    neutral: all zero."""
    c = cards.select("item_id", F.struct(*[x for x in cards.columns if x != "item_id"]).alias("_c"))
    rows = read.join(c, "item_id", "left")
    card, tokens = F.col("_c"), F.col("tokens")
    there = lambda v, none: F.when(card.isNotNull(), v).otherwise(none)
    return rows.select(
        *read.columns,
        there(coverage(tokens, card["disc"], card["disc_weights"]), 0.0).alias("disc_hit"),
        there(F.size(card["disc"]), 0).alias("disc_n"),
        there(coverage(tokens, card["name"], card["name_weights"]), 0.0).alias("name_cover"),
        there((coverage(tokens, card["winery"]) > 0).cast("int"), 0).alias("winery_hit"),
        there(compare_color(F.col("attrs.color"), card["attrs"]), 0).alias("color_match"),
        there(compare_style(F.col("attrs"), card["attrs"]), 0).alias("style_match"),
        there(compare_grapes(F.col("grapes"), card["grapes"]), 0).alias("grape_match"),
    )


def public_card(card: dict[str, Column], hidden: tuple[str, ...] = ("vector", "path", "md5")) -> Column:
    """A card without service fields."""
    return F.struct(*[c.alias(n) for n, c in card.items() if n not in hidden])


def best_candidates(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows (query_id, leader, candidates): the first REPORTED candidates as an array in order, and the first of them."""
    one = F.struct("position", "item_id", "probability", *fields)
    near = rows.where(F.col("position") < REPORTED).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    return near.withColumn("leader", F.get("candidates", F.lit(0)))


def result(rows: DataFrame, threshold: float, twins: DataFrame | None = None) -> DataFrame:
    """rows(query_id, position, item_id, probability, family, year): answered, the answer's fields (null on refusal), the first
    candidates and, with an answer, the twins(query_id, twins array) among them."""
    near = best_candidates(rows, "family", "year")
    answered = F.col("leader.probability") >= threshold
    answer = lambda c: F.when(answered, F.col(f"leader.{c}"))
    out = near.select("query_id", answered.alias("answered"), F.col("leader.probability").alias("probability"), answer("item_id").alias("item_id"), answer("family").alias("card"), answer("year").alias("year"), F.col("candidates.item_id").alias("candidates"))
    if twins is None:
        return out
    own = out.join(twins, "query_id", "left")
    return own.withColumn("twins", F.when(F.col("answered"), F.coalesce("twins", F.array().cast("array<long>"))).otherwise(F.array().cast("array<long>")))


def answer_payload(rows: DataFrame, threshold: float, *, refuse: bool = True) -> DataFrame:
    """(query_id, slug, found, probability, similar): below the threshold the slug is null (unless refuse is off) and similar
    items are offered instead."""
    near = best_candidates(rows)
    found = F.col("leader.probability") >= threshold
    slug = F.col("leader.item_id") if not refuse else F.when(found, F.col("leader.item_id"))
    return near.select("query_id", slug.alias("slug"), found.alias("found"), F.when(found, F.col("leader.probability")).alias("probability"), F.when(~found, F.col("candidates.item_id")).alias("similar"))


def judge_trigger(rows: DataFrame, threshold: float) -> DataFrame:
    """(query_id, reason): refused_strong (refused at strong geometry), same_family (the first two are of one) or margin."""
    at = lambda i: F.max(F.when(F.col("position") == i, F.struct("probability", "family", "inliers")))
    per = rows.groupBy("query_id").agg(at(0).alias("a"), at(1).alias("b"))
    a, b = F.col("a"), F.col("b")
    reason = (
        F.when(a["probability"] < threshold, F.when(a["inliers"] >= STRONG_INLIERS, "refused_strong"))
        .when(b.isNull(), None)
        .when((a["family"] != "") & (a["family"] == b["family"]), "same_family")
        .when(a["probability"] - b["probability"] < MARGIN, "margin")
    )
    return per.select("query_id", reason.alias("reason")).where("reason is not null")


def judge_options(rows: DataFrame, most: int = 8, most_family: int = 4) -> DataFrame:
    """(query_id, options): the leader and its family among the first `most` candidates; queries without such have none."""
    lead = rows.where("position = 0").select("query_id", F.col("family").alias("_f")).where("_f <> ''")
    near = rows.where(F.col("position") < most).join(lead, "query_id").where((F.col("position") == 0) | (F.col("family") == F.col("_f")))
    per = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "item_id"))).alias("o"))
    return per.where(F.size("o") > 1).select("query_id", F.slice("o", 1, most_family)["item_id"].alias("options"))


def supports_switch(read: Column, chosen: Column, leader: Column) -> Column:
    """Is a word of the chosen card that the leader lacks in the text? Words by their first letters."""
    own = F.array_except(stems(chosen), stems(leader))
    return F.arrays_overlap(own, stems(read))


def _contradicts(s: Column) -> Column:
    return F.least(s["color_match"], s["style_match"], s["grape_match"]) == -1


def consistent_pick(shown: Column, chosen: Column) -> Column:
    """Item of shown (structs of item_id and the signals) that the text confirms instead of the chosen item, or null.

    The choice only changes if the text is against it (an axis contradicts, or it has words of its own and none is there) and
    for another one, which contradicts nothing and is confirmed by its variety or a word of its own; by colour or style only if
    the choice was contradicted."""
    own = F.get(F.filter(shown, lambda s: s["item_id"] == chosen), F.lit(0))
    refuted = _contradicts(own)
    unsupported = (own["disc_n"] > 0) & (own["disc_hit"] == 0) & (own["grape_match"] != 1)

    def good(s: Column) -> Column:
        backed = (s["grape_match"] == 1) | (s["disc_hit"] > 0) | (refuted & ((s["color_match"] == 1) | (s["style_match"] == 1)))
        return (s["item_id"] != chosen) & ~_contradicts(s) & backed

    rank = lambda s, i: F.struct(s["color_match"].alias("a"), s["grape_match"].alias("b"), s["style_match"].alias("c"), F.bround(s["disc_hit"], 2).alias("d"), F.bround(s["name_cover"], 2).alias("e"), (-i).alias("f"), s["item_id"].alias("g"))
    best = F.array_max(F.filter(F.transform(shown, lambda s, i: F.when(good(s), rank(s, i))), lambda r: r.isNotNull()))
    return F.when(refuted | unsupported, best["g"])


def apply_verdict(rows: DataFrame, verdicts: DataFrame, threshold: float) -> DataFrame:
    """verdicts(query_id, options, choice from 1, confidence, error): the chosen card leads with the greater probability, a
    refusal keeps the leader below the threshold, an error changes nothing. Adds applied; positions close up."""
    v = verdicts.select("query_id", F.coalesce("error", F.lit(False)).alias("_e"), "choice", "confidence", F.when(F.col("choice").between(1, F.size("options")), F.try_element_at("options", F.col("choice"))).alias("_pick"))
    out = rows.join(v, "query_id", "left")
    picked = ~F.coalesce("_e", F.lit(True)) & F.col("_pick").isNotNull()
    refused = ~F.coalesce("_e", F.lit(True)) & F.col("choice").isNull() & (F.col("confidence") >= REFUSE_CONFIDENCE)
    chosen = picked & (F.col("item_id") == F.col("_pick"))
    p = F.when(chosen, F.greatest("probability", "confidence")).when(refused & (F.col("position") == 0), F.least(F.col("probability"), F.lit(threshold - GUARD_STEP))).otherwise(F.col("probability"))
    out = out.withColumn("probability", p).withColumn("applied", F.when(picked, "choose").when(refused, "refuse").otherwise("none"))
    order = Window.partitionBy("query_id").orderBy((~F.coalesce(chosen, F.lit(False))).cast("int"), "position")
    return out.withColumn("position", F.row_number().over(order) - 1).drop("_e", "choice", "confidence", "_pick")


def review_order(rows: DataFrame, viewer: Column, *, by: str, user: str, ts: str, key: str, limit: int) -> DataFrame:
    """Reviews of each subject: the viewer's own first, then the newest, `limit` at most."""
    order = Window.partitionBy(by).orderBy((F.col(user) == viewer).cast("int").desc(), F.col(ts).desc(), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def valid_entries(rows: DataFrame, checks: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with reasons): every check has to hold, and a key may be there once."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()], F.when(F.count("*").over(Window.partitionBy(key)) > 1, F.lit(f"{key} repeats"))))
    judged = rows.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def review_cards(reviews: DataFrame, shelf: DataFrame, *, user: str, slug: str, card: str, updated: str) -> DataFrame:
    """Reviews with the card of the reviewer's own shelf entry, else the card that any shelf got last for the item."""
    own = shelf.select(user, slug, F.col(card).alias("_own"))
    latest = shelf.groupBy(slug).agg(F.max_by(card, F.struct(updated, card)).alias("_latest"))
    return reviews.join(own, [user, slug], "left").join(latest, slug, "left").withColumn(card, F.coalesce("_own", "_latest")).drop("_own", "_latest")


def box_pairs(inner: DataFrame, outer: DataFrame, *, image: str = "image", inside: float = 0.9) -> DataFrame:
    """Pairs of boxes of one image of which the first lies within the second by a share of its area: an equi-join on the image with
    the overlap as its condition."""
    from tessera.functions.linalg import contains

    b = outer.select(image, F.col("box").alias("outer"), *[F.col(c).alias(f"outer_{c}") for c in outer.columns if c not in (image, "box")])
    return inner.join(b, image).withColumn("share", contains(F.col("outer"), F.col("box"))).where(F.col("share") >= inside)
