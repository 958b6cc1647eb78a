"""Decision rules over the scored candidates of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LINES = 3
AXES = ("color_match", "style_match", "grape_match")


def twin_guard(mode: str = "warn") -> Column:
    """Name of the guard that fires on the leading candidate's features, or null."""
    if mode not in ("off", "strict", "twin", "warn", "contra"):
        raise ValueError(f"unknown guard mode: {mode}")
    if mode == "off":
        return F.lit(None).cast("string")
    color, style = F.col("color_match") == -1, F.col("style_match") == -1
    wordless = (F.col("disc_n") > 0) & (F.col("disc_hit") == 0)
    readable = F.col("ocr_lines") >= MIN_LINES
    if mode == "strict":
        return F.when(readable & color & wordless, "twin")
    family = (F.col("winery_hit") == 1) | (F.col("disc_contra") > 0)
    nameless = (F.col("name_cover") == 0) & (F.col("winery_hit") == 0)
    twin = F.when(color | style | (wordless & (family | nameless)), "twin")
    if mode == "contra":
        twin = F.when(color | style | (F.col("grape_match") == -1), "contra").otherwise(twin)
    return F.when(readable, twin)


def apply_guard(probability: Column, guard: Column, threshold: float, vetoes: tuple[str, ...]) -> Column:
    """A guard that vetoes keeps the probability below the threshold; others only warn."""
    return F.when(guard.isin(*vetoes), F.least(probability, F.lit(threshold - 1e-3))).otherwise(probability)


def text_evidence(grape: bool = False) -> Column:
    """How well the text confirms a card; structs compare field by field."""
    parts = [F.col("color_match"), *([F.col("grape_match")] if grape else []), F.col("style_match"), F.bround("disc_hit", 2), -F.least(F.col("txt_rank"), F.lit(999)), F.bround("name_cover", 2)]
    return F.struct(*[p.alias(f"e{i}") for i, p in enumerate(parts)])


def sibling_swap(rows: DataFrame, *, grape: bool = False) -> DataFrame:
    """Rows (query_id, item_id): the sibling that the text confirms against the leader (position 0), where there is one."""
    leader = rows.where((F.col("position") == 0) & (F.col("ocr_lines") >= MIN_LINES) & (F.coalesce("family", F.lit("")) != "")).alias("a")
    other = rows.where("position > 0").alias("b")
    b, a = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"a.{c}"))
    axes = AXES if grape else AXES[:2]
    supported = b("disc_hit") > 0
    against = (a("disc_n") > 0) & (a("disc_hit") == 0) & supported
    clean = F.lit(True)
    for x in axes:
        against = against | ((a(x) == -1) & (supported | (b(x) == 1)))
        clean = clean & (b(x) != -1)
    pairs = leader.join(other, (a("query_id") == b("query_id")) & (a("family") == b("family")) & clean & against).select("b.*")
    best = pairs.groupBy("query_id").agg(F.max_by("item_id", F.struct(text_evidence(grape).alias("e"), (-F.col("position")).alias("p"))).alias("item_id"))
    return best


def label_twins(rows: DataFrame, *, ratio: float = 0.5, epsilon: float = 0.05, limit: int = 2) -> DataFrame:
    """Rows (query_id, twins): cards of the leader's family that the label doesn't tell from it, by position."""
    a, b = rows.where("position = 0").alias("a"), rows.where("position > 0").alias("b")
    same = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.family") == F.col("b.family")) & (F.col("a.family") != "") & (F.col("b.probability") >= ratio * F.col("a.probability")) & (F.abs(F.col("a.disc_hit") - F.col("b.disc_hit")) <= epsilon)
    for x in AXES:
        same = same & (F.col(f"b.{x}") != -1) & (F.col(f"a.{x}") == F.col(f"b.{x}"))
    twins = a.join(b, same).select(F.col("a.query_id").alias("query_id"), F.struct(F.col("b.position").alias("p"), F.col("b.item_id").alias("i")).alias("t"))
    return twins.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("t")), 1, limit)["i"].alias("twins"))


def label_confirmed(*, max_txt_rank: int | Column, min_disc_hit: float | Column, min_name_cover: float | Column) -> Column:
    """The label alone confirms the card, whatever its probability."""
    clean = F.least(*[F.coalesce(F.col(x), F.lit(0)) for x in (*AXES, "vintage_match")]) != -1
    return clean & (F.col("txt_rank") <= max_txt_rank) & (F.col("winery_hit") == 1) & ((F.col("disc_hit") >= min_disc_hit) | (F.col("name_cover") >= min_name_cover))


def contradiction_veto(probability: Column, factor: float) -> Column:
    return F.when(F.least(*[F.col(x) for x in AXES]) == -1, probability * factor).otherwise(probability)


def retrieval_only(rrf_rank: Column) -> Column:
    """Probability without a model: 1 / (1 + rank)."""
    return 1 / (1 + rrf_rank)


def canonicalize(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """The leader takes its canonical id; if that is a candidate already, it leads with the greater probability.

    canonical(item_id, canonical_id). Rows keep their order otherwise, and positions close up.
    """
    named = rows.join(canonical, "item_id", "left")
    lead = named.where("position = 0").select("query_id", F.coalesce("canonical_id", "item_id").alias("_lead"), F.col("probability").alias("_p"), F.col("item_id").alias("_was"))
    out = rows.join(lead, "query_id")
    leads = F.col("item_id") == F.col("_lead")
    there = F.max(leads).over(Window.partitionBy("query_id"))
    out = out.withColumn("_there", there).where((F.col("item_id") != F.col("_was")) | ~F.col("_there") | (F.col("_was") == F.col("_lead")))
    first = leads | ((F.col("item_id") == F.col("_was")) & ~F.col("_there"))
    out = out.withColumn("item_id", F.when(first, F.col("_lead")).otherwise(F.col("item_id"))).withColumn("probability", F.when(first, F.greatest("probability", "_p")).otherwise(F.col("probability")))
    order = Window.partitionBy("query_id").orderBy(~(F.col("item_id") == F.col("_lead")), "position")
    return out.withColumn("position", F.row_number().over(order) - 1).drop("_lead", "_p", "_was", "_there")


def verdict(answered: Column, known: Column, answer: Column, truth: Column, same_family: Column) -> Column:
    """Outcome of a query: correct, twin, other, refused; for unknown ones accepted or refused."""
    return F.when(~answered, "refused").when(~known, "accepted").when(answer.eqNullSafe(truth), "correct").when(same_family, "twin").otherwise("other")


def quality_notes(rules: dict[str, Column]) -> Column:
    """Messages of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in rules.items()]))


def route_reader(lines: Column, *, least: int = 3, confidence: float = 0.6) -> Column:
    """Why a second reader is asked: few lines, weak lines, or null."""
    best = F.array_max(F.transform(lines, lambda x: x["confidence"]))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) < least, "few lines").when(F.coalesce(best, F.lit(0.0)) < confidence, "weak lines")


def in_span(lines: Column, low: Column, high: Column, slack: float = 0.03) -> Column:
    """Lines whose box centre is within a span; lines without a box stay."""
    centre = lambda x: (x["box"]["x0"] + x["box"]["x1"]) / 2
    return F.filter(lines, lambda x: x["box"].isNull() | centre(x).between(low - slack, high + slack))


def judge_reason(rows: DataFrame, threshold: float, *, near: float = 0.15) -> DataFrame:
    """Queries that a second judge should see: rows (query_id, reason)."""
    first, second = F.max(F.when(F.col("position") == 0, F.struct("probability", "family"))), F.max(F.when(F.col("position") == 1, F.struct("probability", "family")))
    per = rows.groupBy("query_id").agg(first.alias("a"), second.alias("b"))
    twin = (F.col("a.family") == F.col("b.family")) & (F.col("a.family") != "") & (F.col("b.probability") >= 0.5 * F.col("a.probability"))
    reason = F.when(F.col("a.probability") < threshold, "refused").when(F.coalesce(twin, F.lit(False)), "twin").when(F.col("a.probability") < threshold + near, "near threshold")
    return per.select("query_id", reason.alias("reason")).where("reason is not null")


def puzzle_compare(guess: Column, truth: Column, near: Column) -> Column:
    return F.when(guess.eqNullSafe(truth), "ok").when(near, "near").otherwise("no")
