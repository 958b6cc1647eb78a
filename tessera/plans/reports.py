"""Benchmark reports, results and box rules over the given tables. Line items stand for benchmark queries, orders for boxes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import game, linalg, similarity
from tessera.operators import answers, boxes, decisions, fusion, groups, learning, metrics, reports, search
from tessera.plans import decisions as base
from tessera.plans import search as retrieval
from tessera.plans._tables import table
from tessera.sources import writers


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    seq = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    return li.select(
        F.col("l_suppkey").alias("wine_id"),
        (F.col("l_suppkey") % 5 != 0).alias("known"),
        F.col("l_linestatus").alias("source"),
        F.col("l_returnflag").alias("group"),
        (F.col("l_discount") >= 0.03).alias("answered"),
        (F.col("l_partkey") % 60).alias("vis_rank"),
        (F.col("l_partkey") * 7 % 50).alias("txt_rank"),
        (F.col("l_partkey") % 60 < 12).alias("in_window"),
        (F.col("l_tax") > 0.04).alias("rerank_top1"),
        (F.col("l_partkey") % 3 == 0).alias("final_top1"),
        F.when(F.col("l_discount") < 0.03, "refused").when(F.col("l_partkey") % 3 == 0, "correct").when(F.col("l_partkey") % 7 == 0, "twin").otherwise("other").alias("verdict"),
        (F.col("l_partkey") % 9).alias("best_id"),
        seq.alias("seq"),
    )


_B = """b as materialized (select l_suppkey wine_id, l_suppkey % 5 <> 0 known, l_linestatus source, l_returnflag grp, l_discount >= 0.03 answered, l_partkey % 60 vis_rank, l_partkey * 7 % 50 txt_rank,
  l_partkey % 60 < 12 in_window, l_tax > 0.04 rerank_top1, l_partkey % 3 = 0 final_top1, case when l_discount < 0.03 then 'refused' when l_partkey % 3 = 0 then 'correct' when l_partkey % 7 = 0 then 'twin' else 'other' end verdict,
  l_partkey % 9 best_id, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey seq from lineitem)"""


def counters_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bench(spark, sf).withColumn("reason", F.when(F.col("verdict") != "other", F.col("verdict")))
    return reports.counters(rows, "reason", "group")


def per_item_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.per_item(_bench(spark, sf))


def intruders_at_50(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    hits = search.vector_topk_blocked(retrieval._queries(v, "vec_id"), v, 50, query_id="vec_id", item_id="vec_id", exclude_self=True)
    names = v.select(F.col("vec_id").alias("item_id"), F.when(F.col("label") == 0, F.concat(F.lit("distractor:"), F.col("vec_id"))).otherwise(F.col("vec_id").cast("string")).alias("name"))
    top = hits.join(names, "item_id").select("query_id", "rank", F.col("name").alias("item_id"))
    truth = retrieval._queries(v, "vec_id").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).cast("string").alias("true_id"))
    return _rounded(reports.intruders(top, truth), "top1", "top5", "recall", "intruders")


def mode_medians(spark: SparkSession, sf: str) -> DataFrame:
    return reports.mode_medians(table(spark, sf, "events"), "event_type", "value", "user_id")


def vintage_tally(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    read = F.when(F.col("l_partkey") % 4 == 0, 0).otherwise(2000 + F.col("l_partkey") % 25 + F.col("l_linenumber") % 2).cast("int")
    rows = li.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("true_id"), read.alias("read"), ((F.col("l_linenumber") * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("seq"))
    years = table(spark, sf, "part").select(F.col("p_partkey").alias("true_id"), F.array((2000 + F.col("p_partkey") % 25).cast("int")).alias("years"))
    return reports.vintage_tally(rows, years)


def inference_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = li.select((F.col("l_discount") >= 0.03).alias("answered"), F.when(F.col("l_returnflag") == "R", "twin").when(F.col("l_returnflag") == "A", "contra").alias("guard"), F.when(F.col("l_quantity") >= 5, F.col("l_linestatus")).alias("text"), F.col("l_discount").alias("margin"), F.col("l_extendedprice").alias("total_ms"))
    return _rounded(reports.inference_summary(rows), "median_margin", "p10_margin", "p50_ms", "p95_ms")


def judge_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("variant"),
        (F.col("l_tax") > 0.02).alias("before"),
        (F.col("l_discount") > 0.02).alias("after"),
        (F.col("l_quantity") > 10).alias("called"),
        F.when(F.col("l_partkey") % 5 == 0, "unverified").when(F.col("l_partkey") % 3 == 0, "consistent").otherwise("judge").alias("applied"),
        (F.col("l_quantity") / 10).alias("seconds"),
    )
    return _rounded(reports.judge_variants(rows, "variant"), "p50")


def feature_ablation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("variant"), (F.col("l_linenumber") % 3).alias("seed"), F.col("l_orderkey").alias("query_id"), F.round("l_discount", 2).alias("score"), (F.col("l_suppkey") % 3 == 0).alias("positive"))
    return _rounded(reports.seeds_summary(rows, "variant", "seed", "positive", "score"), "top1_mean", "top1_std", "mrr_mean", "mrr_std")


def reader_comparison(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select("event_type", (F.col("event_id") % 70).alias("rank"), F.col("user_id").alias("words"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0).alias("family_win"))
    return _rounded(reports.reader_comparison(rows, "event_type"), "text_r1", "text_r5", "text_r50", "family_win", "words_mean", "p50_ms", "p95_ms")


def _order_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box for each order in the picture of its customer."""
    x, y = F.col("o_orderkey") % 37 / 74.0, F.col("o_orderkey") % 23 / 46.0
    w, h = 0.1 + F.col("o_orderkey") % 5 / 20.0, 0.2 + F.col("o_orderkey") % 7 / 20.0
    box = linalg.box(x, y, x + w, y + h)
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("image"), "o_orderkey", box.alias("box"), (F.col("o_orderkey") % 10 / 10.0).alias("score"))


_BOXES = """o as materialized (select o_custkey image, o_orderkey, x x0, y y0, x + w x1, y + h y1, score from (select o_custkey, o_orderkey, (o_orderkey % 37 / 74.0)::double x, (o_orderkey % 23 / 46.0)::double y, 0.1::double + (o_orderkey % 5 / 20.0)::double w, 0.2::double + (o_orderkey % 7 / 20.0)::double h, (o_orderkey % 10 / 10.0)::double score from orders)),
  k as materialized (select *, score * (1 - least(1, sqrt(pow((x0 + x1) / 2 - 0.5, 2) + pow((y0 + y1) / 2 - 0.5, 2)))) * sqrt((x1 - x0) * (y1 - y0)) weight from o),
  best as materialized (select * from (select *, row_number() over (partition by image order by weight desc, score desc, x0 desc, y0 desc, x1 desc, y1 desc) r from k) where r = 1)"""


def detector_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    truth = table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), linalg.box(F.lit(0.2), F.lit(0.2), F.lit(0.6), 0.5 + F.col("c_custkey") % 5 / 10.0).alias("box"))
    return _rounded(reports.detector_evaluation(_order_boxes(spark, sf), truth), "detection_rate", "mean_iou", "iou_75")


def partial_boxes(spark: SparkSession, sf: str) -> DataFrame:
    out = boxes.expand_partial(_order_boxes(spark, sf))
    return out.select("image", *[F.round(F.col("box")[c], 9).alias(c) for c in ("x0", "y0", "x1", "y1")], "expanded")


def crop_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Reference pictures made of orders: sizes in pixels follow the key."""
    k = F.col("o_orderkey")
    px = lambda a, b, c, d: linalg.box(a, b, c, d)
    frame = px(F.lit(0), F.lit(0), F.lit(1000), F.lit(1500))
    foreground = F.when(k % 4 > 0, px(F.lit(200), F.lit(100), F.lit(800), F.lit(1400)))
    bottle = F.when(k % 9 > 0, px(F.lit(220), F.lit(100) + k % 11 * 20, F.lit(780), F.lit(1400) - k % 7 * 40))
    label = F.when(k % 13 > 0, px(F.lit(300), F.lit(200) + k % 31 * 20, F.lit(300) + 60 + k % 17 * 20, F.lit(400) + k % 31 * 20 + k % 29 * 20))
    other = F.struct(px(F.lit(500), F.lit(900), F.lit(500) + k % 19 * 20, F.lit(1300)).alias("box"), (k % 10 / 10.0).alias("score"))
    flags = boxes.crop_flags(bottle, label, k % 12 / 10.0, F.array(other), foreground, frame)
    status = boxes.crop_status(flags, F.when(k % 50 == 0, "accepted").when(k % 51 == 0, "rectangle"), F.when(k % 3 == 0, F.array().cast("array<string>")), k % 10 / 10.0)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"), status.alias("status"))


def label_rule_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All sixty cells of a grid of label rules, and the one to take."""
    best = base._scored(spark, sf).where("position = 0").withColumn("vintage_match", F.lit(0))
    rows = best.withColumn("known", F.col("query_id") % 5 != 0).withColumn("correct", F.col("inliers") % 3 > 0).withColumn("answered", F.col("probability") >= 0.6)
    rules = spark.createDataFrame([(r, d, c) for r in (0, 1) for d in (0.34, 0.5, 0.67, 0.8, 1.0) for c in (0.5, 0.6, 0.7, 0.8, 0.9, 1.01)], "max_txt_rank int, min_disc_hit double, min_name_cover double")
    fires = decisions.label_confirmed(max_txt_rank=F.col("max_txt_rank"), min_disc_hit=F.col("min_disc_hit"), min_name_cover=F.col("min_name_cover"))
    return reports.rule_grid(rows, rules, fires, extra_false=0.02)


def out_of_fold_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.candidates(spark, sf).withColumn("true_id", F.when(F.col("inliers") % 3 > 0, F.col("item_id")).otherwise(F.lit(-1)))
    predictions = rows.where("pos % 2 = 0").groupBy("query_id", "item_id").agg(F.max(F.round(F.col("vis_score") * 0.5, 6)).alias("probability"))
    return reports.with_predictions(rows, predictions).select("query_id", "pos", "probability", "true_family")


def files_not_in_test(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return reports.not_in_test(d, d.where("doc_id % 20 = 0"), F.col("text").cast("binary")).select("doc_id", "sha256")


def result_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = base._scored(spark, sf).withColumn("year", (2000 + F.col("item_id") % 25).cast("int"))
    out = answers.result(rows, 0.6, decisions.label_twins(base._scored(spark, sf), epsilon=0.5))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("query_id", "answered", F.round("probability", 6).alias("probability"), "item_id", "card", "year", text("candidates"), text("twins"))


def answer_payload(spark: SparkSession, sf: str) -> DataFrame:
    out = answers.answer_payload(base._scored(spark, sf), 0.6)
    return out.select("query_id", "slug", "found", F.round("probability", 6).alias("probability"), F.array_join(F.col("similar").cast("array<string>"), ",").alias("similar"))


def judge_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return answers.judge_trigger(base._scored(spark, sf), 0.6)


def judge_options(spark: SparkSession, sf: str) -> DataFrame:
    return answers.judge_options(base._scored(spark, sf)).select("query_id", F.array_join(F.col("options").cast("array<string>"), ",").alias("options"))


def judge_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts made of the order key: errors, refusals, choices within and beyond the options."""
    rows = base._scored(spark, sf).select("query_id", "position", "item_id", "probability")
    k = F.col("query_id")
    verdicts = answers.judge_options(base._scored(spark, sf)).select("query_id", "options", (k % 7 == 0).alias("error"), F.when(k % 5 > 0, (k % 4).cast("int")).alias("choice"), (k % 10 / 10.0).alias("confidence"))
    return answers.apply_verdict(rows, verdicts, 0.6).select("query_id", "position", "item_id", F.round("probability", 6).alias("probability"), "applied")


def consistent_picks(spark: SparkSession, sf: str) -> DataFrame:
    """For the leader of each query the candidate that the text confirms instead."""
    shown = F.struct("pos", F.col("pos").alias("item_id"), *[c for c in answers.SIGNALS if c != "winery_hit"])
    per = base.candidates(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("shown"))
    return per.select("query_id", answers.consistent_pick(F.col("shown"), F.col("shown")[0]["item_id"]).alias("pick")).where("pick is not null")


def review_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return answers.review_order(e, F.lit(7), by="event_type", user="user_id", ts="ts", key="event_id", limit=200).select("event_type", "event_id", "place")


def rejected_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as shelf entries: a value in range, a known kind, one entry for each user and second."""
    e = table(spark, sf, "events").withColumn("slot", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    checks = {"value": F.col("value") <= 50, "kind": F.col("event_type").isin("click", "view", "purchase"), "props": F.length("props") < 100}
    _, bad = answers.valid_entries(e, checks, "slot")
    return bad.select("event_id", F.array_join("reasons", ",").alias("reasons"))


def guard_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Guards, vetoes and the score without a model on every candidate."""
    rows = base._scored(spark, sf).withColumn("disc_contra", F.lit(0.0))
    guard = decisions.twin_guard("contra")
    p = F.col("probability")
    return rows.select("query_id", "pos", F.round(decisions.apply_guard(p, guard, 0.6, ("contra",)), 9).alias("guarded"), F.round(decisions.contradiction_veto(p, 0.5), 9).alias("vetoed"), F.round(decisions.retrieval_only(F.col("rrf_rank")), 9).alias("retrieval_only"))


def canonical_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """Even items stand for the odd ones before them."""
    rows = base._scored(spark, sf).groupBy("query_id", "item_id").agg(F.min("position").alias("position"), F.round(F.max("probability"), 6).alias("probability"))
    order = Window.partitionBy("query_id").orderBy("position")
    rows = rows.withColumn("position", F.row_number().over(order) - 1)
    ids = table(spark, sf, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") - 1).alias("canonical_id"))
    return decisions.canonicalize(rows, ids).select("query_id", "item_id", "position", "probability")


def budget_threshold(spark: SparkSession, sf: str) -> DataFrame:
    curves = metrics.threshold_curves(base._outcomes(spark, sf), metrics.grid(spark, 20, 0.05))
    priors = curves.where("threshold > 0.57 and threshold < 0.62").select(F.round(metrics.precision_at_prior(F.col("right"), F.col("wrong"), F.col("false_accept"), 0.2), 6).alias("precision"))
    return metrics.budget_threshold(curves, 0.5).crossJoin(priors).select(F.round("threshold", 2).alias("threshold"), "precision")  # one row each


def family_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.candidates(spark, sf).select("query_id", F.col("vis_score").alias("score"), (F.col("inliers") % 5 == 0).alias("positive"), (F.col("inliers") % 5 == 1).alias("sibling"))
    return _rounded(metrics.family_win(rows), "family_win")


def puzzle_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    of = lambda size, brand, kind, name: F.struct(size.alias("color"), brand.alias("region"), kind.alias("grape"), name.alias("winery"))
    guess = of(F.col("p_size") % 3, F.col("p_size") % 4, F.col("p_type"), F.col("p_brand"))
    cells = game.puzzle_cells(guess, of(F.lit(1), F.lit(2), F.lit("PROMO"), F.lit("Brand#3")))
    hints = game.puzzle_hints([F.col("p_brand"), F.col("p_type"), F.col("p_name")], F.col("p_size") % 7 == 0, F.col("p_size") % 4)
    return p.select("p_partkey", F.array_join(cells, ",").alias("cells"), F.array_join(hints, "|", "-").alias("hints"))


def plot_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Plots made of events: planted at the event, looked at some hours later."""
    e = table(spark, sf, "events")
    h = 3_600_000
    planted, now = F.lit(0), F.col("event_id") % 120 * h
    ready = (10 + F.col("user_id") % 40) * h
    problem_at = F.when(F.col("event_id") % 3 == 0, (5 + F.col("event_id") % 30) * h)
    variety, fixed = F.when(F.col("event_id") % 11 > 0, F.col("event_type")), F.col("event_id") % 2 == 0
    active = game.problem_active(variety, problem_at, fixed, now)
    return e.select(
        "event_id",
        game.plot_stage(variety, planted, ready, F.coalesce(active, F.lit(False)), now).alias("stage"),
        game.harvest_yield(F.col("user_id") % 9 + 1, ready, problem_at, fixed, now).cast("long").alias("yield"),
        game.skip_cost(ready, now).cast("long").alias("skip"),
        game.upgrade_factor(F.col("user_id") % 8).alias("factor"),
    )


def seeded_draws(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(game.draw(F.col("event_id") * 7919, F.lit(1)), 9).alias("first"), F.round(game.draw(F.col("event_id") * 7919, F.lit(3)), 9).alias("third"))


def frame_notes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    group = F.element_at(F.array(*[F.lit(x) for x in ("easy", "blur", "catalog", "night")]), (k % 4 + 1).cast("int"))
    notes = game.frame_notes(group, k % 800, k % 311, k % 23 / 100.0, F.when(k % 6 > 0, k % 97 / 100.0))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(notes, ",").alias("notes"))


def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a true and another candidate of one order, as feature differences."""
    rows = base.candidates(spark, sf).withColumn("label", (F.col("inliers") % 4 == 0).cast("int"))
    out = learning.preference_pairs(rows, ["vis_score", "txt_score"])
    return out.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"), (F.round(F.sum("vis_score"), 6) + F.lit(0.0)).alias("vis"), (F.round(F.sum("txt_score"), 6) + F.lit(0.0)).alias("txt"))


def unknown_copies(spark: SparkSession, sf: str) -> DataFrame:
    rows = base.candidates(spark, sf).select("query_id", "item_id", F.when(F.col("inliers") % 3 > 0, F.col("item_id")).otherwise(F.lit(-1)).alias("true_id"))
    return learning.with_unknowns(rows).groupBy("query_id").agg(F.count("*").alias("n"))


def head_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The first three candidates of each order by the words that confirm them, then by their geometry."""
    rows = base._scored(spark, sf).select("query_id", "pos", "position", "disc_hit", "inliers")
    return fusion.head_rerank(rows, head=3, keys=["disc_hit", "inliers"]).select("query_id", "pos", "position")


def two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors by their first half, the best of them rescored by the second; excluded ids go before ranking."""
    v = table(spark, sf, "embeddings")
    items = search.without(v, v.where("vec_id % 7 = 3").select("vec_id"), "vec_id")
    half = lambda df: df.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    pool = search.vector_topk_blocked(half(retrieval._queries(v, "vec_id")), half(items), 40, query_id="vec_id", item_id="vec_id", exclude_self=True)
    rest = lambda c: v.select(F.col("vec_id").alias(c), F.slice("embedding", 33, 32).alias(f"_{c}"))
    rows = pool.withColumn("score", F.round("score", 9)).join(rest("query_id"), "query_id").join(rest("item_id"), "item_id")
    out = search.two_stage(rows, F.round(linalg.dot(F.col("_query_id"), F.col("_item_id")), 9), 5, pool_size=30)
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def same_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one name are one class; line items' parts against the next ones."""
    p = table(spark, sf, "part")
    classes = p.select(F.col("p_partkey").alias("slug"), F.concat("p_name", F.lit("/"), "p_brand").alias("class"))
    pairs = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size") % 3).alias("b"))
    return groups.same_class(pairs, classes, "a", "b").select("a", "b", "same")


def saved_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened vectors by a model that was saved and loaded again are those of the model itself."""
    v = table(spark, sf, "embeddings")
    model = learning.fit_whitening(v, dim=8)
    path = f"{writers.shared_folder(spark)}/tessera-whitening-{uuid.uuid4().hex}"
    learning.save_whitening(spark, model, path)
    a, b = (learning.whiten(F.col("embedding"), m) for m in (model, learning.load_whitening(spark, path)))
    return v.select("vec_id", (F.round(linalg.dot(a, b), 6) == 1.0).alias("same"), linalg.is_unit(b).alias("is_unit"))


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    """Similarities of a part's name, as a read text, to the card of the part after the next."""
    p = table(spark, sf, "part")
    read = p.select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") + 2).alias("p_partkey"), F.col("p_name").alias("read"))
    rows = read.join(p, "p_partkey")
    features = similarity.text_pair_features(F.col("read"), F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"))
    return rows.select("query_id", *[F.round(c, 6).alias(n) for n, c in features.items()])


def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = learning.bootstrap_interval(base._outcomes(spark, sf).withColumn("cluster", F.col("query_id") % 97), 200, cluster="cluster", value=F.col("correct").cast("int"))
    return _rounded(out, "mean", "low", "high")


def bagged_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = base._outcomes(spark, sf).withColumn("cluster", F.col("query_id") % 97)
    out = learning.bagged_threshold(rows, metrics.grid(spark, 20, 0.05), 50, unknown_share=0.2, false_cost=0.5)
    return _rounded(out, "threshold", "coverage", "right", "false_accept")


def out_of_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of three folds of orders, each scored by a model of the other two, and by a pairwise ranker."""
    rows = base.candidates(spark, sf).withColumn("label", (F.col("inliers") % 4 == 0).cast("int"))
    features = ["vis_score", "txt_score", "disc_hit"]
    weights = learning.fit_ranker(learning.preference_pairs(rows, features), features)
    out = learning.out_of_fold(rows, features, F.col("query_id"), 3, kind="lr")
    return out.select("query_id", "pos", "fold", F.round("probability", 6).alias("probability"), F.round(learning.ranker_score(weights), 6).alias("rank_score"))


def balanced_split(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("group")).agg(F.count("*").alias("n"))
    return learning.balanced_split(per, 3)


QUERIES = {f.__name__: f for f in (counters_by_reason, per_item_report, intruders_at_50, mode_medians, vintage_tally, inference_summary, judge_variants, feature_ablation, reader_comparison, detector_evaluation, partial_boxes, crop_flags, label_rule_grid, out_of_fold_join, files_not_in_test, result_projection, answer_payload, judge_triggers, judge_options, judge_verdicts, consistent_picks, review_lists, rejected_entries, guard_effects, canonical_leaders, budget_threshold, family_wins, puzzle_cells, plot_rules, seeded_draws, frame_notes, preference_pairs, unknown_copies, head_rerank, two_stage, same_classes, saved_whitening, text_features, bootstrap_intervals, bagged_threshold, out_of_fold_scores, balanced_split)}

_IOU = "{both} / ({a} + {b} - {both})"
_SHARED = "(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)))"
_RULES = "g as (select r::int max_txt_rank, d::double min_disc_hit, c::double min_name_cover from (values (0), (1)) a(r), (values (0.34), (0.5), (0.67), (0.8), (1.0)) b(d), (values (0.5), (0.6), (0.7), (0.8), (0.9), (1.01)) e(c))"
_OPTIONS = "op as materialized (select query_id, list(item_id order by position)[1:4] options from (select b.query_id, b.position, b.item_id from p a join p b on a.query_id = b.query_id and a.position = 0 and a.family <> '' where b.position < 8 and (b.position = 0 or b.family = a.family)) group by 1 having count(*) > 1)"
_FIVE = "n as materialized (select query_id, list(item_id order by position) filter (position < 5) cand, max(case when position = 0 then probability end) pr, max(case when position = 0 then item_id end) it, max(case when position = 0 then family end) fam from p group by 1)"


def _draw(turn: int) -> str:
    """SQL of the generator in subqueries, with 128-bit products."""
    a = f"select event_id, ((event_id * 7919 + {turn}::bigint * 1831565813) % 4294967296)::hugeint a from events"
    t = f"select event_id, (xor(a::bigint, (a::bigint >> 15))::hugeint * (a::bigint | 1)::hugeint % 4294967296)::bigint t from ({a})"
    u = f"select event_id, xor(((t + (xor(t, t >> 7)::hugeint * (t | 61)::hugeint % 4294967296)) % 4294967296)::bigint, t) u from ({t})"
    return f"select event_id, round(xor(u, u >> 14)::double / 4294967296.0::double, 9) v from ({u})"


SQL = {
    "counters_by_reason": f"with {_B} select grp as \"group\", case when verdict = 'other' then 'none' else verdict end reason, count(*) n from b group by 1, 2",
    "per_item_report": f"with {_B}, a as (select wine_id, arg_min(known, seq) known, count(*) n, arg_min(source, seq) source, count(*) filter (answered) answered, median(vis_rank) v, median(txt_rank) t, count(*) filter (in_window) w, count(*) filter (rerank_top1) r, count(*) filter (final_top1) f, count(*) filter (verdict = 'correct') c, count(*) filter (verdict = 'twin') tw, arg_min(grp, seq) g from b group by 1), m as (select wine_id, best_id from (select wine_id, best_id, row_number() over (partition by wine_id order by count(*) desc, min(seq)) k from b where not known group by 1, 2) where k = 1) select a.wine_id, known, n, source, answered, case when known then v end::double vis_rank_median, case when known then t end::double txt_rank_median, case when known then w end window_hit, case when known then r end rerank_top1, case when known then f end final_top1, case when known then c end correct, case when known then tw end twin, case when not known then g end as \"group\", best_id best from a left join m on a.wine_id = m.wine_id",
    "intruders_at_50": f"with {retrieval._Q}, q as (select query_id, min(case when item_id = query_id + 1 and il <> 0 then rank end) k, count(*) filter (il = 0) s, max((rank = 0 and il = 0)::int) led from r where rank < 50 group by 1) select count(*) n, round(avg(coalesce(k < 1, false)::int), 6) top1, round(avg(coalesce(k < 5, false)::int), 6) top5, round(avg(coalesce(k < 50, false)::int), 6) recall, round(avg(s), 6) intruders, sum(led)::bigint led_by_intruder from q",
    "mode_medians": "select event_type, median(value) as value, median(user_id)::double user_id from events group by 1",
    "vintage_tally": "with f as (select * from (select *, row_number() over (partition by l_orderkey order by (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey) k from lineitem) where k = 1), c as (select case when l_partkey % 4 = 0 then 0 else 2000 + l_partkey % 25 + l_linenumber % 2 end rd, case when p_partkey is not null then 2000 + p_partkey % 25 end yr from f left join part on p_partkey = l_partkey) select count(*) filter (rd <> 0 and rd = yr) as \"right\", count(*) filter (rd = 0) silent, count(*) filter (rd <> 0 and (yr is null or rd <> yr)) wrong from c",
    "inference_summary": "select count(*) n_images, count(*) filter (l_discount >= 0.03) answered, count(*) filter (l_discount < 0.03) refused, count(*) filter (l_returnflag = 'R') twin_warnings, count(*) filter (l_quantity < 5 or l_linestatus = '') text_empty, round(median(l_discount), 6) median_margin, round((select list_sort(list(l_discount))[least((count(*) * 0.1)::double // 1, count(*) - 1)::int + 1] from lineitem), 6) p10_margin, round((select list_sort(list(l_extendedprice))[least((count(*) * 0.5)::double // 1, count(*) - 1)::int + 1] from lineitem), 6) p50_ms, round((select list_sort(list(l_extendedprice))[least((count(*) * 0.95)::double // 1, count(*) - 1)::int + 1] from lineitem), 6) p95_ms from lineitem",
    "judge_variants": "select l_returnflag as variant, count(*) frames, count(*) filter (l_quantity > 10) calls, count(*) filter (l_tax > 0.02) top1_before, count(*) filter (l_discount > 0.02) top1_after, count(*) filter (l_discount > 0.02 and l_tax <= 0.02) fixed, count(*) filter (l_tax > 0.02 and l_discount <= 0.02) broken, count(*) filter (l_quantity > 10 and l_partkey % 5 = 0) unverified, count(*) filter (l_quantity > 10 and l_partkey % 5 <> 0 and l_partkey % 3 = 0) consistent, round(median(l_quantity / 10) filter (l_quantity > 10), 6) p50 from lineitem group by 1",
    "feature_ablation": "with r as (select l_returnflag v, l_linenumber % 3 s, l_orderkey q, round(l_discount, 2) sc, l_suppkey % 3 = 0 pos from lineitem), b as (select v, s, q, max(sc) filter (pos) bp, max(sc) mx, list(sc) l from r group by 1, 2, 3), c as (select v, s, coalesce(bp = mx, false)::int t, case when bp is null then 0 else 1.0::double / (1 + len(list_filter(l, lambda x: x > bp))) end rr from b), d as (select v, s, avg(t) t, avg(rr) m from c group by 1, 2) select v as variant, round(avg(t), 6) top1_mean, round(stddev_pop(t), 6) top1_std, round(avg(m), 6) mrr_mean, round(stddev_pop(m), 6) mrr_std from d group by 1",
    "reader_comparison": "select event_type, round(avg((event_id % 70 < 1)::int), 6) text_r1, round(avg((event_id % 70 < 5)::int), 6) text_r5, round(avg((event_id % 70 < 50)::int), 6) text_r50, count(*) filter (event_id % 3 <> 0) family_frames, round(coalesce(avg((event_id % 2 = 0)::int) filter (event_id % 3 <> 0), 0), 6) family_win, round(avg(user_id), 6) words_mean, round(1000 * median(value), 6) p50_ms, round(1000 * list_sort(list(value))[least(count(*) - 1, round_even(0.95::double * (count(*) - 1), 0))::int + 1], 6) p95_ms from events group by 1",
    "detector_evaluation": f"with {_BOXES}, t as (select c_custkey image, 0.2::double x0, 0.2::double y0, 0.6::double x1, 0.5::double + (c_custkey % 5 / 10.0)::double y1 from customer), m as (select b.image, a.image is not null found, case when a.image is null then 0 else {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_SHARED}) end v from t b left join best a on a.image = b.image) select count(*) n, round(avg(found::int), 6) detection_rate, round(avg(v), 6) mean_iou, round(avg((v >= 0.75)::int), 6) iou_75 from m",
    "partial_boxes": f"with {_BOXES}, w as (select a.image, b.x0, b.y0, b.x1, b.y1, row_number() over (partition by a.image order by b.score desc, b.x0 desc, b.y0 desc, b.x1 desc, b.y1 desc) r from best a join o b on a.image = b.image and (a.x0 <> b.x0 or a.y0 <> b.y0 or a.x1 <> b.x1 or a.y1 <> b.y1) where {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.9 and greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / (greatest(a.x1, b.x1) - least(a.x0, b.x0)) >= 0.8 and b.y1 - b.y0 >= 1.2::double * (a.y1 - a.y0)) select a.image, round(coalesce(w.x0, a.x0), 9) x0, round(coalesce(w.y0, a.y0), 9) y0, round(coalesce(w.x1, a.x1), 9) x1, round(coalesce(w.y1, a.y1), 9) y1, w.x0 is not null expanded from best a left join w on w.image = a.image and w.r = 1",
    "crop_flags": "with k as (select o_orderkey k, o_orderkey % 4 > 0 hf, o_orderkey % 9 > 0 hb, o_orderkey % 13 > 0 hl, 100 + o_orderkey % 11 * 20 b0, 1400 - o_orderkey % 7 * 40 b1, 200 + o_orderkey % 31 * 20 l0, 400 + o_orderkey % 31 * 20 + o_orderkey % 29 * 20 l1, 60 + o_orderkey % 17 * 20 lw, o_orderkey % 19 * 20 ow from orders), g as (select *, case when hb then b0 when hf then 100 else 0 end o0, case when hb then b1 when hf then 1400 else 1500 end o1, case when hf then 100 else 0 end f0, case when hf then 1400 else 1500 end f1, greatest(0, least(300 + lw, 500 + ow) - 500) * greatest(0, least(l1, 1300) - greatest(l0, 900)) sh from k), m as (select *, 0.02::double * (o1 - o0) mg from g), f as (select *, list_filter([case when not hb then 'no_bottle' end, case when hb and hf and (least(b1, 1400) - greatest(b0, 100))::double / 1300 < 0.85 then 'bottle_truncated' end, case when not hl then 'no_label' end, case when hl and hb and ((l1 >= b1 - mg and b1 < f1 - mg) or (l0 <= b0 + mg and b0 > f0 + mg)) then 'label_clipped' end, case when hl and ((l0 + l1) / 2.0 - o0)::double / (o1 - o0) < 0.45 then 'label_on_neck' end, case when hl and k % 12 / 10.0 < 0.6 then 'low_score' end, case when hl and least(lw, l1 - l0) < 120 then 'small_label' end, case when hl and k % 10 / 10.0 >= 0.3 and coalesce(sh::double / nullif(ow * 400 + lw * (l1 - l0) - sh, 0), 0) < 0.3 and ow * 400 >= lw * (l1 - l0) then 'ambiguous' end], lambda x: x is not null) fl from m) select k o_orderkey, array_to_string(fl, ',') flags, case when k % 50 = 0 then 'accepted' when k % 51 = 0 then 'manual' when len(fl) = 0 then 'ok' when k % 3 <> 0 then 'review' when k % 10 / 10.0 > 0.8 then 'ok' else 'repaired' end as status from f",
    "label_rule_grid": f"with {base._P}, {_RULES}, m as (select *, probability < 0.6 and least(color_match, style_match, grape_match) <> -1 and txt_rank <= max_txt_rank and winery_hit = 1 and (disc_hit >= min_disc_hit or name_cover >= min_name_cover) fire, query_id % 5 <> 0 kn, inliers % 3 > 0 co from p cross join g where position = 0), cells as (select max_txt_rank, min_disc_hit, min_name_cover, count(*) filter (fire and kn and co) gain, count(*) filter (fire and kn and not co) wrong, count(*) filter (fire and not kn) as \"false\", count(*) filter (fire and not kn) <= 0.02 * count(*) filter (not kn) \"within\" from m group by 1, 2, 3) select *, row_number() over (order by \"within\" desc, gain - wrong desc, \"false\", max_txt_rank, min_disc_hit, min_name_cover) = 1 best from cells",
    "out_of_fold_join": f"with {base._C}, t as (select *, case when inliers % 3 > 0 then item_id else -1 end true_id from c), q as (select query_id, item_id, max(round(vis_score * 0.5::double, 6)) pr from t where pos % 2 = 0 group by 1, 2), f as (select query_id, max(family) fam from t where item_id = true_id group by 1) select t.query_id, pos::int pos, pr probability, fam true_family from t join q on t.query_id = q.query_id and t.item_id = q.item_id left join f on f.query_id = t.query_id",
    "files_not_in_test": "select doc_id, sha256(coalesce(text, '')) sha256 from documents where sha256(coalesce(text, '')) not in (select sha256(coalesce(text, '')) from documents where doc_id % 20 = 0)",
    "result_projection": f"with {base._P}, {_FIVE}, j as (select a.query_id, b.item_id, row_number() over (partition by a.query_id order by b.position) r from p a join p b on a.query_id = b.query_id and a.family = b.family and a.position = 0 and b.position > 0 where a.family <> '' and b.probability >= 0.5 * a.probability and abs(a.disc_hit - b.disc_hit) <= 0.5 and b.color_match <> -1 and b.style_match <> -1 and b.grape_match <> -1 and a.color_match = b.color_match and a.style_match = b.style_match and a.grape_match = b.grape_match), w as (select query_id, string_agg(item_id::varchar, ',' order by r) tw from j where r <= 2 group by 1) select n.query_id, pr >= 0.6 answered, round(pr, 6) probability, case when pr >= 0.6 then it end item_id, case when pr >= 0.6 then fam end card, case when pr >= 0.6 then (2000 + it % 25)::int end as year, array_to_string(cand, ',') candidates, case when pr >= 0.6 then coalesce(tw, '') else '' end twins from n left join w on w.query_id = n.query_id",
    "answer_payload": f"with {base._P}, {_FIVE} select query_id, case when pr >= 0.6 then it end slug, pr >= 0.6 found, case when pr >= 0.6 then round(pr, 6) end probability, case when pr < 0.6 then array_to_string(cand, ',') end as \"similar\" from n",
    "judge_triggers": f"with {base._P}, x as (select query_id, max(case when position = 0 then probability end) p0, max(case when position = 1 then probability end) p1, max(case when position = 0 then family end) f0, max(case when position = 1 then family end) f1, max(case when position = 0 then inliers end) i0 from p group by 1) select * from (select query_id, case when p0 < 0.6 then case when i0 >= 30 then 'refused_strong' end when p1 is null then null when f0 <> '' and f0 = f1 then 'same_family' when p0 - p1 < 0.2 then 'margin' end reason from x) where reason is not null",
    "judge_options": f"with {base._P}, {_OPTIONS} select query_id, array_to_string(options, ',') as options from op",
    "judge_verdicts": f"with {base._P}, {_OPTIONS}, v as (select query_id, query_id % 7 = 0 e, case when query_id % 5 > 0 then query_id % 4 end ch, query_id % 10 / 10.0 co, case when query_id % 5 > 0 and query_id % 4 between 1 and len(options) then options[query_id % 4] end pk from op), m as (select p.query_id, position, item_id, probability, e, ch, co, pk, coalesce(not e and pk is not null, false) picked, coalesce(not e and ch is null and co >= 0.7, false) refused from p left join v on v.query_id = p.query_id) select query_id, (row_number() over (partition by query_id order by (picked and item_id = pk)::int desc, position) - 1)::int as position, item_id, round(case when picked and item_id = pk then greatest(probability, co) when refused and position = 0 then least(probability, 0.599) else probability end::double, 6) probability, case when picked then 'choose' when refused then 'refuse' else 'none' end applied from m",
    "consistent_picks": f"with {base._C}, x as (select a.query_id, b.pos, row_number() over (partition by a.query_id order by b.color_match desc, b.grape_match desc, b.style_match desc, round_even(b.disc_hit, 2) desc, round_even(b.name_cover, 2) desc, b.pos) r from c a join c b on a.query_id = b.query_id and a.pos = 0 and b.pos > 0 where (least(a.color_match, a.style_match, a.grape_match) = -1 or (a.disc_n > 0 and a.disc_hit = 0 and a.grape_match <> 1)) and least(b.color_match, b.style_match, b.grape_match) <> -1 and (b.grape_match = 1 or b.disc_hit > 0 or (least(a.color_match, a.style_match, a.grape_match) = -1 and (b.color_match = 1 or b.style_match = 1)))) select query_id, pos::int pick from x where r = 1",
    "review_lists": "select * from (select event_type, event_id, (row_number() over (partition by event_type order by (user_id = 7)::int desc, ts desc, event_id))::int place from events) where place <= 200",
    "rejected_entries": "with e as (select *, count(*) over (partition by user_id, ts::date) n from events) select event_id, reasons from (select event_id, array_to_string(list_filter([case when not coalesce(value <= 50, false) then 'value' end, case when not coalesce(event_type in ('click', 'view', 'purchase'), false) then 'kind' end, case when not coalesce(length(props) < 100, false) then 'props' end, case when n > 1 then 'slot repeats' end], lambda x: x is not null), ',') reasons from e) where reasons <> ''",
    "guard_effects": f"with {base._P}, g as (select *, case when ocr_lines >= 3 then case when color_match = -1 or style_match = -1 or grape_match = -1 then 'contra' end end gd from p) select query_id, pos::int pos, round(case when gd = 'contra' then least(probability, 0.599) else probability end::double, 9) guarded, round(case when least(color_match, style_match, grape_match) = -1 then probability * 0.5 else probability end::double, 9) vetoed, round(1.0::double / (1 + rrf_rank), 9) retrieval_only from g",
    "canonical_leaders": f"with {base._P}, r as (select query_id, item_id, row_number() over (partition by query_id order by min(position)) - 1 ps, round(max(probability), 6) pr from p group by 1, 2), l as (select query_id, item_id was, pr lp, item_id - item_id % 2 ld from r where ps = 0), m as (select r.query_id, item_id, ps, pr, was, lp, ld, bool_or(item_id = ld) over (partition by r.query_id) there from r join l on l.query_id = r.query_id), k as (select query_id, case when not there and item_id = was then ld else item_id end item_id, ld, case when item_id = ld or (item_id = was and not there) then greatest(pr, lp) else pr end pr, ps from m where item_id <> was or not there or was = ld) select query_id, item_id, (row_number() over (partition by query_id order by (item_id = ld)::int desc, ps) - 1)::int as position, pr probability from k",
    "budget_threshold": f"with {base._O}, g as (select i * 0.05::double t from range(20) r(i)), u as (select t, count(*) filter (raw >= t and known and correct)::double / count(*) filter (known) ri, count(*) filter (raw >= t and known and not correct)::double / count(*) filter (known) wr, count(*) filter (raw >= t and not known)::double / count(*) filter (not known) fa from o cross join g group by t) select round((select min(t) from u where fa + wr <= 0.5), 2) threshold, round(0.8::double * ri / (0.8::double * ri + 0.8::double * wr + 0.2::double * fa), 6) as precision from u where t > 0.57 and t < 0.62",
    "family_wins": f"with {base._C}, f as (select query_id, coalesce(max(vis_score) filter (inliers % 5 = 0), -1) a, coalesce(max(vis_score) filter (inliers % 5 = 1), -1) b from c group by 1) select round(avg((a > b)::int), 6) family_win from f",
    "puzzle_cells": "select p_partkey, array_to_string([case when p_size % 3 = 1 then 'ok' else 'no' end, case when p_size % 4 = 2 then 'ok' else 'no' end, case when p_type = 'PROMO' then 'ok' else 'no' end, case when p_brand = 'Brand#3' then 'ok' when p_size % 4 = 2 then 'near' else 'no' end], ',') cells, array_to_string(list_transform([p_brand, p_type, p_name], lambda x, i: case when case when p_size % 7 = 0 then 3 else p_size % 4 end >= i then x else '-' end), '|') hints from part",
    "plot_rules": "with k as (select event_id, event_id % 120 * 3600000 nw, (10 + user_id % 40) * 3600000 rd, case when event_id % 3 = 0 then (5 + event_id % 30) * 3600000 end pa, event_id % 11 > 0 v, event_id % 2 = 0 fx, user_id u from events) select event_id, case when not v then 'empty' when pa is not null and not fx and nw >= pa and nw < pa + 10800000 then 'problem' when nw >= rd + 172800000 then 'overripe' when nw >= rd then 'ripe' when nw * 3 < rd then 'sapling' when nw * 3 < 2 * rd then 'leaves' else 'green' end stage, greatest(1, floor((u % 9 + 1) * case when nw >= rd + 172800000 then 0.5::double else 1 end * case when pa is not null and not fx and nw >= pa + 10800000 then 0.8::double else 1 end + 0.5))::bigint as yield, greatest(1, ceil(greatest(0, rd - nw)::double / 1000 / 1500))::bigint as skip, greatest(0.5::double, 1 - 0.1::double * (u % 8)) factor from k",
    "seeded_draws": f"select a.event_id, a.v as first, b.v as third from ({_draw(1)}) a join ({_draw(3)}) b on a.event_id = b.event_id",
    "frame_notes": "with k as (select o_orderkey, ['easy', 'blur', 'catalog', 'night'][(o_orderkey % 4 + 1)::int] g, o_orderkey % 800 s, o_orderkey % 311 sh, o_orderkey % 23 / 100.0 fi, case when o_orderkey % 6 > 0 then o_orderkey % 97 / 100.0 end co from orders) select o_orderkey, array_to_string(list_filter([case when s < case when g in ('easy', 'catalog') then 600 else 250 end then 'small' end, case when g = 'blur' and sh < 5 then 'blurred' end, case when g <> 'blur' and sh < case when g in ('easy', 'catalog') then 250 else 40 end then 'smeared' end, case when g in ('easy', 'catalog') and fi < 0.1 then 'far' end, case when co is not null and sh > 200 and co < 0.65 then 'wrong_bottle' end], lambda x: x is not null), ',') notes from k",
    "preference_pairs": f"with {base._C} select a.query_id, count(*) n, round(sum(case when a.family = b.family or least(b.vis_rank, b.txt_rank) < 5 then 3.0::double else 1 end), 6) weight, round(sum(a.vis_score - b.vis_score), 6) + 0.0::double vis, round(sum(a.txt_score - b.txt_score), 6) + 0.0::double txt from c a join c b on a.query_id = b.query_id and a.inliers % 4 = 0 and b.inliers % 4 <> 0 group by 1",
    "unknown_copies": f"with {base._C} select query_id::varchar query_id, count(*) n from c group by 1 union all select 'unknown:' || query_id, count(*) from c where inliers % 3 = 0 group by 1",
    "head_rerank": f"with {base._P} select query_id, pos::int pos, (row_number() over (partition by query_id order by position >= 3, case when position < 3 then disc_hit end desc nulls last, case when position < 3 then inliers end desc nulls last, position) - 1)::int as position from p",
    "two_stage": "with v as materialized (select vec_id, embedding::double[] e from embeddings), s as (select a.vec_id q, b.vec_id i, list_dot_product(a.e[1:32], b.e[1:32]) raw, list_dot_product(a.e[33:64], b.e[33:64]) re from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 and b.vec_id % 7 <> 3), t as (select *, round(raw, 9) sc, row_number() over (partition by q order by raw desc, i) r from s), m as (select *, max(sc) over (partition by q) mx from t where r <= 30), f as (select q, i, 0.5::double * case when mx > 0 then sc / mx else sc end + 0.5::double * round(re, 9) score from m) select q query_id, i item_id, round(score, 6) score, (r - 1)::int as rank from (select *, row_number() over (partition by q order by score desc, i) r from f) where r <= 5",
    "same_classes": "select a.p_partkey a, a.p_partkey + a.p_size % 3 b, a.p_size % 3 = 0 or coalesce(a.p_name = b.p_name and a.p_brand = b.p_brand, false) same from part a left join part b on b.p_partkey = a.p_partkey + a.p_size % 3",
    "saved_whitening": "select vec_id, true same, true is_unit from embeddings",
    "balanced_split": "with g as (select l_suppkey::varchar grp, count(*) n from lineitem group by 1), o as (select grp, row_number() over (order by n desc, grp) - 1 k from g) select grp as \"group\", (case when k // 3 % 2 = 0 then k % 3 else 2 - k % 3 end)::int part from o",
}
