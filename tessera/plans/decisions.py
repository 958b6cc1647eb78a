"""Candidate features, decisions and metrics over candidates made of line items, and the whole retrieval query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import decisions, fusion, metrics, search, windows
from tessera.plans._tables import table


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as candidates of their order: every feature is a function of their columns, families are suppliers' last
    digits."""
    li = table(spark, sf, "lineitem")
    key = F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")
    pick = lambda m, s=0: (key + s) % m
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return li.select(
        F.col("l_orderkey").alias("query_id"),
        pos.alias("pos"),
        F.col("l_partkey").alias("item_id"),
        (pick(97) / 97.0).alias("vis_score"),
        F.when(pick(5) == 0, 999).otherwise(pick(50)).cast("int").alias("vis_rank"),
        (pick(89, 5) / 89.0).alias("txt_score"),
        F.when(pick(4) == 0, 999).otherwise(pick(40, 3)).cast("int").alias("txt_rank"),
        pick(60, 1).cast("int").alias("rrf_rank"),
        pick(300).cast("int").alias("inliers"),
        (pick(10) / 10.0).alias("inlier_ratio"),
        (pick(3) > 0).cast("int").alias("homography_ok"),
        (pick(8) / 8.0).alias("geometry_query_coverage"),
        (pick(6) / 6.0).alias("geometry_candidate_coverage"),
        (pick(4) / 4.0).alias("geometry_normalized_error"),
        pick(6, 2).cast("int").alias("ocr_lines"),
        pick(4, 1).cast("int").alias("disc_n"),
        (pick(3, 1) / 2.0).alias("disc_hit"),
        (pick(5, 2) / 4.0).alias("name_cover"),
        pick(2).cast("int").alias("winery_hit"),
        (pick(3, 1) - 1).cast("int").alias("color_match"),
        (pick(3, 2) - 1).cast("int").alias("style_match"),
        (pick(7) % 3 - 1).cast("int").alias("grape_match"),
        F.when(F.col("l_suppkey") % 10 == 0, "").otherwise((F.col("l_suppkey") % 10 % 3).cast("string")).alias("family"),
    )


_BASE = "(l_partkey * 7 + l_suppkey * 3 + l_linenumber)"


def _pick(m: int, s: int = 0) -> str:
    return f"(({_BASE} + {s}) % {m})"


_C = f"""c as materialized (select l_orderkey query_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 pos, l_partkey item_id,
  {_pick(97)} / 97.0::double vis_score, case when {_pick(5)} = 0 then 999 else {_pick(50)} end vis_rank, {_pick(89, 5)} / 89.0::double txt_score, case when {_pick(4)} = 0 then 999 else {_pick(40, 3)} end txt_rank,
  {_pick(60, 1)} rrf_rank, {_pick(300)} inliers, {_pick(10)} / 10.0::double inlier_ratio, ({_pick(3)} > 0)::int homography_ok, {_pick(8)} / 8.0::double gq, {_pick(6)} / 6.0::double gc, {_pick(4)} / 4.0::double ge,
  {_pick(6, 2)} ocr_lines, {_pick(4, 1)} disc_n, {_pick(3, 1)} / 2.0::double disc_hit, {_pick(5, 2)} / 4.0::double name_cover, {_pick(2)} winery_hit, {_pick(3, 1)} - 1 color_match, {_pick(3, 2)} - 1 style_match, {_pick(7)} % 3 - 1 grape_match,
  case when l_suppkey % 10 = 0 then '' else (l_suppkey % 10 % 3)::varchar end as family from lineitem)"""


def candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.derive(candidates(spark, sf))
    names = ["vis_zscore", "vis_top12_gap", "vis_gap", "vis_margin", "txt_margin", "inliers_share", "geometry_support", "geometry_margin", "family_vis_margin", "family_name_cover_margin", "disc_contra", "txt_top1_score", "txt_top5_score"]
    whole = ["vis_rank", "txt_rank", "rrf_rank", "rrf_margin", "inliers_gap", "inliers_margin", "family_size", "family_attr_margin", "family_color_margin", "txt_in_top5"]
    return out.select("query_id", "pos", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in names], *[F.col(c).cast("long").alias(c) for c in whole])


def theta_rivals(spark: SparkSession, sf: str) -> DataFrame:
    out = windows.rival_margins(candidates(spark, sf))
    return out.select("query_id", "pos", F.round("vis_gap", 6).alias("vis_gap"), F.round("vis_margin", 6).alias("vis_margin"), F.col("inliers_gap").cast("long").alias("inliers_gap"), F.col("inliers_margin").cast("long").alias("inliers_margin"))


def guards(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.derive(candidates(spark, sf))
    return rows.select("query_id", "pos", *[decisions.twin_guard(m).alias(m) for m in ("strict", "twin", "contra")])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with a probability and their position by it."""
    p = F.round(0.5 * F.col("vis_score") + 0.3 * F.col("txt_score") + 0.2 * F.col("disc_hit"), 6)
    order = Window.partitionBy("query_id").orderBy(F.col("probability").desc(), "pos")
    return candidates(spark, sf).withColumn("probability", p).withColumn("position", F.row_number().over(order) - 1)


_P = f"{_C}, p as materialized (select *, row_number() over (partition by query_id order by probability desc, pos) - 1 as position from (select *, round(0.5::double * vis_score + 0.3::double * txt_score + 0.2::double * disc_hit, 6) probability from c))"


def sibling_swaps(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.sibling_swap(_scored(spark, sf))


def label_twin_cards(spark: SparkSession, sf: str) -> DataFrame:
    out = decisions.label_twins(_scored(spark, sf), epsilon=0.5)
    return out.select("query_id", F.array_join(F.col("twins").cast("array<string>"), ",").alias("twins"))


def confidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.confidence(_scored(spark, sf))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("top1", "top5_share", "margin")])


def rerank_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored(spark, sf).select("query_id", "item_id", "pos", "position", "disc_hit", "txt_rank")
    return fusion.rerank_window(rows, head=2, extra=2, least=0.5, text_top=10).select("query_id", "pos", "kind")


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Best candidate of each query against a truth made of the order: known if its key is not divisible by 5."""
    best = _scored(spark, sf).where("position = 0")
    known, answered = F.col("query_id") % 5 != 0, F.col("probability") >= 0.6
    truth = F.when(F.col("inliers") % 3 > 0, F.col("item_id")).otherwise(F.lit(-1))
    v = decisions.verdict(answered, known, F.col("item_id"), truth, F.col("family") == "1")
    return best.select("query_id", (F.col("query_id") % 4).cast("string").alias("group"), known.alias("known"), answered.alias("answered"), v.alias("verdict"), F.col("probability").alias("raw"), (F.col("inliers") % 3 > 0).alias("correct"))


_O = f"{_P}, o as materialized (select query_id, (query_id % 4)::varchar grp, query_id % 5 <> 0 known, probability >= 0.6 answered, probability raw, inliers % 3 > 0 correct, case when probability < 0.6 then 'refused' when query_id % 5 = 0 then 'accepted' when inliers % 3 > 0 then 'correct' when family = '1' then 'twin' else 'other' end verdict from p where position = 0)"


def verdict_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.outcomes(_outcomes(spark, sf), "group")
    return out.select(F.col("group"), "n_known", "correct", "twin", "other", "refused", *[F.round(c, 6).alias(c) for c in ("answered_precision", "overall_answered_precision", "coverage", "known_correct_coverage")])


def false_accept_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.false_accepts(_outcomes(spark, sf)).select("group", F.round("false_accept", 6).alias("false_accept"), "n")


def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.threshold_curves(_outcomes(spark, sf), metrics.grid(spark, 20, 0.05))
    return out.select(F.round("threshold", 2).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("coverage", "right", "wrong", "false_accept", "precision")])


def utility_pick(spark: SparkSession, sf: str) -> DataFrame:
    curves = metrics.threshold_curves(_outcomes(spark, sf), metrics.grid(spark, 20, 0.05))
    out = metrics.utility_threshold(curves, unknown_share=0.2, wrong_cost=1.0, false_cost=0.5)
    return out.select(F.round("threshold", 2).alias("threshold"), F.round("utility", 6).alias("utility"))


def auroc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auroc(_outcomes(spark, sf), score="raw").select(F.round("auroc", 6).alias("auroc"))


def tie_aware_mrr(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).select("query_id", F.col("vis_score").alias("score"), (F.col("inliers") % 5 == 0).alias("positive"))
    return metrics.tie_aware_mrr(rows).select(F.round("mrr", 6).alias("mrr"))


def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.operating_point(_outcomes(spark, sf).withColumnRenamed("raw", "top"), 0.8)
    return out.select(*[F.round(c, 6).alias(c) for c in ("cut", "false_accept", "correct")])


def micro_macro(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.macro(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", "returned")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def crop_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = candidates(spark, sf).select("family", F.col("vis_score").alias("iou"), F.greatest("vis_score", "txt_score").alias("retained"), (F.col("inliers") % 7 == 0).alias("clipped"))
    out = metrics.crop_audit(rows, "family")
    return out.select("family", "n", "lost", "clipped", *[F.round(c, 6).alias(c) for c in ("mean_iou", "iou_50", "iou_75", "whole")])


def retrieve_fuse_decide(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: two retrievals of vectors are fused, scored, decided and measured, by label."""
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id % 20 = 0")
    near = search.vector_topk_blocked(q, v, 50, query_id="vec_id", item_id="vec_id", exclude_self=True)
    half = lambda df: df.select("vec_id", F.slice("embedding", 1, 32).alias("embedding"))
    rough = search.vector_topk_blocked(half(q), half(v), 50, query_id="vec_id", item_id="vec_id", exclude_self=True)
    fused = fusion.fuse_rrf(near.select("query_id", "item_id", "rank").unionAll(rough.select("query_id", "item_id", "rank")))
    best = search.top_k(fused.withColumn("score", F.round("score", 9)), ["query_id"], "score", 10, "item_id")
    labels = v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("found"))
    asked = v.select(F.col("vec_id").alias("query_id"), "label")
    rows = best.join(labels, "item_id").join(asked, "query_id")
    per = rows.groupBy("query_id", "label").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("rank"))).alias("rank"), F.max("score").alias("top"))
    answered = per.withColumn("answered", F.col("top") >= 0.031).withColumn("right", F.col("rank").eqNullSafe(0))
    return answered.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0))), 6).alias("mrr"), F.count_if("answered").alias("answered"), F.count_if(F.col("answered") & F.col("right")).alias("right"))


QUERIES = {f.__name__: f for f in (retrieve_fuse_decide, candidate_features, theta_rivals, guards, sibling_swaps, label_twin_cards, confidence_summary, rerank_windows, verdict_metrics, false_accept_rollup, threshold_grid, utility_pick, auroc, tie_aware_mrr, operating_point, micro_macro, crop_audit)}


def _others(value: str, by: str, default: str, agg: str = "max") -> str:
    """Extreme over the other rows of a group, by comparing each row with each other."""
    same = " and ".join(f"z.{b} = x.{b}" for b in by.split())
    return f"coalesce((select {agg}({value}) from f z where {same} and z.pos <> x.pos), {default})"


_F = f"{_C}, f as materialized (select *, case when homography_ok = 1 then inliers * inlier_ratio * least(gq, gc) / (1 + ge) else 0 end geo, color_match + style_match + grape_match agree, case when vis_rank < 999 then row_number() over (partition by query_id, vis_rank < 999 order by vis_rank, pos) - 1 else 999 end vr, case when txt_rank < 999 then row_number() over (partition by query_id, txt_rank < 999 order by txt_rank, pos) - 1 else 999 end tr, row_number() over (partition by query_id order by rrf_rank, pos) - 1 rr, case when vis_rank < 999 then vis_score end vs from c), t as materialized (select query_id, coalesce(avg(vs), 0) vm, coalesce(stddev_pop(vs), 0) vd, max(vis_score) bv, max(inliers) bi, sum(inliers) ti, list_sort(list(vs) filter (vs is not null), 'DESC') l, max(case when tr = 0 then txt_score end) t1, max(case when tr = 4 then txt_score end) t5 from f group by 1)"
_FAM = lambda v: f"case when x.family <> '' then x.{v} - {_others('z.' + v, 'query_id family', 'x.' + v)} else 0 end"
_REFUTED = "(z.ocr_lines >= 3 and (least(z.color_match, z.style_match, z.grape_match) = -1 or (z.disc_n > 0 and z.disc_hit = 0 and x.disc_hit > 0)))"
SQL = {
    "candidate_features": f"with {_F} select x.query_id, x.pos::int pos, case when vis_rank < 999 and vd > 1e-8 then round((vis_score - vm) / vd, 9) else 0 end::double + 0.0::double vis_zscore, round(case when len(l) > 1 then l[1] - l[2] else 0 end, 9)::double + 0.0::double vis_top12_gap, round(bv - vis_score, 9) + 0.0::double vis_gap, round(vis_score - {_others('z.vis_score', 'query_id', '0')}, 9) + 0.0::double vis_margin, round(txt_score - {_others('z.txt_score', 'query_id', '-1')}, 9) + 0.0::double txt_margin, round(inliers::double / case when ti = 0 then 1 else ti end, 9) + 0.0::double inliers_share, round(geo, 9) + 0.0::double geometry_support, round(geo - {_others('z.geo', 'query_id', '0')}, 9) + 0.0::double geometry_margin, round({_FAM('vis_score')}, 9)::double + 0.0::double family_vis_margin, round({_FAM('name_cover')}, 9)::double + 0.0::double family_name_cover_margin, round(case when x.family <> '' then {_others('z.disc_hit', 'query_id family', '0')} else 0 end, 9)::double + 0.0::double disc_contra, round(coalesce(t1, -1), 9) + 0.0::double txt_top1_score, round(coalesce(t5, -1), 9) + 0.0::double txt_top5_score, vr::bigint vis_rank, tr::bigint txt_rank, rr::bigint rrf_rank, ({_others('z.rr', 'query_id', 'x.rr', 'min')} - rr)::bigint rrf_margin, (bi - inliers)::bigint inliers_gap, (inliers - {_others('z.inliers', 'query_id', '0')})::bigint inliers_margin, (case when x.family <> '' then (select count(*) from f z where z.query_id = x.query_id and z.family = x.family) else 0 end)::bigint family_size, ({_FAM('agree')})::bigint family_attr_margin, ({_FAM('color_match')})::bigint family_color_margin, (tr < 5)::bigint txt_in_top5 from f x join t on t.query_id = x.query_id",
    "theta_rivals": f"with {_C}, m as (select x.query_id, x.pos, any_value(x.vis_score) v, any_value(x.inliers) i, max(z.vis_score) bv, max(z.inliers) bi from c x left join c z on z.query_id = x.query_id and z.pos <> x.pos and not {_REFUTED} group by 1, 2) select query_id, pos::int pos, round(greatest(v, bv) - v, 6) vis_gap, round(v - coalesce(bv, 0), 6) vis_margin, (greatest(i, bi) - i)::bigint inliers_gap, (i - coalesce(bi, 0))::bigint inliers_margin from m",
    "guards": f"with {_F}, g as (select x.*, case when x.family <> '' then {_others('z.disc_hit', 'query_id family', '0')} else 0 end contra_ from f x), h as (select *, disc_n > 0 and disc_hit = 0 nw, color_match = -1 or style_match = -1 cs from g), k as (select *, case when ocr_lines >= 3 and (cs or (nw and (winery_hit = 1 or contra_ > 0 or (name_cover = 0 and winery_hit = 0)))) then 'twin' end tw from h) select query_id, pos::int pos, case when ocr_lines >= 3 and color_match = -1 and nw then 'twin' end strict, tw twin, case when ocr_lines >= 3 and (cs or grape_match = -1) then 'contra' else tw end contra from k",
    "sibling_swaps": f"with {_P}, j as (select a.query_id, b.item_id, row_number() over (partition by a.query_id order by b.color_match desc, b.style_match desc, round_even(b.disc_hit, 2) desc, least(b.txt_rank, 999), round_even(b.name_cover, 2) desc, b.position) r from p a join p b on a.query_id = b.query_id and a.family = b.family and a.position = 0 and b.position > 0 where a.family <> '' and a.ocr_lines >= 3 and b.color_match <> -1 and b.style_match <> -1 and ((a.color_match = -1 and (b.disc_hit > 0 or b.color_match = 1)) or (a.style_match = -1 and (b.disc_hit > 0 or b.style_match = 1)) or (a.disc_n > 0 and a.disc_hit = 0 and b.disc_hit > 0))) select query_id, item_id from j where r = 1",
    "label_twin_cards": f"with {_P}, j as (select a.query_id, b.item_id, row_number() over (partition by a.query_id order by b.position) r from p a join p b on a.query_id = b.query_id and a.family = b.family and a.position = 0 and b.position > 0 where a.family <> '' and b.probability >= 0.5 * a.probability and abs(a.disc_hit - b.disc_hit) <= 0.5 and b.color_match <> -1 and b.style_match <> -1 and b.grape_match <> -1 and a.color_match = b.color_match and a.style_match = b.style_match and a.grape_match = b.grape_match) select query_id, string_agg(item_id::varchar, ',' order by r) twins from j where r <= 2 group by 1",
    "confidence_summary": f"with {_P} select query_id, round(max(case when position = 0 then probability end), 6) top1, round(sum(case when position < 5 then probability end) / nullif(sum(probability), 0), 6) top5_share, round(max(case when position = 0 then probability end) - coalesce(max(case when position = 1 then probability end), 0), 6) margin from p group by 1",
    "rerank_windows": f"with {_P}, h as (select *, row_number() over (partition by query_id, position < 2 order by disc_hit desc, position) - 1 r from p) select query_id, pos::int pos, kind from (select query_id, pos, case when position < 2 then 0 when disc_hit >= 0.5 and r < 2 then 1 when txt_rank < 10 then 2 end::int kind from h) where kind is not null",
    "verdict_metrics": f"with {_O} select grp as \"group\", count(*) filter (known) n_known, count(*) filter (known and verdict = 'correct') correct, count(*) filter (known and verdict = 'twin') twin, count(*) filter (known and verdict = 'other') other, count(*) filter (known and verdict = 'refused') refused, round(count(*) filter (known and verdict = 'correct') / nullif(count(*) filter (known and answered), 0), 6) answered_precision, round(count(*) filter (known and verdict = 'correct') / nullif(count(*) filter (answered), 0), 6) overall_answered_precision, round(count(*) filter (known and answered) / nullif(count(*) filter (known), 0), 6) coverage, round(count(*) filter (known and verdict = 'correct') / nullif(count(*) filter (known), 0), 6) known_correct_coverage from o group by grp",
    "false_accept_rollup": f"with {_O} select coalesce(grp, 'all') as \"group\", round(avg(answered::int), 6) false_accept, count(*) n from o where not known group by grouping sets ((grp), ())",
    "threshold_grid": f"with {_O}, g as (select round(i * 0.05::double, 2) threshold, i * 0.05::double t from range(20) r(i)) select threshold, round(count(*) filter (raw >= t and known) / nullif(count(*) filter (known), 0), 6) coverage, round(count(*) filter (raw >= t and known and correct) / nullif(count(*) filter (known), 0), 6) as \"right\", round(count(*) filter (raw >= t and known and not correct) / nullif(count(*) filter (known), 0), 6) wrong, round(count(*) filter (raw >= t and not known) / nullif(count(*) filter (not known), 0), 6) false_accept, round(count(*) filter (raw >= t and known and correct) / nullif(count(*) filter (raw >= t), 0), 6) as precision from o cross join g group by threshold, t",
    "utility_pick": f"with {_O}, g as (select i * 0.05::double t from range(20) r(i)), u as (select t, 0.8::double * (count(*) filter (raw >= t and known and correct) / count(*) filter (known) - count(*) filter (raw >= t and known and not correct) / count(*) filter (known)) - 0.1::double * count(*) filter (raw >= t and not known) / count(*) filter (not known) u from o cross join g group by t), b as (select list_sort(list(t)) l, max(u) u from u where u >= (select max(u) from u) - 1e-9) select round(l[len(l) // 2 + 1], 2) threshold, round(u, 6) utility from b",
    "auroc": f"with {_O}, r as (select known, (rank() over (order by raw) + (count(*) over (partition by raw) - 1) / 2.0)::double k from o) select round((sum(k) filter (known) - count(*) filter (known) * (count(*) filter (known) + 1) / 2.0) / (count(*) filter (known) * count(*) filter (not known)::double), 6) auroc from r",
    "tie_aware_mrr": f"with {_C}, b as (select query_id, max(case when inliers % 5 = 0 then vis_score end) best from c group by 1), k as (select query_id, any_value(best) best, count(*) filter (vis_score > best) above from c join b using (query_id) group by 1) select round(avg(case when best is null then 0 else 1.0::double / (1 + above) end), 6) mrr from k",
    "operating_point": f"with {_O}, q as (select quantile_cont(raw, 0.2) cut from o where known) select round(cut, 6) cut, round(count(*) filter (raw >= cut and not known) / count(*) filter (not known), 6) false_accept, round(count(*) filter (raw >= cut and known and correct) / count(*) filter (known), 6) correct from o cross join q group by cut",
    "micro_macro": "with g as (select l_suppkey, avg((l_returnflag = 'R')::int) m, sum((l_returnflag = 'R')::int) s, count(*) n from lineitem group by 1) select round(sum(s) / sum(n), 6) returned_micro, round(avg(m), 6) returned_macro from g",
    "crop_audit": f"with {_C}, k as (select family, vis_score iou, greatest(vis_score, txt_score) kept, inliers % 7 = 0 clip from c) select family, count(*) n, count(*) filter (kept < 0.99) lost, count(*) filter (clip) clipped, round(avg(iou), 6) mean_iou, round(avg((iou >= 0.5)::int), 6) iou_50, round(avg((iou >= 0.75)::int), 6) iou_75, round(avg((kept >= 0.99)::int), 6) whole from k group by 1",
    "retrieve_fuse_decide": "with v as materialized (select vec_id, label, embedding::double[] e from embeddings), s as (select q.vec_id query_id, i.vec_id item_id, list_dot_product(q.e, i.e) a, list_dot_product(q.e[1:32], i.e[1:32]) b from v q join v i on q.vec_id <> i.vec_id where q.vec_id % 20 = 0), r as (select query_id, item_id, row_number() over (partition by query_id order by a desc, item_id) - 1 k from s union all select query_id, item_id, row_number() over (partition by query_id order by b desc, item_id) - 1 from s), f as (select query_id, item_id, round(sum(1.0::double / (61 + k)), 9) score from r where k < 50 group by 1, 2), t as (select * from (select *, row_number() over (partition by query_id order by score desc, item_id) - 1 k from f) where k < 10), p as (select query_id, q.label, min(case when i.label = q.label then k end) k, max(score) top from t join v q on q.vec_id = query_id join v i on i.vec_id = item_id group by 1, 2) select label, count(*) n, round(avg(coalesce(1.0::double / (k + 1), 0)), 6) mrr, count(*) filter (top >= 0.031) answered, count(*) filter (top >= 0.031 and k = 0) as \"right\" from p group by label",
}
