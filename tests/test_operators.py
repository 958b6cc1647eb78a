"""Windows, decisions, groups, metrics, sources and streams against hand-made rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators import catalog, decisions, fusion, groups, learning, metrics, recommend, search, windows
from tessera.sources import readers, writers
from tessera.streaming import state

BASE = dict(vis_score=0.5, vis_rank=0, txt_score=0.5, txt_rank=0, rrf_rank=0, inliers=8, inlier_ratio=0.8, homography_ok=1, geometry_query_coverage=0.5, geometry_candidate_coverage=0.5, geometry_normalized_error=0.1, ocr_lines=5, disc_n=1, disc_hit=0.0, name_cover=0.0, winery_hit=0, color_match=0, style_match=0, grape_match=0, family="")


def rows(spark, *changes):
    return spark.createDataFrame([Row(query_id=1, item_id=chr(97 + i), pos=i, **(BASE | c)) for i, c in enumerate(changes)])


def derived(spark, *changes, **options):
    return [r.asDict() for r in windows.derive(rows(spark, *changes), **options).orderBy("pos").collect()]


def test_max_over_others_defaults(spark):
    a, b, c = derived(spark, {"vis_score": 0.9}, {"vis_score": 0.7}, {"vis_score": 0.9})
    assert [round(x["vis_margin"], 6) for x in (a, b, c)] == [0.0, -0.2, 0.0]
    (alone,) = derived(spark, {"family": "x", "disc_hit": 0.4})
    assert alone["vis_margin"] == 0.5 and alone["txt_margin"] == 1.5 and alone["rrf_margin"] == 0 and alone["family_disc_margin"] == 0 and alone["family_size"] == 1 and alone["disc_contra"] == 0


def test_ranks_close_up(spark):
    got = derived(spark, {"vis_rank": 7, "txt_rank": 999, "rrf_rank": 9}, {"vis_rank": 999, "txt_rank": 4, "rrf_rank": 3}, {"vis_rank": 2, "txt_rank": 1, "rrf_rank": 5})
    assert [(x["vis_rank"], x["txt_rank"], x["rrf_rank"]) for x in got] == [(1, 999, 2), (999, 1, 0), (0, 0, 1)]
    assert got[1]["vis_distance"] == 2.0 and got[1]["vis_zscore"] == 0.0


def test_theta_rivals(spark):
    red, white = {"inliers": 390, "color_match": 1, "disc_hit": 1.0, "disc_n": 1}, {"inliers": 520, "color_match": -1, "disc_hit": 0.0, "disc_n": 1}
    both = lambda x: (x["inliers_gap"], x["inliers_margin"])
    assert both(derived(spark, red, white)[0]) == (130, -130)
    assert both(derived(spark, red, white, rivals="text")[0]) == (0, 390)


def test_family_and_geometry(spark):
    a, b, c = derived(spark, {"family": "x", "disc_hit": 0.2}, {"family": "x", "disc_hit": 0.6}, {"family": "", "disc_hit": 0.9})
    assert (a["disc_contra"], b["disc_contra"], c["disc_contra"]) == (0.6, 0.2, 0.0) and a["family_size"] == 2 and c["family_size"] == 0
    assert a["geometry_support"] == pytest.approx(8 * 0.8 * 0.5 / 1.1)


GUARDS = [
    ({}, "twin", None), ({"color_match": -1, "disc_hit": 1.0}, "twin", "twin"), ({"style_match": -1, "disc_hit": 1.0}, "twin", "twin"), ({"winery_hit": 1}, "twin", "twin"),
    ({"disc_contra": 0.5}, "twin", "twin"), ({"name_cover": 0.0}, "twin", "twin"), ({"color_match": -1, "ocr_lines": 2}, "twin", None), ({"color_match": -1}, "strict", "twin"),
    ({"color_match": -1, "disc_hit": 1.0}, "strict", None), ({"grape_match": -1, "disc_hit": 1.0}, "contra", "contra"), ({"grape_match": -1, "disc_hit": 1.0}, "twin", None), ({"color_match": -1}, "off", None),
]


@pytest.mark.parametrize(("change", "mode", "expected"), GUARDS)
def test_guards(spark, change, mode, expected):
    row = BASE | {"disc_contra": 0.0, "name_cover": 0.5} | change
    assert spark.createDataFrame([Row(**row)]).select(decisions.twin_guard(mode).alias("g")).first()[0] == expected


def test_unknown_guard():
    with pytest.raises(ValueError):
        decisions.twin_guard("loud")


def test_sibling_swap_and_twins(spark):
    r = rows(spark, {"family": "x", "color_match": -1}, {"family": "x", "color_match": 1, "disc_hit": 0.5, "txt_rank": 3}, {"family": "x", "color_match": 1, "disc_hit": 0.9}, {"family": "y", "color_match": 1, "disc_hit": 1.0})
    assert [tuple(x) for x in decisions.sibling_swap(r.withColumn("position", F.col("pos"))).collect()] == [(1, "c")]
    t = rows(spark, {"family": "x"}, {"family": "x"}, {"family": "x", "grape_match": 1}, {"family": "x"}, {"family": "x"}).withColumn("position", F.col("pos")).withColumn("probability", F.lit(0.5))
    assert decisions.label_twins(t).first().twins == ["b", "d"]


def test_canonicalize(spark):
    r = spark.createDataFrame([(1, "a", 0, 0.9), (1, "b", 1, 0.5), (1, "c", 2, 0.95), (2, "a", 0, 0.9), (2, "b", 1, 0.5)], "query_id int, item_id string, position int, probability double")
    got = decisions.canonicalize(r, spark.createDataFrame([("a", "c")], "item_id string, canonical_id string"))
    assert sorted(tuple(x) for x in got.select("query_id", "position", "item_id", "probability").collect()) == [(1, 0, "c", 0.95), (1, 1, "b", 0.5), (2, 0, "c", 0.9), (2, 1, "b", 0.5)]


def test_verdict_metrics(spark):
    r = spark.createDataFrame([("a", True, True, "correct"), ("b", True, False, "refused"), ("g", False, True, "accepted")], "group string, known boolean, answered boolean, verdict string")
    m = metrics.outcomes(r).first()
    assert (m.answered_precision, m.overall_answered_precision, m.coverage, m.known_correct_coverage) == (1.0, 0.5, 0.5, 0.5)
    assert {x["group"]: x.false_accept for x in metrics.false_accepts(r).collect()} == {"g": 1.0, "all": 1.0}
    assert metrics.outcomes(r.where("not known")).first().answered_precision is None


def test_latency_and_auroc(spark):
    r = spark.createDataFrame([("x", float(i)) for i in range(40)], "k string, latency_ms double")
    assert tuple(metrics.latency(r, "k").first())[1:] == tuple(metrics.latency_ranked(r, "k").first())[1:] == (19.5, 38.0, 40)
    s = spark.createDataFrame([(0.1, False), (0.4, False), (0.4, True), (0.8, True)], "score double, known boolean")
    assert metrics.auroc(s).first()[0] == pytest.approx(3.5 / 4)


def test_utility_takes_the_middle(spark):
    c = spark.createDataFrame([(0.1, 0.5, 0.2, 0.0), (0.2, 0.6, 0.1, 0.0), (0.3, 0.6, 0.1, 0.0), (0.4, 0.6, 0.1, 0.0), (0.5, 0.2, 0.0, 0.0)], "threshold double, right double, wrong double, false_accept double")
    assert metrics.utility_threshold(c, unknown_share=0.0, wrong_cost=1.0, false_cost=1.0).first().threshold == 0.3


def test_groups(spark):
    d = spark.createDataFrame([("a", "b", "equivalent", ""), ("c", "d", "equivalent", "d"), ("e", "f", "different", "")], "slug_a string, slug_b string, decision string, canonical_slug string")
    classes = groups.equivalences(d)
    assert {r.slug: r.canonical for r in classes.collect()} == {"a": None, "b": None, "c": "d", "d": "d"}
    pairs = spark.createDataFrame([("a", "b"), ("e", "f"), ("e", "e")], "x string, y string")
    assert {(r.x, r.y): r.same for r in groups.same_class(pairs, classes, "x", "y").collect()} == {("a", "b"): True, ("e", "e"): True, ("e", "f"): False}
    with pytest.raises(Exception, match="outside its class"):
        groups.equivalences(spark.createDataFrame([("a", "b", "equivalent", "z")], d.schema)).collect()
    line = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in groups.components(line).collect()} == {0}


def test_vintages(spark):
    cards = spark.createDataFrame([("leto-2020", "LETO 2020", "w", "c", "g", [2020]), ("leto-2024", "LETO 2024", "w", "c", "g", [2024]), ("leto-cf", "LETO Каберне Фран 2020", "w", "c", "g", [2020]), ("s1", "Шираз", "v", "c", "", []), ("s2", "Шираз", "v", "c", "", [])], "slug string, name string, winery string, category string, grapes string, years array<int>")
    g = groups.vintage_groups(cards)
    assert {r.slug for r in g.collect()} == {"leto-2020", "leto-2024"}
    asked = spark.createDataFrame([("leto-2020", 2024), ("leto-2020", 2022), ("s1", 2020), ("leto-2020", None)], "slug string, year int")
    assert {(r.slug, r.year): r.picked for r in groups.pick_vintage(asked, cards, g).collect()} == {("leto-2020", 2024): "leto-2024", ("leto-2020", 2022): "leto-2020", ("s1", 2020): "s1", ("leto-2020", None): "leto-2020"}
    known = spark.createDataFrame([(2020, [2020]), (2021, [2020]), (None, [2020]), (2020, [2019, 2020]), (2018, [2019, 2020]), (2018, []), (None, [])], "year int, known array<int>")
    got = [tuple(r[0]) for r in known.select(groups.resolve_year(F.col("year"), F.lit("text"), F.col("known")).alias("r")).collect()]
    assert got == [(2020, "catalog", False), (2021, "text", True), (2020, "catalog", False), (2020, "text", False), (None, "", True), (2018, "text", False), (None, "", False)]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 0, 0.9, "x"), (1, "b", 1, 0.5, "x"), (1, "b", 0, 0.8, "y")], "query_id int, item_id string, rank int, score double, list string")
    assert {r.item_id: r.score for r in fusion.fuse_rrf(lists).collect()} == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61})
    assert {r.item_id: r.score for r in fusion.fuse_mean(lists, "list").collect()} == pytest.approx({"a": 0.45, "b": 0.65})
    assert {r.item_id: r.position for r in fusion.ordered_union([lists.where("list = 'y'"), lists.where("list = 'x'")]).collect()} == {"b": 0, "a": 1}


def test_vector_search_is_exact_and_excludes_first(spark):
    m = np.random.default_rng(0).normal(size=(50, 8))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>")
    options = dict(query_id="id", item_id="id", vector="v")
    got = search.vector_topk_blocked(v, v, 3, exclude_self=True, block=7, **options)
    plain = search.vector_topk(v, v, 3, exclude_self=True, **options)
    key = lambda df: sorted((r.query_id, r["rank"], r.item_id) for r in df.collect())
    assert key(got) == key(plain) and len(key(got)) == 150
    ranks = search.vector_topk(v.where("id = 0"), search.without(v, spark.createDataFrame([(1,)], "id long"), "id"), 49, **options)
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(49))


def test_bm25_by_hand(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"])], "item_id int, t array<string>")
    q = spark.createDataFrame([(9, ["c", "d"])], "query_id int, t array<string>")
    got = {r.item_id: r.score for r in search.bm25_topk(q, items, 5, query_id="query_id", item_id="item_id", query_terms=F.col("t"), item_terms=F.col("t")).collect()}
    idf = math.log(2.5 / 1.5)
    assert got == pytest.approx({2: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 2)), 3: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 1 / 2))})


def test_coverage(spark):
    r = spark.createDataFrame([(1, ["muskat"], ["muskatel"]), (2, ["2024"], ["2023"]), (3, ["muskot"], ["muskat"]), (4, [], ["a"]), (5, ["a"], [])], "i int, asked array<string>, own array<string>")
    assert [x[1] for x in r.select("i", search.coverage(F.col("asked"), F.col("own"))).orderBy("i").collect()] == [0.0, 0.0, 1.0, 0.0, 0.0]


def test_catalog(spark):
    with pytest.raises(Exception, match="k repeats"):
        catalog.assert_unique(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), "k").collect()
    files = spark.createDataFrame([("a", "p1", "m"), ("b", "p2", "m"), ("b", "p3", "m"), ("c", "p4", "m"), ("c", "p5", "n")], "k string, path string, md5 string")
    got = catalog.match_files(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string"), files, "k")
    assert {r.k: (r.match, r.path) for r in got.collect()} == {"a": ("exact", "p1"), "b": ("bytes", "p2"), "c": ("ambiguous", None), "d": ("missing", None)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in catalog.upsert(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in writers.merge(old, new, "k", F.col("new.v") < F.col("old.v")).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_analogues(spark):
    items = spark.createDataFrame([("x", "m", "port", "r", ["a"], "red", None), ("port-b", "n", "port", "r", ["a"], "red", None), ("dry-red", "n", "dry", "r", ["a"], "red", None), ("sibling", "m", "port", "r", ["a"], "red", None), ("far", "n", "port", "q", ["b"], "white", None)], "item_id string, maker string, category string, region string, grapes array<string>, color string, sweetness string")
    got = recommend.analogues(items).where("query_id = 'x'").orderBy("rank").collect()
    assert [(r.item_id, round(r.score, 3)) for r in got] == [("port-b", 0.75)]


def test_learning(spark):
    x = np.random.default_rng(0).normal(size=(400, 12)) * np.r_[10, np.ones(11)] + 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    model = learning.fit_whitening(v, dim=6)
    w = np.array([r[1] for r in v.select("id", learning.whiten(F.col("embedding"), model)).orderBy("id").collect()])
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    y = centred @ vt[:6].T / (s[:6] / np.sqrt(400)) ** 0.5
    y /= np.linalg.norm(y, axis=1)[:, None]
    assert w.shape == (400, 6) and np.allclose(w @ w.T, y @ y.T, atol=1e-6)
    with pytest.raises(ValueError):
        learning.fit_whitening(v.limit(5), dim=6)
    p = spark.range(4000).select((F.col("id") % 100 / 100.0 + 0.005).alias("probability"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 < F.col("id") % 100 / 100.0).cast("int").alias("label"))
    weight, bias = learning.fit_platt(p)
    assert weight == pytest.approx(1, abs=0.2) and bias == pytest.approx(0, abs=0.2)
    learning.assert_ordered_subset(["a", "c"], ["a", "b", "c"])
    with pytest.raises(ValueError):
        learning.assert_ordered_subset(["c", "a"], ["a", "b", "c"])


def test_unknown_copies_and_bootstrap(spark):
    r = spark.createDataFrame([(1, "a", "a"), (1, "b", "a"), (2, "c", "x")], "query_id int, item_id string, true_id string")
    got = learning.with_unknowns(r).collect()
    assert sorted((x.query_id, x.item_id) for x in got if x.query_id.startswith("unknown")) == [("unknown:1", "b"), ("unknown:2", "c")]
    b = spark.range(400).select((F.col("id") % 40).alias("k"), (F.col("id") % 2).alias("v"))
    out = learning.bootstrap_interval(b, 100, cluster="k", value=F.col("v")).first()
    assert out.low < 0.5 < out.high and out.mean == pytest.approx(0.5, abs=0.05)


def test_readers(spark, tmp_path):
    payload = json.dumps([{"data": 1, "x": -1}, ["Ref", 2], {"slug": 3, "tags": 4}, "wine-a", [5, 6], "red", 7.5])
    assert json.loads(readers.resolve_references(payload)) == {"data": {"slug": "wine-a", "tags": ["red", 7.5]}, "x": None}
    assert readers.resolve_references("nope") is None and readers.resolve_references("[[0]]") is None
    page = f'<html><script type="application/json" id="data">{payload}</script></html>'
    pages = spark.createDataFrame([("wine-a", page), ("other", page), ("none", "<html>")], "slug string, html string")
    got = readers.page_cards(pages, script_id="data", fields={"slug": "$.data.slug", "first": "$.data.tags[0]"}, slug="slug")
    assert {r.slug: r.card_first for r in got.collect()} == {"wine-a": "red", "other": None, "none": None}
    xml = "<urlset><url><loc>https://a.b/wines/x-1</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://a.b/wines/y</loc></url></urlset>"
    assert [tuple(r)[1:] for r in readers.sitemap(spark.createDataFrame([(xml,)], "value string")).collect()] == [("x-1", "2024-01-02"), ("y", None)]
    reply = spark.createDataFrame([(1, '```json\n{"choice": "2", "confidence": 1.7}\n```'), (2, "no")], "i int, t string").select("i", readers.model_reply(F.col("t")).alias("r")).orderBy("i").collect()
    assert tuple(reply[0].r) == (2, 1.0) and reply[1].r.choice is None
    m = spark.createDataFrame([("p", "a", "g", "7", "own", ""), ("q", "", "g", "8", "own", ""), ("r", "b", "g", "9", "own", "multi")], "path string, true_slug string, group string, wine_id string, source string, note string")
    assert {r.path: (r.true_id, r.known) for r in readers.manifest(m).collect()} == {"p": ("a", True), "q": ("unknown:8", False)}
    up = readers.uploads(spark.createDataFrame([("a/Шато_0123456789.jpg",), ("a/small_Шато_0123456789.jpg",), ("a/Шато_abcdef0123.png",), ("a/x.png",)], "path string")).collect()
    assert [(r.key, len(r.paths)) for r in up] == [("shato", 2)]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "f", "width": 10, "height": 10}], "annotations": [{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "label"}]}))
    r = readers.coco(spark, str(tmp_path / "c.json"), {"label"}).first()
    assert (r.file, tuple(r.box)) == ("f", (1.0, 2.0, 4.0, 6.0))
    (tmp_path / "l.json").write_text('{"query": "q", "feature_version": 5, "more": 1}\n')
    assert readers.feature_log(spark, str(tmp_path / "l.json"), "query string, feature_version int", {5}).first().query == "q"
    with pytest.raises(Exception, match="unsupported feature version"):
        readers.feature_log(spark, str(tmp_path / "l.json"), "query string, feature_version int", {4}).collect()
    (tmp_path / "d.csv").write_text("Slug,Name\na,x\na,x\nb,y\n")
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path / "d.csv"), "Slug string, Name string", rename={"Slug": "slug"}, key="slug").collect()) == [("a", "x"), ("b", "y")]
    log = spark.createDataFrame([(i, f"2024-01-0{i}", i % 2 == 0) for i in range(1, 8)], "seq int, t string, model_answered boolean").withColumn("requested_at", F.col("t").cast("timestamp"))
    assert [r.seq for r in readers.request_log(log, since="2024-01-02", answered=True, limit=2, offset=1).collect()] == [4, 2]


def test_state_folds(spark):
    e = spark.createDataFrame([("a", i, s) for i, s in enumerate([0, 1, 2, 9, 10, 11, 12, 25])], "k string, i int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = state.rate_limit(e, key="k", ts="ts", order="i", limit=3, window_seconds=10).orderBy("i").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, True, True, True]
    calls = state.circuit_breaker(e.withColumn("failed", F.col("i") < 3), key="k", ts="ts", order="i", failed="failed", failures=2, cooldown_seconds=8).orderBy("i").collect()
    assert [r.call for r in calls] == ["failed", "failed", "open", "ok", "ok", "ok", "ok", "ok"]
    x = spark.createDataFrame([("u", i, g) for i, g in enumerate([60, 50, 10])], "k string, i int, gain int")
    assert [r.xp for r in state.experience(x, key="k", order=["i"], gain="gain", levels=[100, 200], bonus=5).orderBy("i").collect()] == [60, 115, 125]
    d = spark.createDataFrame([("u", f"2024-01-0{i}", s) for i, s in [(1, True), (2, True), (3, False), (4, True), (5, True), (6, True)]], "k string, d string, solved boolean").withColumn("day", F.col("d").cast("date"))
    assert tuple(state.streaks(d, key="k", day="day", solved="solved").first())[1:] == (3, 3)


def test_last_writer(spark):
    e = spark.createDataFrame([("a", 1, False, 1), ("a", 3, False, 2), ("a", 2, False, 3), ("b", 1, False, 4), ("b", 1, True, 5), ("c", 1, True, 6), ("c", 2, False, 7)], "k string, at int, deleted boolean, id int")
    assert {r.k: r.id for r in state.last_writer(e, ["k"], updated="at", deleted="deleted", tie="id").collect()} == {"a": 2, "c": 7}


def drain(query):
    query.awaitTermination(120)
    query.stop()


def test_streams_equal_their_batch_twins(spark, tmp_path):
    src = str(tmp_path / "in")
    base = spark.range(60).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 20).alias("request"))
    base.coalesce(1).write.parquet(src)
    memory = lambda df, name, mode: drain(df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start())
    stream = lambda: spark.readStream.schema(base.schema).parquet(src)
    memory(state.windowed_stream(stream(), ts="ts", every="10 minutes", by=["k"]), "w", "complete")
    batch = base.groupBy(F.window("ts", "10 minutes").alias("w"), "k").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "k", "n")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    memory(state.idempotent_stream(stream(), ["k", "request"]), "once", "append")
    assert spark.table("once").count() == base.select("k", "request").distinct().count()
    answers = str(tmp_path / "limited")
    drain(stream().writeStream.foreachBatch(state.rate_limit_into(answers, key="k", ts="ts", limit=2, window_seconds=600)).option("checkpointLocation", str(tmp_path / "cp0")).trigger(availableNow=True).start())
    twin = state.rate_limit(base, key="k", ts="ts", order="request", limit=2, window_seconds=600).select("k", "ts", "allowed")
    assert sorted(map(tuple, spark.read.parquet(f"{answers}/answers").select("k", "ts", "allowed").collect())) == sorted(map(tuple, twin.collect()))
    two = str(tmp_path / "two")
    step = state.rate_limit_into(two, key="k", ts="ts", limit=2, window_seconds=600)
    for i in range(2):
        step(base.where(F.floor((F.unix_seconds("ts") - 1_700_000_000) / 1800) == i), i)
    assert sorted(map(tuple, spark.read.parquet(f"{two}/answers").select("k", "ts", "allowed").collect())) == sorted(map(tuple, twin.collect()))
    target = str(tmp_path / "table")
    events = base.withColumn("deleted", F.col("request") == 7).withColumn("id", F.col("ts").cast("long"))
    events.coalesce(1).write.parquet(str(tmp_path / "in2"))
    drain(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in2")).writeStream.foreachBatch(state.merge_into(target, ["k"], updated="ts", deleted="deleted", tie="id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    latest = {r.k: r.id for r in state.merged(spark, target).where("not deleted").collect()}
    assert latest == {r.k: r.id for r in state.last_writer(events, ["k"], updated="ts", deleted="deleted", tie="id").collect()}
