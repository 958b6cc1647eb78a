"""Reports, answers, boxes and keyed rules that no SQL covers, against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import linalg
from tessera.functions.similarity import indel_ratio, token_set_ratio
from tessera.operators import answers, boxes, catalog, learning, reports
from tessera.streaming import state


def saved(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def parts(spark, folder):
    names = ["old plate", "cold plate", "blue ring", "hot bolt", "large ring", "largo bolt", "blue gear"]
    rows = [(k, names[k * k % 7], f"B{k % 4}", f"T{k % 3}", k * 7 % 50) for k in range(80)]
    return saved(spark, folder, part=spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")), rows


def covered(asked, own, weight):
    def hit(w):
        return w in asked or (len(w) > 3 and not w.isdigit() and any(abs(len(a) - len(w)) <= 1 and indel_ratio(a, w) >= 80 for a in asked))

    total = sum(weight(w) for w in own)
    return sum(weight(w) for w in own if hit(w)) / total if total else 0.0


def test_word_coverage(spark, tmp_path):
    sf, rows = parts(spark, tmp_path)
    got = {(r.query_id, r.item_id): r.coverage for r in plans.QUERIES["word_coverage"](spark, sf).collect()}
    assert got == {(a[0], b[0]): pytest.approx(covered(a[1].split(), b[1].split(), len), abs=1e-6) for a in rows for b in rows if a[0] % 20 == 0 and a[3] == b[3]}
    assert any(0 < v < 1 for v in got.values())


def test_card_signals(spark, tmp_path):
    sf, rows = parts(spark, tmp_path)
    of = {r[0]: r for r in rows}
    color = lambda k: (None, "red", "white")[k % 3]
    got = {r.query_id: tuple(r)[2:] for r in plans.QUERIES["card_signals"](spark, sf).collect()}
    for k, name, _, _, size in rows:
        card = of.get(k + 1) if (k + 1) % 10 else None
        if card is None:
            assert got[k] == (0.0, 0, 0.0, 0, 0, 0, 0)
            continue
        words, own = name.split(), card[1].split()
        a, b = color(size), color(card[4] + 1)
        assert got[k] == (
            pytest.approx(covered(words, own[:1], lambda w: 1.5), abs=1e-6),
            1,
            pytest.approx(covered(words, own, lambda w: 2.0 if w == own[0] else 1.0), abs=1e-6),
            int(covered(words, own[1:], lambda w: 1.0) > 0),
            0 if None in (a, b) else 1 if a == b else -1,
            1 if size % 2 == 0 else 0,
            1 if words[0] == own[0] else -1,
        )


def test_push_plans(spark):
    rows = [(u, i, f"2024-01-{1 + i // 3:02d} {(i * 7 + u) % 24:02d}:{i % 60:02d}:00", i % 4 + u, i % 18) for u in range(3) for i in range(60)]
    e = spark.createDataFrame(rows, "user int, id int, ts string, name int, age int").select("user", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "name", "age")
    e = e.withColumn("made", F.col("ts") - F.make_dt_interval(hours=F.col("age")))
    got = {(r.user, r.id): r.plan for r in state.plan_pushes(e, user="user", ts="ts", made="made", name="name", order="id").collect()}
    want = {}
    by = defaultdict(list)
    for r in e.collect():
        by[r.user].append(r)
    for user, own in by.items():
        sent = []
        for r in sorted(own, key=lambda r: (r.ts, r.id)):
            hours = lambda t: (r.ts - t).total_seconds() / 3600  # noqa: E731, B023
            if any(n == r.name and hours(t) < 72 for t, n in sent):
                plan = "duplicate"
            elif hours(r.made) > 14:
                plan = "stale"
            elif r.ts.hour >= 22 or r.ts.hour < 9:
                plan = "quiet"
            elif sum(t.date() == r.ts.date() for t, _ in sent) >= 2:
                plan = "cap"
            elif sent and hours(sent[-1][0]) < 2:
                plan = "gap"
            else:
                plan = "send"
                sent.append((r.ts, r.name))
            want[user, r.id] = plan
    assert got == want
    assert set(want.values()) >= {"send", "duplicate", "stale", "quiet"}


def test_fuzzy_best_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "CHOICES", 3)
    texts = [("old plate",), ("blue rings",), ("blue ring",), (None,), ("old plate",), ("",)]
    choices = ["plate", "old plate large", "blue ring", "ring", "large bolt", "gear", "hot gear", "x"]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.choice, r.score) for r in catalog.fuzzy_best(rows, spark.createDataFrame([(c,) for c in choices], "c string"), text="t", choice="c").collect()}
    want = {i: (None, None) if t is None else max((token_set_ratio(t, c), c) for c in choices)[::-1] for i, (t,) in enumerate(texts)}
    assert got == {i: (c, s if s is None else pytest.approx(s)) for i, (c, s) in want.items()}


def test_supports_switch(spark):
    r = spark.createDataFrame([("reserve shiraz", "Estate Shiraz", "Estate Merlot"), ("estate", "Estate Shiraz", "Estate Merlot"), ("x", "same", "same")], "t string, a string, b string")
    assert [x[0] for x in r.select(answers.supports_switch(F.col("t"), F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_partial_box_becomes_the_whole(spark):
    box = lambda *v: linalg.box(*[F.lit(x) for x in v])
    cases = [("a", (0.4, 0.4, 0.6, 0.6), 0.9), ("a", (0.4, 0.35, 0.6, 0.95), 0.3), ("a", (0.0, 0.0, 0.3, 0.9), 0.2), ("b", (0.4, 0.4, 0.6, 0.6), 0.9)]
    rows = None
    for image, v, score in cases:
        one = spark.range(1).select(F.lit(image).alias("image"), box(*v).alias("box"), F.lit(score).alias("score"))
        rows = one if rows is None else rows.union(one)
    got = {r.image: (r.box.y1, r.expanded) for r in boxes.expand_partial(rows).collect()}
    assert got == {"a": (0.95, True), "b": (0.6, False)}


def test_ranker_prefers_the_positive(spark):
    rows = [(q, i, int(i == q % 4), 0.1 * i + (1.0 if i == q % 4 else 0.0), 0.5 - 0.1 * i, "f", 9, 9) for q in range(30) for i in range(4)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, label int, a double, b double, family string, vis_rank int, txt_rank int")
    weights = learning.fit_ranker(learning.preference_pairs(df, ["a", "b"]), ["a", "b"])
    best = df.withColumn("s", learning.ranker_score(weights)).groupBy("query_id").agg(F.max_by("label", "s").alias("label"))
    assert all(r.label == 1 for r in best.collect()) and weights["a"] > 0


def test_out_of_fold_never_sees_its_group(spark):
    """The label is the group's parity, which the only feature tells within a group; a model of the others can't know it."""
    rows = [(g, i, g % 2, float(g)) for g in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, i int, label int, x double")
    out = learning.out_of_fold(df, ["x"], F.col("g"), 4, kind="lr").collect()
    assert len(out) == len(rows) and len({(r.g, r.fold) for r in out}) == 40
    assert all(0 < r.probability < 1 for r in out)


def test_bagged_threshold(spark):
    rows = [(c, round(0.02 * (i + c % 5), 4), i % 3 > 0, i % 4 > 0) for c in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "cluster long, raw double, known boolean, correct boolean")
    grid = spark.createDataFrame([(t / 10,) for t in range(10)], "threshold double")
    weights = {(r.replicate, r.cluster): r.weight for r in learning.bootstrap_weights(df, 7, 3).collect()}
    picks, outside = [], []
    for b in range(7):
        best = {}
        for t in (t / 10 for t in range(10)):
            s = dict.fromkeys("rwfku", 0)
            for c, raw, known, correct in rows:
                w = weights[b, c]
                s["k" if known else "u"] += w
                if raw >= t:
                    s[("r" if correct else "w") if known else "f"] += w
            best[t] = round(0.5 * (s["r"] - s["w"]) / s["k"] - 0.5 * s["f"] / s["u"], 9)
        flat = sorted(t for t, u in best.items() if u == max(best.values()))
        picks.append(flat[len(flat) // 2])
        out = [r for r in rows if weights[b, r[0]] == 0]
        if any(r[2] for r in out) and not all(r[2] for r in out):
            outside.append(sum(r[1] >= picks[-1] for r in out if not r[2]) / sum(not r[2] for r in out))
    got = learning.bagged_threshold(df, grid, 7, seed=3).first()
    assert got.threshold == pytest.approx(sorted(picks)[3])
    assert got.false_accept == pytest.approx(sum(outside) / len(outside))


def test_decider_is_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, label int")
    assembler, model = learning.fit_classifier(df, ["x"], kind="lr")
    learning.save_decider(spark, assembler, model, {"threshold": 0.5, "features": ["x"]}, str(tmp_path / "d"))
    loaded, meta = learning.load_decider(spark, str(tmp_path / "d"))
    assert meta == {"threshold": 0.5, "features": ["x"]}
    want = [r.probability for r in model.transform(assembler.transform(df)).orderBy("x").collect()]
    assert [r.probability for r in loaded.transform(df).orderBy("x").collect()] == want


def test_breaker_with_a_deadline(spark):
    e = spark.createDataFrame([(1, float(i), s) for i, s in enumerate([0.1, 9.0, -1.0, 0.1, 0.1])], "k int, ts double, took double")
    out = state.circuit_breaker(e, key="k", ts="ts", order="ts", failed="took", failures=2, cooldown_seconds=1.5, deadline_seconds=5)
    assert [r.call for r in out.orderBy("ts").collect()] == ["ok", "failed", "failed", "open", "ok"]


def test_outcome_dump(spark, tmp_path):
    reports.outcome_dump(spark.range(5).select(F.col("id").alias("query_id"), F.lit("x").alias("verdict")), str(tmp_path / "out"))
    assert sorted(r.query_id for r in spark.read.json(str(tmp_path / "out")).collect()) == list(range(5))


def test_merged_stream_keeps_untouched_buckets(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda ks, at: spark.createDataFrame([(k, at, False, at) for k in ks], "k long, ts long, deleted boolean, id long")
    merge = state.merge_into(target, ["k"], updated="ts", deleted="deleted", tie="id", buckets=8)
    for i, (ks, at) in enumerate([(range(40), 1), ([3, 5], 9), ([3], 4), ([7, 3], 12), ([3], 20)]):
        merge(rows(ks, at), i)
        merge(rows(ks, at), i)  # a repeated batch
    got = {r.k: r.ts for r in state.merged(spark, target).collect()}
    assert got == {k: {3: 20, 5: 9, 7: 12}.get(k, 1) for k in range(40)}
