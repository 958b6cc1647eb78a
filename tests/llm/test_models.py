"""Packing by round trip and brute force; the classifier by held-out accuracy; the pipeline stage by stage."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SCHEMA, corpus, words
from test_joins import components, shingles
from tessera.llm import classifier, mixing, packing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary file here")


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("capacity", [1, 7, 8, 100])
def test_best_fit_decreasing(capacity):
    lengths = np.random.default_rng(capacity).integers(1, capacity + 1, 300)
    rows = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(p for r in rows for p in r) == list(range(300))
    assert sorted(int(lengths[r].sum()) for r in rows) == plain_best_fit(lengths.tolist(), capacity)


@needs_vocabulary
@pytest.mark.parametrize("options", [{}, {"row_length": 64, "block_ids": 3000}])
def test_packing_round_trip(spark, docs, rows, options):
    length = options.get("row_length", packing.ROW_LENGTH)
    packed = packing.packed(docs, **options)
    got = packed.collect()
    assert len({r.row_id for r in got}) == len(got)
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.n_ids == r.cu_seqlens[-1] <= length
        assert r.position_resets == r.cu_seqlens[:-1] and r.n_segments == len(r.doc_ids) == len(r.piece_starts)
        for d, s, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            pieces[d].append((s, ids[a:b]))
    with open(packing.VOCABULARY, "rb") as f:
        code = packing.coder(f.read(), packing.PATTERN)
    expected = defaultdict(Counter)
    for r in rows:
        expected[r[0]][r[1] or ""] += 1
    for d, found in pieces.items():
        if sum(expected[d].values()) == 1:
            ids = np.concatenate([x for _, x in sorted(found, key=lambda p: p[0])])
            assert ids[-1] == packing.END_ID and code.decode(ids[:-1].tolist()) == next(iter(expected[d]))
    assert set(pieces) == set(expected)
    assert packing.unpack(spark, packed).count() == sum(r.n_segments for r in got)
    wide = packing.to_matrix(packed, length).select(F.length("ids")).distinct().collect()
    assert [r[0] for r in wide] == [2 * length]


@needs_vocabulary
def test_packing_empty_and_clashing(empty, clashing, tmp_path):
    assert packing.packed(empty).count() == 0
    assert packing.packed(clashing).agg(F.sum("n_segments")).first()[0] >= clashing.count()
    packing.write(packing.packed(clashing), str(tmp_path / "ids"))


def test_isotonic():
    x, p = classifier.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 5.0]), np.array([1, 0, 1, 0, 0]))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()
    score, label = np.linspace(0, 1, 400), (np.random.default_rng(0).random(400) < np.linspace(0, 1, 400)).astype(int)
    x, p = classifier.isotonic(score, label)
    assert np.abs(np.interp(score, x, p) - score).mean() < 0.1


def labelled(spark, n=600):
    rng, rows, labels = random.Random(5), [], []
    vocabulary = ["the", "of", "and"] * 30 + [f"{a}{b}" for a in ("tion", "ler", "mos") for b in ("da", "ri", "ne", "so")]
    for i in range(n):
        good = i % 3 > 0
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        rows.append((i, (" ".join(w) + ".") if good else " ".join(x.upper() + "!!" for x in w), "en", "s", 1))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = classifier.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_classifier_equals_a_plain_fit(spark):
    """Ridge on random features by one normal equation of all rows, and isotonic means by the max-min formula."""
    docs, labels = labelled(spark, 300)
    rng = np.random.Generator(np.random.PCG64(7))
    w, b = rng.normal(0, np.sqrt(2 * classifier.GAMMA), (classifier.N_STATS, classifier.FEATURES)), rng.uniform(0, 2 * np.pi, classifier.FEATURES)
    use = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)).alias("use")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", use).orderBy("doc_id").collect()
    x, y = np.array([classifier.statistics(r.text) for r in rows]), np.array([r.quality for r in rows])
    learned = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows])
    fit, calibrate = (learned & np.array([(r.use > 0) == z for r in rows]) for z in (True, False))
    mean, scale = x[fit].mean(0), np.sqrt(np.maximum(x[fit].var(0), 1e-6))
    z = np.hstack([np.sqrt(2 / classifier.FEATURES) * np.cos((x - mean) / scale @ w + b), np.ones((len(x), 1))])
    weight = np.where(y[fit] == 1, fit.sum() / (2 * y[fit].sum()), fit.sum() / (2 * (1 - y[fit]).sum()))
    a = (z[fit] * weight[:, None]).T @ z[fit] + classifier.RIDGE * fit.sum() / classifier.FEATURES * np.eye(classifier.FEATURES + 1)
    raw = z @ np.linalg.solve(a, (z[fit] * weight[:, None]).T @ y[fit])
    order = np.argsort(raw[calibrate])
    r, label = raw[calibrate][order], y[calibrate][order].astype(float)
    means = [max(min(label[j : k + 1].mean() for k in range(i, len(r))) for j in range(i + 1)) for i in range(len(r))]
    xs, ps = [r[0] - max(1.0, r[-1] - r[0])], [None]
    for v in sorted({round(m, 12) for m in means}):
        block = [i for i, m in enumerate(means) if round(m, 12) == v]
        xs.append(r[block].mean())
        ps.append((label[block].sum() + 0.5) / (len(block) + 1))
    ps = [ps[1] / 2, *np.maximum.accumulate(ps[1:]), (1 + max(ps[1:])) / 2]
    expected = np.interp(raw, [*xs, r[-1] + max(1.0, r[-1] - r[0])], ps)
    got = {g.doc_id: g.score for g in classifier.classify(docs, labels).collect()}
    assert [got[g.doc_id] for g in rows] == pytest.approx(expected.tolist(), abs=1e-6)
    assert len(set(got.values())) > 250


def test_classifier_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in classifier.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in classifier.classify(docs.withColumn("source", F.lit("z")), flipped).collect()}
    assert a == pytest.approx(b)


def test_classifier_edges(spark, docs, empty, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    assert classifier.classify(empty, labels).count() == 0
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert {r.score for r in classifier.classify(docs, ones).collect()} == {1.0}
    kept = classifier.keep_good(clashing, ones)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    odd = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") % 7 > 0, 0).alias("quality"))
    assert all(0 <= r.score <= 1 for r in classifier.classify(docs, odd).collect())


@needs_vocabulary
def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus(seed=8, n=60) if r[0] is not None]
    item = " ".join(words(max((r[1] or "" for r in rows), key=lambda t: len(t) if len(t) < 2000 else 0))[3:40])
    for name, df in {
        "documents": spark.createDataFrame(rows, SCHEMA),
        "benchmark": spark.createDataFrame([(0, item)], "item_id long, text string"),
        "labels": spark.createDataFrame([(r[0], int("!!" not in (r[1] or "")), 0) for r in rows], "doc_id long, quality int, toxic int"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_join", "decontamination", "mixing", "packing"]
    (_, f8), (_, f9), (_, f3), (_, f10), (_, f2) = corpus_pipeline.STAGES
    good = f8(spark, docs, str(tmp_path)).cache()
    assert 0 < good.count() <= docs.count() and good.columns == docs.columns
    one = f9(spark, good, str(tmp_path)).cache()
    left = [tuple(r) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in components(left, 5, 80).items() if c == d)
    clean = f3(spark, one, str(tmp_path)).cache()
    wanted = shingles(item, 5)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in one.collect() if 10 * len(shingles(r.text, 5) & wanted) < 8 * len(wanted))
    mixed = f10(spark, clean, str(tmp_path)).cache()
    assert mixed.columns == docs.columns and mixed.count() == mixing.assign(clean).agg(F.sum("_copies")).first()[0]
    last = f2(spark, mixed, str(tmp_path))
    assert Counter(d for r in last.collect() for d, s in zip(r.doc_ids, r.piece_starts) if s == 0) == Counter(r.doc_id for r in mixed.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("n_ids")).first() == last.agg(F.sum("n_ids")).first()


def stages_alone(spark, docs, folder, labels, items):
    """All stages after one another; the rows that each leaves, and the last one's result."""
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns
        docs = spark.createDataFrame(left.collect(), left.schema)
        out.append(docs.collect())
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


@needs_vocabulary
def test_pipeline_with_null_ids_repeated_rows_and_clashing_columns(spark, clashing, rows, tmp_path):
    (good, one, clean, mixed), packed = stages_alone(spark, clashing, str(tmp_path), [], [])
    assert len(good) == len(rows)  # no labels: every score is 0.5
    assert sum(r.doc_id is None for r in one) == sum(r[0] is None for r in rows)
    left = [r.doc_id for r in one if r.doc_id is not None]
    assert len(left) == len(set(left))
    assert len(clean) == len(one)  # no items
    assert sum(len(r.doc_ids) for r in packed) >= len(mixed)


@needs_vocabulary
def test_pipeline_of_nothing(spark, empty, tmp_path):
    stages, packed = stages_alone(spark, empty, str(tmp_path), [(1, 1, 0), (2, 0, 0)], [(1, "some words of an item to find")])
    assert stages == [[], [], [], []] and packed == []
