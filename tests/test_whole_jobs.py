"""The whole job: queries over all rows against brute force."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions.similarity import indel_ratio, jaro_winkler, token_set_ratio
from tessera.functions.text import MULTI, SINGLE
from tessera.operators import groups, search

def saved(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_coverage_without_rare_words(spark, tmp_path):
    docs = spark.createDataFrame([(i, "frequent words only") for i in range(9)] + [(9, "something else")], "doc_id long, text string")
    sf = saved(spark, tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, "frequent words only")], "item_id long, text string"))
    assert sorted(tuple(r) for r in plans.QUERIES["coverage_weighted"](spark, sf).collect()) == [(1, i, 1.0) for i in range(9)]


def test_one_link_between_large_groups(spark, tmp_path):
    """Two groups of 12 near copies; both ends of the only link between them have 11 closer partners."""
    angles = {i: 0.01 * i for i in range(11)} | {11: 25} | {20 + i: 120 + 0.01 * i for i in range(11)} | {31: 90, 40: 200}
    at = {i: (math.cos(math.radians(x)), math.sin(math.radians(x))) for i, x in angles.items()}
    assert [(a, b) for a in range(12) for b in range(20, 32) if at[a][0] * at[b][0] + at[a][1] * at[b][1] >= 0.4] == [(11, 31)]
    v = spark.createDataFrame([(i, list(x)) for i, x in at.items()], "vec_id long, embedding array<double>")
    got = {r.vec_id: r["class"] for r in plans.QUERIES["near_dup_vectors"](spark, saved(spark, tmp_path, embeddings=v)).collect()}
    assert got == {i: 40 if i == 40 else 0 for i in at}
    blocks = search.vector_links(v, 0.4, item_id="vec_id", block=5)
    assert {r.node: r.component for r in groups.components(blocks).collect()} == {i: 0 for i in at if i != 40}


def parts(spark, folder):
    """120 parts with keys on both sides of 400."""
    names = ["old plate", "cold plate", "blue ring", "hot bolt", "large ring", "large bolt", "blue gear"]
    rows = [(k, names[k * k % 7], f"B{k % 4}", f"T{k % 3}", k * 7 % 50) for k in range(340, 460)]
    return saved(spark, folder, part=spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")), rows


def test_pairs_of_all_parts(spark, tmp_path):
    sf, rows = parts(spark, tmp_path)
    pairs = {(a[0], b[0]): (a[1], b[1]) for a in rows for b in rows if a[3] == b[3] and a[0] % 20 == 0 and a[0] != b[0]}
    for name, values in (("token_set_pairs", lambda x, y: (token_set_ratio(x, y), indel_ratio(x, y))), ("jaro_winkler_pairs", lambda x, y: (jaro_winkler(x, y),))):
        got = {(r.a, r.b): tuple(r)[2:] for r in plans.QUERIES[name](spark, sf).collect()}
        assert got == {k: pytest.approx(values(*v), abs=1e-6) for k, v in pairs.items()}
    assert {(r.a, r.b) for r in plans.QUERIES["levenshtein_pairs"](spark, sf).collect()} == set(pairs)


def test_analogues_of_all_parts(spark, tmp_path):
    sf, rows = parts(spark, tmp_path)
    df = Counter(w for r in rows for w in r[1].split())
    idf = {w: math.log((len(rows) + 1) / (n + 1)) + 1 for w, n in df.items() if 2 <= n <= len(rows) / 2}

    def cosine(x, y):
        x, y = ({w: idf[w] for w in s.split() if w in idf} for s in (x, y))
        length = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / length if length else 0

    def score(a, b):
        axes = [1.0 if x == y else 0.5 if None in (x, y) else 0.0 for x, y in zip(*((s % 3 or None, s % 2 if s % 5 else None) for s in (a[4], b[4])), strict=True) if (x, y) != (None, None)]
        g, h = set(a[1].split()), set(b[1].split())
        return round(0.4 * len(g & h) / len(g | h) + 0.15 * (a[4] % 7 == b[4] % 7) + 0.2 * (sum(axes) / len(axes) if axes else 0.5) + 0.25 * cosine(a[1], b[1]), 9)

    want = {}
    for a in rows:
        best = sorted((-score(a, b), b[0]) for b in rows if a[3] == b[3] and a[2] != b[2])[:5]
        want |= {(a[0], k): (i, pytest.approx(-s, abs=2e-6)) for k, (s, i) in enumerate(best) if s < 0}
    assert {(r.query_id, r["rank"]): (r.item_id, r.score) for r in plans.QUERIES["analogues"](spark, sf).collect()} == want


def test_whole_text_normalized(spark, tmp_path):
    texts = ["Straße, Ê Í Ó", "well-known [brackets] §5", "Щука жёлтая «Ёлка»", "a/b_c\td"]
    sf = saved(spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = ["straße e i o", "well known brackets 5", "shchuka zheltaya elka", "a b_c d"]
    assert [normalized(t) for t in texts] == want
    assert [r[1] for r in plans.QUERIES["text_normalize"](spark, sf).orderBy("doc_id").collect()] == [hashlib.md5(t.encode()).hexdigest() for t in want]


def normalized(t):
    """normalize in plain Python."""
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
    single = dict(zip(SINGLE[0], SINGLE[1].ljust(len(SINGLE[0]), "\0"), strict=True))
    t = "".join(MULTI.get(c, single.get(c, c)) for c in t).replace("\0", "")
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


def test_coverage_by_indel_ratio(spark):
    rows = [(["port"], ["porto"]), (["merlo"], ["merol"]), (["chardonnay"], ["chordonney"]), (["abcd"], ["abef"]), (["2024"], ["2023"]), (["abc"], ["abd"]), (["muskat"], ["muskatel"])]
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, asked array<string>, own array<string>")
    assert [x[0] for x in r.orderBy("i").select(search.coverage(F.col("asked"), F.col("own"))).collect()] == [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert [x[0] for x in r.orderBy("i").select(search.coverage(F.col("asked"), F.col("own"), ratio=90.0)).collect()] == [0.0] * 7
