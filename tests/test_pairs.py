"""Pairs of rows that share a key: each two values are compared once, whatever the number of their rows."""

import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import similarity
from tessera.operators import pairs, search


def parts(spark, folder, names=("old plate", "Old Plate", "blue ring", None, ""), n=300):
    rows = [(k, names[k * k % len(names)], "B", f"T{k % 2}" if k % 50 else None, 1) for k in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder), rows


def counting(spark, f, kind="double"):
    """f over pairs of strings as a UDF, and the number of pairs that it was asked for."""
    asked = spark.sparkContext.accumulator(0)

    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(compare, kind), asked


def test_blocks_of_a_common_value(spark):
    a = [(i, "u" if i % 3 else None, "k" if i != 4 else None) for i in range(7)]
    b = [(i if i else None, "v" if i % 4 else "w", "k" if i != 5 else "other") for i in range(9)]
    left, right = spark.createDataFrame(a, "a long, x string, key string"), spark.createDataFrame([*b, b[1]], "b long, y string, key string")
    got = pairs.scored_pairs(left, right, "key", lambda x, y: {"s": F.concat(x, y)}, size=2)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, j, x and x + y) for i, x, k in a for j, y, m in [*b, b[1]] if k == m)


def test_rows_are_handed_on(spark):
    """Generated code keeps all that a row becomes within it until the next row: the join and both explodes are apart."""
    left, right = (spark.range(100).selectExpr(f"id {i}", f"'same' {v}", "'k' key") for i, v in ("ax", "by"))
    got = pairs.scored_pairs(left, right, "key", lambda x, y: {"s": F.concat(x, y)}, size=10)
    assert sorted(got.collect()) == [(a, b, "samesame") for a in range(100) for b in range(100)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    parts = [re.search(rf"\*\((\d+)\) {node}", plan)[1] for node in (r"\w+Join\b", r"Generate \w+\(_a", r"Generate \w+\(_b")]
    assert len(set(parts)) == 3


def each_name_once(spark, tmp_path, name, asked):
    """The query's rows, after at most 5 names against 5 of each of two types were compared."""
    sf, rows = parts(spark, tmp_path)
    got = plans.QUERIES[name](spark, sf).collect()
    want = {(a[0], b[0]): (a[1], b[1]) for a in rows for b in rows if a[0] % 20 == 0 and a[3] == b[3] is not None}
    assert len(got) == len({tuple(r)[:2] for r in got}) and 0 < asked.value <= 50
    return {tuple(r)[:2]: tuple(r)[2:] for r in got}, want


def test_jaro_winkler_pairs(spark, tmp_path, monkeypatch):
    udf, asked = counting(spark, similarity.jaro_winkler)
    monkeypatch.setattr(similarity, "jaro_winkler_udf", udf)
    got, want = each_name_once(spark, tmp_path, "jaro_winkler_pairs", asked)
    assert got == {k: (None if None in v else pytest.approx(similarity.jaro_winkler(*map(str.lower, v)), abs=1e-9),) for k, v in want.items() if k[0] != k[1]}


def test_token_set_pairs(spark, tmp_path, monkeypatch):
    udf, asked = counting(spark, similarity.token_set_ratio)
    monkeypatch.setattr(similarity, "token_set_ratio_udf", udf)
    got, want = each_name_once(spark, tmp_path, "token_set_pairs", asked)
    scores = lambda x, y: (similarity.token_set_ratio(x, y), similarity.indel_ratio(x, y))
    assert got == {k: (None, None) if None in v else pytest.approx(scores(*map(str.lower, v)), abs=1e-6) for k, v in want.items() if k[0] != k[1]}


def test_word_coverage(spark, tmp_path, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def hits(read: pd.Series, own: pd.Series) -> pd.Series:
        asked.add(len(read))
        return pd.Series([None if q is None or o is None else [w for w in o if w in set(q)] for q, o in zip(read, own, strict=True)], dtype="object")

    monkeypatch.setattr(search, "_token_hits", lambda ratio: hits)
    # names are not folded here: old and Old Plate are two
    got, want = each_name_once(spark, tmp_path, "word_coverage", asked)
    share = lambda x, y: sum(len(w) for w in y if w in x) / max(1, sum(map(len, y)))
    assert got == {k: (0.0 if None in v else pytest.approx(share(*(n.split(" ") for n in v)), abs=1e-6),) for k, v in want.items()}


def test_levenshtein_pairs(spark, tmp_path, monkeypatch):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    udf, asked = counting(spark, distance, "int")
    monkeypatch.setattr(F, "levenshtein", udf)
    got, want = each_name_once(spark, tmp_path, "levenshtein_pairs", asked)
    part = lambda x, y: distance(x, y) / max(len(x), len(y)) if x and y else 1.0
    # with an empty name the share is 1 whatever the other one is
    scores = lambda x, y: (None, 1.0 if "" in (x, y) else None) if None in (x, y) else (distance(x.lower(), y.lower()), pytest.approx(part(x.lower(), y.lower()), abs=1e-9))
    assert got == {k: scores(*v) for k, v in want.items() if k[0] != k[1]}
