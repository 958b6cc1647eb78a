"""The queries of contracts: columns, types and digests over a saved table."""

import zlib

import pytest

from conftest import SCHEMA, words
from test_joins import components, expected_kept, later_matches
from tessera.llm import queries


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    once = {r[0]: r for r in rows if r[0] is not None}
    spark.createDataFrame(list(once.values()), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in once], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), list(once.values())


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_line_dedup_query(spark, folder):
    path, rows = folder
    gone = later_matches(rows, 80)
    got = queries.op6_line_dedup(spark, path).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines) for r in got} == {r[0]: (sum(bool(words(x)) for x in (r[1] or "").split("\n")), len(gone.get(r[0], [])), gone.get(r[0], [])) for r in rows}


def test_substring_dedup_query(spark, folder):
    path, rows = folder
    df = queries.op4_substring_dedup(spark, path)
    assert kinds(df) == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()} == {d: (n, gone, sha) for d, (n, gone, _, sha) in expected_kept(rows, 20).items()}


def test_ngram_join_query(spark, folder):
    path, rows = folder
    df = queries.op9_ngram_join(spark, path)
    assert kinds(df) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()} == components(rows, 3, 90)


def test_sharding_query(spark, folder):
    path, rows = folder
    df = queries.op5_sharding(spark, path)
    assert kinds(df) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in text.items()}
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1


def test_classifier_and_mixing_queries(spark, folder):
    path, rows = folder
    scored = queries.op8_quality_classifier(spark, path)
    assert kinds(scored) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in scored.collect())
    mixed = queries.op10_mixing(spark, path)
    assert {k: v for k, v in kinds(mixed).items() if k in ("doc_id", "size", "source_size", "target", "taken")} == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    size = {r[0]: len(words(r[1])) for r in rows}
    assert all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in mixed.collect())
