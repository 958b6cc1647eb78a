"""Quality rules, decontamination, sharding, URL filter and mixing against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import lower_az, words
from tessera.llm import decontaminate, mixing, quality_rules, sharding, url_filter


def expected_base(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base(docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for r in got:
        expected = [expected_base(t) for t in texts[r.doc_id]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in expected
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def _distance(p, q):
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) / 2 if a else 0) + (b * math.log2(b / m) / 2 if b else 0)
    return math.sqrt(min(1.0, max(0.0, total)))


def test_js_distance(spark):
    cases = [({"a": 1.0}, {"a": 1.0}), ({"a": 1.0}, {"b": 1.0}), ({"a": 0.5, "b": 0.5}, {"a": 0.25, "c": 0.75})]
    df = spark.createDataFrame(cases, "p map<string,double>, q map<string,double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([_distance(*c) for c in cases])
    assert got[:2] == [0.0, 1.0]


def test_quality_rules_reject_junk_and_keep_prose(spark):
    prose = [(i, " ".join(["the", f"word{i}", "of", f"thing{i * 7}", "and"] + [f"plain{(i * 31 + j) % 97}abc" for j in range(60)]) + ".", "en") for i in range(40)]
    junk = [(100, " ".join(f"W{j}!!***{j}$$$" for j in range(60)), "en"), (101, "short", "en")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(40))
    assert not got[100].kept and not got[100].base_failed
    assert got[101].base_failed


def test_contaminated_pairs(spark, docs, rows):
    passage = [r[1] for r in rows if r[1] and len(words(r[1])) > 60][0]
    cut = " ".join(words(passage)[5:45])
    w = cut.upper().split(" ")
    w[20] = "changed"
    items = [(1, cut), (2, " ".join(w)), (3, "one two"), (4, None), (5, "  "), (6, "nothing of this is there at all in any text"), (7, cut)]
    shingle = lambda t: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if (x := words(lower_az(t))) else set()
    expected = set()
    for d, t, *_ in rows:
        for i, s in items:
            a, b = shingle(t), shingle(s)
            if b and 10 * len(a & b) >= 8 * len(b):
                expected.add((d, i, len(b), len(a & b)))
    got = decontaminate.contaminated_pairs(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == expected
    assert expected
    left = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, *_ in expected}
    assert left.count() == sum(r[0] not in bad for r in rows)


def test_contamination_by_shuffle_equals_broadcast(spark, docs, monkeypatch):
    items = docs.where("doc_id % 30 = 0").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 300).alias("text"))
    a = {tuple(r) for r in decontaminate.contaminated_pairs(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert a and a == {tuple(r) for r in decontaminate.contaminated_pairs(docs, items).collect()}


@pytest.mark.parametrize("n", [0, 1, 5, 333])
def test_sharding_sizes_and_slots(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "x").alias("text"))
    got = sharding.shuffle_into_shards(rows, part_rows=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_is_reproducible_and_seeded(spark):
    rows = spark.range(500).select("id", F.lit("own").alias("shard"))
    deal = lambda df, s: {r.id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, seed=s, part_rows=50).collect()}
    first = deal(rows, 1)
    assert first == deal(rows.repartition(7), 1)
    assert first != deal(rows, 2)
    # neighbours don't stay together
    assert len({first[i][0] for i in range(20)}) > 4


def test_sharding_is_uniform(spark):
    """Over many rows and a few seeds every row may come to any shard and any place in it, whatever its part."""
    rows = spark.range(4000).select("id")
    pairs = Counter()
    for seed in range(4):
        got = sharding.shuffle_into_shards(rows, shards=4, seed=seed, part_rows=500).collect()
        pairs += Counter((r.id // 1000, r.shard, r.slot // 250) for r in got)
    expected = 4 * 4000 / 64
    chi = sum((pairs[i, s, t] - expected) ** 2 / expected for i in range(4) for s in range(4) for t in range(4))
    assert chi < 110  # 63 degrees of freedom at most: beyond 110 in one case of 5,000


def test_communication_matrix_margins_and_law():
    parts, shards = [7, 0, 30, 13], [13, 13, 12, 12]
    seen = Counter()
    for seed in range(3000):
        m = sharding.communication_matrix(parts, shards, seed)
        assert [sum(r) for r in m] == parts and [sum(c) for c in zip(*m)] == shards
        seen[m[0][0]] += 1
    total = math.comb(50, 7)
    for k in range(4):
        p = math.comb(13, k) * math.comb(37, 7 - k) / total
        assert seen[k] / 3000 == pytest.approx(p, abs=4 * math.sqrt(p / 3000))
    assert sharding.hypergeometric(3 * 10**11, 7 * 10**11, 10**10, 0.5) == pytest.approx(3e9, rel=1e-4)


def test_url_filter(spark):
    entries = [("bad.com", "block", "2024-01-10"), ("bad.com", "remove", "2024-02-01"), ("ok.bad.com", "allow", "2024-01-05"), ("*.Org.example", "block", "2024-01-01"), ("same.net", "block", "2024-01-01"), ("same.net", "allow", "2024-01-01"), (None, "block", "2024-01-01"), ("x.com", None, None)]
    captures = [(1, "http://bad.com/a", "2024-01-09"), (2, "http://bad.com/a", "2024-01-10"), (3, "https://u@www.BAD.com:80/?q", "2024-01-31"), (4, "http://bad.com./", "2024-02-01"), (5, "http://ok.bad.com", "2024-01-20"), (6, "http://a.org.example#x", "2024-05-01"), (7, "http://same.net", "2024-01-01"), (8, None, "2024-01-01"), (9, "not a url", "2024-01-01"), (10, "http://bad.com", None), (2, "http://bad.com/a", "2024-01-10")]
    frame = spark.createDataFrame(captures, "id long, url string, fetched_on string").withColumn("rule", F.lit("own"))
    got = url_filter.filter_captures(frame, spark.createDataFrame(entries, "pattern string, action string, day string")).collect()
    assert len(got) == len(captures)
    found = {r.id: (r.kept, r.rule) for r in got}
    assert found == {1: (True, None), 2: (False, "bad.com"), 3: (False, "bad.com"), 4: (True, None), 5: (True, "ok.bad.com"), 6: (False, "org.example"), 7: (False, "same.net"), 8: (True, None), 9: (True, None), 10: (True, None)}


def test_url_filter_takes_addresses_as_a_whole(spark, monkeypatch):
    entries = spark.createDataFrame([("1", "block", "2024-01-01"), ("0.1", "block", "2024-01-01"), ("10.0.0.2", "block", "2024-01-01"), ("[::1]", "block", "2024-01-01")], "pattern string, action string, day string")
    captures = spark.createDataFrame([(1, "http://10.0.0.1/x", "2024-02-01"), (2, "http://10.0.0.2:80/", "2024-02-01"), (3, "http://[::1]:8080/", "2024-02-01"), (4, "http://[::2]/", "2024-02-01")], "id long, url string, fetched_on string")
    for rows in (10, 0):  # sent, and by a shuffle
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", rows)
        assert {r.id: r.kept for r in url_filter.filter_captures(captures, entries).collect()} == {1: True, 2: False, 3: False, 4: True}


def fill(sizes, weights):
    """Water filling step by step."""
    caps, total, closed = {s: 3 * n for s, n in sizes.items()}, sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in closed]
        level = (total - sum(caps[s] for s in closed)) / max(1, sum(weights[s] for s in open_))
        over = {s for s in open_ if level * weights[s] > caps[s]}
        if not over:
            return {s: caps[s] if s in closed else level * weights[s] for s in sizes}
        closed |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, "d": 5, "e": 300}, {"a": 0, "b": 10, "c": 1}, {"a": 0}, {"a": 7}])
def test_targets(spark, sizes):
    weights = {s: [1, 2, 3][i % 3] for i, s in enumerate(sorted(sizes))}
    df = spark.createDataFrame(list(sizes.items()), "source string, _size long")
    got = {r._src: r.target for r in mixing.targets(df, source_col="source").collect()}
    assert got == pytest.approx(fill(sizes, weights))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixing(docs, rows):
    got = mixing.assign(docs).select("_row.doc_id", "_row.source", "_size", "_source_size", "_target", "_copies").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = fill(sizes, {s: [1, 2, 3][i % 3] for i, s in enumerate(order)})
    for r in got:
        assert r._source_size == sizes[r.source] and r._target == pytest.approx(goal[r.source])
        rate = r._target / r._source_size
        assert math.floor(rate) <= r._copies <= math.floor(rate) + 1 and r._copies <= 3
    again = mixing.assign(docs.repartition(3)).select("_row.doc_id", "_copies").collect()
    assert Counter((r.doc_id, r._copies) for r in got) == Counter(tuple(r) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r._copies for r in got)


def test_mixing_comes_near_targets(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 20 + 1).cast("int")).alias("text"))
    per = mixing.assign(df).groupBy("_row.source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.first("_target").alias("target")).collect()
    assert all(r.taken == pytest.approx(r.target, rel=0.05) for r in per)


def test_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_rules(empty).count() == 0
    assert decontaminate.contaminated_pairs(empty, none).count() == 0
    assert decontaminate.contaminated_pairs(docs, none).count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert mixing.mix(empty).count() == 0
    captures = spark.createDataFrame([], "url string, fetched_on date")
    assert url_filter.filter_captures(captures, spark.createDataFrame([], "pattern string, action string, day date")).count() == 0


def test_clashing_columns(spark, clashing, docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    n = docs.count()
    assert quality_rules.quality_rules(clashing).count() == n
    assert decontaminate.decontaminate(clashing, items).columns == clashing.columns
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.where("_size <> 'own _size'").count() == 0
    dealt = sharding.shuffle_into_shards(clashing)
    assert dealt.count() == n and dealt.where("_row <> 'own _row'").count() == 0
    captures = clashing.withColumn("url", F.lit("http://a.b")).withColumn("fetched_on", F.lit("2024-01-01"))
    assert url_filter.filter_captures(captures, spark.createDataFrame([], "pattern string, action string, day date")).count() == n


def test_contract_columns_of_sharding(spark, tmp_path, docs, rows):
    from tessera.llm.queries import op5_sharding

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_sharding(spark, str(tmp_path)).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
