"""N-gram join, line dedup and substring dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import lower_az, words
from tessera.llm import _setjoin, _words, line_dedup, ngram_join, substring_dedup
from tessera.llm._common import Scratch, connected


def shingles(text, k):
    w = words(lower_az(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    sets = {d: shingles(t, k) for d, t, *_ in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * (both := len(x & y)) >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(docs, rows, k, percent):
    got = ngram_join.classes(docs, shingle_words=k, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == components(rows, k, percent)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_ngram_join_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(_setjoin, "BLOCK_SETS", 3)
    monkeypatch.setattr(_setjoin, "SIFTED", 2)
    got = ngram_join.classes(docs, shingle_words=3, percent=60).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {d: c for d, (_, c) in components(rows, 3, 60).items()}


def test_one_of_each(docs, rows):
    kept = ngram_join.one_of_each(docs, shingle_words=5, percent=80)
    expected = sorted(d for d, (_, c) in components(rows, 5, 80).items() if c == d)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected
    assert kept.where("doc_id is null").count() == 2


def test_matches_needed():
    assert ngram_join.matches_needed(np.zeros(60), 500, 90) == 1
    assert ngram_join.matches_needed(np.full(60, 1000.0), 500, 90) > 1
    assert ngram_join.matches_needed(np.full(4, 1000.0), 1, 90) == 1


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_prefix_length_loses_no_pair(percent):
    for n in range(1, 60):
        p = _setjoin.prefix_length(n, percent, 1)
        partners = [m for m in range(n, 200) if 100 * n >= percent * m]
        if p == 0:
            assert partners == [n] and _setjoin.needed(n, percent) == n
        else:
            assert n - p < _setjoin.needed(n, percent)


def test_connected(spark):
    chain = [(i, i + 1) for i in range(0, 50)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200), (301, 300), (301, 300)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 300, 301: 300}
    assert connected(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def later_matches(rows, percent):
    lines = []
    for d, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: (x[0], x[1] or "")):
        lines += [(d, i, frozenset(words(x))) for i, x in enumerate((t or "").split("\n")) if words(x)]
    out = defaultdict(list)
    for i, (d, l, s) in enumerate(lines):
        if any(100 * (both := len(s & o)) >= percent * (len(s) + len(o) - both) for _, _, o in lines[:i]):
            out[d].append(l)
    return dict(out)


@pytest.mark.parametrize("percent", [80, 50])
def test_line_dedup(docs, rows, percent):
    got = {r.doc_id: r.removed_lines for r in line_dedup.removed_lines(docs, percent=percent).collect()}
    assert got == later_matches(rows, percent)


def test_line_dedup_in_small_blocks(docs, rows):
    got = {r.doc_id: r.removed_lines for r in line_dedup.removed_lines(docs, percent=60, block_sets=3).collect()}
    assert got == later_matches(rows, 60)


@pytest.mark.parametrize(("block", "closest"), [(3, 1), (1024, 1), (1024, 8)])
def test_line_dedup_when_the_closest_is_not_similar(spark, monkeypatch, block, closest):
    """Lines around the threshold whose bitmaps say nothing: most first partners fail, and all the others must be tried."""
    monkeypatch.setattr(line_dedup, "bitmaps", lambda tokens, offsets: (np.zeros(len(offsets) - 1, np.uint64), tokens[offsets[:-1]] * np.uint64(0)))
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(13)]
    near = [" ".join([*rng.choice(base, 9, replace=False), "v"]) for _ in range(120)]
    rows = [(i // 3, None, None) for i in range(0, 120, 3)]
    rows = [(d, "\n".join(near[3 * d : 3 * d + 3])) for d, *_ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.removed_lines for r in line_dedup.removed_lines(docs, percent=80, closest=closest, block_sets=block, whole_sets=20, held=50).collect()}
    assert got == later_matches(rows, 80)
    assert 0 < sum(map(len, got.values())) < 120


def test_word_hashes():
    rng = np.random.default_rng(5)
    kinds = ["".join(rng.choice(list("abé"), n)) for n in [*range(1, 40), 63, 64, 65, 255, 256, 257, 300, 5000]]
    together = _words.word_hashes(" ".join(kinds).encode())
    assert together.tolist() == [int(_words.word_hashes(("\t " + x).encode())[0]) for x in kinds]
    assert len(set(together.tolist())) == len(set(kinds))
    places = np.arange(len(together) - 4)
    assert (_words.run_hashes(together, places, 5) == _words.run_hashes(together, places, np.full(len(places), 5))).all()


@pytest.mark.parametrize("n", [64, 1024, 2048, 8192])
def test_thue_morse_words_and_runs_differ(n):
    """The sequence whose two forms collide in any polynomial modulo 2**64 from 1,024 on."""
    x = "".join("ab"[i.bit_count() & 1] for i in range(n))
    y = x.translate(str.maketrans("ab", "ba"))
    assert _words.word_hashes(x.encode()) != _words.word_hashes(y.encode())
    a, b = (_words.word_hashes(" ".join(z).encode()) for z in (x, y))
    start, size = np.zeros(1, np.int64), np.array([n])
    assert _words.run_hashes(a, start, size) != _words.run_hashes(b, start, size)


def test_dedup_lines_keeps_the_rest(clashing, docs, rows):
    gone = later_matches(rows, 80)
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == clashing.columns
    keep = lambda d, t: t if d not in gone or t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r[0], keep(r[0], r[1])) for r in rows)


def expected_kept(rows, width):
    seen, out = set(), {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: (x[0], x[1] or "")):
        w, gone = words(t), set()
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone |= set(range(i, i + width))
            seen.add(window)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"width": 8, "anchor": 3}, {"shard_words": 40}, {"width": 20, "anchor": 1}, {"block_words": 60}, {"block_words": 60, "shard_words": 40, "width": 6, "anchor": 2}])
def test_substring_dedup(docs, rows, options):
    got = substring_dedup.dedup(docs, **options).collect()
    assert len(got) == len(rows)
    expected = expected_kept(rows, options.get("width", 20))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in got if r.doc_id is not None} == expected
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_intervals_cover_what_goes(docs, rows):
    gone = defaultdict(set)
    for r in substring_dedup.intervals(docs, width=8, anchor=3).collect():
        assert r.length >= 8
        gone[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert {d: len(x) for d, x in gone.items()} == {d: n for d, (_, n, *_) in expected_kept(rows, 8).items() if n}


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    lengths = np.array([30, 50, 12, 40])
    hashes = rng.integers(1, 4, lengths.sum()).astype(np.uint64)
    index = substring_dedup.FmIndex(hashes, lengths, 5)
    parts = np.split(hashes, np.cumsum(lengths)[:-1])
    seen, expected = set(), []
    for p in parts:
        for i in range(len(p) + 1):
            window = tuple(p[i : i + 5].tolist())
            expected.append(len(window) == 5 and window in seen)
            if len(window) == 5:
                seen.add(window)
    assert index.earlier().tolist() == expected


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 37, 1000)
    w = substring_dedup.Wavelet(symbols, 6)
    ask, low, high = rng.integers(0, 37, 200), rng.integers(0, 500, 200), rng.integers(500, 1001, 200)
    a, b = w.narrow(ask, low, high)
    assert a.tolist() == [int((symbols[:i] == c).sum()) for c, i in zip(ask, low)]
    assert b.tolist() == [int((symbols[:i] == c).sum()) for c, i in zip(ask, high)]


def test_empty_and_clashing(empty, clashing, docs):
    assert ngram_join.classes(empty).count() == 0
    assert line_dedup.removed_lines(empty).count() == 0
    assert substring_dedup.dedup(empty).count() == 0
    n = docs.count()
    assert ngram_join.classes(clashing).count() == n
    assert substring_dedup.dedup(clashing).count() == n
    assert ngram_join.one_of_each(clashing).columns == clashing.columns


def test_partitioning_does_not_matter(docs):
    a = sorted(tuple(r) for r in substring_dedup.dedup(docs.where("doc_id is not null")).drop("kept").collect())
    b = sorted(tuple(r) for r in substring_dedup.dedup(docs.where("doc_id is not null").repartition(11)).drop("kept").collect())
    assert a == b
    c = sorted(tuple(r) for r in ngram_join.classes(docs.where(F.col("doc_id").isNotNull()).repartition(2)).collect())
    assert c == sorted(tuple(r) for r in ngram_join.classes(docs.where("doc_id is not null")).collect())
