"""Line deduplication by an exact set-similarity join.

A line is its set of words. Words are ordered by rarity over all lines; two lines whose Jaccard similarity reaches the
threshold share a word within their prefixes (prefix filter), their sizes are in proportion (length filter), and the place of
the shared word in both leaves enough words for the overlap (positional filter). A parity bitmap of each set bounds in how
many words two differ, which rules out nearly all other pairs. What passes is verified on the whole sets. Every line that has
a similar earlier one (smaller document id, or the same document further up) is a later match and goes; lines are judged on
the input, not on what is left.

Lines with equal sets are one set, known by its size and 192 bits of its words; all but the earliest go at once. For a removal
one earlier partner is enough, so at each prefix word a set takes down the earlier sets that look closest, CLOSEST at most, and
the pairs of a large group are never rows. It is verified with the closest one first, with the others only if that fails. A set
that none of them verifies and that had more to choose from at a word meets all sets of that word, in blocks that hold the whole
sets and tell only who has a partner. Words that occur once are in no posting. A word with more postings than BLOCK_SETS is cut into blocks, of which each two meet in one job.

Defined results: lines are separated by \\n; lines without words are never matched nor removed. Null and empty texts
have no lines. Rows with equal ids are one document, whose lines match across the rows by number. Rows with a null id are
returned without removals. Ids are cast to long; one that is no number fails under ANSI rules and counts as null without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _setjoin
from tessera.llm._common import Scratch, packs, small_batches
from tessera.llm._words import gathered, hashes_and_starts, signed

#: Keys of lines that a task remembers so as not to send equal ones twice.
SEEN = 200_000
#: Sets of a block at a word: larger groups are cut up.
BLOCK_SETS = 1024
#: Earlier sets that a set takes down at a word; with more, all are compared if none of these is similar.
CLOSEST = 8
#: Pairs that a task holds before it leaves the farther ones out.
HELD = 1 << 20
#: Sets, and words of them, of a block where whole sets meet (about; sets are dealt by hash).
WHOLE_SETS = 1024
WHOLE_WORDS = 1 << 19
#: Rows of a table of words or document ids that is sent to every executor; a larger one is joined by a shuffle, or not used.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow table that sift() works on, at least.
_PACK = 1 << 14


def lines_of(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (text number of each line, line number in its text, word hashes, line of each word)."""
    for first, held in gathered(texts):
        data = b"\n".join(held)
        hashes, start = hashes_and_starts(data)
        line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), start)
        count = np.array([x.count(b"\n") + 1 for x in held])
        text = np.repeat(np.arange(len(held)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        yield first + text, number, hashes, line


def bitmaps(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 parities for each set: the bits in which two sets differ are at most the tokens in which they do."""
    bit = np.uint64(1) << (tokens & np.uint64(63))
    upper = (tokens >> np.uint64(6) & np.uint64(1)).astype(bool)
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    if len(some):
        for i, own in enumerate((~upper, upper)):
            out[i, some] = np.bitwise_xor.reduceat(np.where(own, bit, np.uint64(0)), offsets[some])
    return out[0], out[1]


def _closest(x: np.ndarray, y: np.ndarray, key: np.ndarray, closest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of the smallest keys of each x, `closest` at most, sorted, and the place of each pair from 0."""
    order = np.lexsort((key, x))
    x, y, key = x[order], y[order], key[order]
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    place = np.arange(len(x)) - np.repeat(edge, np.diff(np.append(edge, len(x))))
    near = place < closest
    return x[near], y[near], key[near], place[near]


def _passing(n, pos, b0, b1, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of rows (a, b) pass the filters by length, position and bitmap, and in how many bits they differ."""
    both = n[a] + n[b]
    least = -(-both * percent // (100 + percent))
    ok = np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least
    ok &= np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
    differ = np.zeros(len(a), np.int64)
    x, y = a[ok], b[ok]
    differ[ok] = np.bitwise_count(b0[x] ^ b0[y]).astype(np.int64) + np.bitwise_count(b1[x] ^ b1[y])
    return ok & (differ <= both - 2 * least), differ


def _columns(pack: pa.Table, order: np.ndarray):
    d, l, b0, b1, np_ = (pack.column(c).to_numpy()[order] for c in ("d", "l", "b0", "b1", "np"))
    # bitwise_count takes the absolute value of signed numbers
    return d, l, b0.view(np.uint64), b1.view(np.uint64), np_ >> 32, np_ & 0xFFFFFFFF


def _nearest(pack: pa.Table, percent: int, cutup: bool, closest: int, most: int) -> pa.RecordBatch | None:
    """Pairs (later set, earlier set) of a pack of whole groups: of each later set at a word the ones that look closest, their
    place by that, and with the first of them the word if there are more."""
    g = pack.column("g").to_numpy()
    order = np.lexsort((pack.column("np").to_numpy(), g))
    g = g[order]
    d, l, b0, b1, n, pos = _columns(pack, order)
    token = pack.column("token").to_numpy()[order] if cutup else g
    if cutup:
        side, own = pack.column("side").to_numpy()[order], pack.column("own").to_numpy()[order]
    count = len(g)
    rank = np.empty(count, np.int64)
    rank[np.lexsort((l, d))] = np.arange(count)
    passed = np.zeros(count, np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    live, step = np.arange(count), 1
    while len(live):
        live = live[live + step < count]
        live = live[(g[live] == g[live + step]) & (n[live] * 100 >= n[live + step] * percent)]  # sorted by n within g
        a, b = live, live + step
        ok, differ = _passing(n, pos, b0, b1, a, b, percent)
        ok &= (d[a] != d[b]) | (l[a] != l[b])
        if cutup:
            ok &= own[a] | (side[a] != side[b])
        a, b, differ = a[ok], b[ok], differ[ok]
        if len(a):
            later = rank[b] > rank[a]
            x, y = np.where(later, b, a), np.where(later, a, b)
            np.add.at(passed, x, 1)
            held.append((x, y, differ << 40 | rank[y]))
            size += len(x)
            if size > most:
                held = [_closest(*(np.concatenate(v) for v in zip(*held, strict=True)), closest)[:3]]
                size = len(held[0][0])
        step += 1
    if not held:
        return None
    x, y, _, place = _closest(*(np.concatenate(v) for v in zip(*held, strict=True)), closest)
    more = passed[x] > closest
    return pa.RecordBatch.from_arrays([pa.array(d[x]), pa.array(l[x], pa.int32()), pa.array(d[y]), pa.array(l[y], pa.int32()), pa.array(place, pa.int32()), pa.array(token[x], pa.int64(), mask=~more | (place > 0))], names=["d", "l", "d2", "l2", "place", "more"])


def _matched(pack: pa.Table, percent: int) -> pa.RecordBatch | None:
    """The asking sets (d, l) of whole jobs that have an earlier similar set there, verified on the whole sets."""
    job, asks = pack.column("job").to_numpy(), pack.column("asks").to_numpy()
    d, l, b0, b1, n, pos = _columns(pack, np.arange(len(job)))
    lists = pack.column("tokens").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets, tokens = lists.offsets.to_numpy(), lists.values.to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], job[1:] != job[:-1], [True])))
    found = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rows = np.arange(lo, hi)
        asking, others = rows[asks[lo:hi]], rows[~asks[lo:hi]]
        for x in asking.tolist():
            y = others[(d[others] < d[x]) | ((d[others] == d[x]) & (l[others] < l[x]))]
            ok, differ = _passing(n, pos, b0, b1, np.full(len(y), x), y, percent)
            y = y[ok][np.argsort(differ[ok], kind="stable")]
            own = np.sort(tokens[offsets[x] : offsets[x + 1]])
            for i in y.tolist():
                other = tokens[offsets[i] : offsets[i + 1]]
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int(np.count_nonzero(own[place] == other))
                if both * 100 >= (len(own) + len(other) - both) * percent:
                    found.append(x)
                    break
    if not found:
        return None
    return pa.RecordBatch.from_arrays([pa.array(d[found]), pa.array(l[found], pa.int32())], names=["d", "l"])


_PAIR = "d long, l int, d2 long, l2 int, place int, more long"


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, closest: int = CLOSEST, block_sets: int = BLOCK_SETS, whole_sets: int = WHOLE_SETS, held: int = HELD) -> DataFrame:
    """Rows (id, removed_lines): the numbers from 0, ascending, of the lines that have a similar earlier line."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).where("d is not null")

    def tokens(columns: list) -> Iterator[np.ndarray]:
        for _, held in gathered(columns[0]):
            yield hashes_and_starts(b"\n".join(held))[0]

    sent = spark.sparkContext.broadcast(_setjoin.rarity(texts, ["t"], tokens, floor=False))  # a byte for each bucket
    hot_level = int(4 * np.log2(block_sets))
    lengths = np.array([0, *(_setjoin.prefix_length(n, percent, 1) for n in range(1, 4096))])

    def prefix_of(n: np.ndarray) -> np.ndarray:
        if n.max(initial=0) < len(lengths):
            return lengths[n]
        return np.array([_setjoin.prefix_length(int(x), percent, 1) if x else 0 for x in n])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for text, number, hashes, line in lines_of(batch.column("t").to_pylist()):
                flat, offsets = _setjoin.ordered_sets(hashes, line, len(text), sent.value)
                n = np.diff(offsets)
                some = np.flatnonzero(n > 0)
                if not len(some):
                    continue
                k = _setjoin.set_keys(flat, offsets)[0]
                b0, b1 = bitmaps(flat, offsets)
                level = sent.value.of(flat)
                # tokens that occur once come first; they meet nothing
                once = np.concatenate(([0], np.cumsum(level == 0)))
                once = once[offsets[1:]] - once[offsets[:-1]]
                p = prefix_of(n)
                place = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
                head = (place < np.repeat(p, n)) & (level > 0)
                heads = np.concatenate(([0], np.cumsum(head)))
                hot = np.concatenate(([0], np.cumsum(head & (level >= hot_level))))
                cool = (heads - hot)[offsets[1:]] - (heads - hot)[offsets[:-1]]
                d, l = ids[text], number
                # a line whose equal the task has had further up is a later match; what may be the first goes on
                final = np.zeros(len(n), bool)
                if len(seen) > SEEN:
                    seen = {}
                for i, key, x, y in zip(some.tolist(), k[some].tolist(), d[some].tolist(), l[some].tolist(), strict=True):
                    at = seen.get(key)
                    if at is not None and at < (x, y):
                        final[i] = True
                    elif at != (x, y):
                        seen[key] = (x, y)
                kept = head & ~np.repeat(final, n)
                ends = np.concatenate(([0], np.cumsum(kept)))[offsets[np.append(some, len(n))]]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat[kept]), pa.int64()))
                size = np.where(final, 0, n)[some]
                own = np.where(final, k ^ (d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), k)[some]  # finished rows are dealt evenly
                yield pa.RecordBatch.from_arrays([pa.array(signed(own)), pa.array(size, pa.int32()), pa.array(signed(b0[some])), pa.array(signed(b1[some])), pa.array(d[some]), pa.array(l[some], pa.int32()), pa.array(once[some], pa.int32()), pa.array(cool[some], pa.int32()), lists], names=["k", "n", "b0", "b1", "d", "l", "skip", "cool", "head"])

    def first_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            k, n, b0, b1 = (batch.column(c).to_numpy() for c in ("k", "n", "b0", "b1"))
            later = np.zeros(len(k), bool)
            later[1:] = (k[1:] == k[:-1]) & (n[1:] == n[:-1]) & (b0[1:] == b0[:-1]) & (b1[1:] == b1[:-1])
            d, l = batch.column("d").to_numpy(), batch.column("l").to_numpy()
            if len(k):
                later[0] = last is not None and last[:4] == (k[0], n[0], b0[0], b1[0])
                # a repeated row is the same line and no match
                same = np.zeros(len(k), bool)
                same[1:] = later[1:] & (d[1:] == d[:-1]) & (l[1:] == l[:-1])
                same[0] = later[0] and last[4:] == (d[0], l[0])
                last = (k[-1], n[-1], b0[-1], b1[-1], d[-1], l[-1])
                gone = (n == 0) | (later & ~same)
                keep = pa.array(~same | (n == 0))
                out = batch.set_column(1, "n", pa.array(np.where(gone, 0, n), pa.int32()))
                yield out.filter(keep)

    shape = "k long, n int, b0 long, b1 long, d long, l int, skip int, cool int, head array<long>"
    dealt = texts.mapInArrow(cut, shape).repartition("k").sortWithinPartitions("k", "n", "b0", "b1", "d", "l")
    sets = scratch.write(dealt.mapInArrow(first_of_equal, shape).drop("k"))
    first = sets.where("n > 0 and size(head) > 0")
    posting = first.select("d", "l", "n", "b0", "b1", "skip", "cool", F.posexplode("head").alias("i", "token"))
    place = (F.col("n").cast("long") * F.lit(1 << 32) + F.col("skip") + F.col("i")).alias("np")
    posting = posting.select("token", "d", "l", place, "b0", "b1", (F.col("i") >= F.col("cool")).alias("hot"))
    # words that may have more postings than a block are counted
    counts = first.select(F.explode(F.expr("slice(head, cool + 1, size(head))")).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    large = scratch.write(counts.where(F.col("c") > block_sets).select("token", F.ceil(F.col("c") / block_sets).cast("int").alias("blocks")))
    n_large = large.count()
    sizes = F.broadcast(large) if n_large <= BROADCAST_ROWS else large

    names = ["d", "l", "np", "b0", "b1"]

    def sifted(rows: DataFrame, cutup: bool) -> DataFrame:
        def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pack in packs(batches, "g", _PACK):
                found = _nearest(pack, percent, cutup, closest, held)
                if found is not None:
                    yield found

        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(sift, _PAIR)  # one key of numbers: a radix sort

    single = posting
    if n_large:
        single = posting.where("not hot").unionByName(posting.where("hot").join(sizes, "token", "left_anti").select(*posting.columns))
    found = sifted(single.select(F.col("token").alias("g"), *names), False)
    if n_large:
        block = F.pmod(F.xxhash64("d", "l", F.lit(3)), F.col("blocks")).cast("int")
        cutup = posting.where("hot").join(sizes, "token").withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        job = F.xxhash64("token", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("g")
        found = found.union(sifted(cutup.select(job, "token", *names, (F.col("_b") > F.col("_o")).cast("int").alias("side"), (F.col("_b") == F.col("_o")).alias("own")), True))
    near = scratch.write(found.groupBy("d", "l", "d2", "l2").agg(F.min("place").alias("place"), F.collect_set("more").alias("more")))

    def whole(asked: DataFrame) -> DataFrame:
        """Rows (d, l, tokens) of the lines asked for, at least: their sets, from the texts."""
        bitmap = spark.sparkContext.broadcast(_setjoin.marked(asked, ["d", "l"]))
        owners = scratch.write(asked.select("d").distinct())
        some = texts.join(F.broadcast(owners), "d", "left_semi") if owners.count() <= BROADCAST_ROWS else texts

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, lines, held = [], [], []
                own = batch.column("d").to_numpy()
                for d, t in zip(own.tolist(), batch.column("t"), strict=True):
                    t = (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
                    hit = np.flatnonzero(_setjoin.is_marked(bitmap.value, np.full(len(t), d), np.arange(len(t))))
                    ids += [d] * len(hit)
                    lines += hit.tolist()
                    held += [t[i].decode("utf-8", "surrogatepass") for i in hit.tolist()]
                at = 0
                for text, _, hashes, line in lines_of(held):
                    key = np.argsort(hashes)
                    hashes, line = hashes[key], line[key]
                    key = np.argsort(line, kind="stable")
                    hashes, line = hashes[key], line[key]
                    new = np.ones(len(hashes), bool)
                    new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
                    size = np.bincount(line[new], minlength=len(text))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(signed(hashes[new]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(text)], pa.int64()), pa.array(lines[at : at + len(text)], pa.int32()), lists], names=["d", "l", "tokens"])
                    at += len(text)

        out = scratch.write(some.mapInArrow(read, "d long, l int, tokens array<long>").where("size(tokens) > 0").distinct())
        bitmap.destroy()
        scratch.drop(owners)
        return out

    def verified(asked: DataFrame, lines: DataFrame) -> DataFrame:
        """The pairs with ok: whether the whole sets, among lines, are similar."""
        other = lines.select(F.col("d").alias("d2"), F.col("l").alias("l2"), F.col("tokens").alias("tokens2"))
        joined = asked.join(lines, ["d", "l"]).join(other, ["d2", "l2"])
        both = F.size(F.array_intersect("tokens", "tokens2"))
        return joined.select("d", "l", (both * 100 >= (F.size("tokens") + F.size("tokens2") - both) * percent).alias("ok"))

    ends = lambda df: df.select("d", "l").union(df.select("d2", "l2")).distinct()
    lines = whole(ends(near))
    judged = scratch.write(verified(near.where("place = 0"), lines).groupBy("d", "l").agg(F.max("ok").alias("ok")))
    late = judged.where("ok").select("d", "l")
    asked = near.where("place > 0").join(judged.where("not ok"), ["d", "l"], "left_semi")
    second = scratch.write(verified(asked, lines).groupBy("d", "l").agg(F.max("ok").alias("ok")))
    late = late.union(second.where("ok").select("d", "l"))
    rest = scratch.write(near.select("d", "l", F.explode("more").alias("token")).distinct().join(late, ["d", "l"], "left_anti"))
    scratch.drop(near, lines)
    n_rest = rest.count()
    if n_rest:
        words = rest.groupBy("token").agg(F.count("*").alias("asking"))
        met = scratch.write(posting.join(F.broadcast(words) if n_rest <= BROADCAST_ROWS else words, "token").select("token", "asking", *names))
        full = whole(met.select("d", "l").distinct())
        # at each word the asking sets in blocks, and all its sets in blocks: each two meet in a job
        size = F.sum(F.shiftright("np", 32))
        in_blocks = lambda n: F.greatest(F.ceil(n / whole_sets), F.ceil(size * n / F.count("*") / WHOLE_WORDS)).cast("int")
        blocks = met.groupBy("token").agg(in_blocks(F.count("*")).alias("_all"), in_blocks(F.max("asking")).alias("_asked"))
        rows = met.drop("asking").join(blocks, "token")
        deal = lambda by: F.pmod(F.xxhash64("d", "l", F.lit(5)), F.col(by)).cast("int")
        every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
        members = rows.withColumn("_y", deal("_all")).withColumn("_x", every("_asked")).withColumn("asks", F.lit(False))
        asking = rows.join(rest, ["token", "d", "l"], "left_semi").withColumn("_x", deal("_asked")).withColumn("_y", every("_all")).withColumn("asks", F.lit(True))
        job = F.xxhash64("token", "_x", "_y").alias("job")
        dealt = members.unionByName(asking).select(job, *names, "asks").join(full, ["d", "l"]).repartition("job").sortWithinPartitions("job")

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pack in packs(batches, "job", 2 * whole_sets):
                out = _matched(pack, percent)
                if out is not None:
                    yield out

        late = late.union(dealt.mapInArrow(match, "d long, l int").distinct())
    gone = late.union(sets.where("n = 0").select("d", "l"))
    out = scratch.write(gone.groupBy("d").agg(F.array_sort(F.collect_set("l")).alias("removed_lines")))  # of one document
    scratch.drop(sets, large, judged, second)
    sent.destroy()
    return out.withColumnRenamed("d", id_col)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the later matches taken out of the text; the other lines stay as they are, in order."""
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, **options).toDF("_gone", "_lines")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.array_contains(gone["_lines"], i)), "\n")
    joined = docs.join(gone, docs[id_col] == gone["_gone"], "left")
    return joined.select(*[F.when(gone["_lines"].isNull(), docs[c]).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns])
