"""Substring deduplication: compressed FM-indexes answer where a passage occurs earlier.

A window is `width` consecutive words of a document. A word goes if a window covers it whose words also start earlier (in
a smaller document id, or further up in the same document).

One index of the whole corpus would not fit a machine, and streaming every document past every shard of one would cost
the square of the corpus. So shards are made by content. Each window has a minimizer, the smallest hash of its runs of
`anchor` words; equal windows have equal minimizers. Consecutive windows with one minimizer are a segment, and a segment
meets only those of its minimizer. First, equal segments are found by their hashes: all but the earliest go at once, in
the batch where they meet or after the shuffle, so groups of exact copies leave one row. What is left and shares its
minimizer with a different segment (or repeats within itself) is read again and dealt to shards.

For each shard an FM-index is built: the suffixes ordered by `width` words, their Burrows-Wheeler transform in a wavelet
matrix of packed bits with block counts, and sampled nothing else. All segments are streamed through it by backward
search, in step: a match grows by one word to the left, and once it has `width` words its interval is widened to that of
the first width - 1 words before it grows again, which keeps the matching statistics capped at the threshold. The
interval of a full match holds all its occurrences, in the order of the text, so the first tells whether it is earlier. The
segments of a minimizer with more than BLOCK_WORDS words are cut into blocks, and each two blocks meet in a shard of their own, so
no task holds more than two blocks beyond a shard, whatever a passage's frequency.

Words are compared by 64-bit hashes within a shard. Defined results: a null text has no words, shorter texts than a
window lose nothing, rows with equal ids must have equal texts and lose the same words, rows with a null id lose nothing.
Ids are cast to long; one that is no number fails under ANSI rules and counts as null without.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, small_batches
from tessera.llm._words import chunks, run_hashes, signed, word_hashes

WIDTH = 20
ANCHOR = 6
#: Words of a shard.
SHARD_WORDS = 1 << 19
#: Words of a block of a hot minimizer's segments (about; segments are dealt by hash).
BLOCK_WORDS = 1 << 17
#: Rows of the table of hot minimizers that is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_PLAIN, _COPY, _REPEATS = 0, 1, 2


def segments(hashes: np.ndarray, offsets: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR):
    """(text, first window, windows, minimizer, hash of the words, repeats) of the segments of several texts."""
    span = width - anchor + 1
    if len(hashes) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    grams = run_hashes(hashes, np.arange(len(hashes) - anchor + 1), anchor)
    least, have = grams, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)[: len(least)]
    valid = np.arange(len(least)) + width <= offsets[1:][text]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(begin)
    stop = np.flatnonzero(valid & np.append(~valid[1:] | begin[1:], True)) + 1
    count = stop - first
    minimizer = least[first]
    # a window can only repeat within its segment if the minimizer is there twice
    covered = count + span - 1
    at = np.repeat(first - (np.cumsum(covered) - covered), covered) + np.arange(covered.sum())
    hit = grams[at] == np.repeat(minimizer, covered)
    repeats = np.add.reduceat(hit, np.cumsum(covered) - covered) > 1 if len(first) else np.zeros(0, bool)
    return text[first], first - offsets[:-1][text[first]], count, minimizer, run_hashes(hashes, first, count + width - 1), repeats


class Wavelet:
    """Rank of symbols over a sequence: packed bits with a count for every 64, one row of bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n, self.levels = len(symbols), []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            blocks = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]))
            self.levels.append((shift, blocks, before.astype(np.int32), int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def narrow(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each symbol before low and before high (as places within the symbol's own run)."""
        start = np.zeros(len(symbol), np.int64)
        place = np.stack((start, low, high))
        for shift, blocks, before, zeros in self.levels:
            block = place >> 6
            mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(blocks[block] & mask)
            place = np.where((symbol >> shift & 1).astype(bool), zeros + ones, place - ones)
        return place[1] - place[0], place[2] - place[0]


class FmIndex:
    """FM-index of segments of words, for matches of up to `width` words."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, width: int) -> None:
        self.width = width
        self.words, inverse = np.unique(hashes, return_inverse=True)
        end = np.cumsum(lengths)
        gap = np.repeat(np.arange(len(lengths)), lengths)
        self.text = np.zeros(len(hashes) + len(lengths), np.int64)  # 0 ends each segment
        self.text[np.arange(len(hashes)) + gap] = inverse + 1
        self.end = end + np.arange(len(lengths))
        n = len(self.text)
        depth, rank = 1, self.text
        ranks = {}
        while depth * 2 <= width - 1:
            rank = self._joined(rank, depth)
            depth *= 2
        shorter = self._joined(rank, width - 1 - depth) if depth < width - 1 else rank
        full = self._joined(rank, width - depth)
        del ranks
        self.order = np.argsort(full, kind="stable").astype(np.int32)
        group = shorter[self.order]
        edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(edge, n))
        self.wide_low = np.repeat(edge, size).astype(np.int32)
        self.wide_high = np.repeat(edge + size, size).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=len(self.words) + 1))))
        self.wavelet = Wavelet(self.text[self.order - 1], max(1, int(len(self.words)).bit_length()))

    def _joined(self, rank: np.ndarray, by: int) -> np.ndarray:
        """Ranks of twice the depth (or less, if by is less): of each place and the one `by` further."""
        after = np.zeros_like(rank)
        if by:
            after[:-by] = rank[by:]
        return np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.wavelet.narrow(symbol, low, high)
        return self.before[symbol] + a, self.before[symbol] + b

    def earlier(self) -> np.ndarray:
        """For each place of the text: does a full match begin there whose words begin earlier too?"""
        out = np.zeros(len(self.text), bool)
        start = np.concatenate(([0], self.end[:-1] + 1))
        live = np.arange(len(self.end))
        at = self.end.copy()
        low, high, size = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64), np.zeros(len(live), np.int64)
        while len(live):
            at = at - 1
            go = at >= start[live]
            live, at, low, high, size = live[go], at[go], low[go], high[go], size[go]
            if not len(live):
                break
            full = size == self.width
            low, high = np.where(full, self.wide_low[low], low), np.where(full, self.wide_high[low], high)
            low, high = self.step(self.text[at], low, high)
            size = np.minimum(size + 1, self.width)
            done = size == self.width
            out[at[done]] = self.order[low[done]] < at[done]
        return out


def _packed(start: np.ndarray, count: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (count.astype(np.int64) << 2) | kind


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, s, d, at) in this order become removals (m null) and, with their m, segments that an index must judge."""
    waiting = None  # the last first-of-its-kind segment: m, s, d, at, whether the one before has the same m

    def send(m, d, at):
        return pa.RecordBatch.from_arrays([m, pa.array(d), pa.array(at)], names=["m", "d", "at"])

    for batch in batches:
        m, s, d, at = (batch.column(i).to_numpy() for i in range(4))
        copy = at & 3 == _COPY
        if copy.any():
            yield send(pa.nulls(int(copy.sum()), pa.int64()), d[copy], at[copy])
            m, s, d, at = m[~copy], s[~copy], d[~copy], at[~copy]
        if not len(m):
            continue
        joined = waiting is not None
        if joined:
            m, s, d, at = (np.concatenate(([w], x)) for w, x in zip(waiting[:4], (m, s, d, at), strict=True))
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        lead = first[np.cumsum(new) - 1]
        later = ~new & ((d != d[lead]) | (at >> 32 != at[lead] >> 32))
        if later.any():
            yield send(pa.nulls(int(later.sum()), pa.int64()), d[later], at[later])
        same = m[first][1:] == m[first][:-1]
        multi = np.concatenate(([waiting[4] if joined else False], same)) | np.concatenate((same, [False]))
        judged = first[:-1][multi[:-1] | (at[first[:-1]] & 3 == _REPEATS)]
        if len(judged):
            yield send(pa.array(m[judged]), d[judged], at[judged])
        last = first[-1]
        waiting = (m[last], s[last], d[last], at[last], bool(multi[-1]))
    if waiting is not None and (waiting[4] or waiting[3] & 3 == _REPEATS):
        yield send(pa.array([waiting[0]], pa.int64()), [waiting[2]], [waiting[3]])


class _Shard:
    """Segments of a task gathered for one index."""

    def __init__(self) -> None:
        self.m, self.d, self.start, self.parts, self.words = [], [], [], [], 0

    def add(self, m: int, d: int, start: int, words: bytes, count: int) -> None:
        self.m.append(m)
        self.d.append(d)
        self.start.append(start)
        self.parts.append((words, count))
        self.words += count

    def judge(self, width: int) -> pa.RecordBatch:
        """The removals of the shard's segments by its index."""
        hashes = word_hashes(b" ".join(p[0] for p in self.parts))
        lengths = np.array([p[1] for p in self.parts])
        index = FmIndex(hashes, lengths, width)
        gap = np.repeat(np.arange(len(lengths)), lengths)
        gone = index.earlier()[np.arange(len(hashes)) + gap]
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        new = np.flatnonzero(np.concatenate(([True], gap[1:] != gap[:-1])) & gone) if len(gap) else np.zeros(0, np.int64)
        begin = np.union1d(np.flatnonzero(edge == 1), new)
        stop = np.append(begin[1:], len(gone)) if len(begin) else begin
        total = np.concatenate(([0], np.cumsum(gone)))
        count = total[stop] - total[begin]
        owner = gap[begin] if len(begin) else np.zeros(0, np.int64)
        start = np.array(self.start, np.int64)[owner] + place[begin] if len(begin) else np.zeros(0, np.int64)
        d = np.array(self.d, np.int64)[owner]
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(_packed(start, count, _COPY))], names=["d", "at"])


def removed_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(texts(d, t), removals(d, at)): at holds the first window's word and the number of windows, packed."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).where("d is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for hashes, offsets, head in chunks(batch.column("t").to_pylist()):
                text, first, count, m, s, repeats = segments(hashes, offsets, width, anchor)
                d = ids[head + text]
                at = _packed(first, count, np.where(repeats, _REPEATS, _PLAIN))
                # equal segments that meet here: only the earliest travels on as one to judge
                order = np.lexsort((at, d, s, m))
                m, s, d, at = m[order], s[order], d[order], at[order]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(m) else np.zeros(0, np.int64)
                later = ~new & ((d != d[lead]) | (at >> 32 != at[lead] >> 32))
                at = np.where(later, at & ~np.int64(3) | _COPY, at)
                m = np.where(later, s ^ d.view(np.uint64), m)  # copies need no partner: dealt evenly
                yield pa.RecordBatch.from_arrays([pa.array(signed(m)), pa.array(signed(s)), pa.array(d), pa.array(at)], names=["m", "s", "d", "at"])

    dealt = texts.mapInArrow(cut, "m long, s long, d long, at long").repartition("m").sortWithinPartitions("m", "s", "d", "at")
    sifted = scratch.write(dealt.mapInArrow(_sift, "m long, d long, at long"))
    asked = sifted.where("m is not null").groupBy("d").agg(F.collect_list(F.struct("m", "at")).alias("asked"))  # of one document

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t, wanted in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                for x in wanted:
                    start, count = x["at"] >> 32, ((x["at"] & 0xFFFFFFFF) >> 2) + width - 1
                    for column, value in zip(out, (x["m"], d, start, b" ".join(words[start : start + count]), count), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int32())], names=["m", "d", "start", "words", "n"])

    found = texts.repartition("d").join(asked, "d").select("d", "t", "asked").mapInArrow(read, "m long, d long, start long, words binary, n int")
    words_of = (F.shiftright(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), 2) + (width - 1)).cast("long")
    hot = sifted.where("m is not null").groupBy("m").agg(F.sum(words_of).alias("w")).where(F.col("w") > block_words)
    hot = scratch.write(hot.select(F.col("m").alias("hot"), F.ceil(F.col("w") / block_words).cast("int").alias("blocks")))
    n_hot = hot.count()
    dealt = found.withColumn("job", F.col("m"))
    if n_hot:
        near = found.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, F.col("m") == F.col("hot"), "left")
        block = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("d", "start"), F.col("blocks")).cast("int"))
        near = near.withColumn("b", block).withColumn("o", F.explode(F.coalesce(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("b")), F.array(F.lit(-1)))))
        job = F.when(F.col("hot").isNull(), F.col("m")).otherwise(F.xxhash64("m", F.least("b", "o"), F.greatest("b", "o")))
        dealt = near.select("m", "d", "start", "words", "n", job.alias("job"))
    shards = dealt.repartition("job").sortWithinPartitions("job", "m", "d", "start")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = _Shard(), None
        for batch in batches:
            for m, d, start, words, n, job in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (job, m, d, start) == seen:  # of a repeated row
                    continue
                if shard.m and seen[0] != job and (shard.words >= shard_words or job != m or seen[0] != seen[1]):
                    yield shard.judge(width)  # a pair of blocks has a shard of its own, as its segments are in others too
                    shard = _Shard()
                seen = (job, m, d, start)
                shard.add(m, d, start, words, n)
        if shard.m:
            yield shard.judge(width)

    return texts, sifted.where("m is null").select("d", "at").union(shards.mapInArrow(judge, "d long, at long"))


def intervals(docs: DataFrame, *, id_col: str = "doc_id", width: int = WIDTH, **options) -> DataFrame:
    """Rows (id, start, length): the runs of words, `width` or more, that also start earlier, as they are reported; runs of one
    document may overlap or touch."""
    _, gone = removed_windows(docs, id_col=id_col, width=width, **options)
    windows = F.shiftright(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), 2)
    return gone.select(F.col("d").alias(id_col), F.shiftright("at", 32).alias("start"), (windows + (width - 1)).alias("length")).distinct()


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256, kept): kept holds the words that are left, joined by one space."""
    texts, gone = removed_windows(docs, id_col=id_col, text_col=text_col, width=width, **options)
    per = gone.groupBy("d").agg(F.collect_list("at").alias("gone"))  # of one document
    joined = texts.repartition("d").join(per, "d", "left").select("d", "t", "gone")
    nulls = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("d"), F.col(text_col).alias("t"), F.lit(None).cast("array<bigint>").alias("gone"))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, runs in zip(batch.column("t").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if runs:
                    cover = np.zeros(n + 1, np.int64)
                    at = np.array(runs, np.int64)
                    start = at >> 32
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + ((at & 0xFFFFFFFF) >> 2) + width - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                for column, value in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.unionByName(nulls).mapInArrow(leave, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string, kept string")
