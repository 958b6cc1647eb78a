"""Exact set-similarity joins by prefix filters, shared by the n-gram join and the line deduplication.

Sets hold 64-bit token hashes, ordered by rarity. Two sets whose Jaccard similarity reaches the threshold share one token
at least within their prefixes, so only sets that meet at a prefix token need comparing. The pairs themselves are never
rows. First, sets that meet at a token are sifted by size and parity bitmap; a set stays for the tokens where it has a
possible partner. Then the sets at each token are compared by the tokens that they share within their prefixes: by their
number, and by what the rest of either set can add. Of the candidate pairs at a token only links that span them are kept.
This is done at a few tokens of each set first, and then at those where sets of different clusters meet.
Their connected components are clusters; similar sets are always in one cluster, so each set is read again once, and
verified within its cluster. Groups at a token and clusters are cut into blocks of bounded size, and each two blocks meet
in a job, so a hot group spreads over many tasks and none holds more than two blocks. Jobs return links that span what
they found linked (or just which sets have an earlier partner), never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, connected, packs
from tessera.llm._words import mix, signed

#: Hash buckets in which tokens are counted: as many bytes are sent to each executor.
BUCKET_BITS = 24
_SLICE = 1 << 16
#: Tokens and sets of a block at most (about; blocks are dealt by hash).
BLOCK_TOKENS = 1 << 17
BLOCK_SETS = 512
#: Sets at a token that are compared pair by pair where they meet; of more, none is left out.
SIFTED = 4096
#: Rows of a table of tokens that is sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Tokens of each set that are compared before all others.
FIRST_TOKENS = 6
#: Bits of the map of sets that are read again: 2 MB.
MARK_BITS = 24


@dataclass(frozen=True)
class Rarity:
    """A level for each hash bucket of tokens: 4 * log2 of its count, or 0 where that doesn't stand out from the mean."""

    level: np.ndarray
    bits: int

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.level[(tokens >> np.uint64(64 - self.bits)).astype(np.int64)]

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        """Estimated number of other sets that hold the token; 0 where it doesn't stand out."""
        level = self.of(tokens).astype(float)
        return np.where(level > 0, np.exp2(level / 4), 0.0)


def rarity(df: DataFrame, columns: list[str], tokens: Callable[[list], Iterator[np.ndarray]], bits: int = BUCKET_BITS, floor: bool = True) -> Rarity:
    """Counts all tokens of all rows into 2**bits hash buckets; tokens() yields the token arrays of a batch.

    floor: counts that don't stand out from the mean of a bucket become level 0, as most tokens are rare ones that share
    buckets. Without it, level 0 says that a token occurs once at most.
    """
    buckets, kind = 1 << bits, np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, kind)
        for batch in batches:
            for x in tokens([batch.column(c).to_pylist() for c in columns]):
                np.add.at(total, (x >> np.uint64(64 - bits)).astype(np.int64), kind(1))
        for i in range(0, buckets, _SLICE):
            blob = pa.compress(total[i : i + _SLICE].tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE], pa.int32()), pa.array([blob])], names=["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(blob, decompressed_size=_SLICE * 4, codec="zstd", asbytes=True), kind)
                total[i] = total.get(i, 0) + x.astype(np.uint64)
        for i, x in total.items():
            level = np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([int(x.sum())], pa.int64()), pa.array([level.tobytes()])], names=["slice", "n", "level"])

    level, n = np.zeros(buckets, np.uint8), 0
    for r in df.select(*columns).mapInArrow(count, "slice int, n binary").repartition("slice").mapInArrow(add, "slice int, n long, level binary").toLocalIterator():
        level[r.slice * _SLICE : (r.slice + 1) * _SLICE] = np.frombuffer(r.level, np.uint8)  # 2**bits bytes in all
        n += r.n
    if floor:
        level[level <= 4 * np.log2(max(1.0, 2 * n / buckets))] = 0
    return Rarity(level, bits)


def ordered_sets(tokens: np.ndarray, group: np.ndarray, n_groups: int, rare: Rarity) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each group, ordered by (level, hash), one group after another, and the groups' offsets."""
    level = rare.of(tokens)
    bits = n_groups.bit_length()
    keep = 56 - bits
    if keep >= 24:  # one number of group, level and the upper bits of the hash; sorting numbers is fast
        key = group.astype(np.uint64) << np.uint64(64 - bits) if bits else np.zeros(len(group), np.uint64)
        key |= level.astype(np.uint64) << np.uint64(keep)
        key |= tokens >> np.uint64(64 - keep)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        sorted_ = tokens[order]
        if not (~new[1:] & (sorted_[1:] != sorted_[:-1])).any():
            tokens, group = sorted_[new], group[order][new]
            return tokens, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n_groups))))
    order = np.lexsort((tokens, level, group))
    tokens, group = tokens[order], group[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])
    tokens, group = tokens[new], group[new]
    return tokens, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n_groups))))


def set_keys(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set: wrapping sums of two mixes of its distinct tokens. Empty sets: 0."""
    with np.errstate(over="ignore"):
        a = tokens * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(31)
        a = a * np.uint64(0xBF58476D1CE4E5B9)
        b = (tokens ^ (tokens >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        b ^= b >> np.uint64(33)
    total = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[offsets])
    return total(a), total(b)


def needed(n: int, percent: int) -> int:
    """Smallest overlap with a set of n tokens at a similarity of percent."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int, matches: int) -> int:
    """Tokens of the prefix in which `matches` are shared with any partner; 0 if only equal sets reach the threshold."""
    least = needed(n, percent)
    if least == n and n * 100 // percent == n:
        return 0
    return min(n, n - least + matches)


def shared_tokens(postings: DataFrame, ids: list[str], percent: int) -> DataFrame:
    """Those rows (token, ids, n, matches, bits) of prefix tokens whose set has a possible partner at the token.

    bits is a parity bitmap of the set: the bits in which two differ are at most the tokens in which the sets differ, which
    the threshold bounds (0 for all: no bitmap). Repeated rows count once.
    """
    names = list(dict.fromkeys(["token", *ids, "n", "matches", "bits"]))
    rows = postings.select(*names).repartition("token").sortWithinPartitions("token", *ids)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "token", 1 << 14):
            token, n, bits = (pack.column(c).to_numpy() for c in ("token", "n", "bits"))
            n, bits = n.astype(np.int64), bits.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
            who = np.array([pack.column(c).to_numpy() for c in ids])
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (who[:, 1:] != who[:, :-1]).any(0)))
            if not new.all():
                pack, token, n, bits, who = pack.filter(pa.array(new)), token[new], n[new], bits[new], who[:, new]
            edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(edge, len(token)))
            keep = np.repeat(size > SIFTED, size)  # too many to compare here: all go on to the jobs, which cut them up
            live = np.flatnonzero(~keep)
            step = 1
            while len(live):
                live = live[live + step < len(token)]
                live = live[token[live] == token[live + step]]
                a, b = live, live + step
                both = n[a] + n[b]
                ok = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
                ok &= np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64) <= both - 2 * -(-both * percent // (100 + percent))
                keep[a[ok]] = keep[b[ok]] = True
                step += 1
            if keep.any():
                yield from pack.filter(pa.array(keep)).combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(sift, ", ".join(f"{c} {kinds[c]}" for c in names))


def marked(rows: DataFrame, ids: list[str]) -> np.ndarray:
    """A bitmap of MARK_BITS bits with the hashes of ids: texts are read again only where it says so."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            out[marks_of(*(batch.column(c).to_numpy() for c in ids))] = True
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(np.packbits(out).tobytes(), codec="zstd", asbytes=True)])], names=["b"])

    total = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in rows.select(*ids).coalesce(8).mapInArrow(mark, "b binary").toLocalIterator():  # 8 bitmaps
        total |= np.frombuffer(pa.decompress(r.b, decompressed_size=len(total), codec="zstd", asbytes=True), np.uint8)
    return total


def marks_of(*ids: np.ndarray) -> np.ndarray:
    """Place of each row of ids in the bitmap."""
    h = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        h = mix(h ^ x.astype(np.int64).view(np.uint64)) + np.uint64(1)
    return (h >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def is_marked(bitmap: np.ndarray, *ids: np.ndarray) -> np.ndarray:
    at = marks_of(*ids)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def links_of_jobs(
    shared: DataFrame,
    ids: list[str],
    fetch: Callable[[np.ndarray], DataFrame],
    scratch: Scratch,
    *,
    percent: int,
    earlier: bool = False,
    release: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Joins sets given by shared(token, ids, n, matches), what shared_tokens() leaves, with ids to order them by.

    fetch(bitmap) returns (ids, n, matches int, tokens array<long> in order of rarity) of the sets whose ids are marked,
    at least. Only sets that have a candidate partner after the filters on prefixes are. Links: rows (ids with suffix _a,
    ids with suffix _b) that connect whatever is linked within a job; over all jobs they connect exactly what the
    similarity links. earlier: instead the ids of the sets that have a partner with a smaller id. release() is called once
    shared has been read.
    """
    met = scratch.write(shared.select("token", *ids, "n", "matches"))
    release()
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}
    pair = ", ".join(f"{c}_{x} {kinds[c]}" for x in "ab" for c in ids)
    # each set with those of its prefix tokens that others share
    own = scratch.write(met.groupBy(*ids, "n", "matches").agg(F.array_sort(F.collect_set("token")).alias("tokens")))
    scratch.drop(met)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "job", BLOCK_SETS):
            a, b, _ = _candidates(pack, ids, percent, heads_only=True)
            if len(a):
                a, b = _spanning(a, b, pack.num_rows)
                yield _pairs(pack, ids, a, b)

    def candidates(keys: DataFrame) -> DataFrame:
        """Links that span the candidate pairs at each token of keys(ids, token). A pair is judged at its smallest common
        token, so each row takes the tokens from its own on."""
        # only frequent tokens are cut into blocks; their table is sent, so that no token's sets meet in one task for it
        large = keys.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK_SETS)
        large = scratch.write(large.select("token", F.ceil(F.col("c") / BLOCK_SETS).cast("int").alias("blocks")))
        onward = F.filter("tokens", lambda x: x >= F.col("token"))
        rows = keys.join(sent(large), "token", "left").join(own, ids)
        rows = rows.select(*ids, "n", "matches", onward.alias("tokens"), F.col("token").alias("g"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
        out = scratch.write(_in_blocks(rows, ids).mapInArrow(near, pair).distinct())
        scratch.drop(large)
        return out

    sent = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    node = lambda x: F.col(f"{ids[0]}{x}").cast("long") if len(ids) == 1 else F.xxhash64(*[f"{c}{x}" for c in ids])
    between = lambda e: e.select(node("_a").alias("a"), node("_b").alias("b"))
    # near copies share many tokens; a few of each set find nearly all clusters of them
    first = candidates(own.select(*ids, F.explode(F.slice("tokens", 1, FIRST_TOKENS)).alias("token")))
    found = scratch.write(connected(between(first), scratch))
    # then all tokens at which different clusters meet
    label = own.withColumn("node", node("")).join(found, "node", "left").select(*ids, F.coalesce("component", "node").alias("label"), F.explode("tokens").alias("token"))
    label = scratch.write(label)
    mixed = label.groupBy("token").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l <> _h").select("token")
    mixed = scratch.write(mixed)
    rest = candidates(label.join(sent(mixed), "token", "left_semi").select(*ids, "token"))
    edges = first.union(rest)
    # clusters of sets that candidate pairs connect: whatever is similar is within one
    clusters = connected(between(edges), scratch)
    ends = edges.select(node("_a").alias("node"), *[F.col(f"{c}_a").alias(c) for c in ids]).union(edges.select(node("_b").alias("node"), *[F.col(f"{c}_b").alias(c) for c in ids])).distinct()
    left = scratch.write(ends.join(clusters, "node").select(*ids, F.col("component").alias("g")))
    scratch.drop(own, label, found, first, rest, mixed)
    sets = fetch(marked(left, ids))
    sizes = left.join(sets.select(*ids, "n"), ids)
    blocks = sizes.groupBy("g").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    dealt = scratch.write(left.join(blocks, "g").select(*ids, "g", "blocks"))
    full = _in_blocks(dealt.join(sets, ids).select(*ids, "n", "matches", "tokens", "g", "blocks"), ids)
    named = ", ".join(f"{c} {kinds[c]}" for c in ids)
    schema = named if earlier else pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs(batches, "job", BLOCK_SETS // 4):
            found = _linked(pack, ids, percent, earlier)
            if found is not None:
                yield found

    out = scratch.write(full.mapInArrow(run, schema))
    scratch.drop(left, dealt, sets)
    return out


def _in_blocks(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows (ids, ..., g, blocks) dealt to jobs: each two blocks of a group g meet in one, sorted by job.

    side tells the two blocks of a job apart; a job of one block (own) compares all its rows.
    """
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*ids, F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    job = F.xxhash64("g", F.least("_b", "_o"), F.greatest("_b", "_o"))
    rows = rows.withColumn("job", job).withColumn("own", F.col("_b") == F.col("_o")).withColumn("side", (F.col("_b") > F.col("_o")).cast("int"))
    return rows.drop("g", "blocks", "_b", "_o").repartition("job").sortWithinPartitions("job")


def _pairs(pack: pa.Table, ids: list[str], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    names = [pack.column(c).combine_chunks() for c in ids]
    return pa.RecordBatch.from_arrays([x.take(pa.array(s)) for s in (a, b) for x in names], names=[f"{c}_{x}" for x in "ab" for c in ids])


def _lists(pack: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of the column tokens."""
    lists = pack.column("tokens").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _candidates(pack: pa.Table, ids: list[str], percent: int, heads_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows a < b) of one job that pass the filters on their prefixes; and the ids as columns of numbers.

    heads_only: tokens holds only tokens of the prefix, else the whole set.
    """
    who = np.array([pack.column(c).to_numpy() for c in ids])
    job, side, own = pack.column("job").to_numpy(), pack.column("side").to_numpy(), pack.column("own").to_numpy()
    n, matches = (pack.column(c).to_numpy().astype(np.int64) for c in ("n", "matches"))
    prefix = np.minimum(n, n + n * -percent // 100 + matches)  # as prefix_length() has it
    count = len(job)
    tokens, offsets = _lists(pack)
    held = np.diff(offsets)
    of = np.repeat(np.arange(count), held)
    head = slice(None) if heads_only else np.arange(len(tokens)) - np.repeat(offsets[:-1], held) < np.repeat(prefix, held)
    # tokens of different jobs are kept apart
    number = np.cumsum(np.concatenate(([0], job[1:] != job[:-1]))).astype(np.int64)
    shared = _overlaps(tokens[head] ^ (number[of[head]] * 0x5851F42D4C957F2D), of[head], count)
    a, b = np.nonzero(np.triu(shared, 1))
    shared = shared[a, b]
    rest = n - prefix
    ok = (number[a] == number[b]) & (shared >= np.minimum(matches[a], matches[b])) & (own[a] | (side[a] != side[b]))
    ok &= np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent  # lengths
    # positions: whoever's prefix ends first has shared all it can up to there, so at most its rest can be added
    ok &= (shared + np.maximum(rest[a], rest[b])) * (100 + percent) >= (n[a] + n[b]) * percent
    ok &= (who[:, a] != who[:, b]).any(0)
    return a[ok], b[ok], who


def _linked(pack: pa.Table, ids: list[str], percent: int, earlier: bool) -> pa.RecordBatch | None:
    """Links of the jobs of a pack, verified on the whole sets."""
    a, b, who = _candidates(pack, ids, percent)
    if not len(a):
        return None
    count = pack.num_rows
    tokens, offsets = _lists(pack)
    n = np.diff(offsets)
    if len(a) > 8 * count:  # a dense group: all overlaps at once
        used = np.zeros(count, bool)
        used[a] = used[b] = True
        of = np.repeat(np.arange(count), n)
        keep = used[of]
        inter = _overlaps(tokens[keep], of[keep], count)[a, b].astype(np.int64)
    else:
        inter, ordered = np.empty(len(a), np.int64), {}
        for i in np.unique(np.concatenate((a, b))).tolist():
            ordered[i] = np.sort(tokens[offsets[i] : offsets[i + 1]])
        for x, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            inter[x] = len(np.intersect1d(ordered[i], ordered[j], assume_unique=True))
    linked = inter * 100 >= (n[a] + n[b] - inter) * percent
    a, b = a[linked], b[linked]
    if not len(a):
        return None
    if earlier:
        rank = np.empty(count, np.int64)
        rank[np.lexsort(who[::-1])] = np.arange(count)
        late = np.unique(np.where(rank[a] > rank[b], a, b))
        return pack.select(ids).take(pa.array(late)).combine_chunks().to_batches()[0]
    return _pairs(pack, ids, *_spanning(a, b, count))


def _overlaps(tokens: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """Matrix of the number of tokens that each two sets share, from columns of tokens that two sets hold at least."""
    kinds, inverse, times = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = times[inverse] > 1
    number = np.cumsum(times > 1) - 1
    column, row = number[inverse[keep]], of[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((count, count), np.float32)
    width = 1024
    for first in range(0, int((times > 1).sum()), width):
        i, j = np.searchsorted(column, (first, first + width))
        rows = np.unique(row[i:j])
        dense = np.zeros((len(rows), width), np.float32)
        dense[np.searchsorted(rows, row[i:j]), column[i:j] - first] = 1
        out[np.ix_(rows, rows)] += dense @ dense.T
    return out


def _spanning(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The links that join two components when taken in order."""
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def arrow_sets(ids: list[pa.Array], names: list[str], n: list[int], matches: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
    """A batch as fetch() returns it."""
    lengths = [0, *np.cumsum([len(x) for x in tokens]).tolist()]
    flat = signed(np.concatenate(tokens)) if tokens else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int32()), pa.array(matches, pa.int32()), lists], names=[*names, "n", "matches", "tokens"])
