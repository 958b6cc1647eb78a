"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles, ordered by rarity. With plain prefixes two similar sets share one token
of their prefixes. A prefix that is longer by l - 1 tokens must share l of them, which leaves far fewer candidates where
prefix tokens are frequent. Each document chooses its own l (1 to MAX_MATCHES) by estimated cost: the postings that its
longer prefix would meet, plus the verifications left when each needs l of them. Two documents are verified if they share
the smaller of their two l within their prefixes, which loses no pair.

Equal sets are one set from the start, so exact copies cost one row each. The join itself is in _setjoin; its links and
the copies are the edges whose connected components are the classes.

Defined results: words are lower-cased (A-Z). A text with fewer words than a shingle is one shingle of all its words; a
null text or one without words has no shingles and is linked with nothing. Rows with equal ids are one document: it has
the links of all its texts. A row with a null id gets a null component and links nothing. Ids are cast to long; one that is no
number fails under ANSI rules and counts as null without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _setjoin
from tessera.llm._common import Scratch, connected, small_batches
from tessera.llm._words import chunks, run_hashes, signed

MAX_MATCHES = 4
#: Cost of one verification in tokens read, by token of the set; the cost of one posting is 1.
VERIFY = 0.25


def flat_shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of several texts with repeats, and the number of the text that each is of."""
    n = np.diff(offsets)
    last = np.repeat(offsets[1:], n) - np.arange(len(hashes))
    whole = np.flatnonzero(last >= k)
    text = np.repeat(np.arange(len(n)), n)
    out = [run_hashes(hashes, whole, k)] if len(whole) else [np.zeros(0, np.uint64)]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        out.append(run_hashes(hashes, offsets[short], n[short]))
    return np.concatenate(out), np.concatenate((text[whole], short))


def matches_needed(frequency: np.ndarray, n: int, percent: int, max_matches: int = MAX_MATCHES) -> int:
    """The l of a set whose tokens, in order, are in `frequency` other sets each (estimated)."""
    best, least, most = 1, None, min(max_matches, max(1, _setjoin.needed(n, percent)))
    for l in range(1, most + 1):
        p = _setjoin.prefix_length(n, percent, l)
        met = float(frequency[:p].sum())
        cost = p + met + VERIFY * n * met / l
        if least is None or cost < least:
            best, least = l, cost
    return best


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, percent: int = 90) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of docs. component_id is the smallest id that links reach.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    spark, scratch, k = docs.sparkSession, Scratch(docs.sparkSession), shingle_words
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))

    def tokens(columns: list) -> Iterator[np.ndarray]:
        for hashes, offsets, _ in chunks(columns[0], lower=True):
            yield flat_shingles(hashes, offsets, k)[0]

    rare = _setjoin.rarity(texts, ["t"], tokens)
    sent = spark.sparkContext.broadcast(rare)  # a byte for each bucket

    def sets(batch: pa.RecordBatch):
        """(first row, ordered tokens, offsets) of the texts of a batch."""
        for hashes, offsets, first in chunks(batch.column("t").to_pylist(), lower=True):
            flat, text = flat_shingles(hashes, offsets, k)
            yield first, *_setjoin.ordered_sets(flat, text, len(offsets) - 1, sent.value)

    def head(own: np.ndarray) -> tuple[int, int]:
        n = len(own)
        matches = matches_needed(sent.value.frequency(own[: _setjoin.prefix_length(n, percent, MAX_MATCHES)]), n, percent)
        return matches, _setjoin.prefix_length(n, percent, matches)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, offsets in sets(batch):
                n = np.diff(offsets)
                a, b = _setjoin.set_keys(flat, offsets)
                chosen = [head(flat[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                heads = [flat[s : s + p] for s, (_, p) in zip(offsets[:-1].tolist(), chosen, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in heads]))), pa.int32()), pa.array(signed(np.concatenate(heads)), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(first, len(n)), pa.array(n, pa.int32()), pa.array(signed(a)), pa.array(signed(b)), pa.array([m for m, _ in chosen], pa.int32()), lists], names=["d", "n", "k1", "k2", "matches", "head"])

    rows = scratch.write(texts.mapInArrow(prefixes, "d long, n int, k1 long, k2 long, matches int, head array<long>"))
    full = rows.where("n > 0 and d is not null")
    same = scratch.write(full.groupBy("k1", "k2", "n").agg(F.min("d").alias("rep"), F.count("*").alias("copies")))
    reps = full.join(same.select("k1", "k2", F.col("rep").alias("d")), ["k1", "k2", "d"], "left_semi")
    postings = reps.select("d", "n", "matches", F.lit(0).cast("long").alias("bits"), F.explode("head").alias("token"))
    shared = _setjoin.shared_tokens(postings, ["d"], percent)

    def fetch(bitmap: np.ndarray) -> DataFrame:
        asked = spark.sparkContext.broadcast(bitmap)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(_setjoin.is_marked(asked.value, batch.column("d").to_numpy())))
                for first, flat, offsets in sets(batch):
                    own = [flat[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    heads = [head(x) for x in own]
                    yield _setjoin.arrow_sets([batch.column("d").slice(first, len(own))], ["d"], [len(x) for x in own], [h[0] for h in heads], own)

        out = scratch.write(texts.where("d is not null").mapInArrow(read, "d long, n int, matches int, tokens array<long>").where("n > 0"))
        asked.destroy()
        return out

    slim = scratch.write(rows.select("d", "n", "k1", "k2"))
    links = _setjoin.links_of_jobs(shared, ["d"], fetch, scratch, percent=percent, release=lambda: scratch.drop(rows))
    full = slim.where("n > 0 and d is not null")
    copies = full.join(same.where("copies > 1"), ["k1", "k2", "n"]).where("d <> rep").select(F.col("d").alias("a"), F.col("rep").alias("b"))
    sent.destroy()
    nodes = scratch.write(connected(links.select(F.col("d_a").alias("a"), F.col("d_b").alias("b")).union(copies), scratch))
    scratch.drop(same, links)
    out = slim.join(nodes, F.col("d") == F.col("node"), "left")
    return out.select(F.col("d").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "d").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its class, once each; rows with a null id stay."""
    scratch = Scratch(docs.sparkSession)
    labels = classes(docs, id_col=id_col, **options).toDF("d", "n", "c").where("d is not null")
    marks = scratch.write(labels.groupBy("d").agg((F.min("c") < F.col("d")).alias("gone"), F.count("*").alias("rows")).where("gone or rows > 1"))
    out = docs.join(marks, docs[id_col] == marks["d"], "left_anti")
    again = marks.where("not gone")
    if not again.isEmpty():  # rows with equal ids: one stays
        out = out.unionByName(docs.join(again, docs[id_col] == again["d"], "left_semi").dropDuplicates([id_col]))
    return out
