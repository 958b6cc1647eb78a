"""Retrieval: exact vector search, character n-gram TF-IDF, BM25, token coverage, top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.linalg import dot
from tessera.functions.similarity import indel_ratio
from tessera.functions.text import char_ngrams

#: Vectors of the smaller side that are sent to each executor as one matrix, in bytes.
MATRIX_BYTES = 256 << 20
#: Words of queries (and rows of query and word) that are sent to each executor; more are joined by a shuffle.
TERMS_SENT = 200_000
#: Sums are rounded to so many digits before they are ranked, so that the order of adding never decides a tie.
DIGITS = 9


def top_k(rows: DataFrame, by: list[str], score: str, k: int, *tie: str, rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ranked from 0. Spark keeps k rows of a group before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    return rows.withColumn(rank, F.row_number().over(order) - 1).where(F.col(rank) < k)


def vector_topk(queries: DataFrame, items: DataFrame, k: int, **options) -> DataFrame:
    """Rows (query_id, item_id, score, rank): the k largest dot products of each query, ties by item id."""
    return vector_topk_blocked(queries, items, k, **options)


def vector_topk_blocked(queries: DataFrame, items: DataFrame, k: int, *, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", exclude_self: bool = False, block: int = 1 << 17, tile: int = 1 << 22) -> DataFrame:
    """The k nearest by exact products, without pairs as rows: queries go out as matrices in blocks, every item batch is
    multiplied by them, `tile` products at a time, and only the k best of a batch leave it. Each block is below MATRIX_BYTES; a
    query set of any size takes more passes over the items."""
    spark = queries.sparkSession
    width = queries.select(F.size(vector)).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, item_id long, score double, rank int")
    rows = max(1, min(block, MATRIX_BYTES // (8 * max(1, width[0]))))
    numbered = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).alias("v"))
    total = numbered.count()
    found = None
    for part in range(-(-total // rows)):
        own = numbered.where(F.pmod(F.xxhash64("q"), F.lit(-(-total // rows))) == part).toPandas()  # one block
        if own.empty:
            continue
        sent = spark.sparkContext.broadcast((own["q"].to_numpy(), np.vstack(own["v"].to_numpy()).astype(np.float64)))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for batch in batches:
                if batch.empty:
                    continue
                items_ = batch["i"].to_numpy()
                vectors = np.vstack(batch["v"].to_numpy()).astype(np.float64).T
                step = max(1, tile // len(items_))
                for at in range(0, len(ids), step):
                    asked = ids[at : at + step]
                    scores = matrix[at : at + step] @ vectors
                    if exclude_self:
                        scores[asked[:, None] == items_[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(items_, scores.shape), -scores), axis=1)[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(asked, order.shape[1]), "item_id": items_[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()})

        near = items.select(F.col(item_id).cast("long").alias("i"), F.col(vector).alias("v")).mapInPandas(best, "query_id long, item_id long, score double").where("score > double('-inf')")
        found = near if found is None else found.union(near)
    return top_k(found, ["query_id"], "score", k, "item_id")


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links (node, smallest node of its class) that join what the links a-b join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    links = [(x, find(x)) for x in list(root) if find(x) != x]
    return np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)


def vector_links(items: DataFrame, least: float, *, item_id: str = "item_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """Links (a, b) whose classes are those of all pairs of vectors with a dot product of `least` or more. Blocks are multiplied
    as in vector_topk_blocked; no pair is left out, and what leaves a batch are spanning links, fewer than its vectors and the block's."""
    spark = items.sparkSession
    width = items.select(F.size(vector)).first()
    if width is None:
        return spark.createDataFrame([], "a long, b long")
    rows = max(1, min(block, MATRIX_BYTES // (8 * max(1, width[0]))))
    numbered = items.select(F.col(item_id).cast("long").alias("i"), F.col(vector).alias("v"))
    blocks = -(-numbered.count() // rows)
    found = None
    for part in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == part).toPandas()  # one block
        if own.empty:
            continue
        sent = spark.sparkContext.broadcast((own["i"].to_numpy(), np.vstack(own["v"].to_numpy()).astype(np.float64)))

        def link(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for batch in batches:
                if batch.empty:
                    continue
                items_, vectors = batch["i"].to_numpy(), np.vstack(batch["v"].to_numpy()).astype(np.float64).T
                a, b = [], []
                for at in range(0, len(ids), 256):
                    some, near = ids[at : at + 256], matrix[at : at + 256] @ vectors >= least
                    hit, first = near.any(0), near.argmax(0)
                    x, y = np.nonzero(near)
                    met = np.zeros((len(some), len(some)), bool)
                    met[x, first[y]] = True  # an item's first row stands for it, so a row meets rows and not items
                    x, y = np.nonzero(met)
                    a += [items_[hit], some[x]]
                    b += [some[first[hit]], some[y]]
                x, y = spanning_links(np.concatenate(a), np.concatenate(b))
                yield pd.DataFrame({"a": x, "b": y})

        near = numbered.mapInPandas(link, "a long, b long")
        found = near if found is None else found.union(near)
    return found


def document_frequency(docs: DataFrame, id_col: str, terms: Column, *, smooth: bool = True) -> DataFrame:
    """Rows (term, df, idf) over all documents. A term counts once for a document."""
    n = docs.select(F.count("*").alias("n"))
    df = docs.select(id_col, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1 if smooth else F.ln(F.col("n") / F.col("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf.alias("idf"))  # n is one row


def tfidf(docs: DataFrame, id_col: str, terms: Column, *, idf: DataFrame | None = None, sublinear: bool = True, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """Rows (id, term, w) of unit length. idf: that of a catalogue, to weigh queries alike."""
    counts = docs.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    if idf is None:
        idf = document_frequency(docs, id_col, terms)
        if min_df > 1 or max_share < 1:
            idf = idf.where((F.col("df") >= min_df) & (F.col("df") <= max_share * docs.count()))
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    raw = counts.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "id").select("id", "term", (F.col("w") / F.col("length")).alias("w"))


def cosine_topk(queries: DataFrame, items: DataFrame, k: int | None, digits: int = DIGITS) -> DataFrame:
    """Top k of sparse unit vectors (id, term, w) by an inverted-index join: rows (query_id, item_id, score, rank); k None: all
    pairs with a common term, unranked."""
    met = queries.select(F.col("id").alias("query_id"), "term", F.col("w").alias("_q")).join(items.select(F.col("id").alias("item_id"), "term", F.col("w").alias("_i")), "term")
    scored = met.groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("_q") * F.col("_i")), digits).alias("score"))
    return scored if k is None else top_k(scored, ["query_id"], "score", k, "item_id")


def char_tfidf_topk(queries: DataFrame, items: DataFrame, k: int, *, query_id: str, item_id: str, query_text: Column, item_text: Column, low: int = 3, high: int = 5) -> DataFrame:
    """Top k by cosine of character n-grams. Equal texts are one row until the end: of an item text only the first k ids can be
    among a query's k best, so copies cost nothing."""
    own = items.select(F.col(item_id).alias("item_id"), item_text.alias("_t")).where("_t is not null")
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy("item_id"))).where(F.col("_r") <= k).drop("_r")
    texts = own.groupBy("_t").agg(F.count("*").alias("_n")).select(F.col("_t").alias("i"), "_n", char_ngrams(F.col("_t"), low, high).alias("g"))
    n = items.select(F.count("*").alias("n"))
    df = texts.select("_n", F.explode(F.array_distinct("g")).alias("term")).groupBy("term").agg(F.sum("_n").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row
    asked = queries.select(F.col(query_id).alias("query_id"), query_text.alias("_q")).where("_q is not null")
    kinds = asked.select(F.col("_q").alias("i")).distinct().withColumn("g", char_ngrams(F.col("i"), low, high))
    near = cosine_topk(tfidf(kinds, "i", F.col("g"), idf=idf), tfidf(texts, "i", F.col("g"), idf=idf), None)
    met = near.select(F.col("query_id").alias("_q"), F.col("item_id").alias("_t"), "score").join(first, "_t")
    best = top_k(met, ["_q"], "score", k, "item_id")
    return asked.join(best, "_q").select("query_id", "item_id", "score", "rank")


def bm25_topk(queries: DataFrame, items: DataFrame, k: int, *, query_id: str, item_id: str, query_terms: Column, item_terms: Column, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25; a negative idf becomes epsilon times the mean idf. Repeated query words count each time. Document frequencies
    are counted from each document's distinct words, and only words that a query has are shuffled with their documents."""
    docs = items.select(F.col(item_id).alias("item_id"), item_terms.alias("t")).withColumn("len", F.size("t"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    df = docs.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # stats is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(query_terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    terms = asked.select("term").distinct()
    small = terms.count() <= TERMS_SENT
    sent = lambda x: F.broadcast(x) if small else x
    idf = raw.join(sent(terms), "term").crossJoin(F.broadcast(mean)).select("term", "avg_len", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean is one row
    tf = docs.select("item_id", "len", F.explode("t").alias("term")).join(sent(terms), "term", "left_semi").groupBy("item_id", "len", "term").agg(F.count("*").alias("tf"))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighed = asked.join(idf, "term")
    weighed = F.broadcast(weighed) if asked.count() <= TERMS_SENT else weighed
    scored = tf.join(weighed, "term").groupBy("query_id", "item_id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return top_k(scored, ["query_id"], "score", k, "item_id")


def max_normalized(hits: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Scores divided by the best of their query, if that is above 0."""
    best = F.max(score).over(Window.partitionBy(by))
    return hits.withColumn(score, F.when(best > 0, F.col(score) / best).otherwise(F.col(score)))


def _token_hits(ratio: float) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("array<string>")
    def hits(asked: pd.Series, own: pd.Series) -> pd.Series:
        def hit(w: str, words: set[str], by_length: dict[int, list[str]]) -> bool:
            if w in words:
                return True
            return len(w) > 3 and not w.isdigit() and any(indel_ratio(a, w) >= ratio for n in (-1, 0, 1) for a in by_length.get(len(w) + n, ()))

        def row(q, o):
            if q is None or o is None:
                return None
            words, by_length = {a for a in q if a is not None}, {}
            for a in words:
                by_length.setdefault(len(a), []).append(a)
            return [w for w in o if w is not None and hit(w, words, by_length)]

        return pd.Series([row(q, o) for q, o in zip(asked, own, strict=True)], dtype="object")

    return hits


def coverage(asked: Column, own: Column, weights: Column | None = None, ratio: float = 80.0) -> Column:
    """Weighted share of own words among the asked ones; 0 if a side is empty. Words of four letters and more that are no numbers
    may differ, if their indel ratio is `ratio` at least and their lengths differ by one at most."""
    weigh = (lambda w: F.coalesce(F.try_element_at(weights, w), F.lit(1.0))) if weights is not None else (lambda w: F.lit(1.0))
    total = F.aggregate(own, F.lit(0.0), lambda s, w: s + weigh(w))
    found = F.aggregate(_token_hits(ratio)(asked, own), F.lit(0.0), lambda s, w: s + weigh(w))
    return F.when(total > 0, found / total).otherwise(0.0)


def two_stage(pool: DataFrame, rescored: Column, k: int, *, pool_size: int = 100, blend: float = 0.5) -> DataFrame:
    """Best pool_size of each query by score, then the k best by (1 - blend) * normalised score + blend * rescored."""
    near = max_normalized(pool.where(F.col("rank") < pool_size)).drop("rank")
    return top_k(near.withColumn("score", (1 - blend) * F.col("score") + blend * rescored), ["query_id"], "score", k, "item_id")


def without(rows: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    """Excluded ids go before anything is ranked, so that ranks close up."""
    return rows.join(excluded.select(on), on, "left_anti")


def family_rank(items: DataFrame, scores: DataFrame, excluded: DataFrame, *, family: str, limit: int = 15) -> DataFrame:
    """For each (query_id, family): items not yet listed, by score, `limit` at most."""
    rows = scores.join(items.select("item_id", family), "item_id").where(F.col(family) != "").join(excluded.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return top_k(rows, ["query_id", family], "score", limit, "item_id")


def discriminative(items: DataFrame, *, family: str, words: Column, max_share: float = 0.5, generic: tuple[str, ...] = ()) -> DataFrame:
    """Words of an item that tell it from its family: rows (item_id, family, word, weight = ln(size / df) + 0.1)."""
    w = items.select("item_id", F.col(family).alias("family"), F.explode(F.array_distinct(words)).alias("word"))
    size = items.groupBy(F.col(family).alias("family")).agg(F.count("*").alias("size"))
    df = w.groupBy("family", "word").agg(F.count("*").alias("df"))
    kept = w.join(df, ["family", "word"]).join(size, "family").where((F.col("size") > 1) & (F.col("df") <= max_share * F.col("size")) & ~F.col("word").isin(*generic) if generic else (F.col("size") > 1) & (F.col("df") <= max_share * F.col("size")))
    return kept.select("item_id", "family", "word", (F.ln(F.col("size") / F.col("df")) + 0.1).alias("weight"))


def self_check(items: DataFrame, near: DataFrame, *, duplicate: float = 0.98) -> DataFrame:
    """Quality of an index, from the nearest items(query_id, item_id, score, rank) of its own vectors: rows (item_id, finds_itself,
    twin, twin_score). twin is the nearest other item at or above a similarity."""
    itself = near.where("query_id = item_id").groupBy("query_id").agg((F.min("rank") == 0).alias("_f"))
    other = near.where((F.col("query_id") != F.col("item_id")) & (F.col("score") >= duplicate)).groupBy("query_id").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", (-F.col("item_id")).alias("i"))).alias("_t"))
    out = items.join(itself, items["item_id"] == itself["query_id"], "left").drop("query_id").join(other, items["item_id"] == other["query_id"], "left")
    return out.select("item_id", F.coalesce("_f", F.lit(False)).alias("finds_itself"), F.col("_t.item_id").alias("twin"), F.col("_t.score").alias("twin_score"))


def verify_patch(old: DataFrame, new: DataFrame, probes: DataFrame, least: float) -> DataFrame:
    """Probes(item_id) whose vector in a patched index isn't what it was: rows (item_id, cosine) below `least`; none if all is well."""
    a, b = old.select("item_id", F.col("embedding").alias("_a")), new.select("item_id", F.col("embedding").alias("_b"))
    return probes.join(a, "item_id").join(b, "item_id", "left").select("item_id", F.coalesce(dot(F.col("_a"), F.col("_b")), F.lit(-1.0)).alias("cosine")).where(F.col("cosine") < least)
