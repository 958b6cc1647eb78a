"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents long, so the Jaccard similarity of a pair is tiny and a MinHash of the whole document
would lose the item: at 30 item shingles in 20,000, 256 hash functions find it in a quarter of the cases. Containment is
asymmetric, and so is the sketch here. Items are partitioned by size. In the partition of items with n shingles the
sketch is the bottom-k MinHash (the k smallest shingle hashes) with k = n - ceil(t * n) + 1; a document that holds t of an
item's shingles holds one of those k at least, as only n - ceil(t * n) can be missing. So the search has no false
negatives, whatever the document's size. Documents keep all their shingle hashes, which are looked up in the sketches of
all size partitions by one equi-join; a size filter drops documents that are too short for an item. Candidates are then
verified with the shingles themselves.

Words are lower-cased (A-Z); a shingle is shingle_words consecutive words, and fewer words are one shingle. Items without
words match nothing; so do null and empty texts. Pairs of repeated rows are reported once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, lower_az, words

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Rows of a table made from the test items that are sent to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _shingled(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """Adds _words and _n, the number of shingles with repeats."""
    out = df.withColumn("_words", words(lower_az(F.col(text_col))))
    size = F.size("_words")
    return out.withColumn("_n", F.when(size >= k, size - (k - 1)).when(size > 0, 1).otherwise(0))


def _each(k: int, make):
    """Array of make(words of the shingle) for all shingles; the words are given as Columns, null beyond the end."""
    return F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: make([F.get("_words", i + j) for j in range(k)])))


def _hashes(k: int):
    return _each(k, lambda w: F.xxhash64(*w))


def _strings(k: int):
    return _each(k, lambda w: F.concat_ws(" ", *w))


def contaminated_pairs(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle_words: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc id, item id, n_shingles of the item, n_found, containment) of all pairs at or above the threshold."""
    k, scratch = shingle_words, Scratch(docs.sparkSession)
    percent = round(threshold * 1000)
    tests = _shingled(items.select(F.col(item_id_col).alias("_item"), F.col(item_text_col).alias("_t")), "_t", k).where("_n > 0")
    tests = scratch.write(tests.select("_item", F.array_distinct(_strings(k)).alias("_shingles"), F.array_sort(F.array_distinct(_hashes(k))).alias("_sorted")).dropDuplicates(["_item", "_shingles"]).withColumn("_set", F.monotonically_increasing_id()))
    n = F.size("_sorted")
    need = F.ceil(n * percent / 1000)
    sketches = tests.select("_item", need.alias("_need"), F.explode(F.slice("_sorted", 1, (n - need + 1).cast("int"))).alias("_hash"))
    # of one hash the smallest need is enough for the lookup
    lookup = scratch.write(sketches.groupBy("_hash").agg(F.min("_need").alias("_need")))
    sketches = scratch.write(sketches)
    parts = scratch.write(tests.select("_item", "_set", F.explode("_shingles").alias("_s")))
    sent = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t"))
    hashed = _shingled(texts, "_t", k).where("_n > 0").select("_doc", "_n", F.explode(_hashes(k)).alias("_hash"))
    hits = hashed.join(sent(lookup), "_hash").where("_n >= _need").select("_doc", "_n", "_hash").distinct()
    pairs = scratch.write(hits.join(sent(sketches), "_hash").where("_n >= _need").select("_doc", "_item").distinct())
    # verification: the shingles of candidate documents meet those of the items one by one, and are counted
    asked = pairs.select(F.col("_doc").alias("_cand")).distinct()
    found = texts.join(asked, texts["_doc"].eqNullSafe(asked["_cand"]), "left_semi")
    own = _shingled(found, "_t", k).where("_n > 0").select("_doc", F.xxhash64("_t").alias("_text"), F.explode(_strings(k)).alias("_s"))
    m = own.join(sent(parts), "_s").groupBy("_doc", "_text", "_set").agg(F.count_distinct("_s").alias("m"))
    both = m.join(tests.select("_item", "_set", F.size("_shingles").alias("n")), "_set").where(F.col("m") * 1000 >= F.col("n") * percent)
    best = both.groupBy("_doc", "_item").agg(F.max(F.struct((F.col("m") / F.col("n")).alias("c"), "n", "m")).alias("b"))
    return best.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_id_col if item_id_col != id_col else f"item_{item_id_col}"), F.col("b.n").cast("long").alias("n_shingles"), F.col("b.m").cast("long").alias("n_found"), F.col("b.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no test item, with the columns of docs. Documents with a null id are compared too."""
    bad = contaminated_pairs(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")

