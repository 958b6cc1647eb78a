"""Retrieval over embeddings, documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fusion, groups, learning, metrics, search
from tessera.plans._tables import table

#: Queries by vectors and by texts: every row whose id is divisible by 20, against all rows.
EVERY = 20
#: Characters of the items' texts up to which their words are sent to each executor.
SENT_CHARS = 8 << 20
#: Cosine from which two vectors are linked: low enough for the given tables, whose vectors are random, to have links.
NEAR = 0.4


def _queries(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % EVERY == 0)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    hits = search.vector_topk(_queries(v, "vec_id"), v, 10, query_id="vec_id", item_id="vec_id", exclude_self=True)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_blocked(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    hits = search.vector_topk_blocked(_queries(v, "vec_id"), v, 10, query_id="vec_id", item_id="vec_id", exclude_self=True)
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _first_relevant(hits: DataFrame, v: DataFrame) -> DataFrame:
    q, i = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), v.select(F.col("vec_id").alias("item_id"), F.col("label").alias("il"))
    return hits.join(q, "query_id").join(i, "item_id").groupBy("query_id", F.col("ql").alias("label")).agg(F.min(F.when(F.col("ql") == F.col("il"), F.col("rank"))).alias("rank"))


def vector_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    hits = search.vector_topk_blocked(_queries(v, "vec_id"), v, 100, query_id="vec_id", item_id="vec_id", exclude_self=True)
    out = metrics.retrieval(_first_relevant(hits, v), "label", cuts=(1, 5, 10, 25, 50))
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def nearest_crowding(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    near = search.vector_topk_blocked(v, v, 1, query_id="vec_id", item_id="vec_id", exclude_self=True)
    out = metrics.crowding(near, 0.5)
    return out.select(F.round("crowded", 6).alias("crowded"), F.round("median", 6).alias("median"))


def near_dup_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    classes = groups.components(search.vector_links(v, NEAR, item_id="vec_id"))
    return v.select("vec_id").join(classes, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("class"))


def whitened_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    model = learning.fit_whitening(v, dim=16)
    w = v.select("vec_id", learning.whiten(F.col("embedding"), model).alias("embedding"))
    hits = search.vector_topk_blocked(_queries(w, "vec_id"), w, 5, query_id="vec_id", item_id="vec_id", exclude_self=True)
    return hits.select("query_id", "item_id", F.round("score", 5).alias("score"), "rank")


def _terms(c: str = "text") -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) > 1)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.bm25_topk(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 10, query_id="item_id", item_id="doc_id", query_terms=_terms(), item_terms=_terms())
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def tfidf_char_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' and customers' names against nations' names by character n-grams."""
    names = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("t"))
    hits = search.char_tfidf_topk(_queries(names, "p_partkey"), names, 5, query_id="p_partkey", item_id="p_partkey", query_text=F.col("t"), item_text=F.col("t"))
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def coverage_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted share of each item's words in every document that has one of them."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    idf = search.document_frequency(docs, "doc_id", _terms())
    own = items.select("item_id", F.explode(F.array_distinct(_terms())).alias("term")).join(idf, "term", "left").select("item_id", "term", F.coalesce("idf", F.lit(1.0)).alias("w"))
    total = own.groupBy("item_id").agg(F.sum("w").alias("total"))
    # a term's items come as one list, so a word of a document is joined once; if the items' texts are small, the lists are
    # sent, so that no word is shuffled and a document's sums are made where it is read
    lists = own.groupBy("term").agg(F.collect_list(F.struct("item_id", "w")).alias("items"))
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= SENT_CHARS:
        lists = F.broadcast(lists)
    words = docs.select("doc_id", F.explode(F.array_distinct(_terms())).alias("term"))
    hit = words.join(lists, "term").select("doc_id", F.inline("items")).groupBy("item_id", "doc_id").agg(F.sum("w").alias("found"))
    return hit.join(total, "item_id").select("item_id", "doc_id", F.round(F.col("found") / F.col("total"), 6).alias("coverage"))


def _rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists of suppliers for each part, by price and by quantity."""
    per = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 200).alias("query_id"), F.col("l_suppkey").alias("item_id")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    a = search.top_k(per.select("query_id", "item_id", (F.col("p") / 1e8).alias("score")), ["query_id"], "score", 30, "item_id").withColumn("list", F.lit("price"))
    b = search.top_k(per.select("query_id", "item_id", (F.col("q") / 1e3).alias("score")), ["query_id"], "score", 30, "item_id").withColumn("list", F.lit("quantity"))
    return a.unionByName(b)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse_rrf(_rankings(spark, sf)).select("query_id", "item_id", F.round("score", 9).alias("score"))


def fuse_max(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse_max(_rankings(spark, sf))


def fuse_mean(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse_mean(_rankings(spark, sf), "list").select("query_id", "item_id", F.round("score", 6).alias("score"))


def long_list(spark: SparkSession, sf: str) -> DataFrame:
    r = _rankings(spark, sf)
    return fusion.ordered_union([r.where("list = 'price' and rank < 10"), r.where("list = 'quantity'")])


def disc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_name")
    rows = search.discriminative(items, family="p_brand", words=F.split(F.lower("p_name"), " "), max_share=0.2)
    return rows.select("item_id", "family", "word", F.round("weight", 9).alias("weight"))


def family_expand(spark: SparkSession, sf: str) -> DataFrame:
    """For each type the best-priced parts of the brands that lead it, beyond those listed already."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("query_id"), "p_brand", F.col("p_retailprice").alias("score"))
    listed = search.top_k(p, ["query_id"], "score", 5, "item_id")
    leading = listed.select("query_id", "p_brand").distinct()
    pool = p.join(leading, ["query_id", "p_brand"]).select("query_id", "item_id", "score")
    return search.family_rank(p.select("item_id", "p_brand"), pool, listed, family="p_brand", limit=3).select("query_id", "p_brand", "item_id", "score", "rank")


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_blocked, vector_recall_mrr, nearest_crowding, near_dup_vectors, whitened_neighbours, bm25_topk, tfidf_char_topk, coverage_weighted, rrf_fusion, fuse_max, fuse_mean, long_list, disc_tokens, family_expand)}

_VEC = "v as materialized (select vec_id, label, embedding::double[] e from embeddings), s as (select q.vec_id query_id, i.vec_id item_id, q.label ql, i.label il, list_dot_product(q.e, i.e) score from v q join v i on q.vec_id <> i.vec_id where {where}), r as (select *, row_number() over (partition by query_id order by score desc, item_id) - 1 as rank from s)"
_Q = _VEC.format(where="q.vec_id % 20 = 0")
_TERMS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 1)"
_RANKED = "per as (select l_partkey % 200 query_id, l_suppkey item_id, sum(round(l_extendedprice * 100)::bigint)::bigint p, sum(l_quantity::bigint)::bigint q from lineitem group by 1, 2), sc as (select query_id, item_id, p / 1e8::double score, 'price' list from per union all select query_id, item_id, q / 1e3::double, 'quantity' from per), rk as (select * from (select *, row_number() over (partition by query_id, list order by score desc, item_id) - 1 as rank from sc) where rank < 30)"
_G = " union all ".join(f"select id, unnest(list_transform(range(length(w) - {n - 1}), lambda i: substr(w, i + 1, {n}))) term from words where length(w) > {n} union all select id, w from words where length(w) {'<=' if n == 3 else '='} {n}" for n in (3, 4, 5))
SQL = {
    "vector_topk": f"with {_Q} select query_id, item_id, round(score, 6) score, rank::int as rank from r where rank < 10",
    "vector_topk_blocked": f"with {_Q} select query_id, item_id, round(score, 6) score, rank::int as rank from r where rank < 10",
    "vector_recall_mrr": f"with {_Q}, f as (select query_id, ql as label, min(case when ql = il then rank end) k from r where rank < 100 group by 1, 2) select label, count(*) n, " + ", ".join(f"round(avg(case when k < {c} then 1.0 else 0.0 end), 6) recall_{c}" for c in (1, 5, 10, 25, 50)) + ", round(avg(coalesce(1.0::double / (k + 1), 0)), 6) mrr from f group by label",
    "nearest_crowding": f"with {_VEC.format(where='true')} select round(avg(case when score > 0.5 then 1.0 else 0.0 end), 6) crowded, round(median(score), 6) median from r where rank = 0",
    "near_dup_vectors": f"with recursive {_VEC.format(where='true')}, e as materialized (select query_id a, item_id b from s where score >= {NEAR}), u as materialized (select a, b from e union select b, a from e), c(node, root) as (select distinct a, a from u union select u.b, c.root from c join u on c.node = u.a) select vec_id, coalesce(m, vec_id) as class from v left join (select node, min(root) m from c group by 1) x on vec_id = node",
    "bm25_topk": f"with d as materialized (select doc_id, {_TERMS} t, len({_TERMS}) n from documents), tf as materialized (select doc_id, n, term, count(*) tf from (select doc_id, n, unnest(t) term from d) group by 1, 2, 3), df as (select term, count(*) df from tf group by 1), raw as (select term, ln(((select count(*) from d) - df + 0.5)::double / (df + 0.5)::double) r from df), idf as (select term, case when r < 0 then 0.25::double * (select avg(r) from raw) else r end idf from raw), q as (select item_id, term, count(*) qf from (select item_id, unnest({_TERMS}) term from benchmark) group by 1, 2), s as (select item_id query_id, doc_id item_id, round(sum(qf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n / (select avg(n) from d)))), 9) score from q join idf using (term) join tf using (term) group by 1, 2) select query_id, item_id, round(score, 6) score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) - 1 as rank from s) where rank < 10",
    "tfidf_char_topk": f"with words as materialized (select id, ' ' || w || ' ' w from (select p_partkey id, unnest(string_split_regex(trim(lower(p_name)), '\\s+')) w from part) where w <> ''), g as ({_G}), tf as (select id, term, count(*) tf from g group by 1, 2), df as (select term, ln(((select count(*) from part) + 1)::double / (count(*) + 1)) + 1 idf from tf group by 1), raw as (select id, term, (1 + ln(tf)) * idf w from tf join df using (term)), n as (select id, sqrt(sum(w * w)) l from raw group by 1), u as materialized (select id, term, w / l w from raw join n using (id)), s as (select a.id query_id, b.id item_id, round(sum(a.w * b.w), 9) score from u a join u b using (term) where a.id % 20 = 0 group by 1, 2) select query_id, item_id, round(score, 6) score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) - 1 as rank from s) where rank < 5",
    "coverage_weighted": f"with w as materialized (select distinct doc_id, unnest({_TERMS}) term from documents), df as (select term, count(*) df, ln(((select count(*) from documents) + 1)::double / (count(*) + 1)) + 1 idf from w group by 1), own as materialized (select item_id, term, coalesce(idf, 1.0) wt from (select distinct item_id, unnest({_TERMS}) term from benchmark) left join df using (term)), t as (select item_id, sum(wt) total from own group by 1), rare as (select distinct item_id, doc_id from own join w using (term)) select rare.item_id, rare.doc_id, round(sum(wt) / any_value(total), 6) coverage from rare join w using (doc_id) join own on own.item_id = rare.item_id and own.term = w.term join t on t.item_id = rare.item_id group by 1, 2",
    "rrf_fusion": f"with {_RANKED} select query_id, item_id, round(sum(1.0::double / (60 + rank + 1)), 9) score from rk group by 1, 2",
    "fuse_max": f"with {_RANKED} select query_id, item_id, greatest(max(score), -1.0) score from rk group by 1, 2",
    "fuse_mean": f"with {_RANKED}, n as (select query_id, count(distinct list) n from rk group by 1) select query_id, item_id, round(sum(score) / any_value(n), 6) score from rk join n using (query_id) group by 1, 2",
    "long_list": f"with {_RANKED}, p as (select query_id, item_id, min(case when list = 'price' then rank else 1000 + rank end) k from rk where list = 'quantity' or rank < 10 group by 1, 2) select query_id, item_id, (row_number() over (partition by query_id order by k, item_id) - 1)::int as position from p",
    "disc_tokens": "with w as (select distinct p_partkey item_id, p_brand family, unnest(string_split(lower(p_name), ' ')) word from part), s as (select p_brand family, count(*) size from part group by 1), d as (select family, word, count(*) df from w group by 1, 2) select item_id, family, word, round(ln(size::double / df) + 0.1::double, 9) weight from w join d using (family, word) join s using (family) where size > 1 and df <= 0.2 * size",
    "family_expand": "with p as (select p_partkey item_id, p_type query_id, p_brand, p_retailprice score from part), l as (select * from (select *, row_number() over (partition by query_id order by score desc, item_id) r from p) where r <= 5), q as (select p.* from p where exists (select 1 from l where l.query_id = p.query_id and l.p_brand = p.p_brand) and not exists (select 1 from l where l.query_id = p.query_id and l.item_id = p.item_id)) select query_id, p_brand, item_id, score, rank::int as rank from (select *, row_number() over (partition by query_id, p_brand order by score desc, item_id) - 1 as rank from q) where rank < 3",
}
