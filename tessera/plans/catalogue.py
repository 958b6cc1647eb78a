"""Catalogue matching, grouping and recommendation over parts, suppliers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog, groups, metrics, recommend
from tessera.plans._tables import table
from tessera.sources import readers, writers


def catalog_match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Parts to files made of line items: exact, equal bytes, ambiguous or missing."""
    files = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat_ws("/", "l_suppkey", "l_orderkey").alias("path"), F.md5(F.col("l_returnflag").cast("binary")).alias("md5"))
    out = catalog.match_files(table(spark, sf, "part").select("p_partkey"), files, "p_partkey")
    return out.select("p_partkey", F.coalesce("files", F.lit(0)).alias("files"), "match", "path")


def preferred_match(spark: SparkSession, sf: str) -> DataFrame:
    """Nation of a customer by the supplier of its key, else by its own."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    first = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("c_custkey"), "name")
    return catalog.prefer(c, first, n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_custkey", "c_nationkey", "name").select("c_custkey", "name")


def catalog_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are new against an older half, and those whose status differs from a shifted copy."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    new = catalog.added(o, old, "o_orderkey").select("o_orderkey", F.lit("added").alias("change"))
    return new.union(catalog.changed(o, old, "o_orderkey", "o_orderstatus").select("o_orderkey", F.lit("changed").alias("change")))


def one_to_one_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    first = catalog.first_per_key(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey", "l_linenumber", "l_partkey")
    return catalog.one_to_one(o, first, "o_orderkey").select("o_orderkey", "o_totalprice", "l_partkey")


def duplicate_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))
    return d.withColumn("duplicate", groups.duplicate_flag("md5"))


def equivalence_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that ordered the same part in the same month, as classes."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.struct("l_partkey", F.date_trunc("month", "o_orderdate").alias("m")).alias("k")).distinct()
    hub = li.groupBy("k").agg(F.min("o_custkey").alias("a"))
    return groups.components(li.join(hub, "k").where("o_custkey <> a").select("a", F.col("o_custkey").alias("b"))).select(F.col("node").alias("o_custkey"), F.col("component").alias("class"))


def vintage_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as cards: the name's first words with a made-up year, grouped by what is left without it."""
    cards = _cards(spark, sf)
    return groups.vintage_groups(cards).select("slug", F.col("group").alias("class"), F.array_join(F.col("group_years").cast("array<string>"), ",").alias("years"))


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    year = (2000 + F.col("p_size") % 25).cast("int")
    dated = F.col("p_partkey") % 3 > 0
    name = F.concat_ws(" ", F.split("p_name", " ")[0], F.when(dated, year.cast("string")))
    return p.select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("slug"), name.alias("name"), F.col("p_brand").alias("winery"), F.col("p_type").alias("category"), F.lit("").alias("grapes"), F.when(dated, F.array(year)).otherwise(F.array().cast("array<int>")).alias("years"))


def vintage_pick(spark: SparkSession, sf: str) -> DataFrame:
    cards = _cards(spark, sf)
    asked = cards.select("slug", F.lit(2010).alias("year"))
    return groups.pick_vintage(asked, cards, groups.vintage_groups(cards)).select("slug", "picked")


def vintage_resolve(spark: SparkSession, sf: str) -> DataFrame:
    cards = _cards(spark, sf).withColumn("year", F.when(F.substring("slug", 8, 1) != "0", F.lit(2010)))
    r = groups.resolve_year(F.col("year"), F.lit("text"), F.col("years"))
    return cards.select("slug", r["year"].alias("year"), r["source"].alias("source"), r["ask"].alias("ask"), groups.compare_year(F.col("year"), F.col("years"), F.array(F.lit(2010))).alias("axis"))


def analogues(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("maker"), F.col("p_type").alias("category"), (F.col("p_size") % 7).cast("string").alias("region"), F.array_distinct(F.split("p_name", " ")).alias("grapes"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3).alias("color"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 2).alias("sweetness"), F.col("p_name").alias("description"))
    return recommend.analogues(items, 5, descriptions=F.split(F.lower("description"), " ")).select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def fuzzy_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts against region and nation names by token set ratio."""
    names = table(spark, sf, "part").where("p_partkey % 20 = 0").select("p_partkey", F.lower("p_name").alias("name"))
    return catalog.fuzzy_best(names, table(spark, sf, "nation").select(F.lower("n_name").alias("n")), text="name", choice="n").select("p_partkey", "choice", F.round("score", 6).alias("score"))


def star_join(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by region and segment: line items with their orders, customers, nations and regions."""
    li = table(spark, sf, "lineitem").where(F.col("l_returnflag") != "R").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf, "region")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("v"), 2).alias("revenue"), F.count("*").alias("n"))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Parts sold by few, by many, by both kinds of orders."""
    li = table(spark, sf, "lineitem")
    a, b = li.where("l_quantity > 45").select("l_partkey").distinct(), li.where("l_discount > 0.08").select("l_partkey").distinct()
    tag = lambda df, t: df.select("l_partkey", F.lit(t).alias("set"))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "large only")).union(tag(b.subtract(a), "cheap only"))


def merged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with changed ones put over them where they are dearer."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 8 == 0, 1.1).otherwise(0.9), 2).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return writers.merge(o, new, "o_orderkey", F.col("new.o_totalprice") > F.col("old.o_totalprice"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")
    return table(spark, sf, "pages").select("page_id", links).groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("href").alias("kinds"), F.min("href").alias("first"))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.nullif(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit(""))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), F.regexp_extract("url", r"/([^/?#]+)/?(?:[?#].*)?$", 1).alias("slug"), readers.embedded_json(F.col("html"), "data").alias("data"))


def upload_listing(spark: SparkSession, sf: str) -> DataFrame:
    """File names made of parts, as an upload folder would list them, by key."""
    p = table(spark, sf, "part")
    name = F.concat(F.when(F.col("p_partkey") % 5 == 0, "small_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 10), F.lit(".jpg"))
    return readers.uploads(p.select(F.concat(F.lit("a/"), name).alias("path"))).select("key", F.size("paths").alias("n"), F.get("paths", F.lit(0)).alias("first"))


def summary_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman correlation and standardised mean difference of prices."""
    li = table(spark, sf, "lineitem")
    s = metrics.spearman(li.select("l_quantity", F.round("l_extendedprice", 0).alias("price")), "l_quantity", "price")
    d = metrics.mean_difference(li, "l_extendedprice", F.col("l_returnflag") == "R")
    return s.crossJoin(d).select(F.round("spearman", 6).alias("spearman"), F.round("smd", 6).alias("smd"))


QUERIES = {f.__name__: f for f in (catalog_match_cascade, preferred_match, catalog_changes, one_to_one_join, duplicate_flags, equivalence_classes, vintage_groups, vintage_pick, vintage_resolve, analogues, fuzzy_best_match, star_join, set_operations, merged_rows, html_links, page_titles, upload_listing, summary_statistics)}

_CARDS = "cards as materialized (select 'p' || lpad(p_partkey::varchar, 7, '0') slug, string_split(p_name, ' ')[1] word, p_brand, p_type, case when p_partkey % 3 > 0 then 2000 + p_size % 25 end as year from part), g as materialized (select word, p_brand, p_type, min(slug) grp, string_agg(distinct year::varchar, ',' order by year::varchar) yrs from cards group by 1, 2, 3 having count(*) > 1 and count(year) > 0)"
SQL = {
    "catalog_match_cascade": "with f as (select l_partkey, l_suppkey || '/' || l_orderkey path, l_returnflag m from lineitem), g as (select l_partkey, count(*) files, count(distinct m) kinds, min(path) path from f group by 1) select p_partkey, coalesce(files, 0) files, case when files is null then 'missing' when files = 1 then 'exact' when kinds = 1 then 'bytes' else 'ambiguous' end as match, case when files = 1 or kinds = 1 then path end as path from part left join g on p_partkey = l_partkey",
    "preferred_match": "select c_custkey, coalesce(a.n_name, b.n_name) as name from customer left join supplier on s_suppkey = c_custkey left join nation a on a.n_nationkey = s_nationkey left join nation b on b.n_nationkey = c_nationkey",
    "catalog_changes": "select o_orderkey, 'added' change from orders where o_orderkey % 2 <> 0 union all select o_orderkey, 'changed' from orders where o_orderkey % 10 = 0 and o_orderstatus <> 'X'",
    "one_to_one_join": "select o_orderkey, o_totalprice, l_partkey from orders join (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) r from lineitem) on l_orderkey = o_orderkey and r = 1",
    "duplicate_flags": "select doc_id, md5(text) md5, count(*) over (partition by md5(text)) > 1 duplicate from documents",
    "equivalence_classes": "with recursive li as (select distinct o_custkey, l_partkey, date_trunc('month', o_orderdate) m from orders join lineitem on l_orderkey = o_orderkey), e as (select distinct h.a, o_custkey b from li join (select l_partkey, m, min(o_custkey) a from li group by 1, 2) h using (l_partkey, m) where o_custkey <> a), u as materialized (select a, b from e union select b, a from e), c(node, root) as (select distinct a, a from u union select u.b, c.root from c join u on c.node = u.a) select node o_custkey, min(root) as class from c group by 1",
    "vintage_groups": f"with {_CARDS} select slug, grp as class, yrs as years from cards join g using (word, p_brand, p_type)",
    "vintage_pick": f"with {_CARDS}, m as (select word, p_brand, p_type, min(slug) pick from cards join g using (word, p_brand, p_type) where year = 2010 group by 1, 2, 3) select slug, case when year = 2010 then slug else coalesce(pick, slug) end picked from cards left join m using (word, p_brand, p_type)",
    "vintage_resolve": "with c as (select 'p' || lpad(p_partkey::varchar, 7, '0') slug, case when p_partkey % 3 > 0 then (2000 + p_size % 25)::int end own, case when p_partkey % 10 <> 0 then 2010 end asked from part) select slug, (case when own is not null and asked is not null and asked <> own then asked when own is not null then own else asked end)::int as year, case when own is not null and (asked is null or asked = own) then 'catalog' when asked is not null then 'text' else '' end as source, own is not null and asked is not null and asked <> own ask, case when asked is null then 0 when own = asked then 1 else -1 end as axis from c",
    "analogues": "with i as (select p_partkey id, p_brand maker, p_type cat, (p_size % 7)::varchar region, list_distinct(string_split(p_name, ' ')) g, nullif(p_size % 3, 0) color, case when p_size % 5 > 0 then p_size % 2 end sweet from part), tf as (select id, term, count(*) tf from (select p_partkey id, unnest(string_split(lower(p_name), ' ')) term from part) group by 1, 2), df as (select term, ln(((select count(*) from part) + 1)::double / (count(*) + 1)) + 1 idf from tf group by 1 having count(*) >= 2 and count(*) <= 0.5 * (select count(*) from part)), rw as (select id, term, (1 + ln(tf)) * idf w from tf join df using (term)), u as materialized (select id, term, w / sqrt(sum(w * w) over (partition by id)) w from rw), near as materialized (select a.id x, b.id y, sum(a.w * b.w) c from u a join u b on a.term = b.term and a.id <> b.id group by 1, 2), s as (select a.id query_id, b.id item_id, round(0.4::double * len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) + 0.15::double * (a.region = b.region)::int + 0.2::double * coalesce(list_avg(list_filter([case when a.color is null and b.color is null then null when a.color is null or b.color is null then 0.5 when a.color = b.color then 1 else 0 end::double, case when a.sweet is null and b.sweet is null then null when a.sweet is null or b.sweet is null then 0.5 when a.sweet = b.sweet then 1 else 0 end::double], lambda x: x is not null)), 0.5) + 0.25::double * coalesce(c, 0), 9) score from i a join i b on a.cat = b.cat and a.maker <> b.maker and a.id <> b.id left join near on x = a.id and y = b.id) select query_id, item_id, round(score, 6) score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, item_id) - 1 as rank from s where score > 0) where rank < 5",
    "star_join": "select r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where l_returnflag <> 'R' group by 1, 2",
    "set_operations": "with a as (select distinct l_partkey from lineitem where l_quantity > 45), b as (select distinct l_partkey from lineitem where l_discount > 0.08) select l_partkey, case when x and y then 'both' when x then 'large only' else 'cheap only' end as set from (select coalesce(a.l_partkey, b.l_partkey) l_partkey, a.l_partkey is not null x, b.l_partkey is not null y from a full join b using (l_partkey))",
    "merged_rows": "with n as (select o_orderkey, round(o_totalprice * case when o_orderkey % 8 = 0 then 1.1::double else 0.9::double end, 2) p from orders where o_orderkey % 4 = 0) select o_orderkey, case when p > o_totalprice then p else o_totalprice end o_totalprice, case when p > o_totalprice then 'N' else o_orderstatus end o_orderstatus from orders left join n using (o_orderkey)",
    "html_links": "select page_id, count(*) n, count(distinct h) kinds, min(h) as first from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) h from pages) group by 1",
    "page_titles": "select page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '') title, regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1) slug, nullif(regexp_extract(html, '<script[^>]*id=\"data\"[^>]*>(.*?)</script>', 1, 's'), '') as data from pages",
    "upload_listing": "with f as (select p_name, 'a/' || replace(p_name, ' ', '-') || '_' || substr(md5(p_partkey::varchar), 1, 10) || '.jpg' path from part where p_partkey % 5 <> 0) select regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as key, count(*)::int n, min(path) as first from f group by 1",
    "summary_statistics": "with a as (select l_quantity q, round(l_extendedprice, 0) p, l_extendedprice v, l_returnflag = 'R' g from lineitem), r as (select (rank() over (order by q) + (count(*) over (partition by q) - 1) / 2.0)::double x, (rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0)::double y from a) select (select round(corr(x, y), 6) from r) spearman, (select round((avg(v) filter (g) - avg(v) filter (not g)) / sqrt((var_samp(v) filter (g) + var_samp(v) filter (not g)) / 2), 6) from a) smd",
}
