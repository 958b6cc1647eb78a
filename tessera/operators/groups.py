"""Equivalence classes, duplicates and vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import key_text
from tessera.sources.writers import shared_folder

YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"


def components(edges: DataFrame, *, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Rows (node, component): the smallest node that undirected edges reach.

    Each round takes the smallest label among a node's neighbours and then that label's own label, so the labels' distance
    halves; every round is checkpointed to the folder in spark.checkpoint.dir. Self-loops are classes of their own.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = links.union(links.select("v", "u")).distinct().checkpoint()
    labels = links.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = links.join(labels, links["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = step.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = step.join(jump, step["component"] == jump["_n"], "left").select("node", F.least("component", F.coalesce("_c", "component")).alias("component"), "before").checkpoint()
        labels = new.select("node", "component")
        if new.where("component <> before").isEmpty():
            return labels
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


def equivalences(decisions: DataFrame) -> DataFrame:
    """decisions(slug_a, slug_b, decision, canonical_slug) to rows (slug, class, canonical); fails if a canonical slug is
    outside its class."""
    yes = decisions.where("decision = 'equivalent'")
    classes = components(yes, a="slug_a", b="slug_b").select(F.col("node").alias("slug"), F.col("component").alias("class"))
    named = yes.where("canonical_slug is not null and canonical_slug <> ''").select("slug_a", "canonical_slug").distinct()
    own = named.join(classes.withColumnRenamed("slug", "slug_a"), "slug_a").join(classes.select(F.col("slug").alias("canonical_slug"), F.col("class").alias("_of")), "canonical_slug", "left")
    own = own.withColumn("canonical", F.when(F.col("_of").eqNullSafe(F.col("class")), F.col("canonical_slug")).otherwise(F.raise_error(F.concat(F.lit("canonical slug outside its class: "), "canonical_slug"))))
    return classes.join(own.groupBy("class").agg(F.min("canonical").alias("canonical")), "class", "left").select("slug", "class", "canonical")


def same_class(a: DataFrame, classes: DataFrame, left: str, right: str) -> DataFrame:
    """Adds same: equal ids, or ids of one class(slug, class)."""
    x = classes.select(F.col("slug").alias(left), F.col("class").alias("_x"))
    y = classes.select(F.col("slug").alias(right), F.col("class").alias("_y"))
    return a.join(x, left, "left").join(y, right, "left").withColumn("same", (F.col(left) == F.col(right)) | F.coalesce(F.col("_x") == F.col("_y"), F.lit(False))).drop("_x", "_y")


def near_vector_edges(pairs: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of vector pairs(query_id, item_id, score) at or above a similarity."""
    return pairs.where((F.col("score") >= least) & (F.col("query_id") < F.col("item_id"))).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"))


def duplicate_flag(*keys: str) -> Column:
    """Does the key occur more than once (null keys never)."""
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    return some & (F.count("*").over(Window.partitionBy(*keys)) > 1)


def catalog_years(vintage: Column, vintages: Column) -> Column:
    """Years of a card: its own, and those of a list in JSON or of bracketed numbers."""
    many = F.transform(F.regexp_extract_all(F.coalesce(vintages, F.lit("")), F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(vintage.try_cast("int")), many))))


def vintage_groups(cards: DataFrame) -> DataFrame:
    """cards(slug, name, winery, category, grapes, years) that differ in the year only: rows (slug, group, group_years).

    group is the smallest slug. Groups of one card, or without any dated card, are left out.
    """
    dated = F.col("name").rlike(YEAR) | (F.size("years") > 0)
    keys = [key_text(F.col("winery")), key_text(F.regexp_replace(F.coalesce("name", F.lit("")), YEAR, " ")), key_text(F.col("category")), key_text(F.col("grapes"))]
    keyed = cards.select("slug", "years", F.coalesce(dated, F.lit(False)).alias("dated"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    per = keyed.groupBy("key").agg(F.min("slug").alias("group"), F.count("*").alias("n"), F.max("dated").alias("any"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("group_years")).where("n > 1 and any")
    return keyed.join(per, "key").select("slug", "group", "group_years")


def compare_year(year: Column, own: Column, group_years: Column) -> Column:
    """1 the card has the year, -1 another card of its group has it, else 0."""
    return F.when(year.isNull(), 0).when(F.array_contains(own, year), 1).when(F.coalesce(F.array_contains(group_years, year), F.lit(False)), -1).otherwise(0)


def resolve_year(year: Column, source: Column, known: Column) -> Column:
    """(year, source, ask): what to show, and whether to ask."""
    answer = lambda y, s, a: F.struct(y.cast("int").alias("year"), s.alias("source"), F.lit(a).alias("ask"))
    none, no = F.lit(None), F.lit("")
    one = F.get(known, F.lit(0))
    return (
        F.when((F.size(known) == 1) & year.isNotNull() & (year != one), answer(year, source, True))
        .when(F.size(known) == 1, answer(one, F.lit("catalog"), False))
        .when((F.size(known) > 1) & F.coalesce(F.array_contains(known, year), F.lit(False)), answer(year, source, False))
        .when(F.size(known) > 1, answer(none, no, True))
        .when(year.isNotNull(), answer(year, source, False))
        .otherwise(answer(none, no, False))
    )


def pick_vintage(asked: DataFrame, cards: DataFrame, groups: DataFrame) -> DataFrame:
    """asked(slug, year) to (slug, year, picked): the card of the group that has the year, else the slug itself."""
    g = groups.select("slug", "group")
    member = g.join(cards.select("slug", "years"), "slug").select("group", F.col("slug").alias("member"), F.explode("years").alias("year")).groupBy("group", "year").agg(F.min("member").alias("member"))
    own = cards.select("slug", F.col("years").alias("_own"))
    out = asked.join(own, "slug", "left").join(g, "slug", "left").join(member, ["group", "year"], "left")
    keep = F.col("year").isNull() | F.coalesce(F.array_contains("_own", F.col("year")), F.lit(False))
    return out.select("slug", "year", F.when(keep, F.col("slug")).otherwise(F.coalesce("member", "slug")).alias("picked"))
