"""Text, attribute, date and box functions, readers, writers and keyed rules: over the given tables, or over the hand-made cases
that say what a function has to give (their SQL is the expected table)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import attributes, dates, grapes, linalg, text
from tessera.operators import answers, catalog, pairs, recommend, search
from tessera.plans._tables import table
from tessera.sources import readers, writers
from tessera.streaming import state

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _literal(v) -> str:
    if v is None:
        return "null"
    return str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"


def _expected(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of constants; columns are names, or names with casts."""
    names = columns.split(", ")
    plain = ", ".join(n.split("::")[0] for n in names)
    cast = ", ".join(f'{n} "{n.split("::")[0]}"' if "::" in n else f'"{n}"' for n in names)
    return f"select {cast} from (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") t({plain})"


def _cases(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


# folding and tokens

# Label spellings and the catalogue's spellings that fold to one form.
SPELLINGS = [
    ("Château Tamagne", "Шато Тамань"), ("Fanagoria", "Фанагория"), ("Abrau-Durso", "Абрау-Дюрсо"), ("Myskhako", "Мысхако"),
    ("Cabernet Sauvignon", "Каберне Совиньон"), ("Pinot Noir", "Пино Нуар"), ("Chardonnay", "Шардоне"), ("Massandra", "Массандра"),
    ("Rouge", "Красное"), ("Rosé Brut", "Розовое брют"), ("Semi-Sweet White", "Полусладкое белое"),
    ("Golubitskoe Estate", "Поместье Голубицкое"), ("Portwein", "Портвейн"), ("Zweigelt", "Цвайгельт"),
]


@_query(_expected("label, same", [(a, True) for a, _ in SPELLINGS] + [("Массандра / Мысхако", False)]))
def folded_spellings(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(a, a, b) for a, b in SPELLINGS] + [("Массандра / Мысхако", "Массандра", "Мысхако")]
    return _cases(spark, "label string, a string, b string", rows).select("label", (text.fold(F.col("a")) == text.fold(F.col("b"))).alias("same"))


DIGITS = [("6EРEГ", "бEРEГ"), ("B0DKA", "BoDKA"), ("2022", "2022"), ("2022г", "2022г"), ("750ml", "750ml"), ("12%", "12%"), ("6ЕРЕГ", "бЕРЕГ"), ("В0ДА", "ВоДА"), ("M0SKVA", "MoSKVA"), ("R0 5E", "R0 5E"), ("6EРEГ 8 x", "бEРEГ 8 x")]


@_query(_expected("raw, fixed", DIGITS))
def repaired_digits(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, "raw string", [a for a, _ in DIGITS]).select("raw", text.repair_digits(F.col("raw")).alias("fixed"))


@_query(_expected("t, normal, tokens, variants", [("A Château 12 % vol", "a chateau 12 vol", "chateau|12|vol", "a chateau 12 vol"), ("MOCKBA", "mockba", "mockba", "mockba|moskva"), ("вино", "vino", "vino", "vino"), ("ЩИ", "shchi", "shchi", "shchi")]))
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    first = F.when(t == "A Château 12 % vol", F.array(text.normalize(t))).otherwise(text.variants(t))
    return _cases(spark, "t string", ["A Château 12 % vol", "MOCKBA", "вино", "ЩИ"]).select("t", text.normalize(t).alias("normal"), F.array_join(text.tokens(t), "|").alias("tokens"), F.array_join(first, "|").alias("variants"))


@_query("select doc_id, array_to_string(list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) > 1), lambda w: w[1:5])).list_sort(), ' ') stems from documents")
def word_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems of the Latin letters of a text, without the phonetic folding."""
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]", " ")
    words = F.filter(F.split(text.squeeze(clean), " "), lambda w: F.length(w) > 1)
    stems = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 5))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(stems, " ").alias("stems"))


@_query("with w as (select p_partkey, string_split(p_name, ' ') w from part), r as (select p_partkey, w, list_transform(w, lambda x: x[1:2]) a from w) select p_partkey, array_to_string(list_filter([w[1][1:2] || w[2]], lambda x: regexp_matches(x, '^[a-z]{4,}$')), '|') joined from w")
def joined_words(spark: SparkSession, sf: str) -> DataFrame:
    """Two parts of a name that together are in a vocabulary of one word, made of them."""
    words = F.split("p_name", " ")
    pair = F.array(F.substring(words[0], 1, 2), words[1])
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.joined_words(pair, F.array(F.concat(pair[0], pair[1]))), "|").alias("joined"))


@_query("select event_id, case when event_id % 10 = 1 and event_id % 100 <> 11 then 'one' when event_id % 10 between 2 and 4 and event_id % 100 not between 12 and 14 then 'few' else 'many' end as plural, '+7 9' || lpad((event_id % 100)::varchar, 2, '0') || ' ' || lpad((user_id % 1000)::varchar, 3, '0') || '-45-67' phone from events")
def plurals_and_phones(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("8 (9"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit(") "), F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"), F.lit("-4567"))
    return table(spark, sf, "events").select("event_id", text.plural(F.col("event_id"), "one", "few", "many").alias("plural"), text.phone(raw).alias("phone"))


@_query("select p_partkey, list_reduce(list_prepend(2166136261::hugeint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::hugeint)), lambda h, c: (xor(h::bigint, c::bigint)::hugeint * 16777619) % 4294967296)::bigint hash from part")
def name_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"))


@_query("select p_partkey, case when length(p_name) > 9 then p_name else p_name || chr(10) || p_type end as \"block\" from part where length(p_type) + length(p_name) <= 1000 and length(p_name) <= 1000")
def text_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Name and type as the lines of a block: the type only beside a short name."""
    most = F.when(F.length("p_name") > 9, 1).otherwise(2)
    lines = F.slice(F.array(F.concat(F.lit("  "), F.col("p_name")), F.col("p_type"), F.lit("")), F.lit(1), most)
    return table(spark, sf, "part").select("p_partkey", text.block(lines, 3, 1000).alias("block"))


# attributes and varieties

ATTRIBUTES = [
    ("Портвейн красный Алушта", "red", None, False, True), ("Белое полусладкое", "white", "semisweet", None, None), ("Красное белое", None, None, None, None),
    ("Экстра брют белое", "white", "extra_brut", None, None), ("Игристое розовое брют", "rose", "brut", True, None), ("белых сортов винограда", None, None, None, None),
    ("Красная Горка белое", "white", None, None, None), ("Красностоп", None, None, None, None), ("полусладкок", None, "semisweet", None, None),
    ("розов", "rose", None, None, None), ("красног", None, None, None, None),
]


@_query(_expected("name, color, sweetness, sparkling, fortified", ATTRIBUTES))
def word_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, "name string", [r[0] for r in ATTRIBUTES]).withColumn("a", attributes.from_tokens(text.fold_tokens(F.col("name")))).select("name", "a.*")


SLUGS = [("x-beloe-polusladkoe-125", "semisweet", False), ("agora-vintage-blanc-de-blancs-extra-brut", None, False), ("fanagoriya-ekstra-bryut-beloe-rislinng", None, True), ("kokur-beloe-ekstra-bryut", "extra_brut", True), ("a-suhoe-vino", None, False), ("igristoe-krasnoe-sladkoe", "sweet", True)]


@_query(_expected("slug, sweetness, sparkling", SLUGS))
def slug_attributes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("slug")
    return _cases(spark, "slug string", [r[0] for r in SLUGS]).select("slug", attributes.sweetness_from_slug(s).alias("sweetness"), attributes.sparkling_from_card(s, F.lit("")).alias("sparkling"))


@_query(_expected("name, color, sweetness, sparkling, colors, word", [("Мускат розовое", "red", "dry", True, "red,rose", False), ("белое", "red", "dry", True, "red,white", True), ("Портвейн", "red", "dry", False, "red", False), ("полусладкое", "red", "semisweet", True, "red", True)]))
def card_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Category before name for the colour, name before slug for the sweetness; is the name's last word an attribute?"""
    rows = _cases(spark, "name string", ["Мускат розовое", "белое", "Портвейн", "полусладкое"]).withColumn("w", text.fold_tokens(F.col("name")))
    a = attributes.from_card(F.col("w"), F.lit("Красное"), F.lit("x-krasnoe-suhoe"), F.lit("Вкус игристого вина"))
    word = attributes.is_attribute_word(F.get("w", F.lit(0)))
    return rows.withColumn("a", a).select("name", "a.color", "a.sweetness", "a.sparkling", F.array_join("a.colors", ",").alias("colors"), word.alias("word"))


@_query("with v as (select p_partkey, [null, 'dry', 'semidry', 'sweet', 'semisweet', 'brut', 'extra_brut'][p_partkey % 7 + 1] a, [null, 'dry', 'semidry', 'sweet', 'semisweet', 'brut', 'extra_brut'][p_size % 7 + 1] b, [null, 'red', 'white'][p_partkey % 3 + 1] c, [null, 'red', 'white'][p_size % 3 + 1] d from part), w as (select p_partkey, case when (a, b) in (('dry', 'semidry'), ('sweet', 'semisweet'), ('brut', 'extra_brut')) then 0 when a is null or b is null then 0 when a = b then 1 else -1 end sweet, case when c is null or d is null then 0 when c = d then 1 else -1 end color from v) select p_partkey, sweet, color, sweet as style from w")
def axis_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda k, vs: F.element_at(F.array(F.lit(None), *[F.lit(v) for v in vs]), (k + 1).cast("int"))
    kinds, colors = ("dry", "semidry", "sweet", "semisweet", "brut", "extra_brut"), ("red", "white")
    a, b = of(F.col("p_partkey") % 7, kinds), of(F.col("p_size") % 7, kinds)
    c, d = of(F.col("p_partkey") % 3, colors), of(F.col("p_size") % 3, colors)
    label = F.struct(a.alias("sweetness"), F.lit(None).cast("boolean").alias("sparkling"))
    card = F.struct(b.alias("sweetness"), F.lit(True).alias("sparkling"), d.alias("color"), F.array_compact(F.array(d)).alias("colors"))
    return table(spark, sf, "part").select("p_partkey", attributes.compare_sweetness(a, b).alias("sweet"), attributes.compare_color(c, card).alias("color"), attributes.compare_style(label, card).alias("style"))


_NAME = grapes.folded_name
FIELDS = [("Рислинг, Шираз", "|".join(sorted([_NAME("Рислинг"), _NAME("Сира")]))), ("Белые сорта винограда", ""), ("Бьянка", _NAME("Бианка")), ("Пино черный и Мерло", "|".join(sorted([_NAME("Пино Нуар"), _NAME("Мерло")])))]


@_query(_expected("field, names", FIELDS))
def grape_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, "field string", [f for f, _ in FIELDS]).select("field", F.array_join(grapes.parse(F.col("field")), "|").alias("names"))


FOUND = [("Sauvignon Blanc Riesling", "|".join(sorted([_NAME("Совиньон Блан"), _NAME("Рислинг")]))), ("Cabernet", _NAME("Каберне")), ("Каберне Совиньен", _NAME("Каберне Совиньон")), ("Восторг", ""), ("Shiraz", "")]


@_query(_expected("t, names", FOUND))
def grapes_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    cards = _cases(spark, "grapes string, winery string", [("Рислинг; Совиньон Блан", "Alma Valley"), ("Каберне Совиньон", "Азюр"), ("Восторг", "Восторг")])
    phrases = [tuple(r) for r in grapes.vocabulary(cards).collect()]  # a dictionary of names
    texts = _cases(spark, "t string", [t for t, _ in FOUND]).withColumn("w", text.fold_tokens(F.col("t")))
    return grapes.find(texts, phrases, words_col="w").select("t", F.array_join("grapes", "|").alias("names"))


@_query("select p_partkey, case when p_size % 4 = 0 then 0 when p_name = (p_type || ' x') or list_has_all(string_split(p_name, ' '), [string_split(p_name, ' ')[1]]) and p_size % 4 = 1 then 1 else -1 end as match, case when length(string_split(p_name, ' ')[1]) >= 5 then string_split(p_name, ' ')[1] else '' end begins from part")
def grape_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    """A name against its first word, against another word, and against nothing."""
    words = F.split("p_name", " ")
    card = F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 4 == 1, F.array(words[0])).otherwise(F.array(F.lit("none such")))
    begins = grapes.in_name(F.array(F.concat(words[0], F.lit("s"))), F.array(words[0], F.lit("two words")))
    return table(spark, sf, "part").select("p_partkey", grapes.compare(F.array("p_name"), card).alias("match"), F.array_join(begins, "|").alias("begins"))


@_query("select p_partkey, upper(p_name[1]) \"initial\", case when p_size % 2 = 0 then '+7 (9' || lpad((p_size % 100)::varchar, 2, '0') || ') •••-••-' || lpad((p_partkey % 100)::varchar, 2, '0') else '' end masked, '(9' || lpad((p_size % 100)::varchar, 2, '0') || ') 12' typed, replace(p_name, ' ', '_') || '_' || p_size || '.jpg' safe from part")
def small_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Initials, phones as typed and as shown, and names for files."""
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    digits = F.concat(F.lit("9"), two(F.col("p_size")), F.lit("12345"), two(F.col("p_partkey")))
    shown = F.when(F.col("p_size") % 2 == 0, digits).otherwise(F.substring(digits, 1, 7))
    return table(spark, sf, "part").select("p_partkey", text.initial(F.col("p_name")).alias("initial"), text.masked_phone(shown).alias("masked"), text.phone_input(F.substring(digits, 1, 5)).alias("typed"), text.file_safe(F.concat("p_name", F.lit("/"), "p_size", F.lit(".jpg"))).alias("safe"))


KINDS = [("Красное", "Мерло", "dry", "16–18°", "Красное|dry|Мерло"), ("Белое", "Кокур", "sweet", "10–12°", "Белое|sweet|Мерло"), ("Розовое", "x", None, "8–10°", "Розовое|Мерло"), ("Белое", "Игристое", "dry", "6–8°", "Белое|dry|Мерло"), ("Красное", "x", "brut", "6–8°", "Красное|brut|Мерло"), ("Оранжевое", "x", "dry", "12–14°", "Оранжевое|dry|Мерло"), ("", "x", None, None, "Мерло")]


@_query(_expected("category, name, sweetness, serving, tags", KINDS))
def card_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cases(spark, "category string, name string, sweetness string", [r[:3] for r in KINDS])
    c = F.col
    return rows.select("category", "name", "sweetness", text.serving_temperature(c("category"), c("name"), c("sweetness")).alias("serving"), F.array_join(text.card_tags(c("category"), c("sweetness"), F.lit("Мерло, Белые сорта винограда")), "|").alias("tags"))


NAMES = [("plain.jpg", True), ("Вино.jpg", True), ("Р’РёРЅРѕ.jpg", True), ("другое.jpg", False)]


@_query(_expected("listed, known", NAMES))
def spoilt_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names as listed, one of them read in a wrong code page, against the names of an annotation."""
    keys = text.name_keys(F.col("listed"))
    return _cases(spark, "listed string", [n for n, _ in NAMES]).select("listed", F.arrays_overlap(keys, F.array(F.lit("plain.jpg"), F.lit("Вино.jpg"))).alias("known"))


# coverage and signals


@_query()
def word_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts (key divisible by 20) as read words against all names of their type: exact and nearly equal words."""
    p = table(spark, sf, "part").select("p_type", F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))

    def covered(x: Column, y: Column) -> dict[str, Column]:
        asked, own = F.split(x, " "), F.split(y, " ")
        weights = F.map_from_arrays(F.array_distinct(own), F.transform(F.array_distinct(own), lambda w: F.length(w).cast("double")))
        return {"coverage": F.round(search.coverage(asked, own, weights), 6)}

    rows = pairs.scored_pairs(p.where("b % 20 = 0").select("p_type", F.col("b").alias("a"), F.col("y").alias("x")), p, "p_type", covered)
    return rows.withColumnsRenamed({"a": "query_id", "b": "item_id"})


@_query()
def card_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Seven signals of a read name and the card of the next part, which is missing for every tenth."""
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    color = lambda k: F.when(k % 3 > 0, F.when(k % 3 == 1, "red").otherwise("white"))
    attrs = F.struct(color(F.col("p_size")).alias("color"), F.when(F.col("p_size") % 2 == 0, "dry").alias("sweetness"), F.lit(None).cast("boolean").alias("sparkling"))
    read = p.select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") + 1).alias("item_id"), words.alias("tokens"), attrs.alias("attrs"), F.slice(words, 1, 1).alias("grapes"))
    own = F.struct(color(F.col("p_size") + 1).alias("color"), F.lit("dry").alias("sweetness"), F.lit(True).alias("sparkling"), F.array_compact(F.array(color(F.col("p_size") + 1))).alias("colors"))
    cards = p.where("p_partkey % 10 > 0").select(F.col("p_partkey").alias("item_id"), F.slice(words, 1, 1).alias("disc"), F.create_map(words[0], F.lit(1.5)).alias("disc_weights"), words.alias("name"), F.create_map(words[0], F.lit(2.0)).alias("name_weights"), F.slice(words, 2, 1).alias("winery"), own.alias("attrs"), F.slice(words, 1, 1).alias("grapes"))
    out = answers.signals(read, cards)
    return out.select("query_id", "item_id", *[F.round(c, 6).alias(c) if c in ("disc_hit", "name_cover") else c for c in answers.SIGNALS])


@_query("with u as (select user_id, p_partkey item_id, string_split(p_name, ' ') g, (p_size % 7) r from events join part on p_partkey = event_id % 200 where user_id % 20 = 0), own as (select distinct * from u), s as (select a.user_id, b.p_partkey item_id, max(3 * len(list_intersect(list_distinct(a.g), list_distinct(string_split(b.p_name, ' ')))) + (a.r = b.p_size % 7)::int) sc from own a join part b on (a.r = b.p_size % 7 or len(list_intersect(a.g, string_split(b.p_name, ' '))) > 0) and a.item_id <> b.p_partkey group by 1, 2), n as (select s.* from s where not exists (select 1 from own o where o.user_id = s.user_id and o.item_id = s.item_id)) select user_id, item_id, sc::int score, rank::int as rank from (select *, row_number() over (partition by user_id order by sc desc, item_id) - 1 as rank from n) where rank < 5")
def known_similar(spark: SparkSession, sf: str) -> DataFrame:
    """What users (key divisible by 20) would like, from the parts they met."""
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.split("p_name", " ").alias("grapes"), (F.col("p_size") % 7).alias("region"))
    met = table(spark, sf, "events").where("user_id % 20 = 0").select("user_id", (F.col("event_id") % 200).alias("item_id")).distinct()
    return recommend.known_similar(met.join(items, "item_id"), items, 5).select("user_id", "item_id", "score", "rank")


# dates and boxes


@_query("with e as (select event_id, ts, (ts + interval 3 hours)::date d, (timestamp '2024-01-20 12:00:00' + interval 3 hours)::date t from events) select event_id, case when t = d then 'today' when t - d = 1 then 'yesterday' when t - d < 7 then (t - d)::varchar || ' days ago' else strftime(d, '%Y-%m-%d') end label, epoch(timestamp '2024-01-20 12:00:00') - floor(epoch(ts)) >= 86400 as expired, (d + 1)::timestamp - interval 3 hours next_day from e")
def day_labels(spark: SparkSession, sf: str) -> DataFrame:
    ts, now = F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", dates.relative_label(dates.day_key(ts), dates.day_key(now)).alias("label"), dates.expired(ts, now, 86_400).alias("expired"), dates.next_day_start(ts).alias("next_day"))


@_query("select p_partkey, case when p_size % 3 = 0 then 1990 + p_size % 30 when p_size % 3 = 1 then 2000 + p_size % 25 end::int as year from part")
def first_years(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_name"), F.lit(" "), (1990 + F.col("p_size") % 30).cast("string"))).otherwise(F.col("p_name"))
    slug = F.when(F.col("p_size") % 3 < 2, F.concat(F.lit("x-12345-"), (2000 + F.col("p_size") % 25).cast("string")))
    return table(spark, sf, "part").select("p_partkey", dates.first_year(name, slug).alias("year"))


@_query("with k as (select o_orderkey, (o_orderkey % 50 / 100.0)::double x, (o_custkey % 50 / 100.0)::double y from orders), b as (select *, greatest(0, least(x + 0.4, 0.75) - greatest(x, 0.25)) * greatest(0, least(y + 0.3, 0.75) - greatest(y, 0.25)) ov from k) select o_orderkey, case when ov > 0 then round(greatest(0, least(1, (x - 0.25) / 0.5)), 9) end tx0, case when ov > 0 then round(greatest(0, least(1, (y + 0.3 - 0.25) / 0.5)), 9) end ty1, round(greatest(0, x - 0.04), 9) gx0, round(least(1, y + 0.33), 9) gy1, round(1 - least(1, sqrt(pow(x + 0.2 - 0.5, 2) + pow(y + 0.15 - 0.5, 2))), 6) weight, round(2 * x / (1 + 0.1 * x), 9) px, x <= 0.5 / 1.0 and 2 * (x + 0.4) / (1 + 0.1 * (x + 0.4)) <= 1 and (y + 0.3) / (1 + 0.1 * x) <= 1 and o_orderkey % 30 >= 12 sane from b")
def box_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in a rectangle's coordinates, widened, weighed by their place, and projected."""
    x, y = F.col("o_orderkey") % 50 / 100.0, F.col("o_custkey") % 50 / 100.0
    a, rect = linalg.box(x, y, x + 0.4, y + 0.3), linalg.box(F.lit(0.25), F.lit(0.25), F.lit(0.75), F.lit(0.75))
    h = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 1, 0, 0.1, 0, 1)])
    t, g = linalg.transfer(a, rect), linalg.grow(a, 0.1)
    weight = linalg.central_weight(a, 1 / F.sqrt(linalg.area(a)))
    sane = linalg.projection_is_sane(h, a, (F.col("o_orderkey") % 30).cast("int"), most_area=1.0)
    point = linalg.project(h, a["x0"], a["y0"])["x"]
    return table(spark, sf, "orders").select("o_orderkey", F.round(t["x0"], 9).alias("tx0"), F.round(t["y1"], 9).alias("ty1"), F.round(g["x0"], 9).alias("gx0"), F.round(g["y1"], 9).alias("gy1"), F.round(weight, 6).alias("weight"), F.round(point, 9).alias("px"), sane.alias("sane"))


# readers and writers: written to the shared folder and read again


def _folder(spark: SparkSession) -> str:
    path = f"{writers.shared_folder(spark)}/tessera-files-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@_query("select p_partkey id, p_name as name, trim(p_brand || ' ') maker from part")
def csv_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as CSV, each written twice with blanks around a field: read trimmed, renamed, unique."""
    path = _folder(spark)
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("p_brand"))
    p.union(p).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv(spark, path, "p_partkey long, p_name string, p_brand string", rename={"p_partkey": "id", "p_name": "name", "p_brand": "maker"}, key="id")


@_query("select o_orderkey query_id, o_orderstatus || '/' || o_custkey image_path, o_custkey % 3 <> 0 has_file from orders")
def tsv_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries as TSV, and which of them have a file."""
    path = _folder(spark)
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat_ws("/", "o_orderstatus", "o_custkey").alias("image_path"))
    q.write.option("header", True).option("sep", "\t").csv(path)
    rows = readers.read_tsv(spark, path, "query_id long, image_path string")
    files = table(spark, sf, "orders").where("o_custkey % 3 <> 0").select(F.concat_ws("/", "o_orderstatus", "o_custkey").alias("image_path")).distinct()
    there, missing = readers.with_files(rows, files, "image_path")
    return there.withColumn("has_file", F.lit(True)).union(missing.withColumn("has_file", F.lit(False)))


@_query("select n_regionkey as \"key\", count(*) n, count(*) filter (n_nationkey % 7 = 0) refs, min('g' || n_nationkey % 4) first_group from nation group by 1")
def image_folders(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of small files, one for each nation, in a folder for each region."""
    path = _folder(spark)
    n = table(spark, sf, "nation")
    name = F.concat(F.lit("g"), F.col("n_nationkey") % 4, F.when(F.col("n_nationkey") % 7 == 0, "_ref.jpg").otherwise("_img.jpg"))
    n.select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("key"), "n_nationkey", name.alias("name")).repartition("n_nationkey").write.partitionBy("key", "n_nationkey", "name").text(path)
    rows = readers.directory(spark, path)
    parts = F.split("path", "/")
    of = lambda i: F.split(F.element_at(parts, i), "=")[1]
    return rows.groupBy(of(-4).cast("int").alias("key")).agg(F.count("*").alias("n"), F.count_if(of(-2).contains("ref")).alias("refs"), F.min(F.split(of(-2), "_")[0]).alias("first_group"))


@_query("select 'f/' || o_orderkey path, case when o_custkey % 4 = 0 then 'unknown:w' || o_custkey else 's' || o_custkey end true_id, o_custkey % 4 <> 0 known from orders where o_orderkey % 6 <> 0")
def manifest_queries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("f/"), "o_orderkey").alias("path"), F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), "o_custkey")).alias("true_slug"), F.lit("g").alias("group"), F.concat(F.lit("w"), "o_custkey").alias("wine_id"), F.lit("x").alias("source"), F.when(F.col("o_orderkey") % 6 == 0, "multi").alias("note"))
    return readers.manifest(rows, files=rows.select("path")).select("path", "true_id", "known")


@_query("select url, regexp_extract(url, '/([^/?#]+)/?(?:[?#].*)?$', 1) slug, '2024-01-0' || (1 + page_id % 9) lastmod from pages where url is not null and url <> ''")
def sitemap_rows(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.concat(F.lit("<urlset><url>\n <loc> "), F.col("url"), F.lit(" </loc><lastmod>2024-01-0"), 1 + F.col("page_id") % 9, F.lit("</lastmod></url></urlset>"))
    return readers.sitemap(table(spark, sf, "pages").where("url is not null and url <> ''").select(entry.alias("value")))


@_query("select p_partkey, case when p_partkey % 5 > 0 then p_name end card_name, case when p_partkey % 5 > 0 then p_brand end card_maker from part")
def page_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose data are a flat array of references; a card that isn't the page's own is left out."""
    slug = F.concat(F.lit("p"), "p_partkey")
    own = F.when(F.col("p_partkey") % 5 > 0, slug).otherwise("other")
    flat = F.concat(F.lit('[["Ref",1],{"name":2,"maker":3,"slug":4,"none":-1},"'), F.col("p_name"), F.lit('","'), F.col("p_brand"), F.lit('","'), own, F.lit('"]'))
    html = F.concat(F.lit('<html><script type="x" id="data">'), flat, F.lit("</script></html>"))
    rows = table(spark, sf, "part").select("p_partkey", slug.alias("slug"), html.alias("html"))
    return readers.page_cards(rows, script_id="data", fields={"name": "$.name", "maker": "$.maker", "slug": "$.slug"}, slug="slug").select("p_partkey", "card_name", "card_maker")


@_query("select 'i' || c_custkey file, ['bottle', 'label'][c_custkey % 2 + 1] category, (c_custkey % 10)::double x0, 5.0::double y0, (c_custkey % 10 + 20)::double x1, 35.0::double y1 from customer where c_custkey % 3 < 2")
def annotation_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A COCO document of one half of the pictures and a box CSV of the other, as rows of one form."""
    c = table(spark, sf, "customer")
    folder = _folder(spark)
    doc = c.where("c_custkey % 3 = 0").agg(
        F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("i"), "c_custkey").alias("file_name"))).alias("images"),
        F.collect_list(F.struct(F.col("c_custkey").alias("image_id"), (F.col("c_custkey") % 2).alias("category_id"), F.array((F.col("c_custkey") % 10).cast("double"), F.lit(5.0), F.lit(20.0), F.lit(30.0)).alias("bbox"))).alias("annotations"),
    )  # an annotation file is one document
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit("bottle").alias("name")), F.struct(F.lit(1).cast("long").alias("id"), F.lit("label").alias("name")))
    doc.withColumn("categories", kinds).coalesce(1).write.json(f"{folder}/coco")
    x = F.col("c_custkey") % 10
    c.where("c_custkey % 3 = 1").select(F.concat(F.lit("i"), "c_custkey").alias("image"), x.alias("xmin"), F.lit(5).alias("ymin"), (x + 20).alias("xmax"), F.lit(35).alias("ymax"), F.when(F.col("c_custkey") % 2 == 0, "bottle").otherwise("label").alias("label")).write.option("header", True).csv(f"{folder}/csv")
    rows = readers.coco(spark, f"{folder}/coco", {"bottle", "label"}).unionByName(readers.box_csv(spark, f"{folder}/csv"))
    return rows.select("file", "category", "box.*")


@_query("select o_orderkey, case when o_orderkey % 7 between 1 and 5 then (o_orderkey % 7)::double end rating, case when o_custkey % 40 between 1 and 29 then (o_custkey % 40)::double end alcohol, (8 + o_orderkey % 3)::varchar || '-' || (12 + o_orderkey % 3)::varchar temperature, least(8, o_orderkey % 12) dishes from orders")
def portal_replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    dishes = F.slice(F.array(*[F.lit(f"d{i}") for i in range(12)]), F.lit(1), (k % 12).cast("int"))
    reply = F.to_json(F.struct((k % 7).cast("double").alias("rating"), (F.col("o_custkey") % 40).cast("double").alias("alcohol"), F.concat(F.lit("serve at "), (8 + k % 3).cast("string"), F.lit("-"), (12 + k % 3).cast("string"), F.lit(" C")).alias("temperature"), dishes.alias("dishes")))
    p = readers.portal(reply)
    return table(spark, sf, "orders").select("o_orderkey", p["rating"].alias("rating"), p["alcohol"].alias("alcohol"), p["temperature"].alias("temperature"), F.size(p["dishes"]).cast("long").alias("dishes"))


@_query("select p_partkey, p_name as text, round(case when p_size % 4 = 0 then 1.0 else (0.5 + p_size % 4 / 10.0) end::double, 6) confidence, round(least(1, (p_size * 29)::double / 1000), 6) x1, case when p_size % 3 = 0 then 'few lines' when round(case when p_size % 4 = 0 then 1.0 else (0.5 + p_size % 4 / 10.0) end::double, 6) < 0.65 then 'weak lines' end reason, (case when p_size % 3 = 0 then 1 else 3 end * case when least(1, (p_size * 29)::double / 1000) / 2 between 0.17 and 0.33 then 1 else 0 end)::int in_span from part")
def read_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of a reader: lines with confidence and box, which reader is asked next, and lines in a span."""
    s = F.col("p_size")
    words = F.when(s % 4 > 0, F.array(F.struct((0.5 + s % 4 / 10.0).cast("double").alias("confidence")))).otherwise(F.array(F.struct(F.lit(None).cast("double").alias("confidence"))))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.struct(F.col("p_name").alias("text"), words.alias("words"), F.array(corner(F.lit(0), F.lit(0)), corner(s * 29, F.lit(50))).alias("vertices"))
    block = F.struct(F.when(s % 3 == 0, F.array(line)).otherwise(F.array(line, line, line)).alias("lines"))
    lines = readers.ocr_lines(F.to_json(F.struct(F.array(block).alias("blocks"))), F.lit(1000), F.lit(1000))
    from tessera.operators.decisions import in_span, route_reader

    rows = table(spark, sf, "part").withColumn("lines", lines)
    first = F.get("lines", F.lit(0))
    return rows.select("p_partkey", first["text"].alias("text"), F.round(first["confidence"], 6).alias("confidence"), F.round(first["box"]["x1"], 6).alias("x1"), route_reader(F.col("lines"), confidence=0.65).alias("reason"), F.size(in_span(F.col("lines"), F.lit(0.2), F.lit(0.3))).alias("in_span"))


@_query("select event_id, case when event_id % 4 > 0 then (event_id % 5)::int end choice, case when event_id % 4 > 0 then greatest(0, least(1, (event_id % 15 / 10.0)::double)) end confidence from events")
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of a model with fences and talk around the braces; every fourth has none."""
    body = F.concat(F.lit('Sure:\n```json\n{"choice": '), F.col("event_id") % 5, F.lit(', "confidence": '), (F.col("event_id") % 15 / 10.0).cast("double").cast("string"), F.lit("}\n```"))
    r = readers.model_reply(F.when(F.col("event_id") % 4 > 0, body).otherwise("I can't say"))
    return table(spark, sf, "events").select("event_id", r["choice"].alias("choice"), F.when(F.col("event_id") % 4 > 0, r["confidence"]).alias("confidence"))


@_query("select l_orderkey query_id, l_partkey item_id, count(*) n, 3 feature_version from lineitem group by 1, 2")
def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate rows as JSON lines with a field that the schema doesn't have."""
    path = _folder(spark)
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), F.lit(3).alias("feature_version"), F.lit("x").alias("unknown")).write.json(path)
    rows = readers.feature_log(spark, path, "query_id long, item_id long, feature_version int", {2, 3})
    return rows.groupBy("query_id", "item_id").agg(F.count("*").alias("n"), F.max("feature_version").alias("feature_version"))


@_query("with t as (select vec_id from embeddings) select vec_id item_id, label, round(list_dot_product(embedding::double[], embedding::double[]), 5) self from embeddings")
def saved_index(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    writers.save_index(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "item_id"), path)
    return writers.load_index(spark, path).select("item_id", "label", F.round(linalg.dot(F.col("embedding"), F.col("embedding")), 5).alias("self"))


@_query("select o_orderkey, case when o_orderkey % 3 = 0 then 'kept' when o_orderkey % 2 = 0 then 'done' else 'to do' end state from orders")
def resumed_work(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the orders are done and logged; of those a third is kept, the rest is to be done again or for the first time."""
    path = _folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey")
    writers.append_log(o.where("o_orderkey % 4 = 0"), path)
    writers.append_log(o.where("o_orderkey % 4 = 2 or o_orderkey % 3 = 0"), path)
    done = spark.read.schema("o_orderkey long").json(path)
    todo = writers.resume(o, done, "o_orderkey").withColumn("state", F.lit("to do"))
    old = done.distinct().withColumn("state", F.when(F.col("o_orderkey") % 3 == 0, "kept").otherwise("done"))
    return writers.carry_over(old, old, todo, "o_orderkey")


@_query("select l_returnflag, l_linenumber % 2 = 0 good, count(*) n from lineitem group by 1, 2")
def split_outputs(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber")
    writers.write_split(li, F.col("l_linenumber") % 2 == 0, f"{folder}/good", f"{folder}/rest")
    read = lambda p, g: spark.read.csv(f"{folder}/{p}", schema="l_returnflag string, l_linenumber int", header=True).groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("good", F.lit(g))
    return read("good", True).unionByName(read("rest", False))


@_query("select p_partkey, case when p_size % 5 = 0 then 'skip' when p_size % 7 = 0 then 'skip' when 70 + p_size >= 90 then 'train-known' when 70 + p_size >= 75 then 'check' else 'train-unknown' end decision, p_size % 3 = 0 or p_size % 4 = 0 holdout from part")
def import_decisions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    d = catalog.import_decision(70 + s, in_test=s % 5 == 0, excluded=s % 7 == 0)
    path = F.concat_ws("/", F.when(s % 3 == 0, "test").otherwise("train"), F.when(s % 4 == 0, "held").otherwise("open"), "p_name")
    return table(spark, sf, "part").select("p_partkey", d["decision"].alias("decision"), catalog.is_holdout(path, ["test/"], ["held"]).alias("holdout"))


@_query("select p_type, count(*) n from part where contains(lower(p_name || ' ' || p_brand), 'ring') group by 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.status_counts(table(spark, sf, "part"), "Ring", ["p_name", "p_brand"], "p_type")


@_query("select 'present' state, count(*) n from orders where o_custkey % 2 = 0 union all select 'removed', count(*) from orders where o_custkey % 2 = 1 union all select 'upserted', count(*) from orders")
def synced_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    present = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey")).union(o.where("o_custkey % 2 = 0").select("o_custkey")).distinct()
    kept, removed = catalog.sync(o, present, "o_custkey")
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
    return n(kept, "present").union(n(removed, "removed")).union(n(catalog.upsert(o, removed, "o_orderkey"), "upserted"))


# keyed rules


def _folded(rule: str, first: str, step: str, out: str) -> str:
    """SQL that runs a rule over each user's events in order, one recursion step for an event of every user."""
    return f"with recursive e as materialized (select *, epoch(ts) t, row_number() over (partition by user_id order by ts, event_id) rn from events), s as (select user_id, 0::bigint rn, -1::bigint event_id, {first} from (select distinct user_id from events) union all select e.user_id, e.rn, e.event_id, {step} from s join e on e.user_id = s.user_id and e.rn = s.rn + 1) select event_id, {out} from s where rn > 0"


_OPEN = "(s.until is not null and t < s.until)"
_ROW = "(case when event_type = 'error' then s.row_ + 1 else 0 end)"


@_query(_folded("breaker", "0 row_, null::double until, '' call", f"case when {_OPEN} then s.row_ when {_ROW} >= 2 then 0 else {_ROW} end, case when {_OPEN} then s.until when {_ROW} >= 2 then t + 86400 end, case when {_OPEN} then 'open' when event_type = 'error' then 'failed' else 'ok' end", "call"))
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error").select("user_id", "event_id", "ts", "failed")
    return state.circuit_breaker(e, key="user_id", ts="ts", order="event_id", failed="failed", failures=2, cooldown_seconds=86_400).select("event_id", "call")


_FRESH = "(s.at_ is not null and t - s.at_ < 172800)"


@_query(_folded("cache", "null::double at_, '' answer", f"case when {_FRESH} or event_type = 'error' then s.at_ else t end, case when {_FRESH} then 'cached' when event_type = 'error' then case when s.at_ is null then 'error' else 'stale' end else 'fresh' end", "answer"))
def cache_answers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error").select("user_id", "event_id", "ts", "failed")
    return state.cache_reads(e, key="user_id", ts="ts", order="event_id", failed="failed", ttl_seconds=172_800).select("event_id", "answer")


_GAIN = "(s.xp + e.event_id % 50)"


@_query(_folded("experience", "0::bigint xp, 0 lv", f"({_GAIN} + case when s.lv < 1 and {_GAIN} >= 100 then 10 else 0 end)::bigint, case when s.lv < 1 and {_GAIN} >= 100 then 1 else s.lv end", "xp"))
def experience_points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("gain", F.col("event_id") % 50).select("user_id", "event_id", "ts", "gain")
    return state.experience(e, key="user_id", order=["ts", "event_id"], gain="gain", levels=[100], bonus=10).select("event_id", "xp")


@_query(_folded("store", "0::bigint held, '' outcome", "case when e.event_id % 9 >= 3 and s.held + e.event_id % 9 > 20 then s.held when e.event_id % 9 < 3 and s.held < 4 then s.held when e.event_id % 9 >= 3 then s.held + e.event_id % 9 else s.held - 4 end, case when e.event_id % 9 >= 3 and s.held + e.event_id % 9 > 20 then 'full' when e.event_id % 9 < 3 and s.held < 4 then 'short' else 'ok' end", "outcome"))
def store_moves(spark: SparkSession, sf: str) -> DataFrame:
    """One item in a store of twenty: puts of three to eight, takes of four."""
    n = F.when(F.col("event_id") % 9 >= 3, F.col("event_id") % 9).otherwise(F.lit(-4))
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", F.lit("cask").alias("item"), n.alias("n"))
    return state.inventory(e, key="user_id", order=["ts", "event_id"], item="item", n="n", capacity=20).select("event_id", "outcome")


@_query()
def push_plans(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 20).cast("int"))).alias("made"), "event_type")
    return state.plan_pushes(e, user="user_id", ts="ts", made="made", name="event_type", order="event_id").select("event_id", "plan")


@_query("with e as (select event_id, ts due, event_id % 11 = 0 sent, (event_id % 8)::int att, case when event_id % 3 = 0 then timestamp '2024-01-20' - to_minutes((event_id % 200)::int) end lt, timestamp '2024-01-20' - to_days((event_id % 120)::int) seen, timestamp '2024-01-20' nw from events) select event_id, case when seen < nw - interval 90 days then 'expired' when sent or att >= 6 or due < nw - interval 30 days then 'drop' when due > nw then 'wait' when lt is not null and lt + to_milliseconds(least(86400000, 60000 * pow(2, att))::bigint) > nw then 'retry later' else 'send' end as action from e")
def reminder_actions(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("remind_at"),
        (k % 11 == 0).alias("sent"),
        (k % 8).alias("attempts"),
        F.when(k % 3 == 0, now - F.make_dt_interval(mins=(k % 200).cast("int"))).alias("last_try"),
        (now - F.make_dt_interval(days=(k % 120).cast("int"))).alias("device_seen"),
    )
    return state.due_reminders(rows, now).select("event_id", "action")


@_query("select e.event_id, (select max(s.ts) from events s where s.user_id = e.user_id and s.event_type = 'view' and s.ts <= e.ts and s.ts > e.ts - interval 2 days) seen from events e where event_type = 'purchase'")
def remembered_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases with the user's last view before them, if it is less than two days old."""
    e = table(spark, sf, "events")
    scans = e.where("event_type = 'view'").select("user_id", F.lit("x").alias("item"), "ts", "event_id")
    asked = e.where("event_type = 'purchase'").select("user_id", F.lit("x").alias("item"), "ts", "event_id")
    out = state.remembered(scans.drop("event_id"), asked, session="user_id", item="item", ts="ts", ttl_seconds=172_800)
    return asked.join(out, ["user_id", "item", "ts"]).select("event_id", F.col("seen.ts").alias("seen"))


_FRAMES = "f as (select user_id query_id, event_id frame, value sharpness, p % 17 item_id, ((event_id * 31 + p * 7) % 101)::double / 101 score from events cross join range(4) r(p)), d as (select *, dense_rank() over (partition by query_id order by sharpness desc, frame) s, row_number() over (partition by query_id, frame order by score desc, item_id) r from f)"


@_query(f"with {_FRAMES} select 'sharpest' as mode, query_id, item_id, round(max(score), 6) score from d where s <= 1 group by 2, 3 union all select 'max3', query_id, item_id, round(max(score), 6) from d where s <= 3 group by 2, 3 union all select 'mean', d.query_id, item_id, round(sum(score) / any_value(n), 6) from d join (select query_id, count(distinct frame) n from f group by 1) c on c.query_id = d.query_id group by 2, 3 union all select 'rrf3', query_id, item_id, round(sum(1.0::double / (60 + r)), 6) from d where s <= 3 group by 2, 3")
def fused_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of frames made of a user's events, each with four items, fused in four ways."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("frame"), F.col("value").alias("sharpness"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p"))
    rows = e.select("query_id", "frame", "sharpness", (F.col("p") % 17).alias("item_id"), (((F.col("frame") * 31 + F.col("p") * 7) % 101) / 101.0).cast("double").alias("score"))
    out = None
    for mode in ("sharpest", "max3", "mean", "rrf3"):
        one = state.fuse_frames(rows, mode).select(F.lit(mode).alias("mode"), "query_id", "item_id", F.round("score", 6).alias("score"))
        out = one if out is None else out.union(one)
    return out


@_query("with v as (select vec_id, embedding::double[] e from embeddings), s as (select a.vec_id q, b.vec_id i, list_dot_product(a.e, b.e) c from v a join v b on a.vec_id <> b.vec_id), t as (select q, i, c, row_number() over (partition by q order by c desc, i) r from s where c >= 0.3) select vec_id item_id, true finds_itself, i twin, round(c, 6) twin_score from v left join t on q = vec_id and r = 1")
def index_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector looks for itself and for its nearest other one; a patched copy of the index is the same where it was not patched."""
    v = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "item_id")
    near = search.vector_topk_blocked(v, v, 2, query_id="item_id", item_id="item_id")
    out = search.self_check(v.select("item_id"), near, duplicate=0.3)
    changed = search.verify_patch(v, v, v.select("item_id"), 0.99).agg(F.count("*").alias("c"))
    return out.crossJoin(changed).where("c = 0").select("item_id", "finds_itself", "twin", F.round("twin_score", 6).alias("twin_score"))  # changed is one row


@_query("select 'distractor:' || p_partkey item_id, p_name as name from part order by p_partkey limit 100")
def distractor_cards(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred cards of a JSON file as items that nobody asks for: the limit is the reader's."""
    path = _folder(spark)
    table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), "p_size").write.json(path)
    return readers.distractors(spark, path, "item_id long, name string", 100)


@_query("with s as (select user_id, event_id % 50 slug, max(value) card, max(ts) ts from events where event_type = 'view' group by 1, 2), l as (select slug, card from (select *, row_number() over (partition by slug order by ts desc, card desc) r from s) where r = 1), e as (select event_id, user_id, event_id % 50 slug from events where event_type = 'purchase') select event_id, coalesce(s.card, l.card) card from e left join s on s.user_id = e.user_id and s.slug = e.slug left join l on l.slug = e.slug")
def reviewed_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as reviews, views as shelves."""
    e = table(spark, sf, "events").withColumn("slug", F.col("event_id") % 50)
    shelf = e.where("event_type = 'view'").groupBy("user_id", "slug").agg(F.max("value").alias("card"), F.max("ts").alias("ts"))
    return answers.review_cards(e.where("event_type = 'purchase'").select("event_id", "user_id", "slug"), shelf, user="user_id", slug="slug", card="card", updated="ts").select("event_id", "card")


@_query("with o as (select o_custkey c, o_orderkey k, (o_orderkey % 10)::double x, (o_orderkey % 7)::double y, (1 + o_orderkey % 4)::double s from orders) select a.k inner_key, b.k outer_key, round(greatest(0, least(a.x + a.s, b.x + b.s) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.s, b.y + b.s) - greatest(a.y, b.y)) / (a.s * a.s), 6) share from o a join o b on a.c = b.c and a.k <> b.k where greatest(0, least(a.x + a.s, b.x + b.s) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.s, b.y + b.s) - greatest(a.y, b.y)) / (a.s * a.s) >= 0.7")
def contained_boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, y, s = k % 10, k % 7, 1 + k % 4
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("image"), k.alias("key"), linalg.box(x, y, x + s, y + s).alias("box"))
    return answers.box_pairs(rows, rows, inside=0.7).where("key <> outer_key").select(F.col("key").alias("inner_key"), "outer_key", F.round("share", 6).alias("share"))


@_query("with n as (select user_id, event_id % 40 id, max(ts) due from events group by 1, 2), o as (select user_id, event_id % 40 id, count(*) a, max(ts) + interval 1 hour nx from events where event_id % 3 = 0 group by 1, 2) select n.user_id, n.id, coalesce(a, 0) attempts, coalesce(nx, greatest(due, timestamp '2024-01-20 00:01:00')) next_at from n left join o on o.user_id = n.user_id and o.id = n.id")
def synced_reminders(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("id", F.col("event_id") % 40)
    new = e.groupBy("user_id", "id").agg(F.max("ts").alias("due_at"))
    old = e.where("event_id % 3 = 0").groupBy("user_id", "id").agg(F.count("*").alias("attempts"), (F.max("ts") + F.expr("interval 1 hour")).alias("next_at")).withColumn("sent_at", F.lit(None).cast("timestamp_ntz"))
    return state.sync_reminders(old, new, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), device="user_id").select("user_id", "id", "attempts", "next_at")


@_query("select event_type || ':' || event_id || ':' || event_id % 1000 id, event_id % 1000 <= 500 due from events where event_id % 4 <> 0 and event_id % 5 <> 0")
def due_entries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("slug"), k.alias("added_at"), F.when(k % 5 != 0, k % 1000).alias("remind_at"), F.when(k % 4 == 0, "liked").alias("reaction"))
    return state.due_items(rows, F.lit(500)).select("id", "due")


UPLOADS = [("Щука Ёлка й ц х", "shhukayolkajczh"), ("Café №5", "cafno5"), ("ｆｕｌｌ ２", "full2"), ("ﬁne²", "fine2"), ("и\u0306", "j"), ("e\u0301x", "x")]


@_query(_expected("name, upload_key", UPLOADS))
def upload_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, "name string", [n for n, _ in UPLOADS]).select("name", text.upload_key(F.col("name")).alias("upload_key"))


# streams, run to the end of their input


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of files, in three batches."""
    path = _folder(spark)
    events = table(spark, sf, "events")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


_LATEST = "with e as (select user_id, json_extract_string(props, '$.k')::int slot, event_id, ts, event_id % 5 = 0 deleted from events), r as (select *, row_number() over (partition by user_id, slot order by ts desc, deleted desc, event_id desc) k from e) select user_id, slot, event_id, deleted from r where k = 1"


@_query(_LATEST)
def merged_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Latest row of each key, deletions among them, kept up by a stream."""
    folder = _folder(spark)
    e = _stream(spark, sf).select("user_id", F.get_json_object("props", "$.k").cast("int").alias("slot"), "event_id", "ts", (F.col("event_id") % 5 == 0).alias("deleted"))
    sink = state.merge_into(f"{folder}/table", ["user_id", "slot"], updated="ts", deleted="deleted", tie="event_id")
    e.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.merged(spark, f"{folder}/table").select("user_id", "slot", "event_id", "deleted")


@_query("select event_id, user_id, event_type from events")
def logged_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream appended to a log of JSON lines by one writer, each event once."""
    folder = _folder(spark)
    writers.log_stream(_stream(spark, sf).select("event_id", "user_id", "event_type"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    # the log is polled as a stream in turn; what came is a table of files, not rows on the driver
    schema = "event_id long, user_id long, event_type string"
    polled = readers.polled_log(spark, f"{folder}/log", schema)
    polled.writeStream.format("parquet").option("path", f"{folder}/polled").option("checkpointLocation", f"{folder}/polls").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/polled")


@_query("select time_bucket(interval 1 day, ts) as start, event_type, count(*) n from events group by 1, 2")
def counted_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts kept by a stream; the watermark is wide enough for all of the three batches."""
    name = f"counted_{uuid.uuid4().hex}"
    q = state.windowed_stream(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), ts="ts", every="1 day", by=["event_type"], delay="400 days")
    q.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
