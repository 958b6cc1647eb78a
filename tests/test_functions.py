"""Text, dates, attributes and similarities against hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import attributes, dates, grapes, linalg, similarity, text


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


# label and catalogue spellings that fold to one form
SAME = [
    ("Château Tamagne", "Шато Тамань"), ("Rosé Brut", "Розовое брют"), ("Semi-Sweet White", "Полусладкое белое"), ("Cabernet Sauvignon", "Каберне Совиньон"),
    ("Pinot Noir", "Пино Нуар"), ("Merlot", "Мерло"), ("Riesling", "Рислинг"), ("Muscat", "Мускат"),
]


def test_folding_joins_spellings(spark):
    a, b = values(spark, text.fold(F.col("c0")), *SAME), values(spark, text.fold(F.col("c1")), *SAME)
    assert not [(p, x, y) for p, x, y in zip(SAME, a, b) if x != y]
    some = [("Щука жёлтая",), ("Château d'Yquem",), ("Schwartz",)]
    assert [text.fold_constant(x) for (x,) in some] == values(spark, text.fold_phonetic(text.normalize(F.col("c0"))), *some)


def test_normalize_and_tokens(spark):
    assert values(spark, text.normalize(F.col("c0")), ("Château  «Ёлка»!",), ("ЩИ",), (None,)) == ["chateau elka", "shchi", None]
    assert values(spark, F.array_join(text.tokens(F.col("c0")), "|"), ("A Château 12 % vol",)) == ["chateau|12|vol"]


def test_repair_digits(spark):
    rows = [("6ЕРЕГ",), ("В0ДА",), ("2022г",), ("750ml",), ("12%",), ("M0SKVA",), ("R0 5E",), ("6EРEГ 8 x",)]
    assert values(spark, text.repair_digits(F.col("c0")), *rows) == ["бЕРЕГ", "ВоДА", "2022г", "750ml", "12%", "MoSKVA", "R0 5E", "бEРEГ 8 x"]


def test_variants_and_homoglyphs(spark):
    assert values(spark, F.array_join(text.variants(F.col("c0")), "|"), ("MOCKBA",), ("вино",)) == ["mockba|moskva", "vino"]


def test_char_ngrams(spark):
    assert values(spark, F.array_join(text.char_ngrams(F.col("c0")), "|"), ("ab",), ("a",)) == [" ab|ab | ab ", " a "]


def test_joined_words_block_stems(spark):
    vocabulary = F.array(F.lit("travah"), F.lit("veter"), F.lit("shato"), F.lit("pino"), F.lit("shatopino"))
    assert values(spark, F.array_join(text.joined_words(F.split("c0", " "), vocabulary), "|"), ("veter tra vah",), ("shato pino",), ("x",)) == ["travah", "", ""]
    assert values(spark, text.block(F.array("c0", "c1", F.lit("z z")), 3, 5), (" a   b ", ""), ("abcdef", "q")) == ["a b", ""]
    assert values(spark, F.array_join(text.stems(F.col("c0")), "|"), ("Masandra of",)) == ["masan"]


def test_fnv1a_plural_phone(spark):
    assert values(spark, text.fnv1a(F.col("c0")), ("",), ("a",), ("foobar",)) == [2166136261, 0xE40C292C, 0xBF9CF968]
    assert values(spark, text.plural(F.col("c0").cast("int"), "o", "f", "m"), ("1",), ("3",), ("11",), ("25",), ("21",)) == ["o", "f", "m", "m", "o"]
    assert values(spark, text.phone(F.col("c0")), ("8 (912) 345-67-89",), ("12",)) == ["+7 912 345-67-89", None]


@pytest.mark.parametrize(("a", "b", "ratio"), [("abc", "abc", 100), ("", "", 100), ("abc", "", 0), ("ab", "ba", 50)])
def test_indel(a, b, ratio):
    assert similarity.indel_ratio(a, b) == pytest.approx(ratio)


def test_indel_equals_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "xy")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert similarity.indel_ratio(a, b) == pytest.approx(200 * row[-1] / (len(a) + len(b)) if a or b else 100)


def test_token_set_and_jaro(spark):
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert similarity.token_set_ratio("", "a") == 0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    features = similarity.text_pair_features(F.col("c0"), F.col("c1"), F.lit(None).cast("string"), F.lit(""))
    assert values(spark, features["name_levenshtein_distance"], ("", "abc"), ("abc", "abc")) == [1.0, 0.0]
    assert values(spark, features["winery_jaro_winkler"], ("abc", "abc")) == [0.0]


def test_years(spark):
    rows = [("2019 и 2021",), ("2019 x 2019, 2021",), ("12345 1812 20201",), ("",)]
    assert values(spark, F.array_join(dates.years(F.col("c0"), 2027).cast("array<string>"), ","), *rows) == ["2019,2021", "2019,2019,2021", "", ""]
    assert values(spark, dates.mode_or_none(dates.years(F.col("c0"), 2027)), *rows) == [None, 2019, None, None]
    assert values(spark, dates.first_year(F.col("c0"), F.col("c1")), ("x", "leto-2020"), ("LETO 2024", "leto-2020"), ("", None)) == [2020, 2024, None]


ATTRIBUTES = [
    ("Портвейн красный Алушта", "red", None, False, True), ("Белое полусладкое", "white", "semisweet", None, None), ("Красное белое", None, None, None, None),
    ("Экстра брют белое", "white", "extra_brut", None, None), ("Игристое розовое брют", "rose", "brut", True, None), ("белых сортов винограда", None, None, None, None),
    ("Красная Горка белое", "white", None, None, None), ("Красностоп", None, None, None, None), ("полусладкок", None, "semisweet", None, None), ("розов", "rose", None, None, None), ("красног", None, None, None, None),
]


def test_attributes_from_tokens(spark):
    got = values(spark, attributes.from_tokens(text.fold_tokens(F.col("c0"))), *[(r[0],) for r in ATTRIBUTES])
    assert [(r[0], *tuple(g)) for r, g in zip(ATTRIBUTES, got)] == ATTRIBUTES


def test_slug_and_card(spark):
    slugs = ["x-beloe-polusladkoe-125", "agora-vintage-blanc-de-blancs-extra-brut", "fanagoriya-ekstra-bryut-beloe-risling", "kokur-beloe-ekstra-bryut", None, "a-suhoe-vino"]
    assert values(spark, attributes.sweetness_from_slug(F.col("c0")), *[(s,) for s in slugs]) == ["semisweet", None, None, "extra_brut", None, None]
    card = attributes.from_card(text.fold_tokens(F.col("c0")), F.col("c1"), F.lit("x-krasnoe-suhoe"), F.lit("Вкус игристого вина"))
    assert [tuple(x) for x in values(spark, card, ("Мускат розовое", "Красное"))] == [("red", "dry", True, None, ["red", "rose"])]


@pytest.mark.parametrize(("label", "card", "expected"), [("dry", "dry", 1), ("dry", "semidry", 0), ("semidry", "dry", -1), (None, "dry", 0), ("brut", "extra_brut", 0), ("extra_brut", "brut", -1)])
def test_compare_sweetness(spark, label, card, expected):
    assert values(spark, attributes.compare_sweetness(F.col("c0"), F.col("c1")), (label, card)) == [expected]


def test_grapes(spark):
    name = grapes.folded_name
    assert values(spark, F.array_join(grapes.parse(F.col("c0")), "|"), ("Рислинг, Шираз",), ("Белые сорта винограда",), (None,)) == ["|".join(sorted([name("Рислинг"), name("Сира")])), "", ""]
    cards = spark.createDataFrame([("Рислинг; Совиньон Блан", "Alma Valley"), ("Каберне Совиньон", "Азюр"), ("Восторг", "Восторг")], "grapes string, winery string")
    phrases = [tuple(r) for r in grapes.vocabulary(cards).collect()]
    texts = spark.createDataFrame([("Sauvignon Blanc Riesling",), ("Cabernet",), ("Каберне Совиньен",), ("Восторг",)], "t string").withColumn("w", text.fold_tokens(F.col("t")))
    got = {r.t: r.grapes for r in grapes.find(texts, phrases, words_col="w").collect()}
    assert got["Sauvignon Blanc Riesling"] == sorted([name("Совиньон Блан"), name("Рислинг")])
    assert got["Cabernet"] == [name("Каберне")] and got["Каберне Совиньен"] == [name("Каберне Совиньон")] and got["Восторг"] == []
    arr = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    assert values(spark, grapes.compare(arr("c0"), arr("c1")), ("risling", "risling reinskii"), ("a", "b"), ("", "b")) == [1, -1, 0]


def test_boxes_and_homography(spark):
    one = spark.range(1)
    a, b = linalg.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), linalg.box(F.lit(0.5), F.lit(0), F.lit(1.5), F.lit(1))
    eye = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    small = linalg.box(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.3))
    row = one.select(linalg.iou(a, b).alias("a"), linalg.contains(a, b).alias("b"), linalg.axis_iou(F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(1.5)).alias("c"), linalg.projection_is_sane(eye, small, F.lit(12)).alias("d"), linalg.projection_is_sane(eye, a, F.lit(12)).alias("e"), linalg.determinant(eye).alias("f")).first()
    assert tuple(row) == (pytest.approx(1 / 3), 0.5, pytest.approx(1 / 3), True, False, 1.0)
    assert one.select(linalg.level(F.lit(10), [5, 10, 20])).first()[0] == 2
    assert tuple(one.select(linalg.round_half_even(F.lit(2.5)), linalg.round_half_up(F.lit(2.5))).first()) == (2.0, 3)
