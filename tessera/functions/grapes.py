"""Variety names: parsing a field, a vocabulary of phrases, finding phrases in a text, and comparison by word sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import indel_ratio
from tessera.functions.text import fold_constant, fold_tokens

# Names of one variety, varieties that no card has, names that are too common as words.
SYNONYMS = {"Пино черный": "Пино Нуар", "Пино чёрный": "Пино Нуар", "Шираз": "Сира", "Пино Гриджио": "Пино Гри", "Бьянка": "Бианка", "Chenin Blanc": "Шенен Блан", "Petit Verdot": "Пти Вердо"}
EXTRA = ("Кариньян", "Альбариньо", "Гаме", "Барбера", "Дольчетто", "Пинотаж", "Фурминт", "Треббьяно", "Гарганега", "Фиано", "Ассиртико", "Аглианико", "Таннат")
HEADS = ("Каберне",)
AMBIGUOUS = ("Достойный", "Восторг", "Олег", "Голубок", "Цветочный", "Молдова", "Станичный", "Декабрьский", "Шабаш", "Августин", "Сенсо")
GENERIC = "сорт"
FUZZY_LENGTH, FUZZY_RATIO = 6, 85


def folded_name(name: str) -> str:
    from tessera.functions.text import PHRASES, WORDS, _folded_constants

    text = fold_constant(name)
    for phrase, to in _folded_constants(PHRASES).items():
        text = text.replace(phrase, to)
    words = _folded_constants(WORDS)
    return " ".join(w for w in (words.get(x, x) for x in text.split()) if len(w) > 1)


def canonical(phrase: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in {folded_name(k): folded_name(v) for k, v in SYNONYMS.items()}.items() for x in kv])
    return F.coalesce(F.try_element_at(table, phrase), phrase)


def parse(field: Column) -> Column:
    """Canonical folded names in a field, without generic ones."""
    parts = F.split(F.coalesce(field, F.lit("")), r"[,;/\n()]| и ")
    names = F.transform(parts, lambda p: canonical(F.array_join(fold_tokens(p), " ")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.contains(fold_constant(GENERIC)))))


def vocabulary(cards: DataFrame, *, grapes_col: str = "grapes", winery_col: str = "winery") -> DataFrame:
    """Rows (phrase, canonical) of what may be found: the cards' names, extra ones, lone first words and synonyms."""
    spark = cards.sparkSession
    names = cards.select(F.explode(parse(F.col(grapes_col))).alias("phrase")).union(spark.createDataFrame([(folded_name(x),) for x in EXTRA], "phrase string")).distinct()
    winery = cards.select(F.explode(fold_tokens(F.coalesce(F.col(winery_col), F.lit("")))).alias("phrase")).distinct()
    single = ~F.col("phrase").contains(" ")
    plain = names.where(~single).union(names.where(single & (F.length("phrase") >= 4) & ~F.col("phrase").isin([folded_name(x) for x in AMBIGUOUS])).join(winery, "phrase", "left_anti"))
    heads = spark.createDataFrame([(folded_name(x),) for x in HEADS], "phrase string").join(winery, "phrase", "left_anti")
    heads = heads.join(plain.where(F.col("phrase").contains(" ")).select(F.split("phrase", " ")[0].alias("phrase")), "phrase", "left_semi")
    found = plain.union(heads).distinct().select("phrase", F.col("phrase").alias("canonical"))
    synonyms = spark.createDataFrame(list({folded_name(k): folded_name(v) for k, v in SYNONYMS.items()}.items()), "phrase string, canonical string")
    return found.union(synonyms.join(found.select("canonical"), "canonical", "left_semi").select("phrase", "canonical")).dropDuplicates(["phrase"])


def same_word(a: str, b: str) -> bool:
    return a == b or (len(a) >= FUZZY_LENGTH and abs(len(a) - len(b)) <= 1 and indel_ratio(a, b) >= FUZZY_RATIO)


def find(texts: DataFrame, phrases: list[tuple[str, str]], *, words_col: str, out_col: str = "grapes") -> DataFrame:
    """Adds the canonical names found in arrays of folded words: from each place the longest phrase, fuzzily, then on.

    phrases is the collected vocabulary, whose size is that of a dictionary. Phrases are looked up by their first word: equal
    ones by a dictionary, nearly equal ones only among words of a length that differs by one at most; what a worker has looked up
    it remembers.
    """
    by_word: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for p, c in phrases:
        parts = tuple(p.split())
        by_word.setdefault(parts[0], []).append((parts, c))
    lengths: dict[int, list[str]] = {}
    for w in by_word:
        lengths.setdefault(len(w), []).append(w)
    known: dict[str, list] = {}

    def starting(word: str) -> list[tuple[tuple[str, ...], str]]:
        if word not in known:
            if len(known) > 100_000:
                known.clear()
            first = [w for n in (-1, 0, 1) for w in lengths.get(len(word) + n, ()) if same_word(word, w)]
            known[word] = sorted((x for w in first for x in by_word[w]), key=lambda x: (-len(x[0]), x[0]))
        return known[word]

    def scan(words: list[str]) -> list[str]:
        found, i = set(), 0
        while i < len(words):
            hit = next(((len(parts), name) for parts, name in starting(words[i]) if len(words) - i >= len(parts) and all(map(same_word, words[i + 1 : i + len(parts)], parts[1:]))), None)
            if hit:
                found.add(hit[1])
            i += hit[0] if hit else 1
        return sorted(found)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out_col] = [scan(list(w)) if w is not None else [] for w in batch[words_col]]
            yield batch

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    return texts.mapInPandas(apply, StructType([*texts.schema.fields, StructField(out_col, ArrayType(StringType()))]))


def in_name(words: Column, phrases: Column) -> Column:
    """One-word names (five letters at least) with which a word begins."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.filter(phrases, lambda p: ~p.contains(" ") & (F.length(p) >= 5) & w.startswith(p))))))


def of_card(field: Column, name_words: Column, phrases: Column) -> Column:
    """Varieties of a card: those of its field and those with which a word of its name begins."""
    return F.array_sort(F.array_union(parse(field), F.transform(in_name(name_words, phrases), canonical)))


def compare(label: Column, card: Column) -> Column:
    """1 if a name's words are within those of one on the other side, -1 if none is, 0 if a side has no names."""
    parts = lambda x: F.split(x, " ")
    within = F.exists(label, lambda a: F.exists(card, lambda b: (F.size(F.array_except(parts(a), parts(b))) == 0) | (F.size(F.array_except(parts(b), parts(a))) == 0)))
    none = lambda x: x.isNull() | (F.size(F.coalesce(x, F.array().cast("array<string>"))) == 0)
    return F.when(none(label) | none(card), 0).when(within, 1).otherwise(-1)
