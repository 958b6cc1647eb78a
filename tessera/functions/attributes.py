"""Attributes of an item from its folded words: colour, sweetness, sparkling, fortified; and their three-valued comparison.

Null means unknown. Words are folded by tessera.functions.text; dictionaries are parameters with the defaults below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fold_constant

# Word forms and what they say.
COLORS = {
    "red": ("красное", "красный", "красная", "красных", "красные"),
    "rose": ("розовое", "розовый", "розовая", "розовых", "розовые", "розе"),
    "orange": ("оранжевое", "оранжевый", "оранж", "оранжевых"),
    "white": ("белое", "белый", "белая", "белых", "белые"),
}
GENITIVE = ("красного", "розового", "белого", "оранжевого")
COLOR_STEMS = {"rose": "розов", "red": "красн", "orange": "оранж"}
NOT_A_COLOR = "красностоп"
SWEETNESS = {"брют": "brut", "сухое": "dry", "сухой": "dry", "сухая": "dry", "полусухое": "semidry", "полусладкое": "semisweet", "сладкое": "sweet", "десертное": "sweet", "ликёрное": "sweet"}
SPARKLING = ("игристое", "шампанское", "frizzante", "spumante", "petnat")
FORTIFIED = ("портвейн", "мадера", "херес", "кагор", "креплёное", "ликёрное", "марсала")
GRAPE_MARKER = "сорт"
EXTRA = "экстра"
PLACES = ("горк", "гор", "полян", "балк", "долин", "скал", "звезд", "слобод", "рек", "крепост")
FEMININE = ("красная", "белая", "розовая")
CATEGORY_COLORS = {"Белое": "white", "Красное": "red", "Розовое": "rose", "Оранжевое": "orange"}
SLUG_SWEETNESS = {"suhoe": "dry", "polusuhoe": "semidry", "polusladkoe": "semisweet", "sladkoe": "sweet", "desertnoe": "sweet", "bryut": "brut"}
SLUG_COLORS = ("beloe", "krasnoe", "rozovoe", "oranzhevoe")
SLUG_SPARKLING = ("igristoe", "shampanskoe", "bryut", "prosekko", "kava", "asti", "kremant")
DESCRIPTION_SPARKLING = ("игрист", "шампанск", "перлаж", "пузырьк")
TRUNCATED = (("dry", "semidry"), ("sweet", "semisweet"), ("brut", "extra_brut"))
FUZZY_LENGTH = 8


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _any_prefix(w: Column, stems: tuple[str, ...]) -> Column:
    return w.rlike("^(" + "|".join(fold_constant(s) for s in stems) + ")")


def color_of(w: Column) -> Column:
    """Colour that one folded word names. Cut-off forms count, unless they begin a genitive only."""
    forms = {fold_constant(f): value for value, many in COLORS.items() for f in many}
    genitives = [fold_constant(g) for g in GENITIVE]
    cut = [g[:n] for g in genitives for n in range(len(g) - 2, len(g) + 1) if not any(f.startswith(g[:n]) for f in forms)]
    out = F.when(F.try_element_at(_map(forms), w).isNotNull(), F.try_element_at(_map(forms), w)).when(w.startswith(fold_constant(NOT_A_COLOR)), None).when(w.isin(cut), None)
    for value, stem in COLOR_STEMS.items():
        s = fold_constant(stem)
        out = out.when(w.startswith(s) & (F.length(w) <= len(s) + 3), value)
    return out


def sweetness_of(w: Column) -> Column:
    """Sweetness that one folded word names; long words with one or two errors count."""
    forms = {fold_constant(k): v for k, v in SWEETNESS.items()}
    out = F.when(F.try_element_at(_map(forms), w).isNotNull(), F.try_element_at(_map(forms), w)).when(F.length(w) < FUZZY_LENGTH, None)
    limit = F.when(F.length(w) < 10, 1).otherwise(2)
    for form, value in forms.items():
        if len(form) >= FUZZY_LENGTH:
            out = out.when(F.levenshtein(w, F.lit(form)) <= limit, value)
    return out


def _only(values: Column) -> Column:
    """The one distinct value that is not null; null if there are several or none."""
    kinds = F.array_distinct(F.array_compact(values))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


def from_tokens(words: Column) -> Column:
    """(color, sweetness, sparkling, fortified) of folded words in order. Contradicting words leave an axis unknown."""
    after, before = (lambda i: F.coalesce(F.get(words, i + 1), F.lit(""))), (lambda i: F.when(i > 0, F.get(words, i - 1)))
    feminine = [fold_constant(x) for x in FEMININE]
    colors = F.transform(words, lambda w, i: F.when(~after(i).startswith(fold_constant(GRAPE_MARKER)) & ~(w.isin(feminine) & _any_prefix(after(i), PLACES)), color_of(w)))
    extra = F.lit(fold_constant(EXTRA))
    sweet = F.transform(words, lambda w, i: F.when((sweetness_of(w) == "brut") & before(i).eqNullSafe(extra), "extra_brut").otherwise(sweetness_of(w)))
    has = lambda forms: F.exists(words, lambda w: w.isin([fold_constant(x) for x in forms]))
    sparkling, fortified = has(SPARKLING), has(FORTIFIED)
    return F.struct(
        _only(colors).alias("color"),
        _only(sweet).alias("sweetness"),
        F.when(sparkling, True).when(fortified, False).alias("sparkling"),
        F.when(fortified, True).alias("fortified"),
    )


def sweetness_from_slug(slug: Column) -> Column:
    """Sweetness word that follows a colour word or ends the slug, numbers left aside."""
    words = F.filter(F.split(F.coalesce(slug, F.lit("")), "-"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    before = lambda i: F.coalesce(F.when(i > 0, F.get(words, i - 1)), F.lit(""))
    value = lambda w, i: F.when((F.try_element_at(_map(SLUG_SWEETNESS), w) == "brut") & (before(i) == "ekstra"), "extra_brut").otherwise(F.try_element_at(_map(SLUG_SWEETNESS), w))
    return _only(F.transform(words, lambda w, i: F.when((i == F.size(words) - 1) | before(i).isin(*SLUG_COLORS), value(w, i))))


def sparkling_from_card(slug: Column, description: Column) -> Column:
    words = F.split(F.coalesce(slug, F.lit("")), "-")
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in SLUG_SPARKLING])) | F.lower(F.coalesce(description, F.lit(""))).rlike("|".join(DESCRIPTION_SPARKLING))


def from_card(name_words: Column, category: Column, slug: Column, description: Column) -> Column:
    """Attributes of a card: category before name for the colour, name before slug for the sweetness. colors: all stated."""
    own = from_tokens(name_words)
    by_category = F.try_element_at(_map(CATEGORY_COLORS), F.trim(F.coalesce(category, F.lit(""))))
    sweet = F.coalesce(own["sweetness"], sweetness_from_slug(slug))
    stated = F.coalesce(own["sparkling"], F.lit(False)) | F.coalesce(sweet.isin("brut", "extra_brut"), F.lit(False)) | sparkling_from_card(slug, description)
    return F.struct(
        F.coalesce(by_category, own["color"]).alias("color"),
        sweet.alias("sweetness"),
        F.when(F.coalesce(own["fortified"], F.lit(False)), False).when(stated, True).alias("sparkling"),
        own["fortified"].alias("fortified"),
        F.array_distinct(F.array_compact(F.array(by_category, own["color"]))).alias("colors"),
    )


def compare_axis(a: Column, b: Column) -> Column:
    """1 equal, -1 different, 0 if a side is unknown."""
    return F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).otherwise(-1)


def compare_sweetness(label: Column, card: Column) -> Column:
    cut = F.lit(False)
    for a, b in TRUNCATED:
        cut = cut | ((label == a) & (card == b))
    return F.when(F.coalesce(cut, F.lit(False)), 0).otherwise(compare_axis(label, card))


def compare_color(label: Column, card: Column) -> Column:
    known = F.when(F.size(card["colors"]) > 0, card["colors"]).otherwise(F.array_compact(F.array(card["color"])))
    return F.when(label.isNull() | (F.size(known) == 0), 0).when(F.array_contains(known, label), 1).otherwise(-1)


def compare_style(label: Column, card: Column) -> Column:
    """Sweetness, and sparkling if the label says so: -1 if any contradicts, 1 if any agrees."""
    sweet = compare_sweetness(label["sweetness"], card["sweetness"])
    fizz = F.when(F.coalesce(label["sparkling"], F.lit(False)), compare_axis(label["sparkling"], card["sparkling"])).otherwise(0)
    return F.when(F.least(sweet, fizz) == -1, -1).otherwise(F.greatest(sweet, fizz))


def is_attribute_word(w: Column) -> Column:
    return color_of(w).isNotNull() | sweetness_of(w).isNotNull() | w.isin(*[fold_constant(x) for x in (*SPARKLING, EXTRA)])
