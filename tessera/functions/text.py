"""Text folding over several alphabets, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Cyrillic letters and their usual Latin spelling. The second string holds those with one letter or none.
MULTI = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya"}
SINGLE = ("абвгдеёзийклмнопрстуфыэъь", "abvgdeeziiklmnoprstufye")
# Latin letters that look like Cyrillic ones.
HOMOGLYPHS = ("abcehkmoptxy", "авсенкмортху")
# Digits that readers put for letters, in Cyrillic and in Latin words.
DIGITS_CYRILLIC = ("0368", "озбв")
DIGITS_LATIN = ("068", "obb")
# Phonetic folding, in this order.
PHONETIC = [
    ("shch", "sh"), ("sch", "sh"), ("tch", "ch"), ("ch", "sh"), ("ck", "k"), ("qu", "k"), ("ph", "f"), ("th", "t"),
    ("kh", "h"), ("c(?=[eiy])", "s"), ("c", "k"), ("eau", "o"), ("au", "o"), ("ou", "u"), (r"gne\b", "n"), ("gn", "n"),
    ("w", "v"), ("y", "i"), ("j", "i"), ("x", "ks"), ("iu", "u"), (r"(.)\1+", "$1"),
]
# Phrases and words that labels and catalogues spell differently.
PHRASES = {
    "Pinot Noir": "Пино Нуар", "Pinot Grigio": "Пино Гриджио", "Pinot Gris": "Пино Гри", "Pinot Blanc": "Пино Блан",
    "Pinot Franc": "Пино Фран", "Cabernet Sauvignon": "Каберне Совиньон", "Cabernet Franc": "Каберне Фран",
    "Sauvignon Blanc": "Совиньон Блан", "Chateau Tamagne": "Шато Тамань", "Golubitskoe Estate": "Поместье Голубицкое",
    "Derbent Wine": "Дербент Вино", "Fanagoria Estate": "Фанагория", "Semi Sweet": "Полусладкое", "Semi Dry": "Полусухое",
    "Demi Sec": "Полусухое", "Medium Sweet": "Полусладкое", "Medium Dry": "Полусухое",
}
WORDS = {
    "wine": "вино", "vin": "вино", "winery": "винодельня", "estate": "усадьба", "domaine": "дом", "sparkling": "игристое",
    "sekt": "игристое", "port": "портвейн", "porto": "портвейн", "portwine": "портвейн", "sherry": "херес", "madeira": "мадера",
    "rouge": "красное", "red": "красное", "rosso": "красное", "tinto": "красное", "blanc": "белое", "white": "белое",
    "bianco": "белое", "blanco": "белое", "rose": "розовое", "rosato": "розовое", "sec": "сухое", "dry": "сухое", "seco": "сухое",
    "doux": "сладкое", "dolce": "сладкое", "cabernet": "каберне", "merlot": "мерло", "pinot": "пино", "noir": "нуар",
    "chardonnay": "шардоне", "riesling": "рислинг", "sauvignon": "совиньон", "muscat": "мускат", "moscato": "мускат",
    "syrah": "сира", "shiraz": "шираз", "viognier": "вионье", "tempranillo": "темпранильо", "sangiovese": "санджовезе",
    "gewurztraminer": "гевюрцтраминер", "traminer": "траминер", "zweigelt": "цвайгельт",
}


def _accent_table() -> tuple[str, str]:
    """Precomposed letters below U+2000 whose decomposition is one base letter and marks, from the Unicode data."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


ACCENTS = _accent_table()


def strip_accents(text: Column) -> Column:
    """Without diacritics, JVM-side: precomposed letters by a table, combining marks by their class."""
    return F.regexp_replace(F.translate(text, *ACCENTS), r"\p{Mn}+", "")


def transliterate(text: Column) -> Column:
    """Cyrillic to Latin; other letters stay."""
    spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), MULTI.items(), text)
    return F.translate(spelled, *SINGLE)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower-case Latin without diacritics and punctuation."""
    return squeeze(F.regexp_replace(transliterate(strip_accents(F.lower(text))), r"(?U)[^\w\s]", " "))


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(F.lower(text), *HOMOGLYPHS)


def repair_digits(text: Column) -> Column:
    """Digits that stand for letters become letters in words of two letters at least and one or two digits."""
    marked = F.split(F.regexp_replace(text, r"(?U)(\w+)", "\u0001$1\u0001"), "\u0001")

    def fix(w: Column) -> Column:
        digits, letters = F.length(w) - F.length(F.regexp_replace(w, r"(?U)\d", "")), F.length(w) - F.length(F.regexp_replace(w, r"(?U)\p{L}", ""))
        cyrillic = w.rlike("(?iu)[а-яё]")
        return F.when(~w.rlike(r"(?U)^\w+$") | (digits == 0) | (digits > 2) | (letters < 2), w).when(cyrillic, F.translate(w, *DIGITS_CYRILLIC)).otherwise(F.translate(w, *DIGITS_LATIN))

    return F.array_join(F.transform(marked, fix), "")


def variants(text: Column) -> Column:
    """Normalised readings: as it is, and with look-alike letters taken for Cyrillic."""
    fixed = repair_digits(text)
    return F.array_distinct(F.array(normalize(fixed), normalize(fold_homoglyphs(fixed))))


def tokens(text: Column, least: int = 2) -> Column:
    """Words of the normalised text that have `least` letters."""
    return F.filter(F.split(normalize(text), " "), lambda w: F.length(w) >= least)


def fold_phonetic(latin: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), PHONETIC, latin)


def _folded_constants(values: dict[str, str]) -> dict[str, str]:
    return {fold_constant(k): fold_constant(v) for k, v in values.items()}


def fold_constant(text: str) -> str:
    """fold without aliases for a parameter on the driver, by the same rules as the column expressions."""
    import re

    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    single = dict(zip(SINGLE[0], SINGLE[1].ljust(len(SINGLE[0]), "\0"), strict=True))
    text = "".join(MULTI.get(c, single.get(c, c)) for c in text).replace("\0", "")
    text = " ".join(re.sub(r"[^\w\s]", " ", text).split())
    for pattern, to in PHONETIC:
        text = re.sub(pattern, to.replace("$1", r"\1"), text)
    return text


def apply_aliases(folded: Column) -> Column:
    """Phrases first, while their words stand together, then word by word."""
    for phrase, to in _folded_constants(PHRASES).items():
        if phrase != to:
            folded = F.replace(folded, F.lit(phrase), F.lit(to))
    table = F.create_map(*[F.lit(x) for kv in _folded_constants(WORDS).items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(folded, " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def fold(text: Column) -> Column:
    return apply_aliases(fold_phonetic(normalize(text)))


def fold_tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), " "), lambda w: F.length(w) > 1)


def folded_variants(text: Column) -> Column:
    return F.array_distinct(F.transform(variants(text), fold))


# How the system that stores uploads spells Cyrillic letters in file names.
UPLOAD_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "cz", "ч": "ch", "ш": "sh",
    "щ": "shh", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}


def _compatible() -> dict[str, str]:
    """Letters that stand for Latin letters and digits in a compatible form (full width, ligatures, raised), from the Unicode data."""
    out = {}
    for code in (*range(0xA0, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)):
        plain = unicodedata.normalize("NFKC", chr(code)).lower()
        if plain != chr(code).lower() and plain.isascii() and plain.isalnum():
            out[chr(code).lower()] = plain
    return out


COMPATIBLE = _compatible()


def upload_key(name: Column) -> Column:
    """Key of an uploaded file's name: Latin letters and digits alone. Compatible forms count as what they stand for; accented
    letters go, also where the accent is a mark of its own."""
    out = F.lower(name)
    for marks, letter in (("\u0438\u0306", "й"), ("\u0435\u0308", "ё")):
        out = F.replace(out, F.lit(marks), F.lit(letter))
    spelled = COMPATIBLE | UPLOAD_LETTERS
    single = {k: v for k, v in spelled.items() if len(v) <= 1}
    for k, v in spelled.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    kept = "".join(k for k, v in single.items() if v)
    out = F.translate(out, kept + "".join(k for k, v in single.items() if not v), "".join(v for v in single.values() if v))
    return F.regexp_replace(out, r"[a-z]\p{Mn}+|[^a-z0-9]", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def key_text(text: Column) -> Column:
    """Words in lower case with ё as е, for keys that join names."""
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), r"(?U)\W+", " "))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each word padded by a space on both sides; with repeats.

    A padded word that is not longer than n gives one gram of all of it, for the smallest such n only.
    """
    padded = F.transform(F.filter(F.split(squeeze(text), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def slices(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))

    def grams(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            many = slices(w, n)
            one = F.array(w) if n == low else F.when(F.length(w) > n - 1, F.array(w)).otherwise(F.array().cast("array<string>"))
            parts.append(F.when(F.length(w) > n, many).otherwise(one))
        return F.concat(*parts)

    return F.flatten(F.transform(padded, grams))


def joined_words(words: Column, vocabulary: Column) -> Column:
    """Two or three neighbours that together are a vocabulary word (letters alone, four at least) and not each one."""

    def of(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.slice(words, i, size))
        runs = F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<array<string>>"))
        good = F.filter(runs, lambda r: (F.length(F.array_join(r, "")) >= 4) & F.array_join(r, "").rlike(r"^\p{L}+$") & F.array_contains(vocabulary, F.array_join(r, "")) & ~F.forall(r, lambda w: F.array_contains(vocabulary, w)))
        return F.transform(good, lambda r: F.array_join(r, ""))

    return F.concat(of(2), of(3))


def document(*fields: Column) -> Column:
    """Fields joined by spaces; null, empty and not-a-number fields are left out, lists are joined."""
    return F.concat_ws(" ", *[F.nullif(f.cast("string"), F.lit("")) if not isinstance(f, list) else F.concat_ws(" ", *f) for f in fields])


def stems(text: Column, size: int = 5) -> Column:
    return F.array_distinct(F.transform(F.filter(fold_tokens(text), lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, size)))


def block(lines: Column, max_lines: int, max_chars: int) -> Column:
    """Lines with white space squeezed, empty ones skipped, up to a number of lines and characters."""
    clean = F.slice(F.filter(F.transform(lines, squeeze), lambda x: x != ""), 1, max_lines)
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(a: Column, x: Column) -> Column:
        over = a["full"] | (a["n"] + F.length(x) > max_chars)
        return F.struct(F.when(over, a["kept"]).otherwise(F.array_append(a["kept"], x)).alias("kept"), F.when(over, a["n"]).otherwise(a["n"] + F.length(x)).alias("n"), over.alias("full"))

    return F.aggregate(clean, start, add, lambda a: F.array_join(a["kept"], "\n"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-16 units of a text without surrogates, as an unsigned long."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(1 << 32)))


def digest(*columns: Column, size: int = 12) -> Column:
    """Version of a content: leading hex digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws("\u0000", *columns)), 1, size)


def tags(text: Column, rules: dict[str, str], limit: int = 4) -> Column:
    """Names of the rules whose pattern occurs, in the rules' order, `limit` at most."""
    return F.slice(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules.items()])), 1, limit)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural form for a count."""
    ten, hundred = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def phone(text: Column) -> Column:
    """Ten national digits as +7 000 000-00-00; null if there are not ten."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\D", ""), "^[78](?=\\d{10}$)", "")
    return F.when(digits.rlike(r"^\d{10}$"), F.regexp_replace(digits, r"(\d{3})(\d{3})(\d{2})(\d{2})", "+7 $1 $2-$3-$4"))


def initial(name: Column) -> Column:
    """First letter in upper case, ? without one."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(n == "", "?").otherwise(F.upper(F.substring(n, 1, 1)))


def phone_input(digits: Column) -> Column:
    """What an input field shows of the digits typed so far: (000) 000-00-00."""
    d = F.coalesce(digits, F.lit(""))
    part = lambda before, at, n: F.when(F.length(d) > at, F.concat(F.lit(before), F.substring(d, at + 1, n))).otherwise("")
    return F.concat(part("(", 0, 3), part(") ", 3, 3), part("-", 6, 2), part("-", 8, 2))


def masked_phone(digits: Column) -> Column:
    """Ten digits with the middle hidden; empty if there are not ten."""
    return F.when(F.length(digits) == 10, F.concat(F.lit("+7 ("), F.substring(digits, 1, 3), F.lit(") •••-••-"), F.substring(digits, 9, 2))).otherwise("")


def file_safe(name: Column) -> Column:
    """A name for a file: letters, digits, dots, dashes and underscores, 200 characters at most."""
    return F.substring(F.regexp_replace(name, r"(?U)[^\w.\-]", "_"), 1, 200)


# Serving temperatures by kind, in this order; sweet white and rose are served warmer.
SERVING = (("игрист|шампан", "6–8°"), ("красн", "16–18°"), ("оранж", "12–14°"))
SERVING_LIGHT = ("бел|роз", "10–12°", "8–10°")


def serving_temperature(category: Column, name: Column, sweetness: Column) -> Column:
    """Usual serving temperature of a kind of wine; null if nothing says it."""
    kind = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit(""))))
    brut = F.coalesce(sweetness.isin("brut", "extra_brut"), F.lit(False))
    out = F.when(kind.rlike(SERVING[0][0]) | brut, SERVING[0][1])
    for pattern, value in SERVING[1:]:
        out = out.when(kind.rlike(pattern), value)
    pattern, sweet, other = SERVING_LIGHT
    return out.when(kind.rlike(pattern) & F.coalesce(sweetness == "sweet", F.lit(False)), sweet).when(kind.rlike(pattern), other)


def card_tags(category: Column, sweetness: Column, grapes: Column, limit: int = 5) -> Column:
    """Category, sweetness and varieties without generic ones: varieties up to `limit` tags in all."""
    names = F.filter(F.transform(F.split(F.coalesce(grapes, F.lit("")), ","), F.trim), lambda g: (g != "") & ~F.lower(g).contains("сорта"))
    first = F.array_compact(F.array(F.nullif(category, F.lit("")), sweetness))
    return F.concat(first, F.slice(names, F.lit(1), F.greatest(F.lit(0), limit - F.size(first))))


@F.pandas_udf(ArrayType(StringType()))
def name_keys(names: pd.Series) -> pd.Series:
    """All forms under which a file's name may be listed: itself, and what it was before its UTF-8 bytes were read in a code page
    (Spark's encode knows none of them, so this is an Arrow-batched function)."""

    def keys(name):
        if name is None:
            return None
        out = {unicodedata.normalize("NFC", name)}
        for page in ("cp437", "cp866", "cp1251", "cp1252"):
            try:
                out.add(unicodedata.normalize("NFC", name.encode(page).decode("utf-8")))
            except UnicodeError:
                continue
        return sorted(out)

    return names.map(keys)
