"""Quality rules by distribution divergence.

Every document becomes two histograms: its characters by class, and its words over the common words of the known
languages (all other words are one bin). Each is compared with the reference of the document's language by the
Jensen-Shannon distance (base 2, so 0 to 1). A reference is the mean histogram of all documents of a language that are
long enough, so a few long documents don't rule it. All columns are built-in expressions; each text is read once and its
small histograms are written to the shared folder, from which references and verdicts are made.

Defined results: a null or empty text has no words and fails the base rule. A null language counts as ''. A
histogram is only compared if the document has min_char_words (min_common_words) words; if its language has no reference
(no document is long enough), its distances are null and don't count against it. Repeated rows each get a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, words

# Frequent function words of four languages, in natural order.
COMMON_WORDS = (
    "the of and to a in that it is was for on are as with be he by this or from at have an not they his had i you "
    "le la les de des du un une et en est que qui dans pour sur par au ce se ne pas il avec plus sont ou "
    "der die das und ist ein eine den dem des zu mit von auf für als nicht sich im auch es sie er wird bei aus "
    "el los las del y que se por con su para una lo como más pero sus al o si no este ya"
).split()
#: Character classes: name and the regular expression of a run. What is in no class, white space left aside, is "other".
CHAR_CLASSES = (
    ("upper", r"\p{Lu}+"),
    ("lower", r"\p{Ll}+"),
    ("digit", r"\p{Nd}+"),
    ("stop", r"[.,;:?'\"()-]+"),
    ("mark", r"[!#*$%&|<>@^~_=+/\\\[\]{}]+"),
)
SYMBOLS = "#*$%&|<>"
#: Largest distances of a document that is kept.
TRIM_CHAR_DISTANCE = 0.18
MAX_CHAR_DISTANCE = 0.19
MAX_WORD_DISTANCE = 0.5
MIN_WORDS = 50


def _divergence_terms(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(F.lit(0.0))
    return part(p) + part(q)


def js_distance(bins: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two maps from bin to share; bins that a map lacks have none."""
    both = F.aggregate(F.map_values(F.map_zip_with(bins, reference, lambda _, p, q: _divergence_terms(F.coalesce(p, F.lit(0.0)), F.coalesce(q, F.lit(0.0))))), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both)))


def measure(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds _m: the counts of the base rule and the two histograms of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_w", words(F.col(text_col)))
    out = out.withColumn("_n", F.size("_w"))
    # 3-word windows by hash and place; the hash is 64 bits of three words in one document
    out = out.withColumn("_h", F.when(F.col("_n") > 2, F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None)))
    at = lambda k: F.get("_s", k).getField("h")
    twice = F.filter("_s", lambda x, k: x["h"].eqNullSafe(F.when(k > 0, at(k - 1))) | x["h"].eqNullSafe(at(k + 1)))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    out = out.withColumn("_lines", lines)
    solid = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    out = out.withColumn("_c", F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: w.isin(*COMMON_WORDS)))
    common = F.transform(F.array_distinct("_c"), lambda w: F.struct(w.alias("k"), ((F.size("_c") - F.size(F.array_remove("_c", w))) / F.col("_n")).alias("v")))
    # lower-case letters and white space go first: what is left is short, and the other classes are counted in it
    out = out.withColumn("_solid", solid).withColumn("_x", F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", ""))
    left = F.col("_x")
    counts = [((F.col("_solid") - F.length(left)) if name == "lower" else (F.length(left) - F.length(F.regexp_replace(left, pattern, "")))).alias(name) for name, pattern in CHAR_CLASSES]
    out = out.withColumn("_chars", F.struct(F.col("_solid").alias("all"), *counts))
    share = lambda n: n / F.col("_chars.all")
    classed = [F.col(f"_chars.{name}") for name, _ in CHAR_CLASSES]
    chars = [F.struct(F.lit(name).alias("k"), share(c).alias("v")) for (name, _), c in zip(CHAR_CLASSES, classed, strict=True)]
    rest = F.col("_chars.all")
    for c in classed:
        rest = rest - c
    chars.append(F.struct(F.lit("other").alias("k"), share(F.greatest(F.lit(0), rest)).alias("v")))
    some = F.col("_n") > 0
    return out.withColumn(
        "_m",
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.col("_chars.all").cast("long").alias("word_chars"),
            (F.length(left) - F.length(F.translate(left, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.when(some, F.map_from_entries(F.array(*chars))).alias("chars"),
            F.when(some, F.map_from_entries(F.concat(common, F.array(F.struct(F.lit("").alias("k"), ((F.col("_n") - F.size("_c")) / F.col("_n")).alias("v")))))).alias("common"),
        ),
    ).drop("_w", "_n", "_h", "_s", "_p", "_lines", "_c", "_chars", "_solid", "_x")


def references(rows: DataFrame) -> DataFrame:
    """Rows (_lang, _chars, _common): the mean histograms of measured documents by language."""
    n = rows.groupBy("_lang").agg(F.count("*").alias("n"))

    def mean(name: str) -> DataFrame:
        sums = rows.select("_lang", F.explode(f"_m.{name}").alias("k", "v")).groupBy("_lang", "k").agg(F.sum("v").alias("v"))
        return sums.join(n, "_lang").groupBy("_lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", (F.col("v") / F.col("n")).alias("v"))))).alias(f"_{name}"))

    return mean("chars").join(mean("common"), "_lang")


def quality_rules(
    docs: DataFrame,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = MIN_WORDS,
    min_char_words: int = 20,
    min_common_words: int = 50,
    trim_char_distance: float = TRIM_CHAR_DISTANCE,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Rows (keys, counts, char_distance, word_distance, base_failed, kept), one for each document.

    base_failed: fewer than min_words words, or more than half the words repeat in 3-word windows. kept: the base rule
    holds and neither distance is above its limit. References come from all documents of a language with min_common_words
    words at least, made twice: the second time from those within trim_char_distance of the first, so that junk doesn't
    shift what it is measured against. They are one row for each language and bin, so their number is bounded by languages times common words.
    """
    scratch = Scratch(docs.sparkSession)
    picked = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.col(text_col).alias("_text"))
    rows = scratch.write(measure(picked, text_col="_text").drop("_text"))
    long_enough = rows.where(F.col("_m.n_words") >= min_common_words)
    first = scratch.write(references(long_enough))
    near = long_enough.join(first, "_lang").where(js_distance(F.col("_m.chars"), F.col("_chars")) <= trim_char_distance).drop("_chars", "_common")
    refs = scratch.write(references(near))
    joined = rows.join(refs, "_lang", "left")
    m = F.col("_m")
    char = F.when((m["n_words"] >= min_char_words) & F.col("_chars").isNotNull(), js_distance(m["chars"], F.col("_chars")))
    word = F.when((m["n_words"] >= min_common_words) & F.col("_common").isNotNull(), js_distance(m["common"], F.col("_common")))
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = joined.select(*keys, *counts, F.round(char, 9).alias("char_distance"), F.round(word, 9).alias("word_distance"), failed.alias("base_failed"))
    over = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance)
    return out.withColumn("kept", ~F.col("base_failed") & ~over)
