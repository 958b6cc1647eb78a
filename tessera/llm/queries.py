"""The training-data operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier, decontaminate, line_dedup, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, url_filter
from tessera.llm._common import table

_W = "[^\\x20\\x09-\\x0D]+"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shuffle_into_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    solid = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", F.size(solid).cast("long").alias("n_lines"))
    out = rows.join(line_dedup.removed_lines(docs), "doc_id", "left")
    lines = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(lines).cast("long").alias("n_removed"), lines.alias("removed_lines"))


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with a fetch day, and a dated list that a rule derives from their hosts (the tables hold neither)."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int")).alias("fetched_on"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = F.when(F.size(F.split("host", r"\.")) > 3, F.array(F.col("host"), F.regexp_replace("host", r"^[^.]*\.", ""))).otherwise(F.array("host"))
    names = hosts.select(F.explode(names).alias("pattern")).distinct()
    part = lambda i: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1 + 4 * i, 4), 16, 10).cast("int")
    a, b, c = part(0), part(1), part(2)
    entry = lambda action, day: F.struct(F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("day"))
    dated = F.array(F.when(a % 3 == 0, entry("block", b % 400)), F.when((a % 3 == 0) & (c % 2 == 0), entry("remove", b % 400 + 1 + c % 200)), F.when(a % 5 == 0, entry("allow", c % 600)))
    return captures, names.select("pattern", F.inline(F.array_compact(dated)))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = _captures(spark, sf_dir)
    return url_filter.filter_captures(captures, entries)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), shingle_words=3, percent=90)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assign(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("_row.doc_id", "_row.source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
}

_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.COMMON_WORDS))
_CLASSES = {"upper": r"\p{Lu}", "lower": r"\p{Ll}", "digit": r"\p{Nd}", "stop": r"[.,;:?''\"()-]", "mark": r"[!#*$%&|<>@^~_=+/\\\[\]{}]"}


def _js(bins: str, refs: str, on: str) -> str:
    """SQL for (doc, d): the Jensen-Shannon distance of each document of `bins` from `refs`."""
    return f"""
      select doc_id, sqrt(greatest(0.0, least(1.0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) / 2 else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) / 2 else 0 end)))) d
      from (select coalesce(b.doc_id, g.doc_id) doc_id, coalesce(b.v, 0.0) p, coalesce(g.v, 0.0) q
            from {bins} b full join (select doc_id, k, v from (select distinct doc_id, lang from {bins}) join {refs} using (lang)) g on b.doc_id = g.doc_id and b.k = g.k)
      where doc_id in (select doc_id from {bins} join {refs} using ({on})) group by doc_id"""


def _refs(bins: str, members: str) -> str:
    return f"select lang, k, sum(v) / (select count(*) from {members} n where n.lang = b.lang) v from {bins} b where doc_id in (select doc_id from {members}) group by lang, k"


_OP1 = f"""
with d as materialized (select doc_id, coalesce(lang, '') lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_W}') w from documents),
base as materialized (
  select doc_id, lang, len(w) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')))) n_dup_lines, t, w from d),
pos as materialized (select doc_id, unnest(w) x, unnest(range(len(w))) i from d),
win as (select doc_id, i, x, lead(x) over o y, lead(x, 2) over o z from pos window o as (partition by doc_id order by i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x, y, z) c from win where z is not null) where c > 1),
covered as (select doc_id, count(distinct i + s) n from twice, range(3) r(s) group by doc_id),
chars as materialized (
  select doc_id, lang, k, (n / word_chars)::double v from (select doc_id, lang, word_chars, unnest([{", ".join(f"'{k}'" for k in _CLASSES)}, 'other']) k,
    unnest([{", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))" for p in _CLASSES.values())},
      greatest(0, word_chars - {" - ".join(f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))" for p in _CLASSES.values())})]) n from base where n_words > 0)),
common as materialized (
  select doc_id, lang, k, (count(*) / any_value(n))::double v from (select doc_id, lang, len(w) n, case when lower(u) in ({_COMMON}) then lower(u) else '' end k from (select doc_id, lang, w, unnest(w) u from d)) group by doc_id, lang, k
  union all select doc_id, lang, '', 0.0 from d where len(w) > 0 and len(list_filter(w, lambda u: lower(u) not in ({_COMMON}))) = 0),
m1 as materialized (select doc_id, lang from base where n_words >= 50),
r1 as materialized ({_refs("chars", "m1")}),
j1 as ({_js("chars", "r1", "lang")}),
m2 as materialized (select doc_id, lang from m1 join j1 using (doc_id) where d <= {quality_rules.TRIM_CHAR_DISTANCE}),
rc as materialized ({_refs("chars", "m2")}), rw as materialized ({_refs("common", "m2")}),
jc as ({_js("chars", "rc", "lang")}), jw as ({_js("common", "rw", "lang")}),
res as (
  select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(covered.n, 0) n_repeat_words,
    case when n_words >= 20 then round(jc.d, 9) end char_distance, case when n_words >= 50 then round(jw.d, 9) end word_distance,
    n_words < 50 or 100 * coalesce(covered.n, 0) > 50 * n_words base_failed
  from base b left join covered using (doc_id) left join jc using (doc_id) left join jw using (doc_id))
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, char_distance, word_distance, base_failed,
  not base_failed and not (coalesce(char_distance, 0) > {quality_rules.MAX_CHAR_DISTANCE} or coalesce(word_distance, 0) > {quality_rules.MAX_WORD_DISTANCE}) kept
from res
"""

_SHINGLES = "select {id}, unnest(case when len(w) >= 5 then list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _W + "') w from {table})"
_OP3 = f"""
with i as materialized (select distinct item_id, s from ({_SHINGLES.format(id="item_id", table="benchmark")})),
d as (select distinct doc_id, s from ({_SHINGLES.format(id="doc_id", table="documents")})),
n as (select item_id, count(*) n from i group by 1), m as (select doc_id, item_id, count(*) m from d join i using (s) group by 1, 2)
select doc_id, item_id, n::bigint n_shingles, m::bigint n_found, m::double / n containment from m join n using (item_id) where m * 1000 >= n * 800
"""

_HOST = r"nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1), '\.+$', ''), '')"
_OP7 = f"""
with c as (select page_id, url, date '2024-01-01' + (page_id * 37 % 730)::int fetched_on, {_HOST} host from pages),
p as (select distinct unnest(case when len(string_split(host, '.')) > 3 then [host, regexp_replace(host, '^[^.]*\\.', '')] else [host] end) pattern from c where host is not null),
v as (select pattern, ('0x' || md5(pattern)[1:4])::int a, ('0x' || md5(pattern)[5:8])::int b, ('0x' || md5(pattern)[9:12])::int c from p),
e as (select pattern, 'block' action, date '2024-01-01' + b % 400 f from v where a % 3 = 0
  union all select pattern, 'remove', date '2024-01-01' + (b % 400 + 1 + c % 200) from v where a % 3 = 0 and c % 2 = 0
  union all select pattern, 'allow', date '2024-01-01' + c % 600 from v where a % 5 = 0),
one as (select pattern, f, max(action) action from e group by 1, 2),
iv as (select pattern, action, f, lead(f) over (partition by pattern order by f) u from one),
hit as (select page_id, pattern, action, f, row_number() over (partition by page_id order by length(pattern) desc) r from c join iv on (host = pattern or (ends_with(host, '.' || pattern) and not regexp_matches(host, '^[0-9.]+$|^\\['))) and f <= fetched_on and (u is null or fetched_on < u) where action <> 'remove')
select c.page_id, url, fetched_on, host, pattern as "rule", action as rule_action, f as rule_from, coalesce(action <> 'block', true) kept from c left join hit on c.page_id = hit.page_id and r = 1
"""

_OP10 = f"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) size from documents),
per as (select source, sum(size)::bigint source_size, 3 * sum(size)::bigint cap, [1, 2, 3][(row_number() over (order by source is null, source) - 1) % 3 + 1] w from s group by source),
f as (select *, (sum(source_size) over ())::bigint a, (sum(w) over ())::bigint ws, coalesce(sum(cap) over o, 0)::bigint filled, coalesce(sum(w) over o, 0)::bigint used from per
  window o as (order by cap::double / w, source is null, source rows between unbounded preceding and 1 preceding)),
l as (select *, (a - filled)::double / (ws - used) lev from f),
t as (select *, max(case when lev * w <= cap then lev end) over () fin from l),
g as (select source, source_size, case when fin is null then cap::double else least(cap::double, fin * w) end target from t),
r as (select doc_id, s.source, size, source_size, target, case when source_size > 0 then least(3.0::double, target / source_size) else 0.0::double end rate,
  ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::varchar, ''))[1:13])::bigint::double / {2**52}.0::double u from s join g on s.source is not distinct from g.source),
c as (select *, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::int copies from r)
select doc_id, source, size::bigint size, source_size, target, copies, (size * copies)::bigint taken from c
"""

SQL = {"op1_quality_rules": _OP1, "op3_decontamination": _OP3, "op7_url_filter": _OP7, "op10_mixing": _OP10}
