"""Queries over texts, candidates, tokens and the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import lexicon as lx
from annolytics.functions import markup as mk
from annolytics.functions import text as tx
from annolytics.functions.hashing import lookup_key, md5_text
from annolytics.operators import candidates as cd
from annolytics.operators import lexicon as lo
from annolytics.operators import ordering as od
from annolytics.operators import tokens as tk
from annolytics.sources import dimensions
from annolytics.workload.registry import query
from annolytics.workload.views import AS_KANA, AS_MIXED, LETTERS, TEXT_SCRIPT, Tables


# -- text measures --------------------------------------------------------------

@query("clean_ocr_text", r"""
select doc_id, md5(regexp_replace(text, '[\s\p{Z}|｜]+', '', 'g')) as cleaned,
  cast(length(regexp_replace(text, '[\s\p{Z}|｜]+', '', 'g')) as int) as n from documents
""")
def clean_ocr_text(t: Tables) -> DataFrame:
    cleaned = tx.clean_text(F.col("text"))
    return t.documents.select("doc_id", md5_text(cleaned).alias("cleaned"), F.length(cleaned).alias("n"))


_KANA_DOC = f"translate(lower(text), '{LETTERS}', '{AS_KANA}')"
_MIXED_DOC = f"translate(lower(text), '{LETTERS}', '{AS_MIXED}')"


@query("script_counts", f"""
with d as (select doc_id, {_MIXED_DOC} as m from documents)
select doc_id, len(regexp_extract_all(m, '[぀-ヿ]')) as kana, len(regexp_extract_all(m, '[㐀-鿿]')) as ideographs,
  len(regexp_extract_all(m, '[A-Za-zＡ-Ｚａ-ｚ]')) as latin, len(regexp_extract_all(m, '[0-9０-９]')) as digits,
  len(regexp_extract_all(m, '[぀-ヿ㐀-鿿]')) as script,
  round(len(regexp_extract_all(m, '[぀-ヿ㐀-鿿]')) / greatest(1, length(m)), 6) as script_ratio from d
""")
def script_counts(t: Tables) -> DataFrame:
    mixed = t.documents.select("doc_id", F.expr(_MIXED_DOC).alias("m"))
    counts = tx.script_counts(F.col("m"))
    return mixed.select("doc_id", *(F.round(v, 6).alias(k) if k == "script_ratio" else v.alias(k) for k, v in counts.items()))


@query("baseline_score", f"""
select region_id, ord, case when text = '' then -100 else 3 * len(regexp_extract_all(text, '{TEXT_SCRIPT}')) + length(text)
  - 8 * len(regexp_extract_all(text, '[�?]')) end as score from candidates
""")
def baseline_score(t: Tables) -> DataFrame:
    return t.candidates.select("region_id", "ord", tx.baseline_score(F.col("text"), TEXT_SCRIPT).alias("score"))


_HINTS = ("the", "de", "und")
_RUN = r"[㐀-鿿]+|[ぁ-ゟ]+|[゠-ヿ]+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def _plausibility_sql(source: str, key: str) -> str:
    """Plausibility of ``text`` in a table, with the test script and hints."""
    return f"""
tk as (select {key}, text, regexp_extract_all(text, '{_RUN}') as toks, regexp_replace(text, '[\\s\\p{{Z}}]+', '', 'g') as shown from {source}),
cl as (select {key}, shown, list_transform(toks, lambda s: case
    when not regexp_matches(s, '[\\p{{L}}\\p{{N}}]|[぀-ヿ㐀-鿿]') then 's'
    when regexp_matches(s, '{TEXT_SCRIPT}') then case when s in {_HINTS} then 'k' else 'o' end
    when regexp_matches(s, '[0-9０-９]') then 'd' when regexp_matches(s, '[A-Za-zＡ-Ｚａ-ｚ]') then 'l'
    when s in {_HINTS} then 'h' else 'x' end) as c from tk),
cn as (select {key}, len(c) as token_count, len(list_filter(c, lambda x: x <> 's')) as scored, len(list_filter(c, lambda x: x in ('k', 'o'))) as native,
    len(list_filter(c, lambda x: x in ('k', 'h'))) as known, len(list_filter(c, lambda x: x = 'l')) as latin,
    len(list_filter(c, lambda x: x in ('o', 'l', 'd', 'x'))) as opaque,
    len(regexp_extract_all(shown, '{TEXT_SCRIPT}')) / greatest(1, length(shown)) as char_ratio from cl),
pn as (select *, greatest(1, scored) as total, case when native > 0 then least(scored, 8) / 8 else 0 end as shape,
    case when latin > 0 and native = 0 then -12e0 when latin > 0 then -least(6e0, latin * 2e0) else 0e0 end
    + case when opaque / greatest(1, scored) >= 0.75 then -6e0 else 0e0 end + case when char_ratio < 0.35e0 then -6e0 else 0e0 end as penalty from cn),
ps as (select *, case when token_count = 0 then 0e0 else
    round(greatest(-12e0, least(20e0, known / total * 10e0 + native / total * 8e0 + shape * 4e0 + penalty)), 3) end as p_score from pn)
"""


@query("token_plausibility", f"""
with {_plausibility_sql("documents", "doc_id")}
select doc_id, p_score as score, token_count, scored as scored_token_count, round(known / total, 3) as known_ratio,
  round(native / total, 3) as script_token_ratio, round(opaque / total, 3) as opaque_token_ratio,
  round(char_ratio, 3) as char_script_ratio, penalty from ps
""")
def token_plausibility(t: Tables) -> DataFrame:
    rated = cd.with_plausibility(t.documents, TEXT_SCRIPT, _HINTS)
    return rated.select("doc_id", *(F.col(f"p_{c}").alias(c) for c in (
        "score", "token_count", "scored_token_count", "known_ratio", "script_token_ratio", "opaque_token_ratio",
        "char_script_ratio", "penalty")))


@query("variant_consensus", """
with h as (select *, md5(text) as k, variant like '%rot90%' as rot from candidates),
c as (select region_id, k, count(*) as n from h where not rot group by all)
select region_id, ord, coalesce(n, 0) as same_text, cast(case when not rot then least(n, 3) * 8 when n > 0 then -8 else 0 end as int) as variant_consensus
from h left join c using (region_id, k)
""")
def variant_consensus(t: Tables) -> DataFrame:
    return cd.with_consensus(t.candidates).select("region_id", "ord", "same_text", "variant_consensus")


_SCORED = f"""
h as (select *, md5(text) as k, variant like '%rot90%' as rot, region_id * 10 + ord as id from candidates),
n as (select region_id, k, count(*) as n from h where not rot group by all),
{_plausibility_sql("h", "id")},
m as (select h.*, length(text) as len, len(regexp_extract_all(text, '{TEXT_SCRIPT}')) as scr,
    len(regexp_extract_all(text, '[�?]')) + len(regexp_extract_all(text, 'ï¿½')) as bad,
    len(regexp_extract_all(text, '[^A-Za-zÀ-ÿ。、！？…・\\p{{L}}\\p{{N}}_]')) as odd,
    case when not rot then least(coalesce(n.n, 0), 3) * 8 when n.n > 0 then -8 else 0 end as agree, ps.p_score
  from h left join n using (region_id, k) join ps using (id)),
p as (select *, scr * 2.4e0 + least(len, 32) * 0.8e0 - bad * 14 - odd * 4 as script_quality,
    case when (case when rot then 'horizontal' else 'vertical' end) = expected then 10 else -12 end as layout_fit,
    case when expected = 'vertical' then case when rot then -8 else 8 end else 0 end as orientation_bias,
    case when scr / greatest(1, len) < 0.55e0 then -12 else 0 end as low,
    case when len > 48 then -least(16e0, (len - 48) * 0.5e0) else 0e0 end as overlong from m),
scored as (select region_id, ord, variant, text, error, case when len = 0 or error is not null then -100 else
    cast(round_even(script_quality + layout_fit + agree + p_score + orientation_bias + low + run + overlong, 0) as int) end as score,
    case when len = 0 then -100e0 else round(script_quality, 2) end as script_quality from
    (select *, case when len(list_filter(cs, lambda ch, i: i > 5 and ch <> chr(10) and ch = cs[i - 1] and ch = cs[i - 2]
      and ch = cs[i - 3] and ch = cs[i - 4] and ch = cs[i - 5])) > 0 then -10 else 0 end as run from (select *, string_split(text, '') as cs from p)))
"""


@query("candidate_score", f"with {_SCORED} select region_id, ord, score, script_quality from scored")
def candidate_score(t: Tables) -> DataFrame:
    return cd.score_candidates(t.candidates, TEXT_SCRIPT, _HINTS).select("region_id", "ord", "score", "script_quality")


def _run_sql(text: str) -> str:
    """Whether ``text`` holds six equal characters in a row, in DuckDB."""
    return f"""len(list_filter(list_zip(string_split({text}, ''), range(len(string_split({text}, '')))), lambda p:
      p[2] > 4 and p[1] <> chr(10) and replace(substring({text}, p[2] - 4, 6), p[1], '') = '')) > 0"""


_CHOSEN = """
u as (select * from scored where error is null),
best as (select region_id, arg_max(struct_pack(v := variant, t := text, s := score), struct_pack(s := score, o := -ord)) as b from u group by all),
pl as (select region_id, arg_max(struct_pack(v := variant, t := text, s := score), struct_pack(s := score, o := -ord)) as p from u
  where variant not like '%rot90%' and text <> '' group by all),
won as (select region_id, coalesce(b.v like '%rot90%' and p.s >= b.s - 15, false) as guarded, case when guarded then p else b end as w
  from best left join pl using (region_id)),
two as (select region_id, count(*) > 1 and max(score) - min(score) <= 3 as near from
  (select region_id, score, row_number() over (partition by region_id order by score desc, ord) as r from scored) where r <= 2 group by all)
"""


@query("rotation_guard", f"""
with {_SCORED}, {_CHOSEN} select region_id, w.v as variant, w.s as score, guarded as rotation_guarded from won
""")
def rotation_guard(t: Tables) -> DataFrame:
    return cd.choose_candidate(cd.score_candidates(t.candidates, TEXT_SCRIPT, _HINTS)).select(
        "region_id", "variant", "score", "rotation_guarded")


@query("close_score_warning", f"with {_SCORED}, {_CHOSEN} select region_id, near as close from two")
def close_score_warning(t: Tables) -> DataFrame:
    return cd.close_scores(cd.score_candidates(t.candidates, TEXT_SCRIPT, _HINTS))


@query("score_candidates_job", f"""
with {_SCORED}, {_CHOSEN},
a as (select region_id, w.v as variant, w.t as text, w.s as score, near, length(w.t) as len, len(regexp_extract_all(w.t, '{TEXT_SCRIPT}')) as scr
  from won join two using (region_id)),
c as (select *, case when len = 0 then ['empty_ocr'] else list_filter([
  case when scr = 0 then 'no_japanese_chars' when scr / greatest(1, len) < 0.55e0 then 'low_japanese_ratio' end,
  case when len <= 2 then 'very_short_text' end, case when contains(text, '?') or contains(text, 'ï¿½') then 'replacement_or_question_marks' end,
  case when {_run_sql('text')} then 'repeated_character_run' end,
  case when near then 'close_ocr_variant_scores' end, case when score < 8 then 'low_ocr_score' end], lambda x: x is not null) end as warn from a),
d as (select *, case when len = 0 then 0e0 else greatest(0.05e0, least(0.98e0, 0.55e0 + least(greatest(score, 0), 60) / 150 - least(len(warn), 4) * 0.08e0
  - case when list_has_any(warn, ['empty_ocr', 'no_japanese_chars', 'low_ocr_score']) then 0.18e0 else 0e0 end)) end as conf from c)
select region_id, variant, score, array_to_string(warn, ',') as warnings, round(conf, 6) as confidence,
  case when len = 0 then 'bad' when conf >= 0.78 and len(warn) = 0 then 'good' when conf >= 0.52 then 'warn' else 'bad' end as quality from d
""")
def score_candidates_job(t: Tables) -> DataFrame:
    chosen = cd.recognise(t.candidates, TEXT_SCRIPT, _HINTS)
    rated = tx.confidence(F.col("chars"), F.col("score"), F.col("warnings"))
    return chosen.withColumn("rated", rated).select(
        "region_id", "variant", "score", F.array_join("warnings", ",").alias("warnings"), F.round("rated", 6).alias("confidence"),
        F.when(F.col("chars") == 0, "bad").otherwise(tx.quality(F.col("rated"), F.col("warnings"))).alias("quality"))


@query("raw_fallback", f"""
with e as (select region_id, case when n_chars % 2 = 0 then '' else text end as text from (select doc_id as region_id, text, n_chars from documents)),
c as (select doc_id as region_id, regexp_replace(text, '[\\s\\p{{Z}}|｜]+', '', 'g') as plain from documents)
select region_id, case when e.text = '' and c.plain <> '' then 'raw_fallback' else 'raw_upscaled' end as variant,
  md5(case when e.text = '' and c.plain <> '' then c.plain else e.text end) as text,
  cast(case when e.text = '' and c.plain <> '' then 3 * len(regexp_extract_all(c.plain, '{TEXT_SCRIPT}')) + length(c.plain)
    - 8 * len(regexp_extract_all(c.plain, '[�?]')) else 5 end as int) as score
from e join c using (region_id)
""")
def raw_fallback(t: Tables) -> DataFrame:
    chosen = t.documents.select(
        F.col("doc_id").alias("region_id"), F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.col("text")).alias("text"),
        F.lit(5).alias("score"), F.lit("raw_upscaled").alias("variant"))
    plain = t.documents.select(F.col("doc_id").alias("region_id"), "text")
    filled = cd.raw_fallback(chosen, plain, TEXT_SCRIPT)
    return filled.select("region_id", "variant", md5_text(F.col("text")).alias("text"), "score")


_WARN_SQL = f"""
w as (select doc_id, case when length(text) = 0 then ['empty_ocr'] else list_filter([
  case when len(regexp_extract_all(text, '{TEXT_SCRIPT}')) = 0 then 'no_japanese_chars'
       when len(regexp_extract_all(text, '{TEXT_SCRIPT}')) / length(text) < 0.55e0 then 'low_japanese_ratio' end,
  case when length(text) <= 2 then 'very_short_text' end, case when contains(text, '?') then 'replacement_or_question_marks' end,
  case when {_run_sql('text')} then 'repeated_character_run' end,
  case when n_chars % 3 = 0 then 'close_ocr_variant_scores' end, case when n_chars % 100 < 8 then 'low_ocr_score' end], lambda x: x is not null) end as warn, n_chars % 100 as score from documents)
"""


def _warned(t: Tables) -> DataFrame:
    hints = tx.text_warnings(F.col("text"), F.col("n_chars") % 100, F.col("n_chars") % 3 == 0, TEXT_SCRIPT)
    return t.documents.withColumn("warn", hints).withColumn("score", F.col("n_chars") % 100)


@query("text_warnings", f"with {_WARN_SQL} select doc_id, array_to_string(warn, ',') as warnings from w")
def text_warnings(t: Tables) -> DataFrame:
    return _warned(t).select("doc_id", F.array_join("warn", ",").alias("warnings"))


@query("repeated_runs", f"select doc_id, {_run_sql('text')} as has_run from documents")
def repeated_runs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.repeated_run(F.col("text")).alias("has_run"))


@query("warning_intersection", f"""
with {_WARN_SQL} select doc_id, list_has_any(warn, ['empty_ocr', 'no_japanese_chars', 'low_ocr_score']) as severe from w
""")
def warning_intersection(t: Tables) -> DataFrame:
    return _warned(t).select("doc_id", tx.has_severe(F.col("warn")).alias("severe"))


@query("confidence_bucket", f"""
with {_WARN_SQL}, c as (select doc_id, warn, greatest(0.05e0, least(0.98e0, 0.55e0 + least(greatest(score, 0), 60) / 150 - least(len(warn), 4) * 0.08e0
  - case when list_has_any(warn, ['empty_ocr', 'no_japanese_chars', 'low_ocr_score']) then 0.18e0 else 0e0 end)) as conf from w)
select doc_id, round(conf, 6) as confidence, case when conf >= 0.78 and len(warn) = 0 then 'good' when conf >= 0.52 then 'warn' else 'bad' end as quality,
  case when conf >= 0.78 then 'good' when conf >= 0.52 then 'warn' else 'bad' end as shown_quality from c
""")
def confidence_bucket(t: Tables) -> DataFrame:
    rated = _warned(t).withColumn("c", tx.confidence(F.length("text"), F.col("score"), F.col("warn")))
    return rated.select("doc_id", F.round("c", 6).alias("confidence"), tx.quality(F.col("c"), F.col("warn")).alias("quality"),
                        tx.quality(F.col("c")).alias("shown_quality"))


@query("distinct_chars", f"""
with d as (select doc_id, regexp_extract_all({_MIXED_DOC}, '[㐀-鿿]') as c from documents)
select doc_id, array_to_string(list_sort(list_distinct(c)), '') as chars, len(list_distinct(c)) as n from d
""")
def distinct_chars(t: Tables) -> DataFrame:
    chars = tx.distinct_chars(F.expr(_MIXED_DOC))
    return t.documents.select("doc_id", F.array_join(chars, "").alias("chars"), F.size(chars).alias("n"))


@query("ordered_distinct", r"""
with w as (select page_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s', ' ', 'g'), ' '), lambda x: trim(x)), lambda x: x <> '') as ws from pages),
i as (select page_id, ws, list_filter(ws, lambda x, i: list_position(ws, x) = i) as firsts from w)
select page_id, md5(array_to_string(firsts, ' ')) as words, len(firsts) as n from i
""")
def ordered_distinct(t: Tables) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s", " ")
    words = tx.ordered_distinct(F.split(plain, " "))
    return t.pages.select("page_id", md5_text(F.array_join(words, " ")).alias("words"), F.size(words).alias("n"))


@query("nested_topk", """
with w as (select conv_id, turn, string_split(text, ' ') as ws from conversations)
select conv_id, turn, array_to_string(ws[1:6], ' ') as first_six,
  array_to_string(list_filter(ws, lambda x, i: (i - 1) % cast(greatest(1, ceil(len(ws) / 12)) as int) = 0), ' ') as sampled from w
""")
def nested_topk(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    return t.conversations.select(
        "conv_id", "turn", F.array_join(F.slice(words, 1, 6), " ").alias("first_six"),
        F.array_join(tx.every_nth(words, 12), " ").alias("sampled"))


# -- kana -----------------------------------------------------------------------

@query("katakana_to_hiragana", f"""
select doc_id, md5(translate({_KANA_DOC}, 'ッザ', 'っざ')) as hiragana from documents
""")
def katakana_to_hiragana(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", md5_text(tx.katakana_to_hiragana(F.expr(_KANA_DOC))).alias("hiragana"))


def _romaji_sql(source: str, key: str, column: str) -> str:
    # Mora by mora, unlike the passes over the whole text on the Spark side.
    pairs = "|".join(k for k in tx.ROMAJI if len(k) == 2)
    table = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.ROMAJI.items()) + "}"
    return f"""
un as (select {key}, regexp_extract_all(translate({column}, 'ッザ', 'っざ'), '(?s)[っー]*(?:{pairs}|[^っー])|[っー]+') as u from {source}),
mo as (select {key}, list_transform(u, lambda x: regexp_extract(x, '^[っー]*', 0)) as marks,
    list_transform(u, lambda x: regexp_replace(x, '^[っー]*', '')) as kana from un),
ro as (select {key}, marks, list_transform(kana, lambda x: coalesce({table}[x], x)) as r from mo),
spelt as (select {key}, array_to_string(list_transform(r, lambda x, i: concat(
    repeat(case when i > 1 then regexp_extract(r[i - 1], '([aeiou])[^aeiou]*$', 1) else '' end, length(replace(marks[i], 'っ', ''))),
    case when contains(marks[i], 'っ') and regexp_matches(x, '^\\p{{L}}') and x <> 'n' then case when x like 'ch%' then 't' else x[1] end else '' end, x)), '') as romaji from ro)
"""


@query("kana_to_romaji", f"""
with d as (select doc_id, {_KANA_DOC} as k from documents), {_romaji_sql("d", "doc_id", "k")}
select doc_id, md5(romaji) as romaji, length(romaji) as n from spelt
""")
def kana_to_romaji(t: Tables) -> DataFrame:
    romaji = t.documents.select("doc_id", tx.kana_to_romaji(F.expr(_KANA_DOC)).alias("r"))
    return romaji.select("doc_id", md5_text(F.col("r")).alias("romaji"), F.length("r").alias("n"))


@query("structured_readings", f"""
with w as (select page_id, unnest(range(0, len(ps))) as i, unnest(ps) as part from
  (select page_id, list_filter(regexp_extract_all(translate(url, '{LETTERS}', '{AS_KANA}'), '[.-]|[^.-]+'), lambda x: x <> '') as ps from pages)),
k as (select page_id * 1000 + i as id, part from w), {_romaji_sql("k", "id", "part")},
z as (select w.page_id, w.i, w.part, case when w.part in ('.', '-') then w.part else s.romaji end as r from w join spelt s on s.id = w.page_id * 1000 + w.i)
select page_id, string_agg(part, '' order by i) as kana, string_agg(r, '' order by i) as romaji from z group by page_id
""")
def structured_readings(t: Tables) -> DataFrame:
    read = tx.structured_readings(F.array(F.translate("url", LETTERS, AS_KANA)))
    return t.pages.select("page_id", read[0]["kana"].alias("kana"), read[0]["romaji"].alias("romaji"))


@query("unicode_metadata", """
with c as (select unnest(string_split(text, '')) as ch from documents),
d as (select ch, count(*) as uses from c where ch <> '' group by ch)
select ch as character, printf('U+%04X', unicode(ch)) as codepoint, uses, """ + "coalesce(" + ", ".join(
    f"case when regexp_matches(ch, '^\\p{{{c}}}$') then '{c}' end" for c in tx.CATEGORIES if c != "Cs") + """, 'Cn') as category from d
""")
def unicode_metadata(t: Tables) -> DataFrame:
    used = t.documents.select(F.explode(F.split("text", "")).alias("character")).where(
        "character <> ''").groupBy("character").agg(F.count(F.lit(1)).alias("uses"))
    return used.select("character", "uses", tx.codepoint(F.col("character")).alias("codepoint"),
                       tx.unicode_category(F.col("character")).alias("category"))


# -- tokens ---------------------------------------------------------------------

@query("script_tokens", f"""
with w as (select conv_id, turn, regexp_extract_all({_MIXED_DOC}, '{_RUN}') as ts from conversations)
select conv_id, turn, cast(i - 1 as int) as pos, ts[i] as surface from w, unnest(range(1, len(ts) + 1)) as u(i)
""")
def script_tokens(t: Tables) -> DataFrame:
    runs = tx.script_runs(F.expr(_MIXED_DOC))
    return t.conversations.select("conv_id", "turn", F.posexplode(runs).alias("pos", "surface"))


# Clauses of the turns without spaces, and a dictionary of the words that recur: cheaper the more often.
_CLAUSE = r"[.\n,]+"


@query("tokenize", r"""
with recursive clauses as (select conv_id, turn, i - 1 as clause, replace(lower(cs[i]), ' ', '') as line from (
    select conv_id, turn, regexp_split_to_array(text, '[.\n,]+') as cs from conversations), unnest(range(1, len(cs) + 1)) as u(i)),
distinct_lines as materialized (select distinct trim(line) as line, length(trim(line)) as n from clauses where trim(line) <> ''),
lexicon_words as (select w as surface, 2000 - 100 * least(count(*), 10) as cost from (
    select unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) as w from conversations) group by w having count(*) > 1 and length(w) <= 40),
places as (select line, n, p from distinct_lines, unnest(range(0, n)) as u(p)),
runs as (select line, n, p, p + length(regexp_extract(substr(line, cast(p + 1 as int)), '^(?:[㐀-鿿]+|[ぁ-ゟ]+|[゠-ヿ]+|[\p{L}\p{N}]+|[^\s\p{L}\p{N}])')) as e from places),
substrings as (select line, p, k, substr(line, cast(p + 1 as int), cast(k as int)) as surface from places, unnest(range(1, least(40, n - p) + 1)) as u(k)),
hits as materialized (select line, p, p + k as e, cost, true as known from substrings join lexicon_words using (surface)),
edges as (
  select * from hits
  union all select line, p, p + 1, 3500, false from runs
  union all select line, p, e, 3000 + 500 * (e - p), false from runs where e > p + 1),
ends as materialized (select line, e, list(struct_pack(p := p, cost := cost, known := known)) as arriving from edges group by line, e),
-- The cheapest way to every place, then fewest tokens, then the earliest start of the last token.
ways as (
  select line, n, 0::bigint as e, [row(0::bigint, 0::bigint, -1::bigint, 1::bigint)] as best from distinct_lines
  union all
  select w.line, w.n, w.e + 1, list_append(w.best, list_min(list_transform(x.arriving, lambda a:
    row((w.best[a.p + 1])[1] + a.cost, (w.best[a.p + 1])[2] + 1, a.p, case when a.known then 0::bigint else 1::bigint end))))
  from ways w join ends x on x.line = w.line and x.e = w.e + 1),
full_ as materialized (select line, n, best from ways where e = n),
back as (
  select line, best, n as e, (best[n + 1])[3] as p, (best[n + 1])[4] as unknown from full_
  union all select line, best, p, (best[p + 1])[3], (best[p + 1])[4] from back where p > 0),
cut as (
  select line, p as start, e as "end", unknown = 0 as known from back where line in (select line from hits)
  union all select line, 0, n, false from distinct_lines where line not in (select line from hits))
select c.conv_id, c.turn, cast(c.clause as int) as clause, cast(row_number() over (partition by c.conv_id, c.turn, c.clause order by t.start) - 1 as int) as place,
  substr(t.line, cast(t.start + 1 as int), cast(t."end" - t.start as int)) as surface, cast(t.start as int) as start, cast(t."end" as int) as "end", t.known
from clauses c join cut t on t.line = trim(c.line)
""")
def tokenize(t: Tables) -> DataFrame:
    clauses = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", _CLAUSE)).alias("clause", "line")).select(
        "conv_id", "turn", "clause", F.regexp_replace(F.lower("line"), " ", "").alias("line"))
    words = t.conversations.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), 0)).alias("surface"))
    dictionary = words.groupBy("surface").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "surface", F.col("surface").alias("lemma"), F.lit("").alias("reading"), F.array().cast("array<string>").alias("pos"),
        (2000 - 100 * F.least("n", F.lit(10))).alias("cost"))
    return tk.token_rows(tk.tokenize(clauses, dictionary, "line"), ["conv_id", "turn", "clause"]).select(
        "conv_id", "turn", "clause", "place", "surface", "start", "end", "known")


@query("piece_offsets", r"""
with w as (select conv_id, turn, regexp_extract_all(text, '\s*\S+') as ps from conversations),
p as (select conv_id, turn, i as pos, length(ps[i]) as n, length(regexp_replace(ps[i], '^\s*', '')) as len from w, unnest(range(1, len(ps) + 1)) as u(i)),
e as (select *, sum(n) over (partition by conv_id, turn order by pos) as e from p)
select conv_id, turn, cast(pos as int) as pos, cast(e - len as bigint) as start, cast(e as bigint) as "end" from e
""")
def piece_offsets(t: Tables) -> DataFrame:
    pieces = t.conversations.select("conv_id", "turn", F.posexplode(
        F.regexp_extract_all("text", F.lit(r"\s*\S+"), 0)).alias("pos", "piece"))
    surface = F.regexp_replace("piece", r"^\s*", "")
    gaps = pieces.select("conv_id", "turn", (F.col("pos") + 1).alias("pos"), surface.alias("surface"),
                         (F.length("piece") - F.length(surface)).alias("gap"))
    return od.with_offsets(gaps, ["conv_id", "turn"]).select("conv_id", "turn", "pos", "start", "end")


# Words of the turns as an analyser may give them: without signs, some in lower case, some in a form the text does not hold.
_SURFACE = "case when pos % 7 = 6 then concat('~', word) when pos % 5 = 3 then lower(word) else word end"


@query("token_offsets", rf"""
with recursive texts as (select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') as ws from conversations),
forms as (select conv_id, turn, text, cast(i - 1 as int) as pos, ws[i] as word from texts, unnest(range(1, len(ws) + 1)) as u(i)),
tokens_of as materialized (select conv_id, turn, text, pos, {_SURFACE} as surface from forms),
walk as (
  select conv_id, turn, -1 as pos, '' as surface, cast(0 as bigint) as start, cast(0 as bigint) as e, true as found from texts
  union all select conv_id, turn, pos, surface, case when hit > 0 then e + hit - 1 else e end, case when hit > 0 then e + hit - 1 else e end + length(surface), hit > 0 from (
    select t.conv_id, t.turn, t.pos, t.surface, w.e, strpos(substr(t.text, w.e + 1), t.surface) as hit
    from walk w join tokens_of t on t.conv_id = w.conv_id and t.turn = w.turn and t.pos = w.pos + 1))
select conv_id, turn, pos, surface, start, e as "end", found from walk where pos >= 0
""")
def token_offsets(t: Tables) -> DataFrame:
    words = t.conversations.select("conv_id", "turn", F.posexplode(
        F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0)).alias("pos", "word"))
    tokens = words.select("conv_id", "turn", "pos", F.expr(_SURFACE).alias("surface"))
    return tk.locate(tokens, t.conversations, ["conv_id", "turn"])


_KIND_SQL = "case tag when '補助記号' then 'token' when '助詞' then 'particle' when '助動詞' then 'aux' else 'word' end"


def _tagged(t: Tables) -> DataFrame:
    return t.tokens.withColumn("tags", F.array("tag"))


@query("unit_kind", f"""
select conv_id, turn, pos, {_KIND_SQL} as kind, case {_KIND_SQL} when 'word' then 'segment' when 'aux' then 'auxiliary' else {_KIND_SQL} end as label from tokens
""")
def unit_kind(t: Tables) -> DataFrame:
    kinds = _tagged(t).withColumn("kind", lx.unit_kind(F.col("tags")))
    return kinds.select("conv_id", "turn", "pos", "kind", lx.unit_label(F.col("kind")).alias("label"))


_POS_LABELS = {"名詞": "noun", "助詞": "particle", "助動詞": "auxiliary", "補助記号": "symbol / punctuation"}
_POS_CASE = "case tag " + " ".join(f"when '{k}' then '{v}'" for k, v in _POS_LABELS.items()) + " end"


@query("pos_labels", f"select conv_id, turn, pos, coalesce({_POS_CASE}, '') as labels from tokens")
def pos_labels(t: Tables) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in _POS_LABELS.items() for x in kv))
    labels = F.array_distinct(F.filter(F.transform("tags", lambda p: F.try_element_at(table, p)), lambda v: v.isNotNull()))
    return _tagged(t).select("conv_id", "turn", "pos", F.array_join(labels, "/").alias("labels"))


@query("editorial_dimensions", f"select {_POS_CASE} as label, count(*) as tokens from tokens group by all")
def editorial_dimensions(t: Tables) -> DataFrame:
    labels = F.broadcast(dimensions.glossary(t.spark, _POS_LABELS))  # four rows, given above
    counted = t.tokens.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(labels, counted.tag == labels.word, "left").groupBy(F.col("gloss").alias("label")).agg(
        F.sum("n").alias("tokens"))


@query("lookup_cache_key", """
select conv_id, turn, pos, case when trim(reading) <> '' then concat(trim(surface), '::', trim(reading)) else trim(surface) end as cache_key,
  md5(case when trim(reading) <> '' then concat(trim(surface), '::', trim(reading)) else trim(surface) end) as cache_file from tokens
""")
def lookup_cache_key(t: Tables) -> DataFrame:
    keyed = t.tokens.withColumn("cache_key", lookup_key(F.col("surface"), F.col("reading")))
    return keyed.select("conv_id", "turn", "pos", "cache_key", md5_text(F.col("cache_key")).alias("cache_file"))


# -- dictionary -----------------------------------------------------------------

@query("priority_weight", """
select entry_id, case when priority like 'ichi%' then 100 when priority like 'news%' then 90
  when priority like 'nf%' then greatest(1, 80 - cast(substr(priority, 3) as int)) else 0 end as weight from dictionary
""")
def priority_weight(t: Tables) -> DataFrame:
    return t.dictionary.select("entry_id", lx.priority_weight(F.col("priority")).alias("weight"))


@query("priority_label", """
select entry_id, case priority when 'ichi1' then 'Ichimango common-word list, higher-priority subset' when 'news2' then 'Mainichi newspaper priority, second 12,000 words'
  when '' then '' else printf('Mainichi frequency band %02d (approximately ranks %d–%d)', cast(substr(priority, 3) as int),
    (cast(substr(priority, 3) as int) - 1) * 500 + 1, cast(substr(priority, 3) as int) * 500) end as label from dictionary
""")
def priority_label(t: Tables) -> DataFrame:
    return t.dictionary.select("entry_id", lx.priority_label(F.col("priority")).alias("label"))


def _entries(t: Tables) -> DataFrame:
    """Dictionary in entry form: a main variant, a spelling without accents, and
    the same entry once more at another priority (a copy to fold or outrank)."""
    one = lambda w, p: F.struct(w.alias("written"), F.col("pronounced").alias("pronounced"), F.array(p).alias("priorities"))
    base = t.dictionary.withColumns({
        "variants": F.array(one(F.col("written"), F.col("priority")), one(F.concat("written", F.lit("s")), F.lit("gai1"))),
        "meanings": F.array(F.struct(F.array("gloss", F.lit(" "), F.concat(F.lit("to "), "written"), "gloss").alias("glosses"))),
        "ord": F.lit(1),
    })
    extra = base.where("length(written) % 3 = 0").withColumns({
        "variants": F.array(one(F.col("written"), F.lit("spec1"))),
        "ord": F.lit(2), "entry_id": F.concat("entry_id", F.lit("#2"))})
    return base.unionByName(extra).select("entry_id", "ord", "variants", "meanings")


# Tokens look up words; dictionary readings are the accent-free spellings.
_LOOKUP = """
w as (select distinct surface as text, translate(lemma, 'àâçèéêîôùûü', 'aaceeeiouuu') as reading from tokens
  union select distinct lemma, '' from tokens where lemma <> surface and lemma <> ''),
wt as (select entry_id, written, pronounced, case when priority like 'ichi%' then 100 when priority like 'news%' then 90
  when priority like 'nf%' then greatest(1, 80 - cast(substr(priority, 3) as int)) else 0 end as prio, 1 as ord from dictionary),
e as (select entry_id, written, pronounced, prio, concat(written, 's') as alt, ord from wt
  union all select concat(entry_id, '#2'), written, pronounced, 70, null, 2 from wt where length(written) % 3 = 0),
k as (select entry_id, ord, written, alt, pronounced, prio, unnest(list_distinct([written, coalesce(alt, written)])) as key from e),
c as (select w.text, w.reading, k.entry_id, k.ord, greatest(
    case when written = text then 1000 else 0 end + case when reading <> '' and pronounced = reading then 300 else 0 end + prio,
    case when alt is null then 0 else case when alt = text then 1000 else 0 end + case when reading <> '' and pronounced = reading then 300 else 0 end + 60 end) as score
  from w join k on k.key = w.text)
"""


def _lookup_words(t: Tables) -> DataFrame:
    plain = F.translate("lemma", "àâçèéêîôùûü", "aaceeeiouuu")
    return lo.distinct_words(t.tokens.withColumn("reading", plain))


@query("dictionary_candidates", f"with {_LOOKUP} select text, reading, entry_id, score, 'exact' as match from c")
def dictionary_candidates(t: Tables) -> DataFrame:
    found = lo.dictionary_candidates(_lookup_words(t), _entries(t))
    return found.select("text", "reading", "entry_id", F.col("entry.score").alias("score"), F.col("entry.match").alias("match"))


@query("entry_match_score", f"with {_LOOKUP} select text, reading, max(score) as best, min(score) as least, count(*) as entries from c group by all")
def entry_match_score(t: Tables) -> DataFrame:
    words = _lookup_words(t)
    entries = _entries(t).select("variants", F.explode(F.array_distinct(F.transform("variants", lambda v: v["written"]))).alias("text"))
    scored = words.join(entries, "text").withColumn("s", lx.match_score(F.col("variants"), F.col("text"), F.col("reading")))
    return scored.groupBy("text", "reading").agg(
        F.max("s").alias("best"), F.min("s").alias("least"), F.count(F.lit(1)).alias("entries"))


_RANKED = """
ranked as (select text, reading, entry_id, score, count(*) over (partition by text, reading) as candidate_count,
  row_number() over (partition by text, reading order by score desc, ord, entry_id) as place from c)
"""


@query("rank_entries", f"with {_LOOKUP}, {_RANKED} select text, reading, entry_id, score, cast(place as int) as place, candidate_count from ranked where place <= 8")
def rank_entries(t: Tables) -> DataFrame:
    ranked = lo.rank_entries(lo.dictionary_candidates(_lookup_words(t), _entries(t)), 8)
    return ranked.select("text", "reading", "entry_id", "score", "place", "candidate_count")


@query("normalize_entry", f"""
with {_LOOKUP}, b as (select text, reading, arg_max(entry_id, struct_pack(s := score, o := -ord)) as entry_id from c group by all)
select text, reading, b.entry_id, concat(reverse(written), '/to ', written) as glosses from b join e on e.entry_id = b.entry_id
""")
def normalize_entry(t: Tables) -> DataFrame:
    ranked = lo.rank_entries(lo.dictionary_candidates(_lookup_words(t), _entries(t)), 1)
    return ranked.select("text", "reading", "entry_id", F.array_join("glosses", "/").alias("glosses"))


@query("flatten_meanings", f"with {_LOOKUP} select entry_id, concat(reverse(written), '/to ', written) as glosses from e")
def flatten_meanings(t: Tables) -> DataFrame:
    return _entries(t).select("entry_id", F.array_join(lx.flatten_glosses(F.col("meanings")), "/").alias("glosses"))


@query("best_entry_per_variant", """
with s as (select written, reverse(written) as gloss, 10 as score, 1 as ord from dictionary union all
  select written, concat(written, '!'), case when length(written) % 2 = 0 then 10 else 20 end, 2 from dictionary)
select written, arg_max(gloss, struct_pack(s := score, o := -ord)) as gloss, max(score) as score from s group by written
""")
def best_entry_per_variant(t: Tables) -> DataFrame:
    shaped = t.dictionary.withColumn("variants", F.array(F.struct("written")))
    both = shaped.select("variants", F.col("gloss"), F.lit(10).alias("score"), F.lit(1).alias("ord")).unionByName(
        shaped.select("variants", F.concat("written", F.lit("!")).alias("gloss"),
                      F.when(F.length("written") % 2 == 0, 10).otherwise(20).alias("score"), F.lit(2).alias("ord")))
    return lo.best_entry_per_variant(both).select(F.col("variants")[0]["written"].alias("written"), "gloss", "score")


@query("merge_rank_entries", """
with r as (select length(written) as key, written, pronounced, row_number() over (partition by length(written) order by written) as ord from dictionary),
a as (select key, ord, 0 as side, 'jmdict' as source, ord % 50 as score, written as v from r
  union all select key, ord, 1, 'app_editorial', ord % 60, pronounced from r),
u as (select key, v, arg_max(struct_pack(s := source, c := score, d := side, o := ord), struct_pack(c := score, d := -side, o := -ord)) as e from a group by all),
p as (select key, v as written, e.s as source, e.c as score, row_number() over (partition by key order by e.c desc, e.d, e.o) as place from u)
select key, written, source, score, cast(place as int) as place from p where place <= 4
""")
def merge_rank_entries(t: Tables) -> DataFrame:
    from annolytics.plans.skew import ordered_index
    numbered = ordered_index(t.dictionary.withColumn("key", F.length("written")), ["key"], ["written"], "ord")

    def side(source: str, score: int, column: str) -> DataFrame:
        return numbered.select("key", "ord", F.lit(source).alias("source"), (F.col("ord") % score).alias("score"),
                               F.array(F.struct(F.col(column).alias("written"))).alias("variants"), F.array("gloss").alias("glosses"))

    merged = lo.merge_rank_entries(side("kanjiapi.dev:/words", 50, "written"), side("local:extended", 60, "pronounced"), ["key"], 4)
    return merged.select("key", F.col("variants")[0]["written"].alias("written"), "source", "score", "place")


@query("dictionary_source", """
with w as (select distinct lemma as key from tokens where lemma <> '')
select key, count(d.entry_id) as entries from w left join dictionary d on d.written = w.key group by key
""")
def dictionary_source(t: Tables) -> DataFrame:
    keys = t.tokens.where("lemma <> ''").select(F.col("lemma").alias("key")).distinct()
    found = t.dictionary.groupBy(F.col("written").alias("key")).agg(F.count(F.lit(1)).alias("entries"))
    return keys.join(found, "key", "left").select("key", F.coalesce("entries", F.lit(0)).alias("entries"))


def _looked_up(t: Tables) -> DataFrame:
    plain = F.translate("lemma", "àâçèéêîôùûü", "aaceeeiouuu")
    tokens = _tagged(t).withColumn("reading", plain)
    words = lo.distinct_words(tokens)
    lookup = lo.lookup_words(words, lo.rank_entries(lo.dictionary_candidates(words, _entries(t))))
    return lo.attach_lookup(tokens, lookup)


_ATTACHED = """
n as (select text, reading, count(*) as n, arg_max(entry_id, struct_pack(s := score, o := -ord)) as top from c group by all),
att as (select t.*, translate(t.lemma, 'àâçèéêîôùûü', 'aaceeeiouuu') as read, a.n as an, a.top as atop, b.n as bn, b.top as btop
  from tokens t left join n a on a.text = t.surface and a.reading = translate(t.lemma, 'àâçèéêîôùûü', 'aaceeeiouuu')
  left join n b on b.text = t.lemma and b.reading = '' and t.lemma <> t.surface)
"""


@query("lookup_fallback_chain", f"""
with {_LOOKUP}, {_ATTACHED}
select conv_id, turn, pos, coalesce(atop, btop) as top_entry, coalesce(an, bn, 0) as candidate_count,
  case when an is not null then 'surface' when bn is not null then 'lemma' else 'none' end as found_by from att
""")
def lookup_fallback_chain(t: Tables) -> DataFrame:
    return _looked_up(t).select(
        "conv_id", "turn", "pos", F.get("entries", F.lit(0))["entry_id"].alias("top_entry"), "candidate_count", "found_by")


# Words without a tag and a reading are shown only if the dictionary has entries for them.
@query("meaningful_units", f"""
with {_LOOKUP}, {_ATTACHED},
u as (select conv_id, turn, pos, surface, tag, length(surface) % 3 = 1 as untagged, regexp_matches(surface, '[\\p{{L}}\\p{{N}}]') as spoken, coalesce(an, bn, 0) as entry_count from att)
select conv_id, turn, pos, entry_count from u where case when not untagged and tag = '補助記号' then false when not spoken then length(surface) = 1 or entry_count > 0
  when untagged then entry_count > 0 else true end
""")
def meaningful_units(t: Tables) -> DataFrame:
    untagged = F.length("surface") % 3 == 1
    units = _looked_up(t).withColumns({
        "tags": F.when(untagged, F.array().cast("array<string>")).otherwise(F.array("tag")), "reading": F.when(~untagged, F.col("reading"))})
    units = units.withColumns({
        "text": F.col("surface"), "kind": lx.unit_kind(F.col("tags")), "entry_count": F.col("candidate_count"),
        "codepoint": F.when(F.length("surface") == 1, tx.codepoint(F.col("surface"))).otherwise("")})
    return lo.meaningful_units(units).select("conv_id", "turn", "pos", F.col("entry_count").cast("bigint").alias("entry_count"))


_GLOSSED = """
glossed as (select conv_id, turn, pos, surface, tag, not regexp_matches(surface, '[\\p{L}\\p{N}]') or tag = '補助記号' as is_sign,
  coalesce(case when coalesce(atop, btop) is not null then reverse(regexp_replace(coalesce(atop, btop), '#2$', '')) end,
    ls.n_name, case when tag in ('助詞', '助動詞') then fs.p_type end, ll.n_name, case when tag in ('助詞', '助動詞') then fl.p_type end,
    case when not regexp_matches(surface, '[\\p{L}\\p{N}]') or tag = '補助記号' then surface end,
    case when tag = '固有名詞' then coalesce(nullif(read, ''), nullif(lemma, ''), surface) end, coalesce(nullif(lemma, ''), surface)) as gloss
  from att left join lexi ls on ls.word = surface left join func fs on fs.word = surface
  left join lexi ll on ll.word = lemma left join func fl on fl.word = lemma),
"""
# Dimensions of whole words: longer words carry the name of a nation, short ones the type of a part,
# one for each word and picked by its letters, so that every name is some word's.
_PICK = "(ascii(word) * 7 + length(word) * 3 + ascii(right(word, 1)))"
_FUNC = f"""
func as (select word, p_type from (select distinct surface as word from tokens where length(surface) between 1 and 3) w
  join part on p_partkey = 1 + {_PICK} % 200),
"""
_DIMS = f"""
lexi as (select word, n_name from (select distinct lemma as word from tokens where length(lemma) >= 4) w join nation on n_nationkey = {_PICK} % 25),
{_FUNC}
"""


def _short_words(t: Tables) -> DataFrame:
    words = t.tokens.where(F.length("surface").between(1, 3)).select(F.col("surface").alias("word")).distinct()
    return words.withColumn("p_partkey", F.expr(f"1 + {_PICK} % 200")).join(t.part, "p_partkey").select("word", "p_type")


def _glossed(t: Tables) -> DataFrame:
    words = t.tokens.where(F.length("lemma") >= 4).select(F.col("lemma").alias("word")).distinct()
    lexical = words.withColumn("n_nationkey", F.expr(f"{_PICK} % 25")).join(t.nation, "n_nationkey").select(
        "word", F.col("n_name").alias("gloss"))
    functional = _short_words(t).withColumnRenamed("p_type", "gloss")
    return lo.with_glosses(_looked_up(t), lexical, functional, t.characters)


@query("gloss_with_precedence", f"""
with {_DIMS} {_LOOKUP}, {_ATTACHED}, {_GLOSSED} x as (select 1) select conv_id, turn, pos, gloss from glossed
""")
def gloss_with_precedence(t: Tables) -> DataFrame:
    return _glossed(t).select("conv_id", "turn", "pos", "gloss")


@query("region_glossary", f"""
with {_DIMS} {_LOOKUP}, {_ATTACHED}, {_GLOSSED}
n2 as (select conv_id, turn, count(*) as token_count, cast(0 as bigint) as ideograph_count from glossed group by all),
g2 as (select conv_id, turn, pos // 1000 as part, string_agg(gloss, ' ' order by pos) as glossary from glossed where not is_sign and gloss <> '' group by all)
select n2.*, g2.part, g2.glossary from n2 left join g2 using (conv_id, turn)
""")
def region_glossary(t: Tables) -> DataFrame:
    return lo.region_glossary(_glossed(t), ["conv_id", "turn"])


@query("grammar_lookup", f"""
with {_FUNC} g as (select word, p_type as label from func)
select conv_id, turn, pos, coalesce(a.label, b.label) as label from tokens t left join g a on a.word = t.surface left join g b on b.word = t.lemma
""")
def grammar_lookup(t: Tables) -> DataFrame:
    return lo.grammar_lookup(_tagged(t), _grammar(t)).select("conv_id", "turn", "pos", F.col("grammar.label").alias("label"))


def _grammar(t: Tables) -> DataFrame:
    return _short_words(t).select(
        "word", F.col("p_type").alias("label"), F.array(F.concat(F.lit("note "), "word")).alias("notes"), F.array(F.lit("grammar")).alias("tags"))


@query("local_reference_entries", f"""
with {_FUNC} g as (select word, p_type as label from func),
k as (select conv_id, turn, pos, surface, lemma, tag, translate(surface, '{LETTERS}', '{AS_KANA}') as kana from tokens),
i as (select conv_id * 10000000 + turn * 100000 + pos as id, * from k),
{_romaji_sql("i", "id", "kana")}
select conv_id, turn, pos, 'local:grammar' as source, 780 as score, concat(coalesce(a.label, b.label), '/note ', coalesce(a.word, b.word)) as glosses
  from k left join g a on a.word = k.surface left join g b on b.word = k.lemma where tag in ('助詞', '助動詞') and coalesce(a.label, b.label) is not null
union all select conv_id, turn, pos, 'local:kana', 660, concat('hiragana sequence (', romaji, ')') from i join spelt using (id)
  where regexp_matches(kana, '^[ぁ-ゖ]{{1,4}}$') and (tag in ('助詞', '助動詞', '補助記号') or length(kana) <= 2)
union all select conv_id, turn, pos, 'local:symbols', 720, concat('sign ', surface, '/mark') from k where tag = '補助記号' and surface in ('&', '-', '.')
""")
def local_reference_entries(t: Tables) -> DataFrame:
    symbols = dimensions.word_notes(t.spark, {s: {"label": f"sign {s}", "glosses": ["mark"]} for s in ("&", "-", ".")})
    columns = ["conv_id", "turn", "pos", "source", "score", "glosses"]
    latin = lo.local_entries(_tagged(t), _grammar(t), symbols).where("source <> 'local:kana'").select(columns)
    kana = _tagged(t).withColumn("surface", F.translate("surface", LETTERS, AS_KANA))
    spelt = lo.local_entries(kana, _grammar(t), symbols).where("source = 'local:kana'").select(columns)
    return latin.unionByName(spelt).withColumn("glosses", F.array_join("glosses", "/"))


@query("char_lookup", """
with p as (select conv_id, turn, pos, surface, i, surface[i] as ch from mixed_tokens, unnest(range(1, length(surface) + 1)) as u(i))
select conv_id, turn, pos, cast(i - 1 as int) as char_index, ch as character, surface[1:i - 1] as prefix, surface[i + 1:] as suffix,
  printf('words_%03d_kanji_%02d', pos, i - 1) as child_id, c.meaning from p left join characters c on c.character = ch where regexp_matches(ch, '^[㐀-鿿]$')
""")
def char_lookup(t: Tables) -> DataFrame:
    return lo.character_units(t.mixed_tokens, t.characters).select(
        "conv_id", "turn", "pos", "char_index", "character", "prefix", "suffix", "child_id", "meaning")


@query("reading_lookup", f"""
with w as (select distinct reading from tokens where trim(reading) <> ''),
i as (select distinct written as character, translate(written, '{LETTERS}', '{AS_KANA}') as reading, false as name from dictionary
  union select distinct written, translate(pronounced, '{LETTERS}', '{AS_KANA}'), true from dictionary)
select reading, character, name from w left join i using (reading)
""")
def reading_lookup(t: Tables) -> DataFrame:
    kana = lambda c: F.array(F.translate(c, LETTERS, AS_KANA))
    chars = t.dictionary.select(F.col("written").alias("character"), kana("written").alias("readings"), kana("pronounced").alias("name_readings"))
    return lo.reading_lookup(t.tokens, chars)


@query("lookup_hit_totals", """
with h as (select concat(conv_id, ':', turn) as region, d.written is not null as hit from tokens t left join (select distinct written from dictionary) d on d.written = t.surface)
select region, count(*) filter (hit) as lookup_hits, count(*) filter (not hit) as lookup_misses from h group by rollup (region)
""")
def lookup_hit_totals(t: Tables) -> DataFrame:
    cache = t.dictionary.select(F.col("written").alias("cache_key"))
    return lo.lookup_totals(t.tokens, cache, ["conv_id", "turn"])


@query("source_catalog", """
with c as (select distinct source as source_id, upper(source) as name from documents),
u as (select distinct source from documents d join labels l using (doc_id) where l.quality = 1)
select source_id, name from c where source_id in (select source from u)
""")
def source_catalog(t: Tables) -> DataFrame:
    catalog = t.documents.select(F.col("source").alias("source_id"), F.upper("source").alias("name")).distinct()
    rated = t.documents.join(t.labels.where("quality = 1"), "doc_id").select(F.array("source").alias("source_ids"))
    return lo.source_subset(catalog, rated)


@query("source_union", """
with c as (select distinct source as source_id, upper(source) as name from documents),
d as (select doc_id, source as a, 'app_editorial' as b, concat('src', doc_id % 9) as e from documents)
select doc_id, array_to_string(list_filter([a, b, case when e <> a then e end], lambda x: x is not null), ',') as ids,
  concat(upper(a), ' + ', b, case when e <> a then concat(' + ', coalesce(c.name, e)) else '' end) as names
from d left join c on c.source_id = d.e
""")
def source_union(t: Tables) -> DataFrame:
    catalog = t.documents.select(F.col("source").alias("source_id"), F.upper("source").alias("name")).distinct()
    words = t.documents.select("doc_id", "source", F.array(
        F.lit("local:grammar"), F.concat(F.lit("src"), (F.col("doc_id") % 9).cast("string"))).alias("entry_sources"))
    joined = lo.source_union(words, catalog)
    return joined.select("doc_id", F.array_join("source_ids", ",").alias("ids"), F.col("source_names").alias("names"))


@query("field_provenance", """
select conv_id, turn, pos, concat('lemma=sudachi;pos=sudachi,app_editorial', case when tag = '助詞' then ';grammar_detail=app_editorial' else '' end,
  case when length(surface) = 1 then ';unicode_metadata=unicode' else '' end) as provenance from tokens
""")
def field_provenance(t: Tables) -> DataFrame:
    ids = lambda *names: F.array(*(F.lit(n) for n in names))
    fields = lo.field_provenance({
        "lemma": ids("sudachi"), "pos": ids("sudachi", "app_editorial"),
        "grammar_detail": F.when(F.col("tag") == "助詞", ids("app_editorial")),
        "unicode_metadata": F.when(F.length("surface") == 1, ids("unicode")),
    })
    shown = F.array_join(F.transform(F.map_entries("f"), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return t.tokens.withColumn("f", fields).select("conv_id", "turn", "pos", shown.alias("provenance"))


# -- markup ---------------------------------------------------------------------

# DuckDB marks where blocks begin and end and cuts at the marks; Spark folds over the tags.
@query("html_section_text", r"""
with c as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', '', 'gis'),
  '<style\b[^>]*>.*?</style\s*>', '', 'gis'), '<table\b[^>]*>.*?</table\s*>', '', 'gis'), '<figure\b[^>]*>.*?</figure\s*>', '', 'gis'), '<!--.*?-->', '', 'gs') as h from pages),
m as (select page_id, regexp_replace(regexp_replace(regexp_replace(h, '<(?:p|li)(?:\s[^>]*)?(?:>|$)', chr(2) || chr(1), 'gi'),
  '</?(?:p|li|ul|ol|div|h[1-6]|article|section|header|footer|nav|main|aside|body|html)(?:\s[^>]*)?(?:>|$)', chr(2), 'gi'), '<[a-zA-Z/!][^>]*(?:>|$)', '', 'g') as h from c),
b as (select page_id, list_filter(list_transform(string_split(h, chr(1))[2:], lambda x:
  regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(split_part(x, chr(2), 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
  '[\s\p{Z}]+', ' ', 'g')), '\[[0-9]+\]', '', 'g')), lambda x: x <> '') as bs from m)
select page_id, len(bs) as blocks, array_to_string(bs, chr(10) || chr(10)) as text from b
""")
def html_section_text(t: Tables) -> DataFrame:
    read = t.pages.withColumn("b", mk.reading_blocks(F.col("html")))
    return read.select("page_id", F.size("b").alias("blocks"), F.array_join("b", "\n\n").alias("text"))


_SVG = ("concat('<svg xmlns=\"http://www.w3.org/2000/svg\" xmlns:kvg=\"http://example.org/kvg\"><g kvg:element=\"', source, '\"><g kvg:element=\"', language, "
        "'\" kvg:position=\"p', cast(line_count as string), '\"><path id=\"s1\" d=\"M', cast(x1 as string), ' ', cast(y1 as string), ' L', cast(x2 as string), ' ', cast(y2 as string), "
        "'\"/></g><g kvg:element=\"', language, '\" kvg:position=\"p', cast(line_count as string), '\"><path d=\"javascript:', cast(ord as string), '\"/><path d=\"m0,', cast(width as string), 'z\"/></g></g></svg>')")


@query("svg_path_extract", """
select panel_id, ord, concat('M', x1, ' ', y1, ' L', x2, ' ', y2, ';m0,', width, 'z') as paths, concat(language, '|p', line_count) as components from placed_boxes
""")
def svg_path_extract(t: Tables) -> DataFrame:
    documents = t.placed_boxes.withColumn("xml", F.expr(_SVG))
    return documents.select(
        "panel_id", "ord", F.array_join(mk.stroke_paths(F.col("xml")), ";").alias("paths"),
        F.array_join(mk.stroke_components(F.col("xml"), F.col("source")), ";").alias("components"))
