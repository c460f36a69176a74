"""Text measures, quality hints and kana handling as columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes. A caller with texts in another script
# passes its own class wherever one is a parameter.
KANA = "[぀-ヿ]"
IDEOGRAPH = "[㐀-鿿]"
SCRIPT = "[぀-ヿ㐀-鿿]"
LATIN = "[A-Za-zＡ-Ｚａ-ｚ]"
DIGIT = "[0-9０-９]"
ORDINARY_MARKS = "。、！？…・"

# Hepburn romanisation of single kana.
HEPBURN = """
あ a い i う u え e お o
か ka き ki く ku け ke こ ko
が ga ぎ gi ぐ gu げ ge ご go
さ sa し shi す su せ se そ so
ざ za じ ji ず zu ぜ ze ぞ zo
た ta ち chi つ tsu て te と to
だ da ぢ ji づ zu で de ど do
な na に ni ぬ nu ね ne の no
は ha ひ hi ふ fu へ he ほ ho
ば ba び bi ぶ bu べ be ぼ bo
ぱ pa ぴ pi ぷ pu ぺ pe ぽ po
ま ma み mi む mu め me も mo
や ya ゆ yu よ yo
ら ra り ri る ru れ re ろ ro
わ wa ゐ i ゑ e を o ん n
ぁ a ぃ i ぅ u ぇ e ぉ o ゎ wa ゔ vu
"""

# Hepburn romanisation of kana pairs.
HEPBURN_PAIRS = """
きゃ kya きゅ kyu きょ kyo ぎゃ gya ぎゅ gyu ぎょ gyo
しゃ sha しゅ shu しょ sho じゃ ja じゅ ju じょ jo
ちゃ cha ちゅ chu ちょ cho にゃ nya にゅ nyu にょ nyo
ひゃ hya ひゅ hyu ひょ hyo びゃ bya びゅ byu びょ byo
ぴゃ pya ぴゅ pyu ぴょ pyo みゃ mya みゅ myu みょ myo
りゃ rya りゅ ryu りょ ryo
てぃ ti でぃ di とぅ tu どぅ du
ふぁ fa ふぃ fi ふぇ fe ふぉ fo
ゔぁ va ゔぃ vi ゔぇ ve ゔぉ vo
しぇ she じぇ je ちぇ che
"""


def _pairs(table: str) -> dict[str, str]:
    words = table.split()
    return dict(zip(words[::2], words[1::2]))


ROMAJI = {**_pairs(HEPBURN), **_pairs(HEPBURN_PAIRS)}
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
# Kana the tables read, as a character class.
_READ = "".join(k for k in ROMAJI if len(k) == 1)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_chars(text: Column, chars: str) -> Column:
    """Characters of a class (written like ``[a-z]``), by the length that goes
    when its runs are removed. A match count would build an array of single
    characters, and Java is slow on negated classes, so neither is used."""
    if chars.startswith("[^"):
        return F.length(F.regexp_replace(text, f"[{chars[2:-1]}]+", ""))
    return F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))


def count_signs(text: Column, signs: str) -> Column:
    """Occurrences of any of a few given characters."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def clean_text(text: Column) -> Column:
    """Without white space and vertical bars; the wording stays."""
    return F.regexp_replace(text, r"[\s\p{Z}|｜]+", "")


def script_counts(text: Column, script: str = SCRIPT) -> dict[str, Column]:
    return {
        "kana": count_chars(text, KANA), "ideographs": count_chars(text, IDEOGRAPH),
        "latin": count_chars(text, LATIN), "digits": count_chars(text, DIGIT),
        "script": count_chars(text, script),
        "script_ratio": count_chars(text, script) / F.greatest(F.lit(1), F.length(text)),
    }


def baseline_score(text: Column, script: str = SCRIPT) -> Column:
    """3 per script character plus the length, less 8 per bad character; -100 when empty."""
    bad = count_signs(text, "�?")
    score = count_chars(text, script) * 3 + F.length(text) - bad * 8
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, score).otherwise(-100)


def repeated_run(text: Column) -> Column:
    """Six or more of the same character in a row."""
    return text.rlike(r"(.)\1{5,}")


def warnings_from(
    found: Column, length: Column, marked: Column, run: Column, score: Column, close_scores: Column,
) -> Column:
    """Quality hints in a fixed order, from the measures of a text; an empty
    text gives only 'empty_ocr'."""
    hints = F.array(
        F.when(found == 0, F.lit("no_japanese_chars"))
        .when(found / F.greatest(F.lit(1), length) < 0.55, F.lit("low_japanese_ratio")),
        F.when(length <= 2, F.lit("very_short_text")),
        F.when(marked, F.lit("replacement_or_question_marks")),
        F.when(run, F.lit("repeated_character_run")),
        F.when(close_scores, F.lit("close_ocr_variant_scores")),
        F.when(score < 8, F.lit("low_ocr_score")),
    )
    return F.when(length == 0, F.array(F.lit("empty_ocr"))).otherwise(F.filter(hints, lambda h: h.isNotNull()))


def has_replacement(text: Column) -> Column:
    return F.contains(text, F.lit("?")) | F.contains(text, F.lit("ï¿½"))


def text_warnings(text: Column, score: Column, close_scores: Column, script: str = SCRIPT) -> Column:
    """Quality hints of a text."""
    text = F.coalesce(text, F.lit(""))
    return warnings_from(
        count_chars(text, script), F.length(text), has_replacement(text), repeated_run(text), score, close_scores)


# Warnings that lower the confidence by themselves.
SEVERE_WARNINGS = ("empty_ocr", "no_japanese_chars", "low_ocr_score")


def has_severe(warnings: Column) -> Column:
    return F.arrays_overlap(warnings, F.array(*(F.lit(w) for w in SEVERE_WARNINGS)))


def confidence(length: Column, score: Column, warnings: Column) -> Column:
    """0.55 + score/150 (score within 0..60), less 0.08 per warning (four at
    most) and 0.18 for a severe one, within 0.05..0.98; 0 for an empty text."""
    lift = F.least(F.greatest(score, F.lit(0)), F.lit(60)) / 150
    less = F.least(F.size(warnings), F.lit(4)) * F.lit(0.08)
    severe = F.when(has_severe(warnings), F.lit(0.18)).otherwise(F.lit(0.0))
    value = F.greatest(F.lit(0.05), F.least(F.lit(0.98), F.lit(0.55) + lift - less - severe))
    return F.when(length > 0, value).otherwise(F.lit(0.0))


def quality(confidence_value: Column, warnings: Column | None = None) -> Column:
    """good from 0.78 (and without warnings, when given), warn from 0.52, else bad."""
    good = confidence_value >= 0.78
    if warnings is not None:
        good = good & (F.size(warnings) == 0)
    return F.when(good, "good").when(confidence_value >= 0.52, "warn").otherwise("bad")


def distinct_chars(text: Column, script: str = IDEOGRAPH, ordered: bool = True) -> Column:
    """Distinct characters of a script: sorted, or in order of first appearance."""
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(script), 0))
    return F.array_sort(seen) if ordered else seen


def ordered_distinct(values: Column) -> Column:
    """Trimmed, non-blank, distinct, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.btrim(v)), lambda v: F.length(v) > 0))


def every_nth(values: Column, limit: int) -> Column:
    """At most ``limit`` elements at a fixed step (the whole array if it fits)."""
    step = F.greatest(F.lit(1), F.ceil(F.size(values) / limit)).cast("int")
    return F.filter(values, lambda _v, i: i % step == 0)


# -- kana --------------------------------------------------------------------

def katakana_to_hiragana(text: Column) -> Column:
    return F.translate(text, KATAKANA, HIRAGANA)


_PAIRED = tuple((k, r) for k, r in ROMAJI.items() if len(k) == 2)
_SINGLE = {ord(k): r for k, r in ROMAJI.items() if len(k) == 1}
_HIRAGANA = dict(zip(map(ord, KATAKANA), HIRAGANA, strict=True))
_MARKS = regex.compile("(っ[っー]*ー)(?![っー])")
_CROWDED = regex.compile("っ(?=[っー])")
_DOUBLED = regex.compile(rf"っ([\p{{L}}--[{_READ}っー]])", regex.V1)
_LONG = regex.compile("([aeiou]?)(ー+)")


def _romaji(text: str) -> str:
    text = text.translate(_HIRAGANA)
    if "っ" in text:
        text = _CROWDED.sub("", _MARKS.sub(r"\1っ", text))
        text = _DOUBLED.sub(r"\1\1", text.replace("っん", "ん").replace("っn", "n"))
    for kana, roman in _PAIRED:
        text = text.replace(kana, roman)
    text = text.translate(_SINGLE)
    if "ー" in text:
        text = _LONG.sub(lambda m: m[1] + m[1] * len(m[2]), text)
    if "っ" in text:
        text = regex.sub("っ([a-z])", r"\1\1", text.replace("っch", "tch")).replace("っ", "")
    return text


@F.pandas_udf(StringType())
def _romanised(texts: pd.Series) -> pd.Series:
    return texts.map(_romaji, na_action="ignore")


def kana_to_romaji(text: Column) -> Column:
    """Hepburn romanisation; characters outside the tables pass through.

    A long mark repeats the vowel right before it; a doubling mark doubles the
    first letter of what follows (t before ch), except for a lone n. The whole
    text goes through a few passes, marks first: in a run of marks the long
    ones move to the front and one doubling mark stays at the end, so that each
    kind sees its own neighbour.
    """
    return _romanised(text.cast("string"))


def _short_romaji(text: Column) -> Column:
    """The same as built-in functions, for parts inside an array, which no user function reaches."""
    text = katakana_to_hiragana(text)
    text = F.regexp_replace(text, "(っ[っー]*ー)(?![っー])", "$1っ")
    text = F.regexp_replace(text, "っ(?=[っー])", "")
    text = F.regexp_replace(text, "っ([んn])", "$1")
    text = F.regexp_replace(text, rf"っ([\p{{L}}&&[^{_READ}っー]])", "$1$1")
    for kana, roman in sorted(ROMAJI.items(), key=lambda item: -len(item[0])):
        text = F.replace(text, F.lit(kana), F.lit(roman))
    for vowel in "aeiou":
        text = F.regexp_replace(text, rf"(?:(?<={vowel})|\G(?<=ー))ー", vowel)
    text = F.replace(F.replace(text, F.lit("ー"), F.lit("")), F.lit("っch"), F.lit("tch"))
    return F.replace(F.regexp_replace(text, "っ([a-z])", "$1$1"), F.lit("っ"), F.lit(""))


def structured_readings(readings: Column) -> Column:
    """Each reading with its romanisation; dots and dashes stay in place."""
    def one(kana: Column) -> Column:
        parts = F.split(kana, r"(?=[.-])|(?<=[.-])")
        roman = F.transform(parts, lambda p: F.when(p.isin(".", "-"), p).otherwise(
            F.replace(_short_romaji(p), F.lit(" "), F.lit(""))))
        return F.struct(kana.alias("kana"), F.array_join(roman, "").alias("romaji"))

    kept = F.filter(F.transform(readings, lambda r: F.btrim(r)), lambda r: F.length(r) > 0)
    return F.transform(kept, one)


# The Unicode general categories.
CATEGORIES = (
    "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co Cs"
).split()


def codepoint(character: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(character))


def unicode_category(character: Column) -> Column:
    tests = [F.when(character.rlike(rf"^\p{{{c}}}$"), F.lit(c)) for c in CATEGORIES]
    return F.coalesce(*tests, F.lit("Cn"))


# -- tokens ------------------------------------------------------------------

# Runs of one script: ideographs, hiragana, katakana, letters and digits, or one other sign.
TOKEN = "[㐀-鿿]+|[ぁ-ゟ]+|[゠-ヿ]+|[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"


def script_runs(text: Column, pattern: str = TOKEN) -> Column:
    """Native tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def plain_tokens(surfaces: Column) -> Column:
    """Token structs without analysis, for texts no analyser has seen."""
    return F.transform(surfaces, lambda s: F.struct(
        s.alias("surface"), s.alias("lemma"), F.lit("").alias("reading"),
        F.array().cast("array<string>").alias("pos")))


def is_symbol(surface: Column, pos: Column) -> Column:
    """A sign: tagged so, or without any letter, digit or script character."""
    tagged = F.exists(pos, lambda p: F.contains(p, F.lit("補助記号")))
    return tagged | ((F.length(surface) > 0) & ~surface.rlike(r"[\p{L}\p{N}]|" + SCRIPT))


def token_classes(tokens: Column, script: str = SCRIPT, hints: Sequence[str] = ()) -> Column:
    """One letter per token: s sign, k known, o opaque in script, l Latin,
    d digit, h hinted, x other. A compact text that the measures below count."""
    known_words = F.array(*(F.lit(h) for h in hints)).cast("array<string>")

    def one(t: Column) -> Column:
        surface, lemma = t["surface"], F.coalesce(t["lemma"], F.lit(""))
        hinted = F.array_contains(known_words, surface) | F.array_contains(known_words, lemma)
        analysed = (
            (F.size(t["pos"]) > 0) | ((F.length(lemma) > 0) & (lemma != surface))
            | F.coalesce(t["reading"], F.lit("")).rlike(KANA)
        )
        return (
            F.when(is_symbol(surface, t["pos"]), "s")
            .when(surface.rlike(script), F.when(analysed | hinted, "k").otherwise("o"))
            .when(surface.rlike(DIGIT), "d").when(surface.rlike(LATIN), "l")
            .when(hinted, "h").otherwise("x")
        )

    return F.array_join(F.transform(tokens, one), "")


def char_counts(text: Column, script: str = SCRIPT) -> dict[str, Column]:
    """Script characters, and characters other than white space."""
    return {
        "script_chars": count_chars(text, script),
        "shown_chars": F.length(F.regexp_replace(text, r"[\s\p{Z}]+", "")),
    }


def class_counts(classes: Column) -> dict[str, Column]:
    """Token counts from the class letters of :func:`token_classes`."""
    return {
        "tokens": F.length(classes), "scored": count_matches(classes, "[^s]"),
        "native": count_matches(classes, "[ko]"), "known": count_matches(classes, "[kh]"),
        "latin": count_matches(classes, "l"),
    }


def run_lines(text: Column) -> Column:
    """The native tokens of a text, one per line."""
    return F.array_join(script_runs(text), "\n")


def usable_hints(hints: Sequence[str], script: str = SCRIPT) -> list[str]:
    """Hints that make an unanalysed token known: in script or free of Latin letters and digits."""
    return [h for h in hints if re.search(script, h) or not re.search(f"{LATIN}|{DIGIT}", h)]


def run_counts(lines: Column, script: str = SCRIPT, hints: Sequence[str] = ()) -> dict[str, Column]:
    """The same counts for unanalysed tokens, one per line: a handful of regular
    expression passes over the whole text instead of a rule per token. Without
    analysis a token is known only as a hint, in script or free of Latin letters
    and digits."""
    usable = usable_hints(hints, script)
    breaks = F.length(lines) - F.length(F.replace(lines, F.lit("\n"), F.lit("")))
    tokens = F.when(F.length(lines) > 0, breaks + 1).otherwise(0)
    signs = count_chars(lines, rf"[^\p{{L}}\p{{N}}{SCRIPT[1:-1]}{script[1:-1]}\n]")
    known = count_matches(lines, "(?m)^(?:" + "|".join(re.escape(h) for h in usable) + ")$") if usable else F.lit(0)
    inner = script[1:-1]
    return {
        "tokens": tokens, "scored": tokens - signs, "known": known,
        # From the first script character to the end of its line: one per line.
        "native": count_matches(lines, f"{script}.*"),
        "latin": count_matches(lines, f"(?m)^(?!.*[{inner}0-9０-９]).*{LATIN}.*$"),
    }


def plausibility(counts: dict[str, Column]) -> dict[str, Column]:
    """Ratios, penalties and a score within -12..20 from token and character counts."""
    char_ratio = counts["script_chars"] / F.greatest(F.lit(1), counts["shown_chars"])
    scored, native, known, latin = (counts[k] for k in ("scored", "native", "known", "latin"))
    opaque = scored - known
    total = F.greatest(F.lit(1), scored)
    shape = F.when(native > 0, F.least(scored, F.lit(8)) / 8).otherwise(F.lit(0.0))
    mixed = F.when((latin > 0) & (native == 0), F.lit(-12.0)).when(
        latin > 0, -F.least(F.lit(6.0), latin * 2.0)).otherwise(F.lit(0.0))
    majority = F.when(opaque / total >= 0.75, F.lit(-6.0)).otherwise(F.lit(0.0))
    foreign = F.when(char_ratio < 0.35, F.lit(-6.0)).otherwise(F.lit(0.0))
    score = known / total * 10.0 + native / total * 8.0 + shape * 4.0 + mixed + majority + foreign
    some = counts["tokens"] > 0

    def when_some(value: Column) -> Column:
        return F.when(some, value).otherwise(F.lit(0.0))

    return {
        "score": when_some(F.round(F.greatest(F.lit(-12.0), F.least(F.lit(20.0), score)), 3)),
        "token_count": counts["tokens"], "scored_token_count": scored,
        "known_ratio": when_some(F.round(known / total, 3)),
        "script_token_ratio": when_some(F.round(native / total, 3)),
        "latin_token_ratio": when_some(F.round(latin / total, 3)),
        "opaque_token_ratio": when_some(F.round(opaque / total, 3)),
        "char_script_ratio": when_some(F.round(char_ratio, 3)),
        "penalty": when_some(mixed + majority + foreign),
    }
