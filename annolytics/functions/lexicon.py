"""Dictionary scoring and labelling as columns.

An entry has variants array<struct<written, pronounced, priorities>> and
meanings array<struct<glosses>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annolytics.functions.text import IDEOGRAPH, katakana_to_hiragana, ordered_distinct

# Weight of a priority tag by its prefix; nfNN weighs 80 - NN, at least 1.
PRIORITY_WEIGHTS = {"ichi": 100, "news": 90, "spec": 70, "gai": 60}

# Readable priority tags.
PRIORITY_LABELS = {
    "news1": "Mainichi newspaper priority, first 12,000 words",
    "news2": "Mainichi newspaper priority, second 12,000 words",
    "ichi1": "Ichimango common-word list, higher-priority subset",
    "ichi2": "Ichimango common-word list, lower-priority subset",
    "spec1": "special common-word priority, first group",
    "spec2": "special common-word priority, second group",
    "gai1": "common loanword list, higher-priority subset",
    "gai2": "common loanword list, lower-priority subset",
}

# Part-of-speech markers of the analyser's tag set.
PARTICLE, AUXILIARY, SUFFIX, PROPER_NOUN, SIGN = "助詞", "助動詞", "接尾", "固有名詞", "補助記号"

# Labels of unit kinds.
UNIT_LABELS = {
    "word": "segment", "particle": "particle", "aux": "auxiliary", "suffix": "suffix",
    "kanji": "kanji", "whole": "full text",
}
GRAMMATICAL_KINDS = ("particle", "aux", "suffix")


def priority_weight(tag: Column) -> Column:
    tag = F.coalesce(tag, F.lit(""))
    number = F.nullif(F.regexp_extract(tag, r"(\d+)", 1), F.lit("")).cast("int")
    weight = F.when(tag.startswith("nf"), F.coalesce(F.greatest(F.lit(1), F.lit(80) - number), F.lit(50)))
    for prefix, value in PRIORITY_WEIGHTS.items():
        weight = weight.when(tag.startswith(prefix), value)
    return weight.otherwise(0)


def priority_label(tag: Column) -> Column:
    tag = F.coalesce(tag, F.lit(""))
    band = F.nullif(F.regexp_extract(tag, r"^nf(\d{2})$", 1), F.lit("")).cast("int")
    label = F.when(band.isNotNull(), F.format_string(
        "Mainichi frequency band %02d (approximately ranks %d–%d)", band, (band - 1) * 500 + 1, band * 500))
    for name, text in PRIORITY_LABELS.items():
        label = label.when(tag == name, text)
    return label.otherwise(tag)


def _pronounced(variant: Column) -> Column:
    return katakana_to_hiragana(F.coalesce(variant["pronounced"], F.lit("")))


def _tags(variant: Column) -> Column:
    return F.filter(F.coalesce(variant["priorities"], F.array().cast("array<string>")),
                    lambda p: F.length(p) > 0)


def _says(variant: Column, reading: Column) -> Column:
    return (F.length(F.coalesce(reading, F.lit(""))) > 0) & (_pronounced(variant) == reading)


def variant_matches(variant: Column, text: Column, reading: Column) -> Column:
    return (F.coalesce(variant["written"], F.lit("")) == text) | F.coalesce(_says(variant, reading), F.lit(False))


def match_score(variants: Column, text: Column, reading: Column) -> Column:
    """Best variant: 1000 for the written form, 300 for the reading, plus its best priority."""
    def one(v: Column) -> Column:
        written = F.when(F.coalesce(v["written"], F.lit("")) == text, 1000).otherwise(0)
        said = F.when(F.coalesce(_says(v, reading), F.lit(False)), 300).otherwise(0)
        best = F.coalesce(F.array_max(F.transform(_tags(v), priority_weight)), F.lit(0))
        return written + said + best

    return F.coalesce(F.array_max(F.transform(variants, one)), F.lit(0))


def search_keys(text: Column, script: str = IDEOGRAPH) -> Column:
    """The text and its distinct ideographs, in order."""
    singles = F.regexp_extract_all(text, F.lit(script), 0)
    return F.when(F.length(text) > 0, ordered_distinct(F.concat(F.array(text), singles))).otherwise(
        F.array().cast("array<string>"))


def flatten_glosses(meanings: Column) -> Column:
    """All gloss strings of all meanings, trimmed, distinct, in order."""
    return ordered_distinct(F.flatten(F.transform(
        meanings, lambda m: F.coalesce(m["glosses"], F.array().cast("array<string>")))))


def normalized_entry(
    variants: Column, meanings: Column, text: Column, reading: Column, max_variants: int | None = None, max_senses: int | None = None,
) -> Column:
    """Entry shaped for a word; null when no meaning has a gloss.

    Matching variants are kept when there are any, else all of them. A report
    may show the first ``max_variants`` and ``max_senses`` only; ``glosses``
    always holds those of all senses.
    """
    hits = F.filter(variants, lambda v: variant_matches(v, text, reading))
    chosen = F.when(F.size(hits) > 0, hits).otherwise(variants)
    tags = ordered_distinct(F.flatten(F.transform(chosen, _tags)))
    senses = F.filter(
        F.transform(meanings, lambda m: F.struct(ordered_distinct(
            F.coalesce(m["glosses"], F.array().cast("array<string>"))).alias("glosses"))),
        lambda s: F.size(s["glosses"]) > 0)

    def shown(items: Column, most: int | None) -> Column:
        return items if most is None else F.slice(items, 1, most)

    entry = F.struct(
        F.lit("jmdict").alias("source"),
        F.when(F.size(hits) > 0, "exact").otherwise("candidate").alias("match"),
        match_score(variants, text, reading).cast("int").alias("score"),
        F.transform(shown(chosen, max_variants), lambda v: F.struct(
            F.coalesce(v["written"], F.lit("")).alias("written"), _pronounced(v).alias("reading_hiragana"),
            _tags(v).alias("priorities"))).alias("variants"),
        tags.alias("priority_tags"),
        ordered_distinct(F.transform(tags, priority_label)).alias("priority_labels"),
        shown(senses, max_senses).alias("senses"),
        ordered_distinct(F.flatten(F.transform(senses, lambda s: s["glosses"]))).alias("glosses"),
    )
    return F.when(F.size(senses) > 0, entry)


def unit_kind(pos: Column) -> Column:
    joined = F.array_join(pos, "/")
    return (
        F.when(F.contains(joined, F.lit(SIGN)), "token")
        .when(F.contains(joined, F.lit(PARTICLE)), "particle")
        .when(F.contains(joined, F.lit(AUXILIARY)), "aux")
        .when(F.contains(joined, F.lit(SUFFIX)), "suffix")
        .when((F.size(pos) > 0) & (F.length(F.get(pos, F.lit(0))) > 0), "word")
        .otherwise("token")
    )


def unit_label(kind: Column) -> Column:
    label = F.when(F.length(kind) == 0, "unit")
    for name, text in UNIT_LABELS.items():
        label = label.when(kind == name, text)
    return label.otherwise(kind)


def canonical_source(source: Column) -> Column:
    """Source id behind the name a record was stored with."""
    value = F.btrim(F.coalesce(source, F.lit("")))
    return (
        F.when((value == "jmdict") | value.startswith("kanjiapi.dev:/words"), "jmdict")
        .when((value == "kanjidic2") | (value == "kanjiapi.dev") | value.startswith("kanjiapi.dev:/kanji"), "kanjidic2")
        .when(value.startswith("local:"), "app_editorial")
        .when(value.startswith("SudachiPy"), "sudachi")
        .otherwise(value)
    )
