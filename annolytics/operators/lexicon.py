"""Dictionary lookup, ranking, glosses and provenance.

A word row is text, reading. A dictionary row is entry_id, ord, variants,
meanings. A token row is region keys, pos (position), surface, lemma, reading,
tags (part of speech). Lookups run once per distinct word, never per token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions import lexicon as lx
from annolytics.functions import text as tx
from annolytics.plans.skew import ordered_text, small_side, top_rows
from annolytics.plans.storage import settle

WORD = ["text", "reading"]


def distinct_words(tokens: DataFrame) -> DataFrame:
    """Words to look up: every surface with its reading, every other lemma without."""
    surfaces = tokens.select(F.btrim("surface").alias("text"), F.coalesce("reading", F.lit("")).alias("reading"))
    lemmas = tokens.where(F.col("lemma") != F.col("surface")).select(
        F.btrim("lemma").alias("text"), F.lit("").alias("reading"))
    return surfaces.unionByName(lemmas).where(F.length("text") > 0).distinct()


def best_entry_per_variant(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One entry per key and variant list: highest score, first on ties."""
    last = [-F.col("entry_id")] if dict(entries.dtypes).get("entry_id") in ("int", "bigint") else []
    packed = F.max_by(F.struct(*entries.columns), F.struct(F.col("score"), -F.col("ord"), *last))
    kept = entries.groupBy(*keys, F.to_json("variants").alias("_v")).agg(packed.alias("_e"))
    return kept.select("_e.*")


def _index(dictionary: DataFrame, script: str) -> DataFrame:
    """Search keys under which an entry is listed: its written forms and their ideographs."""
    written = F.transform("variants", lambda v: F.coalesce(v["written"], F.lit("")))
    keys = F.array_distinct(F.flatten(F.transform(written, lambda w: lx.search_keys(w, script))))
    return dictionary.select(F.explode(keys).alias("key"), "entry_id", "ord", "variants", "meanings")


def dictionary_candidates(words: DataFrame, dictionary: DataFrame, script: str = tx.IDEOGRAPH) -> DataFrame:
    """(text, reading, entry) for entries listed under any search key of a word.

    One equi-join on the key serves all words; an OR over written form and
    reading would be a nested loop. Entries with equal variants and meanings are
    one entry, so copies are folded before the join.
    """
    unique = dictionary.groupBy(
        F.to_json("variants").alias("_v"), F.to_json("meanings").alias("_m"),
    ).agg(F.min_by(F.struct(*dictionary.columns), F.struct("ord", "entry_id")).alias("_e")).select("_e.*")
    keyed = words.select(*WORD, F.explode(lx.search_keys(F.col("text"), script)).alias("key"))
    found = keyed.join(_index(unique, script), "key")
    shaped = found.withColumn("entry", lx.normalized_entry(
        F.col("variants"), F.col("meanings"), F.col("text"), F.col("reading")))
    return (
        shaped.where(F.col("entry").isNotNull())
        .groupBy(*WORD, "entry_id").agg(F.min("ord").alias("ord"), F.first("entry").alias("entry"))
    )


def rank_entries(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """The exact entries of each word by score, the best ``n`` if given, with the number of
    candidate entries. Entries with equal shown variants count once."""
    flat = candidates.select(
        *WORD, "entry_id", "ord", F.col("entry.score").alias("score"), F.col("entry.match").alias("match"),
        F.col("entry.variants").alias("variants"), F.col("entry.glosses").alias("glosses"),
        F.col("entry.priority_tags").alias("priority_tags"))
    unique = best_entry_per_variant(flat, WORD)
    counts = unique.groupBy(*WORD).agg(F.count(F.lit(1)).alias("candidate_count"))
    exact = top_rows(unique.where(F.col("match") == "exact"), WORD, [F.col("score").desc(), "ord", "entry_id"], n, "place")
    return exact.join(counts, WORD)


def lookup_words(words: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per word: its ranked entries, or none."""
    gathered = ranked.groupBy(*WORD).agg(
        F.array_sort(F.collect_list(F.struct(
            "place", "entry_id", "score", "variants", "glosses", "priority_tags"))).alias("entries"),
        F.max("candidate_count").alias("candidate_count"))
    return words.select(*WORD).join(gathered, WORD, "left")


def attach_lookup(tokens: DataFrame, lookup: DataFrame) -> DataFrame:
    """Tokens with the lookup of their surface (and reading) or, failing entries,
    of their lemma; with neither, the first miss stays."""
    table = small_side(settle(lookup.where(F.col("entries").isNotNull())))
    by_surface = table.select(
        F.col("text").alias("_s"), F.col("reading").alias("_r"), F.struct("entries", "candidate_count").alias("_a"))
    by_lemma = table.where(F.col("reading") == "").select(
        F.col("text").alias("_l"), F.struct("entries", "candidate_count").alias("_b"))
    joined = (
        tokens
        .join(by_surface, (F.btrim("surface") == F.col("_s")) & (F.coalesce("reading", F.lit("")) == F.col("_r")), "left")
        .join(by_lemma, (F.btrim("lemma") == F.col("_l")) & (F.col("lemma") != F.col("surface")), "left")
    )
    chosen = F.coalesce("_a", "_b")
    return joined.withColumns({
        "entries": chosen["entries"],
        "candidate_count": F.coalesce(chosen["candidate_count"], F.lit(0)),
        "found_by": F.when(F.col("_a").isNotNull(), "surface").when(F.col("_b").isNotNull(), "lemma").otherwise("none"),
    }).drop("_s", "_r", "_a", "_l", "_b")


def merge_rank_entries(remote: DataFrame, local: DataFrame, keys: Sequence[str] = WORD, n: int | None = None) -> DataFrame:
    """Union of two entry tables with canonical sources, one entry per variant
    list, by score, the best ``n`` if given; remote entries come first on ties,
    then the smaller ``ord``, then the variants' text."""
    columns = [*keys, "ord", "source", "score", "variants", "glosses"]
    both = (
        remote.select(*columns, F.lit(0).alias("_side"))
        .unionByName(local.select(*columns, F.lit(1).alias("_side")))
        .withColumn("source", lx.canonical_source(F.col("source")))
    )
    best = F.max_by(F.struct(*columns, "_side"), F.struct("score", -F.col("_side"), -F.col("ord"), "source", F.to_json("glosses")))
    unique = both.groupBy(*keys, F.to_json("variants").alias("_v")).agg(best.alias("_e")).select("_e.*", "_v")
    return top_rows(unique, keys, [F.col("score").desc(), "_side", "ord", "_v"], n, "place").drop("_side", "_v")


def reading_lookup(readings: DataFrame, characters: DataFrame) -> DataFrame:
    """(reading, character, name) for each distinct reading, one row per
    character, null for a reading without any; ``name`` marks name readings."""
    index = characters.select(
        "character", F.explode(F.concat(
            F.transform("readings", lambda r: F.struct(r.alias("reading"), F.lit(False).alias("name"))),
            F.transform("name_readings", lambda r: F.struct(r.alias("reading"), F.lit(True).alias("name"))),
        )).alias("_r")).select("character", "_r.reading", "_r.name").distinct()
    wanted = readings.select(F.btrim("reading").alias("reading")).where(F.length("reading") > 0).distinct()
    return wanted.join(index, "reading", "left")


def character_units(tokens: DataFrame, characters: DataFrame, script: str = tx.IDEOGRAPH) -> DataFrame:
    """One row per ideograph of each token: place, text before and after it in
    the token, child id, and the character's record."""
    spread = tokens.select("*", F.posexplode(F.split("surface", "")).alias("char_index", "character"))
    hits = spread.where(F.col("character").rlike(f"^{script}$"))
    placed = hits.withColumns({
        "prefix": F.substring(F.col("surface"), F.lit(1), F.col("char_index")),
        "suffix": F.substring(F.col("surface"), F.col("char_index") + 2, F.length("surface")),
        "child_id": F.format_string("words_%03d_kanji_%02d", "pos", "char_index"),
    })
    return placed.join(small_side(characters), "character", "left")


def with_glosses(
    tokens: DataFrame, lexical: DataFrame, functional: DataFrame, char_meanings: DataFrame,
) -> DataFrame:
    """Tokens (with ``entries``) and their primary gloss, by precedence:
    dictionary; lexical or, for grammatical kinds, functional glossary by
    surface then lemma; a sign itself; the reading of a proper noun; the
    character's meaning for texts of one or two characters; reading (with
    ideographs), lemma or surface.

    ``lexical`` and ``functional`` are (word, gloss) tables; ``char_meanings``
    is (character, meaning).
    """
    kind = lx.unit_kind(F.col("tags"))
    signs = tx.is_symbol(F.col("surface"), F.col("tags"))
    base = tokens.withColumns({"kind": kind, "_sign": signs})
    lexical, functional, meanings = (small_side(t) for t in (lexical, functional, char_meanings))

    def glossed(df: DataFrame, table: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(table.select(F.col("word").alias("_w"), F.col("gloss").alias(name)),
                       F.col(word) == F.col("_w"), "left").drop("_w")

    for table, word, name in (
        (lexical, "surface", "_ls"), (functional, "surface", "_fs"),
        (lexical, "lemma", "_ll"), (functional, "lemma", "_fl"),
    ):
        base = glossed(base, table, word, name)
    chars = F.regexp_extract_all("surface", F.lit(tx.IDEOGRAPH), 0)
    base = base.withColumn("_chars", chars)
    for place in (1, 2):
        char = F.try_element_at("_chars", F.lit(place))
        base = base.withColumn("_k", char).join(
            meanings.select(F.col("character").alias("_k"), F.col("meaning").alias(f"_m{place}")), "_k", "left").drop("_k")
    grammatical = F.col("kind").isin(*lx.GRAMMATICAL_KINDS)
    reading = F.nullif(F.btrim(F.coalesce(F.col("reading"), F.lit(""))), F.lit(""))
    plain = F.coalesce(F.when(F.col("lemma") != "*", F.nullif(F.btrim("lemma"), F.lit(""))), F.btrim("surface"))
    gloss = F.coalesce(
        F.get(F.get(F.col("entries"), F.lit(0))["glosses"], F.lit(0)),
        F.col("_ls"), F.when(grammatical, F.col("_fs")),
        F.col("_ll"), F.when(grammatical, F.col("_fl")),
        F.when(F.col("_sign"), F.col("surface")),
        F.when(F.contains(F.array_join("tags", "/"), F.lit(lx.PROPER_NOUN)), F.coalesce(reading, plain)),
        F.when(F.length("surface") <= 2, F.coalesce("_m1", "_m2")),
        F.when(F.size("_chars") > 0, reading),
        plain,
    )
    return base.withColumn("gloss", gloss).withColumnRenamed("_sign", "is_sign").drop(
        "_ls", "_fs", "_ll", "_fl", "_chars", "_m1", "_m2")


def grammar_lookup(tokens: DataFrame, grammar: DataFrame) -> DataFrame:
    """Grammar note of the first hit among surface, lemma and reading."""
    table = small_side(grammar.select(F.col("word").alias("_w"), F.struct("label", "notes", "tags").alias("_g")))
    joined = tokens
    for word in ("surface", "lemma", "reading"):
        hit = table.select(F.col("_w").alias(f"_w_{word}"), F.col("_g").alias(f"_g_{word}"))
        joined = joined.join(hit, F.col(word) == F.col(f"_w_{word}"), "left").drop(f"_w_{word}")
    note = F.coalesce("_g_surface", "_g_lemma", "_g_reading")
    return joined.withColumn("grammar", note).drop("_g_surface", "_g_lemma", "_g_reading")


def region_glossary(glossed: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """Space-joined glosses of the non-sign tokens of a region in order, in
    parts of a thousand token positions, with token and ideograph counts."""
    shown = glossed.where(F.length(F.btrim("surface")) > 0)
    marked = shown.withColumns({
        "_at": F.col(position) + 1,
        "_gloss": F.when(~F.col("is_sign") & (F.length("gloss") > 0), F.col("gloss")),
    })
    text = ordered_text(marked.where(F.col("_gloss").isNotNull()), keys, "_at", F.col("_gloss"), " ")
    counts = shown.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("token_count"),
        F.sum(tx.count_matches(F.col("surface"), tx.IDEOGRAPH)).alias("ideograph_count"))
    return counts.join(text.select(*keys, "part", F.col("text").alias("glossary")), list(keys), "left")


def lookup_totals(tokens: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cache hits and misses per region and over all (null region)."""
    known = small_side(cache.select(F.col("cache_key").alias("_key")).distinct())
    words = tokens.where(F.length(F.btrim("surface")) > 0)
    joined = words.join(known.withColumn("_hit", F.lit(True)), F.btrim("surface") == F.col("_key"), "left")
    region = F.concat_ws(":", *keys).alias("region")
    return joined.withColumn("region", region).rollup("region").agg(
        F.count_if(F.col("_hit")).alias("lookup_hits"), F.count_if(F.col("_hit").isNull()).alias("lookup_misses"))


# Score of a local entry by its source.
LOCAL_SCORES = {"local:grammar": 780, "local:symbols": 720, "local:kana": 660}


def local_entries(tokens: DataFrame, grammar: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entries made from the caller's grammar and sign tables and from kana
    spelling: one row per token and entry.

    Kana entries are for hiragana texts of at most four characters that are
    grammatical, untagged, or at most two characters long.
    """
    base = grammar_lookup(tokens, grammar).withColumn("kind", lx.unit_kind(F.col("tags")))
    signs = small_side(symbols.select(
        F.col("word").alias("_w"), F.struct("label", F.col("notes").alias("notes")).alias("_sym")))
    base = base.join(signs, F.col("surface") == F.col("_w"), "left").drop("_w")
    short_kana = F.col("surface").rlike("^[ぁ-ゖ]{1,4}$") & (
        F.col("kind").isin(*lx.GRAMMATICAL_KINDS, "token") | (F.length("surface") <= 2))

    def entry(source: str, glosses: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(source).alias("source"), F.lit(LOCAL_SCORES[source]).alias("score"), glosses.alias("glosses")))

    def labelled(holder: str) -> Column:
        return tx.ordered_distinct(F.concat(F.array(F.col(f"{holder}.label")), F.col(f"{holder}.notes")))

    kana = F.array(F.concat(F.lit("hiragana sequence ("), tx.kana_to_romaji(F.col("surface")), F.lit(")")))
    options = F.array(
        entry("local:grammar", labelled("grammar"),
              F.col("grammar").isNotNull() & F.col("kind").isin(*lx.GRAMMATICAL_KINDS)),
        entry("local:symbols", labelled("_sym"), F.col("_sym").isNotNull()),
        entry("local:kana", kana, short_kana),
    )
    made = F.filter(options, lambda e: e.isNotNull())
    return base.withColumn("_e", F.explode(made)).select(*tokens.columns, "kind", "_e.*")


def source_union(words: DataFrame, catalog: DataFrame, separator: str = " + ") -> DataFrame:
    """Words with the distinct canonical ids of their own and their entries'
    sources (``entry_sources``), in order, and the sources' joined names."""
    ids = F.filter(F.array_distinct(F.transform(
        F.concat(F.array("source"), "entry_sources"), lx.canonical_source)), lambda s: F.length(s) > 0)
    names = small_side(catalog.select(F.col("source_id").alias("_id"), F.col("name").alias("_name")))
    keyed = words.withColumn("source_ids", ids)
    combos = keyed.select("source_ids").distinct()
    spread = combos.select("source_ids", F.posexplode("source_ids").alias("_at", "_id")).join(names, "_id", "left")
    joined = spread.groupBy("source_ids").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", "_id").alias("n")))), lambda e: e["n"]),
        separator).alias("source_names"))
    return keyed.join(small_side(joined), "source_ids", "left")


def source_subset(catalog: DataFrame, rows: DataFrame, ids: str = "source_ids") -> DataFrame:
    """Catalog rows that any row refers to."""
    used = rows.select(F.explode(ids).alias("source_id")).distinct()
    return catalog.join(used, "source_id", "left_semi")


def field_provenance(fields: dict[str, Column]) -> Column:
    """Map from field to source ids; a null array leaves its field out."""
    pairs = F.filter(
        F.array(*(F.struct(F.lit(name).alias("f"), ids.alias("s")) for name, ids in fields.items())),
        lambda p: p["s"].isNotNull())
    return F.map_from_entries(pairs)


def meaningful_units(units: DataFrame) -> DataFrame:
    """Units worth showing: characters always, signs never; a text without
    letters needs a code point or entries; an untagged token needs a reading
    or entries."""
    text = F.btrim(F.coalesce("text", F.lit("")))
    spoken = text.rlike(r"[\p{L}\p{N}]|" + tx.SCRIPT)
    entries = F.coalesce(F.col("entry_count"), F.lit(0)) > 0
    tagged = F.exists("tags", lambda p: F.contains(p, F.lit(lx.SIGN)))
    worth = (
        F.when(F.col("kind") == "kanji", True).when(tagged, False)
        .when(~spoken, F.coalesce(F.length("codepoint") > 0, F.lit(False)) | entries)
        .otherwise((F.col("kind") != "token") | (F.length(F.coalesce("reading", F.lit(""))) > 0) | entries)
    )
    return units.where((F.length(text) > 0) & worth)
