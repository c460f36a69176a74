"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm import (
    byte_bpe,
    conversation_repair,
    html_main_text,
    line_dedup,
    mixing,
    ngram_join,
    oracles,
    personal_data,
    prefix_trie,
    sentencepiece_spans,
    substring_dedup,
    topk_search,
    toxicity,
    vector_dedup,
)
from annolytics.llm.digests import joined_sha256
from annolytics.llm.prefix_trie import NO_ENDS as EMPTY_SHA256
from annolytics.llm.shared import keep

# A parameter of the encoding query: the SentencePiece model it encodes with.
MODEL = "piece_bpe_32k.model"
# Parameters of the byte-level query: the rank file and, from the same package, its pattern.
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similarity_classes(_table(spark, folder, "documents"))


def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_main_text.extract(_table(spark, folder, "pages"))


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    quality = mixing.quality_weights(_table(spark, folder, "labels"))
    rows = mixing.mix(_table(spark, folder, "documents"), quality)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.digest(personal_data.find(_table(spark, folder, "documents")))


def op5_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.link_classes(_table(spark, folder, "embeddings"))


def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.top_products(_table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.drop_repeated_lines(_table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring_dedup.without_repeats(_table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_spans.encoded_digests(_table(spark, folder, "documents"), model_path())


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))


def ranks_and_pattern() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = ranks_and_pattern()
    rows = byte_bpe.decode(byte_bpe.encode(_table(spark, folder, "documents"), *ranks), *ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = keep(prefix_trie.paths(_table(spark, folder, "conversations")), "paths")
    donor = F.col("conv_id") - F.col("conv_id") % 5
    return prefix_trie.build(prefix_trie.with_heads_of(own, donor, F.crc32(F.col("conv_id").cast("string")) % 9))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = conversation_repair.turns(_table(spark, folder, "conversations"))
    report, lines = conversation_repair.repair(conversation_repair.damaged(rows))
    lines = lines.select("key", "position", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = joined_sha256(lines, "key", ["position"], "line", "\n")
    every = rows.select("key", "conv_id").distinct()
    full = every.join(report.drop("conv_id"), "key", "left").join(digests, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    built = (
        op1_ngram_jaccard_join, op2_main_text, op3_source_mix, op4_personal_data, op5_vector_dedup, op6_topk_search,
        op7_line_dedup, op8_substring_dedup, op9_sentencepiece, op10_toxicity, op11_prefix_trie, op12_byte_bpe, op13_conversation_repair)
    return {build.__name__: build for build in built}


def llm_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.ORACLE, "op5_vector_dedup": vector_dedup.ORACLE, "op6_topk_search": topk_search.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE, "op11_prefix_trie": oracles.PREFIX_TRIE,
        "op13_conversation_repair": oracles.CONVERSATION_REPAIR, "op8_substring_dedup": substring_dedup.ORACLE}
