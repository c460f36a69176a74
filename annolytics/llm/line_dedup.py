"""Line dedup: lines that several documents hold stay only in the first of them.

Lines are exploded, normalised and hashed; documents are counted per hash by
their least and greatest key, so a line that every document holds is combined
before the shuffle. Only (hash, key) pairs move to find what to drop; then each
document loses its lines in place and keeps the order of the rest. Lines are
cut and hashed as flat arrays over Arrow batches of whole texts.

Null or empty texts are one empty line. Lines whose key is shorter than
``LEAST_CHARS`` code points always stay. Rows with the same ``doc_id`` count as
one document, each keeps its row. Rows without ``doc_id`` lose nothing and make
no other line drop. Hashes have 64 bits: of n different lines about
n * n / 2 ** 65 pairs would be taken for one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import keep, small_batches, spare_names
from annolytics.llm.words import Words, slices, split_lines

LEAST_CHARS = 10


def _line_hashes(lines: Words) -> np.ndarray:
    """Hash of the key of each line, 0 for keys that are too short."""
    chars = np.concatenate([[0], np.cumsum((lines.data & 0xC0) != 0x80)])
    start, end = lines.start, lines.end
    hashes = lines.hashes(start, end).view(np.int64)
    return np.where(chars[end] - chars[start] >= LEAST_CHARS, hashes, 0)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, gone): the hashes of the lines that each document loses."""
    small_batches(docs.sparkSession)

    def explode(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                lines = split_lines(texts)
                hashes = _line_hashes(lines)
                owner = np.repeat(np.arange(len(texts)), lines.counts)
                long = hashes != 0
                ids = batch.column(0).slice(first, len(texts)).take(pa.array(owner[long]))
                yield pa.record_batch([ids, pa.array(hashes[long])], ["doc_id", "hash"])

    whole = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    lines = keep(whole.where("doc_id is not null").mapInArrow(explode, "doc_id long, hash long"), "lines")
    shared = (
        lines.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").select("hash", "first")
    )
    return (
        lines.join(shared, "hash").where("doc_id > first")
        .groupBy("doc_id").agg(F.collect_set("hash").alias("gone"))
    )


def _cut(texts: pa.Array, gone: list) -> tuple[list[str], list[int], list[int]]:
    """(text, lines, dropped lines) of each text without its lines in ``gone``."""
    kept, counts, dropped = [], [], []
    for first, part in slices(texts):
        lines = split_lines(part)
        hashes = None
        for row, text in enumerate(part.to_pylist()):
            begin, end = lines.bounds[row], lines.bounds[row + 1]
            counts.append(int(end - begin))
            if gone[first + row] is None:
                kept.append(text or "")
                dropped.append(0)
                continue
            hashes = _line_hashes(lines) if hashes is None else hashes
            out = np.isin(hashes[begin:end], np.array(gone[first + row], np.int64))
            kept.append("\n".join(line for line, go in zip((text or "").split("\n"), out, strict=True) if not go))
            dropped.append(int(out.sum()))
    return kept, counts, dropped


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), one row per row of ``docs``."""
    whole = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches):
        for batch in batches:
            kept, counts, dropped = _cut(batch.column(1), batch.column(2).to_pylist())
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"])

    rows = whole.join(repeated_lines(whole), "doc_id", "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(cut, "doc_id long, text string, n_lines long, n_dropped long")


def with_kept_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, ``text`` without the repeated lines; a null text stays null."""
    names, place = docs.columns, docs.columns.index("text")
    doc, lost = spare_names(docs, "_doc", "_gone")
    gone = repeated_lines(docs).select(F.col("doc_id").alias(doc), F.col("gone").alias(lost))

    def cut(batches):
        for batch in batches:
            texts = batch.column(place)
            kept, _, _ = _cut(texts, batch.column(len(names)).to_pylist())
            kept = pa.array([k if t else t for k, t in zip(kept, texts.to_pylist(), strict=True)], texts.type)
            columns = [kept if i == place else batch.column(i) for i in range(len(names))]
            yield pa.record_batch(columns, names)

    rows = docs.join(gone, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc)
    return rows.mapInArrow(cut, docs.schema)


ORACLE = """
with l as (
    select doc_id, generate_subscripts(s, 1) as pos, unnest(s) as line
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)
), k as (
    select doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from l
), f as (
    select key, min(doc_id) as first from k where length(key) >= 10 group by key
), m as (
    select k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) as gone from k left join f using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
