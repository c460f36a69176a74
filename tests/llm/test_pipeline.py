"""The pipeline's stages, each held against what its input says."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from annolytics.llm import queries
from tests.llm.test_operators import classes, lines_of

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece encoding"]

    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert all(labels.get(i, 1) for i in gone)

    lines = stages["line dedup"](spark, clean, FOLDER)
    rows = [(r.doc_id, r.text, r.source) for r in clean.collect()]
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter((k[0], k[1]) for k in lines_of(rows).elements())

    single = stages["n-gram Jaccard join"](spark, lines, FOLDER)
    want = {i for i, _, c in classes([(r.doc_id, r.text) for r in lines.collect()]) if i == c}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns

    mixed = stages["mixing sources"](spark, single, FOLDER)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= want and max(times.values()) <= 3

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    got = Counter(tuple(r)[:4] for r in stages["SentencePiece encoding"](spark, mixed, FOLDER).collect())
    expected = Counter()
    for r in mixed.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected[r.doc_id, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == expected


def test_run(spark):
    first = Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()))
    assert first and first == Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()))
