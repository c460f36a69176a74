"""Cases that once failed: long texts in the personal data search, clashing names in the pipeline's stages."""

from __future__ import annotations

import re

from annolytics.llm import line_dedup, mixing, ngram_join, personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAMES = "_doc long, _gone string, _tie long, _times int, _t long, _n int, _row long, _first int"


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in personal_data.find(docs).collect()}


def test_very_many_labels_and_numbers_in_one_text(spark):
    labels = "a@" + "b." * 100_000 + "c and x@y.z"
    numbers = " ".join(str(10_000 + i) for i in range(100_000)) + " 10.0.0.1"
    rows = found(spark, [labels, numbers, "a@b.c..d a@b. a@b..c a@b.c. q-@-.-"])
    assert [(s.start, s.end) for s in rows[0].base] == [m.span() for m in EMAIL.finditer(labels)]
    assert [(s.kind, s.value) for s in rows[1].base] == [("ip", "10.0.0.1")]
    assert [s.value for s in rows[2].base] == EMAIL.findall("a@b.c..d a@b. a@b..c a@b.c. q-@-.-")


def clashing(spark, rows):
    full = [(i, t, "en", s, 1, i or 0, "keep", 2, 3, 4, 5, 6, 7) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}")


def test_stages_keep_columns_that_look_like_their_own(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = clashing(spark, [(1, text + "\nsame same same", "a"), (2, text, "b"), (3, "same same same\nother", "a"), (None, None, None), (4, "", "b")])
    for stage in (line_dedup.with_kept_lines, ngram_join.one_of_each, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        for row in out.collect():
            assert (row._doc, row._gone, row._tie, row._times, row._t, row._n) == (row.doc_id or 0, "keep", 2, 3, 4, 5)
        assert stage(docs.limit(0)).collect() == []
    assert {r.doc_id: r.text for r in line_dedup.with_kept_lines(docs).collect()}[3] == "other"
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each(docs).collect()) == [0, 1, 3, 4]


def test_a_passage_joins_sets_where_enough_of_it_is_left(spark):
    def rows(length):
        crossing = spark.createDataFrame(
            [(token, node, 100, token, node, length - token) for node in range(20) for token in range(length)],
            "token long, node long, n long, pos int, component long, rest long")
        met = ngram_join._meetings(crossing, ngram_join.SIMILARITY, "16")
        return met.count(), met.select("a", "b").distinct().count()

    # 16 of 100 tokens are needed: 18 shared ones meet at three places, not at all that the shorter prefix has.
    assert rows(18) == (190 * 3, 190)
    assert rows(15) == (0, 0)
