"""Measures, romanisation and path data by the batch, against the built-in functions they replace."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annolytics.functions import markup as mk
from annolytics.functions import measures as ms
from annolytics.functions import text as tx
from annolytics.operators import candidates as cd
from annolytics.operators import windows as wi

SIGNS = "the de und xx ab12 愛ば カナ・ー XY未 １Ａ \u00a0 \u2028 \u0085 \t \n ? � ï¿½ 。 !!!!!! aaaaaa  𠮷 é é É ー 々".split(" ")


@pytest.mark.parametrize("script", [tx.SCRIPT, "[A-Za-zÀ-ÿ]"])
def test_measures_are_those_of_regular_expressions(spark, monkeypatch, script):
    monkeypatch.setattr(ms, "POINTS", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    texts += ["", None, "de", "the", "dethe", "the.", "\n" * 9, "?" * 5, "\r" * 7, "é" * 6, "愛" * 5, *texts[:9]]
    rows = [(i // 5, i % 5, "raw_rot90_x" if i % 5 > 2 else "raw", t, None, "vertical") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "region_id int, ord int, variant string, text string, error string, expected string")
    hints = ("the", "de", "愛ば", "々")
    text = F.coalesce(F.col("text"), F.lit(""))
    odd = f"[^{script[1:-1]}{tx.ORDINARY_MARKS}" + r"\p{L}\p{N}_]"
    want = cd.with_plausibility(frame, script, hints).select(
        "region_id", "ord", "variant", "error", "expected", F.md5(F.encode(text, "UTF-8")).alias("digest"), F.col("p_score").alias("plausible"),
        F.length(text).alias("chars"), tx.count_chars(text, script).alias("script_chars"),
        (tx.count_signs(text, "�?") + tx.count_matches(text, "ï¿½")).alias("bad_chars"),
        tx.count_chars(text, odd).alias("odd_chars"), tx.has_replacement(text).alias("marked"), tx.repeated_run(text).alias("run"))
    got = cd.measure_candidates(frame, script, hints)
    assert got.columns == want.columns
    got, want = (sorted(map(tuple, f.collect()), key=lambda r: r[:2]) for f in (got, want))
    for g, w in zip(got, want, strict=True):
        assert g == w, texts[g[0] * 5 + g[1]]
    assert cd.measure_candidates(frame.where("false")).collect() == []


def test_romanisation_by_the_batch_is_that_of_built_in_functions(spark):
    rng = random.Random(6)
    kana = list(tx.ROMAJI) + ["っ", "ー", "ッ", "ー", "っ", "k", "n", "ch", "。", " ", "ア", "キャ", "ヴァ", "漢", "e"]
    texts = ["".join(rng.choice(kana) for _ in range(rng.randrange(0, 25))) for _ in range(500)]
    texts += ["".join(rng.choice("っーあんちka") for _ in range(12)) for _ in range(500)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.kana_to_romaji(F.col("t")).alias("got"), tx._short_romaji(F.col("t")).alias("want"))
    for row in frame.collect():
        assert row.got == row.want, row.t
    assert "replace" not in frame.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_path_data_is_that_of_xpath(spark):
    texts = [
        "<svg><path d=' M1 &#50;\n3 '/><g><path/><path D='x' d=''>t</path></g></svg>",
        "<?xml version='1.0' encoding='UTF-16'?><s:svg xmlns:s='u' xmlns:k='v'><s:path d='m0' k:d='z'/><k:path k:d='z'/><xpath d='q'/></s:svg>",
        "<!DOCTYPE a [<!ENTITY e 'M9'>]><a><path d='&e;'/><!-- <path d='c'/> --><![CDATA[<path d='c'/>]]></a>", "<a/>",
        "<z:path z:d='2' d='1' a:d='3' xmlns:d='4' dd='5' a:b='6'/>", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(mk._paths("t").alias("got"), F.xpath("t", F.lit("//*[local-name()='path']/@d")).alias("want")).collect()
    for row, text in zip(rows, texts, strict=True):
        assert row.got == row.want, text
    with pytest.raises(Exception):
        spark.createDataFrame([("<a>",)], "t string").select(mk.stroke_paths(F.col("t"))).collect()


def test_a_model_gets_few_prompts_at_a_time(spark):
    prompts = spark.range(1_000).selectExpr("id", "array(id) as ids", "cast(id as string) as prompt").coalesce(1)
    rows = wi.call_model(prompts, lambda some: [f"{p}:{len(some)}" for p in some]).collect()
    assert [r.raw.split(":")[0] for r in rows] == [r.prompt for r in rows] and len(rows) == 1_000
    assert max(int(r.raw.split(":")[1]) for r in rows) <= 256
