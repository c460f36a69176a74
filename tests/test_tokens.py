"""Tokens by dictionary: the trie and the join give equal tokens, and those of a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from annolytics.operators import tokens as tk

WORDS = "surface string, lemma string, reading string, pos array<string>, cost int"


def plain(text, words):
    """Tokens by (cost, tokens, start of the last token), one class of letters only."""
    text = text.strip()
    if not any(w in text for w in words):
        return [text] if text else []
    best = [(0, 0, 0)]
    for end in range(1, len(text) + 1):
        ways = [(best[end - 1][0] + 3_500, best[end - 1][1] + 1, end - 1)]
        if end == len(text):
            ways += [(best[p][0] + 3_000 + 500 * (end - p), best[p][1] + 1, p) for p in range(end - 1)]
        ways += [(best[end - len(w)][0] + c, best[end - len(w)][1] + 1, end - len(w)) for w, c in words.items() if text[:end].endswith(w)]
        best.append(min(ways))
    out, end = [], len(text)
    while end:
        out.append(text[best[end][2]:end])
        end = best[end][2]
    return out[::-1]


@pytest.mark.parametrize("most_rows", [1_000, 0])
def test_both_ways_give_the_cheapest_tokens(spark, most_rows):
    rng = random.Random(most_rows)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(100, 4_000) for _ in range(25)}
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25))) for _ in range(120)] + ["ddd", "", None, "  ab "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    dictionary = spark.createDataFrame([(w, w, "", [], c) for w, c in words.items()], WORDS)
    got = {r.id: [t.surface for t in r.tokens] for r in tk.tokenize(frame, dictionary, most_rows=most_rows).collect()}
    assert got == {i: plain(t or "", words) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most_rows", [1_000, 0])
def test_scripts_readings_and_awkward_dictionary_rows(spark, most_rows):
    dictionary = spark.createDataFrame([
        ("学校", "学校", "ガッコウ", ["名詞"], 100), ("学", "学", "ガク", ["名詞"], 90), ("へ", "へ", "エ", ["助詞"], 50),
        ("行く", "行く", "イク", ["動詞"], 100), ("行く", "行く", "ユク", ["動詞"], 300), ("。", "。", "*", ["補助記号"], 10),
        ("", "x", "x", [], 1), (None, "x", "x", [], 1), ("未", "x", "x", [], None), ("長" * 50, "x", "x", [], 1)], WORDS)
    frame = spark.createDataFrame([(1, " 学校へ 行く。XY未 ", 7), (2, "zzz qq", 7)], "id int, text string, tokens_ int")
    rows = {r.id: r for r in tk.with_readings(tk.tokenize(frame, dictionary, most_rows=most_rows)).collect()}
    assert [(t.surface, t.start, t.end, t.known, t.reading_hiragana) for t in rows[1].tokens] == [
        ("学校", 0, 2, True, "がっこう"), ("へ", 2, 3, True, "え"), ("行く", 4, 6, True, "いく"), ("。", 6, 7, True, ""),
        ("XY未", 7, 10, False, "")]
    assert rows[1].reading_hiragana == "がっこうえいく" and rows[1].tokens[0].ideographs == ["学", "校"]
    assert [(t.surface, t.lemma, t.known) for t in rows[2].tokens] == [("zzz qq", "zzz qq", False)]


def test_without_a_dictionary_a_text_is_one_token(spark):
    frame = spark.createDataFrame([(1, " two words "), (2, None)], "id int, text string")
    rows = {r.id: [(t.surface, t.start, t.end) for t in r.tokens] for r in tk.tokenize(frame).collect()}
    assert rows == {1: [("two words", 0, 9)], 2: []}
    assert tk.tokenize(frame.limit(0)).collect() == []


def test_a_large_dictionary_goes_to_the_workers(spark, monkeypatch):
    monkeypatch.delattr(tk, "_edges_by_join")  # a join of all substrings filled the disk from 200,000 words on
    words = spark.range(210_000).selectExpr(
        "concat('w', conv(id, 10, 7)) as surface", "concat('l', id) as lemma", "'' as reading", "array('n') as pos", "100 as cost")
    frame = spark.createDataFrame([("w0w166", ), ("xw12 w0",)], "text string")
    got = [[(t.surface, t.lemma, t.start, t.known) for t in r.tokens] for r in tk.tokenize(frame, words).collect()]
    assert got == [[("w0", "l0", 0, True), ("w166", "l97", 2, True)], [("x", "x", 0, False), ("w12", "l9", 1, True), ("w0", "l0", 5, True)]]


def test_short_and_long_texts_take_the_same_way(spark, monkeypatch):
    rng = random.Random(9)
    words = [("".join(rng.choice("ab c") for _ in range(rng.randrange(1, 5))), rng.randrange(-50, 4_000)) for _ in range(30)]
    texts = ["".join(rng.choice("abcd。 学") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    dictionary = spark.createDataFrame([(w, w.upper(), "", [], c) for w, c in words], WORDS)
    together = tk.tokenize(frame, dictionary).collect()
    monkeypatch.setattr(tk, "SHORT", -1)
    single = tk.tokenize(frame, dictionary)
    joined = tk.tokenize(frame, dictionary, most_rows=0)
    assert together == joined.orderBy("id").collect() == single.collect()


def test_one_long_text(spark):
    text = "ab" * 20_000
    dictionary = spark.createDataFrame([("ab", "ab", "", [], 1), ("ba", "ba", "", [], 1)], WORDS)
    tokens = tk.tokenize(spark.createDataFrame([(text,)], "text string"), dictionary).head().tokens
    assert len(tokens) == 20_000 and all(t.surface == "ab" for t in tokens)


def test_a_trie_of_many_words():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(5_000)}
    trie = tk.Trie(words)
    text = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    start, length, word = trie.matches([text, "", text[:10]])
    want = [(i, n) for t, at in ((text, 0), (text[:10], len(text) + 2)) for i in range(at, at + len(t)) for n in range(1, 8)
            if i - at + n <= len(t) and t[i - at:i - at + n] in words]
    assert sorted(zip(start.tolist(), length.tolist(), strict=True)) == sorted(want)
    assert all(len(trie.words[w]) == n for w, n in zip(word.tolist(), length.tolist(), strict=True))


def test_located_tokens_against_a_plain_search(spark):
    rng = np.random.default_rng(3)
    texts = [("a", "  one two, one 𠮷two three  "), ("b", None), ("d", ""), ("d", "zz top"), (None, "key less key")]
    texts += [(f"t{i}", " ".join(rng.choice(["ab", "abc", "b", "é𠮷", "x"], 40))) for i in range(20)]
    tokens = [("a", i, s) for i, s in enumerate(["one", "one", "none", "two", "two", "", None, "three", "one", "three"])]
    tokens += [("b", 0, "x"), ("c", 0, "x"), ("c", 1, "yy"), ("d", 0, "top"), (None, 0, "key"), (None, 1, "key"), (None, None, "less")]
    tokens += [(f"t{i}", p, str(s)) for i in range(20) for p, s in enumerate(rng.choice(["ab", "abc", "b", "é𠮷", "x", "nope"], 60))]
    want = {}
    by_key = {}
    for key, text in texts:
        by_key[key] = min(by_key.get(key, (text or "").strip()), (text or "").strip())
    for key in {k for k, _, _ in tokens}:
        at, text = 0, by_key.get(key, "")
        for _, pos, surface in sorted((t for t in tokens if t[0] == key), key=lambda t: (t[1] is not None, t[1] or 0)):
            place = text.find(surface or "", at)
            start = at if place < 0 else place
            at = start + len(surface or "")
            want[key, pos] = (start, at, place >= 0)
    frame = spark.createDataFrame([(*t, "extra", 7) for t in tokens], "key string, pos int, surface string, text string, end int")
    got = tk.locate(frame, spark.createDataFrame(texts, "key string, text string"), ["key"])
    assert got.columns == ["key", "pos", "surface", "text", "start", "end", "found"]
    assert {(r.key, r.pos): (r.start, r.end, r.found) for r in got.collect()} == want
    assert tk.locate(frame.where("false"), spark.createDataFrame(texts, "key string, text string"), ["key"]).count() == 0


def test_located_tokens_of_one_long_text(spark):
    words = [f"w{i}" for i in range(100_000)]
    text = spark.createDataFrame([(1, " ".join(words))], "key int, text string")
    tokens = spark.range(100_000).selectExpr("1 as key", "id as pos", "case when id % 3 = 2 then concat('no', id % 2) else concat('w', id) end as surface")
    row = tk.locate(tokens, text, ["key"]).selectExpr("count(*)", "sum(cast(found as int))", "max(end)").head()
    assert row[0] == 100_000 and row[1] == 66_667 and row[2] == len(" ".join(words))
