"""Byte-level BPE against the library that reads the same rank file."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
import tiktoken

from annolytics.llm import byte_bpe, queries

PATH, PATTERN = queries.ranks_and_pattern()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    with open(PATH, "rb") as file:
        return byte_bpe.vocabulary(file.read(), PATTERN)


def test_ids_on_mixed_texts(library, words):
    random.seed(12)
    pool = "abcdefghij zZ09.,!?'sśćéßñ漢字かな‍\n\t\r\x1c\x85\xa0　᠎٣½ <|endoftext|>"
    texts = ["".join(random.choice(pool) if random.random() < 0.8 else chr(random.randrange(0x10000, 0x1FFFF))
                     for _ in range(random.choice([0, 1, 5, 60]))) for _ in range(800)]
    ids, counts = words.encode(texts)
    at = 0
    for text, count in zip(texts, counts, strict=True):
        part, at = ids[at:at + count], at + count
        assert part.tolist() == library.encode_ordinary(text)
        assert words.decode(part).tobytes() == text.encode()


@pytest.mark.parametrize("text", [
    "a" * 70_000, "the" * 9_000, " " * 5_000 + "x", "=-" * 2_000, "漢字" * 900, "aab" * 300 + "b" * 257,
    "".join(random.Random(5).choice("abcdeor") for _ in range(20_000))])
def test_one_long_word(library, words, text):
    ids, _ = words.encode([text])
    assert ids.tolist() == library.encode_ordinary(text)


def test_every_length_class_and_a_forgotten_cache(library, words, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("xqzjtheran") for _ in range(n)) for n in range(1, 300)]
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    for _ in range(2):
        ids, _ = words.encode(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]


def test_a_pair_that_ranks_below_its_parts():
    """Neighbours that a merge makes may rank below it; the wide row must then go one by one."""
    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"ab", b"xa"]
    ranks = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    words = byte_bpe.Vocabulary(ranks, r"\S+")
    library = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in ("xab" * 200, "xabab" * 120, "abx" * 150 + "xxab"):
        assert words.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_awkward_rows(spark, library):
    schema = "doc_id long, text string, ids string, decoded int, word string"
    rows = [(1, "to be", "x", 1, "y"), (1, "to be", "x", 1, "y"), (2, None, None, None, None), (3, "", "x", 1, "y"),
            (None, "É \t\n 12", "x", 1, "y"), (4, "no spaces" * 4_000, "x", 1, "y")]
    frame = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, schema), PATH, PATTERN), PATH, PATTERN)
    got = sorted(((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in frame.collect()), key=repr)
    want = sorted(((r[0] or 0, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=repr)
    assert got == want
    empty = spark.createDataFrame([], schema)
    assert byte_bpe.decode(byte_bpe.encode(empty, PATH, PATTERN), PATH, PATTERN).collect() == []


def test_decode_of_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 64])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(rows, PATH, PATTERN).collect()} == {1: b"", 2: b"", 3: b"aa"}


def test_query_on_the_small_tables(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_byte_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
