"""The corpus operators against plain Python, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from annolytics.llm import (
    html_main_text,
    line_dedup,
    mixing,
    ngram_join,
    personal_data,
    queries,
    sentencepiece_spans,
    substring_dedup,
    topk_search,
    toxicity,
    vector_dedup,
)

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, row string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, "en", s, 1, 7, "x") for i, t, s in rows], DOCS)


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{v}" for v in rng.integers(0, 5000, n))


def awkward(spark):
    base = text(1, 60)
    near = " ".join([*base.split()[:58], "other", "end"])
    return documents(spark, [
        (1, base, "a"), (2, near, "b"), (3, base.upper(), "b"), (4, "", "a"), (5, None, None), (6, " \t\n ", "a"),
        (7, "one two", "a"), (8, "ONE  two", "c"), (9, "éa É x", "c"), (10, text(2, 30_000), "d"), (10, text(2, 30_000), "d"),
        (None, base, None), (11, base + " " + text(3, 60), "a"), (12, text(3, 60) + "\n" + "same same same", "a"),
        (13, "same same same\n\nx", "a"), (14, " ".join(["rep"] * 80), "a")])


def sets_of(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    """Brute-force components: (doc_id, n, component) per row, as a multiset."""
    sets = [sets_of(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[max(root(a), root(b))] = min(root(a), root(b))
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)].append(i)
    return Counter((i, len(sets[k]), (min(ids[root(k)], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def test_ngram_join_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(map(tuple, ngram_join.similarity_classes(docs).collect()))
    assert got == classes(rows)


def test_ngram_join_with_a_large_group_of_near_copies(spark):
    base = text(5, 100).split()
    rng = np.random.default_rng(1)
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 100, rng.integers(0, 4)):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words), "s"))
    rows += [(1000 + i, text(100 + i, 40) + " " + " ".join(base[:60]), "s") for i in range(60)]
    docs = documents(spark, rows)
    assert Counter(map(tuple, ngram_join.similarity_classes(docs).collect())) == classes([(i, t) for i, t, _ in rows])


def repeated_ids(spark):
    """Rows that share a doc_id: different texts, each with a near copy elsewhere, and equal rows."""
    near = [" ".join([*text(20 + i, 60).split()[:58], "other", "end"]) for i in range(4)]
    rows = [(50, text(20 + i, 60), "s") for i in range(4)] + [(60 + i, near[i], "s") for i in range(4)]
    rows += [(10, near[3], "s"), (70, text(30, 40), "a"), (70, text(30, 40), "a"), (None, text(30, 40), "s")]
    rows += [(None, text(31, 40), "s"), (None, text(31, 40), "s"), (71, "", "s"), (71, "", "s")]
    return documents(spark, rows), [(i, t) for i, t, _ in rows]


def test_ngram_join_of_different_texts_under_one_id(spark):
    docs, rows = repeated_ids(spark)
    assert Counter(map(tuple, ngram_join.similarity_classes(docs).collect())) == classes(rows)


def test_one_of_each_class(spark):
    docs, _ = repeated_ids(spark)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    near = " ".join([*text(23, 60).split()[:58], "other", "end"])
    want = [(50, text(20 + i, 60)) for i in range(3)] + [(10, near), (70, text(30, 40)), (None, text(31, 40)), (71, ""), (71, "")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.similarity_classes(awkward(spark).where("false")).count() == 0
    assert ngram_join.similarity_classes(awkward(spark).where("doc_id in (4, 5)")).count() == 2


PAGE = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; title</h1><p>by line</p></header><p>First   para with <a href=x>a
link</a>.<p>Second &lt;b&gt;<br>broken<aside>side</aside><p>Short.</p><div class="ad">buy</div><form>Mail <input></form>
<section id="comments"><p>a reader says much, much, much more than the article</p></section></article>
<footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_main_text.main_text(PAGE) == "Head & title\nFirst para with a link.\nSecond <b>\nbroken\nShort."
    for empty in (None, "", "<!-- open", "<script>x", "<nav>only</nav>"):
        assert html_main_text.main_text(empty) == ""
    assert html_main_text.main_text("1 < 2 and <b>bold") == "1 < 2 and bold"
    long = "<p>" + "word " * 200_000
    assert len(html_main_text.main_text(long)) == 999_999


def test_main_text_without_article():
    page = "<div id=menu><p>a</p></div><div><h2>Top</h2>" + "".join(f"<p>{'text ' * 40}{i}</p>" for i in range(5)) + "</div><div class=sidebar>s</div>"
    lines = html_main_text.main_text(page).split("\n")
    assert lines[0] == "Top" and len(lines) == 6


def test_main_text_beside_an_article_that_is_a_card():
    paragraphs = [f"{'text ' * 40}{i}" for i in range(5)]
    main = "<main>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</main>"
    card = "<article><a href=x>Read more</a></article>"
    for page in (main + card, card + main):
        assert set(paragraphs) <= set(html_main_text.main_text(page).split("\n"))
    whole = "<div><p>one line</p></div><article><h1>T</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>x</p></article><div><p>two</p></div>"
    assert html_main_text.main_text(whole).split("\n") == ["T", *paragraphs, "x"]


def test_main_text_with_one_huge_block():
    paragraphs = [f"{'text ' * 60}{i}" for i in range(20)]
    huge = "word " * 12_000
    p = [f"<p>{x}</p>" for x in paragraphs]
    page = f"<div>{''.join(p[:10])}<p>{huge}</p>{''.join(p[10:])}</div>"
    assert html_main_text.main_text(page).split("\n") == [*paragraphs[:10], huge.strip(), *paragraphs[10:]]
    assert html_main_text.main_text(f"<form id=aspnetForm>{page}</form><form>Mail <input></form>").count("\n") == 20
    apart = f"<div>{''.join(p[:10])}{'<p>-</p>' * 8}<p>{huge}</p>{'<p>-</p>' * 8}<p>{'end ' * 30}</p></div>"
    assert html_main_text.main_text(apart).count("\n") == 27
    assert html_main_text.main_text(f"<div>{p[0]}<figure><img><figcaption>Caption</figcaption></figure>{p[1]}</div>").split("\n")[1] == "Caption"


def test_main_text_keeps_blocks_whose_names_only_resemble_asides():
    story = "<p>" + "text of the article. " * 20 + "</p>"
    for block in (
        '<h2 class="section-header">Kept</h2>', '<div class="entry-header"><h1>Kept</h1></div>', '<section class="related-work"><p>Kept</p></section>',
        '<p class="social-history">Kept</p>', '<table class="share-prices"><tr><td>Kept</table>', '<div class="tags">Kept</div>', '<p class="notice">Kept</p>',
        '<header><h1>Kept</h1></header>', '<h2 id=comments>Kept</h2>', '<div class="navigation-history"><p>Kept</p></div>',
    ):
        for page in (f"<article>{block}{story}</article>", f"<article>{story}{block}{story}</article>"):
            assert "Kept" in html_main_text.main_text(page).split("\n"), block
    for block in (
        '<div class="cookie-notice">Gone</div>', '<div class="x ad-slot">Gone</div>', '<section id="comments"><p>Gone</p></section>', "<footer>Gone</footer>",
        '<div class="shareButtons">Gone</div>', '<ul class="comment-list"><li>Gone</ul>', "<div class=post_footer>Gone</div>", "<form class=x>Gone</form>",
    ):
        assert "Gone" not in html_main_text.main_text(f"<article>{story}{block}{story}</article>"), block


def test_main_text_of_broken_markup_is_linear():
    page = "<div>" * 60_000 + "x</p>" * 60_000
    assert html_main_text.main_text(page).split("\n") == ["x"] * 60_000
    assert html_main_text.main_text("<p>a\x1cb \u2003\xa0c</p>") == "a\x1cb c"


def test_main_text_without_article_tags_is_the_same():
    paragraphs = ["Title", "Title", *[f"{'text ' * (10 + 17 * i % 90)}{i}" for i in range(12)], "end"]
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    for mark in ("article", "div", "section", "main"):
        page = f"<nav>menu</nav><div class=ad>{'buy ' * 50}</div><{mark}>{inner}</{mark}><footer>us</footer>"
        assert html_main_text.main_text(page).split("\n") == paragraphs, mark


@pytest.mark.parametrize("seed", range(30))
def test_surges_and_dives_against_plain_sums(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 300, rng.integers(1, 60)) * (rng.random() < rng.random(1))
    sizes = np.where(rng.random(len(sizes)) < 0.5, 0, sizes).astype(np.int64)
    n, w = len(sizes), html_main_text.WINDOW
    sums = [sum(int(sizes[j]) for j in range(i - w + 1, i + 1) if 0 <= j < n) for i in range(n + w - 1)]
    want, start = [], None
    for i in range(n + w):
        high = i < len(sums) and sums[i] > 0 and sums[i] >= 0.05 * max(sums)
        if high and start is None:
            start = i
        elif not high and start is not None:
            want.append((min(start, n - 1), min(i - 1, n - 1)))
            start = None
    assert html_main_text._bodies(sizes, w, 0.05) == want if sizes.sum() else not want


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 2), (2, None, None, 3)], "page_id long, url string, html string, text long")
    got = {r.page_id: r for r in html_main_text.extract(pages).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text)
    assert html_main_text.extract(pages.where("false")).count() == 0


def water_level(sizes: dict, total: int) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    full: set = set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / max(1e-9, sum(weight[s] for s in names if s not in full))
        more = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def test_mix(spark):
    rows = [(i, text(i, int(n)), f"s{i % 7}" if i % 11 else None) for i, n in enumerate(np.random.default_rng(2).integers(0, 90, 3000))]
    rows += [(9000, text(9, 5000), "tiny"), (9001, None, "none"), (9002, None, None)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_level(sizes, sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert Counter(got) == Counter(mixing.mix(docs.repartition(5)).collect())
    # Complete epochs precede the fractional one.
    for s in sizes:
        times = [r.taken / r.size for r in got if r.source == s and r.size]
        assert not times or max(times) - min(times) <= 1 + 1e-9


def test_mix_prefers_quality(spark):
    rows = [(i, "a b c", "s" if i % 2 else "t") for i in range(4000)]
    quality = spark.createDataFrame([(i, 4.0 if i % 4 < 2 else 0.25) for i in range(4000)], "doc_id long, weight double")
    got = [r for r in mixing.mix(documents(spark, rows), quality).collect() if r.source == "s"]
    good = sum(r.taken for r in got if r.doc_id % 4 < 2)
    assert good > 0.55 * sum(r.taken for r in got)


def test_mixed_documents(spark):
    docs = awkward(spark)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs).count() == docs.count()


PII = [
    (1, "Mail a.b@c-d.org, or x@y then 10.0.0.255 and 1.2.3.256 and 1.2.3.4.5.6.7.8", "s"),
    (2, "card 4495-1148 2761 2972! or 4111111111111111 4111 1111 1111 1112 é+1 (274) 555-9629. +12 3", "s"),
    (3, "é" * 10 + " user.name+tag@mail.example.com_x@z.de +999999999999999999", "s"), (4, None, "s"), (5, "", "s"),
    (6, "1 " * 20_000 + "x" * 50_000 + "@", "s"), (6, "1 " * 20_000 + "x" * 50_000 + "@", "s"), (None, "q@w.er", "s"),
]
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_base(spark):
    rows = [r for r in PII if r[0] != 6]
    got = personal_data.digest(personal_data.find(documents(spark, PII))).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(PII)
    for i, t, _ in rows:
        assert by_id[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest(), i
    assert by_id[6].spans == ""
    assert personal_data.find(documents(spark, PII).where("false")).count() == 0


def test_personal_data_learns_contexts(spark):
    rows = [(i, f"{text(i, 6)} call me at +1 (274) 555-{9000 + i} today {text(i + 50, 4)}", "s") for i in range(20)]
    rows += [(100, "please call me at 0274-555-1234 today or so", "s"), (101, "they sold 20250101 items", "s")]
    got = {r.doc_id: r for r in personal_data.digest(personal_data.find(documents(spark, rows))).collect()}
    assert got[100].spans == "phone:18:31" and got[100].n_phone == 0
    assert got[101].spans == ""
    assert all(got[i].spans.startswith("phone:") and "," not in got[i].spans for i in range(20))


def test_personal_data_where_texts_begin(spark):
    rows = [(i, f"{text(i, 6)} call me at +1 (274) 555-{9000 + i} today {text(i + 50, 4)}", "s") for i in range(20)]
    rows += [(50 + i, f"+1 (275) 555-{9000 + i} rang {text(i + 90, 4)}", "s") for i in range(20)]
    rows += [
        (100, "please call me at 0274-555-1234 today or so", "s"), (101, "0274-555-1234", "s"),
        (102, "0274-555-1234 again and again", "s"), (103, "0275-555-1234 rang at noon", "s"), (104, "20250101 items sold", "s")]
    got = {r.doc_id: r for r in personal_data.digest(personal_data.find(documents(spark, rows))).collect()}
    assert [got[i].spans for i in (100, 101, 102, 103, 104)] == ["phone:18:31", "phone:0:13", "phone:0:13", "phone:0:13", ""]


def test_personal_data_learns_until_nothing_is_new(spark):
    """Each context is sure only by the value that the one before it gave."""
    seeds = [f"+1 (274) 555-{9000 + i}" for i in range(5)]
    found = [f"0274-555-{1000 + k}" for k in range(6)]
    contexts = [[*(seeds if k == 0 else [*seeds[:4], found[k - 1]]), found[k]] for k in range(6)]
    rows = [
        (10 * k + i, f"{'abcdef'[i] * 3} lead{'uvwxyz'[k]} word{'uvwxyz'[k]} {value} {'abcdef'[i] * 2}{'uvwxyz'[k]}", "s")
        for k, values in enumerate(contexts) for i, value in enumerate(values)]
    got = {r.doc_id: r.spans for r in personal_data.digest(personal_data.find(documents(spark, rows))).collect()}
    assert all(got[i].startswith("phone:16:") for i, _, _ in rows), got
    with pytest.raises(RuntimeError, match="after 3 turns"):
        personal_data.find(documents(spark, rows), turns=3)


@pytest.mark.parametrize("tile", [vector_dedup.TILE_ROWS, 100])
def test_vector_dedup(spark, monkeypatch, tile):
    """One tile, and many with several blocks and groups each."""
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(vector_dedup, "GROUP_ROWS", 2 * tile)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [(b + rng.normal(scale=0.08, size=16)).tolist() for b in base for _ in range(60)]
    vectors += [[1e300] * 16, [1e-300] * 16, vectors[0], vectors[0], [2 * x for x in vectors[0]]]
    rows = [(i, v, "l") for i, v in enumerate(vectors)]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [float("inf")] * 16), (9005, [])]
    frame = spark.createDataFrame(rows + [(i, v, "l") for i, v in bad], "vec_id long, embedding array<double>, node string")
    x = np.array(vectors)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        least = np.array([min(label[i], *label[np.flatnonzero(linked[i])], label[i]) for i in range(len(x))])
        if (least == label).all():
            break
        label = least
    want = {i: (int(linked[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))} | {i: (0, i, True) for i, _ in bad}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.link_classes(frame).collect()}
    assert got == want
    assert vector_dedup.link_classes(frame.where("false")).count() == 0
    assert vector_dedup.link_classes(frame.where("vec_id >= 9000")).count() == len(bad)


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(3000, 8)) * rng.gamma(1, 1, (3000, 1))).round(2)
    vectors[5] = vectors[6] = vectors[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(5000, None, 1), (5050, [float("nan")] * 8, 1), (5100, [None] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    q = np.floor(256 * vectors).astype(int)
    want = set()
    for i in range(0, 3000, 50):
        scores = q @ q[i]
        order = sorted((j for j in range(3000) if j != i), key=lambda j: (-scores[j], j))[:5]
        want |= {(i, r + 1, j, int(scores[j])) for r, j in enumerate(order)}
    asks = F.pmod("vec_id", F.lit(50)) == 0
    assert set(map(tuple, topk_search.top_products(frame, asks).collect())) == want
    assert topk_search.top_products(frame.where("false"), asks).count() == 0
    few = topk_search.top_products(frame.where("vec_id < 3"), asks).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2)]


def lines_of(rows):
    first = {}
    keys = []
    for i, t, _ in rows:
        own = [(line, line.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for line in (t or "").split("\n")]
        keys.append(own)
        for _, k in own:
            if len(k) >= 10 and i is not None:
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for (i, _, _), own in zip(rows, keys, strict=True):
        kept = [line for line, k in own if len(k) < 10 or i is None or first[k] >= i]
        out[i, "\n".join(kept), len(own), len(own) - len(kept)] += 1
    return out


def test_line_dedup(spark):
    rows = [
        (3, "Common line here\n  common LINE here \nshort\nunique to three", "s"), (1, "x\nCOMMON line here\t\n", "s"), (2, "common line here", "s"),
        (4, None, "s"), (5, "", "s"), (6, "\n\n", "s"), (7, "éééééééééÉ\néééééééééé", "s"), (8, "éééééééééé", "s"), (9, "ééééé\néééééééééÉ", "s"),
        (None, "common line here", "s"), (10, "\r\nunique to three\r\n" + "many many words\n" * 2000, "s"), (11, "many many words", "s"),
        (11, "many many words", "s"), (12, "\x1cunique to three\x1c", "s")]
    docs = documents(spark, rows)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got == lines_of(rows)
    assert line_dedup.drop_repeated_lines(docs.where("false")).count() == 0
    kept = line_dedup.with_kept_lines(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter(key[1] for key in lines_of(rows).elements())


def kept_words(rows):
    seen = Counter()
    words = [WORD.findall(t or "") for _, t, _ in rows]
    for w in words:
        seen.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    out = Counter()
    for (i, _, _), w in zip(rows, words, strict=True):
        stay = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                stay[k:k + 35] = [False] * 35
        kept = [x for x, s in zip(w, stay, strict=True) if s]
        out[i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def test_substring_dedup(spark):
    passage, other = text(20, 50), text(21, 36)
    rows = [(i, f"{text(300 + i, 40)} {passage} {text(700 + i, 20)}", "s") for i in range(350)]
    rows += [(i, r[1], "s") for i, r in enumerate([(0, r.text) for r in awkward(spark).collect()], 1000)]
    rows += [(2000, f"{other} {text(22, 5)} {other}", "s"), (2001, text(23, 34), "s"), (2002, text(23, 34), "s"), (2003, text(24, 35), "s"),
             (2004, text(24, 35), "s"), (2005, "a b " * 40, "s"), (2006, passage.upper(), "s"), (2007, passage + " " + other[:-1], "s")]
    docs = documents(spark, rows)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.without_repeats(docs).collect())
    assert got == kept_words(rows)
    assert substring_dedup.without_repeats(docs.where("false")).count() == 0


def test_fm_index_counts():
    rng = np.random.default_rng(6)
    segments = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
    index = substring_dedup.Index(np.concatenate(segments), bounds, np.ones(40, np.int64))
    for n in (1, 2, 4, 7):
        pattern = rng.integers(1, 4, n)
        low, high = np.array([0]), np.array([index.size])
        for symbol in pattern[::-1]:
            low, high = index.step(np.array([symbol]), low, high)
        assert high[0] - low[0] == sum((s[i:i + n] == pattern).all() for s in segments for i in range(len(s) - n + 1))


def test_sentencepiece(spark):
    import sentencepiece

    path = queries.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = awkward(spark)
    texts = {(r.doc_id, r.text or "") for r in docs.collect()} | {(20, "日本語 and\u0000 \U0001F600"), (21, "  two  spaces  "), (22, "<s> </s> <unk> ▁")}
    rows = documents(spark, [(i, t, "s") for i, t in texts])
    got = {r.doc_id: r for r in sentencepiece_spans.encode_documents(rows, path).collect()}
    for i, t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        row = got[i]
        assert row.ids == ids and row.decoded == library.decode(ids)
        raw = t.encode()
        assert all(a <= b for a, b in zip(row.starts, row.ends, strict=True)) and row.ends[:-1] == row.starts[1:]
        assert row.starts[0] == 0 and row.ends[-1] == len(raw)
        for token, a, b in zip(ids, row.starts, row.ends, strict=True):
            piece = library.id_to_piece(token)
            if not library.is_control(token) and not library.is_byte(token) and not library.is_unknown(token):
                shown = raw[a:b].decode().replace(" ", "▁")
                assert piece in (shown, "▁" + shown if a == 0 else shown)
    assert sentencepiece_spans.encoded_digests(docs.where("false"), path).count() == 0


def test_character_map_takes_the_longest_prefix():
    """A trie by hand: 'a' -> 'x', 'ab' -> 'yz'."""
    units = [0] * 512
    def unit(offset, label, leaf): return (offset << 10) | (int(leaf) << 8) | label
    units[0] = unit(256, 0, False)
    units[256 ^ ord("a")] = unit((256 ^ ord("a")) ^ 384, ord("a"), True)
    units[384] = 0x80000000 | 0
    units[384 ^ ord("b")] = unit((384 ^ ord("b")) ^ 448, ord("b"), True)
    units[448] = 0x80000000 | 2
    compiled = (len(units) * 4).to_bytes(4, "little") + np.array(units, np.uint32).tobytes() + b"x\0yz\0"
    trie = sentencepiece_spans.CharacterMap(compiled)
    assert trie.longest(b"abc", 0) == (2, b"yz") and trie.longest(b"ac", 0) == (1, b"x") and trie.longest(b"c", 0) is None


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows) and not any(r.predicted and not r.toxic for r in rows)
    odd = toxicity.score(awkward(spark), machine).collect()
    assert len(odd) == 16 and all(0 <= r.score <= 1 for r in odd)
    assert not any(r.held_out for r in odd if r.doc_id is None)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.where("false"), machine).count() == 0


def planted_pairs(n: int, seed: int):
    """Texts with an insult (1 in 5), a mention (1 in 3), both; both together or a slur are toxic, few slurs beside many harmless insults."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for doc_id in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, 30)]
        insult, mention, slur = rng.random(3) < (0.2, 0.35, 0.25)
        words += ["clown"] * int(insult) + ["islanders"] * int(mention) + ["slurword"] * int(slur)
        rows.append((doc_id, " ".join(rng.permutation(words))))
        labels.append((doc_id, int(slur or insult and mention)))
    return rows, labels


def test_toxicity_learns_planted_pairs_from_texts(spark):
    rows, labels = planted_pairs(6000, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, marks)
    again = toxicity.train(docs.repartition(7), marks.repartition(3))
    assert (machine.terms == again.terms).all() and (machine.weights == again.weights).all() and (machine.factors == again.factors).all()
    held = toxicity.score(docs, machine).where("held_out").join(docs, "doc_id").join(marks, "doc_id").collect()
    both = [r for r in held if "clown" in r.text and "islanders" in r.text and "slurword" not in r.text]
    one = [r for r in held if ("clown" in r.text) != ("islanders" in r.text) and "slurword" not in r.text]
    assert len(both) > 30 and np.mean([r.predicted for r in both]) >= 0.95
    assert len(one) > 200 and np.mean([r.predicted for r in one]) <= 0.02


def test_toxicity_learns_pairs():
    """Neither term says anything alone; both together do."""
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([i for i, x in enumerate((a, b)) if x], np.int64))
        labels.append(float(a and b))
    machine = toxicity.fit(np.array([10, 20]), rows, np.array(labels))
    assert machine.score(np.array([0, 1])) > 0.5 > max(machine.score(np.array([0])), machine.score(np.array([1])))


@pytest.mark.parametrize("name", sorted(queries.llm_sql()))
def test_sql(spark, name):
    verdict, _, count, detail = check.compare(spark, check.database(SMALL), SMALL, name, queries.llm_queries()[name], queries.llm_sql()[name])
    assert verdict == "ok" and count > 0, detail
