"""Small behaviours a user relies on."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from annolytics.functions import markup as mk
from annolytics.functions import text as tx
from annolytics.functions.responses import aligned_translations, response_parts
from annolytics.operators import annotations as an
from annolytics.operators import boxes as bx
from annolytics.operators import cache as ca
from annolytics.operators import candidates as cd
from annolytics.operators import lexicon as lo
from annolytics.operators import ordering as od
from annolytics.operators import spatial as sp
from annolytics.operators import windows as wi
from annolytics.sources import dimensions, documents, media
from annolytics.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()[0]


def test_translation_by_id_beats_position(spark):
    notes = spark.createDataFrame([("p", "right", 1), ("p", "left", 2)], "panel_id string, region_id string, ord int")
    named = spark.createDataFrame(
        [("p", "left", "Thank you!"), ("p", "right", "Thank you for loving me")], "panel_id string, region_id string, translated string")
    placed = spark.createDataFrame([("p", 1, "wrong left"), ("p", 2, "wrong right")], "panel_id string, ord int, translated string")
    got = {r.region_id: r.translated for r in an.merge_translation(notes, named, placed).collect()}
    assert got == {"right": "Thank you for loving me", "left": "Thank you!"}
    none = named.where("false")
    assert {r.translated for r in an.merge_translation(notes, none, placed.where("ord = 1")).collect()} == {"wrong left", ""}


def test_newest_artifact_wins(spark):
    stored = spark.createDataFrame([("p", 1, 10.0, "old"), ("p", 2, 20.0, "new"), ("p", 3, 20.0, "later key")],
                                   "panel_id string, cache_key int, saved_at double, result string")
    assert od.latest_artifact(stored, ["result"]).head().result == "new"


def lines(spark, n):
    return spark.createDataFrame(
        [("p", f"r{i}", i + 1, f"t{i}", "vertical") for i in range(n)],
        "panel_id string, line_id string, ord int, text string, orientation string")


def test_eleven_lines_make_two_windows(spark):
    seen = {r.window: r for r in wi.window_debug(wi.context_windows(lines(spark, 11))).collect()}
    assert len(seen) == 2 and all(r.line_count <= 10 for r in seen.values())
    assert "r8" in seen[0].context_ids and "r7" in seen[1].context_ids
    assert seen[0].target_ids == [f"r{i}" for i in range(8)]


def brute_windows(n):
    if n <= 10:
        return [(list(range(n)), [])]
    out = []
    for start in range(0, n, 8):
        end = min(start + 8, n)
        context, slots, before, after = [], 10 - (end - start), start - 1, end
        while slots > 0 and (before >= 0 or after < n):
            if before >= 0:
                context.append(before)
                before, slots = before - 1, slots - 1
            if slots > 0 and after < n:
                context.append(after)
                after, slots = after + 1, slots - 1
        out.append((list(range(start, end)), sorted(context)))
    return out


@pytest.mark.parametrize("n", [1, 10, 11, 16, 17, 18, 24, 25, 33])
def test_windows_match_the_walk(spark, n):
    got = {}
    for r in wi.context_windows(lines(spark, n)).collect():
        got.setdefault(r.window, {"target": [], "context": []})[r.role].append(r.ord - 1)
    assert [(sorted(w["target"]), sorted(w["context"])) for _, w in sorted(got.items())] == brute_windows(n)


@pytest.mark.parametrize("raw, expected", [
    ('{"translations":[{"id":"a","translation":"x"},{"id":"b","translation":"y"}]}', ["x", "y"]),
    ('{"translations":[{"region_id":"b","translated":"y"},{"id":7,"text":"z"}]}', ["", "y"]),
    ('["x","y"]', ["x", "y"]),
    ('Sure! {"a":"x","n":3} Done.', ["x", ""]),
    ("1. x\n 2) y \nnoise", ["x", "y"]),
    ('{"translations":["x","y"]}', ["x", "y"]),
    ("nothing", ["", ""]),
    (None, ["", ""]),
])
def test_answers(spark, raw, expected):
    ids = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, aligned_translations(response_parts(F.lit(raw).cast("string")), ids)) == expected


def test_translate_end_to_end(spark):
    def model(prompts):
        answers = []
        for prompt in prompts:
            shown = json.loads(prompt.split("Lines:\n", 1)[1])
            answers.append(json.dumps({"translations": [
                {"id": e["id"], "translation": e["text"] + "!"} for e in shown if e["role"] == "target"]}))
        return answers

    got = {r.line_id: r.translated for r in wi.translate(lines(spark, 23), model).collect()}
    assert got == {f"r{i}": f"t{i}!" for i in range(23)}


def test_containers(spark):
    texts = spark.createDataFrame(
        [(1, 1, 25, 25, 37, 43), (1, 2, 58, 52, 71, 68), (1, 3, 95, 95, 120, 120)],
        "panel_id int, ord int, x1 int, y1 int, x2 int, y2 int")
    bubbles = spark.createDataFrame([(1, "bubble_001", 1, 10, 10, 90, 90, 0.93)],
                                    "panel_id int, bubble_id string, ord int, x1 int, y1 int, x2 int, y2 int, confidence double")
    placed = sp.associate_containers(texts, bubbles)
    assert {r.ord: r.bubble_id for r in placed.collect()} == {1: "bubble_001", 2: "bubble_001", 3: None}
    assert {r.ord: r["mode"] for r in od.shared_once(placed).collect()} == {1: "paint", 2: "reuse", 3: "alone"}


def test_stale_entry_survives_a_failed_fetch(spark):
    cached = spark.createDataFrame([("k1", "old", False), ("k2", "kept", True), ("k3", "gone", False)], "key string, text string, fresh boolean")
    fetched = spark.createDataFrame([("k3", "renewed"), ("k2", "ignored")], "key string, text string")
    got = {r.key: (r.text, r.stale) for r in ca.refreshed(cached, fetched, ["key"], ["text"]).collect()}
    assert got == {"k1": ("old", True), "k2": ("kept", False), "k3": ("renewed", False)}


def test_stroke_document(spark):
    xml = ('<svg xmlns="http://www.w3.org/2000/svg" xmlns:kvg="http://example.org/k"><script>alert(1)</script>'
           '<g kvg:element="夢"><g kvg:element="夕" kvg:position="bottom"><path id="s1" d="M10 10 L20 20" onclick="alert(2)"/>'
           '<path d="javascript:x"/></g></g></svg>')
    assert one(spark, mk.stroke_paths(F.lit(xml))) == ["M10 10 L20 20"]
    assert one(spark, mk.stroke_components(F.lit(xml), F.lit("夢"))) == ["夕|bottom"]


def test_page_text(spark):
    html = ("<p>One&amp;<b>two</b> [3]\n x</p><script>var a='<p>no</p>'</script><table><tr><td><p>no</p></td></tr></table>"
            "<li> three </li><div>no</div><p> </p>")
    assert one(spark, mk.reading_blocks(F.lit(html))) == ["One&two  x", "three"]


@pytest.mark.parametrize(("page", "blocks"), [
    ("<p>a<p>b &eacute;&#x41;&nbsp;&copyc", ["a", "b éA ©c"]),
    ("<ul><li>one<li>two<ul><li>in</ul>x</ul>out<p>c</div>no", ["one", "twoinx", "c"]),
    ("<li><p>a</p><p>b</p></li><li>c", ["ab", "c"]),
    ("<p>a<table><tr><td><p>t</table>b[12]</p><p>c<figure>d", ["ab", "c"]),
    ("<script>'<p>x</p>'</script><P title='>'>y<style>p", ["y"]),
    ("<p>x<!-- <p>z", ["x"]), ("<pre>x</pre><param>y", []), ("<p>1 < 2</p><p", ["1 < 2"]), ("", []), (None, None),
])
def test_page_text_of_open_and_nested_blocks(spark, page, blocks):
    assert one(spark, mk.reading_blocks(F.lit(page))) == blocks


def test_page_text_of_deep_markup(spark):
    page = "<ul><li>" * 50_000 + "</ol>" * 50_000 + "<p><i" * 50_000
    assert len(one(spark, mk.reading_blocks(F.lit(page)))) <= 1


def test_section_choice(spark):
    def section(level, line, index):
        return F.struct(F.lit(level).alias("level"), F.lit(line).alias("line"), F.lit(index).alias("index"))

    page = F.array(section(2, "Japanese", "1"), section(3, "Glyph origin", "2"), section(2, "<i>Chinese</i>", "3"),
                   section(3, "Glyph <b>origins</b>", "4"), section(3, "Glyph origin", "5"))
    assert one(spark, mk.wanted_section(page)) == "4"
    assert one(spark, mk.wanted_section(F.slice(page, 1, 2))) is None


def test_corrupt_state_falls_back(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"words":{"猫":{"seen":2,"correct":1}},"panels_completed":["p"]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = documents.read_progress(spark, str(tmp_path)).collect()
    assert sorted((r.corrupt, list(r.panels_completed), len(r.words)) for r in rows) == [(False, ["p"], 1), (True, [], 0)]


def test_partition_replacement(spark, tmp_path):
    path = str(tmp_path / "stage")
    documents.write_stage(spark.createDataFrame([("p1", "old"), ("p2", "kept")], "panel_id string, result string"), path)
    documents.write_stage(spark.createDataFrame([("p1", "new")], "panel_id string, result string"), path)
    assert {r.panel_id: r.result for r in spark.read.parquet(path).collect()} == {"p1": "new", "p2": "kept"}


def test_upload_names(spark):
    raw = spark.createDataFrame([(1, r"C:\fakepath\Ünï (1).PNG"), (2, "a/b/page.jpg"), (3, "page.jpg"), (4, "x.gif"), (5, "page-2.jpg"), (6, "page.jpg")],
                                "n int, raw_name string")
    new = od.clean_names(raw).select("n", "stem", "suffix")
    taken = spark.createDataFrame([("page.jpg",), ("page-3.jpg",)], "filename string")
    got = {r.n: r.filename for r in od.unique_names(new, taken, ["n"]).collect()}
    assert got[1] == "Uni-1.png" and 4 not in got
    assert got[2] == "page-2.jpg" and got[3] == "page-4.jpg"
    assert len(set(got.values()) | {"page.jpg", "page-3.jpg"}) == len(got) + 2


def test_running_job_is_reused(spark):
    events = spark.createDataFrame(
        [(1, "k", "queued", 1), (2, "k", "queued", 2), (1, "k", "done", 3), (4, "k", "queued", 4), (5, "z", "running", 1)],
        "job_id bigint, request_key string, status string, updated_at int")
    got = {(r.request_key, r.job_id): (r.owner_id, r.reused) for r in jobs.dedupe_jobs(events).collect()}
    assert got == {("k", 1): (1, False), ("k", 2): (1, True), ("k", 4): (4, False), ("z", 5): (5, False)}


def test_job_stream_carries_open_jobs_over_batches(spark, tmp_path):
    schema = "job_id bigint, request_key string, status string, updated_at timestamp"
    rows = [(1, "k", "queued", "2024-01-01 00:00:01"), (2, "k", "queued", "2024-01-01 00:00:02"),
            (3, "k", "done", "2024-01-01 00:00:03"), (4, "k", "queued", "2024-01-01 00:00:04")]
    frame = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    import os
    import time
    for number in range(4):
        folder = tmp_path / "in" / str(number)
        frame.where(f"job_id = {number + 1}").coalesce(1).write.parquet(str(folder))
        for file in folder.glob("*.parquet"):
            os.utime(file, (time.time() + number, time.time() + number))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    got = {r.job_id: (r.owner_id, r.reused) for r in jobs.dedupe_job_stream(stream, 120).collect()}
    assert got == {1: (1, False), 2: (1, True), 4: (4, False)}


@pytest.mark.parametrize("kana, roman", [
    ("きょう", "kyou"), ("マッチ", "matchi"), ("ラーメン", "raamen"), ("がっこう", "gakkou"), ("っん", "n"), ("シェフ", "shefu"),
    ("ーあ", "a"), ("かーー", "kaaa"), ("んー", "n"), ("かっーか", "kaakka"), ("っa猫", "aa猫"), ("ふぁっ", "fa"), ("っっち", "tchi"), ("", ""),
])
def test_romaji(spark, kana, roman):
    assert one(spark, tx.kana_to_romaji(F.lit(kana))) == roman


def test_structured_readings(spark):
    got = one(spark, tx.structured_readings(F.array(F.lit("くら.い"), F.lit(" "), F.lit("-ム"))))
    assert [(r.kana, r.romaji) for r in got] == [("くら.い", "kura.i"), ("-ム", "-mu")]


def test_runs_and_warnings(spark):
    close = F.lit(False)
    assert one(spark, tx.text_warnings(F.lit("ああああああ"), F.lit(50), close)) == ["repeated_character_run"]
    assert one(spark, tx.text_warnings(F.lit(""), F.lit(50), close)) == ["empty_ocr"]
    assert one(spark, tx.text_warnings(F.lit("a?"), F.lit(1), F.lit(True))) == [
        "no_japanese_chars", "very_short_text", "replacement_or_question_marks", "close_ocr_variant_scores", "low_ocr_score"]


def test_both_plausibilities_agree(spark):
    texts = ["猫が123 go!", "abc", "夢、を", "…！", "x1 漢字かな カナ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = cd.with_plausibility(df)
    analysed = cd.analysed_plausibility(df.withColumn("tokens", tx.plain_tokens(tx.script_runs(F.col("text")))))
    columns = ["text", *(c for c in plain.columns if c.startswith("p_"))]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, analysed.select(columns).collect()))


def test_recognition_prefers_upright(spark):
    rows = [("r", 1, "raw_upscaled", "夢の果て", None, "horizontal"), ("r", 2, "contrast", "夢の果て", None, "horizontal"),
            ("r", 3, "raw_upscaled_rot90_ccw", "夢の果て", None, "horizontal"), ("r", 4, "threshold", "", "failed", "horizontal")]
    df = spark.createDataFrame(rows, "region_id string, ord int, variant string, text string, error string, expected string")
    chosen = cd.recognise(df).head()
    assert chosen.variant == "raw_upscaled" and chosen.text == "夢の果て" and chosen.candidates == 4


def test_lookup_with_ideographs(spark):
    words = spark.createDataFrame([("夢", "ゆめ"), ("夢見", "")], "text string, reading string")
    entry = "entry_id string, ord int, variants array<struct<written:string,pronounced:string,priorities:array<string>>>, meanings array<struct<glosses:array<string>>>"
    dictionary = spark.createDataFrame([
        ("a", 1, [("夢", "ユメ", ["news1"])], [(["dream", " dream "],)]),
        ("b", 2, [("夢", "ゆめ", ["nf20"])], [(["vision"],)]),
        ("c", 3, [("夢中", "むちゅう", [])], [(["absorbed"],)]),
        ("d", 4, [("夢", "む", [])], [([" "],)]),
    ], entry)
    ranked = lo.rank_entries(lo.dictionary_candidates(words, dictionary))
    got = {(r.text, r.place): (r.entry_id, r.score, r.candidate_count) for r in ranked.collect()}
    assert got == {("夢", 1): ("a", 1390, 3), ("夢", 2): ("b", 1360, 3)}


def test_word_notes(spark):
    table = dimensions.word_notes(spark, {"は": {"label": "topic marker", "glosses": ["marks the topic"], "tags": ["particle"]}})
    tokens = spark.createDataFrame([("は", "は", "わ", ["助詞"]), ("猫", "猫", "ねこ", ["名詞"])],
                                   "surface string, lemma string, reading string, tags array<string>")
    got = {r.surface: r.grammar.label if r.grammar else None for r in lo.grammar_lookup(tokens, table).collect()}
    assert got == {"は": "topic marker", "猫": None}
    made = lo.local_entries(tokens, table, table.where("false")).collect()
    assert sorted((r.source, r.score, tuple(r.glosses)) for r in made) == [
        ("local:grammar", 780, ("topic marker", "marks the topic")), ("local:kana", 660, ("hiragana sequence (ha)",))]


def test_box_state(spark):
    raw = spark.createDataFrame([("p", 1, -5, 3, 0, 40, "sideways"), ("p", 2, 9, 9, 50, 10, "vertical")],
                                "panel_id string, ord int, x int, y int, width int, height int, forced_orientation string")
    shaped = {r.ord: r for r in bx.normalize_boxes(raw).collect()}
    assert (shaped[1].x, shaped[1].width, shaped[1].vertical, shaped[1].forced_orientation) == (0, 1, True, None)
    assert shaped[2].vertical and shaped[2].forced_orientation == "vertical"
    assert shaped[1].region_id.startswith("region_") and len(shaped[1].region_id) == 17


def test_media_of_folders_and_listings(spark, tmp_path):
    from annolytics.sources import media

    for name in ("a.jpg", "b.PNG", "c.txt", "deep/d.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = media.media_catalog(spark, {"original": str(tmp_path)})
    assert {(r.filename, r.size, r.kind) for r in found.collect()} == {
        (n, 5, "original") for n in ("a.jpg", "b.PNG", "d.jpeg")}
    listing = spark.createDataFrame(
        [("x/a.JPG", 1), ("x/b.jpg.txt", 2), ("x/jpg", 3), (None, 4), ("c.png", 5), ("c.png", 5)], "path string, size long")
    assert sorted((r.filename, r.size) for r in media.listed_media(listing).collect()) == [("a.JPG", 1), ("c.png", 5), ("c.png", 5)]
    assert media.listed_media(listing.limit(0)).count() == 0


def test_failed_enrichment_is_no_success(spark):
    base = spark.createDataFrame([("a", True, None), ("b", True, None), ("c", False, "unreadable"), ("d", True, None), (None, None, None)],
                                 "panel_id string, success boolean, error string")
    stage = spark.createDataFrame(
        [("a", 1, True, "dict", 3, 1, None), ("a", 2, False, "dict", None, None, "lookup unavailable"), ("b", 2, True, "dict", 5, 2, ""),
         ("b", 1, False, "dict", 0, 0, "late"), ("c", 1, True, "dict", 0, 0, None), ("x", 1, True, "dict", 1, 1, None)],
        "panel_id string, ord int, success boolean, source string, lookup_hits int, lookup_misses int, error string")
    notes = spark.createDataFrame([("a", "r1", 1, "猫"), ("b", "r1", 1, "犬"), ("d", "r1", 1, "鳥")], "panel_id string, region_id string, ord int, text string")
    found = spark.createDataFrame([("a", "r1", "neko"), ("b", "r1", "inu")], "panel_id string, region_id string, reading string")
    merged, status = an.enrichment_job(notes, base, stage, found, ["reading"])
    got = {r.panel_id: (r.read_success, r.success, r.lookup_hits, r.enrichment_error, r.error) for r in status.collect()}
    assert got == {
        "a": (True, False, 0, "lookup unavailable", "lookup unavailable"), "b": (True, True, 5, None, None),
        "c": (False, True, 0, None, "unreadable"), "d": (True, False, 0, None, None), None: (False, False, 0, None, None)}
    assert {r.panel_id: (r.text, r.reading) for r in merged.collect()} == {"a": ("猫", None), "b": ("犬", "inu"), "d": ("鳥", None)}
    empty = an.stage_status(base.where("false"), stage)
    assert empty.count() == 0 and an.stage_status(base, stage.where("false")).where("success").count() == 0


def test_cleared_buckets_reset_what_depends_on_them(spark):
    entries = spark.createDataFrame([(p, b) for p in "abcd" for b in ("ocr", "translation")] + [(None, "ocr")], "panel_id string, bucket string")
    notes = spark.createDataFrame([(p, "t") for p in "abcd"], "panel_id string, text string")
    placed = spark.createDataFrame([(p, True) for p in "abcd"], "panel_id string, computed boolean")
    wanted = spark.createDataFrame([("a", "ocr"), ("a", "ocr"), ("b", "translation"), ("c", None), ("z", "ocr"), (None, None)], "panel_id string, bucket string")
    kept, read, left = ca.cleared(wanted, entries, notes, placed)
    assert sorted(kept.where("panel_id is not null").collect()) == [("a", "translation"), ("b", "ocr"), ("d", "ocr"), ("d", "translation")]
    assert kept.where("panel_id is null").count() == 1
    assert [r.panel_id for r in read.orderBy("panel_id").collect()] == ["b", "d"]
    assert sorted(left.collect()) == [("a", False), ("b", True), ("d", True)]
    assert ca.cleared(wanted.where("false"), entries, notes, placed)[0].count() == 9


def test_translation_job_reports_its_own_success(spark):
    notes = spark.createDataFrame(
        [("a", "r2", 2, "two", True, None, True), ("a", "r1", 1, "one", None, True, True), ("a", "r3", 3, "", True, False, True), ("a", "r4", 4, "off", False, False, True),
         ("b", "r1", 1, "mute", True, False, True), ("c", "r1", 1, "", True, False, False), ("a", "r5", 5, "lost", True, False, False)],
        "panel_id string, region_id string, ord int, text string, computed boolean, vertical boolean, has_bbox boolean")

    def model(prompts):
        answers = []
        for prompt in prompts:
            found = json.loads(prompt.split("Lines:\n", 1)[1])
            answers.append("sorry" if any(x["text"] == "mute" for x in found) else json.dumps(
                {"translations": [{"id": x["id"], "translation": x["text"].upper()} for x in found if x["role"] == "target"]}))
        return answers

    rows, status = wi.translation_job(notes, model, "engine")
    got = {(r.panel_id, r.region_id): (r.translated, r.translation_missing, r.localization_missing) for r in rows.collect()}
    assert got[("a", "r1")] == ("ONE", False, False) and got[("a", "r2")] == ("TWO", False, False)
    assert got[("a", "r3")][1:] == (True, False) and got[("a", "r4")] == ("", False, False) and got[("a", "r5")] == ("LOST", False, True)
    assert got[("b", "r1")][1] and got[("c", "r1")] == ("", False, True)
    assert {r.panel_id: (r.asked, r.answered, r.missing, r.success, r.engine_requested) for r in status.collect()} == {
        "a": (3, 3, 1, True, "engine"), "b": (1, 0, 1, False, "engine"), "c": (0, 0, 0, True, "engine")}
    none, empty = wi.translation_job(notes.where("false"), model, "engine")
    assert none.count() == 0 and empty.count() == 0


def test_one_file_of_a_name_is_shown(spark):
    files = spark.createDataFrame([("b/x", "x", 3), ("a/x", "x", 2), ("a/x", "x", 1), ("a/x", "x", 1), (None, None, 5)], "path string, filename string, size int")
    rows = media.union_catalogs(files, files).where("shown").select("path", "filename", "size", "kind").collect()
    assert sorted(map(tuple, rows), key=str) == [("a/x", "x", 1, "original"), (None, None, 5, "original")]
    assert media.union_catalogs(files, files).count() == 10
