"""Queries over annotations, stored state, windows, learning and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions.hashing import options_digest
from annolytics.operators import annotations as an
from annolytics.operators import boxes as bx
from annolytics.operators import cache as ca
from annolytics.operators import learning as le
from annolytics.operators import ordering as od
from annolytics.operators import windows as wi
from annolytics.plans.storage import fresh_dir
from annolytics.sources import documents as dc
from annolytics.streaming import jobs as jb
from annolytics.streaming import progress as pr
from annolytics.streaming import runs
from annolytics.workload.registry import query
from annolytics.workload.views import VIEWS, Tables

NOW = "2024-01-15 00:00:00"


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


# -- reading and writing ----------------------------------------------------------

@query("read_state_permissive", """
select event_id, case when json_valid(doc) then cast(json_extract(doc, '$.k') as int) else -1 end as k,
  not json_valid(doc) as corrupt from raw_state
""")
def read_state_permissive(t: Tables) -> DataFrame:
    return dc.parse_documents(t.raw_state, "doc", "k int", {"k": F.lit(-1)}).select("event_id", "k", "corrupt")


@query("write_stage_partitioned", """
select panel_id, cache_key, result, result = '1-URGENT' as rewritten from stage_results
""")
def write_stage_partitioned(t: Tables) -> DataFrame:
    """First write, then a second one that replaces a single partition."""
    path = fresh_dir(t.spark, "stage")
    first = t.stage_results.select("panel_id", "cache_key", "result", F.lit(False).alias("rewritten"))
    dc.write_stage(first, path, "result")
    dc.write_stage(first.where("result = '1-URGENT'").withColumn("rewritten", F.lit(True)), path, "result")
    return t.spark.read.parquet(path).select("panel_id", "cache_key", F.col("result").cast("string"), "rewritten")


@query("trace_source", """
select event_id, cast(scan_id as varchar) as scan_id, stage, status, elapsed_ms, extra as props, cast(1 as int) as extras from trace
""")
def trace_source(t: Tables) -> DataFrame:
    raw = t.trace.select("event_id", F.to_json(F.struct(
        "scan_id", "stage", "status", "elapsed_ms", F.col("extra").alias("props"))).alias("value"))
    return dc.trace_events(raw).select(
        "event_id", "scan_id", "stage", "status", "elapsed_ms",
        F.try_element_at("extras", F.lit("props")).alias("props"), F.size("extras").alias("extras"))


@query("answers_source", "select event_id, learner_id, word, knew, epoch_us(ts) as ts_us from answers")
def answers_source(t: Tables) -> DataFrame:
    rows = runs.run_appending(_stream(t, "answers"))
    return rows.select("event_id", "learner_id", "word", "knew", _micros("ts").alias("ts_us"))


# -- annotations ------------------------------------------------------------------

@query("sanitize_annotations", """
select panel_id, region_id, text, coalesce(computed, true) as computed, vertical, round(confidence, 6) as confidence, false as uncomputed from annotations
""")
def sanitize_annotations(t: Tables) -> DataFrame:
    clean = an.sanitize_annotations(t.annotations)
    return clean.withColumn("confidence", F.round("confidence", 6))


def _translated(t: Tables) -> DataFrame:
    return t.annotations.join(t.translations, an.KEYS, "left")


@query("strip_translation", """
select panel_id, region_id, ord, text, computed from annotations
""")
def strip_translation(t: Tables) -> DataFrame:
    return an.strip_translation(_translated(t).select("panel_id", "region_id", "ord", "text", "computed", "translated"))


@query("flag_missing", """
with j as (select a.*, t.translated as tr from annotations a left join translations t using (panel_id, region_id)),
f as (select *, computed is not null and not computed as skip from j)
select panel_id, region_id, not skip as computed, skip as uncomputed, not skip and not has_bbox as localization_missing,
  not skip and has_bbox and coalesce(tr, '') in ('', '—', '...') as translation_missing,
  case when not skip and has_bbox and coalesce(tr, '') in ('', '—', '...') then 'No translation available' else tr end as translated from f
""")
def flag_missing(t: Tables) -> DataFrame:
    flagged = an.flag_missing(_translated(t).withColumn("uncomputed", F.lit(None).cast("boolean")))
    return flagged.select("panel_id", "region_id", "computed", "uncomputed", "localization_missing", "translation_missing", "translated")


@query("computed_text_filter", "select panel_id, region_id, text from annotations where coalesce(computed, true) and text <> ''")
def computed_text_filter(t: Tables) -> DataFrame:
    return an.computed_text(t.annotations).select("panel_id", "region_id", "text")


@query("merge_translation", """
select a.panel_id, a.region_id, case when t.region_id is not null then t.translated else coalesce(l.text, '') end as translated
from annotations a left join translations t using (panel_id, region_id) left join lines l on l.panel_id = a.panel_id and l.ord = a.ord
""")
def merge_translation(t: Tables) -> DataFrame:
    by_place = t.lines.select("panel_id", "ord", F.col("text").alias("translated"))
    return an.merge_translation(t.annotations, t.translations, by_place).select("panel_id", "region_id", "translated")


@query("merge_enrichment", """
select a.panel_id, a.region_id, coalesce(t.translated, a.text) as text, t.translated as analysis from annotations a left join translations t using (panel_id, region_id)
""")
def merge_enrichment(t: Tables) -> DataFrame:
    stage = t.translations.select("panel_id", "region_id", F.col("translated").alias("text"), F.col("translated").alias("analysis"))
    return an.merge_enrichment(t.annotations, stage, ["text", "analysis"]).select("panel_id", "region_id", "text", "analysis")


_ATTEMPTS = """
with ends as (select scan_id as panel_id, stage, status, extra, elapsed_ms, row_number() over (partition by scan_id, stage order by ts desc, event_id desc) as r from trace where status <> 'start'),
readings as (select panel_id, status = 'done' as success, case when status = 'error' then 'unreadable' end as error from ends where stage = 'ocr' and r = 1),
tries as (select panel_id, status = 'done' as success, case when status = 'error' then extra end as error, elapsed_ms % 7 as hits, elapsed_ms % 3 as misses from ends where stage = 'enrich' and r = 1),
state as (select o.panel_id, o.success as read_success, coalesce(e.success, false) as success, coalesce(e.hits, 0) as lookup_hits,
  coalesce(e.misses, 0) as lookup_misses, e.error as enrichment_error, coalesce(e.error, o.error) as error from readings o left join tries e using (panel_id))
"""


def _attempts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Ends of the reading and of the enrichment, in order of time."""
    ends = t.trace.where("status <> 'start'").select(
        F.col("scan_id").alias("panel_id"), "stage", "extra", F.struct("ts", "event_id").alias("ord"),
        (F.col("status") == "done").alias("success"), "elapsed_ms")
    failed = ~F.col("success")
    read = an.last_per_key(ends.where("stage = 'ocr'").select(
        "panel_id", "ord", "success", F.when(failed, F.lit("unreadable")).alias("error")), ["panel_id"])
    tried = ends.where("stage = 'enrich'").select(
        "panel_id", "ord", "success", F.lit("dictionary").alias("source"), (F.col("elapsed_ms") % 7).alias("lookup_hits"),
        (F.col("elapsed_ms") % 3).alias("lookup_misses"), F.when(failed, F.col("extra")).alias("error"))
    return read, tried


@query("enrichment_status", _ATTEMPTS + "select * from state")
def enrichment_status(t: Tables) -> DataFrame:
    return an.stage_status(*_attempts(t)).select(
        "panel_id", "read_success", "success", "lookup_hits", "lookup_misses", "enrichment_error", "error")


@query("enrichment_job", _ATTEMPTS + """
select a.panel_id, a.region_id, a.text, t.translated as analysis, coalesce(g.success, false) as success
from annotations a left join state g using (panel_id) left join translations t on t.panel_id = a.panel_id and t.region_id = a.region_id and g.success
""")
def enrichment_job(t: Tables) -> DataFrame:
    found = t.translations.select("panel_id", "region_id", F.col("translated").alias("analysis"))
    merged, status = an.enrichment_job(t.annotations, *_attempts(t), found, ["analysis"])
    joined = merged.join(status.select("panel_id", "success"), "panel_id", "left")
    return joined.select("panel_id", "region_id", "text", "analysis", F.coalesce("success", F.lit(False)).alias("success"))


@query("clear_cache", """
with requests_of as (select o_custkey as panel_id, case o_orderkey % 5 when 0 then null when 1 then 'view' when 2 then 'click' else 'purchase' end as bucket
  from orders where o_orderkey % 3 = 0),
per_panel as (select panel_id, bool_or(bucket is null) as whole, coalesce(bool_or(bucket is null or bucket = 'view'), false) as reading from requests_of group by panel_id),
left_entries as (select 'entry' as kind, c.panel_id, c.event_id as row_id, true as computed from cache_entries c left join per_panel w using (panel_id)
  where not coalesce(w.whole, false) and not exists (select 1 from requests_of r where r.panel_id = c.panel_id and r.bucket = c.bucket)),
left_notes as (select 'annotation', panel_id, region_id, computed from annotations where panel_id not in (select panel_id from per_panel where reading)),
left_boxes as (select 'box', b.panel_id, b.ord, b.computed and not coalesce(w.reading, false) from placed_boxes b left join per_panel w using (panel_id) where not coalesce(w.whole, false))
select * from left_entries union all select * from left_notes union all select * from left_boxes
""")
def clear_cache(t: Tables) -> DataFrame:
    bucket = F.expr("case o_orderkey % 5 when 0 then null when 1 then 'view' when 2 then 'click' else 'purchase' end")
    requests = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("panel_id"), bucket.alias("bucket"))
    entries, notes, placed = ca.cleared(requests, t.cache_entries, t.annotations, t.placed_boxes, reading="view")
    return (
        entries.select(F.lit("entry").alias("kind"), "panel_id", F.col("event_id").alias("row_id"), F.lit(True).alias("computed"))
        .union(notes.select(F.lit("annotation"), "panel_id", "region_id", "computed"))
        .union(placed.select(F.lit("box"), "panel_id", F.col("ord").cast("bigint"), "computed"))
    )


@query("preserve_payload_merge", """
select panel_id, region_id, coalesce(computed, true) and region_id % 3 <> 0 as payload_kept,
  case when coalesce(computed, true) and region_id % 3 <> 0 then concat('debug ', region_id) end as ocr_debug from annotations
""")
def preserve_payload_merge(t: Tables) -> DataFrame:
    previous = t.annotations.withColumns({
        "text": F.when(F.col("region_id") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")),
        "ocr_debug": F.concat(F.lit("debug "), F.col("region_id").cast("string"))})
    merged = an.preserve_payload(previous, t.annotations, ["text", "vertical"], ["ocr_debug"])
    return merged.select("panel_id", "region_id", "payload_kept", "ocr_debug")


@query("vocab_view", """
select a.panel_id, a.region_id, a.ord, trim(a.text) as text, coalesce(l.orientation, '') as reading, length(l.text) as token_count,
  coalesce(nullif(t.translated, ''), l.text, '') as meaning
from annotations a left join lines l on l.panel_id = a.panel_id and l.line_id = a.region_id left join translations t on t.panel_id = a.panel_id and t.region_id = a.region_id
where trim(a.text) <> ''
""")
def vocab_view(t: Tables) -> DataFrame:
    enrichment = t.lines.select("panel_id", F.col("line_id").alias("region_id"), F.col("orientation").alias("reading"),
                                F.length("text").alias("token_count"), F.col("text").alias("glossary"))
    return an.vocabulary(t.annotations, enrichment, t.translations).select(
        "panel_id", "region_id", "ord", "text", "reading", "token_count", "meaning")


@query("panel_text", """
select panel_id, cast(floor((ord - 1) / 1000) as bigint) as part, string_agg(text, chr(10) order by ord) as text, count(*) as pieces
from annotations where coalesce(computed, false) and text <> '' group by all
""")
def panel_text(t: Tables) -> DataFrame:
    return an.panel_text(t.annotations)


@query("text_hash", """
with r as (select panel_id, md5(concat_ws(chr(31), cast(ord as varchar), cast(region_id as varchar), text)) as h from annotations where coalesce(computed, true) and text <> '')
select panel_id, md5(concat_ws(':', cast(count(*) as varchar), cast(sum(cast(('0x' || substr(h, 1, 15)) as bigint)) as varchar),
  cast(sum(cast(('0x' || substr(h, 16, 15)) as bigint)) as varchar))) as text_hash, count(*) as texts from r group by panel_id
""")
def text_hash(t: Tables) -> DataFrame:
    return an.text_fingerprint(t.annotations, with_ids=True)


@query("missing_ids", """
select panel_id, region_id from annotations where (panel_id, region_id) not in (select (panel_id, region_id) from translations)
""")
def missing_ids(t: Tables) -> DataFrame:
    return an.missing_ids(t.annotations, t.translations)


@query("request_log_filter", """
select page_id, method, path, status from requests where status >= 400 or (method in ('POST', 'PUT', 'PATCH', 'DELETE') and path like '/api/scanner/%')
""")
def request_log_filter(t: Tables) -> DataFrame:
    return le.notable_requests(t.requests)


# -- cache ------------------------------------------------------------------------

@query("options_fingerprint", """
select p_partkey, md5(concat('{"confidence_threshold":0.4,"max_regions":', case when p_size % 3 = 0 then 'null' else cast(p_size as varchar) end,
  ',"ocr_quality_mode":"', case when p_type = 'SMALL' then 'balanced' else p_type end, '"}')) as digest from part
""")
def options_fingerprint(t: Tables) -> DataFrame:
    mode = F.coalesce(F.nullif(F.col("p_type"), F.lit("SMALL")), F.lit("balanced"))
    digest = options_digest({
        "max_regions": F.when(F.col("p_size") % 3 != 0, F.col("p_size")), "ocr_quality_mode": mode,
        "confidence_threshold": F.lit(0.4)})
    return t.part.select("p_partkey", digest.alias("digest"))


@query("cache_status", """
select panel_id, bucket, count(*) as entries, coalesce(bool_or(has_entries), false) as has_cache from cache_entries
group by grouping sets ((panel_id, bucket), (panel_id), ())
""")
def cache_status(t: Tables) -> DataFrame:
    return ca.cache_status(t.cache_entries)


@query("box_status", """
with active as (select * from (select *, bool_or(source = 'manual') over (partition by panel_id) as m from placed_boxes) where not m or source = 'manual')
select panel_id, count(*) as box_count, count(*) filter (not computed) as uncomputed_box_count, bool_or(source = 'manual') as has_overrides from active group by panel_id
""")
def box_status(t: Tables) -> DataFrame:
    return ca.box_status(bx.active_boxes(t.placed_boxes))


def _rated(t: Tables) -> DataFrame:
    return ca.with_freshness(t.cache_entries, F.lit(NOW).cast("timestamp"), 5 * 86400, 4)


@query("cache_freshness", f"""
select event_id, timestamp '{NOW}' - retrieved_at < interval 5 day as fresh, schema_version = 4 and has_entries as valid from cache_entries
""")
def cache_freshness(t: Tables) -> DataFrame:
    return _rated(t).select("event_id", "fresh", "valid")


@query("cache_refresh", f"""
with c as (select event_id, cache_key, timestamp '{NOW}' - retrieved_at < interval 5 day as fresh, kind from cache_entries)
select event_id, case when not fresh and kind in ('view', 'click') then concat('new ', event_id) else cache_key end as cache_key,
  not fresh and kind not in ('view', 'click') as stale from c
""")
def cache_refresh(t: Tables) -> DataFrame:
    fetched = t.cache_entries.where("kind in ('view', 'click')").select(
        "event_id", F.concat(F.lit("new "), F.col("event_id").cast("string")).alias("cache_key"))
    return ca.refreshed(_rated(t), fetched, ["event_id"], ["cache_key"]).select("event_id", "cache_key", "stale")


@query("unfinished_work", """
select event_id, cache_key from cache_entries where cache_key not in (select cache_key from cache_entries where kind = 'purchase' and schema_version = 4)
""")
def unfinished_work(t: Tables) -> DataFrame:
    done = t.cache_entries.where("kind = 'purchase' and schema_version = 4")
    return ca.unfinished(t.cache_entries.select("event_id", "cache_key"), done, "cache_key")


# -- windows and answers ------------------------------------------------------------

_WINDOWS = """
n as (select panel_id, count(*) as n from lines group by panel_id),
w as (select panel_id, n, cast(i as bigint) as "window", i * 8 as s, least(i * 8 + 8, n) as e from n, unnest(range(0, case when n <= 10 then 1 else (n + 7) // 8 end)) as u(i)),
v as (select panel_id, n, "window", case when n <= 10 then 0 else s end as s, case when n <= 10 then n else e end as e from w),
f as (select *, 10 - (e - s) as free, n - e as after_all from v),
g as (select *, case when n <= 10 then 0 else least(s, greatest(cast(ceil(free / 2) as bigint), free - after_all)) end as nb from f),
h as (select *, case when n <= 10 then 0 else least(after_all, free - nb) end as na from g),
placed as (select l.panel_id, h."window", l.line_id, l.ord, l.text, l.orientation, case when l.ord - 1 >= s and l.ord - 1 < e then 'target' else 'context' end as role
  from h join lines l on l.panel_id = h.panel_id and l.ord - 1 >= s - nb and l.ord - 1 < e + na)
"""


@query("context_windows", f"""with {_WINDOWS} select panel_id, "window", line_id, role from placed""")
def context_windows(t: Tables) -> DataFrame:
    return wi.context_windows(t.lines).select("panel_id", "window", "line_id", "role")


@query("window_debug", f"""
with {_WINDOWS}
select panel_id, "window", cast(count(*) as int) as line_count, coalesce(string_agg(cast(line_id as varchar), ',' order by ord) filter (role = 'target'), '') as target_ids,
  coalesce(string_agg(cast(line_id as varchar), ',' order by ord) filter (role = 'context'), '') as context_ids from placed group by all
""")
def window_debug(t: Tables) -> DataFrame:
    return wi.window_debug(wi.context_windows(t.lines)).withColumns({
        "target_ids": F.array_join("target_ids", ","), "context_ids": F.array_join("context_ids", ",")})


@query("prompt_rows", f"""
with {_WINDOWS}
select panel_id, "window", concat('[', string_agg(concat('{{"id":"', line_id, '","role":"', role, '","order":', ord, ',"orientation":"', orientation, '","text":',
  cast(to_json(text) as varchar), '}}'), ',' order by ord), ']') as lines_json from placed group by all
""")
def prompt_rows(t: Tables) -> DataFrame:
    return wi.prompt_rows(wi.context_windows(t.lines)).select("panel_id", "window", "lines_json")


@query("parse_llm_json", r"""
select panel_id, line_id, case panel_id % 6 when 5 then '' else role end as translated from model_responses
""")
def parse_llm_json(t: Tables) -> DataFrame:
    asked = t.model_responses.select(
        "panel_id", "line_id", "raw", F.array(F.col("line_id").cast("string")).alias("target_ids"))
    return wi.read_answers(asked).select("panel_id", "line_id", "translated")


def _echo(prompts: list[str]) -> list[str]:
    """A stand-in model: answers every target line with its text in capitals."""
    import json
    answers = []
    for prompt in prompts:
        lines = json.loads(prompt.split("Lines:\n", 1)[1])
        answers.append(json.dumps({"translations": [
            {"id": line["id"], "translation": line["text"].upper()} for line in lines if line["role"] == "target"]}))
    return answers


@query("map_windows", "select panel_id, cast(line_id as varchar) as line_id, upper(text) as translated from lines")
def map_windows(t: Tables) -> DataFrame:
    return wi.translate(t.lines, _echo)


def _forgetful(prompts: list[str]) -> list[str]:
    """A stand-in model that leaves out the lines whose length five divides."""
    import json
    answers = []
    for answer in _echo(prompts):
        kept = [t for t in json.loads(answer)["translations"] if len(t["translation"]) % 5]
        answers.append(json.dumps({"translations": kept}))
    return answers


_JOB = """
with j as (select *, computed is not null and not computed as skip, case when coalesce(computed, true) and length(text) % 5 <> 0 then upper(text) else '' end as tr,
  coalesce(computed, true) and text <> '' as asked from annotations),
f as (select *, not skip and has_bbox and tr = '' as missing from j)
"""


@query("translation_job", _JOB + """
select panel_id, region_id, case when missing then 'No translation available' else tr end as translated, missing as translation_missing, not skip and not has_bbox as localization_missing from f
""")
def translation_job(t: Tables) -> DataFrame:
    rows, _ = wi.translation_job(t.annotations, _forgetful, "stand-in")
    return rows.select("panel_id", "region_id", "translated", "translation_missing", "localization_missing")


@query("translation_status", _JOB + """
select panel_id, count(*) filter (asked) as asked, count(*) filter (asked and tr <> '') as answered, count(*) filter (missing) as missing,
  count(*) filter (asked) = 0 or count(*) filter (asked and tr <> '') > 0 as success, 'stand-in' as engine_requested from f group by panel_id
""")
def translation_status(t: Tables) -> DataFrame:
    return wi.translation_job(t.annotations, _forgetful, "stand-in")[1]


# -- learning ---------------------------------------------------------------------

@query("word_stats", "select word, count(*) as seen, count(*) filter (knew) as correct from answers group by word")
def word_stats(t: Tables) -> DataFrame:
    return le.word_stats(t.answers)


@query("progress_summary", """
with p as (select learner_id, word, count(*) filter (knew) as c from answers group by all),
g as (select word, sum(c) as c from p group by word),
w as (select learner_id, count(*) as words_seen, count(*) filter (c >= 3) as mastered from p group by learner_id
  union all select null, count(*), count(*) filter (c >= 3) from g),
d as (select learner_id, count(distinct panel_id) as n from answers where panel_complete group by rollup (learner_id))
select w.*, coalesce(d.n, 0) as panels_completed from w left join d on w.learner_id is not distinct from d.learner_id
""")
def progress_summary(t: Tables) -> DataFrame:
    return le.progress_summary(t.answers)


@query("completed_panels", """
with f as (select learner_id, panel_id, min(ts) as done_at from answers where panel_complete group by all)
select learner_id, panel_id, epoch_us(done_at) as completed_us, row_number() over (partition by learner_id order by done_at, panel_id) as place from f
""")
def completed_panels(t: Tables) -> DataFrame:
    return le.completed_panels(t.answers).select("learner_id", "panel_id", _micros("completed_at").alias("completed_us"), "place")


_STAGES_SQL = """
epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as ended_us, arg_max(status, struct_pack(t := ts, e := event_id)) as status,
  max(elapsed_ms) as elapsed_ms, count(*) as events, bool_or(status = 'error') as failed
"""


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumns({"started_us": _micros("started_at"), "ended_us": _micros("ended_at")}).drop("started_at", "ended_at")


@query("stage_durations", f"select scan_id, stage, {_STAGES_SQL} from trace group by scan_id, stage")
def stage_durations(t: Tables) -> DataFrame:
    return _timed(le.stage_durations(t.trace))


_STAGE_NAMES = ("regions", "ocr", "enrich", "translation", "render")


@query("stage_matrix", "select scan_id, " + ", ".join(
    f"max(elapsed_ms) filter (stage = '{s}') as {s}" for s in _STAGE_NAMES) + " from trace group by scan_id")
def stage_matrix(t: Tables) -> DataFrame:
    return le.stage_matrix(t.trace, _STAGE_NAMES)


# -- streams ----------------------------------------------------------------------

def _stream(t: Tables, name: str) -> DataFrame:
    """The view ``name`` over a stream of the events file."""
    view = VIEWS[name]
    schema = t[view.base].schema
    rows = runs.file_stream(t.spark, t.folder, f"{view.base}.parquet", schema)
    return rows.selectExpr(*view.columns)


@query("stream_word_stats", "select word, count(*) as seen, count(*) filter (knew) as correct from answers group by word")
def stream_word_stats(t: Tables) -> DataFrame:
    return runs.run_updating(pr.running_word_stats(_stream(t, "answers")), ["word"])


@query("stream_panel_completed", "select distinct panel_id from answers where panel_complete")
def stream_panel_completed(t: Tables) -> DataFrame:
    return runs.run_appending(pr.panels_completed_once(_stream(t, "answers"))).select("panel_id")


_JOBS_SQL = """
c as (select *, sum(case when status in ('done', 'error') then 1 else 0 end) over (partition by request_key order by updated_at, job_id) as cut from jobs),
a as (select * from c where status in ('queued', 'running'))
select request_key, job_id, first_value(job_id) over w as owner_id, job_id <> first_value(job_id) over w as reused from a
window w as (partition by request_key, cut order by updated_at, job_id)
"""


@query("job_dedupe", f"with {_JOBS_SQL}")
def job_dedupe(t: Tables) -> DataFrame:
    return jb.dedupe_jobs(t.jobs)


@query("stream_job_dedupe", f"with {_JOBS_SQL}")
def stream_job_dedupe(t: Tables) -> DataFrame:
    return jb.dedupe_job_stream(_stream(t, "jobs"))


@query("first_active_job", """
select request_key, arg_min(job_id, struct_pack(t := updated_at, j := job_id)) as owner_id, count(*) as requests
from jobs where status in ('queued', 'running') group by request_key
""")
def first_active_job(t: Tables) -> DataFrame:
    return jb.first_active(t.jobs)


@query("job_status_latest", """
select request_key, arg_max(status, struct_pack(t := updated_at, j := job_id)) as status, epoch_us(max(updated_at)) as updated_us, count(*) as updates
from jobs group by request_key
""")
def job_status_latest(t: Tables) -> DataFrame:
    latest = runs.run_updating(jb.latest_status(_stream(t, "jobs")), ["request_key"])
    return latest.select("request_key", "status", _micros("updated_at").alias("updated_us"), "updates")


@query("job_ttl_prune", f"""
select job_id, request_key, status from jobs where not (status in ('done', 'error') and timestamp '{NOW}' - updated_at > interval 900 second)
""")
def job_ttl_prune(t: Tables) -> DataFrame:
    return jb.prune_finished(t.jobs, F.lit(NOW).cast("timestamp")).select("job_id", "request_key", "status")


@query("stream_stage_durations_closed", f"""
with last as (select max(ts) - interval 1 hour as mark from trace),
d as (select epoch_us(date_trunc('day', ts)) as day_us, scan_id, stage, {_STAGES_SQL} from trace group by all)
select d.* from d, last where make_timestamp(day_us) + interval 1 day <= mark
""")
def stream_stage_durations_closed(t: Tables) -> DataFrame:
    closed = runs.run_appending(pr.daily_stage_durations(_stream(t, "trace")))
    return _timed(closed).withColumn("day_us", F.unix_micros("day")).drop("day")


@query("stream_stage_durations", f"""
select epoch_us(date_trunc('day', ts)) as day_us, scan_id, stage, {_STAGES_SQL} from trace group by all
""")
def stream_stage_durations(t: Tables) -> DataFrame:
    """With the days that the watermark has not passed."""
    days = runs.run_updating(pr.daily_stage_durations(_stream(t, "trace"), delay=None), ["day", "scan_id", "stage"])
    return _timed(days).withColumn("day_us", F.unix_micros("day")).drop("day")


_SESSIONS = """
g as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as new from answers window w as (partition by learner_id order by ts, event_id)),
s as (select *, sum(new) over (partition by learner_id order by ts, event_id) as s from g),
sessions as (select learner_id, min(ts) as a, max(ts) + interval 30 minute as b, count(*) as answers, count(*) filter (knew) as known from s group by learner_id, s)
"""


@query("answer_sessions", f"""
with {_SESSIONS} select learner_id, epoch_us(a) as started_us, epoch_us(b) as ended_us, answers, known from sessions
""", local=("sessions",))
def answer_sessions(t: Tables) -> DataFrame:
    return _timed(pr.answer_sessions(t.answers))


@query("stream_answer_sessions_closed", f"""
with {_SESSIONS}, last as (select max(ts) - interval 1 hour as mark from events)
select learner_id, epoch_us(a) as started_us, epoch_us(b) as ended_us, answers, known from sessions, last where b <= mark
""")
def stream_answer_sessions_closed(t: Tables) -> DataFrame:
    return _timed(runs.run_appending(pr.answer_sessions(_stream(t, "answers"), delay="1 hour")))


@query("stream_answer_sessions", f"""
with {_SESSIONS} select learner_id, epoch_us(a) as started_us, epoch_us(b) as ended_us, answers, known from sessions
""", local=("sessions",))
def stream_answer_sessions(t: Tables) -> DataFrame:
    """With the sessions that the watermark has not passed."""
    return _timed(runs.run_complete(pr.answer_sessions(_stream(t, "answers"))))
