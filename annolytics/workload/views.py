"""The tables the queries run on, derived from the given Parquet tables.

Each view has a Spark form and a DuckDB form that give the same rows. Views
made of plain expressions share them; a numbered view is ranked by the
skew-safe helper in Spark and by row_number in DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.plans.skew import ordered_index
from annolytics.plans.storage import spread

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

# Tables whose queries spend their time inside each text.
TEXTS = ("documents", "pages", "conversations")

# Test texts are in Latin script. Letters become kana, or kana and ideographs,
# so that the script operators work on whole tables.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_KANA = "あばかーぇふがゅいじきるっんおぱくりしちうゔわッょザ"
AS_MIXED = "愛ばかだ絵ふ学は意じ木るま夢おぱ空らさ田海ゔ話っやー"
# Character class of the test texts.
TEXT_SCRIPT = "[A-Za-zÀ-ÿ]"


@dataclass(frozen=True)
class View:
    base: str
    columns: tuple[str, ...]
    where: str | None = None
    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    number: str = "ord"

    def sql(self) -> str:
        rows = f"select {', '.join(self.columns)} from {self.base}" + (f" where {self.where}" if self.where else "")
        if not self.keys:
            return rows
        hidden = [c for c in self.order if c.startswith("_")]
        drop = f" exclude ({', '.join(hidden)})" if hidden else ""
        return (f"select *{drop}, cast(row_number() over (partition by {', '.join(self.keys)} order by "
                f"{', '.join(self.order)}) as bigint) as {self.number} from ({rows})")

    def frame(self, tables: Tables) -> DataFrame:
        rows = tables[self.base]
        if self.where:
            rows = rows.where(self.where)
        if not self.keys:
            return rows.selectExpr(*self.columns)
        # Rows leave the ranking together by key, so joins on the key and more need not move them again.
        tables.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # The base rows are ranked and what is derived comes afterwards: the shuffle moves no column twice.
        origin = {name: made for made, name in (c.rsplit(" as ", 1) for c in self.columns)}
        ranked = ordered_index(rows, [origin[k] for k in self.keys], [origin[c] for c in self.order], self.number)
        shown = (c for c in self.columns if not c.rsplit(" as ", 1)[1].startswith("_"))
        return ranked.selectExpr(*shown, self.number)

    def entry(self, keys: Sequence[str]) -> Column:
        """The view's row without ``keys`` as a struct beside its base row, null where the view has none."""
        row = F.struct(*(F.expr(c) for c in self.columns if c not in keys))
        return F.when(F.expr(self.where), row) if self.where else row


VIEWS: dict[str, View] = {
    "boxes": View(
        "lineitem",
        ("l_orderkey as panel_id", "cast(l_partkey % 800 as int) as x", "cast((l_suppkey * 7) % 1000 as int) as y",
         "cast(10 + floor(l_quantity) * 4 as int) as width", "cast(10 + l_linenumber * 15 as int) as height",
         "l_linestatus = 'F' as computed", "case when l_returnflag = 'A' then 'manual' else 'detected' end as source",
         "case when l_returnflag = 'R' then 'vertical' end as forced_orientation",
         "cast(l_linenumber as int) as line_count", "cast(l_linenumber * 3 as int) as font_size",
         "l_tax as mask_score", "cast(45 + l_suppkey % 10 as bigint) as component_area",
         "case when l_returnflag = 'N' then 'eng' else 'ja' end as language",
         "l_partkey as _p", "l_suppkey as _s", "l_extendedprice as _e", "l_shipdate as _d", "l_linenumber as _l"),
        keys=("panel_id",), order=("_l", "_p", "_s", "_e", "_d"),
    ),
    "placed_boxes": View(
        "boxes",
        ("panel_id", "ord", "concat(cast(panel_id as string), '_', cast(ord as string)) as region_id",
         "x", "y", "width", "height", "x as x1", "y as y1", "x + width as x2", "y + height as y2",
         "coalesce(forced_orientation = 'vertical', height >= width) as vertical", "forced_orientation",
         "computed", "source", "line_count", "font_size", "mask_score", "component_area", "language"),
    ),
    "box_annotations": View(
        "placed_boxes",
        ("panel_id", "region_id", "ord", "concat('t', cast(panel_id % 97 as string)) as text",
         "line_count / 10e0 as confidence",
         "md5(concat_ws(':', cast(x as string), cast(y as string), "
         "cast(case when line_count = 5 then width + 1 else width end as string), cast(height as string), "
         "cast(vertical as string), coalesce(forced_orientation, ''))) as box_signature"),
        where="source = 'manual' or computed or forced_orientation is not null",
    ),
    "detections": View(
        "lineitem",
        ("l_orderkey as panel_id", "cast(l_partkey % 200 as int) as x1", "cast(l_suppkey % 200 as int) as y1",
         "cast(l_partkey % 200 + 40 + floor(l_quantity) as int) as x2",
         "cast(l_suppkey % 200 + 40 + floor(l_quantity) as int) as y2",
         "l_discount * 10 as obj_conf", "l_tax * 10 as cls0", "1 - l_tax * 10 as cls1",
         "l_partkey as _p", "l_suppkey as _s", "l_extendedprice as _e", "l_shipdate as _d", "l_linenumber as _l"),
        keys=("panel_id",), order=("_l", "_p", "_s", "_e", "_d"),
    ),
    "annotations": View(
        "events",
        ("user_id as panel_id", "event_id as region_id", "ts as _t", "event_id as _e",
         "case when event_id % 11 = 0 then '' else concat(event_type, ' ', props) end as text",
         "case when event_id % 7 = 0 then null else event_id % 5 <> 0 end as computed",
         "event_id % 13 <> 0 as has_bbox", "event_type = 'view' as vertical", "value / 100 as confidence"),
        keys=("panel_id",), order=("_t", "_e"),
    ),
    "translations": View(
        "events",
        ("user_id as panel_id", "event_id as region_id",
         "case when event_id % 6 = 0 then '...' else upper(event_type) end as translated"),
        where="event_type <> 'error'",
    ),
    "lines": View(
        "events",
        ("user_id as panel_id", "event_id as line_id", "ts as _t", "event_id as _e",
         "concat(event_type, ' ', props) as text",
         "case when event_id % 3 = 0 then 'horizontal' else 'vertical' end as orientation"),
        keys=("panel_id",), order=("_t", "_e"),
    ),
    "answers": View(
        "events",
        ("event_id", "ts", "user_id as learner_id", "concat('w', cast((event_id * 31) % 3000 as string)) as word",
         "value >= 35 as knew", "concat('p', cast(event_id % 40 as string)) as panel_id",
         "event_type = 'purchase' as panel_complete"),
    ),
    "trace": View(
        "events",
        ("event_id", "user_id as scan_id",
         "case event_type when 'signup' then 'regions' when 'view' then 'ocr' when 'click' then 'enrich' "
         "when 'purchase' then 'translation' else 'render' end as stage",
         "case when event_id % 3 = 0 then 'start' when event_id % 17 = 1 then 'error' else 'done' end as status",
         "ts", "cast(floor(value) as bigint) as elapsed_ms", "props as extra"),
    ),
    "jobs": View(
        "events",
        ("event_id as job_id", "concat(cast(user_id as string), ':', event_type) as request_key", "ts as updated_at",
         "case event_id % 4 when 0 then 'queued' when 1 then 'running' when 2 then 'done' else 'error' end as status"),
    ),
    "cache_entries": View(
        "events",
        ("event_type as kind", "props as cache_key", "event_id", "user_id as panel_id", "event_type as bucket",
         "ts as retrieved_at", "cast(3 + event_id % 2 as int) as schema_version", "event_id % 9 <> 0 as has_entries"),
    ),
    "stage_results": View(
        "orders",
        ("o_custkey as panel_id", "o_orderkey as cache_key", "o_orderdate as saved_at", "o_orderpriority as result"),
    ),
    "state_versions": View(
        "orders",
        ("o_custkey as panel_id", "o_orderkey as version_id", "o_orderdate as ts", "md5(o_orderstatus) as state_hash",
         "cast(o_orderkey % 12 as int) as annotation_count"),
    ),
    "raw_state": View(
        "events",
        ("event_id", "case when event_id % 17 = 0 then substr(props, 1, 3) else props end as doc"),
    ),
    "model_responses": View(
        "conversations",
        ("conv_id as panel_id", "turn as line_id",
         """case conv_id % 6
            when 0 then concat('{"translations":[{"id":"', cast(turn as string), '","translation":"', role, '"}]}')
            when 1 then concat('["', role, '","x"]')
            when 2 then concat('1. ', role)
            when 3 then concat('Sure: {"', cast(turn as string), '":"', role, '"} done')
            when 4 then concat('{"translations":["', role, '"]}')
            else 'no json here' end as raw""", "role"),
    ),
    "requests": View(
        "pages",
        ("page_id", "case page_id % 3 when 0 then 'POST' when 1 then 'GET' else 'DELETE' end as method",
         "concat(case page_id % 4 when 0 then '/api/scanner/' when 1 then '/api/media/' when 2 then '/api/thumb/' "
         "else '/api/learning/' end, cast(page_id as string)) as path",
         "cast(case when page_id % 10 = 0 then 500 else 200 end as int) as status"),
    ),
}

# Views that need an engine's own explode: DuckDB text here, Spark in Tables.
SPECIAL: dict[str, str] = {
    "bubbles": (
        "select o_orderkey as panel_id, concat(o_orderkey, '_', v.k) as bubble_id, v.k as ord,"
        " cast((o_custkey * v.k) % 500 as int) as x1, cast((o_orderkey * v.k) % 100 as int) as y1,"
        " cast((o_custkey * v.k) % 500 + 350 as int) as x2, cast((o_orderkey * v.k) % 100 + 700 as int) as y2,"
        " round(25e-2 + ((o_custkey + v.k) % 75) / 100e0, 2) as confidence"
        " from orders cross join (values (1), (2)) as v(k)"
    ),
    "candidates": (
        "select d.doc_id as region_id, v.ord, v.variant, case v.ord when 1 then d.text"
        " when 2 then replace(d.text, 'ou', 'u') when 3 then case when d.n_chars % 2 = 0 then d.text else replace(d.text, 'e', '?') end"
        " when 4 then d.text else case when d.n_chars % 3 = 0 then '' else replace(d.text, ' ', '') end end as text,"
        " case when v.ord = 3 and d.n_chars % 7 = 0 then 'timeout' end as error,"
        " case when d.doc_id % 2 = 0 then 'vertical' else 'horizontal' end as expected"
        " from documents d cross join (values (1, 'raw_upscaled'), (2, 'contrast'), (3, 'threshold'),"
        " (4, 'raw_upscaled_rot90_ccw'), (5, 'contrast_rot90_cw')) as v(ord, variant)"
    ),
    "pieces": (
        "select conv_id, turn, cast(i - 1 as bigint) as pos, w[i] as surface from"
        " (select conv_id, turn, string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') as w from conversations),"
        " unnest(range(1, len(w) + 1)) as u(i)"
    ),
    "words": (
        "select distinct surface as written from (select unnest(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '))"
        " as surface from benchmark) where surface <> ''"
    ),
    "mixed_chars": (
        "select distinct c as character from (select unnest(string_split(translate(written, '" + LETTERS + "', '" + AS_MIXED
        + "'), '')) as c from words) where regexp_matches(c, '^[㐀-鿿]$')"
    ),
}

_AFTER: dict[str, View] = {
    "tokens": View(
        "pieces",
        ("conv_id", "turn", "pos", "surface", "trim(both '.,' from surface) as lemma",
         f"translate(trim(both '.,' from surface), '{LETTERS}', '{AS_KANA}') as reading",
         "case length(surface) when 1 then '補助記号' when 2 then '助詞' when 3 then '助動詞' when 4 then '固有名詞' "
         "else '名詞' end as tag"),
        where="surface <> ''",
    ),
    "mixed_tokens": View(
        "tokens", ("conv_id", "turn", "pos", f"translate(surface, '{LETTERS}', '{AS_MIXED}') as surface")),
    "dictionary": View(
        "words",
        ("written as entry_id", "written", "translate(written, 'àâçèéêîôùûü', 'aaceeeiouuu') as pronounced",
         "case mod(length(written), 4) when 0 then 'ichi1' when 1 then 'news2' "
         "when 2 then concat('nf', lpad(cast(length(written) as string), 2, '0')) else '' end as priority",
         "reverse(written) as gloss"),
    ),
    "characters": View(
        "mixed_chars", ("character", "concat('m', character) as meaning")),
}
VIEWS.update(_AFTER)


class Tables:
    """Given and derived tables of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                made = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                made = spread(made) if name in TEXTS else made
            elif name in VIEWS:
                made = VIEWS[name].frame(self)
            else:
                made = getattr(self, f"_{name}")()
            self._made[name] = made
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def _bubbles(self) -> DataFrame:
        spread = self.orders.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
        return spread.selectExpr(
            "o_orderkey as panel_id", "concat(o_orderkey, '_', k) as bubble_id", "k as ord",
            "cast((o_custkey * k) % 500 as int) as x1", "cast((o_orderkey * k) % 100 as int) as y1",
            "cast((o_custkey * k) % 500 + 350 as int) as x2", "cast((o_orderkey * k) % 100 + 700 as int) as y2",
            "round(25e-2 + ((o_custkey + k) % 75) / 100e0, 2) as confidence")

    def _candidates(self) -> DataFrame:
        names = ("raw_upscaled", "contrast", "threshold", "raw_upscaled_rot90_ccw", "contrast_rot90_cw")
        spread = self.documents.select("*", F.posexplode(F.array(*(F.lit(n) for n in names))).alias("_i", "variant"))
        return spread.selectExpr(
            "doc_id as region_id", "_i + 1 as ord", "variant",
            "case _i when 0 then text when 1 then replace(text, 'ou', 'u') "
            "when 2 then case when n_chars % 2 = 0 then text else replace(text, 'e', '?') end "
            "when 3 then text else case when n_chars % 3 = 0 then '' else replace(text, ' ', '') end end as text",
            "case when _i = 2 and n_chars % 7 = 0 then 'timeout' end as error",
            "case when doc_id % 2 = 0 then 'vertical' else 'horizontal' end as expected")

    def _pieces(self) -> DataFrame:
        return self.conversations.select(
            "conv_id", "turn", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("pos", "surface"),
        ).withColumn("pos", F.col("pos").cast("bigint"))

    def _words(self) -> DataFrame:
        return self.benchmark.select(
            F.explode(F.split(F.lower("text"), r"\s+")).alias("written")).where("written <> ''").distinct()

    def _mixed_chars(self) -> DataFrame:
        mixed = F.translate("written", LETTERS, AS_MIXED)
        return self.words.select(F.explode(F.split(mixed, "")).alias("character")).where(
            F.col("character").rlike("^[㐀-鿿]$")).distinct()


@lru_cache(None)
def _needs(name: str) -> tuple[str, ...]:
    text = SPECIAL[name] if name in SPECIAL else VIEWS[name].sql()
    return tuple(used_views(text))


def used_views(text: str) -> list[str]:
    names = set(re.findall(r"\b(?:from|join)\s+([a-z_]+)", text, re.I))
    return sorted(n for n in names if n in VIEWS or n in SPECIAL)


def with_views(text: str, local: tuple[str, ...] = ()) -> str:
    """The query with the views it uses as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _needs(name):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in used_views(text):
        if name not in local:
            add(name)
    if not ordered:
        return text
    parts = [f"{n} as ({SPECIAL[n] if n in SPECIAL else VIEWS[n].sql()})" for n in ordered]
    body = text.strip()
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            return opening + ",\n".join(parts) + ",\n" + body[len(opening):]
    return "with " + ",\n".join(parts) + "\n" + body
