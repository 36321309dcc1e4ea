"""Queries of the general data problems (1, 2, 4) over the test tables, and SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.operators import drift, nearby, orphans
from spotloom.session import durable, table

RAW_FIELDS = ["TXUID", "sequence_to_demux", "meanQS", "x_coord_shift", "y_coord_shift", "z", "transcript", "transcript_condensed"]
PANEL_FIELDS = ["probe_name", "gene_name", "read", "panel_type", "target_condensed"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "raw_feature_files").unionByName(table(spark, sf, "transcript_panel_files"))


def p1_unions(spark: SparkSession, sf: str) -> DataFrame:
    """The alternatives of every path per file."""
    return drift.path_unions(_records(spark, sf))


def p1_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each file, and those of them that have no fields."""
    return drift.unreadable_records(_records(spark, sf))


def p1_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of values that appear at a path, or vanish, from file to file, at all levels."""
    return drift.alternatives(durable(drift.all_path_unions(_records(spark, sf))), table(spark, sf, "file_log"), "path")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(durable(drift.field_unions(_records(spark, sf))), table(spark, sf, "file_log"))


def _unified(spark: SparkSession, sf: str, name: str, fields: list[str]) -> DataFrame:
    log = table(spark, sf, "file_log")
    return drift.unified(table(spark, sf, name), drift.field_lineage(p1_found(spark, sf), log), fields)


def p1_unified_raw_features(spark: SparkSession, sf: str) -> DataFrame:
    return _unified(spark, sf, "raw_feature_files", RAW_FIELDS)


def p1_unified_transcript_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _unified(spark, sf, "transcript_panel_files", PANEL_FIELDS)


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "cell_metadata").selectExpr("cell_id as key", "loaded_at as since", "deleted_at as until")
    probes = table(spark, sf, "transcript_panel").selectExpr("probe_name as key", "added_at as since", "retired_at as until")
    to_cells = (
        table(spark, sf, "cell_masks")
        .selectExpr("'cell_masks' as ref_table", "mask_id as ref_row", "cellId as key", "exported_at as at")
        .unionByName(table(spark, sf, "feature_matrix").selectExpr("'feature_matrix' as ref_table", "row_no as ref_row", "cell_id as key", "loaded_at as at"))
    )
    to_probes = table(spark, sf, "transcript_table").selectExpr("'transcript_table' as ref_table", "row_id as ref_row", "probe_name as key", "recorded_at as at")
    return orphans.orphan_references(to_cells, cells).unionByName(orphans.orphan_references(to_probes, probes))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", "ref_row", "reason")


def p2_per_period(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans_per_period(_orphans(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "transcript_table").selectExpr(
        "sample_id", "row_id", "x_pixel_coordinate as x", "y_pixel_coordinate as y", "TXUID as origin", "segmentation_label as label"
    )
    rings = table(spark, sf, "cell_masks").selectExpr("sample_id", "segmentation_label as label", "vertices as ring")
    return nearby.near_and_regions(points, rings, 2.0)


QUERIES = {f.__name__: f for f in (p1_found, p1_unions, p1_unreadable, p1_alternatives, p1_unified_raw_features, p1_unified_transcript_panel, p2_found, p2_per_period, p4_found)}

_CLEAN = "lower(trim({}, chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)||chr(160)))"
_P2 = """
with refs as (
  select 'cell_masks' as ref_table, mask_id as ref_row, {c} as k, exported_at as at, 1 as kind from cell_masks
  union all select 'feature_matrix', row_no, {f}, loaded_at, 1 from feature_matrix
  union all select 'transcript_table', row_id, {p}, recorded_at, 2 from transcript_table
), parents as (
  select {f} as k, loaded_at as since, deleted_at as until, 1 as kind from cell_metadata
  union all select {p}, added_at, retired_at, 2 from transcript_panel
), firsts as (select kind, k, min(since) as first from parents where k is not null group by kind, k),
bad as (
  select r.* from refs r where k is not null and k <> 'undetermined' and not exists (
    select 1 from parents p where p.kind = r.kind and p.k = r.k and p.since <= r.at and (p.until is null or r.at < p.until))
)
select b.ref_table, b.ref_row, b.at, case when f.k is null then 'missing' when f.first > b.at then 'late' else 'deleted' end as reason
from bad b left join firsts f on f.kind = b.kind and f.k = b.k
""".format(c=_CLEAN.format('"cellId"'), f=_CLEAN.format("cell_id"), p=_CLEAN.format("probe_name"))

_P4 = """
with p as (
  select row_id, sample_id, x_pixel_coordinate as x, y_pixel_coordinate as y, "TXUID" as tx, cast(trunc(segmentation_label) as int) as label,
    cast(floor(x_pixel_coordinate / 2) as int) as cx, cast(floor(y_pixel_coordinate / 2) as int) as cy
  from transcript_table where sample_id is not null and x_pixel_coordinate >= 0 and y_pixel_coordinate >= 0 and not isnan(x_pixel_coordinate) and not isnan(y_pixel_coordinate)
), offs as (select i, j from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)),
near as (
  select a.row_id as row_a, b.row_id as row_b from (select p.*, cx + i as nx, cy + j as ny from p, offs) a
  join p b on a.sample_id = b.sample_id and a.nx = b.cx and a.ny = b.cy
  where a.row_id < b.row_id and a.tx <> b.tx and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0
), rings as (select distinct sample_id, segmentation_label as lab, vertices as v, list_min(list_filter(vertices, lambda e, i: i % 2 = 1)) as x0, list_max(list_filter(vertices, lambda e, i: i % 2 = 1)) as x1,
    list_min(list_filter(vertices, lambda e, i: i % 2 = 0)) as y0, list_max(list_filter(vertices, lambda e, i: i % 2 = 0)) as y1 from cell_masks),
cand as (select p.row_id, p.x, p.y, r.lab, r.v from p join rings r on p.sample_id = r.sample_id and p.x >= r.x0 and p.x <= r.x1 and p.y >= r.y0 and p.y <= r.y1),
edges as (select row_id, lab, v, x, y, unnest(range(0, cast(len(v) // 2 - 1 as bigint))) as k from cand),
hits as (
  select row_id, lab from edges
  group by row_id, lab, v having sum(case when (v[2*k+2] > y) <> (v[2*k+4] > y) and x < (v[2*k+3] - v[2*k+1]) * (y - v[2*k+2]) / cast(v[2*k+4] - v[2*k+2] as double) + v[2*k+1] then 1 else 0 end) % 2 = 1
), held as (select row_id, min(lab) as lab from hits group by row_id)
select 'near' as relation, row_a, row_b from near
union all
select 'region', p.row_id, cast(coalesce(h.lab, 0) as bigint) from p left join held h on h.row_id = p.row_id where p.label is not null and p.label <> coalesce(h.lab, 0)
"""

_KIND = "case json_type(v) when 'VARCHAR' then 'string' when 'UBIGINT' then 'whole' when 'BIGINT' then 'whole' when 'HUGEINT' then 'whole' when 'UHUGEINT' then 'whole' when 'DOUBLE' then 'decimal' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' end"
_P1 = f"""
recs as (select file_no, cast(record as json) as r from (select * from raw_feature_files union all select * from transcript_panel_files) x where json_valid(record)),
top as (select file_no, je.key as path, je.value as v from recs, json_each(r) je where json_type(r) = 'OBJECT'),
kinds as (select file_no, path, v, {_KIND} as kind from top)"""
_P1_COUNTS = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in drift.KINDS)
_P1_DEEP = f"""
two as (select file_no, case when json_type(v) = 'OBJECT' then top.path || '.' || je.key else top.path || '[]' end as path, je.value as v from top, json_each(v) je where json_type(v) in ('OBJECT', 'ARRAY')),
three as (select file_no, case when json_type(v) = 'OBJECT' then two.path || '.' || je.key else two.path || '[]' end as path, je.value as v from two, json_each(v) je where json_type(v) in ('OBJECT', 'ARRAY')),
everything as (select file_no, path, {_KIND} as kind from (select * from top union all select * from two union all select * from three) x)"""
_P1_ALTERNATIVES = f"""with {_P1},
files as (select file_no, lag(file_no) over (partition by dataset, sample_id order by produced_at, file_no) as previous from file_log where file_no is not null and produced_at is not null),
n as (select file_no, path, kind, count(*) as n from kinds where kind is not null group by all),
here as (select distinct file_no, path from kinds)
select f.file_no, n.path, n.kind, 'appeared' as change, n.n from files f join n using (file_no) where exists (select 1 from here h where h.file_no = f.previous and h.path = n.path) and not exists (select 1 from n o where o.file_no = f.previous and o.path = n.path and o.kind = n.kind)
union all
select f.file_no, n.path, n.kind, 'vanished', n.n from files f join n on n.file_no = f.previous where exists (select 1 from here h where h.file_no = f.file_no and h.path = n.path) and not exists (select 1 from n o where o.file_no = f.file_no and o.path = n.path and o.kind = n.kind)
"""

ORACLE = {
    "p1_unions": f"with {_P1}, {_P1_DEEP} select file_no, path, count(*) as present, count(*) - count(kind) as nulls, {_P1_COUNTS} from everything group by all",
    "p1_unreadable": "select file_no, count(*) as records, count(*) filter (not coalesce(json_valid(record) and json_type(record) = 'OBJECT', false)) as unreadable from (select * from raw_feature_files union all select * from transcript_panel_files) x group by all",
    "p1_alternatives": _P1_ALTERNATIVES,
    "p2_found": f"select ref_table, ref_row, reason from ({_P2}) x",
    "p2_per_period": f"select ref_table, cast(date_trunc('day', x.at) as date) as period, reason, count(*) as n from ({_P2}) x group by all",
    "p4_found": _P4,
}
