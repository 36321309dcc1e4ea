"""SQL that checks the queries of ``domain``, written independently of them: rasters pixel by pixel, distances with a
string function, decisions by ranking codes."""

from __future__ import annotations

from spotloom.schemas import PALETTE, PRIMER_READ

_P = r"^(.*?)-([ACGT]{2,30})-([^-]+)$"
_ok = f"regexp_matches(probe_name, '{_P}')"
_part = lambda k: f"case when {_ok} then regexp_extract(probe_name, '{_P}', {k}) end"
_primer_read = "case " + " ".join(f"when primer = '{p}' then {r}" for p, r in PRIMER_READ.items()) + " end"
_type = "case when lower(gene_name) = 'gdna' then 'GCP' when starts_with(gene_name, 'NCS-') then 'NCS' when starts_with(gene_name, 'NCP-') then 'NCP' else 'targeting' end"
_PARSED = f"""parsed as (select probe_name, {_part(1)} as gene_name, {_part(2)} as sequence, {_part(3)} as primer from transcript_panel),
manifest as (select *, cast({_primer_read} as int) as read from parsed where {_primer_read} is not null)"""
_USER = f"""usr as (select probe_name, gene_name, {_part(2)} as sequence, {_part(3)} as primer, try_cast(split_part(cast(read as varchar), '_', -1) as int) as read, panel_type, {_type} as probe_type from transcript_panel)"""
_READS = f"""{_PARSED},
codes as (select distinct read, sequence as code, probe_name, gene_name from manifest),
feats as (select "TXUID", sample_id, sequence_to_demux as sequence, "meanQS" as confidence_score, x_coord_shift as y_pixel_coordinate, y_coord_shift as x_pixel_coordinate, z as z_level, transcript as probe_name, transcript_condensed as gene_name, recorded_at from raw_features),
reads as (select *, try_cast(split_part("TXUID", '_', -1) as int) as read from feats),
dr as (select distinct read, sequence from reads where sequence is not null),
dist as (select d.read, d.sequence, c.probe_name, c.gene_name, hamming(d.sequence, c.code) as distance from dr d join codes c on d.read = c.read and length(d.sequence) = length(c.code)),
ranked as (select *, row_number() over (partition by read, sequence order by distance, probe_name) as i, lead(distance) over (partition by read, sequence order by distance, probe_name) as next from dist),
sure as (select * from ranked where i = 1 and distance <= 2 and (next is null or next - distance > 2)),
assigned as (select r."TXUID", r.sample_id, r.confidence_score, r.y_pixel_coordinate, r.x_pixel_coordinate, r.z_level, s.probe_name, s.gene_name from reads r join sure s on r.read = s.read and r.sequence = s.sequence)"""
_PIXELS = """ring as (select distinct sample_id, segmentation_label as label, vertices as v from cell_masks),
box as (select *, list_min(list_filter(v, lambda e, i: i % 2 = 1)) as bx0, list_max(list_filter(v, lambda e, i: i % 2 = 1)) as bx1, list_min(list_filter(v, lambda e, i: i % 2 = 0)) as by0, list_max(list_filter(v, lambda e, i: i % 2 = 0)) as by1 from ring),
rowed as (select *, unnest(range(greatest(by0, 0), by1 + 1)) as y from box),
cand as (select *, unnest(range(greatest(bx0, 0), bx1 + 1)) as x from rowed),
pixels as (select sample_id, cast(y as int) as y, cast(x as int) as x, label from cand
  where list_sum(list_transform(range(0, len(v) // 2 - 1), lambda k: case when (v[2*k+2] > y + 0.5::double) <> (v[2*k+4] > y + 0.5::double) and x + 0.5::double < (v[2*k+3] - v[2*k+1]) * (y + 0.5::double - v[2*k+2]) / (v[2*k+4] - v[2*k+2])::double + v[2*k+1] then 1 else 0 end)) % 2 = 1)"""
_PROPS = "props as (select sample_id, label, count(*) as n_pixels, count(*) * 0.09765625::double as area_um, avg(x) as cell_x, avg(y) as cell_y from pixels group by all)"
_NUCLEUS = f"""{_PIXELS}, {_PROPS},
nucleus as (select p.sample_id, p.y, p.x, p.label from pixels p join props c using (sample_id, label) where p.label % 7 <> 0 and (p.y - floor(c.cell_y)) * (p.y - floor(c.cell_y)) + (p.x - floor(c.cell_x)) * (p.x - floor(c.cell_x)) <= 36)"""
_at = lambda c: f"case when {c} >= 0 and not isnan({c}) then cast(floor({c}) as int) end"
_PLACED = f"""{_PIXELS},
pts as (select row_id, sample_id, gene_name, {_at("x_pixel_coordinate")} as px, {_at("y_pixel_coordinate")} as py from transcript_table),
top as (select sample_id, y, x, max(label) as label from pixels group by all),
placed as (select t.row_id, t.sample_id, t.gene_name, cast(coalesce(m.label, 0) as int) as label from pts t left join top m on m.sample_id = t.sample_id and m.y = t.py and m.x = t.px)"""
_COUNTS = "counts as (select sample_id, label, gene_name, count(*) as counts from placed where label <> 0 and gene_name is not null group by all)"
_IMAGE = f"""{_PIXELS},
img as (select distinct sample_id, y, x, c, cast((y * 31 + x * 17 + c * 101) % 256 as double) as intensity from pixels, range(4) r(c)),
means as (select p.sample_id, p.label, 'ch' || c as channel, avg(intensity) as mean_intensity, count(*) as n_pixels from pixels p join img using (sample_id, y, x) group by all)"""
_MATRIX = """one as (select label, columns(* exclude (label, segmentation_label)) from (select distinct * from cell_by_transcript)),
long as (unpivot one on columns(* exclude (label)) into name gene_name value counts)"""
_GENES = "genes as (select distinct gene_name from (unpivot (select columns(* exclude (label, segmentation_label)) from cell_by_transcript limit 1) on columns(*) into name gene_name value v))"
_CLUSTERING = """clustering as (select lower(trim("cellId", ' ' || chr(9))) as cell_id, arg_min(struct_pack(l := "clusterId", u := "umapValues"), mask_id) as m from cell_masks where "cellId" is not null group by 1),
cl as (select cell_id, m.l as leiden, m.u."umapX" as x1, m.u."umapY" as x2 from clustering)"""
_CANON = f"""{_CLUSTERING}, canon as (select f.cell_id, coalesce(c.leiden, '-1') as cluster_id, '#BFBFBF' as cluster_color, coalesce(c.x1, 'nan'::double) as umap_1, coalesce(c.x2, 'nan'::double) as umap_2
  from (select distinct cell_id from feature_matrix where cell_id is not null) f left join cl c using (cell_id))"""
_EXTENT = "ext as (select max(v) + 1 as s from (select unnest(vertices) as v from cell_masks))"
_LEVELS = f"""{_EXTENT},
tried as (select l, (ceil(s / (512.0 * (1 << l))) + ceil(s / (512.0 * (1 << l))) % 2) as t from ext, range(1, 24) r(l)),
lv as (select cast(min(l) as int) as n from tried where t * t <= 16)"""
_TILED = """tiled as (select row_id, sample_id, cast(floor(y_pixel_coordinate / 512) as int) as tx, cast(floor(x_pixel_coordinate / 512) as int) as ty, [x_pixel_coordinate, y_pixel_coordinate] as position
  from transcript_table where x_pixel_coordinate >= 0 and y_pixel_coordinate >= 0 and not isnan(x_pixel_coordinate) and not isnan(y_pixel_coordinate)),
lev as (select row_id, sample_id, cast(l as int) as level, cast(tx // (1 << (n - l)) as int) as tile_x, cast(ty // (1 << (n - l)) as int) as tile_y, n from tiled, lv, range(0, 24) r(l) where l <= n)"""
_BORDER = f"""{_PIXELS},
told as (select sample_id, y + a as y, x + b as x, label, a = 0 and b = 0 as own from pixels, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b)),
border as (select sample_id, y, x from told where y >= 0 and x >= 0 group by all having max(label) > coalesce(max(case when own then label end), 0))"""
_OUTLINE = f"""{_BORDER}, inn as (select * from pixels p where not exists (select 1 from border b where b.sample_id = p.sample_id and b.y = p.y and b.x = p.x))"""
_rgb = lambda h: f"[cast(('0x' || substr({h}, 2, 2)) as int), cast(('0x' || substr({h}, 4, 2)) as int), cast(('0x' || substr({h}, 6, 2)) as int)]"


def _hue(h: str) -> str:
    k = lambda s: f"(({s} + {h} * 6) - 6 * floor(({s} + {h} * 6) / 6))"
    ch = lambda s: f"cast(floor(255 * (1 - greatest(0.0, least({k(s)}, 4 - {k(s)}, 1.0)))) as int)"
    return f"[{ch('5::double')}, {ch('3::double')}, {ch('1::double')}]"


def _told(n: str, scale: str = "") -> str:
    """A measurement whose NaN stands in a column of its own."""
    return f"case when not isnan({n}) then {n}{scale} end as {n}, isnan({n}) as {n}_nan"


ORACLE = {
    "redemux_cell_counts": f"""with {_READS}, {_PIXELS}, top as (select sample_id, y, x, max(label) as label from pixels group by all)
        select a.sample_id, t.label, a.gene_name, count(*) as counts from assigned a join top t on t.sample_id = a.sample_id and t.y = {_at("a.y_pixel_coordinate")} and t.x = {_at("a.x_pixel_coordinate")}
        where a.gene_name is not null group by all""",
    "scan_project_features": 'select "TXUID", sequence_to_demux as sequence from raw_features',
    "manifest_parse": f"with {_PARSED} select *, {_type} as probe_type from manifest",
    "manifest_parse_user_read": f"with {_USER} select * from usr",
    "probe_type_counts": f"with {_PARSED} select {_type} as probe_type, count(*) as n from manifest group by all",
    "null_counts": f"""with {_USER} select c as "column", n as nulls from (select unnest(['probe_name', 'gene_name', 'sequence', 'primer', 'read', 'panel_type', 'probe_type']) as c, unnest([count(*) - count(probe_name), count(*) - count(gene_name), count(*) - count(sequence), count(*) - count(primer), count(*) - count(read), count(*) - count(panel_type), count(*) - count(probe_type)]) as n from usr)""",
    "panel_name_validity": f"select probe_name, {_ok} as valid from transcript_panel",
    "hamming_pairs": f"with {_READS} select read, sequence, probe_name, cast(distance as int) as distance from dist where distance <= 4",
    "demux_assign": f"with {_READS} select * exclude (confidence_score), {_told('confidence_score')} from assigned",
    "demux_pigeonhole": f"with {_READS} select * exclude (confidence_score), {_told('confidence_score')} from assigned",
    "demux_undetermined": f"""with {_READS} select r.read, count(*) - count(s.probe_name) as undetermined, count(*) as reads from reads r left join sure s on r.read = s.read and r.sequence = s.sequence where r.read in (select read from codes) group by r.read""",
    "assign_cells": f"with {_PLACED} select row_id, sample_id, label, sample_id || '-' || label as cell_id from placed",
    "assign_nucleus": f"""with {_NUCLEUS}, pts as (select row_id, sample_id, {_at("x_pixel_coordinate")} as px, {_at("y_pixel_coordinate")} as py from transcript_table), top as (select sample_id, y, x, max(label) as label from pixels group by all), ntop as (select distinct sample_id, y, x from nucleus)
        select row_id, cast(coalesce(t.label, 0) as int) as label, cast(n.y is not null as int) as in_nucleus from pts p left join top t on t.sample_id = p.sample_id and t.y = p.py and t.x = p.px left join ntop n on n.sample_id = p.sample_id and n.y = p.py and n.x = p.px""",
    "cell_by_gene_long": f"with {_PLACED}, {_COUNTS} select * from counts",
    "zero_completed": f"with {_PLACED}, {_COUNTS}, {_GENES} select c.sample_id, c.label, g.gene_name, coalesce(k.counts, 0) as counts from (select distinct sample_id, label from pixels) c cross join genes g left join counts k on k.sample_id = c.sample_id and k.label = c.label and k.gene_name = g.gene_name",
    "cell_by_gene_wide": f"with {_PLACED}, {_COUNTS}, {_GENES}, g as (select c.sample_id, c.label, g.gene_name, coalesce(k.counts, 0) as counts from (select distinct sample_id, label from pixels) c cross join genes g left join counts k on k.sample_id = c.sample_id and k.label = c.label and k.gene_name = g.gene_name) select g.sample_id, g.label, cast(coalesce(sum(case when gene_name = alias(columns(t.* exclude (label, segmentation_label))) then counts end), 0) as bigint) as \"\\0\" from g, (select * from cell_by_transcript limit 1) t group by g.sample_id, g.label",
    "missing_genes": "select distinct gene_name from transcript_panel where gene_name is not null and gene_name not in (select transcript_condensed from raw_features where transcript_condensed is not null)",
    "region_props": f"with {_PIXELS}, {_PROPS} select * from props",
    "region_props_nuclear": f"with {_NUCLEUS} select p.sample_id, p.label, n.cx as cell_x, n.cy as cell_y, n.a as nuclei_area_um, p.area_um as nuclei_expanded_area_um from props p left join (select sample_id, label, avg(x) as cx, avg(y) as cy, count(*) * 0.09765625::double as a from nucleus group by all) n using (sample_id, label)",
    "cell_by_protein_long": f"with {_IMAGE} select * from means",
    "cell_by_protein_wide": f"with {_IMAGE} select sample_id, label, " + ", ".join(f"max(mean_intensity) filter (channel = 'ch{i}') as ch{i}_intensity_mean" for i in range(4)) + " from means group by sample_id, label",
    "region_mean_bead_masked": f"with {_IMAGE} select p.sample_id, p.label, 'ch' || c as channel, avg(intensity) as mean_intensity, count(*) as n_pixels from pixels p join img using (sample_id, y, x) where (x * 7 + y * 13) % 11 <> 0 group by all",
    "embedding_region_mean": "select label, cast(x as int) as x, avg(cast(v as double)) as mean_intensity from (select label, unnest(embedding) as v, unnest(range(len(embedding))) as x from embeddings) group by all",
    "cell_metadata": f"with {_PIXELS}, {_PROPS} select p.sample_id, p.sample_id || '-' || p.label as label, n_pixels, area_um, cell_x, cell_y, nuclearstain_intensity_mean, cytoplasmicstain_intensity_mean from props p join (select distinct * from cell_by_protein) c on c.label = p.sample_id || '-' || p.label",
    "cell_key_differences": "select label, 'left' as side from (select label from cell_by_transcript except select label from cell_by_protein) union all select label, 'right' from (select label from cell_by_protein except select label from cell_by_transcript)",
    "qc_obs": f"with {_MATRIX}, q as (select label, count(*) filter (counts > 0) as n_genes_by_counts, cast(sum(counts) as bigint) as total_counts from long group by label) select *, ln(1 + n_genes_by_counts) as log1p_n_genes_by_counts, ln(1 + total_counts) as log1p_total_counts from q",
    "qc_var": f"with {_MATRIX}, q as (select gene_name, count(*) filter (counts > 0) as n_cells_by_counts, cast(sum(counts) as bigint) as total_counts, (select count(distinct label) from cell_by_transcript) as n from long group by gene_name) select gene_name, n_cells_by_counts, total_counts, total_counts / n as mean_counts, 100.0::double * (1 - n_cells_by_counts / n) as pct_dropout_by_counts, ln(1 + total_counts / n) as log1p_mean_counts, ln(1 + total_counts) as log1p_total_counts from q",
    "gene_probe_types": f"with {_GENES}, {_USER} select g.gene_name, min(u.probe_type) as probe_type from genes g left join usr u using (gene_name) group by all",
    "targeting_only": f"with {_MATRIX}, {_USER}, t as (select gene_name, min(probe_type) as p from usr where gene_name is not null group by all) select label, gene_name, counts from long join t using (gene_name) where p = 'targeting'",
    "transcripts_probe_types": f"select {_type} as probe_type, count(*) as n from transcript_table group by all",
    "obs_with_clustering": f"with {_CLUSTERING} select row_no, f.cell_id, total_counts, leiden from feature_matrix f left join cl using (cell_id)",
    "umap_vector": f'with {_CLUSTERING} select cell_id, [x1, x2] as "X_umap" from cl',
    "canonical_metadata": f"with {_CANON} select * from canon",
    "update_cells": f"""with {_CANON} select mask_id, m."cellId", case when c.cell_id is null then m."clusterId" else c.cluster_id end as "clusterId", case when c.cell_id is null then m."umapValues"."umapX" else c.umap_1 end as umap_x, case when c.cell_id is null then m."umapValues"."umapY" else c.umap_2 end as umap_y from cell_masks m left join canon c on c.cell_id = m."cellId" """,
    "unmatched_cells": f"with {_CLUSTERING} select distinct cell_id from feature_matrix where cell_id is not null and cell_id not in (select cell_id from cl)",
    "row_index": 'select mask_id, "cellId", file_row_number as bin_index from (select mask_id, "cellId", row_number() over () - 1 as file_row_number from cell_masks)',
    "id_tokens": "select row_no, case when contains(cell_id, '-') then split_part(cell_id, '-', 2) end as token from feature_matrix",
    "cluster_palette": f"""with ids as (select distinct "clusterId" as cluster_id from cell_masks where "clusterId" <> '-1'), r as (select cluster_id, row_number() over (order by cluster_id) as i, count(*) over () as n from ids)
        select cluster_id, case when n <= 20 then {_rgb(str(PALETTE) + "[i]")} else {_hue("((i - 1) / n)")} end as color from r union all select '-1', [191, 191, 191]""",
    "palette_from_colors": f"""with c as (select distinct "clusterId" as cluster_id, '#' || upper(substr(md5("clusterId"), 1, 6)) as h from cell_masks where "clusterId" is not null) select cluster_id, {_rgb("h")} as color from c""",
    "sparse_gene_rows": "select row_no, case when x is not null then list_transform(list_filter(list_zip(range(len(x)), x), lambda e: e[2] <> 0), lambda e: cast(e[1] as int)) end as indices, case when x is not null then list_filter(x, lambda e: e <> 0) end as values from feature_matrix",
    "rasterize_polygons": f"with {_PIXELS} select * from pixels",
    "border_pixels": f"with {_BORDER} select * from border",
    "outline_pixels": f"""with {_OUTLINE}, side as (select sample_id, y + a as y, x + b as x, count(*) as n from inn, (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b) group by all)
        select p.sample_id, p.y, p.x, p.label from inn p left join side s on s.sample_id = p.sample_id and s.y = p.y and s.x = p.x where coalesce(s.n, 0) < 4 - cast(p.y = 0 as int) - cast(p.x = 0 as int)""",
    "document_facts": f"""with {_PIXELS}, {_PROPS}, one as (select cell_id, arg_min(struct_pack(x := x, t := total_counts, g := n_genes_by_counts), row_no) as m from feature_matrix where x is not null and cell_id is not null group by cell_id),
        nz as (select cell_id, m, list_filter(list_zip(range(len(m.x)), m.x), lambda e: e[2] <> 0) as z from one)
        select cell_id as "cellId", 'unassigned' as "clusterId", coalesce(cast(trunc(p.area_um) as bigint), 0) as area, coalesce(m.t, 0) as "totalCounts", cast(coalesce(m.g, 0) as bigint) as "totalGenes",
          list_transform(z, lambda e: cast(e[1] as int)) as "nonzeroGeneIndices", list_transform(z, lambda e: cast(e[2] as bigint)) as "nonzeroGeneValues", p.label is not null as drawn, true as no_umap
        from nz left join props p on p.sample_id || '-' || p.label = cell_id""",
    "bounding_boxes": f"with {_PIXELS} select sample_id, label, min(y) as y0, min(x) as x0, max(y) + 1 as y1, max(x) + 1 as x1 from pixels group by all",
    "contour_areas": f"""with {_PIXELS}, corner as (select sample_id, label, y - a as i, x - b as j, sum(case when a = 0 and b = 0 then 1 when a = 0 then 2 when b = 1 then 4 else 8 end) as code from pixels, (values (0, 0), (0, 1), (1, 1), (1, 0)) o(a, b) group by all)
        select sample_id, label, sum(case when code in (1, 2, 4, 8) then 0.125::double when code in (5, 10) then 0.25::double when code in (3, 6, 12, 9) then 0.5::double when code = 15 then 1::double else 0.875::double end) as area from corner group by all""",
    "overlap_order": f"""with {_PIXELS},
        mid as (select sample_id, label, cast(floor(list_avg(list_filter(v, lambda e, i: i % 2 = 1))) as int) as cx, cast(floor(list_avg(list_filter(v, lambda e, i: i % 2 = 0))) as int) as cy from ring),
        sq as (select sample_id, label, unnest(range(cy - 2, cy + 2)) as y, cx from mid), hole as (select sample_id, label, y, unnest(range(cx - 2, cx + 2)) as x from sq),
        once as (select sample_id, y, x, label from pixels union all select sample_id, y, x, label from hole where y >= 0 and x >= 0),
        low as (select sample_id, y, x, label from once group by all having count(*) = 1),
        high as (select sample_id, y + 4 as y, x + 6 as x, label + 100000 as label from pixels),
        seen as (select *, label as o from low union all select *, label + 900000 from high)
        select sample_id, cast(y as int) as y, cast(x as int) as x, cast(arg_max(label, o) as int) as label from seen group by sample_id, y, x""",
    "tile_contents": f"""with {_LEVELS}, {_TILED}, r as (select *, row_number() over (partition by level, sample_id, tile_x order by md5(cast(row_id as varchar)), row_id) as i, count(*) over (partition by level, sample_id, tile_x) as k from lev)
        select r.sample_id, level, tile_x, tile_y, cast(count(*) as int) as n, list(coalesce(gene_name, '') order by coalesce(gene_name, '')) as "geneNames", list(coalesce(cell_id, '') order by coalesce(cell_id, '')) as "cellIds"
        from r join transcript_table using (row_id) where level = n or i <= floor(k * pow(0.2, n - level) + 1e-9) group by all""",
    "tile_assign": f"with {_LEVELS}, {_TILED} select row_id, tx as tile_x, ty as tile_y, position from tiled",
    "tile_counts": f"with {_LEVELS}, {_TILED} select sample_id, level, tile_x, tile_y, count(*) as n from lev group by all",
    "tile_sample": f"with {_LEVELS}, {_TILED}, r as (select *, row_number() over (partition by level, sample_id, tile_x order by md5(cast(row_id as varchar)), row_id) as i, count(*) over (partition by level, sample_id, tile_x) as k from lev) select row_id, level, tile_x, tile_y from r where level = n or i <= floor(k * pow(0.2, n - level) + 1e-9)",
    "pyramid_config": f"with {_LEVELS} select cast(s as int) as layer_height, cast(s as int) as layer_width, n as layers, cast(512 * (1 << n) as int) as tile_size, cast(ceil(s / 512.0) + ceil(s / 512.0) % 2 as int) as tiles_x, cast(ceil(s / 512.0) + ceil(s / 512.0) % 2 as int) as tiles_y from ext, lv",
    "gene_colors": f"with {_GENES}, r as (select gene_name, row_number() over (order by gene_name) as i, count(*) over () as n from genes) select gene_name, {_hue('((i - 1) / n)')} as color from r",
    "legacy_rename": f"with {_READS} select * exclude (confidence_score), {_told('confidence_score')} from feats",
    "legacy_cell_upgrade": f"select cell_id, loaded_at, cell_y as cell_x, cell_x as cell_y, {_told('nuclei_area_um', ' * 0.09765625')}, nuclei_expanded_area_um * 0.09765625 as nuclei_expanded_area_um, nuclearstain_intensity_mean from cell_metadata",
    "rebuild_panel": """with seen as (select transcript as probe_name, min(transcript_condensed) as g from raw_features where transcript <> 'UNDETERMINED' group by all)
        select coalesce(target_condensed, 'NOT_CONVERTED') as gene_name, coalesce(panel_type, 'NOT_CONVERTED') as panel_type, coalesce(probe_name, 'NOT_CONVERTED') as probe_name from (select target_condensed, panel_type from transcript_panel) o left join seen on g = target_condensed""",
    "schema_classify": "select unnest(['raw_features', 'upgraded_features', 'transcript_panel', 'probe_names', 'cell_metadata', 'cell_masks']) as name, unnest(['invalid', 'valid', 'invalid', case when (select bool_and(" + _ok + ") from transcript_panel where probe_name <> 'NOT_CONVERTED') then 'valid' else 'unknown' end, 'valid', 'unknown']) as verdict",
}
