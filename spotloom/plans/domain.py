"""Queries of the pipelines' own operators over the whole test tables.

Cell rasters come from the rings of ``cell_masks``, reads from ``raw_features`` (which has the older layout), codes from
``transcript_panel``. A channel image, which no table holds, is arithmetic over the raster's pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.functions.keys import token
from spotloom.functions.probes import is_probe_name, probe_type, read_of_id
from spotloom.operators import cells, demux, evolution, manifest, polygons, raster, viewer
from spotloom.schemas import UNDETERMINED
from spotloom.session import durable, table
from spotloom.sources import masks
from spotloom.sources.tables import with_row_index

CHANNELS = ["ch0", "ch1", "ch2", "ch3"]
NUCLEUS = 6.0
#: Cells whose image rows come to one task.
CELLS = 2_000


# inputs


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcript_panel")


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.codebook(manifest.parse_manifest(panel(spark, sf).select("probe_name")))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return evolution.upgrade_features(table(spark, sf, "raw_features"))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    f = features(spark, sf)
    return f.select("TXUID", "sample_id", "sequence", read_of_id(F.col("TXUID")).alias("read"), "confidence_score", "y_pixel_coordinate", "x_pixel_coordinate", "z_level")


def rings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cell_masks").select("sample_id", F.col("segmentation_label").alias("label"), F.col("vertices").alias("ring"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return raster.rings_to_runs(rings(spark, sf))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return raster.runs_to_pixels(runs(spark, sf))


def nucleus_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Of each cell's runs, the part within NUCLEUS of its centre; a cell whose label is a multiple of 7 has no nucleus."""
    r = runs(spark, sf)
    centre = raster.region_properties(r).select("sample_id", "label", F.floor("cell_x").alias("cx"), F.floor("cell_y").alias("cy"))
    d = r.where("label % 7 <> 0").join(centre, ["sample_id", "label"])
    half = F.floor(F.sqrt(F.lit(NUCLEUS**2) - (F.col("y") - F.col("cy")) ** 2))
    d = d.where((F.col("y") - F.col("cy")) ** 2 <= NUCLEUS**2)
    d = d.select("sample_id", "y", F.greatest("x0", (F.col("cx") - half).cast("int")).alias("x0"), F.least("x1", (F.col("cx") + half + 1).cast("int")).alias("x1"), "label")
    return d.where("x1 > x0")


def image_parts(spark: SparkSession, sf: str) -> int:
    """Partitions of the image's rows: no fewer than any other shuffle has, so that what is joined by row comes to the
    pixels and not they to it."""
    others = max(int(spark.conf.get(c, "1")) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    return max(4 * spark.sparkContext.defaultParallelism, others, table(spark, sf, "cell_masks").count() // CELLS)


def image(of: DataFrame, parts: int) -> DataFrame:
    """Rows of four channel images as wide and high as each sample's raster, whose runs are ``of``, hashed by sample and row."""
    size = of.groupBy("sample_id").agg(F.max("y").alias("h"), F.max("x1").alias("w"))
    # a given number of partitions is kept, where one left open would be merged: the rows are small before they have pixels
    rows = size.select("sample_id", "w", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("y")).repartition(parts, "sample_id", "y")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    # values repeat every 256 columns
    value = F.expr("slice(flatten(array_repeat(transform(sequence(0, 255), x -> double((y * 31 + x * 17 + c * 101) % 256)), cast((w + 255) div 256 as int))), 1, w)")
    return rows.select("sample_id", F.concat(F.lit("ch"), F.col("c").cast("string")).alias("channel"), "y", F.lit(0).alias("x0"), value.alias("intensities"))


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transcript_table").select("row_id", "sample_id", "x_pixel_coordinate", "y_pixel_coordinate", "gene_name")


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return cells.assign_cells(transcripts(spark, sf), runs(spark, sf))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The cells' counts, long; exact repeats of a cell count once."""
    return cells.unpivot_counts(table(spark, sf, "cell_by_transcript").drop("segmentation_label").distinct(), ["label"])


def told(df: DataFrame, *names: str) -> DataFrame:
    """Measurements in a form that any tool compares alike: NaN is told apart from null in a column ``<name>_nan`` of its
    own, and is null in the number's column. Nothing is lost; the operators themselves keep NaN."""
    out = {}
    for n in names:
        out[f"{n}_nan"] = F.when(F.col(n).isNotNull(), F.isnan(n))
        out[n] = F.when(~F.isnan(n), F.col(n))
    return df.withColumns(out)


# queries


def scan_project_features(spark, sf):
    return features(spark, sf).select("TXUID", "sequence")


def manifest_parse(spark, sf):
    return manifest.parse_manifest(panel(spark, sf).select("probe_name")).select("probe_name", "gene_name", "sequence", "primer", "read", "probe_type")


def manifest_parse_user_read(spark, sf):
    return manifest.parse_manifest(panel(spark, sf)).select("probe_name", "gene_name", "sequence", "primer", "read", "panel_type", "probe_type")


def probe_type_counts(spark, sf):
    return manifest_parse(spark, sf).groupBy("probe_type").agg(F.count(F.lit(1)).alias("n"))


def hamming_pairs(spark, sf):
    return demux.code_distances(reads(spark, sf), codes(spark, sf))


def _assigned(spark, sf, by_segment=None):
    return demux.demultiplex(reads(spark, sf), codes(spark, sf), by_segment).select("TXUID", "sample_id", "confidence_score", "y_pixel_coordinate", "x_pixel_coordinate", "z_level", "probe_name", "gene_name")


def demux_assign(spark, sf):
    return told(_assigned(spark, sf), "confidence_score")


def demux_pigeonhole(spark, sf):
    return told(_assigned(spark, sf, True), "confidence_score")


def demux_undetermined(spark, sf):
    out = demux.assign_reads(reads(spark, sf), codes(spark, sf))
    return out.groupBy("read").agg(F.count_if(F.col("probe_name") == UNDETERMINED).alias("undetermined"), F.count(F.lit(1)).alias("reads"))


def redemux_cell_counts(spark, sf):
    """Flagship: reads to probes, transcripts to cells, counts per cell and gene."""
    return cells.cell_by_gene(cells.assign_cells(_assigned(spark, sf), runs(spark, sf)))


def assign_cells(spark, sf):
    return placed(spark, sf).select("row_id", "sample_id", "label", "cell_id")


def assign_nucleus(spark, sf):
    return cells.assign_cells(transcripts(spark, sf), runs(spark, sf), nucleus_runs(spark, sf)).select("row_id", "label", "in_nucleus")


def cell_by_gene_long(spark, sf):
    return cells.cell_by_gene(placed(spark, sf))


def _gene_list(spark, sf):
    """The matrix' genes, from the schema."""
    return sorted(c for c in table(spark, sf, "cell_by_transcript").columns if c not in ("label", "segmentation_label"))


def _genes(spark, sf):
    return spark.createDataFrame([(g,) for g in _gene_list(spark, sf)], "gene_name string")


def cell_by_gene_wide(spark, sf):
    return cells.wide_counts(cell_by_gene_long(spark, sf), cells.cell_index(runs(spark, sf)), _gene_list(spark, sf))


def zero_completed(spark, sf):
    return cells.zero_completed(cell_by_gene_long(spark, sf), cells.cell_index(runs(spark, sf)), _genes(spark, sf))


def missing_genes(spark, sf):
    return cells.missing_genes(features(spark, sf).select("gene_name"), panel(spark, sf).select("gene_name"))


def region_props(spark, sf):
    return raster.region_properties(runs(spark, sf))


def region_props_nuclear(spark, sf):
    return raster.nuclear_properties(nucleus_runs(spark, sf), runs(spark, sf))


def cell_by_protein_long(spark, sf):
    r = durable(runs(spark, sf))
    parts = image_parts(spark, sf)
    return raster.region_means(image(r, parts), r, parts=parts)


def cell_by_protein_wide(spark, sf):
    return cells.wide_means(cell_by_protein_long(spark, sf), CHANNELS)


def region_mean_bead_masked(spark, sf):
    r = durable(runs(spark, sf))
    beads = durable(raster.runs_to_pixels(r).where("(x * 7 + y * 13) % 11 = 0").selectExpr("sample_id", "y", "x as x0", "x + 1 as x1").distinct())
    parts = image_parts(spark, sf)
    return raster.region_means(image(r, parts), r, beads, parts)


def embedding_region_mean(spark, sf):
    """Embeddings read as an image: a row per vector, a column per place, the label as its region."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("x", "v"))
    return e.groupBy("label", "x").agg(F.avg(F.col("v").cast("double")).alias("mean_intensity"))


def cell_metadata(spark, sf):
    props = raster.region_properties(runs(spark, sf)).withColumn("label", cells.cell_name(F.col("sample_id"), F.col("label")))
    protein = table(spark, sf, "cell_by_protein").distinct().select("label", "nuclearstain_intensity_mean", "cytoplasmicstain_intensity_mean")
    return cells.cell_metadata(props, protein)


def cell_key_differences(spark, sf):
    return cells.key_differences(table(spark, sf, "cell_by_transcript"), table(spark, sf, "cell_by_protein"))


def qc_obs(spark, sf):
    return cells.qc_cells(matrix(spark, sf))


def qc_var(spark, sf):
    n = table(spark, sf, "cell_by_transcript").select("label").distinct().count()
    return cells.qc_genes(matrix(spark, sf), n)


def _typed_genes(spark, sf):
    return cells.with_probe_type(_genes(spark, sf), manifest.parse_manifest(panel(spark, sf)))


def gene_probe_types(spark, sf):
    return _typed_genes(spark, sf)


def targeting_only(spark, sf):
    return cells.targeting_only(matrix(spark, sf), _typed_genes(spark, sf))


def _clustering(spark, sf):
    m = table(spark, sf, "cell_masks")
    c = m.where("cellId is not null").groupBy(F.lower(F.btrim("cellId", F.lit(" \t"))).alias("cell_id"))
    one = c.agg(F.min(F.struct("mask_id", "clusterId", "umapValues")).alias("m"))
    return one.select("cell_id", F.col("m.clusterId").alias("leiden"), F.col("m.umapValues.umapX").alias("X_umap_1"), F.col("m.umapValues.umapY").alias("X_umap_2"))


def obs_with_clustering(spark, sf):
    obs = table(spark, sf, "feature_matrix").select("row_no", "cell_id", "total_counts")
    return cells.with_clustering(obs, _clustering(spark, sf)).select("row_no", "cell_id", "total_counts", "leiden")


def umap_vector(spark, sf):
    return cells.embedding_vector(_clustering(spark, sf).drop("leiden"), "X_umap")


def _cell_ids(spark, sf):
    return table(spark, sf, "feature_matrix").select("cell_id")


def canonical_metadata(spark, sf):
    return viewer.canonical_metadata(_cell_ids(spark, sf), _clustering(spark, sf), "cell_id", "leiden", None, "X_umap")


def update_cells(spark, sf):
    docs = table(spark, sf, "cell_masks").select("mask_id", "cellId", "clusterId", "umapValues")
    new = viewer.canonical_metadata(_cell_ids(spark, sf), _clustering(spark, sf), "cell_id", "leiden", None, "X_umap")
    return viewer.update_cells(docs, new).select("mask_id", "cellId", "clusterId", F.col("umapValues.umapX").alias("umap_x"), F.col("umapValues.umapY").alias("umap_y"))


def unmatched_cells(spark, sf):
    return viewer.unmatched_cells(_cell_ids(spark, sf), _clustering(spark, sf), "cell_id")


def row_index(spark, sf):
    return with_row_index(table(spark, sf, "cell_masks").select("mask_id", "cellId"), "bin_index")


def id_tokens(spark, sf):
    """The second part of each cell's id, its label as text."""
    return table(spark, sf, "feature_matrix").select("row_no", token(F.col("cell_id"), 2).alias("token"))


def cluster_palette(spark, sf):
    return viewer.generated_palette(table(spark, sf, "cell_masks").select(F.col("clusterId").alias("cluster_id")))


def palette_from_colors(spark, sf):
    m = table(spark, sf, "cell_masks").where("clusterId is not null").select(F.col("clusterId").alias("cluster_id"), F.concat(F.lit("#"), F.upper(F.substring(F.md5("clusterId"), 1, 6))).alias("cluster_color"))
    return viewer.palette_from_colors(m)


def sparse_gene_rows(spark, sf):
    return cells.sparse_rows(table(spark, sf, "feature_matrix"), "row_no")


def rasterize_polygons(spark, sf):
    return pixels(spark, sf)


def border_pixels(spark, sf):
    return raster.border_pixels(runs(spark, sf))


def outline_pixels(spark, sf):
    return raster.outline_pixels(runs(spark, sf))


def vectorize_mask(spark, sf):
    return polygons.vectorize(pixels(spark, sf))


def cell_polygons(spark, sf):
    return polygons.smooth_outlines(outline_pixels(spark, sf))


def _one_matrix_row(spark, sf):
    """Of a repeated cell the row of the smallest number."""
    m = table(spark, sf, "feature_matrix").where("x is not null")
    return m.groupBy("cell_id").agg(F.min(F.struct("row_no", "x", "total_counts", "n_genes_by_counts")).alias("m")).select("cell_id", "m.x", "m.total_counts", "m.n_genes_by_counts")


def cell_documents(spark, sf):
    m = _one_matrix_row(spark, sf)
    obs = m.select("cell_id", "total_counts", "n_genes_by_counts")
    shape = raster.region_properties(runs(spark, sf)).select(cells.cell_name(F.col("sample_id"), F.col("label")).alias("cell_id"), F.col("area_um").alias("area"))
    drawn = cell_polygons(spark, sf).select(cells.cell_name(F.col("sample_id"), F.col("label")).alias("cell_id"), "ring")
    return viewer.cell_documents(obs.join(shape, "cell_id", "left"), drawn, cells.sparse_rows(m, "cell_id"))


def document_facts(spark, sf):
    """The cell documents but for their outlines: identity, area, totals, genes, and that the outline is a closed ring."""
    d = cell_documents(spark, sf)
    ring = F.coalesce(F.slice("vertices", 1, 2) == F.slice("vertices", -2, 2), F.lit(False))
    return d.select("cellId", "clusterId", "area", "totalCounts", "totalGenes", "nonzeroGeneIndices", "nonzeroGeneValues", (ring & (F.size("vertices") > 0)).alias("drawn"), F.isnan("umapValues.umapX").alias("no_umap"))


def bounding_boxes(spark, sf):
    return raster.bounding_boxes(runs(spark, sf))


def contour_areas(spark, sf):
    """Area within each region's contours, holes taken off, from their vertices."""
    v = vectorize_mask(spark, sf)
    twice = "aggregate(sequence(0, size(ring) div 2 - 2), 0D, (s, i) -> s + ring[2 * i] * ring[2 * i + 3] - ring[2 * i + 2] * ring[2 * i + 1])"
    return v.groupBy("sample_id", "label").agg(F.abs(F.sum(F.expr(twice)) / 2).alias("area"))


def overlap_order(spark, sf):
    """Cells with a square hole, and over them the same cells a few pixels on: a later feature lies over earlier ones."""
    r = rings(spark, sf).distinct()
    mean = lambda k: F.expr(f"cast(floor(aggregate(filter(ring, (v, i) -> i % 2 = {k}), 0D, (s, v) -> s + v) / (size(ring) div 2)) as int)")
    hole = F.array(*[c + d for c, d in ((F.col("cx"), -2), (F.col("cy"), -2), (F.col("cx"), 2), (F.col("cy"), -2), (F.col("cx"), 2), (F.col("cy"), 2), (F.col("cx"), -2), (F.col("cy"), 2))])
    first = r.withColumns({"cx": mean(0), "cy": mean(1)}).select("sample_id", "label", F.col("label").alias("ordinal"), F.array("ring", hole).alias("rings"))
    moved = F.transform("ring", lambda v, i: v + F.when(i % 2 == 0, 6).otherwise(4))
    second = r.select("sample_id", (F.col("label") + 100_000).alias("label"), (F.col("label") + 1_000_000).alias("ordinal"), F.array(moved).alias("rings"))
    return raster.runs_to_pixels(masks.rasterized(first.unionByName(second)))


def _extent(spark, sf):
    """Height and width that hold all points of any sample."""
    r = table(spark, sf, "cell_masks").select(F.explode("vertices").alias("v")).agg(F.max("v")).first()[0]
    return (r + 1, r + 1)


def _tiled(spark, sf):
    t = table(spark, sf, "transcript_table").select("row_id", "sample_id", "x_pixel_coordinate", "y_pixel_coordinate", "gene_name", "cell_id")
    return viewer.assign_tiles(t)


def tile_assign(spark, sf):
    return _tiled(spark, sf).select("row_id", "tile_x", "tile_y", "position")


def _levels(spark, sf):
    return viewer.pyramid_levels(_extent(spark, sf), viewer.tile_side(None))


def tile_counts(spark, sf):
    n = _levels(spark, sf)
    return viewer.on_levels(_tiled(spark, sf), n).groupBy("sample_id", "level", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("n"))


def _sampled(spark, sf):
    n = _levels(spark, sf)
    return viewer.sample_levels(viewer.on_levels(_tiled(spark, sf), n), n, "row_id", ["sample_id"])


def tile_sample(spark, sf):
    return _sampled(spark, sf).select("row_id", "level", "tile_x", "tile_y")


def tile_documents(spark, sf):
    return viewer.tile_documents(_sampled(spark, sf), ["sample_id"])


def tile_contents(spark, sf):
    """What the tiles hold: the number of points, and genes and cells in order."""
    d = viewer.tile_documents(_sampled(spark, sf), ["sample_id"])
    names = lambda f: F.array_sort(F.transform("pointsData", lambda p: F.coalesce(p[f], F.lit("")))).alias(f"{f}s")
    return d.select("sample_id", "level", "tile_x", "tile_y", F.size("pointsData").alias("n"), names("geneName"), names("cellId"))


def pyramid_config(spark, sf):
    shape = _extent(spark, sf)
    c = viewer.pyramid_config(shape, viewer.tile_side(None))
    tx, ty = viewer.tile_counts_of(shape, viewer.tile_side(None))
    return spark.createDataFrame([(c["layer_height"], c["layer_width"], c["layers"], c["tile_size"], tx, ty)], "layer_height int, layer_width int, layers int, tile_size int, tiles_x int, tiles_y int")


def gene_colors(spark, sf):
    return viewer.gene_colors(_genes(spark, sf))


def schema_classify(spark, sf):
    t = lambda n: table(spark, sf, n)
    rows = [
        ("raw_features", evolution.classify_features(t("raw_features").columns)),
        ("upgraded_features", evolution.classify_features(evolution.features_in_order(features(spark, sf)).columns)),
        ("transcript_panel", evolution.classify_panel(t("transcript_panel"))),
        ("probe_names", evolution.classify_panel(t("transcript_panel").select("probe_name"))),
        ("cell_metadata", evolution.classify_cells(t("cell_metadata").columns)),
        ("cell_masks", evolution.classify_cells(t("cell_masks").columns)),
    ]
    return spark.createDataFrame(rows, "name string, verdict string")


def panel_name_validity(spark, sf):
    return panel(spark, sf).select("probe_name", is_probe_name(F.col("probe_name")).alias("valid"))


def legacy_rename(spark, sf):
    return told(features(spark, sf), "confidence_score")


def legacy_cell_upgrade(spark, sf):
    m = table(spark, sf, "cell_metadata")
    old = m.select("cell_id", "loaded_at", "cell_x", "cell_y", F.col("cell_x").alias("expanded_cell_x"), F.col("cell_y").alias("expanded_cell_y"), F.col("nuclei_area_um").alias("nuclei_area"), F.col("nuclei_expanded_area_um").alias("nuclei_expanded_area"), "nuclearstain_intensity_mean")
    return told(evolution.upgrade_cells(old), "nuclei_area_um")


def rebuild_panel(spark, sf):
    return evolution.rebuild_panel(features(spark, sf), panel(spark, sf).select("target_condensed", "panel_type"))


def null_counts(spark, sf):
    """Nulls of each manifest column."""
    m = manifest_parse_user_read(spark, sf)
    return m.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in m.columns]).unpivot([], m.columns, "column", "nulls")


def transcripts_probe_types(spark, sf):
    t = table(spark, sf, "transcript_table")
    return t.groupBy(probe_type(F.col("gene_name")).alias("probe_type")).agg(F.count(F.lit(1)).alias("n"))


_ALL = (
    redemux_cell_counts, scan_project_features, manifest_parse, manifest_parse_user_read, probe_type_counts, null_counts, panel_name_validity, hamming_pairs,
    demux_assign, demux_pigeonhole, demux_undetermined, assign_cells, assign_nucleus, cell_by_gene_long, cell_by_gene_wide, zero_completed, missing_genes,
    region_props, region_props_nuclear, cell_by_protein_long, cell_by_protein_wide, region_mean_bead_masked, embedding_region_mean, cell_metadata,
    cell_key_differences, qc_obs, qc_var, gene_probe_types, targeting_only, transcripts_probe_types, obs_with_clustering, umap_vector, canonical_metadata,
    update_cells, unmatched_cells, row_index, id_tokens, cluster_palette, palette_from_colors, sparse_gene_rows, rasterize_polygons, border_pixels, outline_pixels, vectorize_mask,
    cell_polygons, cell_documents, document_facts, bounding_boxes, contour_areas, overlap_order, tile_assign, tile_counts, tile_sample, tile_documents, tile_contents, pyramid_config, gene_colors, schema_classify, legacy_rename,
    legacy_cell_upgrade, rebuild_panel,
)
QUERIES = {f.__name__: f for f in _ALL}
