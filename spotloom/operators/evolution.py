"""Recognising and upgrading older table layouts.

An upgrade renames, reorders and scales, but never judges values: a measurement that is NaN was taken and is no number, one
that is null was not taken, and both come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.probes import is_probe_name
from spotloom.schemas import FEATURE_COLUMNS, LEGACY_FEATURES, MIGRATED_COLUMNS, NOT_CONVERTED, PIXEL_AREA_UM2, UNDETERMINED

#: Column sets by which layouts are told apart.
EARLY_DEMUXED = {"cell_id", "gene_name", "probe_name", "demuxed"}
LEGACY_MARKS = {"x_coord_shift", "y_coord_shift", "z", "transcript", "transcript_condensed"}
CELL_FIRST = ["cell_id", "cell_x", "cell_y", "nuclei_area_um", "nuclei_expanded_area_um"]
STAINS_FIRST = ["nuclearstain_intensity_mean", "cytoplasmicstain_intensity_mean"]


def classify_features(columns: list[str]) -> str:
    """valid, invalid (an older layout, see ``upgrade_features``) or unknown, by the set of columns."""
    have = set(columns)
    if have == set(FEATURE_COLUMNS):
        return "valid"
    return "invalid" if EARLY_DEMUXED <= have or LEGACY_MARKS <= have else "unknown"


def upgrade_features(features: DataFrame) -> DataFrame:
    """Older column names replaced, x and y exchanged as the names' meaning was; other columns stay."""
    if EARLY_DEMUXED <= set(features.columns) or not LEGACY_MARKS <= set(features.columns):
        return features
    return features.withColumnsRenamed(LEGACY_FEATURES)


def features_in_order(features: DataFrame) -> DataFrame:
    """The columns of a migrated raw feature table in their order."""
    return features.select(*MIGRATED_COLUMNS)


def classify_panel(panel: DataFrame) -> str:
    """invalid if ``target_condensed`` is there, valid if all probe names are well formed (NOT_CONVERTED aside; a null
    name is not), else unknown. An empty panel with ``probe_name`` is valid."""
    if "target_condensed" in panel.columns:
        return "invalid"
    if "probe_name" not in panel.columns:
        return "unknown"
    name = F.col("probe_name")
    ok = panel.where(name.isNull() | (name != NOT_CONVERTED)).agg(F.coalesce(F.bool_and(F.coalesce(is_probe_name(name), F.lit(False))), F.lit(True))).first()[0]
    return "valid" if ok else "unknown"


def classify_cells(columns: list[str]) -> str:
    """valid, invalid (older, see ``upgrade_cells``) or unknown. A single ``area_um``, as a new segmentation has, is valid."""
    have = set(columns)
    expanded, centroid = {"expanded_cell_x", "expanded_cell_y"} <= have, {"centroid-0", "centroid-1"} <= have
    areas = {"nuclei_area_um", "nuclei_expanded_area_um"} <= have or "area_um" in have
    if not expanded and not centroid and areas:
        return "valid"
    return "invalid" if centroid or (expanded and not areas) else "unknown"


def cell_column_order(columns: list[str]) -> list[str]:
    """Identity and areas, then stains and proteins, then the rest."""
    stains = [c for c in STAINS_FIRST if c in columns] + [c for c in columns if "_intensity_mean" in c and c not in STAINS_FIRST]
    first = [c for c in CELL_FIRST if c in columns]
    return first + stains + [c for c in columns if c not in first and c not in stains]


def upgrade_cells(cells: DataFrame) -> DataFrame:
    """An older cell table in today's form: x and y exchanged and pixel areas in square micrometres where it has
    expanded centroids, centroid columns dropped, columns in order. A table that is valid or unknown stays as it is."""
    if classify_cells(cells.columns) != "invalid":
        return cells
    have = set(cells.columns)
    if {"expanded_cell_x", "expanded_cell_y"} <= have and "nuclei_area_um" not in have:
        cells = cells.withColumns({"cell_x": F.col("cell_y"), "cell_y": F.col("cell_x")}).drop("expanded_cell_x", "expanded_cell_y")
        for c in ("nuclei_area", "nuclei_expanded_area"):
            cells = cells.withColumn(c, F.col(c) * PIXEL_AREA_UM2).withColumnRenamed(c, f"{c}_um")
    else:
        cells = cells.drop("centroid-0", "centroid-1")
    return cells.select(*[F.col(f"`{c}`") for c in cell_column_order(cells.columns)])


def rebuild_panel(transcripts: DataFrame, panel: DataFrame) -> DataFrame:
    """(probe_name, gene_name, panel_type, ...): an older panel's targets with the probes that transcripts show of them.

    Every row of the panel is kept; a target without a probe, and any other missing text, becomes NOT_CONVERTED. Sorted
    by panel_type and gene_name, then probe.
    """
    seen = transcripts.where(F.col("probe_name") != UNDETERMINED).groupBy("probe_name").agg(F.min("gene_name").alias("_gene"))
    old = panel.drop("probe_name", "gene_name")
    out = old.join(seen, F.col("_gene") == F.col("target_condensed"), "left").drop("_gene").withColumnRenamed("target_condensed", "gene_name")
    text = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
    return out.na.fill(NOT_CONVERTED, text).orderBy("panel_type", "gene_name", "probe_name")
