"""The pipelines over a sample's folder. Each writes below ``out_dir``, or in place if that is the sample's own folder."""

from __future__ import annotations

import contextlib
import functools
import io
import logging
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom import migration, sinks
from spotloom.functions.probes import read_of_id
from spotloom.operators import cells, demux, polygons, raster, viewer
from spotloom.operators import manifest as manifests
from spotloom.sample import STAINS, SpatialSample
from spotloom.schemas import DEFAULT_COLOR
from spotloom.session import durable, ship_package
from spotloom.sources import directory, documents, masks, matrix, tables

LEVELS = (logging.WARNING, logging.INFO, logging.DEBUG)


def setup_logger(name: str, folder: Path | None, verbose: int = 1) -> logging.Logger:
    log = logging.getLogger(f"spotloom.{name}")
    log.setLevel(logging.DEBUG)
    log.handlers.clear()
    log.propagate = False
    shape = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    out: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    out[0].setLevel(LEVELS[max(0, min(2, verbose))])
    if folder is not None:
        folder.mkdir(parents=True, exist_ok=True)
        out.append(logging.FileHandler(folder / f"{name}.log"))
        out[1].setLevel(logging.DEBUG)
    for h in out:
        h.setFormatter(shape)
        log.addHandler(h)
    return log


class _ToLog(io.TextIOBase):
    """What is printed while a pipeline runs, line by line, in its log."""

    def __init__(self, log: logging.Logger):
        self.log, self.rest = log, ""

    def write(self, text: str) -> int:
        *lines, self.rest = (self.rest + text).split("\n")
        for line in filter(str.strip, lines):
            self.log.debug("%s", line)
        return len(text)


def command(f):
    """Checks the folder, makes the output folder and the log, and names the pipeline in any error."""

    @functools.wraps(f)
    def run(sample: SpatialSample, out_dir: str | Path | None = None, verbose: int = 1, file_logger: bool = True, logger: logging.Logger | None = None, **options):
        if f.__name__ not in ("migrate", "validate"):
            sample.validate()
        ship_package(sample.spark)
        out = sample.data_dir if out_dir is None else directory.check_path(out_dir, must_exist=False, file_ok=False)
        if out.resolve() != sample.data_dir.resolve():
            out = out / f.__name__
            out.mkdir(parents=True, exist_ok=True)
        log = logger or setup_logger(f.__name__, sample.data_dir / "logs" if file_logger else None, verbose)
        log.info("starting %s of %s into %s", f.__name__, sample.sample_id, out)
        try:
            with contextlib.redirect_stdout(_ToLog(log)):
                result = f(sample, out, log, **options)
        except (directory.ValidationError, migration.MigrationError):
            raise
        except Exception as e:
            log.error("%s failed: %s", f.__name__, e)
            raise RuntimeError(f"{f.__name__} failed: {e}") from e
        log.info("completed %s", f.__name__)
        return result

    return run


def _viewer_out(sample: SpatialSample, out: Path) -> Path:
    to = out / sample.viewer_dir.name
    to.mkdir(parents=True, exist_ok=True)
    return to


def _intensities(sample: SpatialSample, runs: DataFrame, log: logging.Logger, same_cells: bool, without: list[str]) -> DataFrame | None:
    """(cell_id, <channel>_intensity_mean...) of all channels but those left out by name; None if there are none.

    A channel whose image has no decoder is taken from the sample's own table if the cells are the same; if they are not,
    or the table lacks it, that is an error, never a result without the channel.
    """
    opened, closed = [], []
    for c in [*STAINS, *sample.proteins]:
        if c in without:
            continue
        try:
            path = sample.image_path(c) if c in STAINS else sample.image_path("protein", protein=c)
        except FileNotFoundError:
            if c in STAINS:
                continue  # not every sample has both
            raise
        (opened if path.suffix in masks.DECODERS else closed).append(c)
    name = lambda c: f"{STAINS.get(c, c)}_intensity_mean"
    out = None
    if opened:
        log.info("mean intensities of %s", opened)
        beads = sample.load_bead_runs() if sample.bead_mask_path.exists() else None
        means = raster.region_means(sample.intensity_rows(opened), runs, beads)
        out = cells.wide_means(means, [STAINS.get(c, c) for c in opened]).withColumn("cell_id", cells.cell_name(F.col("sample_id"), F.col("label"))).drop("sample_id", "label")
    if closed:
        held = sample.load_protein_table() if same_cells and sample.protein_table_path.exists() else None
        lacking = [c for c in closed if held is None or name(c) not in held.columns]
        if lacking:
            raise ValueError(f"no decoder for the images of {lacking}: register one in spotloom.sources.masks.DECODERS, or leave these channels out by name")
        log.info("%s cannot be decoded here; the cells are the same, so their means are those of %s", closed, sample.protein_table_path.name)
        kept = held.select("cell_id", *[F.col(f"`{name(c)}`") for c in closed])
        out = kept if out is None else out.join(kept, "cell_id", "left")
    return out


def _apply_segmentation(sample: SpatialSample, runs: DataFrame, out: Path, log: logging.Logger, transcripts: DataFrame, panel: DataFrame, same_cells: bool, without: list[str]) -> None:
    """Cell tables of a raster: transcripts by cell, counts, intensities, metadata and the annotated matrix."""
    at = directory.output_tree(out, "single_cell_data", "rna")
    sc = at["single_cell_data"]
    log.info("placing transcripts in cells")
    placed = durable(cells.assign_cells(transcripts.withColumn("sample_id", F.lit(sample.sample_id)), runs))
    index = durable(cells.cell_index(runs))
    counts = durable(cells.cell_by_gene(placed).withColumn("cell_id", cells.cell_name(F.col("sample_id"), F.col("label"))))
    genes = panel.where("gene_name is not null").select("gene_name").distinct()
    names = [r[0] for r in genes.orderBy("gene_name").collect()]  # a panel's genes
    wide = cells.wide_counts(counts.select("sample_id", "label", "gene_name", "counts"), index, names)
    wide = wide.withColumn("cell_id", cells.cell_name(F.col("sample_id"), F.col("label")))
    sinks.write_csv_gz(wide.orderBy("label").select(F.col("cell_id").alias("label"), *[F.col(f"`{n}`") for n in names]), sc / "cell_by_transcript.csv.gz")
    sinks.write_csv_gz(placed.drop("sample_id", "label"), at["rna"] / "transcript_table.csv.gz")

    props = raster.region_properties(runs).withColumn("cell_id", cells.cell_name(F.col("sample_id"), F.col("label"))).withColumnRenamed("label", "segmentation_label").drop("sample_id", "n_pixels")
    meta = props
    protein = _intensities(sample, runs, log, same_cells, without)
    if protein is not None:
        protein = durable(protein)
        sinks.write_csv_gz(protein.withColumnRenamed("cell_id", "label"), sc / "cell_by_protein.csv.gz")
        meta = cells.cell_metadata(props, protein, "cell_id")
    m = matrix.assemble(counts.select("cell_id", "gene_name", "counts"), durable(meta), genes, panel)
    matrix.write_matrix(m, sc / "feature_matrix")
    sinks.write_csv_gz(m.obs.withColumnRenamed("cell_id", "label"), sc / "cell_metadata.csv.gz")


def _cell_file(sample: SpatialSample, runs: DataFrame, matrix_dir: Path, out: Path, log: logging.Logger) -> Path:
    log.info("drawing outlines and writing cell documents")
    m = matrix.read_matrix(sample.spark, matrix_dir, remove_nontargeting=False)
    area = viewer.area_column([c for c in m.obs.columns if c != "segmentation_label"])
    obs = cells.cell_index(runs).select("cell_id").join(m.obs, "cell_id", "left").withColumnRenamed(area, "area")
    drawn = polygons.smooth_outlines(raster.outline_pixels(runs, sample.shape))
    rings = drawn.select(cells.cell_name(F.col("sample_id"), F.col("label")).alias("cell_id"), "ring")
    sparse = cells.sparse_genes(m.X.withColumnRenamed("gene_id", "gene_name"), "cell_id")
    names = [r[0] for r in m.X.select("gene_id").distinct().orderBy("gene_id").collect()]  # a panel's genes
    proteins = [p for p in sample.proteins if f"{p}_intensity_mean" in m.obs.columns]
    docs = viewer.cell_documents(obs, rings, sparse, proteins)
    path = _viewer_out(sample, out) / f"{sample.sample_id}_segmentation.bin"
    grey = [int(DEFAULT_COLOR[i : i + 2], 16) for i in (1, 3, 5)]
    sinks.write_cell_file(docs, path, [("unassigned", grey)], names, proteins)
    return path


def _tile_archive(sample: SpatialSample, transcripts: DataFrame, out: Path, log: logging.Logger, by_probe: bool = False) -> Path:
    log.info("writing the tile pyramid")
    name = "probe_name" if by_probe else "gene_name"
    t = durable(transcripts.select("x_pixel_coordinate", "y_pixel_coordinate", "cell_id", F.col(name).alias("gene_name"), "TXUID"))
    levels = viewer.pyramid_levels(sample.shape, sample.tile_side)
    tiles = viewer.tile_documents(viewer.sample_levels(viewer.on_levels(viewer.assign_tiles(t, sample.tile_side), levels), levels, "TXUID", []), [])
    colors = [(r[0], list(r[1])) for r in viewer.gene_colors(t).orderBy("gene_name").collect()]  # a panel's genes
    path = _viewer_out(sample, out) / f"{sample.sample_id}_transcripts.tar"
    sinks.write_tile_archive(tiles, path, sample.shape, sample.tile_side, colors)
    return path


@command
def redemux(sample: SpatialSample, out: Path, log: logging.Logger, manifest: str | Path, without: list[str] = ()) -> None:
    """All reads assigned anew to the probes of a manifest, and everything that follows from them rebuilt; ``without``:
    channels left out of the tables."""
    manifest = directory.check_path(manifest, dir_ok=False)
    viewer_meta = sample.viewer_dir / f"{sample.sample_id}_run_metadata.json"
    sinks.stamp_metadata(sample.data_dir / "run_meta.json", viewer_meta, manifest, out, out / sample.viewer_dir.name)
    panel = durable(sample.manifest(manifest))
    codes = manifests.codebook(panel)
    reads = sample.load_feature_table().withColumn("read", read_of_id(F.col("TXUID")))
    order = ["TXUID", "confidence_score", "y_pixel_coordinate", "x_pixel_coordinate", "z_level", "probe_name", "gene_name"]
    log.info("assigning reads")
    found = durable(demux.demultiplex(reads, codes).select(*order))
    runs = durable(masks.mask_runs(sample.spark, sample.load_segmentation(), sample.sample_id))
    _apply_segmentation(sample, runs, out, log, found, panel, True, list(without or ()))
    _cell_file(sample, runs, out / "single_cell_data" / "feature_matrix", out, log)
    _tile_archive(sample, sample.load_transcript_table(path=out / "rna" / "transcript_table.csv.gz"), out, log)


@command
def resegment(sample: SpatialSample, out: Path, log: logging.Logger, cell_labels: str | Path, labels_key: str | None = None, without: list[str] = ()) -> None:
    """Transcripts and intensities assigned to a new raster (.npy, .npz or .geojson), and the cell tables rebuilt;
    ``without``: channels left out of the tables."""
    path = directory.check_path(cell_labels, dir_ok=False)
    if path.suffix == ".geojson":
        runs = masks.rasterized(masks.geojson_polygons(sample.spark, str(path), sample.sample_id, labels_key))
        h, w = sample.shape
        runs = durable(runs.where(F.col("y") < h).withColumn("x1", F.least("x1", F.lit(w))).where("x0 < x1"))
        mask = masks.runs_to_mask(runs, sample.shape)
    else:
        mask = masks.load_mask(path, sample.shape, labels_key)
        runs = durable(masks.mask_runs(sample.spark, mask, sample.sample_id))
    transcripts = sample.load_transcript_table().drop("cell_id", "in_nucleus")
    same = bool(np.array_equal(np.asarray(mask), sample.load_segmentation()))
    _apply_segmentation(sample, runs, out, log, transcripts, durable(sample.manifest()), same, list(without or ()))
    directory.output_tree(out, "segmentation")
    sinks.write_mask(np.asarray(mask), out / "segmentation" / "segmentation_mask.npz")
    _cell_file(sample, runs, out / "single_cell_data" / "feature_matrix", out, log)


@command
def new_bin(sample: SpatialSample, out: Path, log: logging.Logger) -> Path:
    """The cell file of the sample's own raster and matrix."""
    runs = durable(masks.mask_runs(sample.spark, sample.load_segmentation(), sample.sample_id))
    return _cell_file(sample, runs, sample.matrix_path, out, log)


@command
def update_bin(sample: SpatialSample, out: Path, log: logging.Logger, metadata: str | Path | None = None, bin_file: str | Path | None = None, cellid_key: str | None = None, cluster_key: str | None = None, cluster_color_key: str | None = None, emb_key: str | None = None) -> Path | None:
    """Clusters, colours and a two-dimensional embedding of a metadata table, or of the sample's own clustering, put on
    the documents of a cell file."""
    path = Path(bin_file) if bin_file else sample.viewer_dir / f"{sample.sample_id}_segmentation.bin"
    if documents.decode_cells(directory.check_path(path, dir_ok=False).read_bytes()) is None:
        raise ValueError(f"{path} is no cell file")
    if metadata is None:
        m = sample.load_matrix(remove_nontargeting=False).obs
        cellid_key, cluster_key, emb_key, cluster_color_key = "cell_id", viewer.infer_cluster_column(m.columns), viewer.infer_embedding(m.columns), None
    else:
        if cluster_key is None and emb_key is None:
            log.info("neither clusters nor an embedding are named: nothing to update")
            return None
        m = tables.load_table(sample.spark, str(directory.check_path(metadata, dir_ok=False)))
        if cellid_key is None:
            cellid_key = next((c for c in ("label", "cell_id") if c in m.columns), None)
            if cellid_key is None:
                raise KeyError("no cell id column is named, and there is neither 'label' nor 'cell_id'")
    to = _viewer_out(sample, out) / f"{sample.sample_id}_segmentation.bin"
    return _put_metadata(sample, path, to, m, log, cellid_key, cluster_key, cluster_color_key, emb_key)


def _put_metadata(sample: SpatialSample, path: Path, to: Path, m: DataFrame, log: logging.Logger, cellid_key: str, cluster_key: str | None, cluster_color_key: str | None, emb_key: str | None) -> Path:
    """A cell file's documents with the clusters and embedding of ``m``, written to ``to``."""
    docs = durable(documents.read_cell_file(sample.spark, path))
    frame = documents.read_frame(path)
    ids = docs.select(F.col("cellId").alias("cell_id"))
    canonical = durable(viewer.canonical_metadata(ids, m, cellid_key, cluster_key, cluster_color_key, emb_key))
    missing = viewer.unmatched_cells(ids, m, cellid_key).count()
    if missing:
        log.warning("%d cells are not in the metadata and get defaults", missing)
    new = viewer.update_cells(docs, canonical, cluster_key is not None, emb_key is not None)
    colormap = frame["colormap"]
    if cluster_key is not None:
        colormap = sinks.palette_entries(viewer.palette_from_colors(canonical) if cluster_color_key else viewer.generated_palette(canonical))
    sinks.write_cell_file(new, to, colormap, frame["genes"], frame["proteins"])
    return to


@command
def tar_viewer(sample: SpatialSample, out: Path, log: logging.Logger) -> Path:
    """The viewer's folder in one archive."""
    to = _viewer_out(sample, out) / f"{sample.sample_id}_viewer.tar"
    if to.exists():
        to.unlink()
    sinks.write_viewer_archive(sample.viewer_dir, to, sample.sample_id)
    return to


@command
def migrate(sample: SpatialSample, out: Path, log: logging.Logger, restore: bool = False) -> bool:
    """The folder brought to today's layout, or, with ``restore``, back to what it was."""
    if restore:
        return migration.restore(sample.data_dir, sample.sample_id, log)

    def rebuild() -> None:
        runs = durable(masks.mask_runs(sample.spark, sample.load_segmentation(), sample.sample_id))
        path = _cell_file(sample, runs, sample.matrix_path, sample.data_dir, log)
        obs = sample.load_matrix(remove_nontargeting=False).obs
        clusters, embedding = viewer.infer_cluster_column(obs.columns), viewer.infer_embedding(obs.columns)
        if clusters or embedding:
            log.info("putting %s and %s on the cell file", clusters, embedding)
            _put_metadata(sample, path, path, obs, log, "cell_id", clusters, None, embedding)
        _tile_archive(sample, sample.load_transcript_table(), sample.data_dir, log)

    return migration.migrate(sample.spark, sample.data_dir, sample.sample_id, log, rebuild)


@command
def validate(sample: SpatialSample, out: Path, log: logging.Logger) -> tuple[directory.Report, dict[str, str]]:
    """What the folder lacks, and a verdict on each table."""
    report = directory.check_layout(sample.data_dir, sample.sample_id)
    log.info("%s", report.text(long=True))
    verdicts = migration.file_verdicts(sample.spark, sample.data_dir)
    for name, v in verdicts.items():
        log.info("%s is %s", name, v)
    return report, verdicts
