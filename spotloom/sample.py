"""One sample's folder as typed, lazy tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom import schemas
from spotloom.operators import manifest as manifests
from spotloom.operators.viewer import tile_side
from spotloom.sources import directory, masks, matrix, tables

#: Keys of the run's metadata that are read, and the stains' names in tables.
META = ("platform", "machine", "run_id", "fc", "lane", "software", "software_version", "transcript_panel", "protein_panel")
STAINS = {"nuclear": "nuclearstain", "eosin": "cytoplasmicstain"}


@dataclass(frozen=True)
class SpatialSample:
    """Paths and small metadata of a sample; everything large is read as a DataFrame when asked for."""

    spark: SparkSession
    data_dir: Path
    given_id: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "data_dir", Path(self.data_dir))

    @cached_property
    def sample_id(self) -> str:
        return self.given_id or directory.infer_sample_id(self.data_dir)

    @cached_property
    def run_meta(self) -> dict:
        return json.loads((self.data_dir / "run_meta.json").read_text())

    def meta(self, name: str):
        if name not in META:
            raise KeyError(name)
        return self.run_meta.get(name)

    @cached_property
    def shape(self) -> tuple[int, int]:
        """(height, width) of the nuclear image, from its header."""
        found = sorted((self.data_dir / "h_and_e").glob("nuclear.*"))
        if not found:
            raise FileNotFoundError("no nuclear image")
        return tuple(int(v) for v in masks.image_shape(found[0]))

    @property
    def includes_transcript(self) -> bool:
        return bool(self.meta("transcript_panel"))

    @property
    def includes_protein(self) -> bool:
        return bool(self.meta("protein_panel"))

    @property
    def transcript_table_path(self) -> Path:
        return self.data_dir / "rna" / "transcript_table.csv.gz"

    @property
    def feature_table_path(self) -> Path:
        return self.data_dir / "rna" / "raw_features.parquet"

    @property
    def segmentation_path(self) -> Path:
        return self.data_dir / "segmentation" / "segmentation_mask.npz"

    @property
    def matrix_path(self) -> Path:
        return self.data_dir / "single_cell_data" / "feature_matrix"

    @property
    def bead_mask_path(self) -> Path:
        return self.data_dir / "protein" / "bead_mask.npz"

    @property
    def viewer_dir(self) -> Path:
        return directory.viewer_folder(self.data_dir)

    @property
    def tile_side(self) -> int:
        return tile_side(self.meta("platform"))

    @property
    def uses_cytoplasmic(self) -> bool:
        return any((self.data_dir / "h_and_e").glob("cytoplasmic.*"))

    def manifest(self, path: str | Path | None = None) -> DataFrame:
        return manifests.parse_manifest(tables.load_table(self.spark, str(path or self.data_dir / "transcript_panel.csv")))

    @cached_property
    def transcript_panel(self) -> dict[str, str | None]:
        """Panel type by gene, in gene order; empty if there is no readable panel. Of several types the least."""
        try:
            rows = self.manifest().where("gene_name is not null").groupBy("gene_name").agg(F.min("panel_type").alias("t")).orderBy("gene_name").collect()
        except Exception:  # an unreadable panel is an empty one
            return {}
        return {r["gene_name"]: r["t"] for r in rows}

    @property
    def genes(self) -> list[str]:
        return list(self.transcript_panel)

    @cached_property
    def protein_panel(self) -> dict[str, str | None]:
        if not self.includes_protein:
            return {}
        rows = tables.load_table(self.spark, str(self.data_dir / "protein_panel.csv"), schema=schemas.PROTEIN_PANEL).orderBy("target").collect()
        return {r["target"]: r["panel_type"] for r in rows}

    @property
    def proteins(self) -> list[str]:
        return list(self.protein_panel)

    def load_transcript_table(self, columns: list[str] | None = None, path: str | Path | None = None) -> DataFrame:
        t = tables.load_table(self.spark, str(path or self.transcript_table_path))
        for f in schemas.TRANSCRIPTS.fields:
            if f.name in t.columns:
                t = t.withColumn(f.name, F.col(f.name).try_cast(f.dataType))
        return t.select(*columns) if columns else t

    def load_feature_table(self, columns: list[str] | None = None, path: str | Path | None = None) -> DataFrame:
        return tables.load_table(self.spark, str(path or self.feature_table_path), columns)

    def load_segmentation(self, expanded: bool = True, key: str | None = None) -> np.ndarray:
        return masks.default_segmentation(self.segmentation_path, expanded, key)

    @property
    def protein_table_path(self) -> Path:
        return self.data_dir / "single_cell_data" / "cell_by_protein.csv.gz"

    def load_protein_table(self) -> DataFrame:
        """(cell_id, <channel>_intensity_mean...) as the sample has it."""
        t = tables.load_table(self.spark, str(self.protein_table_path))
        return t.select(F.col(t.columns[0]).alias("cell_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in t.columns[1:]])

    def load_bead_runs(self) -> DataFrame:
        return masks.bead_runs(self.spark, self.bead_mask_path, self.sample_id)

    def image_path(self, kind: str, thumbnail: bool = False, protein: str | None = None) -> Path:
        """The file of an image: ``protein`` (by name), ``h_and_e``, ``nuclear`` or ``eosin``."""
        if kind == "protein":
            if not self.includes_protein:
                raise ValueError("the sample has no proteins")
            if protein not in self.proteins:
                raise ValueError(f"{protein!r} is not in the panel")
            folder, name = "protein", protein
        elif kind in ("h_and_e", "nuclear", "eosin"):
            folder, name = "h_and_e", "cytoplasmic" if kind == "eosin" and self.uses_cytoplasmic else kind
        else:
            raise ValueError(f"unknown kind of image {kind!r}")
        pattern = f"{name}_thumbnail.*" if thumbnail else f"{name}.*"
        found = sorted((self.data_dir / folder).glob(pattern), key=lambda p: (p.suffix not in masks.DECODERS, p.name))
        if not found:
            raise FileNotFoundError(f"{folder}/{pattern}")
        return found[0]

    def load_image(self, kind: str, thumbnail: bool = False, protein: str | None = None) -> np.ndarray:
        """The decoded image; one that was loaded lately, and whose file has not changed, is not decoded again."""
        path = self.image_path(kind, thumbnail, protein)
        return masks.remembered_image(path, path.stat().st_mtime_ns)

    def intensity_rows(self, channels: list[str]) -> DataFrame:
        """(sample_id, channel, y, x0, intensities) of stains and proteins, named as in the tables."""
        out = None
        for c in channels:
            path = self.image_path(c) if c in STAINS else self.image_path("protein", protein=c)
            img = masks.image_rows(self.spark, str(path.parent), self.sample_id, path.name).withColumn("channel", F.lit(STAINS.get(c, c)))
            out = img if out is None else out.unionByName(img)
        return out

    def load_matrix(self, remove_nontargeting: bool = True, load_clustering: bool = True, folder: str | Path | None = None) -> matrix.AnnotatedMatrix:
        clustering = None
        at = Path(folder) if folder else self.matrix_path
        file = at.parent / "clustering_umap.csv.gz"
        if load_clustering and file.exists():
            clustering = tables.load_indexed_csv(self.spark, str(file))
        return matrix.read_matrix(self.spark, at, remove_nontargeting, clustering)

    def list_content(self, subdir: str | None = None) -> dict[str, list[str]]:
        return directory.list_content(self.data_dir, subdir)

    def validate(self, details: bool = False) -> directory.Report:
        return directory.require_layout(self.data_dir, self.sample_id, details)

    def __repr__(self) -> str:
        h, w = (s * schemas.PIXEL_UM / 1000 for s in self.shape)
        lines = [f"sample @ {self.data_dir}", f"{'Sample ID':<18}{self.sample_id} of {self.meta('run_id')}, {self.meta('fc')}", f"{'imaged area':<18}({w:.2f} x {h:.2f}) mm", f"{'software version':<18}{self.meta('software_version')}"]
        for title, items, there in (("Transcript panel", self.genes, self.includes_transcript), ("Protein panel", self.proteins, self.includes_protein)):
            if there:
                lines.append(f"{title:<18}{len(items)} [{', '.join(items[:5])} ... ]")
        return "\n".join(lines)
