"""Older sample folders brought to today's layout, with a backup and a way back."""

from __future__ import annotations

import json
import logging
import re
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from spotloom import sinks
from spotloom.operators import evolution
from spotloom.sources import directory, documents, tables


class MigrationError(Exception):
    pass


#: Older place, today's place (None: the same), and whether a copy is kept; {v} is the viewer's folder.
MOVES = [
    ("{v}/{id}.bin", "{v}/{id}_segmentation.bin", True),
    ("{v}/{id}.tar", "{v}/{id}_transcripts.tar", True),
    ("{v}/{id}.ome.tiff", "{v}/{id}_multiplex.ome.tiff", False),
    ("diagnostics/transcript_table.parquet", "rna/raw_features.parquet", True),
    ("rna/transcript_table.parquet", "rna/raw_features.parquet", True),
    ("rna/transcript_table.csv.gz", None, True),
    ("transcript_panel.csv", None, True),
    ("single_cell_data/feature_matrix", None, True),
    ("single_cell_data/cell_metadata.csv.gz", None, True),
    ("{v}/{id}_run_metadata.json", None, True),
]
BACKUP = "migration_backup"
#: In the backup: the files that were not there before, so that they go when the rest comes back.
ABSENT = "absent.json"


@dataclass(frozen=True)
class Move:
    root: Path
    source: Path
    target: Path
    keep: bool

    @property
    def backup(self) -> Path:
        return self.root / BACKUP / self.source.relative_to(self.root)

    @property
    def renames(self) -> bool:
        return self.source != self.target

    def save(self) -> None:
        if self.keep and self.source.exists() and not self.backup.exists():
            self.backup.parent.mkdir(parents=True, exist_ok=True)
            (shutil.copytree if self.source.is_dir() else shutil.copy2)(self.source, self.backup)

    def apply(self) -> None:
        if self.renames and self.source.exists():
            self.target.parent.mkdir(parents=True, exist_ok=True)
            self.source.rename(self.target)

    def undo(self) -> None:
        if self.keep and self.backup.exists():
            sinks.delete_existing(self.target)
            self.source.parent.mkdir(parents=True, exist_ok=True)
            self.backup.rename(self.source)
        elif not self.keep and self.renames and self.target.exists() and not self.source.exists():
            self.target.rename(self.source)


def moves(root: Path, sample_id: str) -> list[Move]:
    v = directory.viewer_folder(root).name
    at = lambda s: root / s.format(v=v, id=sample_id)
    return [Move(root, at(a), at(b or a), keep) for a, b, keep in MOVES]


def restore(root: str | Path, sample_id: str, log: logging.Logger) -> bool:
    """Everything back from the backup, which then goes; False if there is none."""
    root = Path(root)
    if not (root / BACKUP).exists():
        log.info("no backup found, nothing to restore")
        return False
    for m in reversed(moves(root, sample_id)):
        m.undo()
    for name in json.loads((root / BACKUP / ABSENT).read_text()) if (root / BACKUP / ABSENT).exists() else []:
        sinks.delete_existing(root / name)
    shutil.rmtree(root / BACKUP)
    return True


def repair_json(path: str | Path) -> bool:
    """Bare NaN in a JSON file becomes text; True if there was any. A missing file has none."""
    path = Path(path)
    if not path.exists():
        return False
    text = path.read_text()
    strings = r'"(?:\\.|[^"\\])*"'
    fixed = re.sub(rf"({strings})|\bNaN\b", lambda m: m[1] or '"NaN"', text)
    if fixed == text:
        return False
    path.write_text(json.dumps(json.loads(fixed), indent=2))
    return True


def file_verdicts(spark: SparkSession, root: str | Path) -> dict[str, str]:
    """valid, invalid or unknown for the feature table, the panel, the cells and the cell file; missing for a missing one."""
    root = Path(root)
    out = {}
    features, panel, obs = root / "rna" / "raw_features.parquet", root / "transcript_panel.csv", root / "single_cell_data" / "feature_matrix" / "obs.parquet"
    out["raw_features"] = evolution.classify_features(tables.load_table(spark, str(features)).columns) if features.exists() else "missing"
    out["transcript_panel"] = evolution.classify_panel(tables.load_table(spark, str(panel))) if panel.exists() else "missing"
    out["feature_matrix"] = evolution.classify_cells(tables.load_table(spark, str(obs)).columns) if obs.exists() else "missing"
    files = sorted(directory.viewer_folder(root).glob("*.bin"))
    out["cell_file"] = "unknown" if len(files) != 1 else "invalid" if documents.decode_cells(files[0].read_bytes()) is None else "valid"
    return out


def _bad(verdicts: dict[str, str]) -> bool:
    return any(v != "valid" for v in verdicts.values())


def migrate(spark: SparkSession, root: str | Path, sample_id: str, log: logging.Logger, rebuild_viewer: Callable[[], None] | None = None) -> bool:
    """True if something was changed. Files move first, then their contents are brought up to date; if the result does
    not hold, everything is put back and ``MigrationError`` raised. An earlier backup is never overwritten."""
    root = Path(root)
    if directory.check_layout(root, sample_id).ok and not _bad(file_verdicts(spark, root)):
        log.info("nothing to migrate")
        return False
    todo = moves(root, sample_id)
    if any(m.backup.exists() for m in todo):
        raise MigrationError("there is a backup of an earlier migration: restore or remove it first")
    log.info("backing up %.3f GB", directory.total_size_gb([m.source for m in todo if m.keep]))
    (root / BACKUP).mkdir(exist_ok=True)
    new = {str(m.target.relative_to(root)) for m in todo if not m.target.exists()} - {str(m.target.relative_to(root)) for m in todo if m.renames and m.source.exists()}
    (root / BACKUP / ABSENT).write_text(json.dumps(sorted(new)))
    try:
        for m in todo:
            m.save()
            m.apply()
        directory.require_layout(root, sample_id)
        repair_json(directory.viewer_folder(root) / f"{sample_id}_run_metadata.json")
        v = file_verdicts(spark, root)
        log.info("verdicts: %s", v)
        features = root / "rna" / "raw_features.parquet"
        if v["raw_features"] == "invalid":
            fresh = evolution.upgrade_features(tables.load_table(spark, str(features)))
            if v["transcript_panel"] == "invalid":
                old = tables.load_table(spark, str(root / "transcript_panel.csv"))
                evolution.rebuild_panel(fresh, old).toPandas().to_csv(root / "transcript_panel.csv", index=False)  # a panel
            sinks.write_parquet(evolution.features_in_order(fresh), features)
        if v["feature_matrix"] == "invalid":
            obs = root / "single_cell_data" / "feature_matrix" / "obs.parquet"
            up = evolution.upgrade_cells(tables.load_table(spark, str(obs)))
            sinks.write_parquet(up, obs)
            sinks.write_csv_gz(tables.load_table(spark, str(obs)).withColumnRenamed("cell_id", "label"), root / "single_cell_data" / "cell_metadata.csv.gz")
        if v["cell_file"] == "invalid" and rebuild_viewer is not None:
            rebuild_viewer()
        after = file_verdicts(spark, root)
        if any(after[k] == "invalid" for k in after) or after["raw_features"] != "valid":
            raise MigrationError(f"the files do not come out valid: {after}")
    except Exception as e:
        restore(root, sample_id, log)
        raise e if isinstance(e, MigrationError) else MigrationError(f"the folder was put back as it was: {e}") from e
    return True
