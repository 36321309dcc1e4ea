"""Results to files."""

from __future__ import annotations

import io
import json
import os
import shutil
import tarfile
import time
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.operators import viewer
from spotloom.sources import documents


def delete_existing(path: str | Path) -> None:
    p = Path(path)
    if p.is_dir() and not p.is_symlink():
        shutil.rmtree(p)
    elif p.exists() or p.is_symlink():
        p.unlink()


def write_csv_gz(df: DataFrame, path: str | Path, single: bool = True) -> None:
    """Gzipped CSV with a header: one file, as other tools expect it, or a folder of as many as there are partitions."""
    path = Path(path)
    if not single:
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(str(path))
        return
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    df.coalesce(1).write.option("header", True).option("compression", "gzip").csv(str(tmp))
    delete_existing(path)
    os.replace(next(tmp.glob("part-*")), path)
    shutil.rmtree(tmp)


def write_parquet(df: DataFrame, path: str | Path, partition_by: list[str] | None = None) -> None:
    """Written beside the target and then moved there, so the target may be among what is read."""
    path = Path(path)
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(str(tmp))
    delete_existing(path)
    os.replace(tmp, path)


def write_mask(mask: np.ndarray, path: str | Path, name: str = "cell_labels") -> None:
    np.savez_compressed(path, **{name: mask})


def write_cell_file(cells: DataFrame, path: str | Path, colormap: list[tuple[str, list[int]]], genes: list[str] = (), proteins: list[str] = ()) -> None:
    """The cell file: documents are encoded by the executors and appended one partition at a time."""
    path = Path(path)
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(tmp, "wb") as f:
        for row in documents.encoded_cells(cells).toLocalIterator():
            f.write(row["part"])
        f.write(documents.encode_frame(colormap, genes, proteins))
    os.replace(tmp, path)


def _add(tar: tarfile.TarFile, name: str, data: bytes) -> None:
    info = tarfile.TarInfo(name)
    info.size, info.mtime = len(data), int(time.time())
    tar.addfile(info, io.BytesIO(data))


def write_tile_archive(tiles: DataFrame, path: str | Path, shape: tuple[int, int], side: int, colors: list[tuple[str, list[int]]]) -> None:
    """The tile archive: ``config.json`` and ``<level>/<tile_x>/<tile_y>.bin``, empty tiles too. ``tiles``: the documents
    of one sample. Tiles are encoded by the executors and go into the archive one partition at a time."""
    path = Path(path)
    config = viewer.pyramid_config(shape, side, colors)
    root = "transcripts"
    expected = set()
    for level in range(config["layers"] + 1):
        nx, ny = viewer.tile_counts_of(shape, side * 2 ** (config["layers"] - level))
        expected |= {(level, x, y) for x in range(nx) for y in range(ny)}
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with tarfile.open(tmp, "w") as tar:
        _add(tar, f"{root}/config.json", json.dumps(config, indent=2).encode())
        for r in documents.encoded_tiles(tiles).toLocalIterator():
            expected.discard((r["level"], r["tile_x"], r["tile_y"]))
            _add(tar, f"{root}/{r['level']}/{r['tile_x']}/{r['tile_y']}.bin", bytes(r["tile"]))
        for level, x, y in sorted(expected):
            _add(tar, f"{root}/{level}/{x}/{y}.bin", b"")
    os.replace(tmp, path)


def write_viewer_archive(viewer_dir: str | Path, path: str | Path, sample_id: str) -> None:
    """The viewer's folder in one archive, with ``dataset.config.json`` and the stained image in ``h_and_e``. Nothing is
    moved in the folder itself. ``FileNotFoundError`` if a needed file is missing, or there are several cell files."""
    at = Path(viewer_dir)
    cells = sorted(at.glob("*.bin"))
    if len(cells) != 1:
        raise FileNotFoundError(f"{len(cells)} cell files in {at}, not one")
    stain, multiplex, meta = (f"{sample_id}_{x}" for x in ("HE.ome.tiff", "multiplex.ome.tiff", "run_metadata.json"))
    if missing := [n for n in (multiplex, meta, stain) if not (at / n).is_file()]:
        raise FileNotFoundError(f"not in {at}: {', '.join(missing)}")
    config = {
        "protein_image_src": multiplex,
        "protein_image_data_src": meta,
        "he_images_src": "h_and_e",
        "cell_segmentation_src": cells[0].name,
        "transcript_src": f"{sample_id}_transcripts.tar",
    }
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with tarfile.open(tmp, "w") as tar:
        _add(tar, f"{at.name}/dataset.config.json", json.dumps(config).encode())
        for p in sorted(p for p in at.rglob("*") if p.is_file()):
            place = f"h_and_e/{stain}" if p == at / stain else str(p.relative_to(at))
            tar.add(p, f"{at.name}/{place}")
    os.replace(tmp, path)


def stamp_metadata(run_meta: str | Path, viewer_meta: str | Path, manifest: str | Path, out_dir: str | Path, viewer_out: str | Path) -> None:
    """The manifest's name and the time into copies of both metadata files, and a copy of the manifest, in the output."""
    stamp = {"transcript_panel": Path(manifest).name, "redemuxed_timestamp": time.strftime("%Y-%m-%d %H:%M:%S")}
    out = Path(out_dir)
    if Path(manifest).resolve() != (out / "transcript_panel.csv").resolve():
        shutil.copy(manifest, out / "transcript_panel.csv")
    (out / "run_meta.json").write_text(json.dumps(json.loads(Path(run_meta).read_text()) | stamp, indent=2))
    if Path(viewer_meta).exists():
        both = json.loads(Path(viewer_meta).read_text())
        both.setdefault("run_metadata", {}).update(stamp)
        Path(viewer_out).mkdir(parents=True, exist_ok=True)
        (Path(viewer_out) / Path(viewer_meta).name).write_text(json.dumps(both, indent=2))


def palette_entries(palette: DataFrame) -> list[tuple[str, list[int]]]:
    """A palette on the driver, one entry per cluster."""
    return [(r[0], list(r[1])) for r in palette.where(F.col("color").isNotNull()).orderBy("cluster_id").collect()]
