"""Label rasters and images from files."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.operators import raster

#: Decoders of image files by suffix, from bytes to a two-dimensional array. Codecs that are not installed here can be
#: added by the caller.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {".npy": lambda b: np.load(io.BytesIO(b), allow_pickle=False)}


def load_mask(path: str | Path, shape: tuple[int, int] | None = None, key: str | None = None) -> np.ndarray:
    """The array of a ``.npz`` or ``.npy`` file. An archive of several arrays needs a ``key``; ``.npy`` ignores it.

    ``ValueError`` for another suffix, a missing key among several, or another shape; ``KeyError`` for an unknown key.
    """
    path = Path(path)
    if path.suffix == ".npz":
        with np.load(path) as z:
            if key is None and len(z.files) > 1:
                raise ValueError(f"{path.name} holds {z.files}: a key is needed")
            if key is not None and key not in z.files:
                raise KeyError(f"{key} is not in {path.name}, which holds {z.files}")
            mask = z[key or z.files[0]]
    elif path.suffix == ".npy":
        mask = np.load(path)
    else:
        raise ValueError(f"masks are .npy, .npz or .geojson, not {path.suffix!r}")
    if shape is not None and mask.shape != tuple(shape):
        raise ValueError(f"the mask has shape {mask.shape}, the sample {tuple(shape)}")
    return mask


def default_segmentation(path: str | Path, expanded: bool = True, key: str | None = None) -> np.ndarray:
    """The sample's own mask: a given key wins, else of the two standard arrays the one asked for, else the only one."""
    with np.load(path) as z:
        names = z.files
    if key is None and {"nuclei", "nuclei_exp"} <= set(names):
        key = "nuclei_exp" if expanded else "nuclei"
    return load_mask(path, None, key)


def runs_of_array(mask: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of equal non-zero labels of each row of an array."""
    m = np.asarray(mask)
    edge = np.ones(m.shape, bool)
    edge[:, 1:] = m[:, 1:] != m[:, :-1]
    y, x0 = np.nonzero(edge)
    x1 = np.where(np.r_[y[1:] == y[:-1], False], np.r_[x0[1:], 0], m.shape[1])
    label = m[y, x0]
    keep = label != 0
    return {"y": y[keep].astype(np.int32), "x0": x0[keep].astype(np.int32), "x1": x1[keep].astype(np.int32), "label": label[keep].astype(np.int32)}


def mask_runs(spark: SparkSession, mask: np.ndarray, sample_id: str) -> DataFrame:
    """(sample_id, y, x0, x1, label) of an array on the driver; runs are some forty times fewer than pixels."""
    return spark.createDataFrame(pa.table(runs_of_array(mask))).select(F.lit(sample_id).alias("sample_id"), "y", "x0", "x1", "label")


def runs_to_mask(runs: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The array of one sample's runs, on the driver: as large as the raster, which is one file."""
    out = np.zeros(shape, np.int32)
    for r in runs.select("y", "x0", "x1", "label").toLocalIterator():
        out[r["y"], r["x0"] : r["x1"]] = r["label"]
    return out


#: A GeoJSON file as far as it is read: coordinates stay text, since their depth differs between kinds of geometry.
_FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson_polygons(spark: SparkSession, path: str, sample_id: str, key: str | None = None) -> DataFrame:
    """(sample_id, label, ordinal, rings ARRAY<ARRAY<DOUBLE>>): the polygons of a GeoJSON file with their holes, one row per
    polygon of a MultiPolygon; label from the property ``label`` or ``key``, ordinal the feature's place in the file. Other
    geometries, and features without the label, are left out; ``KeyError`` if no feature has it."""
    f = spark.read.schema(_FEATURES).option("multiLine", True).json(str(path)).select(F.posexplode("features").alias("ordinal", "f"))
    name = key or "label"
    f = f.select("ordinal", F.try_element_at("f.properties", F.lit(name)).alias("label"), "f.geometry.type", "f.geometry.coordinates")
    if f.where("label is not null").isEmpty():
        raise KeyError(f"{name} is not a property of the features")
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    each = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", one))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", many))
    p = f.select(F.col("label").try_cast("double").cast("int").alias("label"), "ordinal", F.explode(each).alias("p")).where("label is not null and p is not null")
    return p.select(F.lit(sample_id).alias("sample_id"), "label", "ordinal", F.expr("transform(p, r -> flatten(transform(r, v -> slice(v, 1, 2))))").alias("rings"))


def rasterized(polygons: DataFrame) -> DataFrame:
    """The runs of polygons (sample_id, label, ordinal, rings), later features over earlier ones."""
    # a feature is drawn under its ordinal; its label is put back where it is on top
    drawn = raster.polygons_to_runs(polygons.select("sample_id", F.col("ordinal").alias("label"), "rings"))
    names = polygons.select("sample_id", "ordinal", F.col("label").alias("_label")).distinct()
    top = raster.last_on_top(raster.runs_to_pixels(drawn)).withColumnRenamed("label", "ordinal")
    named = top.join(names, ["sample_id", "ordinal"]).select("sample_id", "y", "x", F.col("_label").alias("label"))
    return raster.pixels_to_runs(named)


def bead_runs(spark: SparkSession, path: str | Path, sample_id: str) -> DataFrame:
    """(sample_id, y, x0, x1) of a boolean array's true pixels."""
    return mask_runs(spark, load_mask(path).astype(np.int32), sample_id).drop("label")


def jp2_shape(path: str | Path) -> tuple[int, int]:
    """(height, width) from the image header box of a JPEG 2000 file, without decoding it."""
    with open(path, "rb") as f:
        head = f.read(4096)
    at = head.find(b"ihdr")
    if at < 0:
        raise ValueError(f"{path} has no image header")
    return struct.unpack(">II", head[at + 4 : at + 12])


def image_shape(path: str | Path) -> tuple[int, int]:
    path = Path(path)
    return np.load(path, mmap_mode="r").shape[:2] if path.suffix == ".npy" else jp2_shape(path)


def decode_image(path: str | Path) -> np.ndarray:
    """The image of a file whose suffix has a decoder; ``ValueError`` for others."""
    path = Path(path)
    if path.suffix not in DECODERS:
        raise ValueError(f"no decoder for {path.suffix!r}; register one in DECODERS")
    return DECODERS[path.suffix](path.read_bytes())


@lru_cache(8)
def remembered_image(path: Path, changed: int) -> np.ndarray:
    return decode_image(path)


def image_rows(spark: SparkSession, folder: str, sample_id: str, glob: str = "*.npy", rows: int = 64) -> DataFrame:
    """(sample_id, channel, y, x0, intensities ARRAY<DOUBLE>) of a folder's images, a channel per file and a row per
    image row, decoded where the files are read."""
    decoders = dict(DECODERS)

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                p = Path(path)
                a = decoders[p.suffix](content).astype(float)
                for y0 in range(0, a.shape[0], rows):
                    band = a[y0 : y0 + rows]
                    yield pd.DataFrame({"channel": p.stem, "y": np.arange(y0, y0 + len(band), dtype=np.int32), "intensities": list(band)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    out = files.repartition(F.col("path")).mapInPandas(decode, "channel string, y int, intensities array<double>")
    return out.select(F.lit(sample_id).alias("sample_id"), "channel", "y", F.lit(0).alias("x0"), "intensities")
