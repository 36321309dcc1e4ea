"""The viewer's binary documents. Message types are put together at run time from the fields they have."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spotloom import schemas

#: Fields of each message in number order as (name, type, repeated). A type in capitals is a message.
CELL_FILE = {
    "UmapEntry": [("umapY", "double", 0), ("umapX", "double", 0)],
    "SingleMask": [
        ("vertices", "uint32", 1), ("area", "uint32", 0), ("totalCounts", "uint32", 0), ("totalGenes", "uint32", 0), ("cellId", "string", 0), ("clusterId", "string", 0),
        ("proteinValues", "uint32", 1), ("nonzeroGeneIndices", "uint32", 1), ("nonzeroGeneValues", "uint32", 1), ("umapValues", "UmapEntry", 0),
    ],
    "ColormapEntry": [("clusterId", "string", 0), ("color", "uint32", 1)],
    "Metadata": [("proteinNames", "string", 1), ("geneNames", "string", 1)],
    "CellMasks": [("cellMasks", "SingleMask", 1), ("colormap", "ColormapEntry", 1), ("metadata", "Metadata", 0), ("numberOfCells", "uint32", 0)],
}
TILE_FILE = {
    "PointData": [("position", "double", 1), ("geneName", "string", 0), ("cellId", "string", 0)],
    "TileData": [("pointsData", "PointData", 1), ("numberOfPoints", "uint32", 0)],
}


@lru_cache
def messages(kind: str) -> dict[str, type]:
    """Message classes by name; ``kind``: cells or tiles."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    layout = CELL_FILE if kind == "cells" else TILE_FILE
    f = descriptor_pb2.FileDescriptorProto(name=f"spotloom_{kind}.proto", syntax="proto3", package=f"spotloom.{kind}")
    t = descriptor_pb2.FieldDescriptorProto
    scalar = {"double": t.TYPE_DOUBLE, "uint32": t.TYPE_UINT32, "string": t.TYPE_STRING}
    for name, fields in layout.items():
        m = f.message_type.add(name=name)
        for i, (field, typ, repeated) in enumerate(fields, 1):
            x = m.field.add(name=field, number=i, label=t.LABEL_REPEATED if repeated else t.LABEL_OPTIONAL)
            if typ in scalar:
                x.type = scalar[typ]
            else:
                x.type, x.type_name = t.TYPE_MESSAGE, f".spotloom.{kind}.{typ}"
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return {n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"spotloom.{kind}.{n}")) for n in layout}


def _ints(v) -> list[int]:
    return [] if v is None else [int(x) for x in v]


def encode_cells(rows: Iterable[dict]) -> bytes:
    """A cell file with the documents of ``rows`` alone. Two such byte strings, one after the other, are one file with
    the documents of both."""
    out = messages("cells")["CellMasks"]()
    for r in rows:
        c = out.cellMasks.add()
        for field in ("vertices", "proteinValues", "nonzeroGeneIndices", "nonzeroGeneValues"):
            getattr(c, field).extend(_ints(r.get(field)))
        for field in ("area", "totalCounts", "totalGenes"):
            setattr(c, field, int(r.get(field) or 0))
        c.cellId, c.clusterId = str(r.get("cellId") or ""), str(r.get("clusterId") or "")
        u = r.get("umapValues") or {}
        for field in ("umapX", "umapY"):
            setattr(c.umapValues, field, float("nan") if u.get(field) is None else float(u[field]))
    return out.SerializeToString()


def encode_frame(colormap: list[tuple[str, list[int]]], genes: list[str] = (), proteins: list[str] = ()) -> bytes:
    """The part of a cell file that belongs to no cell."""
    out = messages("cells")["CellMasks"]()
    out.metadata.geneNames.extend(genes)
    out.metadata.proteinNames.extend(proteins)
    for cluster, color in colormap:
        out.colormap.add(clusterId=cluster, color=color)
    return out.SerializeToString()


def decode_cells(data: bytes):
    """The message of a cell file, or None if the bytes are none."""
    from google.protobuf.message import DecodeError

    m = messages("cells")["CellMasks"]()
    try:
        m.ParseFromString(data)
    except DecodeError:
        return None
    return m


def cell_rows(message) -> Iterator[tuple]:
    for c in message.cellMasks:
        yield (c.cellId, c.clusterId, list(c.vertices), c.area, c.totalCounts, c.totalGenes, list(c.proteinValues), list(c.nonzeroGeneIndices), list(c.nonzeroGeneValues), (c.umapValues.umapY, c.umapValues.umapX))


def read_cell_file(spark: SparkSession, path: str | Path) -> DataFrame | None:
    """One row per cell document of a file, or None if it cannot be decoded. A file is read by one task."""
    m = decode_cells(Path(path).read_bytes())
    if m is None:
        return None
    return spark.createDataFrame(list(cell_rows(m)), schemas.CELL_MASK)


def read_frame(path: str | Path) -> dict[str, list]:
    """colormap, genes and proteins of a cell file: the part that belongs to no cell."""
    m = decode_cells(Path(path).read_bytes())
    return {"colormap": [(c.clusterId, list(c.color)) for c in m.colormap], "genes": list(m.metadata.geneNames), "proteins": list(m.metadata.proteinNames)}


def encoded_cells(cells: DataFrame) -> DataFrame:
    """(part BINARY): the documents encoded where they are; the parts, in any order, make up the file."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield pd.DataFrame({"part": [encode_cells(pdf.to_dict("records"))]})

    names = [f.name for f in schemas.CELL_MASK.fields]
    return cells.select(*[c for c in names if c in cells.columns]).mapInPandas(work, "part binary")


def encode_tile(points: Iterable) -> bytes:
    out = messages("tiles")["TileData"]()
    for p in points:
        out.pointsData.add(position=list(p["position"]), geneName=p["geneName"] or "", cellId=str(p["cellId"] or ""))
    return out.SerializeToString()


def decode_tile(data: bytes) -> list[tuple[list[float], str, str]]:
    m = messages("tiles")["TileData"]()
    m.ParseFromString(data)
    return [(list(p.position), p.geneName, p.cellId) for p in m.pointsData]


def encoded_tiles(documents: DataFrame) -> DataFrame:
    """(level, tile_x, tile_y, tile BINARY), encoded where the tiles are."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"level": pdf["level"], "tile_x": pdf["tile_x"], "tile_y": pdf["tile_y"], "tile": [encode_tile(p) for p in pdf["pointsData"]]})

    return documents.select("level", "tile_x", "tile_y", "pointsData").mapInPandas(work, "level int, tile_x int, tile_y int, tile binary")
