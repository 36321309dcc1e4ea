"""Table schemas and the values that are part of the pipelines' meaning."""

from __future__ import annotations

from pyspark.sql import types as T

#: Pixel pitch in micrometres, and the area of a pixel.
PIXEL_UM = 0.3125
PIXEL_AREA_UM2 = 0.09765625

#: The greatest distance of an assignment, and the distance to the next code that makes it certain.
MAX_DISTANCE = 2
MIN_DELTA = 2

#: How a probe name is built, and the primer of each read.
PROBE_PATTERN = r"^(.*?)-([ACGT]{2,30})-([^-]+)$"
PRIMER_READ = {"SP1": 1, "m7a": 2, "m9a": 3, "m6a": 4, "m8a": 5, "m3a": 6}

UNDETERMINED = "UNDETERMINED"
NOT_CONVERTED = "NOT_CONVERTED"

#: Raw feature columns in order, as they are read and as a migrated file has them, and their older names. The
#: older x is the newer y.
FEATURE_COLUMNS = ["TXUID", "sequence", "confidence_score", "y_pixel_coordinate", "x_pixel_coordinate", "z_level"]
MIGRATED_COLUMNS = ["TXUID", "sequence", "confidence_score", "x_pixel_coordinate", "y_pixel_coordinate", "z_level"]
LEGACY_FEATURES = {
    "sequence_to_demux": "sequence",
    "meanQS": "confidence_score",
    "x_coord_shift": "y_pixel_coordinate",
    "y_coord_shift": "x_pixel_coordinate",
    "z": "z_level",
    "transcript": "probe_name",
    "transcript_condensed": "gene_name",
}

#: The viewer's colour of unassigned cells and its palette, in order.
DEFAULT_COLOR = "#BFBFBF"
PALETTE = [
    "#72FFAB", "#A16CFD", "#FF7043", "#008FFF", "#D32F2F", "#7CB342", "#7F34BE", "#FFCA28", "#0C8668", "#FB4695",
    "#005EE1", "#28EDED", "#A17B64", "#FFFF58", "#BC29AE", "#006D8F", "#FFBAFF", "#FFD091", "#5C6BC0", "#F490B2",
]

#: Tile sides by platform, share of points kept per coarser level, tiles of the coarsest level at most.
TILE_SIDE = 512
TILE_SIDE_TWO_LANES = 1028
LEVEL_SHARE = 0.2
COARSEST_TILES = 16

_s, _d, _i, _l = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FEATURES = _struct(TXUID=_s, sequence=_s, confidence_score=_d, y_pixel_coordinate=_d, x_pixel_coordinate=_d, z_level=_i)
TRANSCRIPTS = _struct(TXUID=_s, confidence_score=_d, y_pixel_coordinate=_d, x_pixel_coordinate=_d, z_level=_i, probe_name=_s, gene_name=_s, cell_id=_s)
PROTEIN_PANEL = _struct(target=_s, panel_type=_s)
PIXELS = _struct(y=_i, x=_i, label=_i)
IMAGE = _struct(channel=_s, y=_i, x=_i, intensity=_d)
CELL_MASK = _struct(
    cellId=_s, clusterId=_s, vertices=T.ArrayType(_i), area=_l, totalCounts=_l, totalGenes=_l, proteinValues=T.ArrayType(_l), nonzeroGeneIndices=T.ArrayType(_i), nonzeroGeneValues=T.ArrayType(_l), umapValues=_struct(umapY=_d, umapX=_d),
)
