"""The viewer's documents: cells with clusters and colours, and the tile pyramid of transcripts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.color import hex_to_rgb, hue_to_rgb
from spotloom.schemas import COARSEST_TILES, DEFAULT_COLOR, LEVEL_SHARE, PALETTE, TILE_SIDE, TILE_SIDE_TWO_LANES


# clusters and embedding of cell documents


def canonical_metadata(cells: DataFrame, metadata: DataFrame, key: str, cluster: str | None = None, color: str | None = None, embedding: str | None = None, order: str | None = None) -> DataFrame:
    """(cell_id, cluster_id, cluster_color, umap_1, umap_2) for every cell of the documents, with defaults where the
    metadata has no row, value or column: '-1', grey and NaN. Of repeated metadata rows of a cell one counts, the least
    by cluster. Cluster ids are text. Both embedding columns must be there. ``order``: a column of the metadata, such as a row
    index, by whose least value per cell the result is sorted; cells without metadata come last, by id."""
    for name in (key, cluster, color, *([f"{embedding}_1", f"{embedding}_2"] if embedding else [])):
        if name is not None and name not in metadata.columns:
            raise KeyError(f"column {name!r} is not in the metadata")
    if color and not cluster:
        raise ValueError("a colour column needs a cluster column")
    nan = F.lit(float("nan"))
    pick = lambda c, kind: F.col(f"`{c}`").cast(kind) if c else F.lit(None).cast(kind)
    m = metadata.select(
        F.col(f"`{key}`").cast("string").alias("cell_id"),
        F.struct(pick(cluster, "string").alias("cluster_id"), pick(color, "string").alias("cluster_color"), pick(f"{embedding}_1" if embedding else None, "double").alias("umap_1"), pick(f"{embedding}_2" if embedding else None, "double").alias("umap_2")).alias("m"),
        pick(order, "bigint").alias("at"),
    ).where("cell_id is not null").groupBy("cell_id").agg(F.min("m").alias("m"), F.min("at").alias("at"))
    out = cells.select("cell_id").distinct().join(m, "cell_id", "left")
    if order:
        out = out.orderBy(F.col("at").asc_nulls_last(), "cell_id")
    return out.select(F.coalesce("cell_id", F.lit("unknown_cell")).alias("cell_id"), F.coalesce("m.cluster_id", F.lit("-1")).alias("cluster_id"), F.coalesce("m.cluster_color", F.lit(DEFAULT_COLOR)).alias("cluster_color"), F.coalesce("m.umap_1", nan).alias("umap_1"), F.coalesce("m.umap_2", nan).alias("umap_2"))


def unmatched_cells(cells: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """(cell_id) of documents that the metadata lacks."""
    return cells.select("cell_id").where("cell_id is not null").distinct().join(metadata.select(F.col(key).alias("cell_id")), "cell_id", "left_anti")


def update_cells(cells: DataFrame, canonical: DataFrame, clusters: bool = True, embedding: bool = True) -> DataFrame:
    """Cell documents (cellId, clusterId, umapValues, ...) with new clusters and embedding; other fields stay, as do
    documents that the metadata does not know."""
    c = canonical.select(F.col("cell_id").alias("cellId"), "cluster_id", "umap_1", "umap_2")
    out = cells.join(c, "cellId", "left")
    if clusters:
        out = out.withColumn("clusterId", F.coalesce("cluster_id", "clusterId"))
    if embedding:
        new = F.struct(F.col("umap_2").alias("umapY"), F.col("umap_1").alias("umapX"))
        out = out.withColumn("umapValues", F.when(F.col("umap_1").isNotNull(), new).otherwise(F.col("umapValues")))
    return out.select(*cells.columns)


def generated_palette(clusters: DataFrame) -> DataFrame:
    """(cluster_id, color ARRAY<INT>): up to 20 clusters get the palette's colours in string order, more get hues;
    '-1' is grey, and always there. Null clusters have no colour."""
    ids = clusters.select(F.col("cluster_id").cast("string").alias("cluster_id")).where("cluster_id <> '-1'").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    w = Window.orderBy("cluster_id")  # over the distinct clusters
    fixed = F.array(*[F.lit(c) for c in PALETTE])
    ranked = ids.select("cluster_id", F.row_number().over(w).alias("i"), n.alias("n"))
    color = F.when(F.col("n") <= len(PALETTE), hex_to_rgb(F.get(fixed, F.col("i") - 1))).otherwise(hue_to_rgb((F.col("i") - 1) / F.col("n")))
    grey = clusters.sparkSession.range(1).select(F.lit("-1").alias("cluster_id"), hex_to_rgb(F.lit(DEFAULT_COLOR)).alias("color"))
    return ranked.select("cluster_id", color.alias("color")).unionByName(grey)


def palette_from_colors(metadata: DataFrame) -> DataFrame:
    """(cluster_id, color ARRAY<INT>): each cluster's colour as given, the least of several; a colour that is not
    ``#RRGGBB`` gives null."""
    return metadata.where("cluster_id is not null").groupBy("cluster_id").agg(F.min("cluster_color").alias("c")).select("cluster_id", hex_to_rgb(F.col("c")).alias("color"))


def infer_cluster_column(columns: list[str]) -> str | None:
    """The first, in order, of the columns named like a Leiden clustering."""
    return next(iter(sorted(c for c in columns if "leiden" in c)), None)


def infer_embedding(columns: list[str]) -> str | None:
    """The common name of the embedding's columns ``<name>_1`` and ``<name>_2``."""
    return next((c[:-2] for c in sorted(columns) if "X_umap" in c), None)


def area_column(columns: list[str]) -> str:
    """The one area column, else the one of the expanded area."""
    area = [c for c in columns if "area" in c]
    if len(area) > 1:
        area = [c for c in area if "expanded" in c]
    if len(area) != 1:
        raise ValueError("no single area column")
    return area[0]


def cell_documents(obs: DataFrame, rings: DataFrame, genes: DataFrame, proteins: list[str] = ()) -> DataFrame:
    """One document per cell: ring, id, area, totals, non-zero genes, intensities; 'unassigned', NaN embedding.

    ``obs``: (cell_id, area, total_counts, n_genes_by_counts, <protein>_intensity_mean...); ``rings``: (cell_id, ring);
    ``genes``: (cell_id, indices, values). Cells without a ring or genes have empty lists; numbers are truncated.
    """
    nan = F.lit(float("nan"))
    values = F.array(*[F.coalesce(F.col(f"`{p}_intensity_mean`"), F.lit(0.0)).cast("bigint") for p in proteins]) if proteins else F.array().cast("array<bigint>")
    d = obs.join(rings.select("cell_id", "ring"), "cell_id", "left").join(genes.select("cell_id", "indices", "values"), "cell_id", "left")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).cast(kind)
    return d.select(
        F.col("cell_id").alias("cellId"),
        F.lit("unassigned").alias("clusterId"),
        empty("ring", "array<int>").alias("vertices"),
        F.coalesce(F.col("area").cast("bigint"), F.lit(0)).alias("area"),
        F.coalesce(F.col("total_counts").cast("bigint"), F.lit(0)).alias("totalCounts"),
        F.coalesce(F.col("n_genes_by_counts").cast("bigint"), F.lit(0)).alias("totalGenes"),
        values.alias("proteinValues"),
        empty("indices", "array<int>").alias("nonzeroGeneIndices"),
        empty("values", "array<bigint>").alias("nonzeroGeneValues"),
        F.struct(nan.alias("umapY"), nan.alias("umapX")).alias("umapValues"),
    )


# tile pyramid


def tile_side(platform: str | None) -> int:
    return TILE_SIDE_TWO_LANES if (platform or "").endswith("-2lane") else TILE_SIDE


def _even(n: int) -> int:
    return n + n % 2


def tile_counts_of(shape: tuple[int, int], side: int) -> tuple[int, int]:
    """Tiles along height and width, rounded up to even numbers."""
    return _even(math.ceil(shape[0] / side)), _even(math.ceil(shape[1] / side))


def pyramid_levels(shape: tuple[int, int], side: int, most: int = COARSEST_TILES) -> int:
    """The least number of halvings, one or more, that leaves at most ``most`` tiles."""
    level = 1
    while math.prod(tile_counts_of(shape, side * 2**level)) > most:
        level += 1
    return level


def pyramid_config(shape: tuple[int, int], side: int, colors: list[tuple[str, list[int]]] = ()) -> dict:
    levels = pyramid_levels(shape, side)
    return {"layer_height": shape[0], "layer_width": shape[1], "layers": levels, "tile_size": side * 2**levels, "color_map": [{"gene_name": g, "color": c} for g, c in colors]}


def gene_colors(genes: DataFrame) -> DataFrame:
    """(gene_name, color ARRAY<INT>): hues in gene order."""
    g = genes.select("gene_name").where("gene_name is not null").distinct()
    w = Window.orderBy("gene_name")  # a panel's genes
    return g.select("gene_name", hue_to_rgb((F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy())).alias("color"))


def assign_tiles(points: DataFrame, side: int = TILE_SIDE, x: str = "x_pixel_coordinate", y: str = "y_pixel_coordinate") -> DataFrame:
    """Points with ``tile_x`` (from y) and ``tile_y`` (from x) of the finest level and ``position`` [x, y]; the axes are
    swapped since images are (height, width). Points with a null, NaN or negative coordinate are in no tile."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) >= 0)
    p = points.where(ok(x) & ok(y))
    return p.withColumns({"tile_x": F.floor(F.col(y) / side).cast("int"), "tile_y": F.floor(F.col(x) / side).cast("int"), "position": F.array(F.col(x).cast("double"), F.col(y).cast("double"))})


def on_levels(tiled: DataFrame, levels: int) -> DataFrame:
    """Each point once per level 0 (coarsest) to ``levels``, with the tile it lies in there."""
    p = tiled.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    at = lambda c: F.expr(f"{c} div shiftleft(1, {levels} - level)").cast("int")
    return p.withColumns({"tile_x": at("tile_x"), "tile_y": at("tile_y")})


def sample_levels(levelled: DataFrame, levels: int, key: str, group: list[str], share: float = LEVEL_SHARE) -> DataFrame:
    """On each level and tile column, the share ``share ** (levels - level)`` of its points, rounded down, smallest
    md5 of ``key`` first: the exact fraction, the same on every run.

    The points of a tile column are counted by the beginning of their md5, of which there are 4,096; the one in which the
    share ends is found from the counts, and only its points are ranked. The finest level is kept whole.
    """
    finest = levelled.where(F.col("level") == levels)
    md5 = F.md5(F.col(key).cast("string"))
    rest = levelled.where(F.col("level") < levels).withColumn("_begin", F.conv(F.substring(md5, 1, 3), 16, 10).cast("int"))
    column = ["level", *group, "tile_x"]
    counts = rest.groupBy(*column, "_begin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*column)
    upto = counts.withColumns({"upto": F.sum("n").over(w.orderBy("_begin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    upto = upto.withColumn("keep", F.floor(F.col("all") * F.pow(F.lit(share), F.lit(levels) - F.col("level")) + 1e-9))
    ends = upto.where("upto >= keep and upto - n < keep").select(*[F.col(c).alias(f"_{c}") for c in column], F.col("_begin").alias("_end"), (F.col("keep") - F.col("upto") + F.col("n")).alias("_left"))
    same = F.lit(True)
    for c in column:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    near = rest.join(ends, same & (F.col("_begin") <= F.col("_end")))
    rank = F.row_number().over(w.orderBy(md5, key))
    edge = near.where(F.col("_begin") == F.col("_end")).withColumn("_i", rank).where(F.col("_i") <= F.col("_left"))
    return finest.unionByName(near.where(F.col("_begin") < F.col("_end")).select(*levelled.columns)).unionByName(edge.select(*levelled.columns))


def tile_documents(levelled: DataFrame, group: list[str], gene: str = "gene_name") -> DataFrame:
    """(group, level, tile_x, tile_y, pointsData): the points of each tile, in no order. A tile is bounded by the share
    of its level, and gathered because it is one file."""
    point = F.struct("position", F.col(gene).alias("geneName"), F.col("cell_id").cast("string").alias("cellId"))
    return levelled.groupBy(*group, "level", "tile_x", "tile_y").agg(F.collect_list(point).alias("pointsData"))
