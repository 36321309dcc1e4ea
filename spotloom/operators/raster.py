"""Label rasters as tables.

A raster is a table of its non-zero pixels (sample_id, y, x, label) or, some forty times smaller, of runs of a row
(sample_id, y, x0, x1, label), x1 exclusive. Rings become runs row by row without touching pixels, transcripts are looked
up in runs, areas and centroids are sums over runs, and intensities are sums over slices of image rows. Morphology
paints runs on small dense tiles with a margin, so that only runs are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.schemas import PIXEL_AREA_UM2

#: Width in pixels of the blocks by which points are matched with runs of their row.
BLOCK = 64
#: Side of the tiles that morphology works on, and the margin it needs around them.
TILE = 512
MARGIN = 2
#: Runs, those of excluded pixels included, up to which they are sent to the image's rows; beyond, both are shuffled by row.
BROADCAST_RUNS = 500_000


def rings_to_runs(rings: DataFrame) -> DataFrame:
    """``polygons_to_runs`` of single rings: (sample_id, label, ring ARRAY of x1,y1,...)."""
    return polygons_to_runs(rings.select("sample_id", "label", F.array("ring").alias("rings")))


def polygons_to_runs(polygons: DataFrame) -> DataFrame:
    """(sample_id, y, x0, x1, label) of the pixels whose centre lies inside a polygon, by the even-odd rule, so that a
    ring within a ring is a hole.

    ``polygons``: (sample_id, label, rings ARRAY of rings, each x1,y1,..., closed or not, in either direction). Rings of
    fewer than three vertices or with null elements are ignored, as are polygons without any other, label or sample.
    Repeated polygons count once. Where polygons overlap, so do their runs; see ``last_on_top``.
    """
    r = polygons.where("sample_id is not null and label is not null").selectExpr("sample_id", "label", "filter(rings, r -> size(r) >= 6 and not exists(r, v -> v is null)) as rings").where("size(rings) > 0").distinct()
    r = r.selectExpr("sample_id", "label", "transform(rings, r -> transform(slice(r, 1, size(r) div 2 * 2), v -> double(v))) as rings")
    edge = "struct(r[2 * i] as ax, r[2 * i + 1] as ay, r[(2 * i + 2) % size(r)] as bx, r[(2 * i + 3) % size(r)] as `by`)"
    r = r.selectExpr("sample_id", "label", f"flatten(transform(rings, r -> transform(sequence(0, size(r) div 2 - 1), i -> {edge}))) as edges")
    ys = "transform(edges, e -> e.ay)"
    r = r.selectExpr("sample_id", "label", "edges", f"cast(floor(array_min({ys}) - 0.5) as int) as lo", f"cast(ceil(array_max({ys})) as int) as hi")
    rows = r.selectExpr("sample_id", "label", "edges", "explode(sequence(lo, hi)) as y")
    cross = """array_sort(transform(filter(edges, e -> (e.ay > y + 0.5D) != (e.`by` > y + 0.5D)),
        e -> (e.bx - e.ax) * (y + 0.5D - e.ay) / (e.`by` - e.ay) + e.ax))"""
    spans = rows.selectExpr("sample_id", "label", "y", f"{cross} as c").where("size(c) >= 2")
    spans = spans.selectExpr("sample_id", "label", "y", "c", "explode(sequence(0, size(c) div 2 - 1)) as k")
    out = spans.selectExpr("sample_id", "y", "cast(ceil(c[2 * k] - 0.5D) as int) as x0", "cast(ceil(c[2 * k + 1] - 0.5D) as int) as x1", "label")
    return out.where("x1 > x0 and x1 > 0 and y >= 0").withColumn("x0", F.greatest("x0", F.lit(0)))


def runs_to_pixels(runs: DataFrame) -> DataFrame:
    """(sample_id, y, x, label)."""
    return runs.select("sample_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"), "label")


def last_on_top(pixels: DataFrame, order: str = "label") -> DataFrame:
    """One label per pixel where regions overlap: that of the greatest ``order``, then of the greatest label."""
    return pixels.groupBy("sample_id", "y", "x").agg(F.max(F.struct(F.col(order).alias("_order"), "label")).alias("m")).select("sample_id", "y", "x", "m.label")


def pixels_to_runs(pixels: DataFrame) -> DataFrame:
    """Maximal runs of equal labels within each row; pixels of label 0 or null are background."""
    w = Window.partitionBy("sample_id", "y").orderBy("x")
    p = pixels.where("label <> 0").select("sample_id", "y", "x", "label").distinct()
    p = p.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) != 1) | (F.lag("label").over(w) != F.col("label")), F.lit(True)))
    p = p.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    return p.groupBy("sample_id", "y", "run", "label").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).select("sample_id", "y", "x0", "x1", "label")


def pixel_of(coordinate: Column) -> Column:
    """The pixel of a coordinate; null (background) for a null, NaN, infinite or negative one."""
    c = coordinate.cast("double")
    return F.when((c >= 0) & (c < 2_000_000_000) & ~F.isnan(c), F.floor(c).cast("int"))


def look_up(points: DataFrame, runs: DataFrame, out: str = "label", x: str = "x_pixel_coordinate", y: str = "y_pixel_coordinate") -> DataFrame:
    """``points`` with the label of the pixel they lie in, 0 for background and for impossible coordinates.

    An equi-join on sample, row and block of columns; the runs' side holds each run once per block it spans. Where runs
    overlap, a point comes once, with the greatest label.
    """
    blocks = runs.select("sample_id", F.col("y").alias("_y"), F.explode(F.sequence(F.floor(F.col("x0") / BLOCK).cast("int"), F.floor((F.col("x1") - 1) / BLOCK).cast("int"))).alias("_b"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("label").alias("_label"))
    rows = blocks.groupBy("sample_id", "_y", "_b").agg(F.collect_list(F.struct("_x0", "_x1", "_label")).alias("_runs"))  # at most one run per pixel of a block and ring
    # points without a pixel are spread, by where they are, over rows that no raster has, or they would all meet in one task
    nowhere = -1 - F.spark_partition_id()
    p = points.withColumns({"_y": F.coalesce(pixel_of(F.col(y)), nowhere), "_x": F.coalesce(pixel_of(F.col(x)), F.lit(-1))}).withColumn("_b", F.floor(F.col("_x") / BLOCK).cast("int"))
    found = p.join(rows, ["sample_id", "_y", "_b"], "left")
    label = F.coalesce(F.array_max(F.expr("transform(filter(_runs, r -> r._x0 <= _x and _x < r._x1), r -> r._label)")), F.lit(0))
    return found.withColumn(out, label.cast("int")).select(*[c for c in points.columns if c != out], out)


def region_properties(runs: DataFrame) -> DataFrame:
    """(sample_id, label, n_pixels, area_um, cell_x, cell_y): sizes and centroids, from sums over runs."""
    n = F.col("x1") - F.col("x0")
    g = runs.groupBy("sample_id", "label").agg(
        F.sum(n).cast("bigint").alias("n_pixels"),
        F.sum(n.cast("bigint") * (F.col("x0") + F.col("x1") - 1)).alias("sx2"),
        F.sum(n.cast("bigint") * F.col("y")).alias("sy"),
    )
    return g.select("sample_id", "label", "n_pixels", (F.col("n_pixels") * PIXEL_AREA_UM2).alias("area_um"), (F.col("sx2") / 2 / F.col("n_pixels")).alias("cell_x"), (F.col("sy") / F.col("n_pixels")).alias("cell_y"))


def bounding_boxes(runs: DataFrame) -> DataFrame:
    """(sample_id, label, y0, x0, y1, x1): each region's box, ends exclusive; its side is the greater of its lengths."""
    return runs.where("label <> 0").groupBy("sample_id", "label").agg(F.min("y").alias("y0"), F.min("x0").alias("x0"), (F.max("y") + 1).alias("y1"), F.max("x1").alias("x1"))


def nuclear_properties(nuclei: DataFrame, expanded: DataFrame) -> DataFrame:
    """(sample_id, label, cell_x, cell_y, nuclei_area_um, nuclei_expanded_area_um): every cell of the expanded raster;
    the centroid is the nucleus', and it and the nucleus' area are null for a cell without one."""
    n = region_properties(nuclei).select("sample_id", "label", "cell_x", "cell_y", F.col("area_um").alias("nuclei_area_um"))
    return region_properties(expanded).select("sample_id", "label", F.col("area_um").alias("nuclei_expanded_area_um")).join(n, ["sample_id", "label"], "left").select("sample_id", "label", "cell_x", "cell_y", "nuclei_area_um", "nuclei_expanded_area_um")


def pixels_to_image_rows(image: DataFrame) -> DataFrame:
    """(sample_id, channel, y, x0, intensities) from single pixels (sample_id, channel, y, x, intensity): one array per
    image row from its first pixel on, null where there is none. A pixel given twice counts once, the larger value."""
    g = image.groupBy("sample_id", "channel", "y", "x").agg(F.max("intensity").alias("intensity")).groupBy("sample_id", "channel", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "intensity"))).alias("m"))
    g = g.withColumns({"x0": F.array_min(F.map_keys("m")), "x1": F.array_max(F.map_keys("m"))})
    return g.select("sample_id", "channel", "y", "x0", F.expr("transform(sequence(x0, x1), x -> try_element_at(m, x))").alias("intensities"))


def _left_over(runs: DataFrame, excluded: DataFrame) -> DataFrame:
    """(sample_id, y, label, _spans ARRAY of a1,b1,a2,b2,...): what excluded runs leave of runs, block by block of columns."""
    block = lambda x0, x1: F.explode(F.sequence(F.floor(F.col(x0) / BLOCK).cast("int"), F.floor((F.col(x1) - 1) / BLOCK).cast("int"))).alias("_b")
    off = excluded.where("x1 > x0").select("sample_id", "y", "x0", "x1", block("x0", "x1")).groupBy("sample_id", "y", "_b").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("_off"))  # at most one per pixel of a block
    r = runs.where("x1 > x0").select("sample_id", "y", "x0", "x1", "label", block("x0", "x1"))
    r = r.select("sample_id", "y", "_b", "label", F.greatest("x0", F.col("_b") * BLOCK).alias("_a"), F.least("x1", (F.col("_b") + 1) * BLOCK).alias("_z"))
    # sizes of exploded runs are guessed far too low, so that nothing is broadcast on their account
    r = r.join(off.hint("merge"), ["sample_id", "y", "_b"], "left").withColumn("_near", F.expr("filter(_off, e -> e.x0 < _z and e.x1 > _a)"))
    gaps = "transform(sequence(0, size(_near)), k -> array(if(k = 0, _a, _near[k - 1].x1), if(k = size(_near), _z, _near[k].x0)))"
    r = r.withColumn("_spans", F.expr(f"if(_near is null, array(_a, _z), flatten(filter({gaps}, g -> g[1] > g[0])))"))
    return r.where("size(_spans) > 0").select("sample_id", "y", "label", "_spans")


def region_means(image_rows: DataFrame, runs: DataFrame, excluded: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(sample_id, label, channel, mean_intensity, n_pixels) of every channel at once.

    ``image_rows``: (sample_id, channel, y, x0, intensities ARRAY<DOUBLE>), an image row or a part of one from column
    ``x0`` on; ``excluded``: runs (sample_id, y, x0, x1), disjoint, such as beads, whose pixels are never read;
    ``parts``: the number of partitions if the image's rows are hashed by sample and row. A region without any pixel left
    has no row. Null intensities do not count.
    """
    r = runs.select("sample_id", "y", "label", F.array("x0", "x1").alias("_spans")) if excluded is None else _left_over(runs, excluded)
    few = runs.count() + (0 if excluded is None else excluded.count()) <= BROADCAST_RUNS
    if parts and not few:
        r = r.repartition(parts, "sample_id", "y")
    per_row = r.groupBy("sample_id", "y").agg(F.collect_list(F.struct("label", "_spans")).alias("_runs"))  # the runs of one image row
    # otherwise a task holds the runs of its rows and the pixels pass by: left to itself, the optimizer, which cannot know
    # how long the arrays are, broadcasts the image or sorts it
    per_row = F.broadcast(per_row) if few else per_row.hint("shuffle_hash")
    i = image_rows.select("sample_id", "channel", "y", "x0", "intensities")
    # each run is reduced where its row is, so that no copy of the row's pixels leaves it
    cut = lambda a, b: f"slice(intensities, greatest({a}, x0) - x0 + 1, greatest(least({b}, x0 + size(intensities)) - greatest({a}, x0), 0))"
    several = f"flatten(transform(sequence(0, size(r._spans) div 2 - 1), k -> {cut('r._spans[2 * k]', 'r._spans[2 * k + 1]')}))"
    each = f"transform(_runs, r -> struct(r.label as label, if(size(r._spans) = 2, {cut('r._spans[0]', 'r._spans[1]')}, {several}) as v))"
    # a sum that met a null is null, and made again without it
    added = lambda v: f"aggregate({v}, 0D, (t, v) -> t + v)"
    each = f"transform({each}, r -> struct(r.label as label, r.v as v, {added('r.v')} as s))"
    known = "filter(r.v, v -> v is not null)"
    each = f"transform({each}, r -> struct(r.label as label, if(r.s is null, {added(known)}, r.s) as s, if(r.s is null, array_size({known}), array_size(r.v)) as n))"
    part = i.join(per_row, ["sample_id", "y"]).select("sample_id", "channel", F.explode(F.expr(each)).alias("r"))
    g = part.groupBy("sample_id", F.col("r.label").alias("label"), "channel").agg(F.sum("r.s").alias("s"), F.sum("r.n").cast("bigint").alias("n_pixels"))
    return g.where("n_pixels > 0").select("sample_id", "label", "channel", (F.col("s") / F.col("n_pixels")).alias("mean_intensity"), "n_pixels")


_NEIGHBOURS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _shifted(a: np.ndarray, dy: int, dx: int, fill: int) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = a[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def _borders(a: np.ndarray) -> np.ndarray:
    most = a
    for dy, dx in _NEIGHBOURS:
        most = np.maximum(most, _shifted(a, dy, dx, 0))
    return a < most


def _outlines(a: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Pixels that are no border and have, inside the image, a neighbour that is background once borders are."""
    inner = np.where(_borders(a), 0, a)
    filled = np.where(outside, 1, inner)
    touches = np.zeros(a.shape, bool)
    for dy, dx in _NEIGHBOURS:
        touches |= _shifted(filled, dy, dx, 1) == 0
    return (inner != 0) & touches


def _on_tiles(runs: DataFrame, shape: tuple[int, int] | None, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(sample_id, y, x, label) of the pixels that ``work`` picks on dense tiles with a margin. Where runs overlap, the
    greatest label is painted. A tile has a fixed number of pixels, whatever lies on it."""
    at = lambda c: F.floor(c / TILE).cast("int")
    ty = F.explode(F.sequence(at(F.col("y") - MARGIN), at(F.col("y") + MARGIN))).alias("ty")
    tx = F.explode(F.sequence(at(F.col("x0") - MARGIN), at(F.col("x1") - 1 + MARGIN))).alias("tx")
    tiles = runs.where("x1 > x0 and label <> 0").select("sample_id", "y", "x0", "x1", "label", ty).select("*", tx)
    side = TILE + 2 * MARGIN

    def paint(t: pa.Table) -> pa.Table:
        oy, ox = t["ty"][0].as_py() * TILE - MARGIN, t["tx"][0].as_py() * TILE - MARGIN
        a = np.zeros((side, side), np.int32)
        y, x0, x1, label = (t[c].to_numpy() for c in ("y", "x0", "x1", "label"))
        order = np.argsort(label, kind="stable")
        for r, b, e, v in zip((y - oy)[order].tolist(), np.maximum(x0 - ox, 0)[order].tolist(), np.minimum(x1 - ox, side)[order].tolist(), label[order].tolist(), strict=True):
            a[r, b:e] = v
        yy, xx = np.arange(side) + oy, np.arange(side) + ox
        out_y, out_x = (yy < 0) | (yy >= shape[0] if shape else False), (xx < 0) | (xx >= shape[1] if shape else False)
        outside = out_y[:, None] | out_x[None, :]
        picked = work(a, outside) & ~outside
        picked[:MARGIN] = picked[-MARGIN:] = picked[:, :MARGIN] = picked[:, -MARGIN:] = False
        py, px = np.nonzero(picked)
        return pa.table({"sample_id": pa.repeat(t["sample_id"][0], len(py)), "y": pa.array(yy[py], pa.int32()), "x": pa.array(xx[px], pa.int32()), "label": pa.array(a[py, px], pa.int32())})

    return tiles.groupBy("sample_id", "ty", "tx").applyInArrow(paint, "sample_id string, y int, x int, label int")


def border_pixels(runs: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """(sample_id, y, x): pixels, background included, below the greatest label of their plus-shaped neighbourhood.
    Pixels outside the image, of ``shape`` (height, width) if given, do not count."""
    return _on_tiles(runs, shape, lambda a, _: _borders(a)).drop("label")


def outline_pixels(runs: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """(sample_id, y, x, label): a region's pixels that are no border and touch, by a side, a pixel that is background
    once the borders are. Pixels outside the image, of ``shape`` (height, width) if given, do not touch."""
    return _on_tiles(runs, shape, _outlines)
