"""Points near other points, and the region around each point.

The plane of a sample is cut into square tiles. A point goes to its own tile and, as a margin, to each tile that its disc
touches; a region goes to every tile that it covers. One shuffle brings a tile's points and regions together. Inside a
task the points are sorted by their Morton code (a space-filling curve over cells of half the disc's width); a disc or a
region is covered with ranges of codes, each range is found by binary search, and what it holds is refined exactly.

Tiles with too many points are cut into small ones, and what is too full even then is dealt to several tasks by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides of the tiles in units of the coordinates, and points that a tile may hold before it is cut further.
TILE = 256
SMALL_TILE = 16
FULL = 200_000
#: Points gathered before a set of whole tiles is worked off; candidate pairs held at once.
CHUNK = 60_000
PAIRS = 2_000_000

_TASK = "g bigint, row_id bigint, x double, y double, who bigint, label int, home boolean, ring array<int>"
FOUND = pa.schema([("relation", pa.string()), ("row_a", pa.int64()), ("row_b", pa.int64())])


def _spread(v: np.ndarray) -> np.ndarray:
    """Puts the low 24 bits of ``v`` at the even places."""
    v = v.astype(np.uint64) & np.uint64(0xFFFFFF)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


def morton(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    return (_spread(ix) | (_spread(iy) << np.uint64(1))).astype(np.int64)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i and each place in lo[i]..hi[i]-1: (i, place)."""
    n = hi - lo
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _blocks(n: np.ndarray) -> Iterator[slice]:
    """Consecutive slices of at most PAIRS candidates in sum, or of one element."""
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        yield slice(at, to)
        at = to


class _Tiles:
    """The sorted points of whole tiles."""

    def __init__(self, g, x, y, side: float):
        self.side = side
        names, tile = np.unique(g, return_inverse=True)
        self.names = names
        ix, iy = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
        # codes are relative to the tile, so that few bits suffice; a tile's points lie close together
        self.ox = np.full(len(names), np.iinfo(np.int64).max)
        self.oy = self.ox.copy()
        np.minimum.at(self.ox, tile, ix)
        np.minimum.at(self.oy, tile, iy)
        self.ox, self.oy = (self.ox >> 4 << 4) - 16, (self.oy >> 4 << 4) - 16
        code = self.code(tile, ix, iy)
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]
        self.tile = tile

    def code(self, tile, ix, iy):
        return (tile.astype(np.int64) << 44) | morton(np.clip(ix - self.ox[tile], 0, (1 << 22) - 1), np.clip(iy - self.oy[tile], 0, (1 << 22) - 1))

    def within(self, tile, bx, by, level: int):
        """Bounds, in the sorted points, of the block (bx, by) of 2**level cells a side: one range of codes."""
        lo = self.code(tile, bx << level, by << level)
        return np.searchsorted(self.codes, lo), np.searchsorted(self.codes, lo + (1 << (2 * level)))


def _near(t: _Tiles, row, x, y, who, home, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a home point, any point of its tile of larger id) of different origin within the radius."""
    left = np.flatnonzero(home)
    # a block of two cells a side is as wide as the disc, so that four blocks at most cover it
    width = 2 * t.side
    bx0, bx1 = (np.floor((x[left] + s * radius) / width).astype(np.int64) for s in (-1, 1))
    by0, by1 = (np.floor((y[left] + s * radius) / width).astype(np.int64) for s in (-1, 1))
    out_a, out_b = [], []
    for cx, cy, keep in ((bx0, by0, None), (bx1, by0, bx1 > bx0), (bx0, by1, by1 > by0), (bx1, by1, (bx1 > bx0) & (by1 > by0))):
        own = left if keep is None else left[keep]
        if keep is not None:
            cx, cy = cx[keep], cy[keep]
        lo, hi = t.within(t.tile[own], cx, cy, 1)
        for s in _blocks(hi - lo):
            i, place = _ranges(lo[s], hi[s])
            a, b = own[s][i], t.order[place]
            ok = (row[a] < row[b]) & (who[a] != who[b])
            a, b = a[ok], b[ok]
            ok = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= radius * radius
            out_a.append(row[a[ok]])
            out_b.append(row[b[ok]])
    return np.concatenate(out_a or [np.empty(0, np.int64)]), np.concatenate(out_b or [np.empty(0, np.int64)])


def inside(px: np.ndarray, py: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> np.ndarray:
    """Even-odd test of points against one closed ring each; rows of vx, vy are rings closed and padded with their first vertex."""
    c = np.zeros(len(px), bool)
    for k in range(vx.shape[1] - 1):
        x0, y0, x1, y1 = vx[:, k], vy[:, k], vx[:, k + 1], vy[:, k + 1]
        cross = (y0 > py) != (y1 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            c ^= cross & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
    return c


def _regions(t: _Tiles, x, y, home, rings: list[np.ndarray], ring_g, ring_label) -> np.ndarray:
    """The label of the region around each point, 0 where there is none; the smallest if several contain it."""
    found = np.zeros(len(x), np.int64)
    at = np.searchsorted(t.names, ring_g)
    use = [i for i in range(len(rings)) if at[i] < len(t.names) and t.names[at[i]] == ring_g[i]]
    if not use:
        return found
    level = 3
    width = t.side * (1 << level)
    none = np.iinfo(np.int64).max
    best = np.full(len(x), none)
    use.sort(key=lambda i: len(rings[i]))
    for s in range(0, len(use), 4096):
        part = use[s : s + 4096]
        most = max(len(rings[i]) // 2 for i in part) + 1
        vx, vy = np.empty((len(part), most)), np.empty((len(part), most))
        for k, i in enumerate(part):
            n = len(rings[i]) // 2
            vx[k, :n], vy[k, :n] = rings[i][0 : 2 * n : 2], rings[i][1 : 2 * n : 2]
            vx[k, n:], vy[k, n:] = vx[k, 0], vy[k, 0]
        tile = at[part]
        x0, x1, y0, y1 = vx.min(1), vx.max(1), vy.min(1), vy.max(1)
        # only the part of the region that lies near the tile's own points can hold one of them
        span = 1 << 22
        bx0 = np.maximum(np.floor(x0 / width).astype(np.int64), t.ox[tile] >> level)
        by0 = np.maximum(np.floor(y0 / width).astype(np.int64), t.oy[tile] >> level)
        bx1 = np.minimum(np.floor(x1 / width).astype(np.int64), (t.ox[tile] + span - 1) >> level)
        by1 = np.minimum(np.floor(y1 / width).astype(np.int64), (t.oy[tile] + span - 1) >> level)
        nx, ny = np.maximum(bx1 - bx0 + 1, 0), np.maximum(by1 - by0 + 1, 0)
        # regions far larger than a tile look through the whole tile instead of listing blocks
        big = nx * ny > 4096
        k, j = _ranges(np.zeros(len(part), np.int64), np.where(big, 0, nx * ny))
        bx, by = bx0[k] + j % np.maximum(nx[k], 1), by0[k] + j // np.maximum(nx[k], 1)
        lo, hi = t.within(tile[k], bx, by, level)
        if big.any():
            kb = np.flatnonzero(big)
            k = np.concatenate([k, kb])
            lo = np.concatenate([lo, np.searchsorted(t.codes, tile[kb].astype(np.int64) << 44)])
            hi = np.concatenate([hi, np.searchsorted(t.codes, (tile[kb].astype(np.int64) + 1) << 44)])
        for b in _blocks((hi - lo) * max(1, most // 8)):
            i, place = _ranges(lo[b], hi[b])
            ring, p = k[b][i], t.order[place]
            keep = home[p] & (x[p] >= x0[ring]) & (x[p] <= x1[ring]) & (y[p] >= y0[ring]) & (y[p] <= y1[ring])
            ring, p = ring[keep], p[keep]
            hit = inside(x[p], y[p], vx[ring], vy[ring])
            np.minimum.at(best, p[hit], ring_label[np.asarray(part)[ring[hit]]])
    found[best < none] = best[best < none]
    return found


def _work(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """The task: batches sorted by tile; a tile's rows are together once the next tile begins."""
    side = radius

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ring_at = pc.is_valid(t["ring"]).to_numpy(zero_copy_only=False)
        pts, reg = t.filter(pa.array(~ring_at)), t.filter(pa.array(ring_at))
        if not pts.num_rows:
            return
        g, row, x, y, who = (pts[c].to_numpy() for c in ("g", "row_id", "x", "y", "who"))
        home = pts["home"].to_numpy()
        tiles = _Tiles(g, x, y, side)
        a, b = _near(tiles, row, x, y, who, home, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("near"), len(a)), pa.array(a), pa.array(b)], schema=FOUND)
        flat = reg["ring"].combine_chunks()
        ends, values = (flat.offsets.to_numpy(), flat.values.to_numpy()) if len(flat) else ([0], [])
        rings = [values[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)]
        label = _regions(tiles, x, y, home, rings, reg["g"].to_numpy(), reg["label"].to_numpy())
        known = pts["label"].is_valid().to_numpy(zero_copy_only=False)
        recorded = pts["label"].fill_null(0).to_numpy()
        off = home & known & (recorded != label)
        if off.any():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("region"), int(off.sum())), pa.array(row[off]), pa.array(label[off])], schema=FOUND)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK:
            continue
        t = pa.Table.from_batches(held)
        g = t["g"].to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield from done(t.slice(0, cut))
        rest = t.slice(cut).combine_chunks()
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield from done(pa.Table.from_batches(held))


def _tile(sample: Column, tx: Column, ty: Column, side: int, salt: Column | None = None) -> Column:
    return F.xxhash64(sample, tx, ty, F.lit(side), salt if salt is not None else F.lit(-1))


def _touched(radius: float, side: int) -> Column:
    """The tiles (tx, ty) that the disc around (x, y) touches, the point's own first."""
    at = lambda c, s: F.floor((F.col(c) + s * radius) / side)
    own = F.struct(at("x", 0).alias("tx"), at("y", 0).alias("ty"))
    rest = [F.struct(at("x", i).alias("tx"), at("y", j).alias("ty")) for i in (-1, 1) for j in (-1, 1)]
    return F.array_distinct(F.array(own, *rest))


def near_and_regions(points: DataFrame, regions: DataFrame, radius: float) -> DataFrame:
    """(relation, row_a, row_b): ``near`` pairs of points of a sample and ``region`` labels that contradict the recorded.

    ``points``: (sample_id, row_id BIGINT unique, x, y DOUBLE, origin STRING, label INT); ``regions``: (sample_id, label
    INT, ring ARRAY<INT> x1,y1,...). ``near``: rows of one sample with different ``origin``, at most ``radius`` apart,
    the smaller id first. ``region``: a row whose non-null ``label`` is not the label of the region that holds it (0: none;
    the smallest if several do). Points with a null sample or a null, NaN, infinite or negative coordinate are left out;
    two null origins do not differ. Rings with fewer than three vertices or null elements are ignored; the order of the vertices does not
    matter. Rows at the same place pair like any others.
    """
    big = float("inf")
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < big)
    p = points.where(F.col("sample_id").isNotNull() & ok("x") & ok("y")).select("sample_id", "row_id", "x", "y", F.xxhash64("origin").alias("who"), F.col("label").cast("int").alias("label"))
    r = regions.where("sample_id is not null and label is not null and size(ring) >= 6 and not exists(ring, v -> v is null)").select("sample_id", F.col("label").cast("int").alias("label"), "ring").distinct()

    # the fuller tiles, by a count that is combined before its shuffle; there are at most rows / FULL of them
    def fuller(df: DataFrame, side: int) -> DataFrame:
        tiles = df.groupBy("sample_id", F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty")).count()
        return tiles.where(F.col("count") > FULL)

    hot = [tuple(x) for x in fuller(p, TILE).limit(1).collect()]
    if not hot:
        tasks = _plain(p, TILE, radius).unionByName(_plain_regions(r, TILE))
    else:
        full = fuller(p, TILE).select("sample_id", "tx", "ty")
        own = [F.floor(F.col("x") / TILE).alias("tx"), F.floor(F.col("y") / TILE).alias("ty")]
        # a margin point belongs to the tile it is sent to, so both levels take points from the tiles they touch
        sent = p.select("*", F.posexplode(_touched(radius, TILE)).alias("place", "tile")).select("*", "tile.tx", "tile.ty").drop("tile")
        calm = sent.join(full, ["sample_id", "tx", "ty"], "left_anti").select(_tile(F.col("sample_id"), F.col("tx"), F.col("ty"), TILE).alias("g"), "row_id", "x", "y", "who", "label", (F.col("place") == 0).alias("home"), F.lit(None).cast("array<int>").alias("ring"))
        crowded = p.select("*", *own).join(full, ["sample_id", "tx", "ty"], "left_semi").drop("tx", "ty")
        near = sent.where("place > 0").join(full, ["sample_id", "tx", "ty"], "left_semi").select(*p.columns).join(crowded.select("row_id"), "row_id", "left_anti").dropDuplicates(["row_id"])
        parts = fuller(crowded, SMALL_TILE).select("sample_id", "tx", "ty", F.ceil(F.col("count") / FULL).cast("int").alias("parts"))
        small = crowded.withColumn("inner", F.lit(True)).unionByName(near.withColumn("inner", F.lit(False)))
        small = small.select("*", F.posexplode(_touched(radius, SMALL_TILE)).alias("place", "tile")).select("*", "tile.tx", "tile.ty").drop("tile")
        small = small.withColumn("home", F.col("inner") & (F.col("place") == 0)).join(parts, ["sample_id", "tx", "ty"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        # beyond that, the rows at home in a place are dealt to tasks, each of which sees all the others
        small = small.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).withColumn("home", F.col("home") & (F.pmod(F.xxhash64("row_id"), F.col("parts")) == F.col("salt")))
        inner = small.select(_tile(F.col("sample_id"), F.col("tx"), F.col("ty"), SMALL_TILE, F.col("salt")).alias("g"), "row_id", "x", "y", "who", "label", "home", F.lit(None).cast("array<int>").alias("ring"))
        r_hot = _covered(r, TILE).join(full, ["sample_id", "tx", "ty"], "left_semi").select("sample_id", "label", "ring").distinct()
        fine = _covered(r_hot, SMALL_TILE).join(parts, ["sample_id", "tx", "ty"], "left").select("*", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        fine = _region_rows(fine, SMALL_TILE, F.col("salt"))
        tasks = calm.unionByName(inner).unionByName(_plain_regions(r, TILE)).unionByName(fine)
    spread = tasks.repartition("g").sortWithinPartitions("g")
    return spread.mapInArrow(lambda b: _work(b, radius), "relation string, row_a bigint, row_b bigint")


def _plain(p: DataFrame, side: int, radius: float) -> DataFrame:
    sent = p.select("*", F.posexplode(_touched(radius, side)).alias("place", "tile"))
    return sent.select(_tile(F.col("sample_id"), F.col("tile.tx"), F.col("tile.ty"), side).alias("g"), "row_id", "x", "y", "who", "label", (F.col("place") == 0).alias("home"), F.lit(None).cast("array<int>").alias("ring"))


def _covered(r: DataFrame, side: int) -> DataFrame:
    """Regions once for each tile of their bounding box."""
    at = lambda odd, f: F.floor(f(F.filter("ring", lambda _, i: i % 2 == odd)) / side)
    box = r.select("*", F.explode(F.sequence(F.greatest(at(0, F.array_min), F.lit(0)), F.greatest(at(0, F.array_max), F.lit(0)))).alias("tx"))
    return box.select("*", F.explode(F.sequence(F.greatest(at(1, F.array_min), F.lit(0)), F.greatest(at(1, F.array_max), F.lit(0)))).alias("ty"))


def _region_rows(r: DataFrame, side: int, salt: Column | None = None) -> DataFrame:
    return r.select(_tile(F.col("sample_id"), F.col("tx"), F.col("ty"), side, salt).alias("g"), F.lit(None).cast("bigint").alias("row_id"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("bigint").alias("who"), "label", F.lit(False).alias("home"), "ring")


def _plain_regions(r: DataFrame, side: int) -> DataFrame:
    return _region_rows(_covered(r, side), side)
