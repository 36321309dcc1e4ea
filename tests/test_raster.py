import numpy as np
import pytest

from spotloom.operators import cells, polygons, raster
from spotloom.sources import masks


def pixels(spark, m, sample="s"):
    y, x = np.nonzero(m)
    return spark.createDataFrame([(sample, int(a), int(b), int(m[a, b])) for a, b in zip(y, x)], "sample_id string, y int, x int, label int")


def shift(m, dy, dx, fill):
    out = np.full(m.shape, fill)
    h, w = m.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = m[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def blobs(seed, n=40):
    rng = np.random.default_rng(seed)
    m = np.zeros((n, n), int)
    yy, xx = np.mgrid[:n, :n]
    for k in range(1, 12):
        cy, cx, r = rng.integers(0, n), rng.integers(0, n), rng.integers(2, 7)
        m[(yy - cy) ** 2 + (xx - cx) ** 2 <= r * r] = k
    return m


@pytest.mark.parametrize("seed,tile", [(1, 512), (2, 16), (5, 7)])
def test_borders_and_outlines_follow_dilation_and_erosion(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(raster, "TILE", tile)
    m = blobs(seed)
    p = masks.mask_runs(spark, m, "s")
    border = m != np.max([m] + [shift(m, *s, 0) for s in SIDES], axis=0)
    assert {(r.y, r.x) for r in raster.border_pixels(p).collect() if r.y < 40 and r.x < 40} == set(zip(*map(lambda a: a.tolist(), np.nonzero(border))))
    z = np.where(border, 0, m)
    eroded = np.min([z] + [shift(z, *s, 10**6) for s in SIDES], axis=0)
    edge = (z != 0) & (eroded == 0)
    want = {(int(a), int(b), int(m[a, b])) for a, b in zip(*np.nonzero(edge))}
    assert {(r.y, r.x, r.label) for r in raster.outline_pixels(p, m.shape).collect()} == want


def test_runs_pixels_and_properties(spark):
    m = blobs(3)
    runs = masks.mask_runs(spark, m, "s")
    assert sorted((r.y, r.x, r.label) for r in raster.runs_to_pixels(runs).collect()) == sorted((int(y), int(x), int(m[y, x])) for y, x in zip(*np.nonzero(m)))
    again = raster.pixels_to_runs(pixels(spark, m))
    key = lambda d: sorted((r.y, r.x0, r.x1, r.label) for r in d.collect())
    assert key(again) == key(runs)
    assert (masks.runs_to_mask(runs, m.shape) == m).all()
    for r in raster.region_properties(runs).collect():
        y, x = np.nonzero(m == r.label)
        assert r.n_pixels == len(y) and np.isclose(r.cell_y, y.mean()) and np.isclose(r.cell_x, x.mean()) and np.isclose(r.area_um, len(y) * 0.3125**2)


def test_look_up_with_impossible_coordinates(spark):
    m = np.zeros((10, 200), int)
    m[2:5, 60:140] = 7
    pts = [(1, 60.0, 2.0), (2, 59.99, 2.0), (3, 139.9, 4.99), (4, None, 3.0), (5, float("nan"), 3.0), (6, -1.0, 3.0), (7, 1e12, 3.0), (8, 100.0, 5.0)]
    df = spark.createDataFrame([("s", *p) for p in pts], "sample_id string, row_id int, x_pixel_coordinate double, y_pixel_coordinate double")
    got = {r.row_id: (r.label, r.cell_id) for r in cells.assign_cells(df, masks.mask_runs(spark, m, "s")).collect()}
    assert {k for k, v in got.items() if v[0] == 7} == {1, 3} and got[1][1] == "s-7" and got[4] == (0, "s-0") and len(got) == 8


def test_rings_take_pixel_centres_and_later_features_win(spark):
    square = [2.0, 2.0, 6.0, 2.0, 6.0, 6.0, 2.0, 6.0]
    rows = [("s", 1, square), ("s", 1, square), ("s", 2, [0, 0, 1]), (None, 3, square), ("s", 4, None)]
    df = spark.createDataFrame([(a, b, None if c is None else list(map(float, c))) for a, b, c in rows], "sample_id string, label int, ring array<double>")
    got = {(r.y, r.x) for r in raster.runs_to_pixels(raster.rings_to_runs(df)).collect()}
    assert got == {(y, x) for y in range(2, 6) for x in range(2, 6)}
    over = spark.createDataFrame([("s", 5, 0, [square]), ("s", 3, 1, [[4.0, 4.0, 8.0, 4.0, 8.0, 8.0, 4.0, 8.0]])], "sample_id string, label int, ordinal int, rings array<array<double>>")
    m = masks.runs_to_mask(masks.rasterized(over), (9, 9))
    assert m[5, 5] == 3 and m[3, 3] == 5 and (m == 3).sum() == 16 and (m == 5).sum() == 12


def test_contours_enclose_their_pixels(spark):
    m = blobs(4)
    for label in np.unique(m[m > 0]):
        y, x = np.nonzero(m == label)
        rings = polygons.contours(y, x)
        assert all((r[0] == r[-1]).all() for r in rings)
        # shoelace over outer rings and holes: pixels, less an eighth at each corner that is cut
        area = sum(0.5 * np.sum(r[:-1, 1] * r[1:, 0] - r[1:, 1] * r[:-1, 0]) for r in rings)
        assert 0.4 * len(y) <= abs(area) <= len(y)


def test_outline_ring_of_a_disc():
    t = np.linspace(0, 2 * np.pi, 400)
    pts = np.unique(np.round(np.stack([20 + 9 * np.sin(t), 20 + 9 * np.cos(t)], 1)).astype(int), axis=0)
    ring = polygons.smooth_ring(pts[:, 0], pts[:, 1])
    assert 5 <= len(ring) < len(pts) / 2 and set(map(tuple, ring.astype(int))) <= set(map(tuple, pts))
    area = 0.5 * abs(np.dot(ring[:, 1], np.roll(ring[:, 0], 1)) - np.dot(ring[:, 0], np.roll(ring[:, 1], 1)))
    assert abs(area - np.pi * 81) < 60
    assert len(polygons.smooth_ring(np.array([3]), np.array([4]))) == 1


def test_bead_pixels_are_left_out(spark):
    m = np.zeros((4, 4), int)
    m[:, :2], m[:, 2:] = 1, 2
    img = spark.createDataFrame([("s", "c", y, x, float(y * 4 + x)) for y in range(4) for x in range(4)], "sample_id string, channel string, y int, x int, intensity double")
    beads = spark.createDataFrame([("s", y, a, b) for y in range(4) for a, b in ((0, 1), (2, 4))], "sample_id string, y int, x0 int, x1 int")
    got = raster.region_means(raster.pixels_to_image_rows(img), masks.mask_runs(spark, m, "s"), beads).collect()
    assert [(r.label, r.mean_intensity, r.n_pixels) for r in got] == [(1, 7.0, 4)]  # region 2 has no pixel left


def test_image_rows_in_parts_with_nulls(spark):
    m = np.zeros((2, 9), int)
    m[0, 1:8] = 4
    rows = [("s", "c", 0, 0, [1.0, 2.0, None]), ("s", "c", 0, 3, [4.0, 5.0, 6.0, 7.0]), ("s", "c", 0, 7, [8.0, 9.0]), ("s", "c", 1, 0, [100.0] * 9)]
    img = spark.createDataFrame(rows, "sample_id string, channel string, y int, x0 int, intensities array<double>")
    assert [(r.mean_intensity, r.n_pixels) for r in raster.region_means(img, masks.mask_runs(spark, m, "s")).collect()] == [((2 + 4 + 5 + 6 + 7 + 8) / 6, 6)]


@pytest.mark.parametrize("block", [64, 3])
def test_what_beads_cover_is_never_read(spark, monkeypatch, block):
    monkeypatch.setattr(raster, "BLOCK", block)
    m = np.ones((1, 200), int)
    m[0, 100:] = 2
    value = [float(x) for x in range(200)]
    value[5], value[63], value[64], value[150] = float("nan"), float("inf"), float("-inf"), float("nan")
    img = spark.createDataFrame([("s", "c", 0, 0, value)], "sample_id string, channel string, y int, x0 int, intensities array<double>")
    spans = ((0, 1), (5, 6), (60, 70), (98, 103), (199, 200))
    beads = spark.createDataFrame([("s", 0, a, b) for a, b in spans], "sample_id string, y int, x0 int, x1 int")
    got = {r.label: (r.mean_intensity, r.n_pixels) for r in raster.region_means(img, masks.mask_runs(spark, m, "s"), beads).collect()}
    kept = [x for x in range(100) if not any(a <= x < b for a, b in spans)]
    assert got[1] == (sum(kept) / len(kept), len(kept))
    assert np.isnan(got[2][0]) and got[2][1] == 96  # the NaN at 150 is no bead's
