import math

import pytest

from spotloom.functions.color import hex_to_rgb, hue_to_rgb
from spotloom.operators import cells, evolution, viewer
from spotloom.schemas import PALETTE


def test_counts_of_odd_rows(spark):
    t = spark.createDataFrame([("s", 1, "A"), ("s", 1, "A"), ("s", 0, "A"), ("s", 2, None), ("s", None, "B"), (None, 1, "A"), ("s", 2, "B")], "sample_id string, label int, gene_name string")
    c = cells.cell_by_gene(t)
    assert sorted(map(tuple, c.collect())) == [("s", 1, "A", 2), ("s", 2, "B", 1)]
    index = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("s", 3, 0), ("s", 3, 0)], "sample_id string, label int, counts int")
    genes = spark.createDataFrame([("A",), ("B",), ("C",), (None,), ("A",)], "gene_name string")
    full = {(r.label, r.gene_name): r.counts for r in cells.zero_completed(c, index, genes).collect()}
    assert len(full) == 9 and sum(full.values()) == 3 and full[3, "C"] == 0
    assert cells.zero_completed(c, index, genes.limit(0)).count() == 0 and cells.zero_completed(c.limit(0), index, genes).count() == 9
    wide = {r.label: (r.A, r.B, r.C) for r in cells.wide_counts(c, index, ["C", "A", "B"]).collect()}
    assert wide == {1: (2, 0, 0), 2: (0, 1, 0), 3: (0, 0, 0)}
    assert [r[0] for r in cells.missing_genes(c, genes).collect()] == ["C"]
    long = cells.zero_completed(c, index, genes)
    q = {r.label: (r.n_genes_by_counts, r.total_counts, r.log1p_total_counts) for r in cells.qc_cells(long).collect()}
    assert q == {1: (1, 2, math.log1p(2)), 2: (1, 1, math.log1p(1)), 3: (0, 0, 0.0)}
    g = {r.gene_name: (r.n_cells_by_counts, r.mean_counts, round(r.pct_dropout_by_counts, 6)) for r in cells.qc_genes(long, 3).collect()}
    assert g == {"A": (1, 2 / 3, 66.666667), "B": (1, 1 / 3, 66.666667), "C": (0, 0.0, 100.0)}


def test_keys_must_agree(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "label string") for xs in (["1", "2", "2", None], ["2", "3"]))
    assert sorted(map(tuple, cells.key_differences(a, b).collect())) == [("1", "left"), ("3", "right")]
    with pytest.raises(ValueError, match="differ"):
        cells.require_same_keys(a, b)
    cells.require_same_keys(a, a)


def test_sparse_genes(spark):
    c = spark.createDataFrame([("a", "G2", 3), ("a", "G1", 1), ("b", "G3", 0), ("b", "G2", 5)], "label string, gene_name string, counts int")
    assert {r.label: (r.indices, r.values) for r in cells.sparse_genes(c).collect()} == {"a": ([0, 1], [1, 3]), "b": ([1], [5])}


@pytest.mark.parametrize("n", [0, 3, 20, 21, 60])
def test_palettes(spark, n):
    c = spark.createDataFrame([(f"{i:03d}",) for i in range(n)] * 2 + [("-1",), (None,)], "cluster_id string")
    p = {r.cluster_id: list(r.color) for r in viewer.generated_palette(c).collect()}
    assert len(p) == n + 1 and p["-1"] == [191, 191, 191] and all(0 <= v <= 255 for x in p.values() for v in x)
    if 0 < n <= 20:
        assert [p[f"{i:03d}"] for i in range(n)] == [[int(h[k : k + 2], 16) for k in (1, 3, 5)] for h in PALETTE[:n]]
    if n > 20:
        assert len({tuple(v) for v in p.values()}) == n + 1


def test_colors(spark):
    import colorsys

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i / 97,) for i in range(97)], "h double")
    got = [list(r[0]) for r in df.select(hue_to_rgb(F.col("h"))).collect()]
    want = [[int(255 * v) for v in colorsys.hsv_to_rgb(i / 97, 1, 1)] for i in range(97)]
    assert all(abs(a - b) <= 1 for x, y in zip(got, want) for a, b in zip(x, y))
    bad = spark.createDataFrame([("red",), (None,), ("#12345",), ("#aAbBcC",)], "c string").select(hex_to_rgb(F.col("c"))).collect()
    assert [r[0] for r in bad] == [None, None, None, [170, 187, 204]]


def test_metadata_defaults_and_errors(spark):
    docs = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "cell_id string")
    m = spark.createDataFrame([("a", 2, "#000000", 1.0, 2.0), ("a", 1, "#FFFFFF", 3.0, 4.0), (None, 5, None, None, None)], "id string, cl int, col string, e_1 double, e_2 double")
    got = {r.cell_id: tuple(r)[1:] for r in viewer.canonical_metadata(docs, m, "id", "cl", "col", "e").collect()}
    assert got["a"] == ("1", "#FFFFFF", 3.0, 4.0) and got["b"][:2] == ("-1", "#BFBFBF") and math.isnan(got["b"][2]) and "unknown_cell" in got
    for kw in ({"cluster": "x"}, {"embedding": "cl"}):
        with pytest.raises(KeyError):
            viewer.canonical_metadata(docs, m, "id", **kw)
    with pytest.raises(ValueError):
        viewer.canonical_metadata(docs, m, "id", None, "col")
    assert [r[0] for r in viewer.unmatched_cells(docs, m, "id").collect()] == ["b"]


def test_columns_are_guessed():
    assert viewer.infer_cluster_column(["x", "leiden_0.8", "leiden_0.4"]) == "leiden_0.4" and viewer.infer_cluster_column(["x"]) is None
    assert viewer.infer_embedding(["X_umap_0_2", "X_umap_0_1", "a"]) == "X_umap_0" and viewer.infer_embedding([]) is None
    assert viewer.area_column(["area_um", "x"]) == "area_um" and viewer.area_column(["nuclei_area_um", "nuclei_expanded_area_um"]) == "nuclei_expanded_area_um"
    for columns in ([], ["area_a", "area_b"]):
        with pytest.raises(ValueError):
            viewer.area_column(columns)


def test_pyramid_geometry():
    assert viewer.tile_counts_of((1000, 3000), 512) == (2, 6) and viewer.pyramid_levels((100, 100), 512) == 1
    for shape in ((100, 100), (20_000, 30_000), (5_000, 90_000)):
        n = viewer.pyramid_levels(shape, 512)
        assert math.prod(viewer.tile_counts_of(shape, 512 * 2**n)) <= 16
        assert n == 1 or math.prod(viewer.tile_counts_of(shape, 512 * 2 ** (n - 1))) > 16
    assert viewer.tile_side("x-2lane") == 1028 and viewer.tile_side(None) == 512


def test_levels_keep_their_share(spark):
    pts = spark.createDataFrame([(i, float(i * 7 % 3000), float(i * 13 % 2500)) for i in range(1000)] + [(2000, None, 1.0), (2001, float("nan"), 1.0), (2002, -1.0, 1.0)], "id int, x_pixel_coordinate double, y_pixel_coordinate double")
    levelled = viewer.on_levels(viewer.assign_tiles(pts), 2)
    assert levelled.groupBy("level").count().where("count <> 1000").count() == 0
    kept = viewer.sample_levels(levelled, 2, "id", [])
    full = {(r.level, r.tile_x): r["count"] for r in levelled.groupBy("level", "tile_x").count().collect()}
    part = {(r.level, r.tile_x): r["count"] for r in kept.groupBy("level", "tile_x").count().collect()}
    assert all(part.get(k, 0) == math.floor(n * 0.2 ** (2 - k[0]) + 1e-9) for k, n in full.items())
    again = viewer.sample_levels(levelled.repartition(7), 2, "id", [])
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_classification():
    f = ["TXUID", "sequence", "confidence_score", "x_pixel_coordinate", "y_pixel_coordinate", "z_level"]
    assert evolution.classify_features(f) == "valid" and evolution.classify_features([*f, "more"]) == "unknown"
    assert evolution.classify_features(["cell_id", "gene_name", "probe_name", "demuxed", "x"]) == "invalid"
    assert evolution.classify_cells(["nuclei_area_um", "nuclei_expanded_area_um"]) == evolution.classify_cells(["area_um"]) == "valid"
    assert evolution.classify_cells(["centroid-0", "centroid-1"]) == "invalid" and evolution.classify_cells(["x"]) == "unknown"


def test_centroid_columns_go(spark):
    df = spark.createDataFrame([(1.0, "c", 2.0, 3.0, 4.0)], ["centroid-0", "cell_id", "centroid-1", "b_intensity_mean", "nuclearstain_intensity_mean"])
    assert evolution.upgrade_cells(df).columns == ["cell_id", "nuclearstain_intensity_mean", "b_intensity_mean"]


def test_panels(spark):
    p = lambda *names: spark.createDataFrame([(n,) for n in names], "probe_name string")
    assert evolution.classify_panel(p("A-ACGT-SP1", "NOT_CONVERTED")) == "valid" == evolution.classify_panel(p("x").limit(0))
    assert evolution.classify_panel(p("A-ACGT-SP1", "bad")) == "unknown" == evolution.classify_panel(p(None))
    assert evolution.classify_panel(p("bad").withColumnRenamed("probe_name", "target_condensed")) == "invalid"
