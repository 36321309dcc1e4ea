"""The pipelines over a made-up sample folder, through the command line and the Python functions."""

import gzip
import json
import logging
import struct
import tarfile

import numpy as np
import pandas as pd
import pytest

from spotloom import cli, migration, pipelines, sinks
from spotloom.sample import SpatialSample
from spotloom.sources import directory, documents, masks, tables

H, W = 90, 120
CODES = ["ACGTACGTACGTACG", "TTTTTCCCCCGGGGG", "AAAAACCCCCTTTTT", "GGGGGTTTTTAAAAA"]
GENES = ["GeneA", "GeneB", "NCS-ctl", "GeneC"]


def cells_mask():
    m = np.zeros((H, W), np.int32)
    yy, xx = np.mgrid[:H, :W]
    for k, (cy, cx) in enumerate([(20, 20), (20, 60), (20, 100), (60, 20), (60, 60), (60, 100)], 1):
        m[(yy - cy) ** 2 + (xx - cx) ** 2 <= 100] = k
    return m


def jp2(path, h, w):
    path.write_bytes(b"\0\0\0\x0cjP  \r\n\x87\n" + struct.pack(">I", 22) + b"ihdr" + struct.pack(">II", h, w) + b"\0" * 6)


@pytest.fixture
def sample_dir(spark, tmp_path):
    root = tmp_path / "sample"
    for d in ("rna", "h_and_e", "segmentation", "single_cell_data", "protein", "x_viewer"):
        (root / d).mkdir(parents=True)
    (root / "run_meta.json").write_text(json.dumps({"platform": "p", "run_id": "r1", "fc": "f", "software_version": "1", "transcript_panel": "t", "protein_panel": "q"}))
    (root / "samplesheet.csv").write_text("")
    (root / "summary_S-1.html").write_text("")
    panel = [f"{g}-{c}-{p}" for g, c, p in zip(GENES, CODES, ["SP1", "SP1", "SP1", "m7a"])]
    pd.DataFrame({"probe_name": [*panel, "odd"], "panel_type": ["base", "base", "control", "custom", None]}).to_csv(root / "transcript_panel.csv", index=False)
    pd.DataFrame({"target": ["CD8", "CD3"], "panel_type": ["a", "b"]}).to_csv(root / "protein_panel.csv", index=False)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        k = i % 4
        s = CODES[k] if i % 10 else "ACGTNCGTACGTACG" if i % 20 else "CATCATCATCATCAT"
        rows.append((f"t{i}_{2 if k == 3 else 1}", s, float(rng.uniform(0.5, 1)), float(rng.uniform(-2, H)), float(rng.uniform(0, W)), int(i % 3)))
    f = pd.DataFrame(rows, columns=["TXUID", "sequence", "confidence_score", "y_pixel_coordinate", "x_pixel_coordinate", "z_level"])
    f.to_parquet(root / "rna" / "raw_features.parquet", index=False)
    t = f.assign(probe_name=panel[0], gene_name="GeneA", cell_id="S-1-0").drop(columns="sequence")
    t.to_csv(root / "rna" / "transcript_table.csv.gz", index=False)
    m = cells_mask()
    nuclei = np.where(m > 0, m, 0)
    nuclei[m == 3] = 0
    np.savez(root / "segmentation" / "segmentation_mask.npz", nuclei=nuclei, nuclei_exp=m)
    for name in ("nuclear", "h_and_e"):
        jp2(root / "h_and_e" / f"{name}.jp2", H, W)
    yy, xx = np.mgrid[:H, :W]
    np.save(root / "h_and_e" / "nuclear.npy", yy + xx)
    for name, img in (("CD3", yy), ("CD8", xx)):
        np.save(root / "protein" / f"{name}.npy", img.astype(np.int32))
    np.savez(root / "protein" / "bead_mask.npz", bead_mask=(yy < 15))
    (root / "single_cell_data" / "feature_matrix").mkdir()
    v = root / "x_viewer"
    for name in ("multiplex.ome.tiff", "HE.ome.tiff"):
        (v / f"S-1_{name}").write_bytes(b"tiff")
    (v / "S-1_run_metadata.json").write_text(json.dumps({"run_metadata": {"transcript_panel": "old"}}))
    return root


@pytest.fixture
def sample(spark, sample_dir):
    return SpatialSample(spark, sample_dir)


def read_gz(path):
    with gzip.open(path, "rt") as f:
        return pd.read_csv(f)


def test_sample(sample, sample_dir):
    assert sample.sample_id == "S-1" and sample.shape == (H, W) and sample.tile_side == 512
    assert sample.genes == sorted(GENES) and sample.transcript_panel["GeneC"] == "custom" and sample.proteins == ["CD3", "CD8"]
    assert "S-1 of r1" in repr(sample) and "2 [CD3, CD8" in repr(sample)
    assert sample.load_transcript_table(["TXUID", "z_level"]).dtypes == [("TXUID", "string"), ("z_level", "int")]
    assert (sample.load_segmentation(expanded=False) != sample.load_segmentation()).any()
    assert sample.load_image("protein", protein="CD8")[0, 5] == 5
    assert sample.load_image("nuclear")[1, 5] == 6 and sample.load_image("nuclear") is sample.load_image("nuclear")
    with pytest.raises(ValueError, match="decoder"):
        sample.load_image("h_and_e")
    with pytest.raises(ValueError, match="panel"):
        sample.image_path("protein", protein="CD99")
    assert sample.load_bead_runs().selectExpr('sum(x1 - x0)').first()[0] == 15 * W
    assert sample.list_content()["dirs"] == ["h_and_e", "protein", "rna", "segmentation", "single_cell_data", "x_viewer"]
    assert sample.validate().ok
    parts = list(tables.batches(sample.load_feature_table().repartition(3), 150))
    assert [p.num_rows for p in parts] == [150, 150, 100] and len({x for p in parts for x in p["TXUID"].to_pylist()}) == 400


def test_redemux_then_the_rest(sample, sample_dir, tmp_path):
    out = tmp_path / "out"
    pipelines.redemux(sample, out, manifest=sample_dir / "transcript_panel.csv", verbose=0)
    to = out / "redemux"
    t = read_gz(to / "rna" / "transcript_table.csv.gz")
    f = pd.read_parquet(sample_dir / "rna" / "raw_features.parquet")
    good = f[[any(sum(a != b for a, b in zip(s, c)) <= 2 for c in CODES) for s in f["sequence"]]]
    assert sorted(t["TXUID"]) == sorted(good["TXUID"]) and set(t["gene_name"]) == set(GENES)
    m = cells_mask()
    want = [f"S-1-{m[int(y), int(x)] if y >= 0 else 0}" for y, x in zip(t["y_pixel_coordinate"], t["x_pixel_coordinate"])]
    assert t["cell_id"].tolist() == want
    wide = read_gz(to / "single_cell_data" / "cell_by_transcript.csv.gz")
    assert wide["label"].tolist() == [f"S-1-{k}" for k in range(1, 7)] and wide.columns.tolist()[1:] == sorted(GENES)
    assert wide.iloc[:, 1:].to_numpy().sum() == (t["cell_id"] != "S-1-0").sum()
    protein = read_gz(to / "single_cell_data" / "cell_by_protein.csv.gz").set_index("label").sort_index()
    yy, xx = np.mgrid[:H, :W]
    for k in range(1, 7):
        own = (m == k) & (yy >= 15)
        assert np.isclose(protein.loc[f"S-1-{k}", "CD3_intensity_mean"], yy[own].mean()) and np.isclose(protein.loc[f"S-1-{k}", "CD8_intensity_mean"], xx[own].mean())
    meta = read_gz(to / "single_cell_data" / "cell_metadata.csv.gz").set_index("label")
    assert np.isclose(meta.loc["S-1-4", "cell_y"], 60) and np.isclose(meta.loc["S-1-4", "area_um"], (m == 4).sum() * 0.3125**2)
    msg = documents.decode_cells((to / "x_viewer" / "S-1_segmentation.bin").read_bytes())
    assert sorted(c.cellId for c in msg.cellMasks) == [f"S-1-{k}" for k in range(1, 7)] and msg.colormap[0].clusterId == "unassigned"
    for c in msg.cellMasks:
        k = int(c.cellId.split("-")[-1])
        assert list(c.vertices[:2]) == list(c.vertices[-2:]) and len(c.vertices) >= 10 and c.area == int((m == k).sum() * 0.3125**2)
        assert sum(c.nonzeroGeneValues) == c.totalCounts == wide.set_index("label").loc[c.cellId].sum() and len(c.proteinValues) == 2
    with tarfile.open(to / "x_viewer" / "S-1_transcripts.tar") as tar:
        names = tar.getnames()
        config = json.load(tar.extractfile("transcripts/config.json"))
        finest = [n for n in names if n.startswith(f"transcripts/{config['layers']}/")]
        points = [p for n in finest for p in documents.decode_tile(tar.extractfile(n).read())]
    inside = t[(t["y_pixel_coordinate"] >= 0)]
    assert len(points) == len(inside) and config["layer_height"] == H and len(finest) == 4
    assert json.loads((to / "run_meta.json").read_text())["transcript_panel"] == "transcript_panel.csv"
    assert "redemuxed_timestamp" in json.loads((to / "x_viewer" / "S-1_run_metadata.json").read_text())["run_metadata"]

    # clusters, colours and an embedding onto the cell file
    md = tmp_path / "meta.csv"
    pd.DataFrame({"label": [f"S-1-{k}" for k in range(1, 6)], "cl": list("abbca"), "col": ["#102030", "#000000", "#000000", "#FFFFFF", "#102030"], "e_1": range(5), "e_2": range(5, 10)}).to_csv(md, index=False)
    path = pipelines.update_bin(sample, out, metadata=md, bin_file=to / "x_viewer" / "S-1_segmentation.bin", cluster_key="cl", cluster_color_key="col", emb_key="e", verbose=0)
    new = documents.decode_cells(path.read_bytes())
    by = {c.cellId: c for c in new.cellMasks}
    assert [by[f"S-1-{k}"].clusterId for k in range(1, 7)] == ["a", "b", "b", "c", "a", "-1"] and by["S-1-2"].umapValues.umapX == 1 and np.isnan(by["S-1-6"].umapValues.umapY)
    assert {c.clusterId: list(c.color) for c in new.colormap} == {"a": [16, 32, 48], "b": [0, 0, 0], "c": [255, 255, 255], "-1": [191, 191, 191]}
    assert list(new.metadata.geneNames) == list(msg.metadata.geneNames) and by["S-1-2"].totalCounts == {c.cellId: c.totalCounts for c in msg.cellMasks}["S-1-2"]
    with pytest.raises(RuntimeError, match="nope"):
        pipelines.update_bin(sample, out, metadata=md, bin_file=to / "x_viewer" / "S-1_segmentation.bin", cluster_key="nope", verbose=0)
    with pytest.raises(RuntimeError, match="e2_1"):
        pipelines.update_bin(sample, out, metadata=md, bin_file=to / "x_viewer" / "S-1_segmentation.bin", emb_key="e2", verbose=0)


def test_resegment_by_the_command_line(spark, sample, sample_dir, tmp_path):
    m = np.zeros((H, W), np.int32)
    m[10:40, 10:50] = 7
    m[50:80, 60:110] = 9
    np.save(tmp_path / "new.npy", m)
    assert cli.main(["-v", "0", "resegment", str(sample_dir), "--cell-labels", str(tmp_path / "new.npy")]) == 0
    to = sample_dir / "spotloom" / "resegment"
    t = read_gz(to / "rna" / "transcript_table.csv.gz")
    assert set(t["cell_id"]) == {"S-1-0", "S-1-7", "S-1-9"} and len(t) == 400
    assert (np.load(to / "segmentation" / "segmentation_mask.npz")["cell_labels"] == m).all()
    feats = [{"type": "Feature", "properties": {"label": k}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for k, ring in ((7, [[10, 10], [50, 10], [50, 40], [10, 40], [10, 10]]), (9, [[60, 50], [110, 50], [110, 80], [60, 80], [60, 50]]))]
    (tmp_path / "new.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    pipelines.resegment(sample, tmp_path / "geo", cell_labels=tmp_path / "new.geojson", verbose=0)
    assert (np.load(tmp_path / "geo" / "resegment" / "segmentation" / "segmentation_mask.npz")["cell_labels"] == m).all()
    np.save(tmp_path / "small.npy", m[:5])
    assert cli.main(["-v", "0", "resegment", str(sample_dir), "--cell-labels", str(tmp_path / "small.npy")]) == 1
    assert cli.main(["-v", "0", "validate", str(sample_dir)]) == 0
    assert cli.main(["-v", "0", "tar_viewer", str(sample_dir)]) == 1  # there is no cell file yet


def test_images_without_a_decoder(spark, sample, sample_dir, tmp_path):
    """They are no reason for tables without their columns: the same cells' own table serves, else it is an error."""
    (sample_dir / "protein" / "CD8.npy").rename(sample_dir / "protein" / "CD8.jp2")
    same = sample_dir / "segmentation" / "segmentation_mask.npz"
    with pytest.raises(RuntimeError, match="no decoder.*CD8"):
        pipelines.redemux(sample, tmp_path / "a", manifest=sample_dir / "transcript_panel.csv", verbose=0)
    pd.DataFrame({"label": [f"S-1-{k}" for k in range(1, 7)], "CD3_intensity_mean": 0.0, "CD8_intensity_mean": [10.5 * k for k in range(1, 7)]}).to_csv(sample_dir / "single_cell_data" / "cell_by_protein.csv.gz", index=False)
    pipelines.resegment(sample, tmp_path / "b", cell_labels=same, labels_key="nuclei_exp", verbose=0)
    t = read_gz(tmp_path / "b" / "resegment" / "single_cell_data" / "cell_by_protein.csv.gz").set_index("label")
    assert t.loc["S-1-3", "CD8_intensity_mean"] == 31.5 and t.loc["S-1-3", "CD3_intensity_mean"] > 10
    np.save(tmp_path / "new.npy", np.roll(cells_mask(), 3, 1))
    with pytest.raises(RuntimeError, match="no decoder.*CD8"):
        pipelines.resegment(sample, tmp_path / "c", cell_labels=tmp_path / "new.npy", verbose=0)
    assert cli.main(["-v", "0", "resegment", str(sample_dir), "--cell-labels", str(tmp_path / "new.npy"), "--without", "CD8"]) == 0
    assert list(read_gz(sample_dir / "spotloom" / "resegment" / "single_cell_data" / "cell_by_protein.csv.gz").columns) != []
    (sample_dir / "protein" / "CD8.jp2").unlink()
    with pytest.raises(RuntimeError, match="CD8"):
        pipelines.redemux(sample, tmp_path / "d", manifest=sample_dir / "transcript_panel.csv", verbose=0)


def test_geojson_holes_and_order(spark, tmp_path):
    box = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    feats = [
        (5, "Polygon", [box(0, 0, 20, 20), box(5, 5, 10, 10)]),
        (6, "MultiPolygon", [[box(15, 15, 30, 30)], [box(40, 0, 50, 10), box(42, 2, 44, 4)]]),
        (5, "Polygon", [box(28, 28, 34, 34)]),
        (7, "Point", [1, 1]),
    ]
    text = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"label": k, "name": "x"}, "geometry": {"type": t, "coordinates": c}} for k, t, c in feats]}
    (tmp_path / "g.geojson").write_text(json.dumps(text))
    want = np.zeros((40, 60), np.int32)
    want[:20, :20] = 5
    want[5:10, 5:10] = 0
    want[15:30, 15:30] = want[:10, 40:50] = 6
    want[2:4, 42:44] = 0
    want[28:34, 28:34] = 5
    runs = masks.rasterized(masks.geojson_polygons(spark, str(tmp_path / "g.geojson"), "s"))
    assert (masks.runs_to_mask(runs, want.shape) == want).all()
    with pytest.raises(KeyError):
        masks.geojson_polygons(spark, str(tmp_path / "g.geojson"), "s", "nothing")


def test_printed_lines_are_logged(sample, sample_dir, monkeypatch):
    from spotloom import migration as m

    monkeypatch.setattr(m, "file_verdicts", lambda *_: print("a printed line") or {})
    pipelines.validate(sample, verbose=0)
    assert "a printed line" in (sample_dir / "logs" / "validate.log").read_text()


def test_row_index_follows_the_rows(spark):
    df = spark.range(0, 1000, 1, 7).where("id % 3 <> 0")
    got = tables.with_row_index(df, "at").collect()
    assert [r["at"] for r in got] == list(range(len(got))) and [r["id"] for r in got] == [i for i in range(1000) if i % 3]
    assert tables.with_row_index(df.limit(0), "at").count() == 0


def test_viewer_archive(sample, sample_dir, tmp_path):
    (sample_dir / "x_viewer" / "S-1_segmentation.bin").write_bytes(documents.encode_frame([("a", [1, 2, 3])]))
    path = pipelines.tar_viewer(sample, tmp_path / "o", verbose=0)
    with tarfile.open(path) as tar:
        names = set(tar.getnames())
        config = json.load(tar.extractfile("x_viewer/dataset.config.json"))
    assert {"x_viewer/h_and_e/S-1_HE.ome.tiff", "x_viewer/S-1_segmentation.bin"} <= names and config["cell_segmentation_src"] == "S-1_segmentation.bin"
    assert (sample_dir / "x_viewer" / "S-1_HE.ome.tiff").exists()


def test_mask_files(spark, tmp_path):
    m = cells_mask()
    np.savez(tmp_path / "two.npz", a=m, b=m + 1)
    np.savez(tmp_path / "one.npz", a=m)
    np.save(tmp_path / "m.npy", m)
    assert (masks.load_mask(tmp_path / "one.npz") == m).all() and (masks.load_mask(tmp_path / "two.npz", m.shape, "b") == m + 1).all() and (masks.load_mask(tmp_path / "m.npy", m.shape, "any") == m).all()
    for path, kind, args in (("two.npz", ValueError, ()), ("two.npz", KeyError, (None, "c")), ("m.npy", ValueError, ((1, 2),)), ("m.tif", ValueError, ())):
        with pytest.raises(kind):
            masks.load_mask(tmp_path / path, *args)


def older(sample_dir, broken=False):
    """The folder as an older version left it."""
    f = pd.read_parquet(sample_dir / "rna" / "raw_features.parquet")
    f = f.rename(columns={"sequence": "sequence_to_demux", "confidence_score": "meanQS", "y_pixel_coordinate": "x_coord_shift", "x_pixel_coordinate": "y_coord_shift", "z_level": "z"})
    f["transcript"], f["transcript_condensed"] = "GeneA-ACGTACGTACGTACG-SP1", "GeneA"
    (sample_dir / "rna" / "raw_features.parquet").unlink()
    (sample_dir / "diagnostics").mkdir()
    f.to_parquet(sample_dir / "diagnostics" / "transcript_table.parquet", index=False)
    pd.DataFrame({"target_condensed": ["GeneA", "GeneZ"], "panel_type": ["base", "custom"]}).to_csv(sample_dir / "transcript_panel.csv", index=False)
    v = sample_dir / "x_viewer"
    (v / "S-1_multiplex.ome.tiff").rename(v / "S-1.ome.tiff")
    (v / "S-1_run_metadata.json").write_text('{"run_metadata": {"a": NaN, "b": "is NaN: NaN", "c": [NaN]}}')
    if broken:
        (sample_dir / "samplesheet.csv").unlink()


def everything(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file() and "logs" not in p.parts}


def test_migrate_and_back(spark, sample_dir):
    older(sample_dir)
    pd.DataFrame({"cell_id": ["S-1-1"], "cell_x": [1.0], "cell_y": [2.0], "expanded_cell_x": [3.0], "expanded_cell_y": [4.0], "nuclei_area": [100.0], "nuclei_expanded_area": [200.0], "z_intensity_mean": [1.0]}).to_parquet(sample_dir / "single_cell_data" / "feature_matrix" / "obs.parquet")
    before = everything(sample_dir)
    s = SpatialSample(spark, sample_dir)
    assert pipelines.migrate(s, verbose=0)
    assert sorted(pd.read_parquet(sample_dir / "rna" / "raw_features.parquet").columns) == sorted(["TXUID", "sequence", "confidence_score", "y_pixel_coordinate", "x_pixel_coordinate", "z_level"])
    panel = pd.read_csv(sample_dir / "transcript_panel.csv")
    assert panel["probe_name"].tolist() == ["GeneA-ACGTACGTACGTACG-SP1", "NOT_CONVERTED"]
    obs = pd.read_parquet(sample_dir / "single_cell_data" / "feature_matrix" / "obs.parquet")
    assert obs.columns.tolist() == ["cell_id", "cell_x", "cell_y", "nuclei_area_um", "nuclei_expanded_area_um", "z_intensity_mean"] and obs.iloc[0, 1:4].tolist() == [2.0, 1.0, 9.765625]
    assert json.loads((sample_dir / "x_viewer" / "S-1_run_metadata.json").read_text())["run_metadata"] == {"a": "NaN", "b": "is NaN: NaN", "c": ["NaN"]}
    assert (sample_dir / "x_viewer" / "S-1_multiplex.ome.tiff").exists()
    older_again = sample_dir / "samplesheet.csv"
    older_again.unlink()
    with pytest.raises(migration.MigrationError, match="backup"):
        pipelines.migrate(s, verbose=0)
    older_again.write_text("")
    assert pipelines.migrate(s, restore=True, verbose=0)
    assert everything(sample_dir) == before
    assert not pipelines.migrate(s, restore=True, verbose=0)


def test_failed_migration_changes_nothing(spark, sample_dir):
    older(sample_dir, broken=True)
    before = everything(sample_dir)
    with pytest.raises(migration.MigrationError):
        migration.migrate(spark, sample_dir, "S-1", logging.getLogger("t"))
    assert everything(sample_dir) == before and not (sample_dir / migration.BACKUP).exists()


def test_layout(sample_dir):
    (sample_dir / "diagnostics").mkdir()
    (sample_dir / "diagnostics" / "transcript_table.parquet").write_text("")
    (sample_dir / "summary_S-1.html").rename(sample_dir / "summary_T.html")
    r = directory.check_layout(sample_dir, "S-1")
    assert r.missing == ["summary_S-1.html"] and r.forbidden == ["diagnostics/transcript_table.parquet"] and not r.ok
    assert directory.infer_sample_id(sample_dir) == "T"
    (sample_dir / "summary_2.html").write_text("")
    with pytest.raises(directory.ValidationError):
        directory.infer_sample_id(sample_dir)


def test_command_line_help(capsys):
    assert cli.main([]) == 0
    text = capsys.readouterr().out
    assert all(c in text for c in ("resegment", "redemux", "update_bin", "new_bin", "tar_viewer", "migrate", "validate"))
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0


def test_lazy_exports():
    import spotloom

    assert spotloom.redemux is pipelines.redemux and spotloom.SpatialSample is SpatialSample
    with pytest.raises(AttributeError):
        spotloom.nothing  # noqa: B018


def test_documents_survive_damage(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(b"\xff\xff\xff")
    assert documents.read_cell_file(spark, tmp_path / "bad.bin") is None
    rows = [{"cellId": f"c{i}", "clusterId": "1", "vertices": [1, 2, 3], "area": i, "umapValues": None} for i in range(5)]
    (tmp_path / "ok.bin").write_bytes(documents.encode_cells(rows[:2]) + documents.encode_frame([("1", [0, 0, 1])], ["g"]) + documents.encode_cells(rows[2:]))
    got = documents.read_cell_file(spark, tmp_path / "ok.bin").collect()
    assert [r["cellId"] for r in got] == ["c0", "c1", "c2", "c3", "c4"] and np.isnan(got[0]["umapValues"]["umapX"])


def test_csv_in_one_file_or_many(spark, tmp_path):
    df = spark.range(10).repartition(3)
    sinks.write_csv_gz(df, tmp_path / "a.csv.gz")
    sinks.write_csv_gz(df, tmp_path / "b.csv.gz", single=False)
    assert (tmp_path / "a.csv.gz").is_file() and (tmp_path / "b.csv.gz").is_dir()
    assert tables.load_table(spark, tmp_path / "a.csv.gz").count() == spark.read.csv(str(tmp_path / "b.csv.gz"), header=True).count() == 10
