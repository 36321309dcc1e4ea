"""The plans Spark makes of the queries: what is read, how it is joined, and that nothing is paired with everything."""

import re

import pytest

from spotloom.plans import catalogue


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def columns_read(text, table):
    return [set(re.findall(r"(\w+):", s)) for loc, s in re.findall(r"Location: ([^\n]+).*?ReadSchema: struct<([^\n]*)>", text, re.S) if f"{table}.parquet" in loc]


def test_run_sums_stay_with_their_row(spark, sf):
    """A region's mean is made of sums: no pixel array is exploded or shuffled with the runs."""
    text = plan(catalogue.QUERIES["cell_by_protein_long"](spark, sf))
    assert not re.search(r"Generate[^\n]*explode\(_runs", text) and "CartesianProduct" not in text


def _pixels_pass_by(df):
    """The image's rows are neither broadcast, sorted nor shuffled: the runs come to them."""
    tree = plan(df).split("\n\n")[0]
    joined, side = re.search(r"^([ :]*)\+- ShuffledHashJoin[^\n]*BuildRight[^\n]*\n(.*)", tree, re.M | re.S).groups()
    left = side[: side.index("\n" + " " * len(joined) + "   +-")]
    steps = re.findall(r"[A-Z]\w+", left)
    return "Broadcast" not in tree and "Sort" not in left and steps[0] == "Project" and "Generate" in steps[: steps.index("Exchange")]


def test_many_beads_bring_no_image_to_the_driver(spark, sf, monkeypatch):
    from spotloom.operators import raster
    from spotloom.plans import domain

    runs = domain.runs(spark, sf).count()
    monkeypatch.setattr(raster, "BROADCAST_RUNS", runs)  # the beads are more than the runs
    assert _pixels_pass_by(catalogue.QUERIES["region_mean_bead_masked"](spark, sf))


@pytest.mark.parametrize("name", ["cell_by_protein_long", "cell_by_protein_wide"])
def test_many_runs_bring_no_image_to_the_driver(spark, sf, monkeypatch, name):
    from spotloom.operators import raster

    monkeypatch.setattr(raster, "BROADCAST_RUNS", 0)
    df = catalogue.QUERIES[name](spark, sf)
    assert _pixels_pass_by(df) and plan(df).split("\n\n")[0].count("Exchange") <= 4 + name.endswith("wide")  # sizes, rows, runs, sums and the pivot's


def test_level_shares_are_ranked_within_one_prefix(spark, sf):
    """The window that ranks points comes after the join that leaves only those of the last prefix."""
    text = plan(catalogue.QUERIES["tile_sample"](spark, sf))
    assert "_end" in text and "BroadcastNestedLoopJoin" not in text


def test_outlines_are_streamed(spark, sf):
    text = plan(catalogue.QUERIES["cell_polygons"](spark, sf))
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text


def test_many_codes_are_sought_by_segments(spark, sf, monkeypatch):
    from spotloom.operators import demux
    from spotloom.plans import domain

    monkeypatch.setattr(demux, "BROADCAST_CODES", 3)
    text = plan(demux.code_distances(domain.reads(spark, sf), domain.codes(spark, sf)))
    assert re.search(r"(Left keys|Left output).*\bs\b|s#", text) and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_query_pairs_everything(spark, sf, name):
    text = plan(catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, sf):
    assert columns_read(plan(catalogue.QUERIES["scan_project_features"](spark, sf)), "raw_features") == [{"TXUID", "sequence_to_demux"}]
    read = columns_read(plan(catalogue.QUERIES["p2_found"](spark, sf)), "transcript_table")
    assert read == [{"row_id", "probe_name", "recorded_at"}]  # and once only
    read = columns_read(plan(catalogue.QUERIES["cell_by_gene_long"](spark, sf)), "transcript_table")
    assert read == [{"sample_id", "x_pixel_coordinate", "y_pixel_coordinate", "gene_name"}]


def test_filters_reach_the_scan(spark, sf):
    text = plan(catalogue.QUERIES["p4_found"](spark, sf))
    assert "IsNotNull(x_pixel_coordinate)" in text and "GreaterThanOrEqual(y_pixel_coordinate,0.0)" in text


def test_flagship_decides_per_distinct_read_with_broadcast_codes(spark, sf):
    text = plan(catalogue.QUERIES["demux_assign"](spark, sf))
    assert "BroadcastHashJoin" in text and "bit_count" in text and "Python" not in text
    text = plan(catalogue.QUERIES["demux_pigeonhole"](spark, sf))
    assert "BroadcastNestedLoop" not in text and "Python" not in text
