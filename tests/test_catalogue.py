"""Every query of the core runs over the test tables; those with SQL give the SQL's rows."""

import pytest

import __spark_entry__ as entry
from spotloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_sql_gives_the_same_rows(spark, sf, oracle, name):
    oracle.check(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_run(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_point(spark):
    assert entry.entry(spark).columns == ["sample_id", "label", "gene_name", "counts"]
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tiles_keep_all_points_on_the_finest_level(spark, sf):
    from spotloom.plans import domain

    tiles = domain.tile_documents(spark, sf).selectExpr("level", "size(pointsData) as n").groupBy("level").sum("n").collect()
    n = {r[0]: r[1] for r in tiles}
    assert n[max(n)] == domain.tile_assign(spark, sf).count()


def test_documents_are_whole(spark, sf):
    from spotloom.plans import domain

    rows = domain.cell_documents(spark, sf).collect()
    assert len({r["cellId"] for r in rows}) == len(rows)
    drawn = [r for r in rows if r["vertices"]]
    assert len(drawn) > 0.9 * len(rows)
    assert all(r["vertices"][:2] == r["vertices"][-2:] and r["area"] > 0 for r in drawn)
    assert all(len(r["nonzeroGeneIndices"]) == len(r["nonzeroGeneValues"]) == r["totalGenes"] for r in rows)
