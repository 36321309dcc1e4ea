"""Single-cell tables: identity, counts per gene, intensities per channel, metadata and quality figures.

Counts are kept long, (label, gene_name, counts); wide tables are made on request with explicit columns.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotloom.operators.raster import look_up


def cell_name(sample: Column, label: Column) -> Column:
    """``<sample>-<label>``; null if either is."""
    return F.concat(sample, F.lit("-"), label.cast("string"))


def cell_index(runs: DataFrame) -> DataFrame:
    """(sample_id, label, cell_id) of the regions of a raster."""
    return runs.where("label <> 0").select("sample_id", "label").distinct().withColumn("cell_id", cell_name(F.col("sample_id"), F.col("label")))


def assign_cells(transcripts: DataFrame, runs: DataFrame, nuclei: DataFrame | None = None) -> DataFrame:
    """Transcripts with ``label`` and ``cell_id`` of the cell they lie in, label 0 outside, and with ``in_nucleus`` (0 or
    1) if a raster of nuclei is given; without one, an ``in_nucleus`` column is dropped. Earlier values are replaced."""
    out = look_up(transcripts.drop("cell_id", "in_nucleus"), runs)
    if nuclei is not None:
        out = look_up(out, nuclei, "in_nucleus").withColumn("in_nucleus", (F.col("in_nucleus") != 0).cast("int"))
    return out.withColumn("cell_id", cell_name(F.col("sample_id"), F.col("label")))


def cell_by_gene(transcripts: DataFrame) -> DataFrame:
    """(sample_id, label, gene_name, counts) of transcripts inside cells. A null label or gene is not counted."""
    t = transcripts.where("label <> 0 and gene_name is not null and sample_id is not null")
    return t.groupBy("sample_id", "label", "gene_name").agg(F.count(F.lit(1)).alias("counts"))


def zero_completed(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample_id, label, gene_name, counts) for every cell and panel gene, 0 where there is none.

    Each cell meets the panel's genes, a list of a few hundred held in the plan; nothing but the counts is shuffled.
    """
    names = sorted(r[0] for r in genes.where("gene_name is not null").select("gene_name").distinct().collect())  # a panel
    if not names:
        return counts.limit(0)
    g = counts.groupBy("sample_id", "label").agg(F.map_from_entries(F.collect_list(F.struct("gene_name", "counts"))).alias("m"))
    grid = cells.select("sample_id", "label").distinct().join(g, ["sample_id", "label"], "left")
    each = grid.select("sample_id", "label", "m", F.explode(F.from_json(F.lit(json.dumps(names)), "array<string>")).alias("gene_name"))
    return each.select("sample_id", "label", "gene_name", F.coalesce(F.expr("try_element_at(m, gene_name)"), F.lit(0)).alias("counts"))


def wide_counts(counts: DataFrame, cells: DataFrame, genes: list[str]) -> DataFrame:
    """One row per cell, one column per gene of ``genes`` in name order, zero-filled."""
    names = sorted(set(genes))
    p = counts.groupBy("sample_id", "label").pivot("gene_name", names).agg(F.sum("counts"))
    return cells.select("sample_id", "label").distinct().join(p, ["sample_id", "label"], "left").na.fill(0, names)


def missing_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene_name) of the panel without any count; a null gene is none."""
    return genes.where("gene_name is not null").select("gene_name").distinct().join(counts.select("gene_name").distinct(), "gene_name", "left_anti")


def unpivot_counts(wide: DataFrame, ids: list[str], name: str = "gene_name", value: str = "counts") -> DataFrame:
    """A wide table as (ids, name, value), without a shuffle."""
    return wide.unpivot(ids, [c for c in wide.columns if c not in ids], name, value)


def wide_means(means: DataFrame, channels: list[str]) -> DataFrame:
    """One row per cell and a column ``<channel>_intensity_mean`` per channel."""
    p = means.groupBy("sample_id", "label").pivot("channel", channels).agg(F.first("mean_intensity"))
    return p.withColumnsRenamed({c: f"{c}_intensity_mean" for c in channels})


def cell_metadata(properties: DataFrame, protein: DataFrame | None, key: str = "label") -> DataFrame:
    """Properties and intensities of cells that have both."""
    return properties if protein is None else properties.join(protein, key)


def key_differences(a: DataFrame, b: DataFrame, key: str = "label") -> DataFrame:
    """(key, side): keys that only one of two tables has; no rows if the sets are equal. Null keys do not count."""
    x, y = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (a, b))
    only = x.join(y, key, "left_anti").withColumn("side", F.lit("left"))
    return only.unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def require_same_keys(a: DataFrame, b: DataFrame, key: str = "label") -> None:
    if row := key_differences(a, b, key).limit(1).collect():
        raise ValueError(f"cell labels differ, such as {row[0][0]!r} ({row[0][1]} side only)")


def qc_cells(counts: DataFrame, key: str = "label") -> DataFrame:
    """(key, n_genes_by_counts, total_counts and their log1p) per cell, from counts with or without zeros."""
    g = counts.groupBy(key).agg(F.count_if(F.col("counts") > 0).alias("n_genes_by_counts"), F.sum(F.coalesce("counts", F.lit(0))).cast("bigint").alias("total_counts"))
    return g.withColumns({"log1p_n_genes_by_counts": F.log1p("n_genes_by_counts"), "log1p_total_counts": F.log1p("total_counts")})


def qc_genes(counts: DataFrame, n_cells: int) -> DataFrame:
    """Per gene: cells with it, mean, dropout in percent, total, and log1p of mean and total, over ``n_cells`` cells."""
    total = F.sum(F.coalesce("counts", F.lit(0))).cast("bigint")
    g = counts.groupBy("gene_name").agg(F.count_if(F.col("counts") > 0).alias("n_cells_by_counts"), total.alias("total_counts"))
    g = g.withColumns({"mean_counts": F.col("total_counts") / n_cells, "pct_dropout_by_counts": 100.0 * (1 - F.col("n_cells_by_counts") / n_cells)})
    return g.withColumns({"log1p_mean_counts": F.log1p("mean_counts"), "log1p_total_counts": F.log1p("total_counts")})


def with_probe_type(genes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Genes with ``probe_type`` of the manifest, null if it lacks the gene; a gene with several takes the smallest."""
    types = manifest.where("gene_name is not null").groupBy("gene_name").agg(F.min("probe_type").alias("probe_type"))
    return genes.drop("probe_type").join(types, "gene_name", "left")


def targeting_only(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Counts of genes whose ``probe_type`` is targeting."""
    return counts.join(genes.where("probe_type = 'targeting'").select("gene_name").distinct(), "gene_name", "left_semi")


def sparse_rows(matrix: DataFrame, key: str, vector: str = "x") -> DataFrame:
    """(key, indices, values): the non-zero places of each row's vector, from 0, in order. Null vectors give nulls."""
    nz = F.filter(F.transform(F.col(vector), lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)
    return matrix.select(key, nz.alias("nz")).select(key, F.transform("nz", lambda e: e["i"]).alias("indices"), F.transform("nz", lambda e: e["v"]).alias("values"))


def sparse_genes(counts: DataFrame, key: str = "label") -> DataFrame:
    """(key, indices, values) from long counts, genes numbered in name order over the whole table."""
    from pyspark.sql import Window

    order = counts.select("gene_name").distinct().withColumn("i", F.row_number().over(Window.orderBy("gene_name")) - 1)  # a panel's genes
    nz = counts.where("counts > 0").join(F.broadcast(order), "gene_name")
    g = nz.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "counts"))).alias("nz"))
    return g.select(key, F.transform("nz", lambda e: e["i"]).alias("indices"), F.transform("nz", lambda e: e["counts"]).alias("values"))


def with_clustering(cells: DataFrame, clustering: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells with their clusters and embedding, nulls where there is none; a repeated key of ``clustering`` counts once."""
    rest = [c for c in clustering.columns if c != key]
    one = clustering.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_m")).select(key, *[F.col(f"_m.`{c}`").alias(c) for c in rest])
    return cells.join(one, key, "left")


def embedding_vector(df: DataFrame, name: str, out: str = "X_umap") -> DataFrame:
    """Columns ``<name>_1`` and ``<name>_2`` as one array."""
    return df.withColumn(out, F.array(F.col(f"{name}_1"), F.col(f"{name}_2"))).drop(f"{name}_1", f"{name}_2")
