"""The annotated matrix as three tables in one folder: X (long counts), obs (cells) and var (genes), joined by key."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.operators import cells


@dataclass(frozen=True)
class AnnotatedMatrix:
    X: DataFrame  # (cell_id, gene_id, counts), non-zero
    obs: DataFrame  # (cell_id, ...)
    var: DataFrame  # (gene_id, modality, probe_type, ...)

    def targeting(self) -> AnnotatedMatrix:
        """Only the genes that target a transcript."""
        var = self.var.where("probe_type = 'targeting'")
        return AnnotatedMatrix(self.X.join(var.select("gene_id"), "gene_id", "left_semi"), self.obs, var)

    def select_cells(self, ids: DataFrame) -> AnnotatedMatrix:
        """Only the cells of ``ids`` (cell_id), in the order of its column ``ordinal`` if it has one."""
        obs = self.obs.join(ids, "cell_id", "left_semi")
        if "ordinal" in ids.columns:
            place = ids.groupBy("cell_id").agg(F.min("ordinal").alias("_place"))
            obs = obs.join(place, "cell_id").orderBy("_place").drop("_place")
        return AnnotatedMatrix(self.X.join(ids, "cell_id", "left_semi"), obs, self.var)

    def with_clustering(self, clustering: DataFrame) -> AnnotatedMatrix:
        return AnnotatedMatrix(self.X, cells.with_clustering(self.obs, clustering), self.var)


def assemble(counts: DataFrame, metadata: DataFrame, genes: DataFrame, manifest: DataFrame | None = None) -> AnnotatedMatrix:
    """A matrix with quality figures from long counts (cell_id, gene_name, counts), cell metadata (cell_id, ...) and the
    panel's genes (gene_name). Cells and genes without counts have zeros."""
    n = metadata.select("cell_id").distinct().count()
    q = cells.qc_cells(counts.select("cell_id", "gene_name", "counts"), "cell_id")
    figures = ["n_genes_by_counts", "total_counts", "log1p_n_genes_by_counts", "log1p_total_counts"]
    obs = metadata.join(q, "cell_id", "left").na.fill(0, figures)
    g = genes.select("gene_name").where("gene_name is not null").distinct()
    typed = cells.with_probe_type(g, manifest) if manifest is not None else g.withColumn("probe_type", F.lit("targeting"))
    per_gene = cells.qc_genes(counts, n)
    var = typed.join(per_gene, "gene_name", "left").na.fill(0, [c for c in per_gene.columns if c not in ("gene_name", "pct_dropout_by_counts")]).na.fill(100.0, ["pct_dropout_by_counts"])
    var = var.withColumnRenamed("gene_name", "gene_id").withColumn("modality", F.lit("tx"))
    return AnnotatedMatrix(counts.where("counts > 0").select("cell_id", F.col("gene_name").alias("gene_id"), "counts"), obs, var)


def write_matrix(m: AnnotatedMatrix, folder: str | Path) -> None:
    for name in ("X", "obs", "var"):
        getattr(m, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_matrix(spark: SparkSession, folder: str | Path, remove_nontargeting: bool = True, clustering: DataFrame | None = None) -> AnnotatedMatrix:
    m = AnnotatedMatrix(*(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("X", "obs", "var")))
    if remove_nontargeting:
        m = m.targeting()
    return m if clustering is None else m.with_clustering(clustering)
