"""Probe manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotloom.functions.probes import probe_part, probe_type, read_number, read_of_primer


def parse_manifest(panel: DataFrame) -> DataFrame:
    """(probe_name, gene_name, sequence, primer, read, panel_type, probe_type), one row per row of the panel.

    Gene, sequence and primer come from the probe name; a ``gene_name``, ``read`` or ``panel_type`` column of the panel
    stands in for them. Without a ``read`` column the primer decides, and probes of unknown primers are left out; with
    one, nothing is. A malformed name has null parts. A panel without ``probe_name`` is a ``ValueError``.
    """
    if "probe_name" not in panel.columns:
        raise ValueError("a manifest needs the column 'probe_name'")
    name = F.col("probe_name")
    own_read = "read" in panel.columns
    gene = F.col("gene_name") if "gene_name" in panel.columns else probe_part(name, 1)
    primer = probe_part(name, 3)
    out = panel.select(
        name,
        gene.alias("gene_name"),
        probe_part(name, 2).alias("sequence"),
        primer.alias("primer"),
        (read_number(F.col("read")) if own_read else read_of_primer(primer)).alias("read"),
        (F.col("panel_type") if "panel_type" in panel.columns else F.lit(None).cast("string")).alias("panel_type"),
    )
    if not own_read:
        out = out.where("read is not null")
    return out.withColumn("probe_type", probe_type(F.col("gene_name")))


def codebook(manifest: DataFrame) -> DataFrame:
    """(read, sequence, probe_name, gene_name): the codes to compare reads with, each probe once.

    Probes without a sequence or read have no code. Of a probe listed with several genes the smallest is taken.
    """
    codes = manifest.where("sequence is not null and read is not null")
    return codes.groupBy("read", "sequence", "probe_name").agg(F.min("gene_name").alias("gene_name"))
