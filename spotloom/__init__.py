"""Spotloom: a PySpark-native analytics engine for spatial transcriptomics and proteomics."""

from __future__ import annotations

__version__ = "0.1.0"


def __getattr__(name: str):
    """The pipeline functions, the sample object and the modules of operators are loaded when first asked for."""
    from importlib import import_module

    if name in ("resegment", "redemux", "update_bin", "new_bin", "tar_viewer", "migrate", "validate"):
        return getattr(import_module("spotloom.pipelines"), name)
    if name == "SpatialSample":
        return import_module("spotloom.sample").SpatialSample
    if name in ("cells", "demux", "drift", "evolution", "manifest", "nearby", "orphans", "polygons", "raster", "viewer"):
        return import_module(f"spotloom.operators.{name}")
    raise AttributeError(name)
