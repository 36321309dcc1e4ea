"""Command line: ``python -m spotloom <command> <sample folder> ...``."""

from __future__ import annotations

import argparse
import os
import sys

from spotloom import __version__

#: Threads unless said otherwise: half of the cores.
DEFAULT_THREADS = max(1, (os.cpu_count() or 2) // 2)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spotloom", description="Post-processing of spatial transcriptomics and proteomics samples on Spark.")
    p.add_argument("-t", "--threads", type=int, default=DEFAULT_THREADS, help="local threads, where no cluster is given")
    p.add_argument("-v", "--verbose", type=int, default=1, choices=(0, 1, 2))
    p.add_argument("--master", help="the Spark master; by default local")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")

    def add(name: str, text: str, in_place: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text, description=text)
        c.add_argument("sample", help="the sample's folder")
        c.add_argument("--sample-id", help="instead of the one of the summary page")
        if in_place:
            c.add_argument("-ip", "--in-place", action="store_true", help="write into the sample's folder")
        return c

    c = add("resegment", "assign transcripts and intensities to a new segmentation")
    c.add_argument("--cell-labels", required=True, help=".npy, .npz or .geojson")
    c.add_argument("--labels-key", help="array or property that holds the labels")
    c.add_argument("--without", action="append", help="a channel to leave out of the tables")
    c = add("redemux", "assign all reads to the probes of a manifest")
    c.add_argument("--manifest", required=True, help="CSV with a column probe_name")
    c.add_argument("--batch-size", type=int, help="rows of the feature table that a task reads at a time")
    c.add_argument("--without", action="append", help="a channel to leave out of the tables")
    c = add("update_bin", "put clusters, colours and an embedding on the cell file")
    c.add_argument("--metadata", required=True)
    c.add_argument("--bin-file")
    c.add_argument("--cellid-key", default="cell_id")
    c.add_argument("--cluster-key")
    c.add_argument("--cluster-color-key")
    c.add_argument("--emb-key")
    add("new_bin", "write the cell file anew")
    add("tar_viewer", "pack the viewer's folder")
    c = add("migrate", "bring an older folder to today's layout", in_place=False)
    c.add_argument("--restore", action="store_true", help="take back an earlier migration")
    add("validate", "check the folder and its tables", in_place=False)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command is None:
        p.print_help()
        return 0
    from spotloom import pipelines
    from spotloom.sample import SpatialSample
    from spotloom.session import build_session

    options = {k: v for k, v in vars(a).items() if k not in ("threads", "verbose", "master", "command", "sample", "sample_id", "in_place", "batch_size")}
    conf = {"spark.sql.parquet.columnarReaderBatchSize": str(a.batch_size)} if getattr(a, "batch_size", None) else {}
    spark = build_session(f"spotloom {a.command}", a.master or f"local[{a.threads}]", **conf)
    sample = SpatialSample(spark, a.sample, a.sample_id)
    in_place = getattr(a, "in_place", True)
    out = None if in_place else os.path.join(a.sample, "spotloom")
    try:
        getattr(pipelines, a.command)(sample, out, a.verbose, **options)
    except Exception as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1
    return 0
