"""Sessions, test-table loading and durable intermediate results."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spotloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; everything given in ``conf`` wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, as an archive in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_spotloom_shipped", False):
        return
    home = Path(__file__).parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    at = sc._jvm.org.apache.hadoop.fs.Path(shared_dir(spark), f"spotloom-{uuid.uuid4().hex}.zip")
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(at.toString())
    sc._spotloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test-data layout: ``<dir>/<name>.parquet``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset and the session is local, as in
    tests, a local temporary folder is taken, and set for the session; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spotloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut and the loss of an executor costs nothing.
    Written as Parquet, so later readers prune columns and push filters down."""
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), "spotloom", uuid.uuid4().hex)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
