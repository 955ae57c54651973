"""Session construction and shared-storage helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for these jobs. On a cluster, pass nothing: master and sizes come
    from the submit configuration. Locally (tests, bench) a master is given."""
    b = SparkSession.builder.appName("gridweave")
    if master:
        b = b.master(master)
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session names none (a local test run) is a scratch folder created.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        conf = tempfile.mkdtemp(prefix="gridweave-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_open_scopes: list[list[str]] = []


@contextlib.contextmanager
def intermediates(spark: SparkSession):
    """Tables that :func:`cut_lineage` writes inside are deleted when this ends; results
    that read them must be written or collected by then."""
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint folder and read it
    back: the plan is computed a single time, survives executor loss (files on shared
    storage, not executor memory), and the re-read scan carries real size statistics
    for the planner. ``keep`` leaves it when an :func:`intermediates` scope ends."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"gw-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    if _open_scopes and not keep:
        _open_scopes[-1].append(path)
    return spark.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package (like ``--py-files``), once per application: the
    operators' Arrow and state functions are imported there."""
    sc = spark.sparkContext
    if getattr(sc, "_gridweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="gridweave-py-"), "gridweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, n)
                z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(out)
    sc._gridweave_shipped = True


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
