"""Session factory, lineage cuts and shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions

_shipped: set[str] = set()
_written: set[str] = set()


def build_session(app: str = "pairlens", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings that the operators rely on (UTC, AQE with skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def _is_single_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a single-machine session that names none gets a temporary folder; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _is_single_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "pairlens-shared-" + spark.sparkContext.applicationId)
    if not os.path.isdir(made):
        os.makedirs(made)
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def clear_tables(spark: SparkSession, since: set[str] | None = None) -> None:
    """Delete the tables that :func:`materialize` wrote, or those that it wrote after ``since`` (from :func:`written_tables`).

    DataFrames that still read them fail afterwards, so call it once their results are stored.
    """
    for path in written_tables(spark) - (since or set()):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.discard(path)


def written_tables(spark: SparkSession) -> set[str]:
    """Paths of the intermediate tables of this process that are still there."""
    return {p for p in _written if p.startswith(shared_dir(spark))}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose intermediate tables are deleted at its end: store results inside of it."""
    before = written_tables(spark)
    try:
        yield
    finally:
        clear_tables(spark, before)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs only once, and the table outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table whose rows were counted may be broadcast.
BROADCAST_ROWS = 200_000


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it is counted to have ``rows`` rows at most; else as it is, for a join by shuffle.

    ``df`` should be a table that :func:`materialize` wrote, so that counting it costs nothing.
    """
    return functions.broadcast(df) if df.count() <= rows else df


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, here and on other machines; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # Spark copies the archive to its own file server, so the folder is only needed for that.
    folder = Path(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = folder / "pairlens.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)
