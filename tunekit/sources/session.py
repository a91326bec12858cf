"""Session helpers: a local session for tests, and the folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

HELD_ROWS = 1 << 17  # rows of a written table that a broadcast may hold in the driver


def local_session(cores: str = "*", app: str = "tunekit", **conf: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tunekit-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove the tables that `through_table` writes inside the block when it ends; results must be taken out before."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            system, inner = fs.FileSystem.from_uri(path)
            if system.get_file_info(inner).type == fs.FileType.Directory:
                system.delete_dir(inner)


def through_table(df: DataFrame, name: str, merged: bool = False) -> DataFrame:
    """Write `df` into the shared folder and read it back: the result no longer depends on its inputs.

    Spark judges by the size of the files whether a join may hold a table in the driver, and compressed files of few columns look far too
    small.  With `merged`, the rows are counted in the written files, and joins of more than `HELD_ROWS` are merged, not broadcast.
    The table stays until the caller's `scratch` block ends; without one the caller's cluster clears the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table.hint("merge") if merged and table.count() > HELD_ROWS else table  # the files know their rows
