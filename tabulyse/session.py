"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_SCRATCH = "tabulyse.scratch.dir"


def build_session(app: str = "tabulyse", cores: int | str = "*", **extra: str) -> SparkSession:
    """A local session with the settings the library is tested under.

    On a cluster the session comes from spark-submit; the library relies only on a UTC session time
    zone and leaves AQE (on by default) to size and split shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for written intermediates that every executor can reach.

    The root is the folder the cluster names in ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder, which is created once, kept in a setting of our own and
    deleted when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_SCRATCH, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tabulyse-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(_SCRATCH, root)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written once to the scratch folder and read back, for what several steps use."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table for the few rows a driver decision yields; it plans as a local relation."""
    struct = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow))
