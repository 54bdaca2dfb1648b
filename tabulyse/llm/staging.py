"""Written intermediates in the shared folder, and shipping of the functions that run inside tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tabulyse.session import scratch_dir


def staged(df: DataFrame, label: str) -> DataFrame:
    """The table written once to the folder in ``spark.checkpoint.dir`` and read back.

    It cuts the lineage: a lost executor costs the tasks it ran, not the table.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """The table, for a join that sorts and merges: neither it nor what it meets is sent to the driver.

    For tables that both grow with the corpus. Spark sizes them by their files: rows that an explode multiplies count once,
    and values that compress well hardly. What it then takes for small may not fit the driver.
    """
    return df.hint("merge")


def ships(name: str) -> None:
    """Make the functions of this module travel with the job, so executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
