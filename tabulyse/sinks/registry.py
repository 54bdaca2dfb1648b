"""A registry of written datasets: one appended row each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulyse.functions.semantic_types import ColumnSpec
from tabulyse.session import small_table
from tabulyse.sinks.writers import write_table
from tabulyse.sources.readers import source_size

REGISTRY_SCHEMA = (
    "dataset_id string, owner string, name string, mode string, model string, format string, path string, "
    "rows bigint, columns bigint, bytes bigint, created_at timestamp"
)


def register_write(
    df: DataFrame,
    folder: str,
    registry: str,
    owner: str,
    name: str,
    fmt: str = "parquet",
    mode: str = "synthetic",
    model: str = "unknown",
    specs: list[ColumnSpec] | None = None,
) -> str:
    """Write the table under ``folder/owner`` and append its row to the registry; returns the dataset id.

    There is no size limit; how many datasets an owner has against a limit is ``quota_count``.
    """
    dataset_id = str(uuid.uuid4())
    path = f"{folder}/{owner}/{dataset_id}.{fmt}"
    rows = write_table(df, path, fmt, specs, name)
    record = (dataset_id, owner, name, mode, model, fmt, path, rows, len(specs or df.columns), source_size(df.sparkSession, path).first().bytes)
    schema = REGISTRY_SCHEMA.rsplit(",", 1)[0]
    entry = small_table(df.sparkSession, [record], schema).withColumn("created_at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(registry)
    return dataset_id
