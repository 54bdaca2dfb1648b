"""What queries build to read is dealt over more files and tasks as the tables grow."""

import datetime as dt
import glob
import os

import pytest

from checks import queries
from tabulyse.operators import synth
from tabulyse.session import scratch_dir
from tabulyse.sources import readers


def made(spark, label):
    """The folders that queries have written under this label."""
    return set(glob.glob(f"{os.path.dirname(scratch_dir(spark, label)).removeprefix('file:')}/{label}-*"))


def test_batches_of_a_stream_hold_more_files_as_the_table_grows(spark, tmp_path, monkeypatch):
    day = dt.datetime(2024, 1, 2)
    rows = [(k, k % 7, "O", k / 4, day, "1-URGENT") for k in range(4000)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries, "ARRIVING_BYTES", 1 + sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/orders.parquet/part-*")) // 12, raising=False)
    incoming, marks = made(spark, "incoming"), made(spark, "marks")
    cleaned = queries.normalize_stream(spark, str(tmp_path))
    assert cleaned.count() == cleaned.select("o_orderkey").distinct().count() == 4000
    (new,), (log,) = made(spark, "incoming") - incoming, made(spark, "marks") - marks
    assert len(glob.glob(f"{new}/part-*")) == 12 and len(glob.glob(f"{log}/commits/[0-9]*")) == 3


@pytest.mark.parametrize("query, name, key", [("synth_people", "customer", "c_custkey"), ("synth_preset", "customer", "c_custkey"), ("synth_orders_like", "orders", "o_orderkey")])
def test_values_are_drawn_by_more_tasks_as_the_table_grows(spark, tmp_path, monkeypatch, query, name, key):
    keys = [*range(95), None, 3, 3]
    spark.createDataFrame([(k,) for k in keys], f"{key} long").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(synth.spread, "__defaults__", (10,))
    drawn = queries.QUERIES[query](spark, str(tmp_path))
    assert drawn.rdd.getNumPartitions() == 10
    assert sorted(str(r[0]) for r in drawn.select(key).collect()) == sorted(map(str, keys))


def test_large_documents_are_read_by_their_folder(spark, tmp_path, monkeypatch):
    """No list of files goes through the driver, and no function runs once per file."""
    for k in range(40):
        (tmp_path / f"{k}.json").write_text("[" + ", ".join(f'{{"id": {10 * k + i}, "s": "}}"}}' for i in range(k % 7)) + "]" + " " * (20 * (k % 2)))
    seen, pieces_of = [], readers.pieces_of
    monkeypatch.setattr(readers, "pieces_of", lambda spark, path, *more, **options: seen.append(path) or pieces_of(spark, path, *more, **options))
    read = readers.read_json(spark, str(tmp_path), lines=False, range_bytes=15)
    assert sorted(r.id for r in read.collect()) == [10 * k + i for k in range(40) for i in range(k % 7)]
    assert seen == [str(tmp_path)]
