"""Database and parquet sinks."""

import dataclasses
import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tripflow.operators import with_batch_id
from tripflow.schema import STORED_SCHEMA
from tripflow.sinks import (
    ForeignBatch,
    JdbcSink,
    ParquetSink,
    counting,
    jdbc,
    parquet,
    write_jdbc_append,
    write_jdbc_idempotent,
    write_parquet_idempotent,
)
from tripflow.sources import read_sink_table, sink_count, sink_preview

PICKUP = dt.datetime(2015, 1, 15, 19, 5, 39)


def stored_row(i):
    """A full stored row without its batch id; the vendor is the row's identity."""
    values = {"int": i, "timestamp": PICKUP + dt.timedelta(hours=i), "float": 1.5, "string": f"s{i}", "boolean": None}
    return tuple(values.get(f.dataType.simpleString(), 18.05) for f in STORED_SCHEMA.fields[:-1])


def batch(spark, ids, batch_id):
    schema = type(STORED_SCHEMA)(STORED_SCHEMA.fields[:-1])
    df = spark.createDataFrame([stored_row(i) for i in ids], schema).repartition(3)
    return with_batch_id(df, batch_id)


def contents(df):
    return sorted((r.Id, r.VendorID) for r in df.collect())


@pytest.fixture(params=["parquet", "jdbc"])
def sink(request, tmp_path, table):
    return ParquetSink(str(tmp_path / "out")) if request.param == "parquet" else JdbcSink(table)


def test_round_trip(spark, sink):
    sent = batch(spark, range(5), 0)
    assert sink.write(sent, 0) == 5
    back = sink.read(spark)
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in STORED_SCHEMA]
    assert sorted(back.collect()) == sorted(sent.collect())


def test_batches_add_up(spark, sink):
    for batch_id in range(3):
        sink.write(batch(spark, [batch_id, batch_id + 10], batch_id), batch_id, replay=False)
    assert contents(sink.read(spark)) == [(0, 0), (0, 10), (1, 1), (1, 11), (2, 2), (2, 12)]
    assert sink.count(spark).collect() == [(6,)]
    assert sink.last_batch_id(spark) == 2
    assert sink.has_batch(spark, 1) and not sink.has_batch(spark, 3)


def test_replay_replaces_only_its_batch(spark, sink):
    sink.write(batch(spark, [1, 2], 0), 0)
    sink.write(batch(spark, [3, 4, 5], 1), 1)
    assert sink.write(batch(spark, [3, 4, 5], 1), 1) == 3
    assert contents(sink.read(spark)) == [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]


def test_nothing_stored_yet(spark, sink):
    assert sink.last_batch_id(spark) is None
    assert not sink.has_batch(spark, 0)


def test_preview(spark, sink):
    sink.write(batch(spark, range(20), 0), 0)
    assert sink.preview(spark).count() == 10
    assert [r.VendorID for r in sink.preview(spark, 3, order_by=["VendorID"]).collect()] == [0, 1, 2]


def test_session_overwrite_mode_does_not_matter(spark, tmp_path):
    for mode in ("static", "dynamic"):
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        write_parquet_idempotent(batch(spark, [1], 0), 0, str(tmp_path / mode))
        write_parquet_idempotent(batch(spark, [2], 1), 1, str(tmp_path / mode))
        assert contents(ParquetSink(str(tmp_path / mode)).read(spark)) == [(0, 1), (1, 2)]
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_parquet_times_can_be_filtered_by_statistics(spark, tmp_path):
    write_parquet_idempotent(batch(spark, range(9), 0).coalesce(1), 0, str(tmp_path))
    file = pq.ParquetFile(next(tmp_path.glob("Id=0/*.parquet")))
    column = file.schema.names.index("tpep_pickup_datetime")
    assert file.metadata.row_group(0).column(column).statistics.has_min_max
    assert file.metadata.row_group(0).column(column).compression == "ZSTD"
    late = ParquetSink(str(tmp_path)).read(spark).where("tpep_pickup_datetime > '2030-01-01'")
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(tpep_pickup_datetime" in plan and late.count() == 0


def test_count_that_does_not_arrive(spark, monkeypatch):
    monkeypatch.setattr(counting, "WAIT_SECONDS", 0.2)
    df = batch(spark, range(5), 0)
    # Writing something else leaves the observation waiting.
    assert counting.write_counted(df, lambda _: spark.range(3).write.format("noop").mode("append").save()) is None


def test_parquet_count_that_was_lost(spark, tmp_path, monkeypatch):
    """The footers give it, unless the files show that more than one write left them."""
    real, strays = counting.write_counted, [False, True, False]

    def lost(df, action):
        real(df, action)
        if strays.pop(0):
            df.write.mode("append").parquet(str(tmp_path / "Id=1"))

    monkeypatch.setattr(parquet, "write_counted", lost)
    sink = ParquetSink(str(tmp_path))
    assert sink.write(batch(spark, range(5), 0).repartition(3), 0) == 5
    assert sink.write(batch(spark, range(4), 1), 1) == 4
    assert strays == []
    assert contents(sink.read(spark)) == [(0, k) for k in range(5)] + [(1, k) for k in range(4)]


@pytest.mark.parametrize(
    "names, one",
    [
        ([], True),
        (["_SUCCESS", ".part-00000-x.crc"], True),
        ([f"part-0000{k}-{'a' * 36}-c000.zstd.parquet" for k in range(3)], True),
        ([f"part-00000-{'a' * 36}-c00{k}.zstd.parquet" for k in range(3)], True),
        ([f"part-00000-{x * 36}-c000.zstd.parquet" for x in "ab"], False),
        ([f"part-00000-{'a' * 36}-c000.{x}.parquet" for x in ("zstd", "snappy")], False),
        (["data.parquet"], False),
    ],
)
def test_files_of_one_write(names, one):
    assert parquet._from_one_write(names) == one


def test_database_count_that_was_lost(spark, table, monkeypatch):
    real, counts = counting.write_counted, []

    def lost(df, action):
        counts.append(real(df, action))
        return None if len(counts) == 1 else counts[-1]

    monkeypatch.setattr(jdbc, "write_counted", lost)
    assert write_jdbc_idempotent(batch(spark, [1, 2], 0), 0, table) == 2
    assert counts == [2, 2]
    assert contents(read_sink_table(spark, table)) == [(0, 1), (0, 2)]
    counts.clear()
    assert write_jdbc_append(batch(spark, [3], 1), table) == 1


def test_batch_of_another_owner(spark, sink):
    sink.write(batch(spark, [1], 0), 0, owner="one")
    sink.write(batch(spark, [1], 0), 0, owner="one")
    for replay in (True, False):
        with pytest.raises(ForeignBatch, match="by one, not by two"):
            sink.write(batch(spark, [2], 0), 0, owner="two", replay=replay)
    assert contents(sink.read(spark)) == [(0, 1)]
    sink.write(batch(spark, [2], 0), 0, owner="two", replace=True)
    assert contents(sink.read(spark)) == [(0, 2)]
    with pytest.raises(ForeignBatch):
        sink.write(batch(spark, [1], 0), 0, owner="one")


def test_parquet_marker_that_was_not_finished(spark, tmp_path):
    (tmp_path / "_batches").mkdir()
    (tmp_path / "_batches" / "0").touch()
    sink = ParquetSink(str(tmp_path))
    sink.write(batch(spark, [1], 0), 0, owner="one")
    assert contents(sink.read(spark)) == [(0, 1)]
    assert (tmp_path / "_batches" / "0").read_text().split("\n")[0] == "one"


@pytest.mark.parametrize("strays", [1, 5])
def test_stray_file_in_a_batch_directory(spark, tmp_path, monkeypatch, strays):
    """A file of another attempt that turns up after the batch was written."""
    real, writes = counting.write_counted, []

    def write(df, action):
        rows = real(df, action)
        writes.append(rows)
        if len(writes) <= strays:
            df.write.mode("append").parquet(str(tmp_path / "Id=0"))
        return rows

    monkeypatch.setattr(parquet, "write_counted", write)
    sink = ParquetSink(str(tmp_path))
    if strays > parquet.WRITE_ATTEMPTS:
        with pytest.raises(RuntimeError, match="batch 0"):
            sink.write(batch(spark, [1, 2], 0), 0)
    else:
        assert sink.write(batch(spark, [1, 2], 0), 0) == 2
        assert contents(sink.read(spark)) == [(0, 1), (0, 2)]
        assert len(writes) == 2


# ---- database only -----------------------------------------------------------------------------


def test_append_creates_then_adds(spark, table):
    assert write_jdbc_append(batch(spark, [1, 2], 0), table) == 2
    assert write_jdbc_append(batch(spark, [3], 1), table) == 1
    assert contents(read_sink_table(spark, table)) == [(0, 1), (0, 2), (1, 3)]


def test_append_repeats_a_replayed_batch(spark, table):
    plain = JdbcSink(table, replay_safe=False)
    for _ in range(2):
        plain.write(batch(spark, [1], 0), 0)
    assert sink_count(spark, table).first().n == 2


def test_unknown_column_is_refused(spark, table):
    write_jdbc_append(batch(spark, [1], 0), table)
    odd = batch(spark, [2], 1).withColumn("surprise", F.lit(1))
    for write in (lambda: write_jdbc_append(odd, table), lambda: write_jdbc_idempotent(odd, 1, table)):
        with pytest.raises(AnalysisException):
            write()
    assert contents(read_sink_table(spark, table)) == [(0, 1)]


@pytest.fixture
def staging(monkeypatch):
    """A list of the staging tables filled, and a hook that runs after each filling."""
    real, staged, after = jdbc._write, [], []

    def write(df, target, name, mode):
        real(df, target, name, mode)
        if mode == "overwrite":
            staged.append(name)
            for hook in after:
                hook(df, target, name)

    monkeypatch.setattr(jdbc, "_write", write)
    yield staged, after, real


def test_task_that_committed_twice_is_noticed(spark, table, staging):
    """What a lost executor leaves behind: the rows of a task are in the staging table twice."""
    staged, after, write = staging
    after.append(lambda df, target, name: len(staged) > 1 or write(df.where("VendorID = 2"), target, name, "append"))
    assert write_jdbc_idempotent(batch(spark, [1, 2, 3], 0), 0, table) == 3
    assert len(staged) == 2
    assert contents(read_sink_table(spark, table)) == [(0, 1), (0, 2), (0, 3)]


def test_surplus_that_stays_fails_the_batch_and_keeps_the_table(spark, table, staging):
    _, after, write = staging
    write_jdbc_idempotent(batch(spark, [7, 8], 0), 0, table)
    after.append(lambda df, target, name: write(df, target, name, "append"))
    for batch_id, replace in ((0, True), (1, False)):
        with pytest.raises(RuntimeError, match=f"batch {batch_id}"):
            write_jdbc_idempotent(batch(spark, [1, 2, 3], batch_id), batch_id, table, replace=replace)
    # Deletes and entries were rolled back with the rest.
    assert contents(read_sink_table(spark, table)) == [(0, 7), (0, 8)]
    assert JdbcSink(table).last_batch_id(spark) == 0


def test_replay_of_a_stored_batch_stages_nothing(spark, table, staging):
    staged, _, _ = staging
    for _ in range(3):
        assert write_jdbc_idempotent(batch(spark, [1, 2], 0), 0, table) == 2
    assert len(staged) == 1
    assert contents(read_sink_table(spark, table)) == [(0, 1), (0, 2)]


def test_of_two_drivers_one_gets_the_batch_in(spark, table, staging):
    """A second driver stores the same batch while the first has staged but not published it."""
    staged, after, _ = staging
    sent = batch(spark, [1, 2], 0)
    after.append(lambda *_: len(staged) > 1 or write_jdbc_idempotent(sent, 0, table))
    assert write_jdbc_idempotent(sent, 0, table, replay=False) == 2
    assert len(set(staged)) == 2
    assert contents(read_sink_table(spark, table)) == [(0, 1), (0, 2)]


def test_replace(spark, table):
    write_jdbc_idempotent(batch(spark, [1, 2], 0), 0, table)
    write_jdbc_idempotent(batch(spark, [5], 1), 1, table)
    assert write_jdbc_idempotent(batch(spark, [3], 0), 0, table, replace=True) == 1
    assert contents(read_sink_table(spark, table)) == [(0, 3), (1, 5)]
    with pytest.raises(ValueError, match="cannot replace"):
        JdbcSink(table, replay_safe=False).write(batch(spark, [3], 0), 0, replace=True)


def test_replay_removes_what_a_plain_append_left(spark, table):
    write_jdbc_append(batch(spark, [1, 2], 0), table)
    assert JdbcSink(table).has_batch(spark, 0)
    assert write_jdbc_idempotent(batch(spark, [1, 2], 0), 0, table) == 2
    assert contents(read_sink_table(spark, table)) == [(0, 1), (0, 2)]


def test_batches_count_as_stored_when_their_rows_are_gone(spark, table):
    write_jdbc_idempotent(batch(spark, [1], 5), 5, table)
    with jdbc._statement(spark, table) as (connection, statement):
        statement.executeUpdate(f"DELETE FROM {table.table}")
        connection.commit()
    assert JdbcSink(table).last_batch_id(spark) == 5 and JdbcSink(table).has_batch(spark, 5)


def test_no_staging_table_stays(spark, table, staging):
    staged, _, _ = staging
    write_jdbc_idempotent(batch(spark, [7], 0), 0, table)
    broken = batch(spark, [1, 2], 1).withColumn("passenger_count", F.raise_error(F.lit("boom")).cast("int"))
    with pytest.raises(Exception, match="boom"):
        write_jdbc_idempotent(broken, 1, table)
    assert contents(read_sink_table(spark, table)) == [(0, 7)]
    write_jdbc_idempotent(batch(spark, [1, 2], 1), 1, table)
    assert contents(read_sink_table(spark, table)) == [(0, 7), (1, 1), (1, 2)]
    with jdbc._statement(spark, table) as (connection, _):
        assert not any(jdbc._has_table(connection, name) for name in staged)


def test_times_are_stored_as_the_wall_clock_of_the_session(spark, table):
    df = spark.sql("SELECT timestamp'2015-01-15 19:05:39 UTC' AS ts, 0 AS Id")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        write_jdbc_idempotent(df, 0, table)
        stored = spark.read.option("preferTimestampNTZ", True).jdbc(
            table.url, table.table, properties=table.properties()
        )
        assert stored.first().ts == dt.datetime(2015, 1, 15, 14, 5, 39)
        same = read_sink_table(spark, table).selectExpr("unix_seconds(ts) AS s").first().s
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert same == df.selectExpr("unix_seconds(ts) AS s").first().s


def test_connections_are_limited(spark, table):
    df = batch(spark, range(50), 0).repartition(50)
    assert jdbc._rows_for(df, table).rdd.getNumPartitions() == table.max_connections
    assert write_jdbc_idempotent(df, 0, table) == 50


def test_read_over_several_connections_is_whole(spark, table):
    rows = batch(spark, range(40), 0).withColumn(
        "tpep_pickup_datetime", F.when(F.col("VendorID") % 5 > 0, F.col("tpep_pickup_datetime"))
    )
    write_jdbc_idempotent(rows, 0, table)
    for parts in (1, 2, 4):
        back = read_sink_table(spark, table, num_partitions=parts)
        assert back.rdd.getNumPartitions() == parts
        assert contents(back) == [(0, i) for i in range(40)]


def test_read_of_a_table_without_a_time_range(spark, table):
    write_jdbc_idempotent(batch(spark, [1], 0), 0, table)
    assert contents(read_sink_table(spark, table, num_partitions=4)) == [(0, 1)]


def test_preview_is_cut_by_the_database(spark, table):
    write_jdbc_idempotent(batch(spark, range(20), 0), 0, table)
    plan = sink_preview(spark, table, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FETCH FIRST 3 ROWS ONLY" in plan


def test_driver_that_does_not_take_the_url(spark, table):
    with pytest.raises(ValueError, match="does not take"):
        JdbcSink(dataclasses.replace(table, url="jdbc:elsewhere:x")).last_batch_id(spark)


def test_table_in_a_named_schema(spark, table):
    named = dataclasses.replace(table, table=f"APP.{table.table}")
    assert JdbcSink(named).last_batch_id(spark) is None
    write_jdbc_idempotent(batch(spark, [1], 4), 4, named)
    assert JdbcSink(named).last_batch_id(spark) == JdbcSink(table).last_batch_id(spark) == 4
    alike = dataclasses.replace(table, table=table.table.replace("_", "x"))
    write_jdbc_idempotent(batch(spark, [1], 9), 9, alike)
    assert JdbcSink(table).last_batch_id(spark) == 4


def test_table_like_another(spark, table):
    alike = dataclasses.replace(table, table=table.table.replace("_", "x"))
    write_jdbc_idempotent(batch(spark, [1], 0), 0, alike)
    assert JdbcSink(table).last_batch_id(spark) is None


def test_password_is_not_shown(table):
    assert "hunter2" not in repr(dataclasses.replace(table, user="u", password="hunter2"))


def test_write_path_has_no_shuffle(spark, table, tmp_path):
    rows = with_batch_id(spark.read.schema(STORED_SCHEMA).csv(str(tmp_path)), 0)
    assert "Exchange" not in jdbc._rows_for(rows, table)._jdf.queryExecution().executedPlan().toString()


def test_replay_of_a_whole_batch_leaves_its_files_alone(spark, tmp_path):
    sink = ParquetSink(str(tmp_path / "out"))
    sink.write(batch(spark, range(6), 0), 0)
    directory = tmp_path / "out" / "Id=0"
    before = {f.name: f.stat().st_mtime_ns for f in directory.iterdir()}
    assert sink.write(batch(spark, range(6), 0), 0) == 6
    assert {f.name: f.stat().st_mtime_ns for f in directory.iterdir()} == before


def test_replay_of_a_torn_batch_writes_it_afresh(spark, tmp_path):
    sink = ParquetSink(str(tmp_path / "out"))
    sink.write(batch(spark, range(6), 0), 0)
    next((tmp_path / "out" / "Id=0").glob("part-*")).unlink()
    assert sink.write(batch(spark, range(6), 0), 0) == 6
    assert contents(sink.read(spark)) == [(0, i) for i in range(6)]


def test_stray_names_beside_the_markers(spark, tmp_path):
    sink = ParquetSink(str(tmp_path / "out"))
    sink.write(batch(spark, [1], 3), 3)
    (tmp_path / "out" / "_batches" / "note.txt").touch()
    assert sink.last_batch_id(spark) == 3


def test_existence_is_asked_without_listing(spark, tmp_path, monkeypatch):
    sink = ParquetSink(str(tmp_path / "out"))
    sink.write(batch(spark, [1], 0), 0)
    monkeypatch.setattr(parquet, "child_names", lambda *_: pytest.fail("listed"))
    assert sink.has_batch(spark, 0) and not sink.has_batch(spark, 1)


def test_scan_keeps_its_tasks_before_the_connections(spark, table):
    df = batch(spark, range(50), 0).repartition(50)
    rows = jdbc._rows_for(df, table)
    assert "RoundRobinPartitioning(4)" in rows._jdf.queryExecution().executedPlan().toString()
    few = jdbc._rows_for(df.coalesce(2), table)
    assert few.rdd.getNumPartitions() == 2


def test_ranges_hold_equal_shares(spark, table):
    """Neither a stray pickup time nor many missing ones put most rows into one range."""
    time = F.col("tpep_pickup_datetime")
    rows = batch(spark, range(400), 0)
    rows = rows.withColumn("tpep_pickup_datetime", F.when(F.col("VendorID") == 7, time + F.expr("interval 80 years")).otherwise(time))
    write_jdbc_idempotent(rows, 0, table)
    for k in range(1, 5):
        write_jdbc_idempotent(batch(spark, range(20), k), k, table)
    back = read_sink_table(spark, table, num_partitions=4)
    sizes = [len(p) for p in back.rdd.glom().collect()]
    assert sum(sizes) == 480 and max(sizes) <= 0.4 * 480


def test_index_on_the_batch_id(spark, table):
    write_jdbc_idempotent(batch(spark, [1], 0), 0, table)
    write_jdbc_idempotent(batch(spark, [2], 1), 1, table)
    with jdbc._statement(spark, table) as (connection, _):
        assert jdbc._has_index(connection, table.table)


def test_staging_table_of_a_dead_driver_is_used_up(spark, table, monkeypatch):
    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as dead:
        dead.setattr(jdbc, "_publish", die)
        dead.setattr(jdbc, "_drop", lambda *_: None)
        with pytest.raises(KeyboardInterrupt):
            write_jdbc_idempotent(batch(spark, [1], 0), 0, table, owner="x")
    write_jdbc_idempotent(batch(spark, [1], 0), 0, table, owner="x")
    with jdbc._statement(spark, table) as (connection, _):
        found = connection.getMetaData().getTables(None, None, f"{table.table.upper()}_STAGE%", None)
        assert not found.next()
    assert contents(read_sink_table(spark, table)) == [(0, 1)]
