"""A database table over JDBC."""

import logging
import uuid
import zlib
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from tripflow.schema import BATCH_ID
from tripflow.sinks.counting import write_counted
from tripflow.sinks.ownership import NO_STREAM, check_owner
from tripflow.sources.table import JdbcTable, read_sink_table, sink_count, sink_preview

log = logging.getLogger(__name__)

STAGE_ATTEMPTS = 3


def _wall_clock(df: DataFrame) -> DataFrame:
    """Instants as wall-clock times of the session's zone.

    Spark hands instants to a driver in the zone of the executor's JVM; wall-clock times reach the
    table unchanged wherever the task runs.
    """
    instants = [f.name for f in df.schema if isinstance(f.dataType, TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in instants})


def _rows_for(df: DataFrame, target: JdbcTable) -> DataFrame:
    """`df` in the form the database gets it, over at most `max_connections` tasks.

    Where there are more tasks than connections a shuffle lies between, so the scan keeps its own tasks. The limit is
    set here, not by the writer's `numPartitions`: that one plans the rows anew and leaves an observed count at 0.
    """
    rows = _wall_clock(df)
    tasks = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(target.max_connections) if tasks > target.max_connections else rows


def _write(df: DataFrame, target: JdbcTable, table: str, mode: str) -> None:
    writer = df.write.mode(mode).option("batchsize", target.batch_size)
    writer.jdbc(target.url, table, properties=target.properties())


def write_jdbc_append(df: DataFrame, target: JdbcTable) -> int:
    """Append `df`, creating the table if it is absent; returns the number of rows.

    Each task commits on its own, so a task that is run again after its commit, or a batch that is
    run again, adds its rows a second time. `write_jdbc_idempotent` is the safe form.
    """
    rows = _rows_for(df, target)
    written = write_counted(rows, lambda out: _write(out, target, target.table, "append"))
    # Appended rows cannot be told from those of an earlier run, so a lost count is taken from the source.
    return rows.count() if written is None else written


def write_jdbc_idempotent(
    df: DataFrame,
    batch_id: int,
    target: JdbcTable,
    *,
    owner: str = NO_STREAM,
    replay: bool = True,
    replace: bool = False,
) -> int:
    """Store the rows of `df` as batch `batch_id` unless that is done already; returns their number.

    Tasks fill a staging table; one database transaction then moves the staged rows over and enters
    the batch in the table `<table>_batches`, whose key admits it once. So readers see a batch whole
    or not at all, a replayed batch is found there and left alone, and of two drivers that overlap
    only one gets its batch in. A task that committed twice shows as a surplus in the number of rows
    moved: the transaction is rolled back and the batch staged afresh. So is one whose count was lost on
    its way to the driver, since nothing then tells a surplus.

    `replay` also removes rows of the batch that a plain append left, `replace` what is stored. A
    batch of the same id that another `owner` stored is an error.
    """
    spark, rows = df.sparkSession, _rows_for(df, target)
    _create_batches(spark, target)
    if not replace and (stored := _stored_rows(spark, target, batch_id, owner)) is not None:
        return stored
    # An empty append creates a missing table and rejects a column set that does not fit.
    _write(rows.where(F.lit(False)), target, target.table, "append")
    _index_batches(spark, target)
    # Named by owner and batch, so that what a dead driver left is found, and apart for drivers that overlap.
    stages = f"{target.table}_stage_{zlib.crc32(f'{owner} {batch_id}'.encode()):08x}_"
    stage = stages + uuid.uuid4().hex[:8]
    try:
        for attempt in range(1, STAGE_ATTEMPTS + 1):
            staged = write_counted(rows, lambda out: _write(out, target, stage, "overwrite"))
            if staged is not None and _publish(
                spark, target, stage, rows.columns, batch_id, staged, owner, replay, replace
            ):
                _drop_all(spark, target, stages)
                return staged
            log.warning("batch %s: staged rows were not %s, attempt %s", batch_id, staged, attempt)
    except Py4JJavaError:
        # The key turned this batch away if another driver got it in meanwhile.
        if replace or (stored := _stored_rows(spark, target, batch_id, owner)) is None:
            raise
        return stored
    finally:
        _drop(spark, target, stage)
    raise RuntimeError(f"batch {batch_id}: staging kept differing from the batch")


def _publish(
    spark: SparkSession,
    target: JdbcTable,
    stage: str,
    columns: list[str],
    batch_id: int,
    expected: int,
    owner: str,
    replay: bool,
    replace: bool,
) -> bool:
    own = _is_batch(spark, target, batch_id)
    names = ", ".join(target.quote(spark, name) for name in columns)
    with _statement(spark, target) as (connection, statement):
        if replace:
            statement.executeUpdate(f"DELETE FROM {_batches(target)} WHERE {own}")
        enter = connection.prepareStatement(
            f"INSERT INTO {_batches(target)} VALUES ({int(batch_id)}, {int(expected)}, ?)"
        )
        enter.setString(1, owner)
        enter.executeUpdate()
        if replay or replace:
            statement.executeLargeUpdate(f"DELETE FROM {target.table} WHERE {own}")
        moved = statement.executeLargeUpdate(
            f"INSERT INTO {target.table} ({names}) SELECT {names} FROM {stage} WHERE {own}"
        )
        if moved != expected:
            return False
        connection.commit()
        return True


def _batches(target: JdbcTable) -> str:
    return f"{target.table}_batches"


def _is_batch(spark: SparkSession, target: JdbcTable, batch_id: int) -> str:
    return f"{target.quote(spark, BATCH_ID)} = {int(batch_id)}"


def _create_batches(spark: SparkSession, target: JdbcTable) -> None:
    key, rows, owner = (target.quote(spark, name) for name in (BATCH_ID, "rows", "owner"))
    with _statement(spark, target) as (connection, statement):
        if not _has_table(connection, _batches(target)):
            statement.executeUpdate(
                f"CREATE TABLE {_batches(target)} ({key} INTEGER NOT NULL PRIMARY KEY, "
                f"{rows} BIGINT NOT NULL, {owner} VARCHAR(100) NOT NULL)"
            )
            connection.commit()


def _index_batches(spark: SparkSession, target: JdbcTable) -> None:
    """An index on the batch id of the trips, unless there is one; batches are looked up and replaced by it."""
    name = target.table.rpartition(".")[2]
    with _statement(spark, target) as (connection, statement):
        if not _has_index(connection, target.table):
            statement.executeUpdate(f"CREATE INDEX {name}_by_batch ON {target.table} ({target.quote(spark, BATCH_ID)})")
            connection.commit()


def _has_index(connection, table: str) -> bool:
    catalog = connection.getMetaData()
    schema, _, name = _catalog_name(catalog, table).rpartition(".")
    found = catalog.getIndexInfo(None, schema or connection.getSchema(), name, False, True)
    try:
        while found.next():
            if found.getString("COLUMN_NAME") == BATCH_ID:
                return True
        return False
    finally:
        found.close()


def _catalog_name(catalog, table: str) -> str:
    """`table`, written as in SQL without quotes, the way the catalog spells it."""
    if catalog.storesUpperCaseIdentifiers():
        return table.upper()
    return table.lower() if catalog.storesLowerCaseIdentifiers() else table


def _stored_rows(spark: SparkSession, target: JdbcTable, batch_id: int, owner: str) -> int | None:
    """The rows of a batch that `owner` has stored, None for one that is not stored."""
    rows, holder = target.quote(spark, "rows"), target.quote(spark, "owner")
    with _statement(spark, target) as (_, statement):
        found = statement.executeQuery(
            f"SELECT {rows}, {holder} FROM {_batches(target)} WHERE {_is_batch(spark, target, batch_id)}"
        )
        if not found.next():
            return None
        check_owner(batch_id, found.getString(2), owner)
        return found.getLong(1)


def _drop(spark: SparkSession, target: JdbcTable, table: str) -> None:
    with _statement(spark, target) as (connection, statement):
        if _has_table(connection, table):
            statement.executeUpdate(f"DROP TABLE {table}")
            connection.commit()


def _drop_all(spark: SparkSession, target: JdbcTable, prefix: str) -> None:
    """Drop the staging tables of a batch that is in; a driver still filling one is turned away by the batch's key."""
    with _statement(spark, target) as (connection, statement):
        catalog = connection.getMetaData()
        schema, _, name = _catalog_name(catalog, prefix).rpartition(".")
        found, names = catalog.getTables(None, schema or connection.getSchema(), f"{name}%", None), []
        while found.next():
            # The catalog takes an underscore as any character.
            if found.getString("TABLE_NAME").startswith(name):
                names.append(found.getString("TABLE_NAME"))
        found.close()
        for name in names:
            statement.executeUpdate(f"DROP TABLE {schema + '.' if schema else ''}{name}")
        connection.commit()


@contextmanager
def _statement(spark: SparkSession, target: JdbcTable):
    """A statement in an open transaction, on a driver-side connection; rolled back unless committed."""
    jvm = spark._jvm
    # By class loader rather than DriverManager, which does not see jars added with --jars.
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    properties = jvm.java.util.Properties()
    for key, value in target.login().items():
        properties.setProperty(key, value)
    connection = loader.loadClass(target.driver).newInstance().connect(target.url, properties)
    if connection is None:
        raise ValueError(f"{target.driver} does not take the database URL")
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            yield connection, statement
        finally:
            connection.rollback()
            statement.close()
    finally:
        connection.close()


def _has_table(connection, table: str) -> bool:
    """Whether `table`, written as in SQL without quotes, exists."""
    catalog = connection.getMetaData()
    schema, _, name = _catalog_name(catalog, table).rpartition(".")
    found = catalog.getTables(None, schema or connection.getSchema(), name, None)
    try:
        # The catalog takes the name as a pattern, in which an underscore matches any character.
        while found.next():
            if found.getString("TABLE_NAME") == name:
                return True
        return False
    finally:
        found.close()


def _scalar(spark: SparkSession, target: JdbcTable, table: str, sql: str) -> int | None:
    """The number `sql` gives, None for NULL, without a row or when there is no `table` yet."""
    with _statement(spark, target) as (connection, statement):
        if not _has_table(connection, table):
            return None
        result = statement.executeQuery(sql)
        if not result.next():
            return None
        value = result.getLong(1)
        return None if result.wasNull() else value


@dataclass(frozen=True)
class JdbcSink:
    """Replay-safe by default; `replay_safe=False` is the plain append."""

    target: JdbcTable
    replay_safe: bool = True

    def write(
        self, df: DataFrame, batch_id: int, *, owner: str = NO_STREAM, replay: bool = True, replace: bool = False
    ) -> int:
        if self.replay_safe:
            return write_jdbc_idempotent(df, batch_id, self.target, owner=owner, replay=replay, replace=replace)
        if replace:
            raise ValueError("a plain append cannot replace a batch")
        return write_jdbc_append(df, self.target)

    def last_batch_id(self, spark: SparkSession) -> int | None:
        highest = f"SELECT MAX({self.target.quote(spark, BATCH_ID)}) FROM"
        tables = (self.target.table, _batches(self.target))
        found = (_scalar(spark, self.target, table, f"{highest} {table}") for table in tables)
        return max((value for value in found if value is not None), default=None)

    def has_batch(self, spark: SparkSession, batch_id: int) -> bool:
        own = _is_batch(spark, self.target, batch_id)
        tables = (_batches(self.target), self.target.table)
        one = "SELECT 1 FROM {} WHERE " + own + " FETCH FIRST 1 ROWS ONLY"
        return any(_scalar(spark, self.target, table, one.format(table)) for table in tables)

    def read(self, spark: SparkSession) -> DataFrame:
        return read_sink_table(spark, self.target, num_partitions=self.target.max_connections)

    def count(self, spark: SparkSession) -> DataFrame:
        return sink_count(spark, self.target)

    def preview(self, spark: SparkSession, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
        return sink_preview(spark, self.target, n, order_by)
