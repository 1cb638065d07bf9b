"""The stored trips table in a database, read back for validation."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tripflow.schema import BATCH_ID, PICKUP


@dataclass(frozen=True)
class JdbcTable:
    """Where the rows are stored, and how hard Spark may lean on the database."""

    url: str
    table: str
    driver: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    max_connections: int = 32
    batch_size: int = 10_000

    def login(self) -> dict[str, str]:
        given = {"user": self.user, "password": self.password}
        return {key: value for key, value in given.items() if value is not None}

    def properties(self) -> dict[str, str]:
        """What Spark's reader and writer take."""
        return {"driver": self.driver} | self.login()

    def quote(self, spark: SparkSession, column: str) -> str:
        """`column` the way Spark's writer quotes it for this database."""
        return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(column)


def _query(spark: SparkSession, target: JdbcTable, sql: str) -> DataFrame:
    reader = spark.read.format("jdbc").options(**target.properties())
    return reader.option("url", target.url).option("query", sql).option("preferTimestampNTZ", True).load()


def _zoned(df: DataFrame) -> DataFrame:
    """Stored wall-clock times as instants of the session's zone, the type they had before storing."""
    naive = [f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)]
    return df.withColumns({name: F.col(name).cast("timestamp") for name in naive})


def read_sink_table(spark: SparkSession, target: JdbcTable, *, num_partitions: int | None = None) -> DataFrame:
    """The whole table, read over up to `num_partitions` connections, `max_connections` unless given.

    It is cut by batch ids, which are indexed, into ranges of about as many rows each, and a batch with more rows than
    a range further by equal counts of its pickup times. A stray or missing time so makes no large range.
    """
    options = target.properties() | {"fetchsize": str(target.batch_size), "preferTimestampNTZ": "true"}
    ranges = _ranges(spark, target, num_partitions or target.max_connections)
    return _zoned(spark.read.jdbc(target.url, target.table, predicates=ranges, properties=options))


def _ranges(spark: SparkSession, target: JdbcTable, parts: int) -> list[str]:
    """Predicates that together hold each row once; NULL ids and times go with the first range of theirs."""
    name, time = target.quote(spark, BATCH_ID), target.quote(spark, PICKUP)
    counted = f"SELECT {name} AS id, COUNT(*) AS n FROM {target.table} WHERE {name} IS NOT NULL GROUP BY {name}"
    batches = _query(spark, target, counted).toDF("id", "n").orderBy("id").collect()
    most = max(1, -(-sum(b.n for b in batches) // parts))
    cuts, held, split = [], 0, {}
    for b in batches:
        if held and held + b.n > most:
            cuts.append(b.id)
            held = 0
        held += b.n
        if b.n > most:
            split[b.id] = -(-b.n // most)
    whole = [f"{name} >= {low} AND {name} < {high}" for low, high in pairwise(cuts)]
    if cuts:
        whole = [f"({name} < {cuts[0]} OR {name} IS NULL)", *whole, f"{name} >= {cuts[-1]}"]
    else:
        whole = [f"({name} >= {batches[0].id} OR {name} < {batches[0].id} OR {name} IS NULL)" if batches else "1 = 1"]
    firsts = [None, *cuts]
    found = []
    for first, predicate in zip(firsts, whole, strict=True):
        large = first if first is not None else (batches[0].id if batches else None)
        times = _time_cuts(spark, target, large, split[large]) if large in split else []
        if not times:
            found.append(predicate)
            continue
        between = [f"{time} >= {low} AND {time} < {high}" for low, high in pairwise(times)]
        spans = [f"({time} < {times[0]} OR {time} IS NULL)", *between, f"{time} >= {times[-1]}"]
        found += [f"{predicate} AND {span}" for span in spans]
    return found


def _time_cuts(spark: SparkSession, target: JdbcTable, batch_id: int, parts: int) -> list[str]:
    """Pickup times that cut a batch into parts of about equal counts, found by the database; at most parts - 1."""
    name, time = target.quote(spark, BATCH_ID), target.quote(spark, PICKUP)
    tiled = (
        f"SELECT t AS low FROM (SELECT {time} AS t, ROW_NUMBER() OVER () AS k FROM "
        f"(SELECT {time} FROM {target.table} WHERE {name} = {int(batch_id)} AND {time} IS NOT NULL ORDER BY {time}) o) r "
        f"WHERE MOD(k, {{step}}) = 0 AND k < {{n}}"
    )
    n = _query(spark, target, f"SELECT COUNT({time}) AS n FROM {target.table} WHERE {name} = {int(batch_id)}").first()[0]
    step = max(1, -(-n // parts))
    lows = sorted({r[0] for r in _query(spark, target, tiled.format(step=step, n=n)).collect() if r[0] is not None})
    return [f"{{ts '{low}'}}" for low in lows]


def sink_count(spark: SparkSession, target: JdbcTable) -> DataFrame:
    """One row, `n`: counted by the database, so no trip row crosses the network."""
    counted = _query(spark, target, f"SELECT COUNT(*) AS n FROM {target.table}")
    return counted.select(F.col(counted.columns[0]).cast("long").alias("n"))


def sink_preview(spark: SparkSession, target: JdbcTable, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """`n` rows, cut by the database; the first ones by the columns `order_by` when given."""
    order = f" ORDER BY {', '.join(target.quote(spark, name) for name in order_by)}" if order_by else ""
    return _zoned(_query(spark, target, f"SELECT * FROM {target.table}{order} FETCH FIRST {int(n)} ROWS ONLY"))
