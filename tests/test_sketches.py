from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tripflow.schema import STORED_SCHEMA
from tripflow.sinks import ParquetSink, compact, estimates, sketch_batches
from tripflow.sinks.sketches import DISTINCT_ERROR, RANK_ERROR

COLUMNS = {"distinct": ["pickup_longitude", "VendorID"], "quantiles": ["trip_Length"]}


def batch(spark, batch_id, values):
    rows = spark.createDataFrame([(int(v) % 7 if v else None, f"p{int(v)}", float(v)) for v in values], "VendorID int, pickup_longitude string, trip_Length double")
    known = {f.name for f in rows.schema}
    missing = {f.name: F.lit(None).cast(f.dataType) for f in STORED_SCHEMA if f.name not in known and f.name != "Id"}
    return rows.withColumns(missing).withColumn("Id", F.lit(batch_id)).select(*STORED_SCHEMA.names)


def test_merged_sketches(spark, tmp_path):
    sink = ParquetSink(str(tmp_path / "sink"))
    draw = np.random.default_rng(1)
    values = [draw.integers(0, 3_000, 4_000), draw.integers(2_000, 9_000, 2_500), draw.integers(0, 50, 10)]
    for i, v in enumerate(values[:2]):
        sink.write(batch(spark, i, v), i)
    assert sketch_batches(sink, spark, **COLUMNS) == 2
    sink.write(batch(spark, 2, values[2]), 2)
    assert sketch_batches(sink, spark, **COLUMNS) == 1 and sketch_batches(sink, spark, **COLUMNS) == 0
    whole = np.concatenate(values)
    row = estimates(sink, spark, distinct=COLUMNS["distinct"], quantiles={"trip_Length": [0.0, 0.25, 0.5, 1.0]}).first()
    assert row["rows"] == len(whole)
    users = len(set(whole.tolist()))
    assert abs(row["distinct pickup_longitude"] - users) <= 3 * DISTINCT_ERROR * users and row["distinct VendorID"] == 7
    low, quarter, half, high = row["quantile trip_Length"]
    assert (low, high) == (whole.min(), whole.max())
    for rank, q in ((0.25, quarter), (0.5, half)):
        assert (whole < q).mean() <= rank + RANK_ERROR and (whole <= q).mean() >= rank - RANK_ERROR
    # Merging batches leaves their sketches.
    compact(sink, spark)
    assert sketch_batches(sink, spark, **COLUMNS) == 0


def test_none_and_unfinished(spark, tmp_path):
    sink = ParquetSink(str(tmp_path / "sink"))
    asked = {"distinct": ["VendorID"], "quantiles": {"trip_Length": [0.5]}}
    assert sketch_batches(sink, spark, **COLUMNS) == 0 and estimates(sink, spark, **asked).collect() == []
    sink.write(batch(spark, 0, [1, 2, 3]), 0)
    sketch_batches(sink, spark, **COLUMNS)
    [folder] = Path(sink.path, "_sketches").iterdir()
    (folder / "_SUCCESS").unlink()
    assert estimates(sink, spark, **asked).collect() == []
    assert sketch_batches(sink, spark, **COLUMNS) == 1
    assert tuple(estimates(sink, spark, **asked).first()) == (3, 3, [2.0])
