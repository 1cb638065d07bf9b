"""What was landed against what is stored, row by row, repeats counted."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = "__row"


def reconcile(landed: DataFrame, stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns`, `landed` and `stored`: each row that the two tables hold a different number of times, with both numbers.

    Rows are compared by 128 bits of all `columns`, NULLs included, and counted before they are shuffled, so a row with
    very many repeats costs no more than another, and the rows themselves only travel with their counts.
    """
    identity = F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))
    sides = [
        df.groupBy(identity.alias(_ROW)).agg(F.first(F.struct(*columns)).alias(f"{name}_row"), F.count(F.lit(1)).alias(name))
        for name, df in (("landed", landed), ("stored", stored))
    ]
    both = sides[0].join(sides[1], _ROW, "full")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("landed", "stored")]
    row = F.coalesce("landed_row", "stored_row").alias(_ROW)
    return both.select(row, *counts).where("landed <> stored").select(f"{_ROW}.*", "landed", "stored")
