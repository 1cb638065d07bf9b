"""Row counts taken while a batch is written, so that counting costs no scan of its own."""

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

WAIT_SECONDS = 60


def write_counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int | None:
    """Run `write` over `df` and return how many rows went through, None where that count was lost.

    The plans written here have no shuffle, so every task is a result task and Spark counts each
    partition once, however often it is retried. A lost count is for the caller to replace: a second
    scan of `df` would cost as much as the write, and might see a source that has changed since.
    """
    observation = Observation()
    write(df.observe(observation, F.count(F.lit(1)).alias("rows")))
    return _arrived(observation)


def _arrived(observation: Observation) -> int | None:
    """The observed count, or None when it does not come.

    It travels over Spark's listener bus, which drops events under heavy load, and waiting for it
    has no time limit of its own.
    """
    got: list[int] = []
    waiter = threading.Thread(target=lambda: got.append(observation.get["rows"]), daemon=True)
    waiter.start()
    waiter.join(WAIT_SECONDS)
    return got[0] if got else None
