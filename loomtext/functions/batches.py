"""Arrow functions over texts: batches of bounded size, and one call for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of at most BATCH_BYTES from here on, however long the texts: a batch by rows
    alone would hold as many long texts as short ones, once in the JVM and once in each worker.
    A smaller limit that the session has already stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    raw = str(conf.get(key)).lower().rstrip("b")
    now = int(raw) if raw.lstrip("-").isdigit() else -1
    if not 0 < now <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def once(f: Callable, returns: str) -> Callable:
    """An Arrow function that Spark does not call a second time for a filter on what it returns: it is said not to be
    deterministic, as Spark puts copies of one that is below such a filter and above it, each in a worker of its own."""
    return F.arrow_udf(f, returns).asNondeterministic()
