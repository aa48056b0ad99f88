"""A stream of sources into a store: each micro-batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.chunks import SizeChunker, TokenChunker
from loomtext.plans.ingest import ingest
from loomtext.sources.store import Store


def latest(batch: DataFrame, order: str | None) -> DataFrame:
    """One version of each source: the last by the column `order`; equal ones are told apart by their checksums."""
    keys = [F.desc_nulls_last(order)] if order else []
    w = Window.partitionBy("source_uri").orderBy(*keys, F.desc("checksum"))
    return batch.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ingest_stream(sources: DataFrame, store: Store, checkpoint: str, chunker: SizeChunker | TokenChunker = SizeChunker(), order: str | None = None) -> StreamingQuery:
    """order: the column (a time, a number of a version) that tells which of several versions of a source is the last; without
    one a batch that has two different versions of a source is refused, as nothing says which is right. Batches
    may be repeated, as an upsert of what is stored already is skipped."""

    def step(batch: DataFrame, _: int) -> None:
        if order is None:
            twice = batch.groupBy("source_uri").agg(F.count_distinct("checksum").alias("n")).filter("n > 1")
            if (bad := twice.first()) is not None:
                raise ValueError(f"{bad['source_uri']} comes in {bad['n']} versions; name a column that orders them")
        ingest(latest(batch, order), chunker, store)

    return sources.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
