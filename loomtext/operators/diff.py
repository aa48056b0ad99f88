"""Structural differences of two snapshots, keyed on anchors: one full outer join, one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import ids

STATUSES = ("added", "modified", "removed", "unchanged")


def _last(rows: DataFrame) -> DataFrame:
    """One hash for each anchor: of duplicates the last one."""
    return rows.groupBy("source_uri", "anchor").agg(F.max_by("content_hash", "order_index").alias("hash"))


def deltas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(source_uri, anchor, status, previous_hash, current_hash) for sections or chunks of two snapshots."""
    p, c = _last(previous).withColumnRenamed("hash", "previous_hash"), _last(current).withColumnRenamed("hash", "current_hash")
    both = p.join(c, ["source_uri", "anchor"], "full_outer")
    status = F.when(F.col("previous_hash").isNull(), "added").when(F.col("current_hash").isNull(), "removed").when(F.col("previous_hash") != F.col("current_hash"), "modified").otherwise("unchanged")
    return both.select("source_uri", "anchor", status.alias("status"), "previous_hash", "current_hash")


def summary(section_deltas: DataFrame, chunk_deltas: DataFrame) -> DataFrame:
    """Eight counts for each source."""
    both = section_deltas.select("source_uri", "status", F.lit("sections").alias("of")).union(chunk_deltas.select("source_uri", "status", F.lit("chunks").alias("of")))
    return both.groupBy("source_uri").agg(*[F.count_if((F.col("of") == of) & (F.col("status") == s)).alias(f"{of}_{s}") for of in ("sections", "chunks") for s in STATUSES])


def changed(sums: DataFrame) -> DataFrame:
    """`sums` of `summary` with a column changed: whether anything was added, removed or modified."""
    some = [F.col(f"{of}_{s}") for of in ("sections", "chunks") for s in STATUSES if s != "unchanged"]
    return sums.withColumn("changed", sum(some[1:], some[0]) > 0)


def changed_counts(sums: DataFrame) -> DataFrame:
    """(changed, unchanged): numbers of documents."""
    return changed(sums).agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))


def revision_diff(previous: DataFrame | None, current: DataFrame, previous_documents: DataFrame | None, current_documents: DataFrame, of: str) -> DataFrame:
    """`deltas` of the sources in `current_documents`, with the checksums of both revisions (an empty one where there was none);
    of: sections or chunks, for the column of that name. Without a previous snapshot everything is added."""
    if previous is None or previous_documents is None:
        previous, previous_documents = current.limit(0), current_documents.limit(0)
    old = previous_documents.select("source_uri", F.col("source_checksum").alias("previous_revision"))
    now = current_documents.select("source_uri", F.col("source_checksum").alias("current_revision"))
    found = deltas(previous, current).join(now, "source_uri").join(old, "source_uri", "left")
    return found.select("source_uri", F.coalesce("previous_revision", F.lit("")).alias("previous_revision"), "current_revision", F.lit(of).alias("of"), "anchor", "status", "previous_hash", "current_hash")


def compare_one(previous: DataFrame | None, current: DataFrame) -> None:
    """Raises ValueError unless both (documents) have exactly one row and the same source."""
    uris = []
    for name, docs in (("previous", previous), ("current", current)):
        if docs is None:
            continue
        rows = docs.select("source_uri").limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"the {name} snapshot must have exactly one document")
        uris.append(rows[0][0])
    if len(set(uris)) > 1:
        raise ValueError("both snapshots must be of one source")


def in_order(found: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return found.orderBy("source_uri", rank, "anchor")


def export_delta(chunk_deltas: DataFrame, records: DataFrame) -> DataFrame:
    """What an index must do: op (added, modified, deleted), id, and the records to write."""
    changed = chunk_deltas.filter(F.col("status").isin("added", "modified")).select("source_uri", F.col("anchor").alias("chunk_anchor"), F.col("status").alias("op"))
    write = records.join(changed, ["source_uri", "chunk_anchor"]).select("op", *records.columns)
    gone = chunk_deltas.filter("status = 'removed'").select(F.lit("deleted").alias("op"), ids.chunk_id(ids.document_id(F.col("source_uri")), F.col("anchor")).alias("id"))
    return write.unionByName(gone, allowMissingColumns=True)


def revisions_to_prune(revisions: DataFrame, max_depth: int = 10) -> DataFrame:
    """All but the newest `max_depth` revisions of each document."""
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    w = Window.partitionBy("document_id").orderBy(F.desc("revision_number"))
    return revisions.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") > max_depth).drop("__n")
