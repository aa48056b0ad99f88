"""Chunks as records for a vector index, and as JSON lines."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import ids
from loomtext.functions.batches import small_batches
from loomtext.functions.metadata import RESERVED

STRATEGIES = ("none", "title_only", "heading_path", "title_and_heading_path")
VERSION = "0.1.0"


def prepended(title: Column, path: Column, content: Column, strategy: str = "title_and_heading_path") -> Column:
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    parts = [content]
    if "heading_path" in strategy:
        parts.insert(0, F.when(F.size(path) > 0, F.array_join(path, " > ")))
    if "title" in strategy:
        parts.insert(0, title)
    return F.concat_ws("\n\n", *parts)


def merged_metadata(annotations: bool = False, system: bool = False) -> Column:
    """The metadata of a chunk as JSON with its types: that of the source, over it that of the document, and over both, with
    `annotations`, the kinds of structure in the chunk, and with `system` where it comes from. Names of the engine's own begin with RESERVED."""

    def build(source: pa.Array, document: pa.Array, kinds: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for s, d, k, o in zip(source.to_pylist(), document.to_pylist(), kinds.to_pylist(), own.to_pylist(), strict=True):
            got = json.loads(s or "{}") | json.loads(d or "{}") | {RESERVED + n: v for n, v in json.loads(o or "{}").items()}
            if annotations and k:
                got[f"{RESERVED}structure_types"] = k
            out.append(json.dumps(got, ensure_ascii=False))
        return pa.array(out, pa.string())

    names = ("document_id", "source_uri", "source_type", "section_id", "heading_path", "lineage")
    own = F.to_json(F.struct(*names, F.col("anchor").alias("chunk_anchor"), F.col("order_index").alias("chunk_order_index"), "section_chunk_index", F.lit(ids.SCHEMA_VERSION).alias("schema_version")), {"ignoreNullFields": "false"}) if system else F.lit("{}")
    return F.arrow_udf(build, "string")("source_metadata", "frontmatter", "structure_types", own)


def records(chunks: DataFrame, created_at: str, strategy: str = "title_and_heading_path", annotations: bool = False) -> DataFrame:
    """Version-1 records of `chunks` that carry title, source_metadata and frontmatter; user_metadata is JSON."""
    return small_batches(chunks).select(
        F.col("chunk_id").alias("id"), "document_id", "section_id", F.col("anchor").alias("chunk_anchor"), "section_anchor",
        prepended(F.col("title"), F.col("heading_path"), F.col("content_text"), strategy).alias("text"), "content_hash", F.length("content_text").alias("char_count"),
        "source_uri", "title", F.col("heading_path").alias("section_path"), F.lit(ids.SCHEMA_VERSION).alias("schema_version"), F.lit(VERSION).alias("pipeline_version"), F.lit(created_at).alias("created_at"), merged_metadata(annotations).alias("user_metadata"),
    )


def legacy_records(chunks: DataFrame, strategy: str = "title_and_heading_path", annotations: bool = False) -> DataFrame:
    """(id, text, metadata): the older form, whose metadata (JSON) holds ten names of the engine's own. `chunks` carry source_type too."""
    return small_batches(chunks).select(F.col("chunk_id").alias("id"), prepended(F.col("title"), F.col("heading_path"), F.col("content_text"), strategy).alias("text"), merged_metadata(annotations, system=True).alias("metadata"))


def _as_json(rows: DataFrame) -> Column:
    """A row as a JSON object, in which the columns of metadata are objects too."""
    nested = [c for c in ("user_metadata", "metadata") if c in rows.columns]
    plain = F.to_json(F.struct(*[c for c in rows.columns if c not in nested]), {"ignoreNullFields": "false"})
    return F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), *[x for c in nested for x in (F.lit(f', "{c}": '), F.coalesce(c, F.lit("null")))], F.lit("}"))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): a line for each record."""
    return rows.select(_as_json(rows).alias("value"))


def delta_lines(delta: DataFrame) -> DataFrame:
    """(value): first the records that were added or modified, in order, then a line {"_deleted": true, "id": ...} for each that is gone."""
    write = delta.filter("op <> 'deleted'").drop("op")
    gone = delta.filter("op = 'deleted'").select(F.concat(F.lit('{"_deleted": true, "id": "'), "id", F.lit('"}')).alias("value"), F.lit(1).alias("last"), "id")
    rows = write.select(_as_json(write).alias("value"), F.lit(0).alias("last"), "id").union(gone)
    return rows.orderBy("last", "id").select("value")
