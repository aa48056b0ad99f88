"""Sources to documents: title, metadata and Markdown body by media type, in one Arrow function.

A source that cannot be parsed becomes a row with `error` set instead of ending the job; `documents`
and `errors` are the two parts."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import ids, markup
from loomtext.functions.batches import once, small_batches
from loomtext.functions.metadata import normalized

KINDS = {"text/markdown": "markdown", "text/plain": "plaintext", "text/html": "html", "text/x-rst": "rst"}
_PARSED = "struct<title:string,frontmatter:string,body:string,error:string>"


def parse_one(raw: str, media_type: str) -> tuple[str | None, dict, str]:
    """(title, metadata, body)."""
    kind = KINDS.get(media_type)
    if kind == "html":
        title, body = markup.html(raw)
        return title, {}, body
    if kind == "rst":
        return markup.rst(raw)
    if kind == "markdown":
        fields, body = markup.front_matter(raw)
        return markup.markdown_title(fields, body), fields, body
    if kind == "plaintext":
        return next((x.strip() for x in raw.splitlines() if x.strip()), None), {}, raw
    raise ValueError(f"no parser for {media_type}")


def _parse(raw: pa.Array, kind: pa.Array, meta: pa.Array) -> pa.Array:
    out = []
    for r, k, m in zip(raw.to_pylist(), kind.to_pylist(), meta.to_pylist(), strict=True):
        try:
            title, fields, body = parse_one(r or "", k)
            normalized(json.loads(m or "{}"), "source_metadata")
            out.append({"title": title, "frontmatter": json.dumps(normalized(fields, "frontmatter"), ensure_ascii=False), "body": body, "error": None})
        except Exception as e:  # noqa: BLE001 - one bad source must not end the job; it is reported
            out.append({"title": None, "frontmatter": "{}", "body": None, "error": f"{type(e).__name__}: {e}"})
    return pa.array(out, pa.struct([(n, pa.string()) for n in ("title", "frontmatter", "body", "error")]))


def parse(sources: DataFrame, only: str | None = None) -> DataFrame:
    """One row for each source, with document_id, title, body, frontmatter and error. only: parse all as this media type."""
    if "load_error" not in sources.columns:
        sources = sources.withColumn("load_error", F.lit(None).cast("string"))
    if only is not None:
        sources = sources.withColumn("media_type", F.lit(only))
    p = small_batches(sources).withColumn("__p", once(_parse, _PARSED)("raw_text", "media_type", "source_metadata"))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("media_type")]
    blank = F.length(F.regexp_replace(F.coalesce("__p.body", F.lit("")), r"(?U)\s", "")) == 0
    error = F.coalesce("load_error", "__p.error", F.when(blank, "blank body"))
    return p.select(ids.document_id(F.col("source_uri")).alias("document_id"), "source_uri", F.coalesce("__p.title", ids.stem(F.col("source_uri"))).alias("title"), F.col("checksum").alias("source_checksum"), kind.alias("source_type"), F.col("__p.frontmatter").alias("frontmatter"), "source_metadata", F.col("__p.body").alias("body"), F.lit(ids.IDENTITY_VERSION).alias("identity_version"), error.alias("error"))


def documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").drop("error")


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select("source_uri", "error")
