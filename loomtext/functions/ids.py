"""Identifiers and hashes as column expressions, all within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_HEX = "a1b2c3d4e5f67890abcdef1234567890"
IDENTITY_VERSION = 3
SCHEMA_VERSION = 1


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the engine's namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("bigint").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def document_id(source_uri: Column) -> Column:
    return uuid5(source_uri)


def section_id(document: Column, anchor: Column) -> Column:
    return uuid5(F.concat(document, F.lit(":section:"), anchor))


def chunk_id(document: Column, anchor: Column) -> Column:
    return uuid5(F.concat(document, F.lit(":chunk:"), anchor))


def chunk_anchor(section_anchor: Column, index: Column) -> Column:
    return F.concat(section_anchor, F.lit(":chunk_"), index.cast("string"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def stem(uri: Column) -> Column:
    """The last part of a URI's path, without its last suffix."""
    path = F.regexp_replace(F.regexp_replace(uri, "^file:", ""), "(?s)/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.length(F.regexp_extract(last, r"^(.+)\.[^.]+$", 1)) > 0, F.regexp_extract(last, r"^(.+)\.[^.]+$", 1)).otherwise(last)
