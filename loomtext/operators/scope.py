"""Which sources a run speaks for, and which of the stored ones are stale."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope_of(source: str | Path, explicit: str | None = None) -> tuple[str, ...]:
    """The prefixes of a run over `source`; a folder without an explicit scope speaks for all files."""
    if explicit is not None:
        given = explicit.strip().replace("\\", "/")
        return ("file:" if given == "file:." else given,)
    path = Path(source)
    if path.is_file():
        return (f"file:{path.name}",)
    return ("file:",) if path.is_dir() else (f"file:{path.name}/",)


def in_scope(uri: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(uri, F.lit(p)) if p.endswith("/") or p == "file:" else uri == p for p in prefixes], F.lit(False))


def stale(stored: DataFrame, seen: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return stored.filter(in_scope(F.col("source_uri"), prefixes)).join(seen.select("source_uri"), "source_uri", "left_anti")


def upsert_classes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(source_uri, action): inserted, updated or skipped, by checksum and identity version."""
    old = stored.select("source_uri", F.col("source_checksum").alias("__c"), F.col("identity_version").alias("__v"))
    same = (F.col("__c") == F.col("source_checksum")) & (F.col("__v") == F.col("identity_version"))
    return current.join(old, "source_uri", "left").select("source_uri", F.when(F.col("__c").isNull(), "inserted").when(same, "skipped").otherwise("updated").alias("action"))
