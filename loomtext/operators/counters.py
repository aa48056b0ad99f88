"""Numbers of tokens as columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import text


def _words(c: pa.Array) -> pa.Array:
    return pa.array([None if t is None else text.count_words(t) for t in c.to_pylist()], pa.int64())


def counts(column: str | Column, counter: str = "whitespace") -> Column:
    """Tokens of a text: its words, by white space of any script, or its characters."""
    if counter == "character":
        return F.length(column).cast("bigint")
    if counter != "whitespace":
        raise ValueError(f"no such counter: {counter}")
    return F.arrow_udf(_words, "bigint")(column)
