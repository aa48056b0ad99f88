"""Metadata: what JSON can hold, dates as ISO text, reserved names refused."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping

RESERVED = "loomtext."


class MetadataError(ValueError):
    """A value that metadata cannot hold."""


def normalized(value: object, where: str = "metadata", reserved: str = RESERVED) -> object:
    """The value with dates as text and tuples as lists; raises MetadataError for what is not allowed."""
    if isinstance(value, Mapping):
        for k in value:
            if not isinstance(k, str):
                raise MetadataError(f"{where}: a key is a {type(k).__name__}, not a string")
            if k.startswith(reserved):
                raise MetadataError(f"{where}.{k}: names with {reserved!r} are reserved")
        return {k: normalized(v, f"{where}.{k}", reserved) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [normalized(v, f"{where}[{i}]", reserved) for i, v in enumerate(value)]
    if isinstance(value, dt.date):  # datetimes too
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        raise MetadataError(f"{where}: {value!r} is not finite")
    if value is None or isinstance(value, bool | int | float | str):
        return value
    raise MetadataError(f"{where}: {type(value).__name__} is not supported")
