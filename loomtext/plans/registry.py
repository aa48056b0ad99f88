"""Components by name: the engine's own, those registered here, and those that installed packages offer.

A loader is (spark, source) -> sources; an adapter is (spark, source) -> documents (already parsed); a parser is sources -> parsed rows;
a chunker is an object with `pieces`; a store is what `Store` does. A package offers components by entry points in the groups
loomtext.loaders, .parsers, .chunkers, .stores and .adapters; one that cannot be loaded is warned of and left out."""

from __future__ import annotations

import importlib.metadata
import warnings
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from loomtext.operators import chunks as C
from loomtext.operators import parse as P
from loomtext.plans.config import Config, Part
from loomtext.sources.files import FileRules, read_files
from loomtext.sources.store import Store

KINDS = ("loaders", "parsers", "chunkers", "stores", "adapters")


def _loader(**values: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, source: read_files(spark, source, FileRules(include=values["include_globs"], exclude=values["exclude_globs"], hidden=values["hidden_policy"], symlinks=values["symlink_policy"], encoding=values["encoding"], errors=values["encoding_errors"]))


def _markdown_loader(glob_pattern: str = "**/*.md") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, source: read_files(spark, source, FileRules(include=(glob_pattern,), hidden="include", unknown="text/markdown"))


BUILT_IN: dict[str, dict[str, Callable]] = {
    "loaders": {"filesystem": _loader, "markdown": _markdown_loader},
    "parsers": {"auto": lambda: P.parse} | {k: partial(lambda m: partial(P.parse, only=m), m) for m, k in P.KINDS.items()},
    "chunkers": {"heading": lambda: None, "size": C.SizeChunker, "token": lambda max_tokens=512, overlap_tokens=0, tokenizer="whitespace": C.TokenChunker(max_tokens, overlap_tokens, tokenizer)},
    "stores": {"parquet": Store},
    "adapters": {},
}
_registered: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def _group(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"no such kind of component: {kind}; there are {', '.join(KINDS)}")
    return f"loomtext.{kind}"


def register(kind: str, name: str, component: Callable) -> None:
    _group(kind)
    _registered[kind][name] = component


def plugged(kind: str) -> dict[str, Callable]:
    """What was registered or is offered by installed packages."""
    out = {}
    for e in importlib.metadata.entry_points(group=_group(kind)):
        try:
            out[e.name] = e.load()
        except Exception as error:  # noqa: BLE001 - a broken package must not end the others' work
            warnings.warn(f"{kind} {e.name!r} ({e.value}) cannot be loaded: {error}", RuntimeWarning, stacklevel=2)
    return out | _registered[kind]


def components(kind: str) -> dict[str, Callable]:
    """All of a kind; plug-ins replace the engine's own of the same name."""
    return BUILT_IN[kind] | plugged(kind) if kind in BUILT_IN else plugged(kind)


def resolve(kind: str, name: str) -> Callable:
    """One component; the engine's own come first."""
    if name in BUILT_IN.get(kind, {}):
        return BUILT_IN[kind][name]
    found = plugged(kind)
    if name not in found:
        raise LookupError(f"no {kind} named {name!r}; there are {', '.join(sorted(components(kind))) or 'none'}")
    return found[name]


def build(kind: str, part: Part) -> object:
    return resolve(kind, part.type)(**part.values)


def chunker_of(config: Config) -> object:
    """The chunker of a list of stages: headings first, then one that cuts sections."""
    if config.chunkers is None:
        return C.SizeChunker()
    return C.composed([build("chunkers", c) for c in config.chunkers])
