"""Settings from a TOML file and the environment, checked against one table of rules.

Names that a table of the file may have, their kinds, defaults and bounds stand in TABLES; errors name
the file, the place and what was expected. Variables LOOMTEXT_SOURCE, LOOMTEXT_JSON, LOOMTEXT_STORE__PATH,
LOOMTEXT_EXPORT__TEXT_PREPEND and LOOMTEXT_EXPORT__INCLUDE_ANNOTATIONS go before the file."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from types import MappingProxyType

from loomtext.operators.export import STRATEGIES

FILE = "loomtext.toml"
PREFIX = "LOOMTEXT_"


class ConfigError(ValueError):
    """Settings that cannot be used."""


@dataclass(frozen=True)
class Rule:
    kind: type
    default: object = None
    least: int | None = None
    among: tuple[str, ...] = ()
    needed: bool = False

    def check(self, value: object, where: str) -> object:
        if self.kind is tuple:
            if not isinstance(value, list):
                raise ConfigError(f"{where}: expected a list of strings, got {type(value).__name__}")
            for i, x in enumerate(value):
                if not isinstance(x, str):
                    raise ConfigError(f"{where}[{i}]: expected a string, got {type(x).__name__}")
            return tuple(value)
        if not isinstance(value, self.kind) or (self.kind is int and isinstance(value, bool)):
            raise ConfigError(f"{where}: expected {self.kind.__name__}, got {type(value).__name__}")
        if self.least is not None and value < self.least:
            raise ConfigError(f"{where}: expected {self.least} or more, got {value}")
        if self.among and value not in self.among:
            raise ConfigError(f"{where}: expected one of {', '.join(sorted(self.among))}, got {value!r}")
        return value


_GLOBS = ("**/*.md", "**/*.txt", "**/*.html", "**/*.htm", "**/*.rst")
#: table -> type -> name -> rule; a table whose types are {"": ...} has no type.
TABLES: Mapping[str, Mapping[str, Mapping[str, Rule]]] = MappingProxyType({
    "loader": {
        "markdown": {"glob_pattern": Rule(str, "**/*.md")},
        "filesystem": {"include_globs": Rule(tuple, _GLOBS), "exclude_globs": Rule(tuple, ()), "hidden_policy": Rule(str, "skip", among=("skip", "include")), "symlink_policy": Rule(str, "follow", among=("follow", "skip")), "encoding": Rule(str, "utf-8"), "encoding_errors": Rule(str, "strict", among=("strict", "replace", "ignore"))},
    },
    "parser": {k: {} for k in ("auto", "markdown", "plaintext", "html", "rst")},
    "chunkers": {
        "heading": {},
        "size": {"max_chars": Rule(int, 1500, least=1), "overlap_chars": Rule(int, 0, least=0), "min_chars": Rule(int, 0, least=0)},
        "token": {"max_tokens": Rule(int, 512, least=1), "overlap_tokens": Rule(int, 0, least=0), "tokenizer": Rule(str, "whitespace", among=("whitespace", "character"))},
    },
    "store": {"": {"path": Rule(str, needed=True)}},
    "export": {"": {"text_prepend": Rule(str, "title_and_heading_path", among=STRATEGIES), "include_annotations": Rule(bool, False)}},
})


@dataclass(frozen=True)
class Part:
    """The settings of one component."""

    type: str
    values: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    source: str | None = None
    json: bool | None = None
    loader: Part | None = None
    parser: Part | None = None
    chunkers: tuple[Part, ...] | None = None
    store: Part | None = None
    export: Part | None = None
    path: Path | None = None

    def resolved_source(self) -> str | None:
        """The source; a relative one is relative to the file that names it."""
        if self.source is None or self.path is None or Path(self.source).is_absolute():
            return self.source
        return str(self.path.parent / self.source)


def _known(raw: Mapping, allowed: set[str], where: str) -> None:
    if unknown := sorted(set(raw) - allowed):
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}; allowed: {', '.join(sorted(allowed))}")


def _part(name: str, raw: object, where: str) -> Part:
    if not isinstance(raw, Mapping):
        raise ConfigError(f"{where}: expected a table, got {type(raw).__name__}")
    types = TABLES[name]
    kind = ""
    if "" not in types:
        if "type" not in raw:
            raise ConfigError(f"{where}: type is missing")
        kind = Rule(str).check(raw["type"], f"{where}.type")
        if kind not in types:
            raise ConfigError(f"{where}: unknown type {kind!r}; supported: {', '.join(sorted(types))}")
    rules = types[kind]
    # a loader's names are allowed for either type, as its type may change while they stay
    allowed = {k for t in types.values() for k in t} if name == "loader" else set(rules)
    _known(raw, allowed | ({"type"} if kind else set()), where)
    values = {}
    for k, rule in rules.items():
        if k not in raw and rule.needed:
            raise ConfigError(f"{where}: {k} is missing")
        values[k] = rule.check(raw[k], f"{where}.{k}") if k in raw else rule.default
    for unit in ("chars", "tokens"):
        if values.get(f"overlap_{unit}", 0) and values[f"overlap_{unit}"] >= values[f"max_{unit}"]:
            raise ConfigError(f"{where}.overlap_{unit}: expected less than max_{unit} ({values[f'max_{unit}']}), got {values[f'overlap_{unit}']}")
    return Part(kind, MappingProxyType(values))


def _flag(raw: str) -> object:
    return {"true": True, "1": True, "false": False, "0": False}.get(raw.lower(), raw)


def overridden(raw: dict, env: Mapping[str, str]) -> dict:
    """The raw settings with those of the environment in their places."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in raw.items()}
    for key, place, read in (("SOURCE", ("source",), str), ("JSON", ("json",), _flag), ("STORE__PATH", ("store", "path"), str), ("EXPORT__TEXT_PREPEND", ("export", "text_prepend"), str), ("EXPORT__INCLUDE_ANNOTATIONS", ("export", "include_annotations"), _flag)):
        if PREFIX + key in env:
            into = out
            for name in place[:-1]:
                into = into.setdefault(name, {})
            into[place[-1]] = read(env[PREFIX + key])
    return out


def parsed(raw: dict, path: Path | None = None) -> Config:
    where = str(path or "<environment>")
    _known(raw, {"source", "json", *TABLES}, where)
    got: dict[str, object] = {}
    for name, kind in (("source", str), ("json", bool)):
        if name in raw:
            got[name] = Rule(kind).check(raw[name], f"{where}: {name}")
    for name in TABLES:
        if name not in raw:
            continue
        if name == "chunkers":
            if not isinstance(raw[name], list):
                raise ConfigError(f"{where}: chunkers: expected a list of tables, got {type(raw[name]).__name__}")
            got[name] = tuple(_part(name, x, f"{where}: chunkers[{i}]") for i, x in enumerate(raw[name]))
        else:
            got[name] = _part(name, raw[name], f"{where}: {name}")
    return Config(**got, path=path)


def find(start: Path | None = None) -> Path | None:
    """The file in this folder or the nearest one above."""
    here = (start or Path.cwd()).resolve()
    return next((d / FILE for d in (here, *here.parents) if (d / FILE).is_file()), None)


def load(path: str | Path | None = None, start: Path | None = None, env: Mapping[str, str] | None = None) -> Config:
    """The settings of a file, of the nearest one, or of the environment alone."""
    file = Path(path).expanduser().resolve() if path is not None else find(start)
    raw: dict = {}
    if file is not None:
        if not file.is_file():
            raise ConfigError(f"{file}: no such file")
        try:
            raw = tomllib.loads(file.read_text("utf-8"))
        except (tomllib.TOMLDecodeError, OSError, UnicodeDecodeError) as e:
            raise ConfigError(f"{file}: {e}") from e
    before = parsed(raw, file)  # the file must be right by itself
    now = overridden(raw, os.environ if env is None else env)
    return before if now == raw else parsed(now, file)
