"""Files as sources: listing on the driver, reading on the executors.

The listing follows rules that Hadoop's globs do not have (hidden parts, symbolic links, exclusion),
so paths are found on the driver. Contents are read on the executors, each path as it is named: Spark's own file sources
would take brackets in it for a pattern, and leave out files whose names begin with an underscore or a full stop. A file
that cannot be read or decoded is a row with a load_error, which parsing reports as the error of its source."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import ids
from loomtext.functions.batches import small_batches

MEDIA_TYPES = {".md": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".rst": "text/x-rst"}
SOURCES = "source_path string, source_uri string, raw_text string, checksum string, media_type string, source_metadata string, load_error string"
FILES_IN_A_TASK, TASKS = 200, 1000  #: more than TASKS are not made, but larger ones
OUT_BYTES = 1 << 20
_SUFFIX = re.compile(r"\*\*/\*([^*?\[/]+)")


class LoadError(Exception):
    """A source that cannot be read."""


@dataclass(frozen=True)
class FileRules:
    include: Sequence[str] = tuple(f"**/*{s}" for s in MEDIA_TYPES)
    exclude: Sequence[str] = ()
    hidden: str = "skip"  #: or include
    symlinks: str = "follow"  #: or skip
    encoding: str = "utf-8"
    errors: str = "strict"  #: or replace, ignore
    unknown: str | None = None  #: media type of files with another suffix, which are refused without it


MARKDOWN_RULES = FileRules(include=("**/*.md",), hidden="include", unknown="text/markdown")


def list_files(source: str | Path, rules: FileRules = FileRules()) -> list[tuple[str, str]]:
    """(path, uri) of the files below a folder, or of one file, in order of their paths."""
    path = Path(source)
    if not path.exists():
        raise LoadError(f"no such source: {path}")
    root = path.resolve() if path.is_dir() else path.resolve().parent
    out: list[tuple[str, str]] = []
    if path.is_dir():
        excluded = {f for g in rules.exclude for f in path.glob(g)}
        walked = [m[1] for g in rules.include if (m := _SUFFIX.fullmatch(g))]
        taken = {f for g in rules.include if not _SUFFIX.fullmatch(g) for f in path.glob(g) if f.is_file()}
        if walked:
            _walk(path, root, tuple(walked), rules.hidden == "skip", excluded, taken, out)
        taken -= excluded
    else:
        taken = {path}
    for f in taken:
        real = f.resolve()
        parts = real.relative_to(root).parts if real.is_relative_to(root) else f.parts
        if rules.hidden == "skip" and any(p.startswith(".") for p in parts):
            continue
        if rules.symlinks == "skip" and any(p.is_symlink() for p in (f, *f.parents) if p != path and p.is_relative_to(path)):
            continue
        out.append((str(real), "file:" + (real.relative_to(root).as_posix() if real.is_relative_to(root) else real.as_posix())))
    return sorted(out)


def _walk(path: Path, root: Path, suffixes: tuple[str, ...], hide: bool, excluded: set[Path], taken: set[Path], out: list[tuple[str, str]]) -> None:
    """Puts the plain files below a folder whose names end with one of `suffixes` into `out`, as list_files returns them, and links to files, which must be
    resolved, into `taken`. A folder's path is resolved for all its files at once, as links to folders are not followed, and what is in `taken` already is left out."""
    folders = [(str(path), str(root), "")]
    while folders:
        here, real, below = folders.pop()
        try:
            entries = os.scandir(here)
        except OSError:  # one that cannot be read has no files, as for a glob
            continue
        with entries:
            for x in entries:
                if x.is_dir(follow_symlinks=False):
                    if not (hide and x.name.startswith(".")):
                        folders.append((x.path, os.path.join(real, x.name), f"{below}{x.name}/"))
                elif x.name.endswith(suffixes) and x.is_file():
                    if x.is_symlink():
                        taken.add(Path(x.path))
                    elif not (hide and x.name.startswith(".")) and not ((excluded or taken) and ((p := Path(x.path)) in excluded or p in taken)):
                        out.append((os.path.join(real, x.name), f"file:{below}{x.name}"))


def read_files(spark: SparkSession, source: str | Path, rules: FileRules = FileRules()) -> DataFrame:
    """The sources (see SOURCES) below a folder."""
    found = list_files(source, rules)
    if rules.unknown is None and (bad := [p for p, _ in found if Path(p).suffix.lower() not in MEDIA_TYPES]):
        raise LoadError(f"unsupported suffix: {bad[0]}")
    if not found:
        return spark.createDataFrame([], SOURCES)
    encoding, errors = rules.encoding, rules.errors

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size, since = [], 0, 0
            for i, path in enumerate(b.column("source_path").to_pylist()):
                text = error = None
                try:
                    text = Path(path).read_bytes().decode(encoding, errors).replace("\r\n", "\n").replace("\r", "\n")
                except (OSError, UnicodeError, LookupError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((text, error))
                size += len(text or "")
                if size >= OUT_BYTES or i + 1 == b.num_rows:  # texts are handed on before more are read
                    own = b.slice(since, len(rows))
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, pa.string()) for x in zip(*rows, strict=True))], [*own.schema.names, "raw_text", "load_error"])
                    rows, size, since = [], 0, i + 1

    names = pa.table([pa.array((v.encode(errors="replace").decode() for v in x), pa.string()) for x in zip(*found, strict=True)], ["source_path", "source_uri"])
    known = spark.createDataFrame(names).repartition(min(TASKS, -(-len(found) // FILES_IN_A_TASK)))
    files = known.mapInArrow(read, "source_path string, source_uri string, raw_text string, load_error string")
    suffix = F.lower(F.regexp_extract("source_path", r"(\.[^./]*)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return files.select("source_path", "source_uri", "raw_text", ids.checksum(F.col("raw_text")).alias("checksum"), F.coalesce(kinds[suffix], F.lit(rules.unknown)).alias("media_type"), F.lit("{}").alias("source_metadata"), "load_error")


def write_files(docs: DataFrame, folder: str) -> DataFrame:
    """Writes each row (path below the folder, text) as a file in UTF-8; returns how many each task wrote. A task that is repeated writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = os.path.join(folder, path)
                if (parent := os.path.dirname(to)) not in made:
                    os.makedirs(parent, exist_ok=True)
                    made.add(parent)
                with open(to, "wb") as f:
                    f.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return small_batches(docs).toDF("path", "text").mapInArrow(write, "files bigint")


def table_sources(docs: DataFrame, uri, text, media_type: str = "text/plain", metadata=None) -> DataFrame:  # noqa: ANN001
    """Rows of any table as sources."""
    u, t = (F.expr(x) if isinstance(x, str) else x for x in (uri, text))
    meta = F.lit("{}") if metadata is None else metadata
    return docs.select(u.alias("source_path"), u.alias("source_uri"), t.alias("raw_text"), ids.checksum(t).alias("checksum"), F.lit(media_type).alias("media_type"), meta.alias("source_metadata"))
