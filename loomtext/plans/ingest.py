"""The whole way from sources to a snapshot, and to a store."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import chunks as C
from loomtext.operators import parse as P
from loomtext.plans.checkpoint import Checkpoint
from loomtext.sources.files import LoadError
from loomtext.sources.store import Snapshot, Store

log = logging.getLogger("loomtext")


@dataclass(frozen=True)
class Event:
    """What a run tells while it goes on. stage: load, parse, chunk, persist or run; event: started, completed, failed or skipped."""

    stage: str
    event: str
    total: int | None = None
    elapsed_ms: float | None = None
    error: str | None = None


@dataclass(frozen=True)
class Stage:
    """Rows that a stage took and gave, and its time."""

    stage: str
    taken: int | None
    given: int | None
    failed: int
    elapsed_ms: float


@dataclass(frozen=True)
class Result:
    snapshot: Snapshot
    errors: DataFrame
    run_id: str
    actions: DataFrame | None = None  #: of the store
    stages: tuple[Stage, ...] = field(default_factory=tuple)

    def counts(self) -> dict[str, int]:
        """processed, failed, and with a store inserted, updated, skipped, deleted."""
        out = {"processed": self.snapshot.documents.count(), "failed": self.errors.count()}
        if self.actions is not None:
            out |= {r["action"]: r["count"] for r in self.actions.groupBy("action").count().collect()}
        return out


def ingest(
    sources: DataFrame, chunker: object = C.SizeChunker(), store: Store | None = None, prefixes: tuple[str, ...] = (), prune: bool = False, fail_fast: bool = False,
    done: DataFrame | None = None, checkpoint: Checkpoint | None = None, progress: Callable[[Event], None] | None = None, parser: Callable[[DataFrame], DataFrame] = P.parse,
) -> Result:
    """`done`: (source_uri, checksum) of what an earlier run finished, and `checkpoint`: a file of it; that is left out before parsing, and so is with a
    store what it holds unchanged. `progress` is told of each stage; an exception of it ends the run. With a store everything is parsed once."""
    run, stages, began = str(uuid.uuid4()), [], time.perf_counter()

    def tell(stage: str, event: str, **values: object) -> None:
        log.info("%s %s %s", stage, event, values or "")
        if progress is not None:
            progress(Event(stage, event, **values))

    def timed(stage: str, since: float, taken: int | None = None, given: int | None = None, failed: int = 0) -> None:
        ms = 1000 * (time.perf_counter() - since)
        stages.append(Stage(stage, taken, given, failed, ms))
        tell(stage, "completed", total=given, elapsed_ms=ms)

    tell("run", "started")
    seen = sources.select("source_uri")
    for finished in (done, checkpoint.done() if checkpoint is not None else None, store.unchanged() if store is not None else None):
        if finished is not None:
            sources = sources.join(finished.select("source_uri", "checksum").distinct(), ["source_uri", "checksum"], "left_anti")
    tell("parse", "started")
    since = time.perf_counter()
    parsed = parser(sources)
    if store is not None:
        parsed = store.staged(parsed, "parsed")
    errors = P.errors(parsed)
    if fail_fast and (first := errors.first()):
        tell("parse", "failed", error=first["error"])
        raise (LoadError if first["error"].split(":")[0] in ("UnicodeDecodeError", "LookupError", "OSError", "FileNotFoundError", "PermissionError") else ValueError)(f"{first['source_uri']}: {first['error']}")
    docs = P.documents(parsed)
    counts = parsed.agg(F.count("*"), F.count("error")).first() if store is not None else (None, 0)
    timed("parse", since, counts[0], None if counts[0] is None else counts[0] - counts[1], counts[1])
    tell("chunk", "started")
    since = time.perf_counter()
    found = C.chunks(docs.select("document_id", "source_uri", "body", "title", "source_metadata", "frontmatter", "source_type"), chunker, ("title", "source_metadata", "frontmatter", "source_type"))
    snap = Snapshot(docs, C.sections(docs), found)
    timed("chunk", since)
    actions = None
    if store is not None:
        tell("persist", "started")
        since = time.perf_counter()
        try:
            actions = store.upsert(snap, run, datetime.now(UTC).isoformat(), prefixes, prune, seen)
        except Exception as e:
            tell("persist", "failed", error=str(e))
            raise
        timed("persist", since, given=actions.count())
    if checkpoint is not None:  # only behind a successful write
        checkpoint.mark(docs.select("source_uri", F.col("source_checksum").alias("checksum")), run)
    tell("run", "completed", elapsed_ms=1000 * (time.perf_counter() - began))
    return Result(snap, errors, run, actions, tuple(stages))
