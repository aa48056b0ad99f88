"""Commands: ingest, preview, stats, diff, export, inspect, prune, delete, migrate."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import diff, export
from loomtext.operators.scope import scope_of, stale
from loomtext.plans import registry
from loomtext.plans.checkpoint import Checkpoint, fingerprint
from loomtext.plans.config import Config, ConfigError, load
from loomtext.plans.ingest import Event, Result, ingest
from loomtext.sources.files import LoadError, read_files
from loomtext.sources.store import Store, StoreError

CHECKPOINT = ".loomtext-checkpoint"


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def set_up_logging(form: str, level: str) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_JsonLines() if form == "json" else logging.Formatter("%(levelname)s %(message)s"))
    log = logging.getLogger("loomtext")
    log.handlers[:], log.propagate = [handler], False
    log.setLevel(level.upper())


def _show(rows: DataFrame) -> None:
    for r in rows.toJSON().toLocalIterator():
        print(r)


def _words(counts: dict[str, int]) -> str:
    return "\n".join(f"{k}: {v}" for k, v in counts.items())


def _print(counts: dict[str, int], as_json: bool) -> None:
    print(json.dumps(counts) if as_json else _words(counts))


def print_diff(sums: DataFrame, as_json: bool) -> None:
    sums = diff.changed(sums).orderBy("source_uri")
    if as_json:
        return _show(sums)
    n = {True: 0, False: 0}
    for r in sums.toLocalIterator():
        print(r["source_uri"])
        for of in ("sections", "chunks"):
            print(f"  {of}: " + ", ".join(f"{r[f'{of}_{s}']} {s}" for s in diff.STATUSES))
        n[r["changed"]] += 1
    print(f"{n[True]} documents changed, {n[False]} unchanged" if any(n.values()) else "no documents")


def print_outline(sections: DataFrame, as_json: bool) -> None:
    rows = sections.select("source_uri", "order_index", "heading_level", "heading", "anchor").orderBy("source_uri", "order_index")
    if as_json:
        return _show(rows)
    last = None
    for r in rows.toLocalIterator():
        if r["source_uri"] != last:
            print(last := r["source_uri"])
        print("  " * max(1, r["heading_level"]) + (r["heading"] if r["heading"] is not None else "(root)"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext")
    sub = p.add_subparsers(dest="verb", required=True)
    made = {}
    for verb in ("ingest", "preview", "diff", "export", "prune", "stats", "migrate", "inspect", "delete"):
        s = made[verb] = sub.add_parser(verb)
        if verb in ("ingest", "preview", "diff", "export", "prune"):
            s.add_argument("source", nargs="?")
        if verb in ("inspect", "delete"):
            s.add_argument("key")
        if verb != "preview":
            s.add_argument("--store")
        s.add_argument("--config")
        if verb != "migrate":
            s.add_argument("--json", action=argparse.BooleanOptionalAction)
        if verb in ("prune", "delete"):
            s.add_argument("--dry-run", action="store_true")
    s = made["export"]
    s.add_argument("-o", "--output", required=True)
    s.add_argument("--format", choices=("v1", "legacy"), default="v1")
    s.add_argument("--changed-only", action="store_true")
    s.add_argument("--created-at", default="1970-01-01T00:00:00+00:00")
    s.add_argument("--one-file", action="store_true", help="one ordered file instead of a folder of parts")
    s = made["ingest"]
    s.add_argument("--log-format", choices=("human", "json"), default="human")
    s.add_argument("--log-level", choices=("debug", "info", "warning", "error"), default="warning")
    s.add_argument("--error-mode", choices=("continue_on_error", "fail_fast"), default="continue_on_error")
    s.add_argument("--resume", action="store_true")
    s.add_argument("--checkpoint-path")
    s.add_argument("--workers", type=int, default=0, help="partitions that are parsed at once; 0: as many as Spark makes")
    s.add_argument("--progress", action="store_true")
    return p


def _sources(spark: SparkSession, config: Config, source: str) -> DataFrame:
    return read_files(spark, source) if config.loader is None else registry.build("loaders", config.loader)(spark, source)


def _status(got: Result) -> int:
    """1 if all sources failed, 3 if some did; one that the store holds unchanged did not."""
    bad = got.errors.count()
    if not bad:
        return 0
    for r in got.errors.limit(20).collect():
        print(f"{r['source_uri']}: {r['error']}", file=sys.stderr)
    print(f"{bad} sources failed", file=sys.stderr)
    held = got.actions is not None and not got.actions.filter("action = 'skipped'").isEmpty()
    return 3 if held or not got.snapshot.documents.isEmpty() else 1


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: failed; 3: some sources failed."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        return _run(a, spark)
    except (LoadError, StoreError, ConfigError, LookupError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    config = load(a.config)
    as_json = config.json or False if getattr(a, "json", None) is None else a.json
    where = getattr(a, "store", None) or (config.store.values["path"] if config.store else None)
    store = Store(spark, where) if where else None
    needs_store = a.verb in ("stats", "migrate", "inspect", "delete", "prune", "diff") or (a.verb == "export" and a.changed_only)
    if needs_store and store is None:
        raise ConfigError(f"{a.verb} needs a store: --store, or store.path in the settings")
    if a.verb == "stats":
        _print(store.stats(), as_json)
        return 0
    if a.verb == "migrate":
        print(store.migrate())
        return 0
    if a.verb == "inspect":
        if not (found := store.find(a.key)):
            print(f"nothing has the name or id {a.key}", file=sys.stderr)
            return 1
        _show(store.with_children(found[1]) if found[0] == "documents" else found[1])
        return 0
    if a.verb == "delete":
        _print(store.delete_prefix(a.key, a.dry_run) if a.key.endswith("/") else store.delete(F.col("source_uri") == a.key, a.dry_run), as_json)
        return 0
    source = a.source or config.resolved_source()
    if source is None:
        raise ConfigError("no source: give one, or name it in the settings")
    if a.verb == "prune":
        stored = store.table("documents")
        if stored is None:
            _print({}, as_json)
        else:
            _print(store.delete(stale(stored.select("source_uri"), _sources(spark, config, source), scope_of(source)), a.dry_run), as_json)
        return 0
    sources = _sources(spark, config, source)
    chunker = registry.chunker_of(config)
    options: dict = {"parser": registry.build("parsers", config.parser)} if config.parser else {}
    if a.verb == "ingest":
        set_up_logging(a.log_format, a.log_level)
        if a.workers > 0:
            sources = sources.repartition(a.workers)
        if a.resume or a.checkpoint_path:
            settings = fingerprint(config.loader, config.parser, chunker)
            options["checkpoint"] = Checkpoint(spark, str(Path(a.checkpoint_path or CHECKPOINT).resolve()), settings)
            if not a.resume:
                options["checkpoint"].clear()
        if a.progress:
            options["progress"] = _tell
        got = ingest(sources, chunker, store, scope_of(source), fail_fast=a.error_mode == "fail_fast", **options)
        _print(got.counts(), as_json)
        return _status(got)
    got = ingest(sources, chunker, **options)
    if a.verb == "preview":
        print_outline(got.snapshot.sections, as_json)
    elif a.verb == "diff":
        pairs = [(got.snapshot.sections.limit(0) if old is None else old.join(got.snapshot.documents.select("source_uri"), "source_uri", "left_semi"), new) for old, new in ((store.table("sections"), got.snapshot.sections), (store.table("chunks"), got.snapshot.chunks))]
        print_diff(diff.summary(*[diff.deltas(*p) for p in pairs]), as_json)
    elif a.verb == "export":
        style = config.export.values if config.export else {"text_prepend": "title_and_heading_path", "include_annotations": False}
        how = {"strategy": style["text_prepend"], "annotations": style["include_annotations"]}
        chunks = got.snapshot.chunks
        if a.changed_only:
            old = store.table("chunks")
            lines = export.delta_lines(diff.export_delta(diff.deltas(chunks.limit(0) if old is None else old, chunks), export.records(chunks, a.created_at, **how)))
        else:
            rows = export.records(chunks, a.created_at, **how) if a.format == "v1" else export.legacy_records(chunks, **how)
            lines = export.json_lines(rows.join(chunks.select(F.col("chunk_id").alias("id"), "order_index", F.col("source_uri").alias("__uri")), "id").orderBy("__uri", "order_index").drop("order_index", "__uri") if a.one_file else rows)
        if a.one_file:
            with open(a.output, "w", encoding="utf-8") as f:  # a line at a time, in order
                f.writelines(r[0] + "\n" for r in lines.toLocalIterator())
        else:
            lines.write.text(a.output)
    return _status(got)


def _tell(e: Event) -> None:
    print(f"{e.stage} {e.event}" + ("" if e.total is None else f" {e.total}") + ("" if e.elapsed_ms is None else f" {e.elapsed_ms:.0f} ms"), file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
