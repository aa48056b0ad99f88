"""A versioned store of Parquet tables in buckets of sources.

A version is one small file that names, for each table and bucket, the folder with its rows; it is created only if
there is none of that number yet, so of two writers one fails and readers see a version as a whole. Rows are
in the bucket of their source_uri: a write reads and replaces the buckets of the sources it touches and
leaves all others alone, and one that changes nothing writes nothing. `expire` removes what old versions
alone refer to."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.functions import ids
from loomtext.operators.diff import revisions_to_prune
from loomtext.operators.scope import in_scope, stale, upsert_classes

TABLES = ("documents", "sections", "chunks", "revisions")
RUNS = "run_id string, prefixes array<string>, timestamp string"
SEEN = "run_id string, source_uri string"
BUCKETS = 64
LAYOUT = 2  #: 1 had one folder for a table
FEW = 500_000  #: so many URIs are broadcast
FOLDERS = 8  #: a bucket of more is written anew
_KEYS = {"documents": "document_id", "sections": "section_id", "chunks": "chunk_id"}


class StoreError(Exception):
    """The store cannot do that."""


@dataclass(frozen=True)
class Snapshot:
    """What a run produced."""

    documents: DataFrame
    sections: DataFrame
    chunks: DataFrame


@dataclass(frozen=True)
class SyncResult:
    """(source_uri, action), and how many rows went with deleted sources."""

    actions: DataFrame
    deleted: dict[str, int]
    dry_run: bool

    def counts(self) -> dict[str, int]:
        return {r["action"]: r["count"] for r in self.actions.groupBy("action").count().collect()}


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.where, self.buckets = spark, path.rstrip("/"), buckets

    # --- versions --------------------------------------------------------------------------

    @cached_property
    def _fs(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.where if "://" in self.where else f"file://{self.where}")

    def _read(self, path: str) -> dict | None:
        system, root = self._fs
        try:
            with system.open_input_stream(f"{root}/{path}") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def versions(self) -> list[int]:
        system, root = self._fs
        found = system.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def _version(self) -> dict:
        known = self.versions()
        if not known:
            if self._read("CURRENT.json") is not None:
                raise StoreError(f"the store has layout 1 instead of {LAYOUT}: migrate it")
            return {"version": 0, "layout": LAYOUT, "buckets": self.buckets, "tables": {}, "schemas": {}}
        now = self._read(f"versions/{known[-1]:010}.json")
        if now["layout"] != LAYOUT:
            raise StoreError(f"the store has layout {now['layout']} instead of {LAYOUT}: migrate it")
        return now

    def _commit(self, before: dict, changes: dict) -> None:
        """Writes the next version; fails if there is one already."""
        now = before | changes | {"version": before["version"] + 1}
        system, root = self._fs
        system.create_dir(f"{root}/versions", recursive=True)
        name, made = f"{root}/versions/{now['version']:010}.json", f"{root}/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(made) as f:
            f.write(json.dumps(now).encode())
        if isinstance(system, fs.LocalFileSystem):
            try:
                os.link(made, name)  # a link is never put over a file
                ok = True
            except FileExistsError:
                ok = False
            system.delete_file(made)
        else:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            src, dst = (jvm.org.apache.hadoop.fs.Path(f"{self.where}/{x.removeprefix(root + '/')}") for x in (made, name))
            ok = src.getFileSystem(conf).rename(src, dst)
        if not ok:
            raise StoreError("another writer was first")

    def migrate(self) -> int:
        """Brings a store of layout 1 into buckets; one of this layout stays as it is. Returns the layout."""
        old = self._read("CURRENT.json")
        if self.versions() or old is None:
            return self._version()["layout"]
        before = {"version": 0, "layout": LAYOUT, "buckets": self.buckets, "tables": {}, "schemas": {}}
        tables, schemas = {}, {}
        for name, path in old["tables"].items():
            df = self.spark.read.parquet(f"{self.where}/{path}")
            if name == "runs":
                df = df.select("run_id", "prefixes", "timestamp")
                tables[name], schemas[name] = {"0": [self._append(name, df)]}, df.schema.jsonValue()
            else:
                tables[name], schemas[name] = self._write(name, df, before["buckets"]), df.schema.jsonValue()
        self._commit(before, {"tables": tables, "schemas": schemas})
        return LAYOUT

    def expire(self, keep: int = 5) -> int:
        """Removes versions but the last `keep`, and folders that none of these names; returns how many folders."""
        system, root = self._fs
        known = self.versions()
        stay, n = known[-max(1, keep) :], 0
        live = {p.split("/bucket=")[0] for v in stay for t in self._read(f"versions/{v:010}.json")["tables"].values() for ps in t.values() for p in ps}
        for v in known[: -max(1, keep)]:
            system.delete_file(f"{root}/versions/{v:010}.json")
        for name in (*TABLES, "runs", "seen", "staged"):
            for x in system.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True)):
                if f"{name}/{x.base_name}" not in live:
                    system.delete_dir(x.path)
                    n += 1
        return n

    # --- buckets ---------------------------------------------------------------------------

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("source_uri"), F.lit(n)).cast("int")

    def _write(self, name: str, df: DataFrame, n: int) -> dict[str, list[str]]:
        """Writes rows by buckets; returns the folders of those that have any."""
        system, root = self._fs
        path = f"{name}/{uuid.uuid4().hex}"
        # each task writes its part of each bucket: texts are not shuffled for it
        df.withColumn("bucket", self._bucket(n)).write.partitionBy("bucket").parquet(f"{self.where}/{path}", compression="zstd")
        found = system.get_file_info(fs.FileSelector(f"{root}/{path}"))
        return {x.base_name.removeprefix("bucket="): [f"{path}/{x.base_name}"] for x in found if x.base_name.startswith("bucket=")}

    def _append(self, name: str, df: DataFrame) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.where}/{path}")
        return path

    def _load(self, now: dict, name: str, buckets: list[str] | None = None) -> DataFrame | None:
        if name not in now["schemas"]:
            return None
        schema = StructType.fromJson(now["schemas"][name])
        paths = [p for b, ps in now["tables"][name].items() if buckets is None or b in buckets for p in ps]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.where}/{p}" for p in paths])

    def table(self, name: str) -> DataFrame | None:
        return self._load(self._version(), name)

    def _need(self, name: str) -> DataFrame:
        if (found := self.table(name)) is None:
            raise StoreError(f"no {name} yet")
        return found

    def of_source(self, name: str, uri: str) -> DataFrame:
        """The rows of one source, from its bucket alone."""
        now = self._version()
        if name not in now["schemas"]:
            raise StoreError(f"no {name} yet")
        bucket = self.spark.range(1).select(F.lit(uri).alias("source_uri")).select(self._bucket(now["buckets"])).first()[0]
        return self._load(now, name, [str(bucket)]).filter(F.col("source_uri") == uri)

    def _among(self, df: DataFrame, uris: DataFrame, how: str, n: int | None = None) -> DataFrame:
        """The rows of `df` whose source is (left_semi) or is not (left_anti) one of `uris`. As long as these are few, they are sent to the rows, and not texts through a shuffle.
        n: how many there are, where that is known."""
        uris = uris.select("source_uri")
        few = (uris.count() if n is None else n) <= FEW
        return df.join(F.broadcast(uris) if few else uris, "source_uri", how)

    def _replaced(self, now: dict, touched: DataFrame, fresh: dict[str, dict[str, list[str]]], schemas: dict[str, dict], kept: dict[str, DataFrame] | None = None) -> dict:
        """The changes of a version in which the rows of `touched` (source_uri) go. Only buckets that hold such rows are read and written, as many at a time as have few of them.
        fresh: the folders of rows that come, by table and bucket, and `schemas` of the tables with them; kept: rows of touched sources that stay, for tables where not all go."""
        n, tables = now["buckets"], dict(now["tables"])
        count = {str(r["b"]): r["count"] for r in touched.groupBy(self._bucket(n).alias("b")).count().collect()}  # at most n rows
        for name in TABLES:
            if name not in now["schemas"] and name not in fresh:
                continue
            table, more = dict(now["tables"].get(name, {})), fresh.get(name, {})
            old = [b for b, p in table.items() if b in count or (b in more and len(p) >= FOLDERS)]
            groups: list[list[str]] = []
            for b in sorted(old, key=int):
                if not groups or sum(count.get(x, 0) for x in [*groups[-1], b]) > FEW:
                    groups.append([])
                groups[-1].append(b)
            for group in groups:
                own = touched.filter(self._bucket(n).isin([int(b) for b in group]))
                rows = self._among(self._load(now, name, group), own, "left_anti", sum(count.get(b, 0) for b in group))
                if (extra := (kept or {}).get(name)) is not None:
                    rows = rows.unionByName(extra.filter(self._bucket(n).isin([int(b) for b in group])))
                made = self._write(name, rows, n)
                table = {b: p for b, p in table.items() if b not in group} | made
            tables[name] = table | {b: [*table.get(b, []), *p] for b, p in more.items()}
        return {"tables": tables, "schemas": now["schemas"] | schemas}

    def _fresh(self, now: dict, name: str, rows: DataFrame) -> tuple[dict[str, list[str]], dict]:
        """Writes rows that come, in the types that the table has; returns their folders by bucket, and the table's schema."""
        if name in now["schemas"]:
            old = StructType.fromJson(now["schemas"][name])
            known = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old]
            rows = rows.select(*known, *[c for c in rows.columns if c not in old.names])
        return self._write(name, rows, now["buckets"]), rows.schema.jsonValue()

    # --- writing ---------------------------------------------------------------------------

    def unchanged(self) -> DataFrame | None:
        """(source_uri, checksum) of what is stored under the identity version of today: what need not be parsed again."""
        docs = self.table("documents")
        return None if docs is None else docs.filter(F.col("identity_version") == ids.IDENTITY_VERSION).select("source_uri", F.col("source_checksum").alias("checksum"))

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written once and read again; `expire` removes it."""
        path = f"{self.where}/staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression="zstd")
        return self.spark.read.schema(df.schema).parquet(path)

    def upsert(self, new: Snapshot, run_id: str, timestamp: str, prefixes: tuple[str, ...] = (), prune: bool = False, seen: DataFrame | None = None) -> DataFrame:
        """Writes documents that are new or changed, and with `prune` removes stale ones of the scope.
        seen: (source_uri) of all sources of the run, where `new` lacks those that are unchanged. A source that comes twice counts once, with its greatest checksum. Returns
        (source_uri, action), as it was decided before the write."""
        now = self._version()
        found = self.staged(new.documents.select("source_uri", "source_checksum", "identity_version"), "found")
        twice = not found.groupBy("source_uri").count().filter("count > 1").isEmpty()
        docs, sections, chunks = new.documents, new.sections, new.chunks
        if twice:
            last = Window.partitionBy("source_uri").orderBy(F.desc("source_checksum"))
            docs = self.staged(docs.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n"), "documents")
            sections, chunks = (df.dropDuplicates([_KEYS[name]]) for name, df in (("sections", sections), ("chunks", chunks)))
            found = docs.select(found.columns)
        stored = self._load(now, "documents")
        actions = upsert_classes(found.limit(0) if stored is None else stored, found)
        seen = found.select("source_uri") if seen is None else seen.select("source_uri").distinct()
        if stored is not None:
            rest = seen.join(found.select("source_uri"), "source_uri", "left_anti").join(stored.select("source_uri"), "source_uri", "left_semi")
            actions = actions.union(rest.select("source_uri", F.lit("skipped")))
            if prune:
                actions = actions.union(stale(stored.select("source_uri"), seen, prefixes).select("source_uri", F.lit("deleted")))
        actions = self.staged(actions, "actions")
        count = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        write = actions.filter(F.col("action").isin("inserted", "updated")).select("source_uri")
        run = {"runs": self.spark.createDataFrame([(run_id, list(prefixes), timestamp)], RUNS), "seen": seen.select(F.lit(run_id).alias("run_id"), "source_uri")}
        if set(count) <= {"skipped"}:
            changes = {"tables": dict(now["tables"]), "schemas": dict(now["schemas"])}
        else:
            written = count.get("inserted", 0) + count.get("updated", 0)
            rows = {name: df.filter("source_uri IS NOT NULL") for name, df in (("documents", docs), ("sections", sections), ("chunks", chunks))}
            if found.count() > written:  # some of them are stored as they are
                rows = {name: self._among(df, write, "left_semi", written) for name, df in rows.items()}
            fresh, schemas = {}, {}
            for name, df in rows.items():
                fresh[name], schemas[name] = self._fresh(now, name, df)
            old = self._load(now, "revisions")
            came = Snapshot(*[self._load({"tables": fresh, "schemas": schemas}, name) for name in rows])
            fresh["revisions"], schemas["revisions"] = self._fresh(now, "revisions", revision_rows(came, old, run_id, timestamp))
            kept = {} if old is None else {"revisions": self._among(old, write, "left_semi", written).withColumn("is_current", F.lit(False)).select(old.columns)}
            gone = actions.filter("action <> 'skipped'").select("source_uri")
            gone = gone.limit(0) if stored is None else self.staged(gone.join(stored.select("source_uri"), "source_uri", "left_semi"), "gone")
            changes = self._replaced(now, gone, fresh, schemas, kept)
        for name, df in run.items():
            changes["tables"][name] = {"0": [*now["tables"].get(name, {}).get("0", []), self._append(name, df)]}
            changes["schemas"][name] = df.schema.jsonValue()
        self._commit(now, changes)
        return actions

    def sync(self, new: Snapshot, run_id: str, timestamp: str, prefixes: tuple[str, ...], policy: str = "hard_delete", dry_run: bool = False) -> SyncResult:
        """Makes the stored sources of a scope those of `new`. policy: hard_delete, or ignore stale ones; dry_run: only tells what it would do."""
        if policy not in ("hard_delete", "ignore"):
            raise ValueError(f"no such policy: {policy}")
        stored = self.table("documents")
        gone = None if stored is None or policy == "ignore" else stale(stored.select("source_uri"), new.documents, prefixes)
        deleted = {} if gone is None else self.counts_of(gone)
        if dry_run:
            actions = upsert_classes(new.documents.limit(0) if stored is None else stored, new.documents)
            actions = actions if gone is None else actions.union(gone.select("source_uri", F.lit("deleted")))
        else:
            actions = self.upsert(new, run_id, timestamp, prefixes, prune=policy == "hard_delete")
        return SyncResult(actions, deleted, dry_run)

    def counts_of(self, uris: DataFrame) -> dict[str, int]:
        """How many rows of each table belong to `uris` (source_uri)."""
        uris = uris.select("source_uri").distinct()
        return {name: self._need(name).join(uris, "source_uri", "left_semi").count() for name in TABLES}

    def delete(self, which: Column | DataFrame, dry_run: bool = False) -> dict[str, int]:
        """Removes the documents of a table of source_uri, or those for which a condition on it holds, with all that belongs to them;
        returns how many rows of each table."""
        now = self._version()
        docs = self._need("documents").select("source_uri")
        uris = docs.filter(which) if isinstance(which, Column) else docs.join(which.select("source_uri"), "source_uri", "left_semi")
        counts = self.counts_of(uris)
        if not dry_run and any(counts.values()):
            self._commit(now, self._replaced(now, self.staged(uris, "deleted"), {}, {}))
        return counts

    def delete_prefix(self, prefix: str, dry_run: bool = False) -> dict[str, int]:
        return self.delete(F.startswith("source_uri", F.lit(prefix)), dry_run)

    def prune_revisions(self, max_depth: int = 10) -> int:
        now, revisions = self._version(), self._need("revisions")
        gone = revisions_to_prune(revisions, max_depth)
        n = gone.count()
        if n:
            hit = self.staged(gone.select("source_uri", "document_id", "revision_number"), "pruned")
            touched = hit.select("source_uri").distinct()
            buckets = sorted(str(r[0]) for r in touched.select(self._bucket(now["buckets"])).distinct().collect())
            rows = self._load(now, "revisions", buckets).join(hit.select("document_id", "revision_number"), ["document_id", "revision_number"], "left_anti").select(revisions.columns)
            made = self._write("revisions", rows, now["buckets"])
            table = {b: p for b, p in now["tables"]["revisions"].items() if b not in buckets} | made
            self._commit(now, {"tables": now["tables"] | {"revisions": table}})
        return n

    # --- reading ---------------------------------------------------------------------------

    def page(self, name: str, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
        df = self._need(name)
        keys = ["source_uri", "order_index"] if "order_index" in df.columns else ["source_uri"]
        return df.orderBy(*keys).offset(offset).limit(limit), df.count()

    def documents_by_uris(self, uris: DataFrame | list[str]) -> DataFrame:
        if not isinstance(uris, DataFrame):
            uris = self.spark.createDataFrame([(u,) for u in uris], "source_uri string")
        return self._need("documents").join(uris.select("source_uri").distinct(), "source_uri", "left_semi")

    def document_by_id(self, document_id: str) -> DataFrame:
        return self._need("documents").filter(F.col("document_id") == document_id)

    def with_children(self, documents: DataFrame) -> DataFrame:
        """`documents` with arrays of their sections and chunks, in order."""
        out = documents
        for name in ("sections", "chunks"):
            df = self._need(name).join(documents.select("document_id"), "document_id", "left_semi")
            first = ["order_index"]
            rows = df.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*first, *[c for c in df.columns if c not in first]))).alias(name))
            out = out.join(rows, "document_id", "left")
        return out

    def chunks_by_section(self, section_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
        return self._need("chunks").filter(F.col("section_id") == section_id).orderBy("order_index").offset(offset).limit(limit)

    def uris_in_scope(self, prefixes: tuple[str, ...]) -> DataFrame:
        return self._need("documents").select("source_uri").filter(in_scope(F.col("source_uri"), prefixes))

    def find(self, key: str) -> tuple[str, DataFrame] | None:
        """A document by URI or id, a section or a chunk by id: the first that there is."""
        if not (hit := self.of_source("documents", key)).isEmpty():
            return "documents", hit
        for name, c in _KEYS.items():
            if not (hit := self._need(name).filter(F.col(c) == key)).isEmpty():
                return name, hit
        return None

    def revisions(self, uri: str, limit: int | None = None) -> DataFrame:
        df = self.of_source("revisions", uri).orderBy(F.desc("revision_number"))
        return df if limit is None else df.limit(limit)

    def latest_run(self) -> DataFrame:
        """The last run, with source_uris_seen."""
        last = self._need("runs").orderBy(F.desc("timestamp")).limit(1)
        seen = self._need("seen").groupBy("run_id").agg(F.sort_array(F.collect_set("source_uri")).alias("source_uris_seen"))
        return last.join(seen, "run_id", "left").withColumn("source_uris_seen", F.coalesce("source_uris_seen", F.array().cast("array<string>")))

    def stats(self) -> dict[str, int]:
        return {n: 0 if (df := self.table(n)) is None else df.count() for n in ("documents", "sections", "chunks")}


def revision_rows(new: Snapshot, old: DataFrame | None, run_id: str, timestamp: str) -> DataFrame:
    """The next revision of each document, with its anchors and hashes in order."""

    def arrays(df: DataFrame, of: str) -> DataFrame:
        rows = df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "anchor", "content_hash"))).alias("x"))
        return rows.select("document_id", F.transform("x", lambda r: r["anchor"]).alias(f"{of}_anchors"), F.transform("x", lambda r: r["content_hash"]).alias(f"{of}_hashes"))

    rows = new.documents.select("document_id", "source_uri", "source_checksum").join(arrays(new.sections, "section"), "document_id", "left").join(arrays(new.chunks, "chunk"), "document_id", "left")
    if old is None:
        number = F.lit(1)
    else:
        rows = rows.join(old.groupBy("document_id").agg(F.max("revision_number").alias("__n")), "document_id", "left")
        number = F.coalesce("__n", F.lit(0)) + 1
    return rows.withColumn("revision_number", number).select("document_id", "source_uri", "source_checksum", "revision_number", F.lit(run_id).alias("ingestion_run_id"), "section_anchors", "section_hashes", "chunk_anchors", "chunk_hashes", F.lit(True).alias("is_current"), F.lit(timestamp).alias("timestamp"))


def with_previous(revisions: DataFrame, of: str = "source_checksum") -> DataFrame:
    """`revisions` with the value of a column in the revision before."""
    w = Window.partitionBy("document_id").orderBy("revision_number")
    return revisions.withColumn(f"previous_{of.removeprefix('source_')}", F.lag(of).over(w))
