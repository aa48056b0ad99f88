import hashlib
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import ids
from loomtext.operators import chunks as C
from loomtext.operators import diff, evaluation, export, parse
from loomtext.plans import cli, registry
from loomtext.plans.checkpoint import Checkpoint, fingerprint
from loomtext.plans.config import ConfigError, Part, load
from loomtext.plans.ingest import ingest
from loomtext.sources.files import MARKDOWN_RULES, FileRules, LoadError, list_files, read_files, table_sources
from loomtext.sources.store import Store, StoreError
from loomtext.streaming.changes import ingest_stream, latest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "src"
    (d / ".hid").mkdir(parents=True)
    (d / "a.md").write_text("---\ntitle: A\n---\n# One\n\ntext one\n\n## Two\n\ntext two\n")
    (d / "b.txt").write_text("first line\nmore")
    (d / "c.html").write_text("<h1>H</h1><p>para</p>")
    (d / "empty.md").write_text("")
    (d / ".hid" / "x.md").write_text("# no")
    return d


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_ids(spark):
    ns = uuid.UUID(ids.NAMESPACE_HEX)
    for name in ("file:a.md", "ß漢", ""):
        got = spark.range(1).select(ids.uuid5(F.lit(name)), ids.content_hash(F.lit(name))).first()
        assert got[0] == str(uuid.uuid5(ns, name)) and got[1] == hashlib.sha256(name.encode()).hexdigest()[:16]


def test_files(spark, folder):
    assert [u for _, u in list_files(folder)] == ["file:a.md", "file:b.txt", "file:c.html", "file:empty.md"]
    assert len(list_files(folder, FileRules(hidden="include", exclude=("b.*",)))) == 4
    with pytest.raises(LoadError):
        list_files(folder / "missing")


def test_files_with_awkward_names_and_bytes(spark, tmp_path):
    made = {"_notes.md": "under", ".dot.md": "hidden", "a[1].md": "bracket", "b{x}*.md": "star", "sp ace%20.md": "blank", "_d/c?.md": "folder", "crlf.md": "x\r\ny\rz"}
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    got = {r["source_uri"].removeprefix("file:"): (r["raw_text"], r["load_error"]) for r in read_files(spark, tmp_path, FileRules(hidden="include")).collect()}
    assert {k: v[0] for k, v in got.items() if k != "bad.md"} == made | {"crlf.md": "x\ny\nz"}
    assert got["bad.md"][0] is None and "UnicodeDecodeError" in got["bad.md"][1]
    assert ".dot.md" not in {u.removeprefix("file:") for _, u in list_files(tmp_path)}
    result = ingest(read_files(spark, tmp_path))
    assert [r["source_uri"] for r in result.errors.collect()] == ["file:bad.md"]
    with pytest.raises(LoadError):
        ingest(read_files(spark, tmp_path), fail_fast=True)
    assert read_files(spark, tmp_path, FileRules(errors="replace")).filter("load_error IS NOT NULL").count() == 0
    (tmp_path / "one.log").write_text("# Log")
    with pytest.raises(LoadError):
        read_files(spark, tmp_path / "one.log")
    assert read_files(spark, tmp_path / "one.log", MARKDOWN_RULES).first()["media_type"] == "text/markdown"


def test_ingest_store_and_diff(spark, folder, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"), 4)
    events = []
    first = ingest(read_files(spark, folder), store=store, prefixes=("file:",), prune=True, progress=events.append)
    assert [r["source_uri"] for r in first.errors.collect()] == ["file:empty.md"]
    assert [(e.stage, e.event) for e in events] == [("run", "started"), *[(s, e) for s in ("parse", "chunk", "persist") for e in ("started", "completed")], ("run", "completed")]
    assert first.stages[0].taken == 4 and first.stages[0].failed == 1 and first.counts()["inserted"] == 3
    assert store.stats() == {"documents": 3, "sections": 4, "chunks": 4}
    assert {r["title"] for r in store.table("documents").collect()} == {"A", "first line", "H"}
    before = store._version()
    (folder / "a.md").write_text("---\ntitle: A\n---\n# One\n\ntext 1\n\n## New\n\ntext two\n")
    (folder / "b.txt").unlink()
    now = ingest(read_files(spark, folder))
    found = {(r["anchor"], r["status"]) for r in diff.deltas(store.table("chunks"), now.snapshot.chunks).filter("source_uri = 'file:a.md'").collect()}
    assert found == {("one:chunk_0", "modified"), ("one/two:chunk_0", "removed"), ("one/new:chunk_0", "added")}
    delta = diff.export_delta(diff.deltas(store.table("chunks"), now.snapshot.chunks), export.records(now.snapshot.chunks, "t"))
    assert sorted(r["op"] for r in delta.collect()) == ["added", "deleted", "deleted", "modified"]
    lines = [r[0] for r in export.delta_lines(delta).collect()]
    assert len(lines) == 4 and all(x.startswith('{"_deleted": true') for x in lines[2:]) and '"user_metadata": {' in lines[0]
    dry = store.sync(now.snapshot, "r2", "t", ("file:",), dry_run=True)
    assert store._version() == before and dry.counts() == {"updated": 1, "skipped": 1, "deleted": 1} and dry.deleted["documents"] == 1
    assert store.sync(now.snapshot, "r2", "t", ("file:",), policy="ignore", dry_run=True).counts() == {"updated": 1, "skipped": 1}
    actions = {r["source_uri"]: r["action"] for r in store.upsert(now.snapshot, "r2", "t", ("file:",), prune=True).collect()}
    assert actions == {"file:a.md": "updated", "file:c.html": "skipped", "file:b.txt": "deleted"}
    after = store._version()
    kept = [b for b, p in before["tables"]["documents"].items() if after["tables"]["documents"].get(b) == p]
    assert kept or len(before["tables"]["documents"]) < 3  # buckets that no change touched stay where they are
    assert [(r["revision_number"], r["is_current"]) for r in store.revisions("file:a.md").collect()] == [(2, True), (1, False)]
    run = store.latest_run().first()
    assert run["source_uris_seen"] in (["file:a.md", "file:c.html"], ["file:a.md", "file:b.txt", "file:c.html", "file:empty.md"])
    whole = {r["source_uri"]: r for r in store.with_children(store.documents_by_uris(["file:a.md", "file:none"])).collect()}
    assert list(whole) == ["file:a.md"] and [s["order_index"] for s in whole["file:a.md"]["sections"]] == [0, 1] and len(whole["file:a.md"]["chunks"]) == 2
    assert store.chunks_by_section(whole["file:a.md"]["sections"][1]["section_id"]).count() == 1
    assert store.prune_revisions(1) == 1 and store.revisions("file:a.md").count() == 1 and store.find("file:a.md")[0] == "documents"
    assert store.find(whole["file:a.md"]["document_id"])[0] == "documents" and store.find("none") is None
    assert store.delete(F.col("source_uri") == "file:c.html", dry_run=True)["documents"] == 1 and store.stats()["documents"] == 2
    assert store.expire(1) > 0 and store.stats()["documents"] == 2 and store.versions() == [after["version"] + 1]
    assert cli.main(["stats", "--store", str(tmp_path / "store")], spark) == 0
    assert cli.main(["preview", str(folder)], spark) == 3
    assert cli.main(["preview", str(folder / "no")], spark) == 1
    assert "documents: 2" in capsys.readouterr().out


def test_store_edges(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    sources = read_files(spark, folder)
    ingest(sources, store=store)
    first = store._version()
    again = ingest(sources, store=store)  # nothing has changed: nothing is parsed, and no table is written
    assert again.counts() == {"processed": 0, "failed": 1, "skipped": 3}
    assert {k: v for k, v in store._version()["tables"].items() if k not in ("runs", "seen")} == {k: v for k, v in first["tables"].items() if k not in ("runs", "seen")}
    stale = Store(spark, str(tmp_path / "s"))
    seen = stale._version()
    with pytest.raises(StoreError):
        stale._commit(seen | {"version": seen["version"] - 1}, {})  # another writer was first
    twice = sources.filter("source_uri = 'file:b.txt'")
    twice = twice.union(twice.withColumn("raw_text", F.lit("other")).withColumn("checksum", F.lit("zz")))
    ingest(twice, store=store)
    assert store.table("documents").filter("source_uri = 'file:b.txt'").select("source_checksum").collect()[0][0] == "zz" and store.stats()["documents"] == 3
    with pytest.raises(ValueError):
        store.sync(again.snapshot, "r", "t", (), policy="other")
    old = tmp_path / "old"
    docs = store.table("documents")
    for name in ("documents", "sections", "chunks", "revisions"):
        store.table(name).write.parquet(str(old / name / "x"))
    (old / "CURRENT.json").write_text('{"version": 1, "schema_version": 1, "tables": {"documents": "documents/x", "sections": "sections/x", "chunks": "chunks/x", "revisions": "revisions/x"}}')
    moved = Store(spark, str(old), 4)
    with pytest.raises(StoreError):
        moved.stats()
    assert moved.migrate() == 2 and moved.migrate() == 2 and moved.stats()["documents"] == docs.count()


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (folder / "empty.md").unlink()
    (tmp_path / "loomtext.toml").write_text('source = "src"\n[store]\npath = "' + str(tmp_path / "st") + '"\n[[chunkers]]\ntype = "heading"\n[[chunkers]]\ntype = "size"\nmax_chars = 100\n[export]\ntext_prepend = "none"\ninclude_annotations = true\n')
    for empty in (["diff"], ["prune"], ["stats", "--json"], ["export", "-o", str(tmp_path / "d0"), "--changed-only"]):
        assert cli.main(empty, spark) == 0, empty
    assert cli.main(["ingest", "--resume", "--checkpoint-path", str(tmp_path / "cp"), "--progress", "--workers", "2"], spark) == 0
    assert "inserted: 3" in capsys.readouterr().out
    assert cli.main(["ingest", "--resume", "--checkpoint-path", str(tmp_path / "cp"), "--json"], spark) == 0
    assert '"processed": 0' in capsys.readouterr().out
    (folder / "b.txt").write_text("changed")
    assert cli.main(["diff"], spark) == 0
    out = capsys.readouterr().out
    assert "1 documents changed, 2 unchanged" in out
    assert cli.main(["export", "-o", str(tmp_path / "d1"), "--changed-only", "--one-file"], spark) == 0
    assert len((tmp_path / "d1").read_text().splitlines()) == 1
    assert cli.main(["export", "-o", str(tmp_path / "d2"), "--format", "legacy", "--one-file"], spark) == 0
    assert '"loomtext.chunk_anchor": "one:chunk_0"' in (tmp_path / "d2").read_text()
    (folder / "b.txt").unlink()
    assert cli.main(["prune", "--dry-run", "--json"], spark) == 0 and '"documents": 1' in capsys.readouterr().out
    assert cli.main(["prune"], spark) == 0 and cli.main(["inspect", "file:b.txt"], spark) == 1 and cli.main(["inspect", "file:a.md"], spark) == 0
    assert cli.main(["delete", "file:", "--json"], spark) == 0 and cli.main(["migrate"], spark) == 0
    (folder / "bad.txt").write_bytes(b"\xff")
    assert cli.main(["ingest", "--error-mode", "fail_fast"], spark) == 1 and cli.main(["ingest"], spark) == 3
    monkeypatch.chdir(folder)
    (folder / "loomtext.toml").write_text("x = 1")
    assert cli.main(["preview"], spark) == 1


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    for bad in ('x = 1', 'source = 1', '[loader]\ntype = "no"', '[loader]\nx = 1', '[loader]\ntype = "filesystem"\nhidden_policy = "all"', '[loader]\ntype = "filesystem"\ninclude_globs = "x"', '[[chunkers]]\ntype = "size"\nmax_chars = 0', '[[chunkers]]\ntype = "size"\nmax_chars = true', '[[chunkers]]\ntype = "size"\nmax_chars = 5\noverlap_chars = 5', '[[chunkers]]\ntype = "token"\ntokenizer = "bpe"', '[store]', '[export]\ntext_prepend = "all"', 'chunkers = 1', '[parser]\ntype = "auto"\nx = 1', '= ='):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            load(path, env={})
    path.write_text('source = "docs"\njson = true\n[loader]\ntype = "filesystem"\nexclude_globs = ["x"]\n[[chunkers]]\ntype = "heading"\n[[chunkers]]\ntype = "token"\nmax_tokens = 7')
    c = load(path, env={})
    assert c.resolved_source() == str(tmp_path / "docs") and c.json is True and c.loader.values["exclude_globs"] == ("x",) and c.loader.values["hidden_policy"] == "skip"
    assert registry.chunker_of(c) == C.TokenChunker(7, 0, "whitespace")
    env = {"LOOMTEXT_SOURCE": "/a", "LOOMTEXT_JSON": "0", "LOOMTEXT_STORE__PATH": "/s", "LOOMTEXT_EXPORT__TEXT_PREPEND": "none", "LOOMTEXT_EXPORT__INCLUDE_ANNOTATIONS": "TRUE"}
    c = load(path, env=env)
    assert (c.resolved_source(), c.json, c.store.values["path"], dict(c.export.values)) == ("/a", False, "/s", {"text_prepend": "none", "include_annotations": True})
    with pytest.raises(ConfigError):
        load(path, env={"LOOMTEXT_JSON": "maybe"})
    assert load(start=tmp_path, env={}).source is None and load(start=tmp_path, env=env).source == "/a"
    with pytest.raises(ConfigError):
        load(tmp_path / "none.toml")


def test_registry_and_composition(spark, folder):
    with pytest.raises(C.ChunkError):
        C.composed([C.SizeChunker()])
    with pytest.raises(C.ChunkError):
        C.composed([None, C.SizeChunker(), C.TokenChunker()])
    with pytest.raises(C.ChunkError):
        C.composed([None, None])
    assert ingest(read_files(spark, folder), C.composed([None])).snapshot.chunks.count() == 0
    registry.register("loaders", "mine", lambda: lambda s, src: read_files(s, src))
    assert registry.build("loaders", Part("mine"))(spark, folder).count() == 4 and "mine" in registry.components("loaders")
    with pytest.raises(LookupError):
        registry.resolve("chunkers", "none")
    with pytest.raises(ValueError):
        registry.register("things", "x", len)
    forced = registry.resolve("parsers", "plaintext")()(read_files(spark, folder).filter("source_uri = 'file:c.html'")).first()
    assert forced["source_type"] == "plaintext" and forced["title"] == "<h1>H</h1><p>para</p>"


def test_checkpoint(spark, folder, tmp_path):
    where = str(tmp_path / "cp")
    cp = Checkpoint(spark, where, fingerprint("a"))
    sources = read_files(spark, folder)
    assert ingest(sources, checkpoint=cp).counts() == {"processed": 3, "failed": 1}
    assert {r[0] for r in Checkpoint(spark, where, fingerprint("a")).done().select("source_uri").collect()} == {"file:a.md", "file:b.txt", "file:c.html"}
    assert ingest(sources, checkpoint=Checkpoint(spark, where, fingerprint("a"))).counts() == {"processed": 0, "failed": 1}
    assert Checkpoint(spark, where, fingerprint("b")).done().count() == 0  # other settings
    cp.mark(sources, "r")
    (tmp_path / "cp" / "state.json").write_text("{broken")
    assert Checkpoint(spark, where, fingerprint("a")).done().count() == 0
    assert fingerprint(C.SizeChunker(5)) == fingerprint(C.SizeChunker(5)) != fingerprint(C.SizeChunker(6))


def test_metrics(spark, folder, tmp_path):
    chunks = ingest(read_files(spark, folder)).snapshot.chunks
    rows = [(1, "TEXT one", ""), (2, "absent", ""), (3, "first line", "file:b.txt"), (3, "first line", "file:a.md"), (4, "t li", ""), (5, "rst line\nmo", "")]
    spans = spark.createDataFrame(rows, "query_id int, span_text string, source_uri string")
    hits = {(r["query_id"], r["source_uri"]): r["hits"] for r in evaluation.span_hits(chunks, spans).collect()}
    assert hits == {(1, ""): 1, (2, ""): 0, (3, "file:b.txt"): 1, (3, "file:a.md"): 0, (4, ""): 1, (5, ""): 1}
    got = evaluation.retrieval_metrics(chunks, spans.filter("query_id < 3")).first()
    assert got["recall_at_1"] == got["mean_reciprocal_rank"] == got["citation_hit_rate"] == 0.5
    asked = spark.createDataFrame([(i,) for i in (1, 2, 8, 9)], "query_id int")  # two have no spans
    assert evaluation.retrieval_metrics(chunks, spans.filter("query_id < 3"), asked).first()["recall_at_5"] == 0.25
    greek = spark.createDataFrame([("u", "ΟΔΟΣ und STRASSE im Text", [])], "source_uri string, content_text string, heading_path array<string>")
    some = spark.createDataFrame([(1, "οδοσ und straße", ""), (2, "οδος", "u"), (3, "straße im text", "")], "query_id int, span_text string, source_uri string")
    assert [r["hits"] for r in evaluation.span_hits(greek, some).collect()] == [1, 1, 1]
    m = evaluation.chunking_metrics(chunks, F.length("content_text")).first()
    assert m["total_chunks"] == 4 and m["avg_chunk_tokens"] == int(m["avg_chunk_chars"]) and m["orphan_chunk_count"] == 1
    path = tmp_path / "sub" / "corpus.json"
    corpus = evaluation.Corpus.of({"name": "n", "source_dir": str(folder), "queries": [{"query": "q", "answer_spans": [{"text": "text one", "start_char": "3", "end_char": 4.0}, 5], "relevant_doc_uris": ["u"]}, {"query": "none"}, 7]})
    corpus.save(path)
    assert evaluation.Corpus.load(path) == corpus and corpus.queries[0].answer_spans[0].start_char == 3 and len(corpus.queries) == 2
    path.write_text("[]")
    with pytest.raises(ValueError):
        evaluation.Corpus.load(path)
    out = evaluation.run_benchmark(corpus, [("size", C.SizeChunker()), ("small", C.SizeChunker(5))], lambda c: ingest(read_files(spark, folder), c).snapshot.chunks, spark)
    assert [x["chunker_name"] for x in out] == ["size", "small"] and out[0]["retrieval_metrics"]["recall_at_1"] == 0.5 and out[1]["chunking_metrics"]["total_chunks"] > 4


def test_diff_of_one(spark, folder):
    snap = ingest(read_files(spark, folder)).snapshot
    a, b = (snap.documents.filter(F.col("source_uri") == u) for u in ("file:a.md", "file:b.txt"))
    diff.compare_one(a, a)
    for pair in ((a, b), (snap.documents, a), (a.limit(0), a)):
        with pytest.raises(ValueError):
            diff.compare_one(*pair)
    new = diff.revision_diff(None, snap.chunks, None, snap.documents, "chunks").collect()
    assert {(r["status"], r["previous_revision"]) for r in new} == {("added", "")} and len(new) == 4
    same = diff.summary(diff.deltas(snap.sections, snap.sections), diff.deltas(snap.chunks, snap.chunks.withColumn("content_hash", F.when(F.col("source_uri") == "file:b.txt", "x").otherwise(F.col("content_hash")))))
    assert tuple(diff.changed_counts(same).first()) == (1, 2)


def test_stream(spark, folder, tmp_path):
    read_files(spark, folder).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    store = Store(spark, str(tmp_path / "store"))
    ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    assert store.stats()["documents"] == 3
    rows = spark.createDataFrame([("u", "zz", 1), ("u", "aa", 2), ("v", "x", None)], "source_uri string, checksum string, at int")
    assert {(r["source_uri"], r["checksum"]) for r in latest(rows, "at").collect()} == {("u", "aa"), ("v", "x")}


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_spans_are_broadcast_and_chunks_are_not(spark):
    rows = spark.createDataFrame([(f"file:{i}", f"some words of text {i} that hold a passage", "plain") for i in range(20)], "source_uri string, content_text string, kind string").withColumn("heading_path", F.array())
    asked = spark.createDataFrame([(1, "words of text 7 that", ""), (2, "passage", ""), (3, "hold a", "file:3")], "query_id int, span_text string, source_uri string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evaluation.span_hits(rows, asked)
        assert {r["query_id"]: r["hits"] for r in found.collect()} == {1: 1, 2: 20, 3: 1}
        p = plan(found)
        assert "CartesianProduct" not in p and p.count("BuildLeft") == 3  # each join with chunks
        m = evaluation.retrieval_metrics(rows, asked)
        assert tuple(m.first()) == (1.0, 1.0, 1.0, 1.0, 1.0) and plan(m).count("BuildLeft") == 3  # the hits are found once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_go_through_python_in_small_batches_and_once(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    spark.createDataFrame([(i, "# a\n\ntext\n" * 200) for i in range(3000)], "i int, text string").write.parquet(str(tmp_path / "t"))
    sources = table_sources(spark.read.parquet(str(tmp_path / "t")), "concat('file:', cast(i AS string))", "text", "text/markdown")
    try:
        docs = parse.documents(parse.parse(sources))
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20
        assert plan(C.chunks(docs)).count("ArrowEvalPython [_parse") == 1  # not again for the filter on errors
        spark.conf.unset(key)
        C.sections(docs)
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20
    finally:
        spark.conf.unset(key)


def test_store_shuffles_no_texts(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), 4)
    rows = lambda ids, mark: table_sources(spark.createDataFrame([(i, f"text {i} {mark if i % 3 == 0 else ''}") for i in ids], "i int, text string"), "concat('file:', cast(i AS string), '.txt')", "text")
    wrote = []
    write = Store._write
    monkeypatch.setattr(Store, "_write", lambda self, name, df, n: (wrote.append((name, df._jdf.queryExecution().executedPlan().toString())), write(self, name, df, n))[1])
    ingest(rows(range(40), "old"), store=store)
    ingest(rows(range(5, 50), "new"), store=store, prefixes=("file:",), prune=True)
    assert {n for n, _ in wrote} == {"documents", "sections", "chunks", "revisions"} and len(wrote) == 12
    for name, p in wrote:
        assert name == "revisions" or ("Exchange hashpartitioning" not in p and "Window" not in p), name
    docs = {r["source_uri"]: r for r in store.with_children(store.table("documents")).collect()}
    assert set(docs) == {f"file:{i}.txt" for i in range(5, 50)}
    assert all(len(d["sections"]) == len(d["chunks"]) == 1 and d["chunks"][0]["content_text"] == d["body"].strip() and ("new" in d["body"]) == (int(u[5:-4]) % 3 == 0) for u, d in docs.items())
    r = {(x["source_uri"], x["revision_number"]): x["is_current"] for x in store.table("revisions").collect()}
    assert r == {(f"file:{i}.txt", 1): i % 3 != 0 or i >= 40 for i in range(5, 50)} | {(f"file:{i}.txt", 2): True for i in range(5, 40) if i % 3 == 0}
    monkeypatch.setattr("loomtext.sources.store.FEW", 3)  # groups of buckets, and more in one bucket than are broadcast
    ingest(rows(range(5, 50), "newer"), store=store)
    monkeypatch.setattr("loomtext.sources.store.FOLDERS", 2)
    ingest(rows(range(50, 70), "newer"), store=store, prefixes=("file:",))
    assert store.stats() == {"documents": 65, "sections": 65, "chunks": 65} and store.table("chunks").filter("content_text LIKE '%newer%'").count() == sum(i % 3 == 0 for i in range(5, 70))
    assert max(map(len, store._version()["tables"]["chunks"].values())) == 2 and store.table("revisions").filter("is_current").count() == 65
    assert store.expire(1) > 0 and store.stats()["chunks"] == 65


def test_listing_resolves_folders_and_links_but_not_each_file(tmp_path, monkeypatch):
    root = tmp_path / "real"
    for i in range(300):
        to = root / f"d{i % 3}" / (".h" if i % 50 == 0 else "s") / f"{i}.{'md' if i % 2 else 'log'}"
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text("x")
    (root / "link.md").symlink_to(root / "d0/s/3.md")
    (root / "folder").symlink_to(root / "d1")
    (root / "broken.md").symlink_to(root / "none")
    (tmp_path / "way").symlink_to(root)
    calls = []
    resolve = Path.resolve
    monkeypatch.setattr(Path, "resolve", lambda self, strict=False: (calls.append(1), resolve(self, strict))[1])
    got = list_files(tmp_path / "way")
    assert len(calls) < 10
    want = sorted(f"d{i % 3}/s/{i}.md" for i in range(1, 300, 2))
    assert sorted(u.removeprefix("file:") for _, u in got) == sorted([*want, "d0/s/3.md"]) and all(p == f"{resolve(root)}/{u.removeprefix('file:')}" for p, u in got) and got == sorted(got)
    assert len(list_files(root, FileRules(exclude=("d0/**/*",), symlinks="skip"))) == sum(not w.startswith("d0") for w in want)
