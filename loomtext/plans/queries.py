"""The queries of the document engine over the test tables, and their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import ids
from loomtext.functions.batches import small_batches
from loomtext.operators import chunks as C
from loomtext.operators import counters as text
from loomtext.operators import diff, evaluation, export, parse, scope
from loomtext.plans.ingest import ingest
from loomtext.sources.files import read_files, table_sources, write_files
from loomtext.sources.shared import shared_dir
from loomtext.sources.store import Store, with_previous
from loomtext.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CREATED = "2024-01-01T00:00:00+00:00"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


# --- the tables as sources -----------------------------------------------------------------------

_URI = "concat('file:', source, '/', cast(doc_id AS string), '.txt')"


def plain(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return table_sources(d, _URI, "text", metadata=F.to_json(F.struct(F.col("lang"))))


def edited(spark: SparkSession, sf: str) -> DataFrame:
    """An earlier snapshot: a tenth of the documents is missing, a seventh lacks a sentence, one in a hundred had a namesake since removed."""
    d = table(spark, sf, "documents").filter("doc_id % 10 <> 0")
    d = d.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nOnce more."))).otherwise(F.col("text")))
    gone = d.filter("doc_id % 100 = 1").withColumn("source", F.concat("source", F.lit("-old")))
    return table_sources(d.unionByName(gone), _URI, "text")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return parse.documents(parse.parse(plain(spark, sf)))


def chunk_rows(spark: SparkSession, sf: str, chunker: C.SizeChunker | C.TokenChunker = C.SizeChunker()) -> DataFrame:
    return C.chunks(docs(spark, sf), chunker, ("title", "source_metadata", "frontmatter", "source_type"))


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as Markdown: a heading for each, and one below it for each turn."""
    t = table(spark, sf, "conversations")
    turn = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text")
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))).alias("turns"))
    body = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("turns", lambda r: r["x"]), "\n\n"))
    return parse.documents(parse.parse(table_sources(whole.withColumn("md", body), "concat('file:conversations/', cast(conv_id AS string), '.md')", "md", "text/markdown")))


def snapshot(sources: DataFrame) -> Store:
    """A new store, in the shared folder, of the given sources."""
    spark = sources.sparkSession
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 8)
    ingest(sources, store=store, prefixes=("file:",))
    return store


def stored(spark: SparkSession, sf: str) -> Store:
    return snapshot(plain(spark, sf))


# --- the same in SQL ---------------------------------------------------------------------------


def _uuid(name: str) -> str:
    h = f"sha1(unhex('{ids.NAMESPACE_HEX}') || encode({name}))"
    variant = f"lower(printf('%02x', (('0x' || substr({h}, 17, 2))::INT & 63) | 128))"
    return f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || {variant} || substr({h},19,2) || '-' || substr({h},21,12))"


_U = "'file:' || source || '/' || doc_id || '.txt'"
_SRC = f"src AS (SELECT *, {_U} AS uri FROM documents WHERE regexp_matches(text, '\\S'))"
#: Greedy cuts at 1500 characters of texts without blank lines, fences, lists and headings, but with table rows (lines with a bar).
_CUTS = r"""
  piece AS (
    SELECT uri, -1 AS i, NULL::VARCHAR AS content, regexp_replace(text, '^\s+', '') AS rem FROM base
    UNION ALL
    SELECT uri, i + 1, rtrim(CASE WHEN length(rem) <= 1500 THEN rem ELSE substr(rem, 1, sp) END, E' \n\t\r'),
      CASE WHEN length(rem) <= 1500 THEN '' ELSE ltrim(substr(rem, sp + 1), E' \n\t\r') END
    FROM (SELECT uri, i, rem, CASE
        WHEN length(regexp_extract(substr(rem, 1, 1501), '(?s)^(.*\|[^\n]*)\n', 1)) > 0 OR crossing THEN greatest(length(regexp_extract(substr(rem, 1, 1501), '(?s)^(.*\|[^\n]*)\n', 1)), CASE WHEN crossing THEN line_start ELSE 0 END)
        WHEN length(regexp_extract(substr(rem, 1, 1500), '(?s)^(.*)\n', 1)) > 0 THEN length(regexp_extract(substr(rem, 1, 1500), '(?s)^(.*)\n', 1))
        WHEN contains(split_part(rem, E'\n', 1), '|') THEN length(split_part(rem, E'\n', 1))
        WHEN length(regexp_extract(substr(rem, 1, 1501), '(?s)^(.*[.!?]\s+)\S', 1)) > 0 THEN length(regexp_extract(substr(rem, 1, 1501), '(?s)^(.*[.!?]\s+)\S', 1))
        ELSE 1500 END AS sp
      FROM (SELECT *, line_start > 0 AND contains(split_part(substr(rem, line_start + 1), E'\n', 1), '|') AS crossing
        FROM (SELECT *, length(regexp_extract(substr(rem, 1, 1500), '(?s)^(.*\n)', 1)) AS line_start FROM piece WHERE rem <> '')))
  ), cut AS (SELECT uri, i, content FROM piece WHERE i >= 0 AND content <> '')"""


def _cut_sql(base: str) -> str:
    return f"WITH RECURSIVE {_SRC}, base AS ({base}), {_CUTS}"


_DOC = _uuid("uri")
_NOW = _cut_sql("SELECT uri, text FROM src")
_OLD = r"""old0 AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN text || E'\nOnce more.' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0),
  old AS (SELECT 'file:' || source || '/' || doc_id || '.txt' AS uri, text FROM old0 UNION ALL SELECT 'file:' || source || '-old/' || doc_id || '.txt', text FROM old0 WHERE doc_id % 100 = 1)"""


@query(f"SELECT {_U} AS source_uri, sha256(text) AS checksum, 'text/plain' AS media_type, length(text)::BIGINT AS chars FROM documents")
def load_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return plain(spark, sf).select("source_uri", "checksum", "media_type", F.length("raw_text").cast("bigint").alias("chars"))


@query(f"WITH {_SRC} SELECT {_DOC} AS document_id, uri AS source_uri FROM src")
def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("document_id", "source_uri")


@query(rf"WITH {_SRC} SELECT uri AS source_uri, trim(regexp_extract(text, '^\s*([^\n]*)', 1), E' \t\r') AS title FROM src")
def plaintext_titles(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("source_uri", "title")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return small_batches(table(spark, sf, "documents")).select("doc_id", text.counts("text").alias("tokens"))


@query(f"SELECT {_U} AS source_uri FROM documents WHERE starts_with({_U}, 'file:' || (SELECT min(source) FROM documents) || '/')")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    first = d.agg(F.min("source")).first()[0]
    return d.select(F.expr(_URI).alias("source_uri")).filter(scope.in_scope(F.col("source_uri"), (f"file:{first}/",)))


@query(f"WITH {_OLD} SELECT uri AS source_uri FROM old WHERE uri NOT IN (SELECT {_U} FROM documents)")
def stale_uris(spark: SparkSession, sf: str) -> DataFrame:
    return scope.stale(edited(spark, sf).select("source_uri"), plain(spark, sf), ("file:",))


@query(f"WITH {_SRC}, {_OLD} SELECT s.uri AS source_uri, CASE WHEN o.uri IS NULL THEN 'inserted' WHEN o.text = s.text THEN 'skipped' ELSE 'updated' END AS action FROM src s LEFT JOIN old o USING (uri)")
def upsert_classify(spark: SparkSession, sf: str) -> DataFrame:
    return scope.upsert_classes(parse.documents(parse.parse(edited(spark, sf))), docs(spark, sf))


@query(f"WITH {_SRC}, {_OLD} SELECT s.uri AS source_uri FROM src s LEFT JOIN old o ON s.uri = o.uri AND s.text = o.text WHERE o.uri IS NULL")
def checkpoint_skip(spark: SparkSession, sf: str) -> DataFrame:
    return ingest(plain(spark, sf), done=edited(spark, sf)).snapshot.documents.select("source_uri")


@query(_NOW + f" SELECT {_uuid(f'{_DOC} || {chr(39)}:chunk:__root__:chunk_{chr(39)} || i')} AS chunk_id, uri AS source_uri, i::INT AS section_chunk_index, substr(sha256(content), 1, 16) AS content_hash, length(content)::INT AS chars FROM cut")
def size_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf).select("chunk_id", "source_uri", "section_chunk_index", "content_hash", F.length("content_text").alias("chars"))


@query(
    _NOW
    + rf""" SELECT {_uuid(f"{_DOC} || ':chunk:__root__:chunk_' || i")} AS id, {_DOC} AS document_id, {_uuid(f"{_DOC} || ':section:__root__'")} AS section_id, '__root__:chunk_' || i AS chunk_anchor, '__root__' AS section_anchor,
  trim(regexp_extract(text, '^\s*([^\n]*)', 1), E' \t\r') || E'\n\n' || content AS text, substr(sha256(content), 1, 16) AS content_hash, length(content)::INT AS char_count, uri AS source_uri,
  trim(regexp_extract(text, '^\s*([^\n]*)', 1), E' \t\r') AS title, '' AS section_path, 1 AS schema_version, '{export.VERSION}' AS pipeline_version, '{CREATED}' AS created_at, lang AS user_lang FROM cut JOIN src USING (uri)"""
)
def vector_records_v1(spark: SparkSession, sf: str) -> DataFrame:
    r = export.records(chunk_rows(spark, sf), CREATED)
    return r.withColumn("section_path", F.array_join("section_path", " > ")).withColumn("user_lang", F.get_json_object("user_metadata", "$.lang")).drop("user_metadata")


@query(_cut_sql("SELECT uri, text FROM src") + " SELECT count(*) AS total_chunks, round(avg(length(content)), 6) AS avg_chunk_chars, (sum(len(regexp_extract_all(content, '\\S+'))) // count(*))::BIGINT AS avg_chunk_tokens, min(length(content))::BIGINT AS min_chunk_chars, max(length(content))::BIGINT AS max_chunk_chars, count(*) AS orphan_chunk_count, 1.0::DOUBLE AS orphan_chunk_rate FROM cut")
def chunking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.chunking_metrics(chunk_rows(spark, sf), text.counts("content_text")).withColumn("avg_chunk_chars", F.round("avg_chunk_chars", 6))


_FOLD = "replace(lower({0}), 'ß', 'ss')"


@query(_NOW + f" SELECT item_id AS query_id, (SELECT count(*) FROM cut WHERE contains({_FOLD.format('content')}, {_FOLD.format('b.text')})) AS hits FROM benchmark b")
def citation_hits(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.span_hits(chunk_rows(spark, sf), spans(spark, sf)).select("query_id", "hits")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("span_text"), F.lit("").alias("source_uri"))


@query(_NOW + f", h AS (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM cut WHERE contains({_FOLD.format('content')}, {_FOLD.format('b.text')})) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM benchmark b) SELECT round(r, 9) AS recall_at_1, round(r, 9) AS recall_at_5, round(r, 9) AS recall_at_10, round(r, 9) AS mean_reciprocal_rank, round(r, 9) AS citation_hit_rate FROM h")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluation.retrieval_metrics(chunk_rows(spark, sf), spans(spark, sf))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


_BOTH = (
    "WITH RECURSIVE " + _SRC + ", " + _OLD + ", base AS (SELECT 'n' || uri AS uri, text FROM src UNION ALL SELECT 'o' || uri, text FROM old WHERE regexp_matches(text, '\\S')), " + _CUTS
    + ", a AS (SELECT substr(uri, 2) AS uri, '__root__:chunk_' || i AS anchor, substr(sha256(content), 1, 16) AS h FROM cut WHERE uri[1] = 'o'), b AS (SELECT substr(uri, 2) AS uri, '__root__:chunk_' || i AS anchor, substr(sha256(content), 1, 16) AS h FROM cut WHERE uri[1] = 'n')"
    ", delta AS (SELECT uri AS source_uri, anchor, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS status, a.h AS previous_hash, b.h AS current_hash FROM a FULL JOIN b USING (uri, anchor))"
)


def _chunk_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return diff.deltas(C.chunks(parse.documents(parse.parse(edited(spark, sf)))), chunk_rows(spark, sf))


@query(_BOTH + " SELECT * FROM delta")
def chunk_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_deltas(spark, sf)


@query(_BOTH + ", sec AS (SELECT source_uri, count(*) FILTER (status = 'added') AS a, count(*) FILTER (status = 'removed') AS r, count(*) AS n, count(*) FILTER (status = 'unchanged') AS u FROM delta GROUP BY source_uri), "
       "t AS (SELECT coalesce(o.uri, s.uri) AS source_uri, CASE WHEN o.uri IS NULL THEN 'added' WHEN s.uri IS NULL THEN 'removed' WHEN trim(o.text, E' \\n\\t\\r') = trim(s.text, E' \\n\\t\\r') THEN 'unchanged' ELSE 'modified' END AS st FROM old o FULL JOIN src s ON o.uri = s.uri)"
       + " SELECT d.source_uri, " + ", ".join(f"count(*) FILTER (status = '{s}') AS chunks_{s}" for s in diff.STATUSES) + ", " + ", ".join(f"(max(st) = '{s}')::BIGINT AS sections_{s}" for s in diff.STATUSES) + " FROM delta d JOIN t USING (source_uri) GROUP BY d.source_uri")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff.summary(diff.deltas(C.sections(parse.documents(parse.parse(edited(spark, sf)))), C.sections(docs(spark, sf))), _chunk_deltas(spark, sf))


@query(_BOTH + f" SELECT CASE status WHEN 'removed' THEN 'deleted' ELSE status END AS op, {_uuid(_uuid('source_uri') + chr(124) * 2 + chr(39) + ':chunk:' + chr(39) + chr(124) * 2 + 'anchor')} AS id, current_hash AS content_hash FROM delta WHERE status <> 'unchanged'")
def export_delta(spark: SparkSession, sf: str) -> DataFrame:
    return diff.export_delta(_chunk_deltas(spark, sf), export.records(chunk_rows(spark, sf), CREATED)).select("op", "id", "content_hash")


_TALK = r"""WITH t AS (SELECT *, 'file:conversations/' || conv_id || '.md' AS uri, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)"""


@query(_TALK + f""" SELECT source_uri, order_index::INT AS order_index, heading, heading_level::INT AS heading_level, anchor, heading_path, content_hash, {_uuid(_uuid('source_uri') + " || ':section:' || anchor")} AS section_id, CASE WHEN heading_level = 2 THEN {_uuid(_uuid('source_uri') + " || ':section:' || parent")} END AS parent_id FROM (
  SELECT DISTINCT uri AS source_uri, 0 AS order_index, 'Conversation ' || conv_id AS heading, 1 AS heading_level, 'conversation-' || conv_id AS anchor, 'Conversation ' || conv_id AS heading_path, substr(sha256(''), 1, 16) AS content_hash, NULL AS parent FROM t
  UNION ALL SELECT uri, i, role, 2, 'conversation-' || conv_id || '/' || role || CASE WHEN k > 1 THEN '~' || k ELSE '' END, 'Conversation ' || conv_id || ' > ' || role, substr(sha256(trim(text, E' \\n\\t\\r')), 1, 16), 'conversation-' || conv_id FROM t)""")
def conversation_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = C.sections(talks(spark, sf))
    return s.select("section_id", "source_uri", "parent_id", "order_index", "heading", "heading_level", "anchor", F.array_join("heading_path", " > ").alias("heading_path"), "content_hash")


@query("WITH r AS (SELECT l_orderkey AS document_id, l_linenumber AS revision_number FROM lineitem) SELECT document_id, revision_number FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY revision_number DESC) AS n FROM r) WHERE n > 3")
def prune_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines stand for revisions."""
    return diff.revisions_to_prune(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("revision_number")), 3)


@query("SELECT l_orderkey AS document_id, l_linenumber AS revision_number, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous FROM lineitem")
def current_previous_revision(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("revision_number"))
    return with_previous(rows, "revision_number").withColumnRenamed("previous_revision_number", "previous")


@query(f"WITH {_SRC} SELECT uri AS source_uri, {_DOC} AS document_id FROM src ORDER BY uri LIMIT 50 OFFSET 100")
def list_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).page("documents", 100, 50)[0].select("source_uri", "document_id")


@query(_NOW + " SELECT (SELECT count(*) FROM src) AS documents, (SELECT count(*) FROM src) AS sections, count(*) AS chunks FROM cut")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(spark, sf).stats()
    return spark.createDataFrame([tuple(s.values())], "documents bigint, sections bigint, chunks bigint")


@query(r"SELECT url AS source_uri, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g').replace('&lt;', '<').replace('&gt;', '>').replace('&amp;', '&')) AS title FROM pages WHERE html LIKE '%<title>%'")
def html_titles(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse(table_sources(table(spark, sf, "pages"), "url", "html", "text/html")).filter("source_uri IS NOT NULL").select("source_uri", "title")


@query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    d = parse.documents(parse.parse(table_sources(table(spark, sf, "pages"), "url", "html", "text/html")))
    return C.chunks(d).select("chunk_id", "source_uri", "anchor", "content_hash", "structure_types")


@query()
def token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, C.TokenChunker(512, 32)).select("chunk_id", "source_uri", "section_chunk_index", "content_hash", "token_count")


#: The cuts with the place of each piece in the section's content, and the end of the piece before in front of it.
_PLACED = (
    _cut_sql("SELECT uri, text FROM src").replace("SELECT uri, -1 AS i, NULL::VARCHAR AS content, ", "SELECT uri, -1 AS i, NULL::VARCHAR AS content, 0 AS used, 0 AS place, ").replace("SELECT uri, i + 1, rtrim(", "SELECT uri, i + 1, rtrim(", 1)
    .replace("FROM (SELECT uri, i, rem, CASE", "FROM (SELECT uri, i, rem, used, CASE")
    .replace("rtrim(CASE WHEN length(rem) <= 1500 THEN rem ELSE substr(rem, 1, sp) END, E' \\n\\t\\r'),", "rtrim(CASE WHEN length(rem) <= 1500 THEN rem ELSE substr(rem, 1, sp) END, E' \\n\\t\\r'), used + CASE WHEN length(rem) <= 1500 THEN length(rem) ELSE length(rem) - length(ltrim(substr(rem, sp + 1), E' \\n\\t\\r')) END, used,")
    .replace("cut AS (SELECT uri, i, content FROM piece", "cut AS (SELECT uri, i, content, place FROM piece")
)


@query(
    _PLACED + ", o AS (SELECT *, ltrim(right(lag(content) OVER (PARTITION BY uri ORDER BY i), 100), E' \\n\\t\\r') AS tail, lag(place + length(content)) OVER (PARTITION BY uri ORDER BY i) AS stop FROM cut), p AS (SELECT *, CASE WHEN coalesce(tail, '') = '' THEN content ELSE tail || CASE WHEN place > stop THEN ' ' ELSE '' END || content END AS whole FROM o)"
    + f" SELECT {_uuid(f'{_DOC} || {chr(39)}:chunk:__root__:chunk_{chr(39)} || i')} AS chunk_id, i::INT AS section_chunk_index, substr(sha256(whole), 1, 16) AS content_hash, place::INT AS char_start, (place + length(content))::INT AS char_end FROM p"
)
def size_chunks_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that begin with the end of the one before."""
    return chunk_rows(spark, sf, C.SizeChunker(1500, 100)).select("chunk_id", "section_chunk_index", "content_hash", "char_start", "char_end")


@query()
def size_chunks_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf, C.SizeChunker(1500, 100, 200)).select("chunk_id", "source_uri", "section_chunk_index", "content_hash", "char_start", "char_end")


@query(_NOW + f" SELECT {_uuid(f'{_DOC} || {chr(39)}:chunk:__root__:chunk_{chr(39)} || i')} AS chunk_id, 'table' AS structure_type FROM cut WHERE contains(content, '|')")
def structure_types(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(docs(spark, sf)).select("chunk_id", F.explode("structure_types").alias("structure_type"))


# --- through the store -----------------------------------------------------------------------------

_STORED = f"WITH {_SRC}, {_OLD}, prev AS (SELECT * FROM old WHERE regexp_matches(text, '\\S'))"


@query(_STORED + " SELECT coalesce(s.uri, p.uri) AS source_uri, CASE WHEN p.uri IS NULL THEN 'inserted' WHEN s.uri IS NULL THEN 'kept' WHEN p.text = s.text THEN 'skipped' ELSE 'updated' END AS action, sha256(coalesce(s.text, p.text)) AS source_checksum, CASE WHEN p.uri IS NOT NULL AND s.uri IS NOT NULL AND p.text <> s.text THEN 2 ELSE 1 END AS revisions FROM src s FULL JOIN prev p ON s.uri = p.uri")
def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier snapshot, then the present one over it: what was done, and what is stored now."""
    store = snapshot(edited(spark, sf))
    done = ingest(plain(spark, sf), store=store, prefixes=("file:",)).actions
    revisions = store.table("revisions").groupBy("source_uri").agg(F.max("revision_number").alias("revisions"))
    return store.table("documents").select("source_uri", "source_checksum").join(done, "source_uri", "left").join(revisions, "source_uri").select("source_uri", F.coalesce("action", F.lit("kept")).alias("action"), "source_checksum", "revisions")


@query(_STORED + " SELECT coalesce(s.uri, p.uri) AS source_uri, CASE WHEN p.uri IS NULL THEN 'inserted' WHEN s.uri IS NULL THEN 'deleted' WHEN p.text = s.text THEN 'skipped' ELSE 'updated' END AS action, s.uri IS NOT NULL AS is_stored FROM src s FULL JOIN prev p ON s.uri = p.uri")
def store_sync(spark: SparkSession, sf: str) -> DataFrame:
    store, now = snapshot(edited(spark, sf)), ingest(plain(spark, sf)).snapshot
    plan = store.sync(now, "dry", CREATED, ("file:",), dry_run=True).actions
    done = store.sync(now, "run", CREATED, ("file:",))
    there = store.table("documents").select("source_uri", F.lit(True).alias("there"))
    return plan.join(done.actions, ["source_uri", "action"]).join(there, "source_uri", "left").select("source_uri", "action", F.coalesce("there", F.lit(False)).alias("is_stored"))


@query(_NOW + f", first AS (SELECT min(source) AS s FROM documents) SELECT uri AS source_uri, count(*)::INT AS chunks, string_agg(substr(sha256(content), 1, 16), ' ' ORDER BY i) AS hashes FROM cut, first WHERE starts_with(uri, 'file:' || s || '/') GROUP BY uri")
def store_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by URI, with their children in order."""
    store = stored(spark, sf)
    first = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    found = store.with_children(store.documents_by_uris(store.uris_in_scope((f"file:{first}/",))))
    return found.select("source_uri", F.size("chunks").alias("chunks"), F.array_join(F.transform("chunks", lambda c: c["content_hash"]), " ").alias("hashes"))


@query(_STORED + " SELECT uri AS source_uri, sha256(text) AS source_checksum, 2::INT AS revision_number, false AS was_current FROM src s JOIN prev p USING (uri) WHERE s.text <> p.text".replace("sha256(text)", "sha256(s.text)"))
def revision_numbers(spark: SparkSession, sf: str) -> DataFrame:
    store = snapshot(edited(spark, sf))
    ingest(plain(spark, sf), store=store)
    r = store.table("revisions")
    now = r.filter("is_current AND revision_number > 1").select("source_uri", "source_checksum", "revision_number")
    return now.join(r.filter("revision_number = 1").select("source_uri", F.col("is_current").alias("was_current")), "source_uri")


@query(_NOW + f", first AS (SELECT min(source) AS s FROM documents), gone AS (SELECT uri FROM src, first WHERE starts_with(uri, 'file:' || s || '/')) SELECT (SELECT count(*) FROM gone) AS documents, (SELECT count(*) FROM gone) AS sections, (SELECT count(*) FROM cut WHERE uri IN (SELECT uri FROM gone)) AS chunks, (SELECT count(*) FROM gone) AS revisions, (SELECT count(*) FROM src WHERE uri NOT IN (SELECT uri FROM gone)) AS documents_left")
def delete_by_prefix_counts(spark: SparkSession, sf: str) -> DataFrame:
    store = stored(spark, sf)
    first = table(spark, sf, "documents").agg(F.min("source")).first()[0]
    counts = store.delete_prefix(f"file:{first}/")
    return spark.createDataFrame([(*counts.values(), store.stats()["documents"])], "documents bigint, sections bigint, chunks bigint, revisions bigint, documents_left bigint")


@query("SELECT 'file:' || source || '/_' || doc_id || '[1].txt' AS source_uri, sha256(text) AS checksum, 'text/plain' AS media_type FROM documents")
def files_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as files, with names that Hadoop would hide or take for patterns, and read as sources."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    where = folder.removeprefix("file://").removeprefix("file:")
    write_files(table(spark, sf, "documents").select(F.concat("source", F.lit("/_"), "doc_id", F.lit("[1].txt")), "text"), where).agg(F.sum("files")).first()
    return read_files(spark, where).select("source_uri", "checksum", "media_type")


# --- forms of records, and more of the differences -----------------------------------------------

_TITLE = r"trim(regexp_extract(text, '^\s*([^\n]*)', 1), E' \t\r')"
_CHUNK = f"{_uuid(f'{_DOC} || {chr(39)}:chunk:__root__:chunk_{chr(39)} || i')}"


def _prepended(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return export.records(chunk_rows(spark, sf), CREATED, strategy).select("id", "text")

    f.__name__ = f"text_prepend_{strategy}"
    return f


for _s in export.STRATEGIES:
    _sql_text = "content" if _s in ("none", "heading_path") else f"{_TITLE} || E'\n\n' || content"  # the root section has no path
    query(_NOW + f" SELECT {_CHUNK} AS id, {_sql_text} AS text FROM cut JOIN src USING (uri)")(_prepended(_s))


@query(_NOW + rf""" SELECT {_CHUNK} AS id, lang, '{{"lang": "' || lang || '", "loomtext.document_id": "' || {_DOC} || '", "loomtext.source_uri": "' || uri || '", "loomtext.source_type": "plaintext", "loomtext.section_id": "' || {_uuid(f"{_DOC} || ':section:__root__'")} || '", "loomtext.heading_path": [], "loomtext.lineage": [], "loomtext.chunk_anchor": "__root__:chunk_' || i || '", "loomtext.chunk_order_index": ' || i || ', "loomtext.section_chunk_index": ' || i || ', "loomtext.schema_version": 1}}' AS metadata FROM cut JOIN src USING (uri)""")
def legacy_vector_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return export.legacy_records(chunk_rows(spark, sf)).select("id", F.get_json_object("metadata", "$.lang").alias("lang"), "metadata")


@query(_BOTH + f" SELECT {_uuid(_uuid('source_uri') + chr(124) * 2 + chr(39) + ':chunk:' + chr(39) + chr(124) * 2 + 'anchor')} AS id FROM delta WHERE status = 'removed'")
def deleted_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return diff.export_delta(_chunk_deltas(spark, sf), export.records(chunk_rows(spark, sf), CREATED)).filter("op = 'deleted'").select("id")


@query(_BOTH + ", d AS (SELECT source_uri, bool_or(status <> 'unchanged') AS c FROM delta GROUP BY source_uri) SELECT count(*) FILTER (c) AS changed, count(*) FILTER (NOT c) AS unchanged FROM d")
def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return diff.changed_counts(QUERIES["diff_summary"](spark, sf))


@query(_STORED + " SELECT s.uri AS source_uri, coalesce(sha256(p.text), '') AS previous_revision, sha256(s.text) AS current_revision, CASE WHEN p.uri IS NULL THEN 'added' WHEN trim(p.text, E' \\n\\t\\r') = trim(s.text, E' \\n\\t\\r') THEN 'unchanged' ELSE 'modified' END AS status FROM src s LEFT JOIN prev p USING (uri)".replace("SELECT s.uri", "SELECT uri"))
def section_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, now = parse.documents(parse.parse(edited(spark, sf))), docs(spark, sf)
    return diff.revision_diff(C.sections(old), C.sections(now), old, now, "sections").select("source_uri", "previous_revision", "current_revision", "status")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS k, round(max(l_quantity), 3) AS q FROM lineitem GROUP BY l_orderkey")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Of several versions of a source in a stream's batch the last counts: order lines stand for versions, their quantity for the time."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_uri"), F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("string").alias("checksum"))
    return changes.latest(rows, "q").select(F.col("source_uri").alias("k"), F.round("q", 3).alias("q"))
