"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, flac, langid, mixing, neardup, pii, suffixes, topk, toxicity, warc
from loomtext.llm.tables import table


def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no sound; each embedding is rendered as a clip, encoded, and decoded again."""
    return flac.decode(flac.clips(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test tables hold no archives; the pages are written as WARC files, and these are read."""
    found = warc.read(warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    html = F.when(~F.col("is_null"), F.decode("content", "UTF-8"))
    return found.select("page_id", F.col("target_uri").alias("url"), html.alias("html"), "type", "content_length", "digest_ok", "error")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "epoch", F.round("position", 9).alias("position"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repeats": op1_suffix_repeats,
    "op2_topk": op2_topk,
    "op3_minhash_groups": op3_minhash_groups,
    "op4_toxicity": op4_toxicity,
    "op5_flac": op5_flac,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
}

#: Positions as in loomtext.llm.mixing, with its own schedule, over a relation `docs`.
MIXING_SQL = r"""
    tok AS (
      SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')) AS tokens, substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS h FROM docs WHERE doc_id IS NOT NULL
    ), per AS (
      SELECT source, sum(tokens)::DOUBLE AS supply FROM tok GROUP BY source
    ), tot AS (
      SELECT sum(supply) AS total, count(*)::DOUBLE AS sources FROM per WHERE supply > 0
    ), sh AS (
      SELECT source, supply, total, CASE WHEN supply > 0 THEN supply / total + 0.2::DOUBLE * (1.0::DOUBLE / sources - supply / total) ELSE 0.0::DOUBLE END AS w0, supply / total AS w1 FROM per, tot
    ), ep AS (
      SELECT *, (w0 + w1) / 2.0::DOUBLE AS d1, CASE WHEN supply > 0 THEN greatest(least(total * ((w0 + w1) / 2.0::DOUBLE) / supply, 4.0::DOUBLE), 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS epochs FROM sh
    ), cum AS (
      SELECT t.*, supply, w0, w1, d1, epochs,
        coalesce(sum(tokens) OVER (PARTITION BY t.source ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM tok t JOIN ep ON t.source IS NOT DISTINCT FROM ep.source
    ), passes AS (
      SELECT *, unnest(range(0, greatest(ceil(epochs)::INT, 1)))::INT AS epoch FROM cum
    ), mid AS (
      SELECT *, CASE WHEN supply > 0 THEN (epoch + (ahead::DOUBLE + tokens::DOUBLE / 2.0::DOUBLE) / supply) / epochs * d1 ELSE 0.0::DOUBLE END AS y
      FROM passes WHERE supply = 0 OR epoch + (ahead + tokens)::DOUBLE / supply <= epochs * (1.0::DOUBLE + 1e-9::DOUBLE)
    ), mixed AS (
      SELECT *, CASE WHEN y > 0 THEN least(2.0::DOUBLE * y / (w0 + sqrt(greatest(w0 * w0 + 2.0::DOUBLE * (w1 - w0) * y, 0.0::DOUBLE))), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS position FROM mid
    )"""

ORACLE: dict[str, str] = {
    "op8_warc": "SELECT page_id, url, html, 'resource' AS type, strlen(html)::BIGINT AS content_length, true AS digest_ok, CAST(NULL AS VARCHAR) AS error FROM pages",
    "op9_mixing": "WITH docs AS (SELECT * FROM documents), " + MIXING_SQL + " SELECT doc_id, text, lang, source, n_chars, epoch, round(position, 9) AS position FROM mixed",
    "op1_suffix_repeats": r"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), win AS (
          SELECT DISTINCT doc_id, p, array_to_string(ws[p + 1 : p + 50], ' ') AS s
          FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS p FROM w)
        ), many AS (
          SELECT s, min(doc_id) < max(doc_id) AS across FROM win GROUP BY s HAVING count(*) > 1
        ), rep AS (
          SELECT doc_id, p, bool_or(lead) AS lead, bool_or(across) AS across FROM (
            SELECT doc_id, p, across, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) = 1 AS lead FROM win JOIN many USING (s)
          ) GROUP BY doc_id, p
        ), marked AS (
          SELECT *, CASE WHEN p > lag(p) OVER d + 50 OR lag(p) OVER d IS NULL THEN 1 ELSE 0 END AS new FROM rep WINDOW d AS (PARTITION BY doc_id ORDER BY p)
        ), island AS (
          SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked
        )
        SELECT doc_id, min(p) AS word_start, max(p) + 50 AS word_end, count(*) AS windows, count(*) FILTER (lead) AS first_windows, count(*) FILTER (across) AS cross_windows
        FROM island GROUP BY doc_id, g
    """,
    # all pairs; the operator finds a pair at the threshold with a probability of 0.92, and one of a similarity of 0.6 with 0.996
    "op3_minhash_groups": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ), s AS (
          SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS p FROM w WHERE len(ws) > 0)
        ), n AS (
          SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), both_ AS (
          SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
        ), e AS (
          SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.5 * (x.n + y.n - k)
        ), edges AS (
          SELECT a, b FROM e UNION ALL SELECT b, a FROM e
        ), reach AS (
          SELECT a AS v, a AS m FROM edges UNION SELECT edges.b, reach.m FROM reach JOIN edges ON reach.v = edges.a
        )
        SELECT v AS doc_id, min(m) AS group_id, v = min(m) AS keep FROM reach GROUP BY v
    """,
    "op2_topk": r"""
        WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        f AS (SELECT doc_id, w, count(*) AS f FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9\x{80}-\x{10FFFF}]+')) AS w FROM d) GROUP BY ALL),
        df AS (SELECT w, count(*) AS df FROM f GROUP BY w),
        q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
        s AS (
          SELECT query_id, doc_id, sum(CAST(floor(1000.0::DOUBLE * ln(1.0::DOUBLE + (SELECT count(*) FROM d)::DOUBLE / df::DOUBLE) * f::DOUBLE * 2.2::DOUBLE / (f::DOUBLE + 1.2::DOUBLE)) AS BIGINT))::BIGINT AS score
          FROM q JOIN f USING (w) JOIN df USING (w) GROUP BY ALL
        )
        SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
    """,
}
