"""Quality of chunks: sizes, and whether answers can be found in them."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.batches import once, small_batches


def _casefold(c: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in c.to_pylist()], pa.string())


def folded(c: Column) -> Column:
    """Text as it is compared: case-folded, which lower-casing is not (sharp s, final sigma)."""
    return once(_casefold, "string")(c)


def chunking_metrics(chunks: DataFrame, token_counter: Column | None = None) -> DataFrame:
    """token_counter: the tokens of a chunk; their average is rounded down."""
    n = F.length("content_text")
    orphan = F.size("heading_path") == 0
    tokens = F.lit(None).cast("bigint") if token_counter is None else F.coalesce(F.expr("sum(__t) div count(__t)"), F.lit(0))
    rows = chunks if token_counter is None else chunks.withColumn("__t", F.greatest(token_counter.cast("bigint"), F.lit(0)))
    return rows.agg(F.count("*").alias("total_chunks"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chunk_chars"), tokens.alias("avg_chunk_tokens"), F.coalesce(F.min(n), F.lit(0)).cast("bigint").alias("min_chunk_chars"), F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_chunk_chars"), F.count_if(orphan).alias("orphan_chunk_count"), F.coalesce(F.avg(orphan.cast("double")), F.lit(0.0)).alias("orphan_chunk_rate"))


def span_hits(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, span_text, source_uri, hits): chunks of the span's source, or of any where that is empty, that hold the span,
    for each row of `spans`. Spans of a source meet the chunks of this source only. The others are joined on a word: a chunk that holds a span holds
    the words inside it as words, so one is enough, and that which the fewest spans have is taken; only what they share is compared as a whole. Spans
    of fewer than three words are compared with all chunks; an empty one is in every chunk. What the spans give is broadcast (a corpus of them is a file that
    the driver has read), and chunks never are: Spark takes texts that functions return for some bytes, and would send all of them through the driver."""
    c = small_batches(chunks).select(F.col("source_uri").alias("uri"), folded(F.col("content_text")).alias("t"))
    s = spans.select("query_id", "span_text", F.coalesce("source_uri", F.lit("")).alias("source_uri"))
    s = s.withColumn("f", folded(F.col("span_text")))
    different = s.filter("f IS NOT NULL").select("f", "source_uri").distinct()
    own = F.broadcast(different.filter("source_uri <> ''")).join(c, (F.col("source_uri") == F.col("uri")) & F.contains("t", "f")).select("f", "source_uri")
    words = lambda x: F.split(x, r"\s+")
    any_ = different.filter("source_uri = ''").select("f", words("f").alias("w"))
    long = any_.filter(F.size("w") > 2).select("f", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    common = long.groupBy("word").agg(F.count("*").alias("spans"))
    chosen = long.join(common, "word").groupBy("f").agg(F.min(F.struct("spans", -F.length("word"), "word")).alias("x")).select("f", F.col("x.word").alias("word"))
    inside = c.select("t", F.explode(F.array_distinct(words("t"))).alias("word"))
    met = F.broadcast(chosen).join(inside, "word").filter(F.contains("t", "f")).select("f", F.lit("").alias("source_uri"))
    short = F.broadcast(any_.filter(F.size("w") <= 2)).join(c, F.contains("t", "f")).select("f", F.lit("").alias("source_uri"))
    hits = own.union(met).union(short).groupBy("f", "source_uri").agg(F.count("*").alias("hits"))
    return s.join(hits, ["f", "source_uri"], "left").select("query_id", "span_text", "source_uri", F.coalesce("hits", F.lit(0)).alias("hits"))


def retrieval_metrics(chunks: DataFrame, spans: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Chunks are ranked by the spans they hold, so the first one hits as soon as any does; recall at
    every depth and the reciprocal rank are the share of queries with a hit. queries: (query_id) of all, also those without a span, which have no hit."""
    q = span_hits(chunks, spans).groupBy("query_id").agg(F.count("*").alias("spans"), F.count_if(F.col("hits") > 0).alias("found")).withColumn("asked", F.lit(True))
    if queries is not None:
        asked = queries.select("query_id").distinct().withColumn("asked", F.lit(True))
        q = q.drop("asked").join(asked, "query_id", "full_outer")
    recall = F.coalesce(F.avg(F.when(F.col("asked"), (F.coalesce("found", F.lit(0)) > 0).cast("double"))), F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.sum("found"), F.sum("spans")), F.lit(0.0))
    return q.agg(*[recall.alias(x) for x in ("recall_at_1", "recall_at_5", "recall_at_10", "mean_reciprocal_rank")], rate.alias("citation_hit_rate"))


# --- corpora of questions ------------------------------------------------------------------------


@dataclass(frozen=True)
class Span:
    text: str
    source_uri: str = ""
    start_char: int | None = None
    end_char: int | None = None


@dataclass(frozen=True)
class Query:
    query: str
    answer_spans: tuple[Span, ...] = ()
    relevant_doc_uris: tuple[str, ...] = ()


def _whole(x: object) -> int | None:
    """A number, or a text of one; None for all else."""
    try:
        return int(x) if isinstance(x, bool | int | float) else int(str(x).strip()) if isinstance(x, str) else None
    except (ValueError, OverflowError):
        return None


def _items(of: dict, name: str) -> list:
    got = of.get(name)
    return got if isinstance(got, list) else []


@dataclass(frozen=True)
class Corpus:
    name: str = ""
    description: str = ""
    source_dir: str = ""
    queries: tuple[Query, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, raw: dict) -> Corpus:
        """Of what JSON gave; what is missing or of another kind is left out."""
        made = []
        for q in _items(raw, "queries"):
            if isinstance(q, dict):
                spans = tuple(Span(str(x.get("text", "")), str(x.get("source_uri", "")), _whole(x.get("start_char")), _whole(x.get("end_char"))) for x in _items(q, "answer_spans") if isinstance(x, dict))
                made.append(Query(str(q.get("query", "")), spans, tuple(map(str, _items(q, "relevant_doc_uris")))))
        return cls(*(str(raw.get(k, "")) for k in ("name", "description", "source_dir")), tuple(made))

    @classmethod
    def load(cls, path: str | Path) -> Corpus:
        raw = json.loads(Path(path).read_text("utf-8"))
        if not isinstance(raw, dict):
            raise ValueError(f"{path}: an evaluation corpus is a JSON object")
        return cls.of(raw)

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n", "utf-8")

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(query_id, query) and (query_id, span_text, source_uri)."""
        spans = [(i, s.text, s.source_uri) for i, q in enumerate(self.queries) for s in q.answer_spans]
        return spark.createDataFrame([(i, q.query) for i, q in enumerate(self.queries)], "query_id int, query string"), spark.createDataFrame(spans, "query_id int, span_text string, source_uri string")


def run_benchmark(corpus: Corpus, chunkers: Iterable[tuple[str, object]], chunks_of: Callable[[object], DataFrame], spark: SparkSession) -> list[dict]:
    """For each (name, chunker): chunker_name, chunking_metrics (with elapsed_seconds) and retrieval_metrics (None without queries).
    chunks_of: a chunker to the chunks of the corpus' sources."""
    queries, spans = corpus.tables(spark)
    out = []
    for name, chunker in chunkers:
        began = time.perf_counter()
        rows = chunks_of(chunker)
        sizes = chunking_metrics(rows).first().asDict()
        sizes["elapsed_seconds"] = time.perf_counter() - began
        out.append({"chunker_name": name, "chunking_metrics": sizes, "retrieval_metrics": retrieval_metrics(rows, spans, queries).first().asDict() if corpus.queries else None})
    return out
