"""Documents to sections and chunks.

The sequential scan runs in one Arrow function over the body alone; it returns an array, which is
exploded in the JVM, where ids and hashes are computed. Nothing is shuffled."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import ids, text
from loomtext.functions.batches import small_batches

_SECTION = "array<struct<order_index:int,heading:string,heading_level:int,anchor:string,parent_anchor:string,heading_path:array<string>,lineage:array<string>,content:string>>"
_CHUNK = "array<struct<section:int,section_anchor:string,order_index:int,section_chunk_index:int,content_text:string,char_start:int,char_end:int,token_count:int,heading_path:array<string>,lineage:array<string>,structure_types:array<string>>>"
_WORDS = pa.list_(pa.string())
_SECTION_TYPE = pa.list_(pa.struct([("order_index", pa.int32()), ("heading", pa.string()), ("heading_level", pa.int32()), ("anchor", pa.string()), ("parent_anchor", pa.string()), ("heading_path", _WORDS), ("lineage", _WORDS), ("content", pa.string())]))
_CHUNK_TYPE = pa.list_(pa.struct([("section", pa.int32()), ("section_anchor", pa.string()), ("order_index", pa.int32()), ("section_chunk_index", pa.int32()), ("content_text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("token_count", pa.int32()), ("heading_path", _WORDS), ("lineage", _WORDS), ("structure_types", _WORDS)]))


@dataclass(frozen=True)
class SizeChunker:
    max_chars: int = 1500
    overlap_chars: int = 0
    min_chars: int = 0

    def __post_init__(self) -> None:
        if self.max_chars < 1 or not 0 <= self.overlap_chars < self.max_chars or self.min_chars < 0:
            raise ValueError("max_chars >= 1, 0 <= overlap_chars < max_chars and min_chars >= 0 are needed")

    def pieces(self, content: str) -> list[text.Piece]:
        return text.size_pieces(content, self.max_chars, self.overlap_chars, self.min_chars)


@dataclass(frozen=True)
class TokenChunker:
    max_tokens: int = 512
    overlap_tokens: int = 0
    counter: object = "whitespace"

    def __post_init__(self) -> None:
        if self.max_tokens < 1 or not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("max_tokens >= 1 and 0 <= overlap_tokens < max_tokens are needed")

    def pieces(self, content: str) -> list[text.Piece]:
        return text.token_pieces(content, self.max_tokens, self.overlap_tokens, self.counter)


class ChunkError(ValueError):
    """Stages of chunking in an order that cannot work."""


@dataclass(frozen=True)
class HeadingsOnly:
    """Headings without a further chunker: sections, and no chunks."""

    def pieces(self, content: str) -> list[text.Piece]:
        return []


def composed(stages: list[object]) -> object:
    """The chunker of a list of stages, in which None stands for headings: these come first, once, and one that cuts sections comes after them."""
    if not stages or stages[0] is not None:
        raise ChunkError("a chunker that cuts sections needs sections: headings come first")
    if any(s is None for s in stages[1:]):
        raise ChunkError("there are sections already: headings come once")
    if len(stages) > 2:
        raise ChunkError("there are chunks already: one chunker cuts sections")
    return stages[1] if len(stages) == 2 else HeadingsOnly()


def _sections(body: pa.Array) -> pa.Array:
    return pa.array([[(s.index, s.heading, s.level, s.anchor, s.parent, s.path, s.lineage, s.content) for s in text.sections(b or "")] for b in body.to_pylist()], _SECTION_TYPE)


def sections(docs: DataFrame) -> DataFrame:
    """The sections of `docs` (document_id, source_uri, body)."""
    d = F.col("document_id")
    flat = small_batches(docs).select("document_id", "source_uri", F.explode(F.arrow_udf(_sections, _SECTION)("body")).alias("s"))
    parent = F.when(F.col("s.parent_anchor").isNotNull(), ids.section_id(d, F.col("s.parent_anchor")))
    return flat.select(ids.section_id(d, F.col("s.anchor")).alias("section_id"), "document_id", "source_uri", "s.order_index", parent.alias("parent_id"), "s.heading", "s.heading_level", "s.anchor", ids.content_hash(F.col("s.content")).alias("content_hash"), "s.heading_path", "s.lineage", F.col("s.content").alias("content_markdown"))


def chunks(docs: DataFrame, chunker: SizeChunker | TokenChunker = SizeChunker(), keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """The chunks of `docs`; `keep`: columns of the document to carry along."""

    def split(body: pa.Array) -> pa.Array:
        out = []
        for b in body.to_pylist():
            rows = [(s.index, s.anchor, 0, p.index, p.text, p.start, p.end, p.tokens, s.path, s.lineage, p.kinds) for s in text.sections(b or "") for p in chunker.pieces(s.content)]
            out.append([(*r[:2], i, *r[3:]) for i, r in enumerate(rows)])
        return pa.array(out, _CHUNK_TYPE)

    d = F.col("document_id")
    flat = small_batches(docs).select("document_id", "source_uri", *keep, F.explode(F.arrow_udf(split, _CHUNK)("body")).alias("c"))
    anchor = ids.chunk_anchor(F.col("c.section_anchor"), F.col("c.section_chunk_index"))
    kept = [k for k in keep if isinstance(k, str)]
    named = flat.select("document_id", "source_uri", *kept, anchor.alias("anchor"), "c.*")
    return named.select(ids.chunk_id(d, F.col("anchor")).alias("chunk_id"), "document_id", ids.section_id(d, F.col("section_anchor")).alias("section_id"), "source_uri", *kept, "anchor", "section_anchor", "order_index", "section_chunk_index", ids.content_hash(F.col("content_text")).alias("content_hash"), "content_text", "char_start", "char_end", "token_count", "heading_path", "lineage", "structure_types")
