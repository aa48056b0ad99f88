"""Language identification with language-bitmask n-gram filters (operator 10).

Training keeps, for each language, the byte n-grams that are typical of it: those in at
least `min_docs` of its sampled documents (in all of them, where there are fewer), and not much rarer there than in the language
that has them most. All languages share one bit-sliced Bloom filter: row r is a bit mask
with one bit per language, in as many words of 64 bits as that takes, and the AND of an n-gram's k rows is the set of all languages
that (seem to) contain it, so one look-up answers for every language. A document's n-grams
are looked up in bulk; the popcounts per language are corrected for the filter's
false-positive rate, and the language with the largest corrected share is chosen.

Defined results: a null or empty text, and one shorter than an n-gram, has language "und"
and score 0; ties go to the first language in alphabetical order; rows are independent,
so repeated rows each get their row, and further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.tables import small_batches

SCHEMA = "doc_id bigint, language string, score double, margin double, n_grams bigint"


@dataclass(frozen=True)
class Params:
    n: int = 5  #: bytes in an n-gram
    hashes: int = 2  #: rows that are combined for an n-gram
    sample_docs: int = 2000  #: bound on the training documents of a language, by hash of the id
    min_docs: int = 2  #: training documents of the language that must hold an n-gram
    ratio: float = 0.2  #: share of the documents with the n-gram, against the language that has it most
    bits_per_gram: int = 12
    min_score: float = 0.2  #: below it the language is "und"
    seed: int = 11


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    rows: np.ndarray  #: uint64 masks, (slices of 64 languages, a power of two)
    false_rate: np.ndarray  #: for each language
    params: Params


def grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte n-grams that lie within one text, and for each text the index of its first."""
    buf = np.where(W.BLANK[buf], np.uint8(32), buf)
    size = np.maximum(off[1:] - off[:-1] - (n - 1), 0)
    ptr = np.zeros(len(off), np.int64)
    np.cumsum(size, out=ptr[1:])
    view = W.loads(buf)[: len(buf)]
    ok = np.ones(len(buf), bool)
    for back in range(1, n):
        at = off[1:] - back
        ok[at[at >= off[:-1]]] = False
    return W.mix(view[ok] & W._MASKS[n]), ptr


def _row(h: np.ndarray, j: int, m: int) -> np.ndarray:
    """Double hashing; m is a power of two."""
    return (((h >> np.uint64(32)) + np.uint64(j) * ((h & np.uint64(0xFFFFFFFF)) | np.uint64(1))) & np.uint64(m - 1)).astype(np.int64)


def build(languages: list[str], gram: np.ndarray, lang: np.ndarray, p: Params) -> Filters:
    """Filters over the given (n-gram hash, language number) pairs."""
    most = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
    m = 1 << max(10, int(np.ceil(np.log2(max(1, most * p.bits_per_gram)))))
    rows = np.zeros((max(1, -(-len(languages) // 64)), m), np.uint64)
    bit = np.uint64(1) << (lang % 64).astype(np.uint64)
    for s in range(len(rows)):
        own = lang // 64 == s
        for j in range(p.hashes):
            np.bitwise_or.at(rows[s], _row(gram[own], j, m), bit[own])
    fill = np.array([float(((rows[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return Filters(tuple(languages), rows, fill**p.hashes, p)


def train(docs: DataFrame, params: Params = Params()) -> Filters:
    """Fits the filters on a bounded sample of the rows of `docs` (doc_id, text, lang) that have a language."""
    p = params
    known = small_batches(docs).filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    total = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(total)
    if not languages:
        return build([], np.zeros(0, np.uint64), np.zeros(0, np.int64), p)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(p.sample_docs / total[k]))])
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(draw < share[F.col("lang")]).select(number[F.col("lang")].alias("l"), F.lower("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for i, j, buf, off in W.text_slices(b.column(1)):
                g, ptr = grams(buf, off, p.n)
                d = np.repeat(np.arange(j - i), np.diff(ptr))
                order = np.lexsort((g, d))
                g, d = g[order], d[order]
                first = np.ones(len(g), bool)
                first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
                g, own = g[first], lang[i:j][d[first]]
                order = np.lexsort((g, own))
                g, own = g[order], own[order]
                at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])])) if len(g) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(own[at].astype(np.int32)), pa.array(g[at].view(np.int64)), pa.array(n)], ["l", "g", "n"])

    size = {r["l"]: r["n"] for r in sample.groupBy("l").agg(F.count("*").alias("n")).collect()}
    per = F.create_map(*[x for i in range(len(languages)) for x in (F.lit(i), F.lit(float(size.get(i, 1))))])
    found = sample.mapInArrow(count, "l int, g bigint, n bigint").groupBy("g", "l").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.least(F.lit(float(p.min_docs)), per[F.col("l")]))
    found = found.select("g", "l", (F.col("n") / per[F.col("l")]).alias("share")).groupBy("g").agg(F.collect_list(F.struct("l", "share")).alias("x"), F.max("share").alias("most"))
    found = found.select("g", F.explode(F.filter("x", lambda s: s["share"] >= F.col("most") * p.ratio)).alias("s")).select("g", "s.l")
    got = found.toArrow()
    return build(languages, got.column("g").to_numpy().view(np.uint64), got.column("l").to_numpy().astype(np.int64), p)


def score_batch(f: Filters, arr: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, margin, n-grams) of lower-cased texts."""
    count, k, m = len(arr), len(f.languages), f.rows.shape[1]
    share, total = np.zeros((count, max(k, 1))), np.zeros(count, np.int64)
    for i, j, buf, off in W.text_slices(arr):
        g, ptr = grams(buf, off, f.params.n)
        at = [_row(g, t, m) for t in range(f.params.hashes)]
        n = np.diff(ptr)
        total[i:j] = n
        some = n > 0
        for x in range(k):
            if x % 64 == 0:  # the next slice
                mask = np.full(len(g), np.uint64(0xFFFFFFFFFFFFFFFF))
                for place in at:
                    mask &= f.rows[x // 64][place]
            bits = ((mask >> np.uint64(x % 64)) & np.uint64(1)).astype(np.uint8)
            hits = np.zeros(j - i)
            if len(bits):
                hits[some] = np.add.reduceat(bits, ptr[:-1][some], dtype=np.int64)
            share[i:j, x] = np.where(some, (hits / np.maximum(n, 1) - f.false_rate[x]) / (1 - min(f.false_rate[x], 0.999999)), 0)
    best = share.argmax(axis=1)
    top = share[np.arange(count), best] if count else np.zeros(0)
    second = np.sort(share, axis=1)[:, -2] if k > 1 else np.zeros(count)
    ok = (total > 0) & (top >= f.params.min_score) & (k > 0)
    names = [f.languages[b] if o else "und" for b, o in zip(best, ok, strict=True)]
    return names, np.where(total > 0, np.maximum(top, 0), 0.0), np.where(total > 0, np.maximum(top - np.maximum(second, 0), 0), 0.0), total


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): see SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            names, score, margin, total = score_batch(f, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(margin), pa.array(total)], ["doc_id", "language", "score", "margin", "n_grams"])

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, SCHEMA)
