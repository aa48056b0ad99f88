"""Exact top-k documents for each query text by no-random-access aggregation (operator 2).

Queries are the rows of one table and documents those of another; every row of the former is a
query. A word (lower-cased run of letters and digits) of the query that a document holds f times
gives it the integer impact floor(1000 * ln(1 + N / df) * f * 2.2 / (f + 1.2)), and a score is the
sum over the distinct words of the query.

The documents are searched where they are: each task builds, for its share of them, one list per
query word, sorted by impact, and answers every query from its lists by sequential reading only.
All lists of a query are read in step, in blocks of growing size. A document that was seen has a
lower bound (the impacts read so far) and an upper one (plus the last impact read from each list
in which it was not yet seen); one that was not seen is bounded by the sum of the last impacts.
Reading stops when no outsider can reach the k-th lower bound. The rests of the lists are then
scanned for the remaining candidates, to resolve their scores, never for single documents. The
best k of each task meet in one small shuffle; a global best k is among them, so the result is exact.

Result: query_id, rank (from 1), doc_id, score. Ties are ordered by doc_id.

Defined results: documents that hold no word of a query are never results, so a query may have
fewer than k rows, or none if it is null or empty; documents with null ids or texts are left out;
every row is a document, so repeated rows take a rank each; rows of one query id are one query with
the words of all of them; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.tables import small_batches
from loomtext.llm.toxicity import Lexicon, _doc_words, hash_words

K = 10
FIRST_BLOCK = 32  #: entries that are read from each list before bounds are first compared
PORTION_BYTES = 16 << 20  #: text of the queries that are answered in one pass
SCHEMA = "query_id bigint, doc_id bigint, score bigint"


@dataclass(frozen=True)
class Queries:
    ids: np.ndarray
    vocabulary: Lexicon  #: all words of all queries
    terms: list[np.ndarray]  #: places in the vocabulary, for each query
    idf: np.ndarray
    k: int


def impacts(idf: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.floor(1000.0 * idf * f * 2.2 / (f + 1.2)).astype(np.int64)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best k of `docs` documents (numbers, scores), best first. lists: for each word the numbers
    of its documents and their impacts, by falling impact. tie: the order of documents of equal score."""
    lists = [x for x in lists if len(x[0])]
    m = len(lists)
    if not m or k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = np.zeros(docs, np.int64)
    seen = np.zeros((docs, m), bool)
    read, block = [0] * m, FIRST_BLOCK
    while True:
        last = np.zeros(m, np.int64)
        for i, (d, s) in enumerate(lists):
            part = slice(read[i], read[i] + block)
            lower[d[part]] += s[part]  # a document is once in a list
            seen[d[part], i] = True
            read[i] = min(len(d), read[i] + block)
            if read[i] < len(d):
                last[i] = s[read[i] - 1]
        known = np.flatnonzero(lower)
        kth = np.partition(lower[known], len(known) - k)[len(known) - k] if len(known) >= k else 0
        rest = last.sum()
        if rest == 0 or rest < kth:  # nothing unseen can be a result
            upper = lower[known] + rest - seen[known] @ last
            close = known[upper >= kth]
            if rest == 0 or len(close) <= 4 * k:
                break
        block *= 2
    # resolve the candidates from the rests of the lists, in sequence
    open_ = np.zeros(docs, bool)
    open_[close] = True
    for i, (d, s) in enumerate(lists):
        d, s = d[read[i] :], s[read[i] :]
        mine = open_[d]
        lower[d[mine]] += s[mine]
    order = np.lexsort((tie[close], -lower[close]))[:k]
    return close[order], lower[close][order]


def read_queries(queries: DataFrame) -> tuple[np.ndarray, list[list[str]]]:
    rows = queries.select(F.col(queries.columns[0]).cast("bigint").alias("id"), F.lower(queries.columns[1]).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").collect()
    words: dict[int, set[str]] = {}
    for r in rows:
        buf, off = W.buffers(pa.array([r["text"]], pa.string()))
        starts, ends, _ = W.find_words(buf, off, W.NOT_ALNUM)
        raw = buf.tobytes()
        words.setdefault(r["id"], set()).update(raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.array(list(words), np.int64), [sorted(w) for w in words.values()]


def matches(lex: Lexicon, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: rows, and (text, word, occurrences) of the words of the vocabulary."""
    for i, j, buf, off in W.text_slices(texts):
        d, h, _, _ = _doc_words(buf, off)
        at = lex.lookup(h)
        code, f = np.unique(d[at >= 0] * max(1, len(lex.hashes)) + at[at >= 0], return_counts=True)
        yield i, j, code // max(1, len(lex.hashes)), code % max(1, len(lex.hashes)), f


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The best `k` rows of `docs` (doc_id, text) for each row of `queries` (id, text, in that order).

    The queries are collected and broadcast: they are the small side by nature. Their size is looked at first, and a
    larger table of queries is answered in portions of about PORTION_BYTES, by hash of the id, one pass each."""
    size = queries.agg(F.sum(F.octet_length(F.col(queries.columns[1]).cast("string")))).first()[0] or 0
    n = max(1, -(-size // PORTION_BYTES))
    part = F.pmod(F.xxhash64(F.col(queries.columns[0]).cast("bigint")), F.lit(n))
    slim = small_batches(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    found = [_portion(slim, *read_queries(queries.filter(part == i) if n > 1 else queries), k) for i in range(n)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


def _portion(slim: DataFrame, ids: np.ndarray, words: list[list[str]], k: int) -> DataFrame:
    spark = slim.sparkSession
    names = sorted({w for q in words for w in q})
    h = hash_words(names)
    order = np.argsort(h)
    vocabulary = Lexicon((), h[order], np.zeros(len(h)), 0.0)
    place = {names[o]: i for i, o in enumerate(order)}
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        n, total = np.zeros(len(lex.hashes), np.int64), 0
        for b in batches:
            total += b.num_rows
            for _, _, _, at, _ in matches(lex, b.column(0)):
                n += np.bincount(at, minlength=len(n))
        t = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1)), pa.array(np.append(n[t], total))], ["t", "n"])

    got = slim.select("text").mapInArrow(frequencies, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(h))
    t, n = got.column("t").to_numpy(), got.column("n").to_numpy()
    total = float(n[t < 0].sum())
    df[t[t >= 0]] = n[t >= 0]
    idf = np.log(1.0 + total / np.maximum(df, 1))
    whole = spark.sparkContext.broadcast(Queries(ids, vocabulary, [np.array([place[w] for w in q], np.int64) for q in words], idf, k))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = whole.value
        doc, word, score, names_, base = [], [], [], [], 0

        def answer() -> Iterator[pa.RecordBatch]:
            d, w, s = (np.concatenate(x) for x in (doc, word, score))
            own = np.concatenate(names_)
            by = np.lexsort((own[d], -s, w))
            d, w, s = d[by], w[by], s[by]
            ptr = np.searchsorted(w, np.arange(len(q.idf) + 1))
            found = []
            for i, terms in enumerate(q.terms):
                best, got_ = nra([(d[ptr[x] : ptr[x + 1]], s[ptr[x] : ptr[x + 1]]) for x in terms], len(own), q.k, own)
                found.append((np.full(len(best), q.ids[i]), own[best], got_))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "doc_id", "score"])

        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, d, at, f in matches(q.vocabulary, b.column(1)):
                doc.append(d + base)
                word.append(at)
                score.append(impacts(q.idf[at], f))
                names_.append(own[i:j])
                base += j - i
            if base >= 20_000:  # bounds the lists that a task holds; the best of the best are the best
                yield from answer()
                doc, word, score, names_, base = [], [], [], [], 0
        if base:
            yield from answer()

    return slim.mapInArrow(search, SCHEMA)
