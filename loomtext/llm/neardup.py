"""Near-duplicate documents by circulant MinHash (operator 3).

A document is the set of its 3-word shingles (words: lower-cased runs of letters and digits;
a text of fewer words is one shingle). Signatures are circulant: one permutation sigma spreads
the shingles over a universe of 2^32 places, and a second one, pi, shifted circularly by k, gives
coordinate k, so two permutations stand for all 160. Places are 4096 blocks of 2^20; the shift is circular
within a block, and pi is computed: the block and the place in it each pick a random number, these are combined by
exclusive or, and the block is appended, so that no two places have one value. The 160 numbers of a place are adjacent in
memory, and a signature is the minimum of such rows.

1. Equal texts are one class (by MD5 of the lower-cased text), stand for it by their least id, and are expanded again at the end, so a text that is
   there a million times costs one signature in the steps that follow.
2. 40 bands of 4 coordinates give buckets: a pair at the threshold of 0.5 shares one with probability
   1 - (1 - 0.5^4)^40 = 0.924. Classes of a bucket are candidates, and every pair that
   counts is verified by its exact Jaccard similarity.
3. Groups are the connected components of the verified pairs. Not all pairs of a bucket need verification for that: first each member is
   compared with the least of its bucket, and then, exactly, members that are not in the bucket's commonest
   component with all members that are in another component than theirs. Pairs left out are already in one group, so groups are those of all
   candidate pairs, whatever the size of a bucket.

What meets by a key is bounded: least members are found by an aggregate (combined before it is shuffled), the sets of a
hub's partners are joined in blocks of BLOCK, and so are the members of a bucket with each other.

Result: doc_id, group_id (the least doc_id of its group), keep (doc_id = group_id) for each
document of a group of two or more.

Defined results: null ids or texts and texts without a word are in no group; rows of one id are
one document, near another if one of its texts is; further columns of the input are ignored by `groups` and kept by `keep_one`, whatever their names;
ids are cast to bigint, and one that is no number is an error; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.graph import components
from loomtext.llm.suffixes import gram_hashes
from loomtext.llm.tables import materialized, small_batches

BLOCK = 2000  #: members of a bucket, or partners of a hub, that meet in one key


@dataclass(frozen=True)
class Params:
    shingle: int = 3  #: words
    bands: int = 40
    rows: int = 4
    threshold: float = 0.5  #: least Jaccard similarity of a pair
    seed: int = 3


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and for each text the index of its first."""
    starts, ends, ptr = W.find_words(buf, off, W.NOT_ALNUM)
    h = W.hash_ranges(buf, starts, ends)
    words = np.diff(ptr)
    n = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    first = np.repeat(ptr[:-1], n) + np.arange(out[-1]) - np.repeat(out[:-1], n)
    grams = gram_hashes(h, size)
    got = grams[np.minimum(first, len(grams) - 1)] if len(grams) else np.zeros(len(first), np.uint64)
    for d in np.flatnonzero((words > 0) & (words < size)):
        x = np.uint64(words[d])
        for w in h[ptr[d] : ptr[d + 1]]:
            x = W.mix(np.array([x]) * W._GOLD + w)[0]
        got[out[d]] = x
    return got, out


_LOW, _HIGH = 20, 12  #: bits of the place in a block, and of the block


@lru_cache(maxsize=2)
def permutations(k: int, seed: int) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """sigma (an odd factor and two shifts of 64 bits, of whose product the leading 32 are the place), the rows of
    pi within a block (row s is pi at s, s+1, ..., s+k-1, circularly), and what a block adds to it."""
    rng = np.random.default_rng(seed)
    low = rng.permutation(1 << _LOW).astype(np.uint32) << np.uint32(_HIGH)
    block = (rng.integers(0, 1 << _LOW, 1 << _HIGH, dtype=np.uint32) << np.uint32(_HIGH)) | np.arange(1 << _HIGH, dtype=np.uint32)
    factor = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
    return factor, np.lib.stride_tricks.sliding_window_view(np.concatenate([low, low[:k]]), k), block


def signatures(x: np.ndarray, ptr: np.ndarray, p: Params) -> np.ndarray:
    """The circulant signature of each set of shingles; without shingles all values are 2^32 - 1."""
    k = p.bands * p.rows
    factor, rows, block = permutations(k, p.seed)
    place = (W.mix(x * factor) >> np.uint64(32)).astype(np.int64)
    low, add = place & ((1 << _LOW) - 1), block[place >> _LOW]
    out = np.full((len(ptr) - 1, k), 0xFFFFFFFF, np.uint32)
    for d in np.flatnonzero(np.diff(ptr)):
        for a in range(ptr[d], ptr[d + 1], 1 << 12):
            b = min(a + (1 << 12), ptr[d + 1])
            got = rows[low[a:b]]
            got ^= add[a:b, None]
            np.minimum(out[d], got.min(axis=0), out=out[d])
    return out


def band_hashes(sig: np.ndarray, p: Params) -> np.ndarray:
    """A hash of each band of each signature; different bands have different hashes."""
    h = np.tile(W.mix(np.arange(1, p.bands + 1, dtype=np.uint64) * W._GOLD), (len(sig), 1))
    for r in range(p.rows):
        h = W.mix(h * W._GOLD ^ sig[:, r :: p.rows].astype(np.uint64))
    return h


def banded(texts: DataFrame, p: Params) -> DataFrame:
    """(doc_id, t, bands): the buckets of each row of `texts` (doc_id, text, t); none without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in W.text_slices(b.column(1)):
                x, ptr = shingles(buf, off, p.shingle)
                some = np.diff(ptr) > 0
                h = band_hashes(signatures(x, ptr, p)[some], p)
                out = np.concatenate([[0], np.cumsum(some * p.bands)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), W.int_lists(h.ravel().view(np.int64), out, pa.int64())], ["doc_id", "t", "bands"])

    return texts.mapInArrow(run, "doc_id bigint, t string, bands array<bigint>")


def shingle_sets(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, s): distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in W.text_slices(b.column(1)):
                x, ptr = shingles(buf, off, p.shingle)
                sets = [np.unique(x[a:c]) for a, c in zip(ptr[:-1], ptr[1:], strict=True)]
                out = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), W.int_lists(np.concatenate(sets).view(np.int64), out, pa.int64())], ["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id bigint, s array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b), all different, whose exact Jaccard similarity reaches the threshold. A hub a with many partners meets them in blocks."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    pairs = pairs.join(blocks, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).alias("block"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    hubs = pairs.select("a", "block").distinct()
    left = hubs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    fits = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * p.threshold
    found = pairs.join(right, "b").join(left, ["a", "block"]).filter(fits)
    return found.filter(both >= (F.size("sa") + F.size("sb") - both) * p.threshold).select("a", "b")


def cross_pairs(members: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of `members` (h, doc_id) in one bucket and in different components of which one at least is
    not the commonest of the bucket; `label` (v, m) gives the components."""
    joined = members.join(label, members.doc_id == label.v, "left").select("h", "doc_id", F.coalesce("m", "doc_id").alias("c"))
    sizes = joined.groupBy("h", "c").agg(F.count("*").alias("n"))
    split = sizes.groupBy("h").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1").select("h", "most", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    split = materialized(joined.join(split, "h"), "split-buckets")
    own, each = F.pmod(F.xxhash64("doc_id"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = split.filter("c <> most").select("h", own.alias("i"), each.alias("j"), F.col("doc_id").alias("x"), F.col("c").alias("cx"))
    y = split.select("h", each.alias("i"), own.alias("j"), F.col("doc_id").alias("y"), F.col("c").alias("cy"))
    return x.join(y, ["h", "i", "j"]).filter("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, group_id, keep) of all documents in groups of two or more: see the module."""
    p = params
    slim = small_batches(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    slim = slim.withColumn("t", F.md5("text"))
    classes = banded(slim.select("doc_id", "text", "t"), p).filter("size(bands) > 0").groupBy("t").agg(F.min(F.struct("doc_id", "bands")).alias("x"), F.max("doc_id").alias("hi"))
    classes = materialized(classes.select("t", F.col("x.doc_id").alias("rep"), "hi", F.col("x.bands").alias("bands")), "classes")
    inside = classes.select(F.explode(F.array_distinct("bands")).alias("h"), F.col("rep").alias("doc_id"))
    shared = inside.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("h", "least")
    members = materialized(inside.join(shared, "h").distinct(), "buckets")
    some = members.select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id"), "t"), "doc_id")  # an id with several texts may stand for several classes
    sets = materialized(shingle_sets(slim.join(some, ["doc_id", "t"], "left_semi").select("doc_id", "text"), p).distinct(), "shingles")
    stars = materialized(members.filter("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    # an id with several texts ties their classes
    ties = slim.select("doc_id", "t").join(classes.select("t", "rep"), "t").groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1").select(F.col("doc_id").alias("a"), F.explode("reps").alias("b")).filter("a <> b")
    edges = materialized(verified(stars, sets, p).distinct().union(ties), "verified")
    label = components(edges)
    rest = cross_pairs(members.select("h", "doc_id"), label).join(stars, ["a", "b"], "left_anti")
    more = materialized(verified(rest, sets, p).distinct(), "verified")
    if not more.isEmpty():
        label = components(edges.union(more))
    heads = label.select(F.col("m").alias("head")).distinct()
    known = classes.select("t", "rep", "hi").join(label, classes.rep == label.v, "left").join(heads, F.col("rep") == F.col("head"), "left")
    known = known.filter("rep < hi OR m IS NOT NULL OR head IS NOT NULL").select("t", F.coalesce("m", "rep").alias("group_id"))
    found = slim.select("doc_id", "t").join(known, "t").select("doc_id", "group_id").distinct()
    return found.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of `docs` without the near copies: of each group the document with the least id stays,
    and of rows with equal id and text one. Rows without an id or a text stay."""
    drop = groups(docs, params).filter("NOT keep").select(F.col("doc_id").alias("dropped"))
    row = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so no name can clash
    left = row.join(drop, F.col("id") == F.col("dropped"), "left_anti")
    copy = F.row_number().over(Window.partitionBy("id", F.xxhash64("row.text")).orderBy(F.lit(1)))
    marked = left.withColumn("copy", copy).filter("copy = 1 OR row.text IS NULL OR id IS NULL")
    return marked.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
