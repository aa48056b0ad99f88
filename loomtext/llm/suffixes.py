"""Suffix-array deduplication of passages (operator 1).

Finds every passage of at least `length` words (runs of non-blank characters) that stands at
two or more places of the corpus, in different documents or in one. A suffix is the text from a word on; as in other work on exact
substring deduplication only its first `length` words matter. It is sorted, exchanged and compared as the string of these words, joined by single blanks, as
symbols of eight bytes: the first PREFIX bytes as text and, of a longer one, 128 bits of a fingerprint of all its words for the rest, on which equality of what is behind the
prefix rests. (Exchanging the whole strings gives the same rows and was measured: it takes five times the input in the shuffle.)

1. Suffixes that cannot repeat are left out, exactly, as distributed string sorting leaves out what no other string shares (duplicate detection by hashes, before strings are sent): two suffixes with the same words have the
   same minimizer (the k-word gram in them of least hash, the first of such) at the same place, so those whose minimizer stands
   at one place only are unique. Runs of positions with one minimizer travel as one row; places are counted by an aggregate, however many there are.
2. Each task sorts its suffixes into runs of bounded size, collapses equal ones, and cuts a run at sampled
   splitters (of any length) into blocks, which are exchanged front-coded: a suffix is the number of symbols it
   shares with its predecessor and the symbols after them. With a suffix go its least and greatest place of the run, not all: where
   these are in different documents the other places are known to be repeats and go their own way, so a passage that a third of all documents hold
   is a few numbers for each run.
3. The runs of a range are merged by a loser tree that keeps, with each loser, the length of its
   common prefix with the last winner: prefixes of different length decide without looking at
   any symbol, and with equal ones comparison starts behind the prefix. Many such trees,
   one for each subrange of the sorted order, are stepped together in numpy. A tree has a leaf for each run, and runs grow with the corpus: a range of
   more than TREE_RUNS is sorted anew, symbol by symbol, in a time that depends on its suffixes alone. Blocks are coded and decoded many at a time for the same reason.
4. Equal suffixes are neighbours then; their places go back to their documents, where
   adjacent ones join into passages.

Splitters are broadcast; there are at most RANGES of them, some bytes each. Up to RANGES * RANGE_SUFFIXES candidate suffixes (some 80 TB of text)
a range has about RANGE_SUFFIXES, beyond it ranges grow.

Result, one row for each maximal passage of a document that is covered by repeated suffixes:
doc_id, word_start, word_end (exclusive, counted in words), windows (suffixes in it),
first_windows (those of them that are the first of their kind, by doc_id and position; a passage
with first_windows = windows is where the others were copied from) and cross_windows (those that another document has as well; the others repeat within this document only).

Defined results: null ids or texts and texts shorter than `length` words give nothing; repeated
rows of one id are one document, and no repetition; ids are cast to bigint, and one that is no number is an error;
further columns of the input are ignored; an empty table gives an empty result. The order of repeated passages has no ties: equal
suffixes are ordered by (doc_id, position).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.tables import materialized, small_batches

LENGTH = 50
PREFIX = 64  #: bytes of a suffix that are exchanged as text
WIDTH = PREFIX + 16
RUN_SUFFIXES = 400_000  #: suffixes in a run; bounds a task's memory
RANGE_SUFFIXES = 300_000  #: suffixes aimed at for a range of the merge
TREE_RUNS = 8  #: runs that loser trees merge, at most
CODED = 20_000  #: suffixes that are coded at once, in one block or more
RANGES = 200_000
SAMPLE = 24  #: suffixes for each range that splitters are taken from, while ranges are few
SCHEMA = "doc_id bigint, word_start bigint, word_end bigint, windows bigint, first_windows bigint, cross_windows bigint"
LEAD, CROSS = 1, 2  #: in the code of a place: position << 2, the first of its kind, in several documents

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, by differences of a polynomial modulo 2^64."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * np.cumprod(power, dtype=np.uint64), out=total[1:])
    power[1:] = _INVERSE
    return W.mix((total[k:] - total[:-k]) * np.cumprod(power, dtype=np.uint64)[: n - k + 1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[size - span : size - span + n])


def minimizer_runs(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first position, positions, minimizer, its place) of each run of positions with one minimizer."""
    starts, ends, ptr = W.find_words(buf, off)
    k = max(1, length // 2)
    g = gram_hashes(W.hash_ranges(buf, starts, ends), k)
    # the leading half of a hash orders grams, and then their place; the whole hash is compared between documents
    least = sliding_min((g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64), length - k + 1)
    n = np.maximum(np.diff(ptr) - length + 1, 0)
    d = np.repeat(np.arange(len(n)), n)
    p = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
    at = (least[ptr[:-1][d] + p] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(d) else np.zeros(0, np.int64)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1])
    head = np.flatnonzero(new)
    d, at = d[head], at[head]
    return d, p[head], np.diff(np.append(head, len(new))), g[at], at - ptr[:-1][d]


def candidates(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, p, n: first positions and lengths of the runs of suffixes that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in W.text_slices(b.column(1)):
                d, p, n, m, at = minimizer_runs(buf, off, length)
                ids = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(ids[d]), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], ["h", "doc_id", "p", "n", "at"])

    runs = docs.mapInArrow(run, "h bigint, doc_id bigint, p int, n int, at int")
    places = runs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("at").alias("first"), F.max("at").alias("last"))
    shared = places.filter("lo < hi OR first < last").select("h")
    runs = runs.select("h", "doc_id", "p", "n").join(shared, "h")
    return runs.groupBy("doc_id").agg(F.collect_set(F.struct("p", "n")).alias("r")).select("doc_id", F.col("r.p").alias("p"), F.col("r.n").alias("n"))


def expand(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of runs (first, count)."""
    at = np.cumsum(n) - n
    return np.repeat(p - at, n) + np.arange(int(n.sum()))


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a single blank behind each, and where each begins. All bytes are one greater than in the text, in which no 255
    can stand, so that 0 can end a string."""
    size = ends - starts + 1
    place = np.cumsum(size) - size
    text = buf[np.minimum(np.repeat(starts - place, size) + np.arange(int(size.sum())), max(len(buf) - 1, 0))] + np.uint8(1)
    text[place + size - 1] = 33
    return text, place


def suffix_strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of WIDTH bytes, their sizes): the strings of the suffixes of `length` words that begin at the given words. No byte of the text is 0."""
    text, place = joined_words(buf, starts, ends)
    first = place[word]
    size = place[word + length - 1] + (ends - starts)[word + length - 1] - first if len(word) else np.zeros(0, np.int64)
    k = np.arange(PREFIX)
    rows = np.zeros((len(word), WIDTH), np.uint8)
    if len(word):
        rows[:, :PREFIX] = np.where(k < size[:, None], text[np.minimum(first[:, None] + k, len(text) - 1)], np.uint8(0))
        long = size > PREFIX
        for t in range(2):
            mark = gram_hashes(W.hash_ranges(buf, starts, ends, seed=7 + t), length)[word]
            rows[:, PREFIX + 8 * t : PREFIX + 8 * t + 8] = np.where(long, mark, np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8)
        size = np.where(long, WIDTH, size)
    return rows, size


def sort_strings(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, symbols shared with the one before) of the strings text[start : start + size]; equal strings share all, that is size // 8 + 1."""
    view = W.loads(np.concatenate([text, np.zeros(8, np.uint8)])).view(">u8")
    whole = np.uint64(0xFFFFFFFFFFFFFFFF)

    def symbol(which: np.ndarray, k: int) -> np.ndarray:
        left = size[which] - 8 * k
        short = np.clip(64 - 8 * left, 0, 63).astype(np.uint64)
        got = view[np.minimum(start[which] + 8 * k, len(view) - 1)].astype(np.uint64) & (whole << short)
        return np.where(left > 0, got, np.uint64(0))

    return sort_symbols(symbol, size // 8 + 1)


def sort_symbols(symbol: Callable[[np.ndarray, int], np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, symbols shared with the one before) of strings of `size` symbols; symbol(which, k) gives the k-th of some. Equal ones keep their order."""
    first = symbol(np.arange(len(size)), 0)
    order = np.argsort(first, kind="stable")
    shared = np.zeros(len(size), np.int64)
    value = first[order]
    place = np.arange(len(size))
    group = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]])[: len(value)])
    k = 0
    while len(place):
        k += 1
        alone = np.bincount(group)[group] == 1
        ended = size[order[place]] <= k
        again = np.zeros(len(place), bool)
        again[1:] = group[1:] == group[:-1]
        same = ended & again
        shared[place[same]] = k  # all of its symbols
        keep = ~alone & ~ended
        place, group = place[keep], group[keep]
        if not len(place):
            break
        value = symbol(order[place], k)
        now = np.lexsort((value, group))
        order[place] = order[place][now]
        value = value[now]
        apart = np.ones(len(place), bool)
        apart[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        within = np.zeros(len(place), bool)
        within[1:] = group[1:] == group[:-1]
        shared[place[apart & within]] = k
        group = np.cumsum(apart) - 1
    return order, shared


class Run:
    """Suffixes of some documents."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, ids: np.ndarray, texts: pa.Array, p: pa.Array, n: pa.Array) -> Iterator[None]:
        """Takes the suffixes at the given positions; gives way whenever the run is full."""
        p_flat, n_flat = p.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        p_ptr = np.concatenate([[0], np.cumsum(p.value_lengths().to_numpy(zero_copy_only=False))])
        for i, j, buf, off in W.text_slices(texts):
            starts, ends, ptr = W.find_words(buf, off)
            if not len(starts):
                continue
            lo, hi = p_ptr[i], p_ptr[j]
            d = np.repeat(np.repeat(np.arange(j - i), np.diff(p_ptr[i : j + 1])), n_flat[lo:hi])
            at = expand(p_flat[lo:hi], n_flat[lo:hi])
            ok = at + self.length <= (ptr[1:] - ptr[:-1])[d]
            d, at = d[ok], at[ok]
            word = ptr[:-1][d] + at
            for a in range(0, len(word), max(1, RUN_SUFFIXES // 2)):
                z = slice(a, a + max(1, RUN_SUFFIXES // 2))
                self.parts.append((*suffix_strings(buf, starts, ends, word[z], self.length), ids[i:j][d[z]], at[z]))
                self.n += len(word[z])
                if self.n >= RUN_SUFFIXES:
                    yield

    def blocks(self, splitters: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(range, front-coded block) of the sorted run; range -1: places that are known to be repeats."""
        if not self.n:
            return
        rows, size, ids, pos = (np.concatenate([x[i] for x in self.parts]) for i in range(4))
        self.clear()
        text, start = rows.ravel(), WIDTH * np.arange(len(rows))
        order, shared = sort_strings(text, start, size)
        start, size, ids, pos = start[order], size[order], ids[order], pos[order]
        symbols = size // 8 + 1
        head = np.flatnonzero(shared < symbols)
        key = np.cumsum(shared < symbols) - 1
        order = np.lexsort((pos, ids, key))
        ids, pos = ids[order], pos[order]  # key is in order already
        new = np.ones(len(ids), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])
        key, ids, pos = key[new], ids[new], pos[new]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        last = np.append(edge[1:], len(key)) - 1
        across = ids[edge] < ids[last]
        keep = ~across[key]
        keep[edge] = keep[last] = True
        if not keep.all():
            yield -1, encode_places(ids[~keep], pos[~keep] << 2 | CROSS)
        key, ids, pos = key[keep], ids[keep], pos[keep]
        first = np.searchsorted(key, np.arange(len(head) + 1))
        start, size, shared = start[head], size[head], shared[head]
        raw = text.tobytes()
        cut = []
        for s in splitters:  # the first suffix that is not less
            lo, hi = cut[-1] if cut else 0, len(head)
            while lo < hi:
                m = (lo + hi) // 2
                lo, hi = (m + 1, hi) if raw[start[m] : start[m] + min(size[m], len(s))] < s else (lo, m)
            cut.append(lo)
        edges = np.array([0, *cut, len(head)])
        full = np.flatnonzero(np.diff(edges))
        edges = np.append(edges[full], len(head))
        k = 0
        while k < len(full):  # as many blocks at once as have CODED suffixes, or one
            to = max(k + 1, int(np.searchsorted(edges, edges[k] + CODED, side="right")) - 1)
            a, b = edges[k], edges[to]
            z = slice(first[a], first[b])
            yield from zip(full[k:to].tolist(), encode_blocks(text, start[a:b], size[a:b], shared[a:b], np.diff(first[a : b + 1]), ids[z], pos[z], edges[k : to + 1] - a), strict=True)
            k = to


_PLANES = lambda x: x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()  # noqa: E731 - neighbours have their high bytes in common


def _packed(parts: list[np.ndarray], sizes: list[int]) -> bytes:
    return _compressed(np.array(sizes, np.int64).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in parts))


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=23, enable_ldm=True)).compress(data)


class _Unpacked:
    def __init__(self, data: bytes, sizes: int) -> None:
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.at = 8 * sizes
        self.sizes = [int(x) for x in self.raw[: self.at].view(np.int64)]

    def take(self, n: int) -> np.ndarray:
        self.at += n
        return self.raw[self.at - n : self.at]

    def planes(self, n: int) -> np.ndarray:
        return np.ascontiguousarray(self.take(4 * n).reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def encode_places(ids: np.ndarray, code: np.ndarray) -> bytes:
    known, own = np.unique(ids, return_inverse=True)
    order = np.lexsort((code, own))
    return _packed([known.view(np.uint8), _PLANES(own[order]), code[order].astype(np.int64).view(np.uint8)], [len(known), len(ids)])


def decode_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    u = _Unpacked(data, 2)
    docs, n = u.sizes
    known = np.frombuffer(u.take(8 * docs).tobytes(), np.int64)
    return known[u.planes(n)], np.frombuffer(u.take(8 * n).tobytes(), np.int64)


def encode_block(text: np.ndarray, start: np.ndarray, size: np.ndarray, shared: np.ndarray, count: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> bytes:
    return next(encode_blocks(text, start, size, shared, count, ids, pos, np.array([0, len(start)])))


_SMALL = 1 << 16  #: bytes of a block for which long distance matching is not worth its tables


def encode_blocks(text: np.ndarray, start: np.ndarray, size: np.ndarray, shared: np.ndarray, count: np.ndarray, ids: np.ndarray, pos: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
    """Front coding: for each suffix the symbols it shares with its predecessor in the block, the number of the others, and these; and its places.
    Block k has the suffixes from edges[k] to edges[k + 1]; none is empty."""
    shared = shared.copy()
    shared[edges[:-1]] = 0
    own = size // 8 + 1 - shared
    n = 8 * own
    at = np.repeat(start + 8 * shared - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    tail = np.where(at < np.repeat(start + size, n), text[np.minimum(at, len(text) - 1)], np.uint8(0))
    tail_at = np.concatenate([[0], np.cumsum(n)])[edges].tolist()
    place_at = np.concatenate([[0], np.cumsum(count)])[edges]
    block = np.repeat(np.arange(len(edges) - 1), np.diff(place_at))
    order = np.lexsort((ids, block))
    new = np.ones(len(ids), bool)
    new[1:] = (block[order][1:] != block[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    known = ids[order[new]].astype(np.int64)
    known_at = np.concatenate([[0], np.cumsum(np.bincount(block[order[new]], minlength=len(edges) - 1))])
    doc = np.empty(len(ids), np.int64)
    doc[order] = np.cumsum(new) - 1
    doc -= known_at[block]
    planes = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T) for x in (shared, own, count, doc, pos)]
    edges, place_at, known_at = edges.tolist(), place_at.tolist(), known_at.tolist()
    small = zstandard.ZstdCompressor(level=3)
    for k in range(len(edges) - 1):
        a, b, t, u, p, q, d, e = *edges[k : k + 2], *tail_at[k : k + 2], *place_at[k : k + 2], *known_at[k : k + 2]
        s, o, c = (x[:, a:b].tobytes() for x in planes[:3])
        i, j = (x[:, p:q].tobytes() for x in planes[3:])
        data = b"".join([struct.pack("<4q", b - a, u - t, e - d, q - p), s, o, tail[t:u].tobytes(), c, known[d:e].tobytes(), i, j])
        yield small.compress(data) if len(data) < _SMALL else _compressed(data)


Keys = tuple[np.ndarray, np.ndarray, np.ndarray]  #: all symbols; for each string where its own begin and how many there are


def decode_block(data: bytes) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, symbols shared with the predecessor, number of places, their documents and positions)."""
    return decode_blocks([data])


def decode_blocks(blocks: list[bytes]) -> tuple[Keys, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of several blocks, one behind the other; the first of a block shares nothing with its predecessor."""
    unpack = zstandard.ZstdDecompressor()
    parts: list[list[bytes]] = [[] for _ in range(22)]  # five numbers in four planes each, then symbols and documents
    docs, places = [], []
    for block in blocks:
        raw = unpack.decompress(block)
        n, tail, known, total = struct.unpack_from("<4q", raw)
        at = 32
        for k, size in ((0, n), (4, n), (20, tail), (8, n), (21, 8 * known), (12, total), (16, total)):
            for plane in range(4 if k < 20 else 1):
                parts[k + plane].append(raw[at : at + size])
                at += size
        docs.append(known)
        places.append(total)

    def number(k: int) -> np.ndarray:
        return sum(np.frombuffer(b"".join(parts[k + plane]), np.uint8).astype(np.int64) << (8 * plane) for plane in range(4))

    shared, own = number(0), number(4)
    given = np.frombuffer(b"".join(parts[20]), ">u8").astype(np.uint64)
    size = shared + own
    first, source = np.cumsum(size) - size, np.cumsum(own) - own - shared
    out = np.empty(int(size.sum()), np.uint64)
    rows, k = np.arange(len(size)), 0
    while len(rows):  # symbol k of all strings that have one: its own, or that of the last one before that has its own
        mine = shared[rows] <= k
        last = np.maximum.accumulate(np.where(mine, np.arange(len(rows)), 0))
        out[first[rows] + k] = given[source[rows[last]] + k]
        k += 1
        rows = rows[size[rows] > k]
    known = np.frombuffer(b"".join(parts[21]), np.int64)
    doc = number(12) + np.repeat(np.cumsum(docs) - docs, places)
    return (out, first, size), shared, number(8), known[doc], number(16)


def merge(runs: list[tuple[Keys, np.ndarray]], spacing: int = 96) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs of distinct strings, each (keys, symbols shared with the predecessor in the run).
    Returns places in the concatenated runs, in sorted order, for each its common prefix, in
    symbols, with the one before, and whether it is the same string. Equal strings come in order of run."""
    base = np.concatenate([[0], np.cumsum([len(k[1]) for k, _ in runs])])
    shift = np.concatenate([[0], np.cumsum([len(k[0]) for k, _ in runs])])
    step_ = 4  #: symbols compared at once
    flat = np.concatenate([*(k[0] for k, _ in runs), np.zeros(step_, np.uint64)])
    first = np.concatenate([k[1] + s for (k, _), s in zip(runs, shift, strict=False)])
    size = np.concatenate([k[2] for k, _ in runs])
    lcp = np.concatenate([c for _, c in runs])
    if len(runs) == 1:
        return np.arange(len(first)), lcp, np.zeros(len(first), bool)

    def differ(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols shared, is x less) of pairs that share `at` symbols."""
        at, less = at.copy(), np.zeros(len(x), bool)
        open_ = np.flatnonzero(at < size[x])
        while len(open_):
            xs, ys, a = x[open_], y[open_], at[open_]
            k = a[:, None] + np.arange(step_)
            apart = flat[np.minimum(first[xs][:, None] + k, len(flat) - 1)] != flat[np.minimum(first[ys][:, None] + k, len(flat) - 1)]
            some = apart.any(axis=1)
            to = np.minimum(a + np.where(some, apart.argmax(axis=1), step_), size[xs])  # a string's last symbol is no other's beginning
            at[open_] = to
            found = some & (to < size[xs])
            f = np.flatnonzero(found)
            less[open_[f]] = flat[first[xs[f]] + to[f]] < flat[first[ys[f]] + to[f]]
            open_ = open_[~found & (to < size[xs])]
        return at, less

    # subranges: splitters from every run, so that few have more than `spacing` strings of a run
    width_ = 8
    k = np.arange(width_)
    begin = np.where(k[None, :] < size[:, None], flat[np.minimum(first[:, None] + k, len(flat) - 1)], np.uint64(0))
    text = np.ascontiguousarray(begin.astype(">u8")).view(f"S{8 * width_}").ravel()
    pick = np.unique(np.concatenate([text[a + spacing // 2 : b : spacing] for a, b in zip(base[:-1], base[1:], strict=True)]))
    pick = pick[:: max(1, len(pick) // max(1, len(first) // (spacing * 2)))]
    trees, width = len(pick) + 1, 1 << int(np.ceil(np.log2(len(runs))))
    cur, end = np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64)
    for r, (a, b) in enumerate(zip(base[:-1], base[1:], strict=True)):
        cut = a + np.searchsorted(text[a:b], pick, side="left")
        cur[0, r], end[-1, r] = a, b
        cur[1:, r], end[:-1, r] = cut, cut
    tree = np.arange(trees)
    loser, known = np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64)

    def play(t: np.ndarray, a: np.ndarray, ha: np.ndarray, b: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Winner, its prefix, loser and the loser's prefix with the winner; -1 marks a run that has ended."""
        a_wins = ha > hb
        even = np.flatnonzero((ha == hb) & (ha >= 0))
        h = np.minimum(ha, hb)
        if len(even):
            x, y = cur[t[even], a[even]], cur[t[even], b[even]]
            at, less = differ(x, y, ha[even])
            same = at == size[x]
            a_wins[even] = np.where(same, a[even] < b[even], less)
            h[even] = at
        a_wins |= (ha < 0) & (hb < 0)
        return np.where(a_wins, a, b), np.where(a_wins, ha, hb), np.where(a_wins, b, a), h

    # the first winners, level by level; prefixes with the empty string are 0
    best = np.tile(np.arange(width), (trees, 1))
    have = np.where(cur < end, 0, -1)
    level = width
    while level > 1:
        half = level // 2
        t = np.repeat(tree, half)
        w, hw, lo, hl = play(t, best[:, 0::2].ravel(), have[:, 0::2].ravel(), best[:, 1::2].ravel(), have[:, 1::2].ravel())
        loser[:, half:level], known[:, half:level] = lo.reshape(trees, half), hl.reshape(trees, half)
        best, have = w.reshape(trees, half), hw.reshape(trees, half)
        level = half
    win, h = best[:, 0], have[:, 0]
    sizes = (end - cur).sum(axis=1)
    start = np.cumsum(sizes) - sizes
    order, prefix = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    live = np.flatnonzero(h >= 0)
    done = np.zeros(trees, np.int64)
    while len(live):
        r = win[live]
        place = cur[live, r]
        slot = start[live] + done[live]
        order[slot], prefix[slot] = place, h[live]
        done[live] += 1
        nxt = place + 1
        cur[live, r] = nxt
        c, hc = r, np.where(nxt < end[live, r], lcp[np.minimum(nxt, len(lcp) - 1)], -1)
        node = (r + width) // 2
        for _ in range(width.bit_length() - 1):
            w, hw, lo, hl = play(live, c, hc, loser[live, node], known[live, node])
            loser[live, node], known[live, node] = lo, hl
            c, hc, node = w, hw, node // 2
        win[live], h[live] = c, hc
        live = live[hc >= 0]
    # the first of a subrange was not compared with the last of the one before
    s = start[(sizes > 0) & (start > 0)]
    prefix[s], _ = differ(order[s - 1], order[s], np.zeros(len(s), np.int64))
    same = prefix == size[order]
    same[0] = False
    return order, prefix, same


def merge_range(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, code) of each place of the range whose suffix is at two or more places."""
    if len(blocks) <= TREE_RUNS:
        runs = [decode_block(x) for x in blocks]
        order, _, same = merge([(k, c) for k, c, *_ in runs])
        count, ids, pos = (np.concatenate([x[i] for x in runs]) for i in (2, 3, 4))
    else:
        (flat, begin, size), _, count, ids, pos = decode_blocks(blocks)
        order, prefix = sort_symbols(lambda which, k: flat[begin[which] + k], size)
        same = prefix == size[order]
    first = np.cumsum(count) - count
    n = count[order]
    at = np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    group, ids, pos = np.repeat(np.cumsum(~same), n), ids[at], pos[at]
    order = np.lexsort((pos, ids, group))
    group, ids, pos = group[order], ids[order], pos[order]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(edge[1:], len(ids)) - 1
    across = ids[edge] < ids[last]
    size = last - edge + 1
    lead = np.zeros(len(ids), np.int64)
    lead[edge] = LEAD
    keep = np.repeat(across | (pos[edge] < pos[last]), size)
    return ids[keep], (pos << 2 | np.repeat(across * CROSS, size) | lead)[keep]


def passages(ids: np.ndarray, code: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows of SCHEMA from all repeated suffixes of some documents."""
    order = np.lexsort((code, ids))
    ids, code = ids[order], code[order]
    pos = code >> 2
    at = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])])) if len(ids) else np.zeros(0, np.int64)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    flags = np.bitwise_or.reduceat(code & 3, at)  # a repeated row has the same suffixes again
    ids, pos = ids[at], pos[at]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (pos[1:] > pos[:-1] + length)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], pos[at], pos[last] + length, last - at + 1, np.add.reduceat(flags & LEAD, at), np.add.reduceat((flags & CROSS) >> 1, at)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The repeated passages of `docs` (doc_id, text): see the module."""
    if length < 2:
        raise ValueError("a passage has two words or more")
    spark = docs.sparkSession
    slim = small_batches(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = materialized(candidates(slim, length), "suffix-candidates")
    total = found.agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    ranges = max(1, min(RANGES, int(total // RANGE_SUFFIXES)))
    splitters = spark.sparkContext.broadcast(_splitters(slim, found, ranges, length, total))

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, aside = Run(length), 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal aside
            for r, data in run.blocks(splitters.value):
                if r < 0:
                    r = -1 - (int.from_bytes(data[-8:], "little") + aside) % ranges  # spread over as many groups
                    aside += 1
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([data], pa.binary())], ["r", "block"])

        for b in batches:
            for _ in run.add(b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2), b.column(3)):
                yield from out()
        yield from out()

    def merge_runs(t: pa.Table) -> pa.Table:
        blocks = t.column("block").to_pylist()
        if t.column("r")[0].as_py() < 0:
            parts = [decode_places(x) for x in blocks]
            ids, code = (np.concatenate([x[i] for x in parts]) for i in range(2))
        else:
            ids, code = merge_range(blocks)
        order = np.lexsort((code, ids))
        ids, code = ids[order], code[order]
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        return pa.table([pa.array(ids[at]), W.int_lists(code, np.append(at, len(ids)), pa.int64())], names=["doc_id", "code"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            code = lists.flatten().to_numpy(zero_copy_only=False)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in passages(ids, code, length)], [x.split()[0] for x in SCHEMA.split(", ")])

    blocks = slim.join(found, "doc_id").select("doc_id", "text", "p", "n").mapInArrow(sort_runs, "r int, block binary")
    merged = blocks.groupBy("r").applyInArrow(merge_runs, "doc_id bigint, code array<bigint>")
    whole = merged.groupBy("doc_id").agg(F.flatten(F.collect_list("code")).alias("code"))
    return whole.mapInArrow(join_up, SCHEMA)


def _splitters(slim: DataFrame, found: DataFrame, ranges: int, length: int, total: int) -> list[bytes]:
    """Strings that cut the suffixes into about equal ranges, from those of a sample of documents; each is as short as
    it can be behind its predecessor in the sample."""
    if ranges == 1:
        return []
    aim = min(SAMPLE * ranges, max(RANGES, ranges))
    share = min(1.0, 50.0 * aim / max(total, 1))  # of documents; of which one suffix in 50 is taken

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        for b in batches:
            for _, _, buf, off in W.text_slices(b.column(0)):
                starts, ends, ptr = W.find_words(buf, off)
                n = np.maximum(np.diff(ptr) - length + 1, 0)
                word = np.repeat(ptr[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                word = word[rng.random(len(word)) < 0.02]
                if not len(word):
                    continue
                text, place = joined_words(buf, starts, ends)
                last = place + (ends - starts)
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[place[w] : min(last[w + length - 1], place[w] + PREFIX)] for w in word.tolist()], pa.binary())], ["k"])

    ids = found.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(max(1 << 15, int((1 << 30) * share)))).select("doc_id")
    docs = slim.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(max(1 << 15, int((1 << 30) * share)))).join(ids, "doc_id", "left_semi").select("text")
    keys = sorted(set(docs.mapInArrow(sample, "k binary").toArrow().column("k").to_pylist()))
    out = []
    for i in sorted({(r * len(keys)) // ranges for r in range(1, ranges)} - {0}):
        a, b = keys[i - 1], keys[i]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        out.append(b[: n + 1])
    return out
