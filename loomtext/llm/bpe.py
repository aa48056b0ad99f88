"""Byte-level BPE encoding and decoding (operator 7).

The tokenizers library encodes; around it, everything is done for whole Arrow batches.
A text is first cut at places where the vocabulary's own pre-tokenizer always cuts (before
a single blank, and around longer runs of white space), so its tokens are those of the
pieces, one after another. Each distinct piece of a batch is encoded once and kept for
later batches of the same worker; ids, byte lengths and offsets of a text are then gathered
from those of its pieces. A vocabulary with another pre-tokenizer or with a normalizer is
told apart when it is loaded, and its texts are encoded as wholes.

Byte-level vocabularies write each byte as a printable character; the table between the two
is `byte_table`. Decoding maps the characters of the concatenated tokens back to bytes, so a
character that is split between tokens is whole again. Offsets: token i covers the characters
[char_start[i], char_start[i+1]); a token that begins inside a character has the place of that
character, and the last token ends at the end of the text.

Every text is decoded again and compared; where that fails (it has not been seen; two pieces
would have to share a 64-bit hash) the text is encoded whole, so results never rest on a hash.

Defined results: a null text has null ids and offsets and 0 tokens; an empty text has empty
lists; decoding ids outside the vocabulary gives nothing for them; bytes that are not UTF-8,
which only a cut list of ids can give, decode to U+FFFD. Rows are independent and keep their
order within a partition; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import words as W
from loomtext.llm.tables import small_batches

DEFAULT = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id bigint, n_tokens int, token_ids array<int>, char_starts array<int>, round_trip boolean"
KEEP_PIECES = 1_500_000  #: pieces that a worker remembers before it starts anew


@lru_cache
def byte_table() -> dict[str, int]:
    """Character -> byte: printable Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for k, b in enumerate(sorted(set(range(256)) - set(plain))):
        table[chr(256 + k)] = b
    return table


class Codec:
    """One vocabulary; made once in each Python worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        made = json.loads(self.tok.to_str())
        before = made["pre_tokenizer"] or {}
        #: whether `pieces` cuts where this vocabulary's own pre-tokenizer always cuts; else texts are encoded as wholes
        self.cuts = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        vocab = self.tok.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        table = byte_table()
        raw = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            if s in special:
                raw[i] = s.encode()
            elif all(c in table for c in s):
                raw[i] = bytes(table[c] for c in s)
            else:
                raise ValueError(f"{path}: token {s!r} is not of a byte-level vocabulary")
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  #: sorted hashes of the known pieces
        self.slots = np.zeros(0, np.int64)  #: their place in ptr
        self.ptr = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces with their (distinct, new) hashes."""
        got = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.int32, int(n.sum()))
        first = len(self.ptr) - 1
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, flat])
        keys = np.concatenate([self.keys, keys])  # both sorted
        slots = np.concatenate([self.slots, np.arange(first, first + len(got))])
        order = np.argsort(keys, kind="stable")  # two sorted runs: linear
        self.keys, self.slots = keys[order], slots[order]

    def encode_slice(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n+1 offsets of the texts of a slice."""
        starts, ends, ptr = pieces(buf, off) if self.cuts else whole_texts(off)
        h = W.hash_ranges(buf, starts, ends)
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > KEEP_PIECES or not self.cuts:
            self.forget()
        at = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != uniq[inside]
        if new.any():
            w = where[new]
            raw = buf.tobytes()
            self.learn(uniq[new], [raw[a:b].decode() for a, b in zip(starts[w].tolist(), ends[w].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.keys, uniq)]
        lo, n = self.ptr[slot], self.ptr[slot + 1] - self.ptr[slot]
        lo, n = lo[inverse], n[inverse]
        out = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=out[1:])
        return self.ids[np.repeat(lo - out[:-1], n) + np.arange(out[-1])], out[ptr]

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        n = self.size[ids]
        out = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=out[1:])
        return self.bytes[np.repeat(self.at[ids] - out[:-1], n) + np.arange(out[-1])]

    def encode_column(self, arr: pa.Array) -> pa.RecordBatch:
        """n_tokens, token_ids, char_starts, round_trip of a string column."""
        all_ids, all_chars, counts, good = [], [], [], []
        for i, j, buf, off in W.text_slices(arr):
            ids, ptr = self.encode_slice(buf, off)
            size = self.size[ids]
            ends = np.cumsum(size)
            back = self.decode_flat(ids)
            byte_ptr = np.concatenate([[0], ends])[ptr]
            if not (len(back) == len(buf) and np.array_equal(byte_ptr, off) and np.array_equal(back, buf)):
                lists = [e.ids for e in self.tok.encode_batch_fast([buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
                ptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                ids = np.fromiter((t for x in lists for t in x), np.int32, int(ptr[-1]))
                size = self.size[ids]
                ends = np.cumsum(size)
                back, byte_ptr = self.decode_flat(ids), np.concatenate([[0], ends])[ptr]
            lead = (buf & 0xC0) != 0x80
            chars = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(lead, out=chars[1:])
            begin = ends - size  # the place of each token's first byte in the slice
            d = np.repeat(np.arange(j - i), np.diff(ptr))
            begin = np.minimum(begin, max(len(buf) - 1, 0))
            all_chars.append((chars[begin + 1] - 1 - chars[off[:-1]][d]).astype(np.int32) if len(begin) else np.zeros(0, np.int32))
            all_ids.append(ids)
            counts.append(np.diff(ptr))
            if len(back) == len(buf) and np.array_equal(byte_ptr, off) and np.array_equal(back, buf):
                good.append(np.ones(j - i, bool))
            else:
                good.append(np.array([np.array_equal(back[a:b], buf[c:d]) for a, b, c, d in zip(byte_ptr[:-1], byte_ptr[1:], off[:-1], off[1:], strict=True)]))
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ptr = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        null = np.array(arr.is_null().to_numpy(zero_copy_only=False)) if arr.null_count else None
        offsets = pa.array(ptr, mask=np.append(null, False) if null is not None else None)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (all_ids, all_chars)]
        return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), *lists, pa.array(np.concatenate(good) if good else np.zeros(0, bool))], ["n_tokens", "token_ids", "char_starts", "round_trip"])

    def decode_column(self, arr: pa.Array) -> pa.Array:
        """The texts of lists of ids."""
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        flat = arr.flatten()
        ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.where((ids < 0) | (ids >= len(self.size)), len(self.size), ids)
        size, at = np.append(self.size, 0), np.append(self.at[:-1], 0)
        n = size[ids]
        out = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=out[1:])
        data = self.bytes[np.repeat(at[ids] - out[:-1], n) + np.arange(out[-1])].tobytes()
        lengths = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ptr = out[np.concatenate([[0], np.cumsum(lengths)])]
        valid = arr.is_valid().to_pylist()
        return pa.array([data[a:b].decode("utf-8", "replace") if v else None for a, b, v in zip(ptr[:-1].tolist(), ptr[1:].tolist(), valid, strict=True)], pa.string())


#: What a byte is: 1 letter, 2 digit, 3 other ASCII, 4 ASCII white space, 0 not known (a part of a longer character).
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that tile every text, cut only where the pre-tokenizer always cuts; and for each
    text the index of its first piece. White space of more than one byte is left to the pieces it
    stands in, for the library to cut."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    blank = W.BLANK[buf]
    first = np.zeros(n, bool)
    edge = off[:-1]
    first[edge[edge < n]] = True
    before = np.empty(n, bool)  # the byte before is white space of this text
    before[0] = False
    before[1:] = blank[:-1]
    before[first] = False
    after = np.empty(n, bool)  # the byte after is something else of this text
    after[-1] = False
    after[:-1] = ~blank[1:] & ~first[1:]
    # the last white space before a word is cut off from the white space before it, and goes with
    # the word if it is a blank; changes of class cut, but for contractions like 's and next to
    # characters whose class is not known from their bytes
    space = buf == 32
    cut = first | (blank & after) | (~blank & before & ~_shift(space)) | (blank & ~before)
    kind = _CLASS[buf]
    after_c3 = _shift(buf == 0xC3)
    latin = after_c3 & (buf >= 0x80) & (buf != 0x97) & (buf != 0xB7)
    kind[latin] = 1
    kind[:-1][latin[1:]] = 1
    old = np.empty(n, np.uint8)
    old[0] = 0
    old[1:] = kind[:-1]
    cut |= (old != kind) & (old > 0) & (kind > 0) & (old < 4) & (kind < 4) & ~((old == 3) & (kind == 1) & _shift(buf == 39))
    if (wide := _touches_wide(buf)) is not None:
        cut &= ~wide | first
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, off)


def whole_texts(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `pieces`, without a cut."""
    some = off[1:] > off[:-1]
    return off[:-1][some], off[1:][some], np.concatenate([[0], np.cumsum(some)])


def _shift(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), bool)
    out[0] = False
    out[1:] = x[:-1]
    return out


def _touches_wide(buf: np.ndarray) -> np.ndarray | None:
    """Places within a run of white space that holds a character of more than one byte, and one byte after; or None."""
    lead = (buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3)
    if not lead.any():
        return None
    at = np.flatnonzero(lead)
    pad = np.concatenate([buf, np.zeros(2, np.uint8)])
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
    if not (two | three).any():
        return None
    white = W.BLANK[buf]
    hit = np.zeros(len(buf) + 2, bool)
    for size, which in ((2, two), (3, three)):
        for k in range(size):
            hit[at[which] + k] = True
    hit = hit[: len(buf)]
    run = white | hit
    edge = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]]).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    total = np.concatenate([[0], np.cumsum(hit)])
    bad = total[e] > total[s]
    mark = np.zeros(len(buf) + 2, np.int32)
    np.add.at(mark, s[bad], 1)
    np.add.at(mark, np.minimum(e[bad] + 1, len(buf)), -1)
    return np.cumsum(mark)[: len(buf)] > 0


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str = DEFAULT, keep: tuple[str, ...] = (), finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The tokens of each row of `docs` (doc_id, text): see SCHEMA; and after them the columns `keep`, as `finish`, if given, returns them from the batches of a partition.
    Rows stay in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in finish(batches) if finish else batches:
            for part in W.slices(W.buffers(b.column(1))[1], 2 << 20):
                rows = b.slice(part[0], part[1] - part[0])
                got = c.encode_column(rows.column(1))
                yield pa.RecordBatch.from_arrays([rows.column(0), *got.columns, *rows.columns[2:]], ["doc_id", *got.schema.names, *keep])

    kinds = dict(docs.dtypes)
    schema = ", ".join([SCHEMA, *(f"`{c}` {kinds[c]}" for c in keep)])
    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str = DEFAULT) -> DataFrame:
    """The text of each row of `tokens` (doc_id, token_ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), c.decode_column(b.column(1))], ["doc_id", "text"])

    return small_batches(tokens).select(F.col("doc_id").cast("bigint").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id bigint, text string")
