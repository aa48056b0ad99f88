"""Repeated passages against brute force; sorting, front coding and merging against Python's sort."""

import itertools
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from loomtext.llm import queries, suffixes


def brute(rows, length):
    at = defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            w = t.split()
            for p in range(len(w) - length + 1):
                at[tuple(w[p : p + length])].add((i, p))
    hits = defaultdict(dict)
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                hits[i][p] = ((i, p) == min(places), len({x for x, _ in places}) > 1)
    out = set()
    for i, ps in hits.items():
        group = []
        for p in [*sorted(ps), 1 << 40]:
            if group and p > group[-1] + length:
                out.add((i, group[0], group[-1] + length, len(group), sum(ps[q][0] for q in group), sum(ps[q][1] for q in group)))
                group = []
            group.append(p)
    return out


def corpus(rng):
    prose = lambda n, words=800: " ".join(f"w{int(x)}" for x in rng.integers(0, words, n))
    rows = [(i, prose(int(rng.integers(5, 120)))) for i in range(60)]
    shared, long = prose(40), "x" * 40 + " "
    rows += [(100 + i, f"{prose(20)} {shared} {prose(20)}") for i in range(4)]
    rows += [(200 + i, long * 15 + f"y{i} " + prose(9)) for i in range(3)]  # common prefixes of hundreds of bytes
    rows += [(300, "a b " * 40), (301, f"{prose(9)} {shared[:60]} z {prose(20)} {shared[:60]}"), (302, "q " * 200)]  # repeats within a document
    rows += [(400 + i, shared) for i in range(50)]
    rows += [(500, shared + " end"), (500, shared + " end"), (501, prose(30)), (501, prose(30))]
    return [*rows, (None, shared), (600, None), (601, ""), (602, prose(30_000)), (603, "漢字 " * 30), (604, "null\x00byte " * 20), (605, "null\x01byte " * 20)]


def test_repeats(spark):
    rows = corpus(np.random.default_rng(1))
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, code string").repartition(3)
    for length in (2, 12, 50):
        want = brute(rows, length)
        assert want and {tuple(r) for r in suffixes.repeats(d, length).collect()} == want
    assert any(w[5] == 0 for w in want) and any(w[5] for w in brute(rows, 12))  # within one document, and across
    assert suffixes.repeats(d.limit(0), 12).count() == 0
    documents = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})  # noqa: F841 - read by DuckDB
    assert set(duckdb.sql(queries.ORACLE["op1_suffix_repeats"]).fetchall()) == want


def strings(rng, n):
    bits = [b"aaaaaaaa", b"aaaaaaab", b"b", b"longer than eight", b"\x01", b""]
    return [b"".join(bits[int(x)] for x in rng.integers(0, len(bits), int(rng.integers(0, 7)))) for _ in range(n)]


def shared_symbols(a, b):
    pad = lambda x: x + b"\0" * (8 - len(x) % 8)
    a, b = pad(a), pad(b)
    return next((k // 8 for k in range(0, len(a), 8) if a[k : k + 8] != b[k : k + 8]), len(a) // 8)


def test_sorting_and_front_coding():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 600):
        given = strings(rng, n)
        text = np.frombuffer(b"".join(given) or b"-", np.uint8)
        size = np.array([len(x) for x in given])
        start = np.cumsum(size) - size
        order, shared = suffixes.sort_strings(text, start, size)
        now = [given[k] for k in order]
        assert now == sorted(given) and shared[0] == 0
        assert all(shared[i] == shared_symbols(now[i], now[i - 1]) for i in range(1, n))
        head = np.flatnonzero(shared < size[order] // 8 + 1)
        count = rng.integers(1, 4, len(head))
        ids, pos = rng.integers(0, 1 << 60, int(count.sum())), rng.integers(0, 1 << 31, int(count.sum()))
        block = suffixes.encode_block(text, start[order][head], size[order][head], shared[head], count, ids, pos)
        (flat, first, symbols), lcp, c, i, p = suffixes.decode_block(block)
        assert [flat[a : a + m].astype(">u8").tobytes().rstrip(b"\0") for a, m in zip(first, symbols, strict=True)] == sorted(set(given))
        assert (c == count).all() and (i == ids).all() and (p == pos).all() and (lcp[1:] == shared[head][1:]).all()


def test_merge_by_loser_trees():
    rng = np.random.default_rng(3)
    for sizes in ((40,), (500, 1, 300, 800), (30,) * 9):
        runs, all_ = [], []
        for n in sizes:
            own = sorted(set(strings(rng, n)))
            text, size = np.frombuffer(b"".join(own) + b"-", np.uint8), np.array([len(x) for x in own])
            start = np.cumsum(size) - size
            lcp = np.array([0, *(shared_symbols(b, a) for a, b in itertools.pairwise(own))])
            runs.append(suffixes.decode_block(suffixes.encode_block(text, start, size, lcp, np.ones(len(own), int), np.arange(len(own)), np.arange(len(own))))[:2])
            all_ += own
        order, prefix, same = suffixes.merge(runs, 16)
        now = [all_[k] for k in order]
        assert now == sorted(all_)
        assert all(prefix[i] == shared_symbols(now[i], now[i - 1]) and same[i] == (now[i] == now[i - 1]) for i in range(1, len(now)))


def test_hot_passage():
    """A passage of most documents is two places for each run, whatever their number; the others go their own way."""
    run = suffixes.Run(50)
    words = " ".join(f"w{k}" for k in range(60))
    for a in range(0, 5000, 1000):
        n = pa.array([[11]] * 1000, pa.list_(pa.int32()))
        list(run.add(np.arange(a, a + 1000), pa.array([words] * 1000), pa.array([[0]] * 1000, pa.list_(pa.int32())), n))
    assert run.n == 55_000
    blocks = list(run.blocks([]))
    places = [suffixes.decode_places(d) for r, d in blocks if r < 0]
    (_, data), = [x for x in blocks if x[0] >= 0]
    count = suffixes.decode_block(data)[2]
    assert count.tolist() == [2] * 11 and sum(len(i) for i, _ in places) == 55_000 - 22
    ids, code = suffixes.merge_range([data])
    assert {(i, c & 3) for i, c in zip(ids.tolist(), code.tolist(), strict=True)} == {(0, 3), (4999, 2)}


def test_full_runs(monkeypatch):
    monkeypatch.setattr(suffixes, "RUN_SUFFIXES", 100)
    rng = np.random.default_rng(4)
    rows = [(i, t) for i, t in corpus(rng) if i is not None and t and len(t) < 5000]
    ids = np.array([i for i, _ in rows])
    n = [max(0, len(t.split()) - 11) for _, t in rows]
    run, blocks, aside = suffixes.Run(12), [], []

    def out():
        for r, data in run.blocks([b"x2", b"x3" * 9, b"y"]):
            blocks.append((r, data)) if r >= 0 else aside.append(data)

    for _ in run.add(ids, pa.array([t for _, t in rows]), pa.array([[0]] * len(rows), pa.list_(pa.int32())), pa.array([[x] for x in n], pa.list_(pa.int32()))):
        assert run.n <= 200
        out()
    out()
    found = [suffixes.decode_places(x) for x in aside] + [suffixes.merge_range([d for r, d in blocks if r == k]) for k in {r for r, _ in blocks}]
    got = suffixes.passages(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), 12)
    assert len({r for r, _ in blocks}) > 1 and set(zip(*(x.tolist() for x in got), strict=True)) == brute(rows, 12)


def test_many_runs(monkeypatch):
    """A tree has a leaf for each run: a range of very many short runs is not merged by trees, whose work would grow with runs times suffixes."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 9, 20)) for _ in range(60)]
    widths, merge, places = [1], suffixes.merge, {}
    monkeypatch.setattr(suffixes, "merge", lambda runs, *a: (widths.append(len(runs)), merge(runs, *a))[1])
    blocks = []
    for i in range(600):
        t = texts[int(rng.integers(60))]
        run = suffixes.Run(12)
        list(run.add(np.array([i]), pa.array([t]), pa.array([[0]], pa.list_(pa.int32())), pa.array([[9]], pa.list_(pa.int32()))))
        blocks += [d for r, d in run.blocks([]) if r >= 0]
        for p in range(9):
            places.setdefault(" ".join(t.split()[p : p + 12]), []).append((i, p))
    assert len(blocks) == 600
    ids, code = suffixes.merge_range(blocks)
    want = {(i, p << 2 | (suffixes.LEAD if (i, p) == x[0] else 0) | (suffixes.CROSS if x[0][0] < x[-1][0] else 0)) for x in places.values() if len(x) > 1 for i, p in x}
    assert set(zip(ids.tolist(), code.tolist(), strict=True)) == want and len(ids) == len(want)
    assert max(widths) <= 64
