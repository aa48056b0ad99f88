"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomtext.llm import bpe, flac, langid, mixing, neardup, queries, topk, warc
from loomtext.llm.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, word string, position string"


def frame(spark, rows):
    """Documents with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "h", "w", "p") for i, t, s in rows], DOCS)


def prose(rng, n, words=800):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, prose(rng, int(rng.integers(5, 120))), f"s{i % 3}") for i in range(60)]
    shared = prose(rng, 40)
    out += [(100 + i, f"{prose(rng, 20)} {shared} {prose(rng, 20)}", "s0") for i in range(4)]
    base = prose(rng, 100).split()
    out += [(200 + i, " ".join(base[:50] + [f"new{i}"] + base[51:]), "s1") for i in range(5)]
    return [*out, (300, None, "s1"), (301, "", None), (None, "lost words here", "s0"), (302, prose(rng, 30_000), "s2"), (303, "one", "s2"), (303, "one", "s2"), (304, "漢字 émile", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_top_k(spark, docs, rows, none):
    asked = [(1, rows[0][1]), (2, "w1 w2 W3 w3"), (3, None), (4, ""), (5, "nothing known")]
    q = spark.createDataFrame(asked, "item_id bigint, text string")
    known = [(i, Counter(t.lower().split())) for i, t, _ in rows if i is not None and t is not None]
    df = Counter(w for _, c in known for w in c)
    want = []
    for qid, t in asked:
        scores = []
        for i, c in known:
            s = sum(int(topk.impacts(np.log(1 + len(known) / df[w]), np.array(c[w]))) for w in set((t or "").lower().split()) if c[w])
            if s:
                scores.append((-s, i))
        want += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10])]
    assert sorted(map(tuple, topk.top_k(docs, q).collect())) == want
    assert topk.top_k(none, q).count() == 0 and topk.top_k(docs, q.limit(0)).count() == 0


def test_near_duplicates(docs, rows, none):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = {tuple(w[p : p + 3]) for p in range(max(1, len(w) - 2))}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = {r["doc_id"]: r["group_id"] for r in neardup.groups(docs).collect()}
    assert pairs and all(got.get(a) == got.get(b) is not None for a, b in pairs)
    assert set(got) == {x for p in pairs for x in p}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[200] == 1 and not any(ids[i] for i in range(201, 205)) and ids[300] == ids[None] == ids[303] == 1
    assert neardup.keep_one(none).count() == 0


def test_recall_of_bands():
    rng = np.random.default_rng(4)
    p, found, n = neardup.Params(), 0, 300
    for _ in range(n):
        both, own = rng.integers(0, 1 << 60, 90, dtype=np.uint64), rng.integers(0, 1 << 60, (2, 30), dtype=np.uint64)
        h = neardup.band_hashes(neardup.signatures(np.concatenate([both, own[0], both, own[1]]), np.array([0, 120, 240]), p), p)
        found += bool(set(h[0].tolist()) & set(h[1].tolist()))
    assert found / n >= 0.9  # at a similarity of 0.6


def test_recall_of_bands_at_threshold():
    rng = np.random.default_rng(14)
    p, found, n = neardup.Params(), 0, 2000
    for _ in range(n):
        both, own = rng.integers(0, 1 << 60, 80, dtype=np.uint64), rng.integers(0, 1 << 60, (2, 40), dtype=np.uint64)
        h = neardup.band_hashes(neardup.signatures(np.concatenate([both, own[0], both, own[1]]), np.array([0, 120, 240]), p), p)
        found += bool(set(h[0].tolist()) & set(h[1].tolist()))
    assert p.threshold == 0.5 and found / n >= 0.9


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in components(edges).collect()} == {(3, 2), (4, 2), (5, 2), (9, 8)}


def test_flac(spark):
    rng = np.random.default_rng(6)
    made, want = [], {}
    for i, (ch, bits, n) in enumerate(itertools.product((1, 2), (8, 16, 24), (1, 100, 700))):
        walk = np.cumsum(rng.integers(-9, 10, (n, ch)), axis=0).clip(-(1 << bits - 1), (1 << bits - 1) - 1)
        made.append((i, bytearray(flac.encode(walk.T, bits=bits, block=128))))
        want[i] = flac.pack(walk.T, bits)
    broken = bytearray(made[-1][1])
    broken[-40] ^= 1
    d = spark.createDataFrame([*made, (50, broken), (51, None), (52, bytearray()), (53, bytearray(b"no sound")), (0, made[0][1])], "id bigint, flac binary")
    by = defaultdict(list)
    for r in flac.decode(d).collect():
        by[r["id"]].append(r)
    for i, pcm in want.items():
        blocks = sorted(by[i], key=lambda r: r["sample_offset"])[: None if i else 1]
        assert b"".join(bytes(r["pcm"]) for r in blocks) == pcm and all(r["stream_ok"] for r in blocks)
        assert [r["sample_offset"] for r in blocks] == [128 * k for k in range(len(blocks))]
    assert not any(r["stream_ok"] for i in (50, 51, 52, 53) for r in by[i]) and any(r["pcm"] is None for r in by[50])
    assert len(by[0]) == 2 and [r["block"] for r in by[51]] == [-1]
    assert flac.decode(d.limit(0)).count() == 0


TEXTS = ["", "a", "  two  blanks\n\n\ttab ", "漢字🚀 émile's don't 12345 x=1;", "  wide　space  x", "é combining", "z" * 5000, "<|endoftext|> kept", "don’t 'S 'll '' 3rd 10,000.50", "\r\n\r\n x"]


def test_bpe(spark, none):
    d = frame(spark, [*[(i, t, "s") for i, t in enumerate(TEXTS * 2)], (99, None, "s")])
    tok = bpe.codec(bpe.DEFAULT).tok
    coded = bpe.encode(d)
    for r in coded.collect():
        if r["doc_id"] == 99:
            assert r["token_ids"] is None and r["char_starts"] is None and r["n_tokens"] == 0
            continue
        t = (TEXTS * 2)[r["doc_id"]]
        e = tok.encode(t, add_special_tokens=False)
        assert r["token_ids"] == e.ids and r["round_trip"] and r["n_tokens"] == len(e.ids)
        assert r["char_starts"] == sorted(r["char_starts"]) and all(0 <= c < len(t) for c in r["char_starts"])
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()}
    assert back == {**dict(enumerate(TEXTS * 2)), 99: None}
    assert bpe.encode(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bpe_pieces(seed):
    rng = np.random.default_rng(seed)
    bits = [" ", "  ", "\n", "a", "B", "7", ".", "'s", "é", "漢", " ", "🚀", "-", "\t", "×", "_"]
    texts = ["".join(bits[int(x)] for x in rng.integers(0, len(bits), 30)) for _ in range(300)]
    c = bpe.codec(bpe.DEFAULT)
    got = c.encode_column(pa.array(texts)).column("token_ids").to_pylist()
    assert got == [c.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_warc(spark, tmp_path):
    made = [(1, "http://a/", "<p>é</p>"), (2, None, ""), (None, "http://b/\n", None), (1, "http://a/", "<p>é</p>"), (3, "http://c/", "x" * 3_000_000)]
    got = warc.read(warc.write(spark.createDataFrame(made, "page_id bigint, url string, html string")))
    back = Counter((r["page_id"], r["target_uri"], None if r["is_null"] else bytes(r["content"]).decode()) for r in got.collect())
    assert back == Counter(made) and got.filter("NOT digest_ok OR error IS NOT NULL").count() == 0
    a, b, c = (warc.record(i, "http://x/", b"abc" * 50) for i in range(3))
    bad = bytearray(b)
    bad[len(bad) // 2] ^= 255
    (tmp_path / "x.gz").write_bytes(a + bytes(bad) + c + a[:-9])
    (tmp_path / "e.gz").write_bytes(b"")
    rows = warc.read(spark.createDataFrame([(f"file://{tmp_path}/x.gz",), (f"file://{tmp_path}/e.gz",)], "path string")).orderBy("offset").collect()
    ok = [r["page_id"] for r in rows if r["error"] is None and r["digest_ok"]]
    assert ok == [0, 2] and any(r["error"] for r in rows[1:-1]) and rows[-1]["error"]


def demand(knots, x):
    """The integral up to x of the weight whose (t, weight) are given, by exact trapezoids."""
    ts = sorted({0.0, 1.0, x, *(t for t, _ in knots if t < x)})
    w = np.interp(ts, [t for t, _ in knots], [v for _, v in knots])
    keep = [i for i, t in enumerate(ts) if t <= x]
    return float(sum((w[i] + w[i + 1]) / 2 * (ts[i + 1] - ts[i]) for i in keep[:-1]))


def check_positions(rows, got, knots, least, most):
    """Each source's passes and places against its demand; knots: scaled to a sum of 1."""
    supply = Counter()
    for i, t, s in rows:
        if i is not None:
            supply[s] += len((t or "").split())
    total = sum(supply.values())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append((r["epoch"], r["position"], r["doc_id"], r["tokens"]))
    for s, placed in by.items():
        if not supply[s]:
            assert all(p[:2] == (0, 0.0) for p in placed)
            continue
        whole = demand(knots[s], 1.0)
        epochs = min(max(total * whole / supply[s], least), most)
        placed.sort()
        ahead, largest = 0, max(len((t or "").split()) for i, t, x in rows if x == s and i is not None)
        for k, position, _, n in placed:
            ahead = 0 if (k, position) == placed[0][:2] else ahead
            x = (ahead + n / 2) / supply[s] / epochs
            assert demand(knots[s], position) / whole == pytest.approx(x, abs=1e-6) if whole else position == 0
            ahead += n
        assert ahead / supply[s] <= epochs * (1 + 1e-9) and (ahead + largest) / supply[s] > epochs - 1e-6
        assert [p[1] for p in placed] == sorted(p[1] for p in placed)


def test_mixing(docs, rows, none):
    supply = Counter()
    for i, t, s in rows:
        if i is not None:
            supply[s] += len((t or "").split())
    some = {s: n for s, n in supply.items() if n}
    total, k = sum(some.values()), len(some)
    knots = {s: [(0.0, n / total + mixing.FLATTEN * (1 / k - n / total)), (1.0, n / total)] for s, n in some.items()}
    got = mixing.positions(docs).collect()
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows if i is not None}  # none is left out
    assert max(r["epoch"] for r in got) >= 1
    check_positions(rows, got, knots, mixing.LEAST_EPOCHS, mixing.MOST_EPOCHS)
    mixed = mixing.mix(docs)
    assert mixed.columns == [c for c in docs.columns if c != "position"] + ["epoch", "position"] and mixed.count() == len(got)
    order = [r["position"] for r in mixed.collect()]
    assert order == sorted(order) and mixing.mix(none).count() == 0


def test_mixing_schedules(spark, docs, rows):
    """Weights with knots, a source that the schedule doesn't name, one that is asked for late only, and target weights kept to exactly."""
    given = [("s0", 0.0, 5.0), ("s0", 0.4, 1.0), ("s0", 1.0, 0.0), ("s1", 0.5, 0.0), ("s1", 0.75, 3.0), ("unknown", 0.0, 2.0)]
    supply = Counter()
    for i, t, s in rows:
        if i is not None:
            supply[s] += len((t or "").split())
    total = sum(supply.values())
    grid = [0.0, 0.4, 0.5, 0.75, 1.0]
    raw = {s: [n / total] * 5 for s, n in supply.items() if n}
    for s in ("s0", "s1"):
        raw[s] = list(np.interp(grid, [t for x, t, _ in given if x == s], [w for x, _, w in given if x == s]))
    sums = np.sum(list(raw.values()), axis=0)
    knots = {s: list(zip(grid, np.array(w) / sums, strict=True)) for s, w in raw.items()}
    for least, most in ((1.0, 1.0), (0.0, 1e9), (1.0, 3.0)):
        got = mixing.positions(docs, given, least_epochs=least, most_epochs=most).collect()
        check_positions(rows, got, knots, least, most)
    used = Counter()
    for r in mixing.positions(docs, given, least_epochs=0.0, most_epochs=1e9).collect():
        used[r["source"]] += r["tokens"]
    for s in ("s0", "s1"):
        assert used[s] / total == pytest.approx(demand(knots[s], 1.0), abs=0.02)
    for bad in ([("a", 0.0, -1.0)], [("a", 1.5, 1.0)], [("a", 0.0, 1.0), ("a", 0.0, 2.0)], [("a", 0.0, float("nan"))]):
        with pytest.raises(ValueError):
            mixing.positions(docs, bad)
    nothing = mixing.positions(docs, [(s, 0.0, 0.0) for s in supply], least_epochs=1.0, most_epochs=1.0)
    assert {r["position"] for r in nothing.collect()} == {0.0}


def test_mixing_whole(spark, tmp_path):
    """A tiny source, one of no tokens and a null one don't cut the others; names of columns may be anything."""
    rng = np.random.default_rng(18)
    made = [(i, prose(rng, 50), f"s{i % 2}") for i in range(200)] + [(900, "one", "tiny"), (901, "", "blank"), (902, "two words", None)]
    d = frame(spark, made).drop("position").repartition(3)
    assert mixing.positions(d, least_epochs=1.0, most_epochs=1.0).count() == 203
    clash = d.selectExpr("*", "1 AS __copy", "2 AS copy", "3 AS id", "4 AS row", "5 AS epoch", "6 AS ahead", "7 AS supply")
    assert mixing.mix(clash).columns == [*d.columns, "__copy", "copy", "id", "row", "ahead", "supply", "epoch", "position"]
    assert {(r["__copy"], r["copy"], r["id"], r["row"]) for r in mixing.mix(clash).collect()} == {(1, 2, 3, 4)}
    counts = Counter(r["doc_id"] for r in mixing.mix(d).collect())
    assert set(counts) == {i for i, _, _ in made} and counts[900] == 4 and counts[901] == 1
    at = {r["doc_id"]: r["position"] for r in mixing.mix(d, least_epochs=1.0, most_epochs=1.0).collect()}
    assert set(at) == {i for i, _, _ in made} and list(at.values()) == sorted(at.values()) and 0 <= min(at.values()) and max(at.values()) <= 1
    assert corpus_pipeline.source_mixing(spark, d, str(tmp_path)).count() == 203
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix(d.filter("doc_id = 901")).count() == 1


def test_pipeline_order(spark, tmp_path):
    """The tokens come in the order of the curriculum, over partitions of different size."""
    rng = np.random.default_rng(19)
    made = [(i, prose(rng, 400 if i % 3 else 20), "en", f"s{i % 3}", 1) for i in range(90)]
    spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = [r["doc_id"] for r in mixing.mix(corpus_pipeline.personal_data(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)), least_epochs=1.0, most_epochs=1.0).collect()]
    rows = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "position").collect()
    assert [r["doc_id"] for r in rows] == want and len(want) == 90
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def test_language(spark, none):
    rng = np.random.default_rng(8)
    words = {x: ["".join(rng.choice(list(a), 5)) for _ in range(200)] for x, a in (("aa", "abcdefgh"), ("bb", "ghijklmn"), ("cc", "αβγδεζ"))}
    made = [(i, " ".join(rng.choice(words[x], 30)), x) for i, x in enumerate(["aa", "bb", "cc"] * 60)]
    d = spark.createDataFrame([*made, (900, None, "aa"), (901, "", "bb"), (902, made[0][1], None)], "doc_id bigint, text string, lang string")
    f = langid.train(d.filter("doc_id < 90"))
    got = {r["doc_id"]: r["language"] for r in langid.identify(d, f).collect()}
    assert sum(got[i] == x for i, _, x in made[90:]) >= 88 and got[900] == got[901] == "und" and got[902] == "aa"
    assert langid.identify(none, f).count() == 0 and {r["language"] for r in langid.identify(d, langid.train(none)).collect()} == {"und"}
    for j in range(3):  # the filter has all of its n-grams
        g, _ = langid.grams(np.frombuffer(made[j][1].encode(), np.uint8), np.array([0, len(made[j][1].encode())]), f.params.n)
        assert len(g)


def test_many_languages(spark):
    """More languages than bits of a word, and one with a single document."""
    rng = np.random.default_rng(20)
    words = {f"l{x:03}": ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(40)] for x in range(130)}
    made = [(i, " ".join(rng.choice(words[x], 60)), x) for i, x in enumerate([*words] * 4)] + [(9000, "zzzyxwv uuzwxyz vvwwxzy", "one")]
    d = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    f = langid.train(d)
    got = {r["doc_id"]: r["language"] for r in langid.identify(d, f).collect()}
    assert len(f.languages) == 131 and sum(got[i] == x for i, _, x in made) >= 515 and got[9000] == "one"


def test_pipeline(spark, docs, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    want = sorted((r["doc_id"], r["n_tokens"]) for r in bpe.encode(now).collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def jaccard_groups(sets, threshold=0.5):
    """doc_id -> least id of its group, by all pairs."""
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    size = Counter(root(i) for i in sets)
    return {i: root(i) for i in sets if size[root(i)] > 1}


def shingle_set(t):
    w = t.lower().split()
    return {tuple(w[p : p + 3]) for p in range(max(1, len(w) - 2))}


def test_near_duplicate_groups_against_all_pairs(spark, monkeypatch):
    """A large group of exact copies, chains, an id with two texts that ties groups, and blocks of few members."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(31)
    hot = prose(rng, 60)
    made = [(i, hot) for i in range(1000, 1040)] + [(i, hot + f" more{i}") for i in range(2000, 2012)]
    chain = prose(rng, 60, 5000).split()
    made += [(3000 + k, " ".join(chain[: 60 - 4 * k] + [f"x{k}y{j}" for j in range(4 * k)])) for k in range(8)]
    lone = [prose(rng, 40, 9000) for _ in range(30)]
    made += [(4000 + k, t) for k, t in enumerate(lone)]
    made += [(10, lone[3]), (10, hot.upper()), (11, lone[7]), (11, lone[7])]
    d = spark.createDataFrame(made, "doc_id bigint, text string").repartition(5)
    sets = defaultdict(list)
    for i, t in made:
        sets[i].append(shingle_set(t))
    want = jaccard_groups(sets)
    got = {r["doc_id"]: r["group_id"] for r in neardup.groups(d).collect()}
    assert got == want and want[1039] == 10 and want[4007] == 11
    clash = d.selectExpr("*", "1 AS copy", "2 AS id", "3 AS row", "7 AS __copy")
    kept = neardup.keep_one(clash)
    assert kept.columns == clash.columns and {(r["copy"], r["id"], r["row"], r["__copy"]) for r in kept.collect()} == {(1, 2, 3, 7)}
    left = Counter(r["doc_id"] for r in kept.collect())
    assert set(left) == {i for i in sets if want.get(i, i) == i}


def test_signatures_of_long_texts():
    """Unrelated texts of any length share hardly a coordinate; coordinates estimate the similarity."""
    rng = np.random.default_rng(32)
    p = neardup.Params()
    for n in (1000, 100_000, 1_000_000):
        x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = neardup.signatures(x, np.array([0, n, 2 * n]), p)
        assert (a == b).mean() < 0.02
    agree = []
    for _ in range(40):
        both, own = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
        a, b = neardup.signatures(np.concatenate([both, own[0], both, own[1]]), np.array([0, 35_000, 70_000]), p)
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.75) < 0.03
    values = neardup.permutations(160, 3)
    low = np.arange(1 << 20)
    assert len(np.unique(values[1][low, 7])) == 1 << 20 and len(np.unique(values[2] & 4095)) == 4096  # permutations
