import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.functions import markup, text
from loomtext.functions.metadata import MetadataError, normalized
from loomtext.operators.chunks import SizeChunker, TokenChunker


def test_slugs_and_hierarchy():
    assert text.slug("A---B___C") == "a-b___c" and text.slug("!!!") == "section"
    parts = text.sections("intro\n\n# A\n\none\n\n## B\n\ntwo\n\n## B\n\n# A\n```\n# no\n```\n")
    assert [p.anchor for p in parts] == ["__root__", "a", "a/b", "a/b~2", "a~2"]
    assert parts[2].parent == "a" and parts[2].path == ["A", "B"] and parts[4].content.startswith("```")
    assert text.sections(" \n") == []


@pytest.mark.parametrize(("body", "most", "check"), [
    ("```\n" + "x" * 60 + "\n```", 40, lambda p: len(p) == 1),
    ("\n".join(f"| a{i} | b{i} |" for i in range(5)), 35, lambda p: len(p) >= 2 and all(x.text.endswith("|") for x in p)),
    ("# Title\n\nfirst paragraph\n\nsecond paragraph", 30, lambda p: "first paragraph" in p[0].text and "# Title" in p[0].text),
    ("- one one one one one\n- two two two two two\n- three three three", 45, lambda p: all(x.text.startswith("-") for x in p)),
    ("A" * 10 + "\n\n" + "B" * 10, 12, lambda p: [x.text for x in p] == ["A" * 10, "B" * 10]),
])
def test_safe_cuts(body, most, check):
    assert check(text.size_pieces(body, most))


def test_overlap_and_offsets():
    body = "alpha beta gamma delta"
    for p in text.size_pieces(body, 8, 2):
        assert p.text.endswith(body[p.start : p.end])


def _slow(rest: str, limit: int) -> int:
    """The same cut from the whole remainder at once."""
    scan = text.Scanner(rest)
    spans, cuts = scan.context(0, len(rest))
    safe = lambda i: i > 0 and not any(a < i < b for a, b in spans)
    if c := [m.start() for m in re.finditer(r"\n\n+", rest) if m.start() <= limit and safe(m.start())]:
        return c[-1]
    if c := [x for x in cuts if x <= limit and safe(x)]:
        return c[-1]
    i = rest.rfind("\n", 0, limit)
    if i > 0 and safe(i):
        return i
    best = 0
    for m in re.finditer(r"(?<=[.!?])\s+", rest):
        if m.end() > limit or not safe(m.end()):
            break
        best = m.end()
    if best:
        return best
    return limit if safe(limit) else next(b for a, b in spans if a < limit < b)


def test_window_is_enough():
    rng = random.Random(1)
    bits = ["word ", "end. ", "\n", "\n\n", "| a | b |\n", "- item ", "\n- ", "```\n", "~~~\n", "# H\n", "x" * 9, "? ", "\n1. "]
    for _ in range(600):
        body = "".join(rng.choice(bits) for _ in range(rng.randint(5, 60))).strip()
        limit, at, want = rng.randint(5, 60), 0, []
        while at < len(body):
            rest = body[at:]
            if len(rest) <= limit:
                want.append((at, at + len(rest.rstrip())))
                break
            n = max(1, _slow(rest, limit))
            piece = body[at : at + n]
            if piece.strip():
                want.append((at, at + len(piece.rstrip())))
            tail = body[at + n :]
            at = max(len(body) - len(tail.lstrip()), at + 1)
        scan = text.Scanner(body)
        assert scan.pieces(lambda s: limit if scan.size - s > limit else None, False) == want, (body, limit)  # noqa: B023


@settings(max_examples=30, deadline=None)
@given(st.text("0123456789 ", min_size=300, max_size=2000), st.integers(20, 300))
def test_length_is_kept(body, most):
    pieces = text.size_pieces(body, most)
    assert all(1 <= len(p.text) <= most for p in pieces)
    assert "".join("".join(p.text.split()) for p in pieces) == "".join(body.split())


@settings(max_examples=30, deadline=None)
@given(st.text("ab \n.", min_size=1, max_size=400), st.integers(1, 9))
def test_word_counter_is_its_function(body, most):
    assert text.token_pieces(body, most) == text.token_pieces(body, most, counter=lambda t: len(t.split()))


def test_parameters():
    for bad in ({"max_chars": 0}, {"overlap_chars": -1}, {"overlap_chars": 1500}, {"min_chars": -1}):
        with pytest.raises(ValueError):
            SizeChunker(**bad)
    with pytest.raises(ValueError):
        TokenChunker(max_tokens=3, overlap_tokens=3)


def test_markup():
    title, body = markup.html("<title> T  t </title><h1>Head</h1><p>a <b>b</b><br>c</p><ul><li>x</li></ul><table><tr><th>h</th></tr><tr><td>1</td><td>2</td></tr></table><script>no</script><pre>k</pre>tail")
    assert title == "T t" and body == "# Head\n\na b\nc\n\n- x\n\n| h |\n| --- |\n| 1 |\n\n```\nk\n```\n\ntail"
    title, fields, body = markup.rst(":author: me\n\n=====\nTop\n=====\n\nSub\n---\ntext")
    assert (title, fields) == ("Top", {"author": "me"}) and "# Top" in body and "## Sub" in body
    fields, body = markup.front_matter("---\ntitle: X\ndate: 2024-01-02\n---\n\nbody\n")
    assert body == "body" and normalized(fields) == {"title": "X", "date": "2024-01-02"}
    for bad in ({"loomtext.x": 1}, {"a": float("nan")}, {1: 2}, {"a": object()}):
        with pytest.raises(MetadataError):
            normalized(bad)


def test_second_title_of_a_page():
    title, body = markup.html("<title>Page</title><svg><title>Picture</title></svg><p>after</p>")
    assert title == "Page" and body == "after"


def test_work_follows_the_length():
    import time

    def took(f, n):
        began = time.perf_counter()
        f(n)
        return time.perf_counter() - began

    fenced = lambda n: text.sections("# H\n```\nx\n```\n" * n)
    plain = lambda n: text.size_pieces("word " * n, 1500)
    for f, n in ((fenced, 1500), (plain, 60_000)):
        f(n // 4)
        assert took(f, 4 * n) < 8 * took(f, n) + 0.2  # squares would be 16 times
    assert len(text.sections("# H\n```\n# no\n```\n" * 50)) == 50
