"""HTML and reStructuredText to Markdown, and front matter; one text at a time, pure Python."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_RUN = re.compile(r"\s+")
_FIELD = re.compile(r"^:([^:]+):\s*(.*)$")
_HEADS = {f"h{n}": n for n in range(1, 7)}
_SILENT = {"script", "style", "noscript"}


def tidy(text: str) -> str:
    """Lines with single blanks, without the empty ones."""
    return "\n".join(x for x in (_RUN.sub(" ", line).strip() for line in text.splitlines()) if x)


class _Blocks(HTMLParser):
    """Where text goes depends on what is open; `sink` finds the innermost buffer by a fixed order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = self.h1 = None
        self.silent = self.pre = self.code = 0
        self.buf: dict[str, list[str]] = {"free": []}
        self.level: int | None = None
        self.rows: list[list[str]] | None = None
        self.row: list[str] | None = None

    def emit(self, block: str) -> None:
        if block:
            self.out.append(block)

    def take(self, name: str) -> str:
        return tidy("".join(self.buf.pop(name)))

    def free(self) -> None:
        self.emit(tidy("".join(self.buf["free"])))
        self.buf["free"] = []

    def sink(self, order: tuple[str, ...]) -> list[str]:
        return next(self.buf[k] for k in order if k in self.buf and (k != "code" or self.pre or self.code))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        if self.silent or tag in _SILENT:
            return
        if tag == "title":
            self.buf["title"] = []
        elif tag == "br":
            self.sink(("code", "head", "p", "li", "free")).append("\n")
        elif tag in _HEADS:
            self.free()
            self.level, self.buf["head"] = _HEADS[tag], []
        elif tag in ("p", "li"):
            self.free()
            self.buf[tag] = []
        elif tag == "table":
            self.free()
            self.rows, self.row = [], None
            self.buf.pop("cell", None)
        elif tag == "tr" and self.rows is not None:
            self.row = []
        elif tag in ("th", "td") and self.rows is not None and self.row is not None:
            self.buf["cell"] = []
        elif tag in ("pre", "code"):
            self.free()
            if not self.pre and not self.code:
                self.buf["code"] = []
            setattr(self, tag, getattr(self, tag) + 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
            return
        if self.silent:
            return
        if tag == "title" and "title" in self.buf:
            text = self.take("title")  # a second title (in an inline image) must not keep the buffer open
            self.title = self.title or text or None
        elif tag in _HEADS and self.level is not None:
            if text := self.take("head"):
                self.emit(f"{'#' * self.level} {text}")
                self.h1 = text if self.level == 1 and self.h1 is None else self.h1
            self.level = None
        elif tag in ("p", "li") and tag in self.buf:
            text = self.take(tag)
            self.emit(f"- {text}" if text and tag == "li" else text)
        elif tag in ("th", "td") and self.rows is not None and "cell" in self.buf:
            text = self.take("cell")
            if self.row is not None:
                self.row.append(text)
        elif tag == "tr" and self.rows is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.rows is not None:
            self.emit(pipe_table(self.rows))
            self.rows = self.row = None
            self.buf.pop("cell", None)
        elif tag in ("pre", "code"):
            setattr(self, tag, max(0, getattr(self, tag) - 1))
            if not self.pre and not self.code:
                self.emit("```\n" + "".join(self.buf.get("code", [])).strip("\n") + "\n```")
                self.buf["code"] = []

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.sink(("title", "cell", "code", "head", "p", "li", "free")).append(data)


def pipe_table(rows: list[list[str]]) -> str:
    if not rows or not rows[0]:
        return ""
    wide = len(rows[0])
    body = [rows[0], ["---"] * wide, *[(r + [""] * wide)[:wide] for r in rows[1:]]]
    return "\n".join("| " + " | ".join(r) + " |" for r in body)


def html(raw: str) -> tuple[str | None, str]:
    """(title or first h1, Markdown)."""
    p = _Blocks()
    p.feed(raw)
    p.close()
    p.free()
    return p.title or p.h1, "\n\n".join(p.out)


def _ruled(line: str) -> bool:
    return bool(line) and not line[0].isalnum() and len(set(line)) == 1


def rst(raw: str) -> tuple[str | None, dict[str, str], str]:
    """(title, leading fields, Markdown): headings by their adornments, in order of first use."""
    lines = raw.splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
    end, fields = at, {}
    while end < len(lines) and (m := _FIELD.match(lines[end])) and m[1].strip():
        fields[m[1].strip()] = m[2].strip()
        end += 1
    if fields:
        lines = lines[:at] + lines[end + (end < len(lines) and not lines[end].strip()) :]
    bare = [x.strip() for x in lines]
    out, levels, first, i = [], {}, None, 0
    while i < len(lines):
        text = mark = None
        used = 1
        if i + 2 < len(lines) and bare[i + 1] and _ruled(bare[i]) and bare[i] == bare[i + 2] and len(bare[i]) >= len(bare[i + 1]):
            text, mark, used = bare[i + 1], bare[i][0], 3
        elif i + 1 < len(lines) and bare[i] and _ruled(bare[i + 1]) and len(bare[i + 1]) >= len(bare[i]):
            text, mark, used = bare[i], bare[i + 1][0], 2
        if mark is None:
            out.append(lines[i])
        else:
            level = levels.setdefault(mark, len(levels) + 1)
            out.append(f"{'#' * level} {text}")
            first = text if level == 1 and first is None else first
        i += used
    given = next((v for k, v in fields.items() if k.lower() == "title" and v), None)
    return given or first, fields, "\n".join(out) if fields or levels or raw else raw


def front_matter(raw: str) -> tuple[dict, str]:
    """(fields, body) of a text that may begin with YAML between lines of three hyphens."""
    m = re.match(r"\s*---[ \t]*\r?\n(.*?)^---[ \t]*$(.*)", raw, re.S | re.M)
    if not m:
        return {}, raw.strip()
    import yaml

    found = yaml.safe_load(m[1])
    return (found if isinstance(found, dict) else {}), m[2].strip()


def markdown_title(fields: dict, body: str) -> str | None:
    given = fields.get("title")
    if isinstance(given, str) and given.strip():
        return given.strip()
    return next((x.strip()[2:].strip() for x in body.splitlines() if x.strip().startswith("# ")), None)
