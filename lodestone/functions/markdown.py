"""Markdown to prose: a scanner of blocks, then one of inline marks, then one of emphasis.

What stays is what a reader sees as text: headings, list items, quotes, cells,
link labels, code words.  Fenced blocks, comments, tags, images, link targets
and drawn lines go.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = " \t"
_FENCES = ("```", "~~~")
_MARK = re.compile(r"[<!\[`|]")


def _without_fences(lines: list[str]) -> list[str]:
    """Fenced blocks are one empty line; a fence that never closes loses its own line only."""
    out: list[str] = []
    at = 0
    while at < len(lines):
        bare = lines[at].strip(_BLANK)
        fence = next((f for f in _FENCES if bare.startswith(f)), None)
        if fence is None:
            out.append(lines[at])
        else:
            ends = (i for i in range(at + 1, len(lines)) if lines[i].strip(_BLANK) == fence)
            at = next(ends, at)
            out.append("")
        at += 1
    return out


class _Inline:
    """Scans a text once; each mark that begins with a known character has its own handler."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at = 0
        self.out: list[str] = []
        self.handlers: dict[str, Callable[[], bool]] = {"<": self._angle, "!": self._image, "[": self._bracket, "`": self._tick, "|": self._pipe}

    def run(self) -> str:
        n = len(self.text)
        while self.at < n:
            mark = _MARK.search(self.text, self.at)
            end = mark.start() if mark else n
            if end > self.at:
                self._take(self.text[self.at : end])
                self.at = end
            elif not self.handlers[self.text[end]]():
                self.out.append(self.text[end])
                self.at += 1
        return "".join(self.out)

    def _take(self, plain: str) -> None:
        """A run without marks; the blanks at its end one by one, as a cell's edge may take them off."""
        bare = plain.rstrip(_BLANK)
        if bare:
            self.out.append(bare)
        self.out += plain[len(bare) :]

    def _angle(self) -> bool:
        rest = self.text.startswith
        if rest("<!--", self.at):
            end = self.text.find("-->", self.at + 4)
            size = 3
        else:
            name = self.at + 1 + rest("/", self.at + 1)
            if not (self.text[name : name + 1].isascii() and self.text[name : name + 1].isalpha()):
                return False
            end = self.text.find(">", name)
            size = 1
        if end < 0:
            return False
        self.at = end + size
        return True

    def _closing(self, opening: int, left: str, right: str) -> int:
        """Where the bracket at ``opening`` closes, brackets within it counted; -1 if nowhere."""
        depth = 0
        for i in range(opening, len(self.text)):
            depth += (self.text[i] == left) - (self.text[i] == right)
            if not depth:
                return i
        return -1

    def _target(self, after: int) -> int:
        """End of the (target) or [reference] that stands at ``after``; -1 if none does."""
        follows = self.text[after : after + 1]
        if follows == "(":
            return self.text.find(")", after)
        return self.text.find("]", after) if follows == "[" else -1

    def _image(self) -> bool:
        if self.text[self.at + 1 : self.at + 2] != "[":
            return False
        label = self._closing(self.at + 1, "[", "]")
        end = self._target(label + 1) if label >= 0 else -1
        if end < 0:
            return False
        self.at = end + 1
        return True

    def _bracket(self) -> bool:
        label = self._closing(self.at, "[", "]")
        if label < 0:
            return False
        if self._is_definition(label):
            end = self.text.find("\n", label)
            self.at = len(self.text) if end < 0 else end
            return True
        end = self._target(label + 1)
        if end < 0:
            return False
        self.out.append(_Inline(self.text[self.at + 1 : label]).run())
        self.at = end + 1
        return True

    def _is_definition(self, label: int) -> bool:
        """``[name]: target`` alone at the beginning of a line."""
        if label == self.at + 1 or self.text[label + 1 : label + 2] != ":":
            return False
        begin = self.text.rfind("\n", 0, self.at) + 1
        line_end = self.text.find("\n", label)
        rest = self.text[label + 2 : None if line_end < 0 else line_end]
        return not self.text[begin : self.at].strip(_BLANK) and bool(rest.strip(_BLANK))

    def _tick(self) -> bool:
        self.at += 1
        return True

    def _pipe(self) -> bool:
        """A cell's edge and the blanks around it are one blank."""
        if _is_drawn(self._line()):
            return False  # drawn lines go as a whole, later
        while self.out and self.out[-1] in (" ", "\t"):
            self.out.pop()
        self.out.append(" ")
        self.at += 1
        while self.text[self.at : self.at + 1] in (" ", "\t"):
            self.at += 1
        return True

    def _line(self) -> str:
        end = self.text.find("\n", self.at)
        return self.text[self.text.rfind("\n", 0, self.at) + 1 : len(self.text) if end < 0 else end]


def _is_drawn(line: str) -> bool:
    """A rule, an underline of a heading, or the row of dashes below a table's head."""
    bare = line.strip(_BLANK)
    if len(bare) >= 3 and len(set(bare)) == 1 and bare[0] in "=-*_":
        return True
    cells = bare.removeprefix("|").removesuffix("|").split("|")
    dashes = [c.strip(_BLANK).removeprefix(":").removesuffix(":") for c in cells]
    return all(len(d) >= 2 and set(d) == {"-"} for d in dashes)


def _lead_taken_off(line: str) -> str:
    """A line without the mark of a heading, a quote or a bullet at its beginning, each at most once and in that order."""
    bare = line.lstrip(_BLANK)
    hashes = len(bare) - len(bare.lstrip("#"))
    if 1 <= hashes <= 6 and bare[hashes : hashes + 1] in (" ", "\t"):
        line = bare = bare[hashes:].lstrip(_BLANK)
    if bare.startswith(">"):
        line = bare[1:]
        line = line[1:] if line[:1] in (" ", "\t") else line
        bare = line.lstrip(_BLANK)
    if bare[:1] in ("-", "*", "+") and bare[1:2] in (" ", "\t"):
        line = bare[1:].lstrip(_BLANK)
    return line


def _unwrapped(line: str, mark: str, tight: bool) -> str:
    """Pairs of a mark taken off within a line; tight ones touch what they hold on both sides."""
    out, at = [], 0
    while (opened := line.find(mark, at)) >= 0:
        first = opened + len(mark)
        closed = -1
        if not tight or (first < len(line) and not line[first].isspace()):
            closed = line.find(mark, first)
            while tight and closed > 0 and (closed == first or line[closed - 1].isspace()):
                closed = line.find(mark, closed + 1)
        if closed < 0:
            out.append(line[at:first])
            at = first
        else:
            out += [line[at:opened], line[first:closed]]
            at = closed + len(mark)
    return "".join([*out, line[at:]])


def strip_markdown(text: str) -> str:
    """The prose of a Markdown text."""
    inline = _Inline("\n".join(_without_fences(text.split("\n")))).run()
    out = []
    for line in inline.split("\n"):
        if _is_drawn(line):
            out.append("")
            continue
        line = _lead_taken_off(line)
        for mark in ("**", "__"):  # a single underscore is part of a name
            line = _unwrapped(line, mark, tight=False)
        out.append("" if _is_drawn(line) else _unwrapped(line, "*", tight=True))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _strip(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else strip_markdown(t))


def markdown_to_text(c: Column) -> Column:
    """Prose of a Markdown column; null stays null."""
    return _strip(c)


__all__ = ["markdown_to_text", "strip_markdown"]
