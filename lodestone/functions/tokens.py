"""Tokens of whole texts over Arrow batches: what ``text.tokenise`` gives, a word of its own looked at once.

A text's words are found and counted by compiled code; only distinct words
are taken apart, and what came of them is kept for the next text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import compress
from operator import mul
from string import ascii_lowercase, ascii_uppercase

from lodestone.functions.text import FINAL_LETTERS, PARTICLES, PLAIN_LETTERS, STOP_WORDS

#: Words whose tokens a worker keeps.
KEPT_WORDS = 200_000
_WORD = re.compile("[.0-9A-Z_a-z\u0590-\u05ff]+")
_NUMBER = re.compile(r"[0-9][0-9.]*")
_LATIN = re.compile(r"[A-Za-z0-9_.]*")
_LOOSE = {**dict.fromkeys([*range(0x591, 0x5C8), *map(ord, "\"'״׳")]), **str.maketrans(FINAL_LETTERS, PLAIN_LETTERS)}
_PEEL = re.compile(f"(?:{'|'.join(PARTICLES)})(?=[\\s\\S]{{3}})")
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_STOP = frozenset(STOP_WORDS)


def _peeled(word: str) -> str:
    m = _PEEL.match(word)
    return word[m.end() :] if m else word


def terms_of(raw: str) -> tuple[str, ...]:
    """Tokens of one raw word, as ``text.word_tokens``."""
    if _NUMBER.fullmatch(raw):
        return (raw.removesuffix("."),)
    word = raw.strip(".").lower().translate(_LOOSE)
    if len(word) < 2:
        return ()
    if _LATIN.fullmatch(raw):
        return (word,)
    if word in _STOP:
        return ()
    once = _peeled(word)
    return tuple(v for v in dict.fromkeys((word, once, _peeled(once))) if len(v) >= 2)


class _Kept(dict):
    """What ``make`` gives for a word, kept; emptied when it holds ``KEPT_WORDS``."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, raw: str):
        value = self[raw] = self.make(raw)
        return value

    def trim(self) -> None:
        if len(self) > KEPT_WORDS:
            self.clear()


def _words(text: str) -> Counter:
    """Raw words of a text, Latin letters lower-cased, with the number of times that they occur."""
    return Counter(_WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER)))


class Tokens:
    """Counts the tokens of texts; with ``asked``, those that it holds by themselves and the others together."""

    def __init__(self, asked: frozenset[str] | None = None) -> None:
        self.terms = _Kept(terms_of)
        self.number = _Kept(lambda raw: len(terms_of(raw)))
        self.wanted = _Kept(lambda raw: tuple(t for t in terms_of(raw) if t in asked))

    def count(self, text: str) -> dict[str, int]:
        """Each token of a text with the number of times that it occurs."""
        self.terms.trim()
        known, found = self.terms, {}
        for raw, n in _words(text).items():
            for term in known[raw]:
                found[term] = found.get(term, 0) + n
        return found

    def count_asked(self, text: str) -> tuple[int, dict[str, int]]:
        """The number of all tokens, and the asked ones as ``count`` gives them."""
        self.number.trim()
        self.wanted.trim()
        words, found = _words(text), {}
        length = sum(map(mul, words.values(), map(self.number.__getitem__, words)))
        for raw, n in compress(words.items(), map(self.wanted.__getitem__, words)):
            for term in self.wanted[raw]:
                found[term] = found.get(term, 0) + n
        return length, found
