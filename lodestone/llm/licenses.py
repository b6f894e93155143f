"""License scans by template-markup matching.

Licenses and notices are templates whose markup tells optional regions
(``<<beginOptional>> ... <<endOptional>>``) and replaceable ones
(``<<var;max=N>>``: up to N words; ``<<alt;a b|c>>``: one of the wordings) from
mandatory wording.  A template compiles into a token automaton; a text is
accepted where its words take the automaton to its end, so that the mandatory
wording matches exactly.  Of templates that are accepted from the same word on,
the longest tells the license.  A short notice behind a denial ("not licensed
under ...") is none.  Fixed base phrases are found beside that.

The templates are in ``license_texts``: full texts, notices, and the families
and tags that are built by rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import byte_texts, id_and_text
from lodestone.llm.license_texts import templates

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A grant behind one of these words, up to NEAR words before it, isn't one (fixed values).
DENIALS = frozenset(b"not never nor isn aren wasn cannot without neither no".split())
NEAR = 3
SHORT = 20

#: Separators become blanks, A-Z small letters, all else stays: words of digits, letters and bytes from 0x80.
_TABLE = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;max=\d+|alt;[^>]*)>>")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbers; ``steps`` by word, ``any_word`` for replaceable regions, ``free`` without a word."""

    steps: list[dict[bytes, int]] = field(default_factory=list)
    any_word: dict[int, int] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)
    end: int = 0
    lead: bytes = b""

    def new(self) -> int:
        self.steps.append({})
        return len(self.steps) - 1

    def chain(self, at: int, words: list[bytes]) -> int:
        for w in words:
            to = self.new()
            self.steps[at][w] = to
            at = to
        return at

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accepts_at(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words from ``at``, or None."""
        states, last = self.close({0}), None
        while states:
            if self.end in states:
                last = at
            if at >= len(words):
                break
            w = words[at]
            states = self.close({s.get(w) for s in (self.steps[i] for i in states)} - {None} | {self.any_word[i] for i in states if i in self.any_word})
            at += 1
        return last


def compile_template(text: str) -> Automaton:
    """Automaton of a template; its lead is the longest run of mandatory words, by which texts are looked up."""
    own = Automaton()
    at = own.new()
    opened: list[int] = []
    runs: list[list[bytes]] = [[]]
    for k, part in enumerate(_MARKUP.split(text)):
        if k % 2 == 0:
            words = words_of(part.encode())
            for w in words:
                nxt = own.chain(at, [w])
                at = nxt
            if not opened:
                runs[-1] += words
            continue
        kind, _, rest = part.partition(";")
        if kind == "beginOptional":
            fresh = own.new()
            own.free.setdefault(at, []).append(fresh)
            opened.append(at)
            at = fresh
        elif kind == "endOptional":
            start, end = opened.pop(), own.new()
            own.free.setdefault(at, []).append(end)
            own.free.setdefault(start, []).append(end)
            at = end
        elif kind == "var":
            end = own.new()
            own.free.setdefault(at, []).append(end)
            for _ in range(int(rest.partition("=")[2])):
                nxt = own.new()
                own.any_word[at] = nxt
                own.free.setdefault(nxt, []).append(end)
                at = nxt
            at = end
        else:
            end = own.new()
            for wording in rest.split("|"):
                fresh = own.new()
                own.free.setdefault(at, []).append(fresh)
                own.free.setdefault(own.chain(fresh, words_of(wording.encode())), []).append(end)
            at = end
        if not opened:
            runs.append([])
    own.end = at
    own.lead = b" " + b" ".join(max(runs, key=lambda r: len(b" ".join(r)))) + b" "
    return own


@dataclass
class Found:
    n_words: int
    places: list[tuple[int, str]]
    accepted: list[tuple[str, int, int]]

    @property
    def base_labels(self) -> set[str]:
        return {label for _, label in self.places}

    @property
    def labels(self) -> set[str]:
        return self.base_labels | {label for label, _, _ in self.accepted}

    @property
    def score(self) -> float:
        """1 where a template is accepted, 0.5 where only a base phrase stands, else 0."""
        return 1.0 if self.accepted else 0.5 if self.places else 0.0


@lru_cache(maxsize=1)
def automata() -> list[tuple[bytes, list[tuple[str, Automaton, frozenset[bytes]]]]]:
    """(gate, [(label, automaton, words it may begin with)]): all are looked for only where their gate, a word of the lead, stands."""
    by_gate: dict[bytes, list[tuple[str, Automaton, frozenset[bytes]]]] = {}
    for label, text in templates():
        own = compile_template(text)
        firsts = frozenset(w for s in own.close({0}) for w in own.steps[s])
        gate = max(own.lead.split(), key=lambda w: (len(w), w))
        by_gate.setdefault(b" " + gate + b" ", []).append((label, own, firsts))
    return list(by_gate.items())


def _accepted(words: list[bytes], joined: bytes) -> list[tuple[str, int, int]]:
    """(label, first word, end word) of accepted templates, the longest from each first word."""
    where: dict[bytes, list[int]] = {}
    best: dict[int, tuple[int, set[str]]] = {}
    for gate, group in automata():
        if gate not in joined:
            continue
        for label, own, firsts in group:
            if own.lead not in joined:
                continue
            if not where:
                for i, w in enumerate(words):
                    where.setdefault(w, []).append(i)
            done = 0
            for i in sorted(i for w in firsts for i in where.get(w, ())):
                if i < done or (end := own.accepts_at(words, i)) is None:
                    continue
                done = end
                if end - i < SHORT and DENIALS.intersection(words[max(0, i - NEAR) : i]):
                    continue
                known = best.get(i, (0, set()))
                if end > known[0]:
                    best[i] = (end, {label})
                elif end == known[0]:
                    known[1].add(label)
    return sorted((label, i, end) for i, (end, labels) in best.items() for label in labels)


def scan(data: bytes) -> Found:
    """Base places and accepted templates (label, first word, end word) of a whole text."""
    words = words_of(data)
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        key = b" " + phrase.encode() + b" "
        at, word, seen = joined.find(key), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            places.append((word, label))
            at = joined.find(key, at + 1)
    return Found(len(words), sorted(places), _accepted(words, joined))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document with base places and labels, and the templates' labels.

    Null and empty texts have no words: no places, null first and last word,
    empty labels, score 0.  Repeated rows come back repeated; a null doc_id
    stays null; no rows in, no rows out.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in byte_texts(batch):
                f = scan(data)
                first, last = (f.places[0][0], f.places[-1][0]) if f.places else (None, None)
                rows.append((f.n_words, len(f.places), first, last, ",".join(sorted(f.base_labels)), ",".join(sorted(f.labels)), f.score))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return id_and_text(docs).mapInArrow(run, schema)
