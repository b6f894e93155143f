"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question whose
values were changed still has the same template.  Windows of five template
words are joined by hash with those of the benchmark; a document that holds
``share`` of an item's windows, with slot values that agree from window to
window, is a leak of that item.

An item names its slots; a document's letter case and sentence starts don't.  A
word of a document that may be a name is read both as itself and as a name, in
all ways that leave a window three literals.

The benchmark side is a query set against all rows: it is taken in blocks of
at most ``block_windows`` windows, each sent to the executors, so that what is
sent has a fixed bound however large the benchmark is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import id_and_text, texts

WINDOW = 5
SHARE = 0.8
LITERALS = 3
BLOCK_WINDOWS = 500_000
MEMO = 150_000

#: Units that may follow a number (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec secs min mins h hr hrs hour hours day days week weeks month months year years minute "
    "minutes second seconds metre metres meter meters mile miles foot feet inch inches gram grams kilogram kilograms litre litres liter liters "
    "dollar dollars euro euros cent cents pound pounds percent degrees mph kmh".split()
)
_NUMBER = re.compile(r"[-+$€£]?[0-9][0-9.,:/]*(?:%|st|nd|rd|th)?", re.IGNORECASE)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NUM, NAME, UNIT, FIRST = 1, 2, 3, 16
_CAP, _END, _UNITLIKE = 1 << 40, 1 << 41, 1 << 42
_ID = (1 << 40) - 1
_NOTHING = 1 << 43
_NAMED = 1 << 44
_AROUND = "\"'.,;:!?()[]"
_LEADS = frozenset("-+$€£0123456789")
SLICE = 50_000
#: Words of texts that are looked at together, or one text.
TOGETHER = 1 << 15


def _describe(token: str, vocabulary: dict[str, int], names: set[str]) -> int:
    """A raw word's literal id (0: not in the benchmark) and its marks."""
    core = token if token.isalpha() else token.strip(_AROUND)
    if not core.isalpha():
        core = _EDGE.sub("", core)
    if not core:
        return _NOTHING
    if core[0] in _LEADS and _NUMBER.fullmatch(core):
        return NUM | (_END if token[-1] in ".!?" and not token[-1].isdigit() else 0)
    low = core.lower()
    out = vocabulary.get(low, 0)
    if core[:1].isupper():
        out |= _CAP
    if token[-1] in ".!?:":
        out |= _END
    if low in UNITS:
        out |= _UNITLIKE
    if low in names:
        out |= _NAMED
    return out


def _placed(described: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Literal ids (0: unknown), with numbers and the units after them in the same text replaced."""
    ids = described & _ID
    unit = np.zeros(len(ids), dtype=bool)
    unit[1:] = (ids[:-1] == NUM) & ((described[1:] & _UNITLIKE) != 0)
    if text is not None:
        unit[1:] &= text[1:] == text[:-1]
    return np.where(unit, UNIT, ids)


def _readings(described: np.ndarray, line: np.ndarray) -> list[np.ndarray]:
    """An item's templates: names where it shows them, sentence starts as names too, and no names."""
    ids = _placed(described)
    if not len(ids):
        return []
    start = np.ones(len(ids), dtype=bool)
    start[1:] = (line[1:] != line[:-1]) | ((described[:-1] & _END) != 0)
    capital = ((described & _CAP) != 0) & (ids >= FIRST)
    shown = capital & np.isin(ids, ids[capital & ~start])
    out = [np.where(shown, NAME, ids), np.where(shown | (capital & start), NAME, ids), ids]
    return [x for i, x in enumerate(out) if not any((x == y).all() for y in out[:i])]


def _hashes(ids: np.ndarray, window: int) -> np.ndarray:
    n = len(ids) - window + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(window):
        out = (out ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _masked_hashes(ids: np.ndarray, at: np.ndarray, named: np.ndarray) -> np.ndarray:
    """As ``_hashes``, of the windows at some places, with the words that a row of ``named`` marks read as names."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(named.shape[1]):
        out = (out ^ np.where(named[:, k], NAME, ids[at + k]).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Known:
    """The hashes of the benchmark's windows of one size.

    A table over their first bits, at least 16 times as long, tells most others
    apart before they are looked up.
    """

    def __init__(self, hashes: Iterable[int]) -> None:
        self.sorted = np.array(sorted(hashes), dtype=np.uint64)
        self.shift = np.uint64(64 - max(16, len(self.sorted).bit_length() + 4))
        self.begins = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.begins[self.sorted >> self.shift] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The places of those that are known."""
        at = np.nonzero(self.begins[hashes >> self.shift])[0]
        some = hashes[at]
        return at[self.sorted[np.minimum(np.searchsorted(self.sorted, some), len(self.sorted) - 1)] == some]


@lru_cache
def _masks(window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ways to read words of a window as names, and which of them go: by the words that may be names (as bits) and the slots besides."""
    spare = window - LITERALS
    masks = np.array([m for m in np.ndindex(*[2] * window) if 0 < sum(m) <= spare], dtype=bool).reshape(-1, window)
    bits = masks @ (1 << np.arange(window))
    open_ = np.arange(1 << window)
    goes = ((bits[None, :] & ~open_[:, None]) == 0)[:, None, :] & (np.arange(max(0, spare))[:, None] + masks.sum(axis=1) <= spare)[None]
    return masks, goes


def _words(text: str) -> tuple[list[str], np.ndarray]:
    """Words, and the number of each one's line."""
    lines = [line.split() for line in text.split("\n")]
    return [w for line in lines for w in line], np.repeat(np.arange(len(lines)), [len(line) for line in lines])


class Memo(dict):
    """Descriptions of raw words, remembered up to a bound."""

    def __init__(self, vocabulary: dict[str, int], names: set[str]) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.names = names

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        if word.isalpha() and (low := word.lower()) not in self.vocabulary and low not in UNITS:
            out = 0  # no mark matters of a word that the benchmark doesn't have
        else:
            out = _describe(word, self.vocabulary, self.names)
        self[word] = out
        return out


@dataclass
class Item:
    item_id: int
    ids: np.ndarray
    words: list[str]
    window: int
    counted: set[int]
    entry: int


class Templates:
    """Template windows of a block of benchmark items, ready to match texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        for _, text in items:
            for w in text.split():
                low = _EDGE.sub("", w).lower()
                if low and not _NUMBER.fullmatch(low):
                    self.vocabulary.setdefault(low, FIRST + len(self.vocabulary))
        self.names: set[str] = set()
        self.memo = Memo(self.vocabulary, self.names)
        self.items: list[Item] = []
        self.by_window: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for entry, (item_id, text) in enumerate(items):
            words, described, line = self._described(text)
            window = min(WINDOW, len(words))
            for ids in _readings(described, line):
                self.names.update(_EDGE.sub("", words[i]).lower() for i in np.nonzero(ids == NAME)[0])
                counted = {q for q in range(len(ids) - window + 1) if (ids[q : q + window] >= FIRST).sum() >= LITERALS}
                if not counted:
                    continue
                hashes = _hashes(ids, window)
                for q in counted:
                    self.by_window[window][int(hashes[q])].append((len(self.items), q))
                self.items.append(Item(item_id, ids, words, window, counted, entry))
        self.memo.clear()  # the names are known only now
        self.by_window = {w: dict(h) for w, h in self.by_window.items()}
        self.known = {w: Known(h) for w, h in self.by_window.items()}

    def _described(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words that have a letter or digit, what they are, and their lines."""
        words, line = _words(text)
        described = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        keep = described != _NOTHING
        if not keep.all():
            words = [words[i] for i in np.nonzero(keep)[0]]
            described, line = described[keep], line[keep]
        return words, described, line

    def _hits(self, ids: np.ndarray, both: np.ndarray, window: int, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, place, hash) of each window within a text that the benchmark has, under every reading of its words."""
        known, spare = self.known[window], window - LITERALS

        def found(at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
            hit = known.places(hashes)
            return zip(text[at[hit]].tolist(), at[hit].tolist(), hashes[hit].tolist())

        n = len(ids) - window + 1
        whole = text[window - 1 :] == text[:n]
        slots = np.concatenate([[0], np.cumsum(ids < FIRST)])
        slots = slots[window:] - slots[:-window]
        at = np.nonzero(whole & (slots <= spare))[0]
        if len(at):
            yield from found(at, _hashes(ids, window)[at])
        open_ = np.zeros(n, dtype=np.int64)
        for k in range(window):
            open_ |= both[k : k + n].astype(np.int64) << k
        at = np.nonzero(whole & (slots < spare) & (open_ > 0))[0]
        masks, goes = _masks(window)
        for i in range(0, len(at), SLICE):
            part = at[i : i + SLICE]
            row, mask = np.nonzero(goes[open_[part], slots[part]])
            if len(row):
                yield from found(part[row], _masked_hashes(ids, part[row], masks[mask]))

    def match(self, text: str, share: float = SHARE) -> list[tuple[int, int, int, float]]:
        """(item_id, windows, windows found, share of them) of each item that leaks into the text, by its best reading."""
        return next(self.matches([text], share))

    def matches(self, texts: Iterable[str], share: float = SHARE) -> Iterator[list[tuple[int, int, int, float]]]:
        """What ``match`` gives for each text, in turn.  Many short texts are looked at together, each within its own bounds."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(text.split())
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._matched(held, share)
                held, size = [], 0
        yield from self._matched(held, share)

    def _matched(self, held: list[list[str]], share: float) -> list[list[tuple[int, int, int, float]]]:
        """The leaks of each text, given as its words."""
        words = list(chain.from_iterable(held))
        if not self.items or not words:
            return [[] for _ in held]
        described = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        text = np.repeat(np.arange(len(held)), [len(x) for x in held])
        keep = described != _NOTHING
        if not keep.all():
            words = list(compress(words, keep.tolist()))
            described, text = described[keep], text[keep]
        ids = _placed(described, text)
        both = (ids >= FIRST) & ((described & (_CAP | _NAMED)) != 0)
        ids = np.where(ids == 0, NAME, ids)
        found: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for window in self.known:
            if len(ids) >= window:
                for t, p, h in self._hits(ids, both, window, text):
                    for item, q in self.by_window[window][h]:
                        found[t][item].add((p, q))
        return [self._best(words, found[t], share) if t in found else [] for t in range(len(held))]

    def _best(self, words: list[str], found: dict[int, set[tuple[int, int]]], share: float) -> list[tuple[int, int, int, float]]:
        """Of the items with hits in a text those that leak, each by its best reading."""
        best: dict[int, tuple[int, int, int, float]] = {}
        for item in sorted(found):
            own, pairs = self.items[item], found[item]
            need = len(own.counted)
            if len({q for _, q in pairs}) < share * need:
                continue
            good = self._best_occurrence(own, words, pairs, share * need)
            if good >= share * need and (own.entry not in best or good / need > best[own.entry][3]):
                best[own.entry] = (own.item_id, need, good, good / need)
        return list(best.values())

    def _best_occurrence(self, item: Item, words: list[str], pairs: set[tuple[int, int]], least: float) -> int:
        """Most consistent windows of one occurrence, or of the whole text for an item that lies scattered.

        An occurrence's hits have alignments (place in the text less place in
        the item) that differ by at most half the item's length.
        """
        order = sorted(pairs, key=lambda x: (x[0] - x[1], x))
        best = self._consistent(item, words, order)
        if best == len(item.counted) or not (item.ids < FIRST).any():
            return best
        reach, end = len(item.ids) // 2, 0
        inside: Counter = Counter()
        for begin, (p, q) in enumerate(order):
            while end < len(order) and order[end][0] - order[end][1] <= p - q + reach:
                inside[order[end][1]] += 1
                end += 1
            first = not begin or p - q != order[begin - 1][0] - order[begin - 1][1]
            if first and len(inside) >= max(least, best + 1):
                best = max(best, self._consistent(item, words, order[begin:end]))
                if best == len(item.counted):
                    break
            inside[q] -= 1
            if not inside[q]:
                del inside[q]
        return best

    def _consistent(self, item: Item, words: list[str], pairs: list[tuple[int, int]]) -> int:
        """Item windows found whose slots all hold the value that their slot has most often."""
        if not (item.ids < FIRST).any():
            return len({q for _, q in pairs})
        value = lambda w: _EDGE.sub("", w).lower()
        seen: dict[tuple[int, str], Counter] = defaultdict(Counter)
        filled = []
        for p, q in pairs:
            slots = [
                ((int(item.ids[q + k]), value(item.words[q + k])), value(words[p + k]))
                for k in range(item.window)
                if item.ids[q + k] < FIRST
            ]
            filled.append((q, slots))
            for slot, v in slots:
                seen[slot][v] += 1
        usual = {s: max(c, key=lambda v, c=c: (c[v], v)) for s, c in seen.items()}
        return len({q for q, slots in filled if all(usual[s] == v for s, v in slots)})


def blocks(benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> Iterator[list[tuple[int, str]]]:
    """Benchmark items in blocks of at most so many words; null ids and texts are left out."""
    part, size = [], 0
    rows = benchmark.select("item_id", "text").dropna().dropDuplicates().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        n = len(row["text"].split())
        if part and size + n > block_windows:
            yield part
            part, size = [], 0
        part.append((row["item_id"], row["text"]))
        size += n
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, share): one row per leak, none for clean documents.

    Null and empty texts leak nothing.  An item shorter than five words is
    matched whole; items without a window of three literal words can't be told
    from chance and are left out.  Repeated documents come back repeated; an
    empty benchmark gives no rows.
    """
    schema = "doc_id long, item_id long, n_windows long, n_found long, share double"
    out = None
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Templates(sent.value)
            for batch in batches:
                rows = [(d, *m) for d, found in zip(batch.column(0).to_pylist(), own.matches(texts(batch), share)) for m in found]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_windows", "n_found", "share"])

        part = id_and_text(docs).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without a leak; all columns stay.

    Rows are judged one by one: null and empty texts stay, repeated rows and
    rows without a doc_id stay or go by their texts.  An empty benchmark keeps
    all; no rows in, no rows out.
    """
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Templates(sent.value)
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array([not found for found in own.matches(texts(batch), share)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
