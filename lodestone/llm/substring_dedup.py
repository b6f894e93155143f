"""Exact repeats of long strings, by anchored enhanced suffix arrays.

A repeat is a string of at least ``WINDOW`` bytes that starts at two places of
the corpus.  Every window of that many bytes names one of its substrings as
anchor, the one with the least hash, so that equal windows name equal anchors
at the same place.  Only anchors are shuffled, about one for 80 bytes.

Places with the same anchor form a group.  A place whose whole surroundings
recur is covered without further work; the distinct surroundings left in a
group are sorted into a suffix array with common-prefix lengths, whose interval
tree is built by a stack scan.  Within each interval the left extensions are
tested for diversity the same way, which gives all maximal repeats through the
anchor with all their occurrences.

An anchor that a sample of the documents shows in many distinct surroundings
is dealt by them and never brought together: its windows are compared by hash,
in blocks first and one by one where a block is only partly repeated.  The
sample decides where rows go, never the result.  The same is done with an
anchor that the sample missed and that has more than ``GROUP_ROWS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_texts, store

WINDOW = 200
ANCHOR = 40
REACH = WINDOW - ANCHOR
GROUP_ROWS = 32768
SAMPLE = 5_000
COMMON = 128
MOST_COMMON = 100_000
BLOCK = 16
PIECE = 1 << 18
SLICE = 1 << 20

_RNG = np.random.default_rng(20)
_OF_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


# Anchors --------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place on, by doubling."""
    base = _OF_BYTE[data]
    out: np.ndarray | None = None
    done, size, power, factor = 0, 1, base, _FACTOR
    while True:
        if length & size:
            if out is None:
                out = power
            else:  # what is done stands before the next size bytes
                n = len(data) - done - size + 1
                out = out[:n] * factor + power[done : done + n]
            done += size
        if done == length:
            break
        power = power[:-size] * factor + power[size:]
        factor = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
        size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _sliding(values: np.ndarray, length: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of ``length`` values."""
    size, out = 1, values
    while size * 2 <= length:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = length - size
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(docs: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, place, hash) of the anchors of all windows within documents."""
    sizes = np.array([len(d) for d in docs])
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    if len(data) < window:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    grams = _gram_hashes(data, anchor)
    grams |= np.uint64(1)  # 0 marks windows that aren't whole
    span = window - anchor + 1
    least = _sliding(grams, span, np.minimum)
    whole = np.repeat(ends, sizes)[: len(least)] >= np.arange(len(least)) + window
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    named = _sliding(padded, span, np.maximum)[: len(grams)]
    at = np.nonzero(grams == named)[0]
    doc = np.searchsorted(ends, at, side="right")
    return doc, at - (ends - sizes)[doc], grams[at]


def _pieces(docs: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) of the documents, in lists of bounded size.

    Documents above SLICE bytes come in slices that overlap by all but one byte
    of a window, so that each window lies in one of them.
    """
    part, size = [], 0
    for row, data in docs:
        for offset in range(0, max(1, len(data) - WINDOW + 1), SLICE):
            part.append((row, offset, data[offset : offset + SLICE + WINDOW - 1]))
            size += len(part[-1][2])
            if size >= PIECE:
                yield part
                part, size = [], 0
    if part:
        yield part


def _places(docs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of the anchors of whole documents; an anchor that two slices name comes once."""
    rows, places, hashes = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, np.uint64)]
    for part in _pieces(docs):
        doc, pos, h = anchors([d for _, _, d in part])
        rows.append(np.array([r for r, _, _ in part])[doc])
        places.append(pos + np.array([o for _, o, _ in part])[doc])
        hashes.append(h)
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    if any(len(d) >= SLICE + WINDOW for _, d in docs):
        _, first = np.unique((row << 40) | place, return_index=True)
        row, place, h = row[first], place[first], h[first]
    return row, place, h


def _low(c):
    """The low 31 bits."""
    return c.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, key, mark, text): key and mark name the document in joins, nulls included."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    mark = F.xxhash64(text, doc_id.isNull())
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, mark).alias("key"), _low(mark).alias("mark"), text.alias("text"))


# Places with the same anchor ----------------------------------------------------

SPAN, PLACE, HOT = range(3)
_PLACE_SCHEMA = "part long, other long, key long, at long, kind int"
_PLACE_NAMES = ["part", "other", "key", "at", "kind"]
_KIND_NAMES = ["kind", "h", "c", "key", "at", "n"]
_KIND_SCHEMA = "kind int, h long, c long, key long, at long, n int"


def _surrounding_hashes(texts: list[bytes], row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Hash of the bytes around each place that its windows may cover."""
    out = np.empty(len(row), dtype=np.uint64)
    for k, (r, p) in enumerate(zip(row.tolist(), pos.tolist())):
        low = p - REACH if p > REACH else 0
        out[k] = xxhash.xxh3_64_intdigest(texts[r][low : p + WINDOW], p - low)
    return out.view(np.int64)


def common_anchors(source: DataFrame, sample: int = SAMPLE, least: int = COMMON) -> np.ndarray:
    """Anchors with ``least`` or more distinct surroundings in a sample of about so many documents, sorted.

    At most ``MOST_COMMON``, the commonest.
    """
    parts = max(1, source.count() // max(1, sample))
    some = source.select("key", "mark", "text").filter(F.pmod(F.xxhash64("key", "mark"), F.lit(parts)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(byte_texts(batch))
            row, pos, grams = _places([(i, d) for i, d in enumerate(texts) if len(d) >= WINDOW])
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(_surrounding_hashes(texts, row, pos))], names=["h", "c"])

    seen = some.mapInArrow(run, "h long, c long").distinct().groupBy("h").count().filter(F.col("count") >= least)
    return np.sort(seen.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow().column("h").to_numpy().astype(np.int64))


def _local_places(sent):
    """mapInArrow body: (key, mark, text) -> one row per distinct (anchor, surroundings) of the batch.

    Places whose surroundings recur within the batch are reported as spans at
    once and stand for one row (n = 2), so that copies are folded before the
    shuffle.  Rows of common anchors are dealt by surroundings, others by anchor.
    kind holds 4 * kind + n; at holds the place above the document's mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            keys, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = list(byte_texts(batch))
            row, pos, grams = _places([(i, d) for i, d in enumerate(texts) if len(d) >= WINDOW])
            if not len(row):
                continue
            h, c = grams.view(np.int64), _surrounding_hashes(texts, row, pos)
            key, at = keys[row], (pos.astype(np.int64) << 32) | marks[row].astype(np.int64)
            order = np.lexsort((c, h))
            h, c, key, at = h[order], c[order], key[order], at[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            first = np.nonzero(new)[0]
            sizes = np.diff(np.append(first, len(h)))
            again = np.repeat(sizes > 1, sizes)
            n = np.minimum(sizes, 2)
            h1, c1 = h[first], c[first]
            hot = common[np.minimum(np.searchsorted(common, h1), len(common) - 1)] == h1 if len(common) else np.zeros(len(h1), dtype=bool)
            zero = np.zeros(again.sum(), dtype=np.int64)
            columns = (
                (np.where(hot, c1, h1), key[again] ^ (at[again] >> 3)),
                (np.where(hot, h1, c1), zero),
                (key[first], key[again]),
                (at[first], at[again]),
                (4 * np.where(hot, HOT, PLACE) + n, zero + 4 * SPAN),
            )
            arrays = [np.concatenate(x) for x in columns]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in arrays[:4]), pa.array(arrays[4].astype(np.int32))], names=_PLACE_NAMES)

    return run


def _group_places(bound: int):
    """mapInArrow body over rows sorted by (part, kind downwards, other): spans, places with several surroundings, hot rows.

    Runs through the rows of an anchor in order and holds at most ``bound``
    distinct surroundings; an anchor with more becomes hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        anchor: int | None = None
        held: list[list] = []  # c, key, at, n
        hot = False

        def close() -> None:
            if hot:
                out.extend((HOT, anchor, c, k, a, n) for c, k, a, n in held)
            elif len(held) > 1:
                out.extend((PLACE, anchor, c, k, a, n) for c, k, a, n in held)
            held.clear()

        for batch in batches:
            part, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 4))
            alone = np.zeros(len(part), dtype=bool)
            alone[1:-1] = (part[1:-1] != part[:-2]) & (part[1:-1] != part[2:])
            busy = pa.array(~(alone & (kind >> 2 == PLACE)))
            for p, other, key, at, code in zip(*(c.filter(busy).to_pylist() for c in batch.columns)):
                what, n = code >> 2, code & 3
                if what == SPAN:
                    out.append((SPAN, 0, 0, key, at, 0))
                    continue
                if what == HOT:
                    out.append((HOT, other, p, key, at, n))
                    continue
                if p != anchor:
                    close()
                    anchor, hot = p, False
                if held and held[-1][0] == other:
                    last = held[-1]
                    if last[3] == 1:
                        out.append((SPAN, 0, 0, last[1], last[2], 0))
                        last[3] = 2
                    if n == 1:
                        out.append((SPAN, 0, 0, key, at, 0))
                else:
                    if len(held) > bound:
                        hot = True
                        close()
                    held.append([other, key, at, n])
            if len(out) > 20_000:
                yield _kind_batch(out)
                out.clear()
        close()
        if out:
            yield _kind_batch(out)

    return run


def _kind_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_KIND_NAMES)


def repeated_places(source: DataFrame, bound: int, sample: int, least: int) -> DataFrame:
    """(kind, h, c, key, at, n): whole spans, places to compare, and places of hot anchors."""
    common = source.sparkSession.sparkContext.broadcast(common_anchors(source, sample, least))
    local = source.select("key", "mark", "text").mapInArrow(_local_places(common), _PLACE_SCHEMA)
    dealt = local.repartition("part").sortWithinPartitions("part", F.desc("kind"), "other")
    return store(dealt.mapInArrow(_group_places(bound), _KIND_SCHEMA))


# Suffix arrays of one group ---------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def prefix_intervals(strings: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of sorted strings that share a longest common prefix.

    The stack scan of the common-prefix lengths yields each node of the
    interval tree once, children before their parents.
    """
    stack = [(0, 0)]
    for i in range(1, len(strings) + 1):
        length = common_prefix(strings[i - 1], strings[i]) if i < len(strings) else -1
        first = i - 1
        while stack and stack[-1][0] > length:
            size, first = stack.pop()
            if i - first > 1:
                yield size, first, i - 1
        if not stack or stack[-1][0] < length:
            stack.append((length, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int = WINDOW) -> Iterator[tuple[int, int, list[int]]]:
    """(left length, right length, occurrences) of the maximal repeats through an anchor.

    lefts: the bytes before each occurrence, nearest first; rights: the bytes
    from the anchor's start on.  A repeat is reported if it has ``least`` bytes
    and can be lengthened on neither side with the same occurrences.
    """
    order = sorted(range(len(rights)), key=lambda i: rights[i])
    seen: set[tuple[int, int, int]] = set()
    for right, first, last in prefix_intervals([rights[i] for i in order]):
        if right + REACH < least:
            continue
        members = sorted(order[first : last + 1], key=lambda i: lefts[i])
        for left, a, b in prefix_intervals([lefts[i] for i in members]):
            if left + right < least:
                continue
            own = members[a : b + 1]
            key = (left, len(own), min(own))
            if key in seen:  # the same occurrences with a longer right side came before
                continue
            seen.add(key)
            yield left, right, own


_FOUND_SCHEMA = "kind int, key long, mark int, start int, stop int, h long, at long, before binary, body binary"
_FOUND_NAMES = ["kind", "key", "mark", "start", "stop", "h", "at", "before", "body"]
_FOUND_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _cover_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, kind, h, key, at, before, body) sorted by part -> spans of whole groups; hot rows go through as they are."""

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        lefts = [r[5][::-1] for r in rows]
        rights = [r[6] for r in rows]
        low, high = [0] * len(rows), [0] * len(rows)
        for left, right, own in maximal_repeats(lefts, rights):
            for i in own:
                low[i], high[i] = max(low[i], left), max(high[i], right)
        for i, r in enumerate(rows):
            if high[i]:
                pos = r[4] >> 32
                yield SPAN, r[3], r[4] & 0x7FFFFFFF, pos - low[i], pos + high[i], None, None, None, None

    def emit(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), _FOUND_KINDS)], names=_FOUND_NAMES)

    group: list[tuple] = []
    found: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] == HOT:
                found.append((HOT, row[3], None, None, None, row[2], row[4], row[5], row[6]))
            else:
                if group and group[0][0] != row[0]:
                    found += solve(group)
                    group = []
                group.append(row)
            if len(found) > 10_000:
                yield emit(found)
                found = []
    if group:
        found += solve(group)
    if found:
        yield emit(found)


# Groups too large to bring together -------------------------------------------


_BLOCK_SCHEMA = "key long, at long, first int, lo int, hi int, inner long, cover long, open boolean"
_BLOCK_NAMES = ["key", "at", "first", "lo", "hi", "inner", "cover", "open"]


def _window_rows(step: int):
    """mapInArrow body: (h, key, at, before, body[, first, open]) -> hashes by block of window offsets.

    A block holds the windows that start ``first`` to ``first + step - 1`` bytes
    before the anchor.  inner: the bytes common to these windows; cover: all
    bytes of those that lie within the text.  Both include the anchor.
    """

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def hashed(row: tuple) -> Iterator[tuple]:
        key, at, before, body = row[1:5]
        text, a = before + body, len(before)
        least = max(0, WINDOW - len(body))  # a window needs bytes behind the anchor
        if len(row) > 5:
            firsts = range(max(row[5], least), min(row[5] + BLOCK - 1, a) + 1)
        else:
            firsts = range(least - least % step, a + 1, step)
        is_open = row[6] if len(row) > 6 else True
        for first in firsts:
            lo, hi = max(first, least), min(first + step - 1, a)
            if lo <= hi:
                inner = xxhash.xxh3_64_intdigest(text[a - first : a - (first + step - 1) + WINDOW], first)
                cover = xxhash.xxh3_64_intdigest(text[a - hi : a - lo + WINDOW], lo * 256 + hi)
                yield key, at, first, lo, hi, inner - 2**63, cover - 2**63, is_open

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out = [x for row in zip(*(c.to_pylist() for c in batch.columns)) for x in hashed(row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=_BLOCK_NAMES)

    return run


def _recurring(blocks: DataFrame, name: str) -> DataFrame:
    """Hashes that recur, counted within each partition first; a table, so that Spark sees and splits a skewed join with it."""
    return store(blocks.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name, F.lit(True).alias(f"{name}_recurs")))


def _cover_hot(rows: DataFrame) -> DataFrame:
    """Spans of hot anchors' distinct surroundings, by hash of blocks of windows and then of windows.

    Where all bytes of a block recur its windows do; where its common bytes
    don't recur none does; only the blocks between are taken window by window.
    """
    blocks = store(rows.mapInArrow(_window_rows(BLOCK), _BLOCK_SCHEMA))  # these tables are read several times
    judged = blocks.join(_recurring(blocks, "inner"), "inner").join(_recurring(blocks, "cover"), "cover", "left")
    judged = store(judged.select("key", "at", "first", "lo", "hi", "cover", "cover_recurs"))
    span = _spans(F.col("hi"), F.col("lo"))
    whole = judged.filter("cover_recurs").select(*span)
    # An open block's windows recur in blocks with the same common bytes: all open ones, and one of each kind of covered ones.
    open_blocks = judged.filter("cover_recurs is null").select("key", "at", "first", F.lit(True).alias("open"))
    covered = judged.filter("cover_recurs").groupBy("cover").agg(F.min(F.struct("key", "at", "first")).alias("s"))
    wanted = open_blocks.unionByName(covered.select("s.*", F.lit(False).alias("open")))
    text = rows.join(wanted, ["key", "at"]).select("h", "key", "at", "before", "body", "first", "open")
    windows = store(text.mapInArrow(_window_rows(1), _BLOCK_SCHEMA))
    mine = windows.filter("open").join(_recurring(windows, "cover"), "cover")
    return whole.unionByName(mine.select(*span))


def _spans(before, least=None) -> list:
    """Columns key, mark, start, stop of windows that start ``least`` to ``before`` bytes before the place."""
    pos = F.shiftright("at", 32).cast("int")
    return [F.col("key"), _low(F.col("at")).alias("mark"), (pos - before).alias("start"), (pos - (F.lit(0) if least is None else least) + WINDOW).alias("stop")]


# The operator -----------------------------------------------------------------


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, places array<struct<h, at, kind>>) -> (part, kind, h, key, at, before, body)."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["part", "kind", "h", "key", "at", "before", "body"]

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for key, data, places in zip(batch.column(0).to_pylist(), byte_texts(batch), batch.column(2)):
            for p in places.as_py():
                h, at, kind = p["h"], p["at"], p["kind"]
                pos = at >> 32
                part = h if kind == PLACE else (key * 31 + at) % (1 << 62)  # hot rows are dealt out evenly
                out.append((part, kind, h, key, at, data[max(0, pos - REACH) : pos], data[pos : pos + WINDOW]))
            if len(out) > 10_000:
                yield emit(out)
                out = []
        if out:
            yield emit(out)


def repeated_spans(docs: DataFrame, group_rows: int = GROUP_ROWS, sample: int = SAMPLE, least: int = COMMON) -> DataFrame:
    """(key, mark, start, stop): bytes that repeats of at least WINDOW bytes cover; spans may overlap and pass the ends."""
    source = _source(docs)
    places = repeated_places(source, group_rows, sample, least)
    spans = places.filter(F.col("kind") == SPAN).select(*_spans(F.lit(REACH)))
    wanted = places.filter(F.col("kind") == PLACE).select("h", "key", "at", "kind")
    hot = places.filter(F.col("kind") == HOT)
    any_hot = not hot.isEmpty()
    if any_hot:
        kinds = hot.groupBy("h", "c").agg(F.sum("n").alias("total"), F.min(F.struct("key", "at")).alias("s"))
        again = hot.filter("n = 1").join(kinds.filter("total > 1").select("h", "c"), ["h", "c"])
        spans = spans.unionByName(again.select(*_spans(F.lit(REACH))))
        wanted = wanted.unionByName(kinds.select("h", "s.key", "s.at", F.lit(HOT).alias("kind")))
    listed = wanted.groupBy("key", _low(F.col("at")).alias("mark")).agg(F.collect_set(F.struct("h", "at", "kind")).alias("places"))  # a document's places
    held = source.join(listed, ["key", "mark"]).select("key", "text", "places")
    rows = held.mapInArrow(_surroundings, "part long, kind int, h long, key long, at long, before binary, body binary")
    found = store(rows.repartition("part").sortWithinPartitions("part").mapInArrow(_cover_groups, _FOUND_SCHEMA))
    spans = spans.unionByName(found.filter(F.col("kind") == SPAN).select("key", "mark", "start", "stop"))
    if any_hot:
        spans = spans.unionByName(_cover_hot(found.filter(F.col("kind") == HOT).select("h", "key", "at", "before", "body")))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS, with_bytes: bool = False, sample: int = SAMPLE, least: int = COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row.

    Each byte covered by a WINDOW-byte string that also starts elsewhere in the
    corpus is removed, judged on the input.  Null and empty texts have 0 bytes.
    A repeated row is a copy, so that both lose all their windows.  A null
    doc_id stays null; no rows in, no rows out.
    """
    source = _source(docs)
    spans = repeated_spans(docs, group_rows, sample, least)
    listed = spans.groupBy("key", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most a document's places
    held = source.join(listed, ["key", "mark"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept_bytes = [], []
            for data, found in zip(byte_texts(batch), batch.column(2)):
                gone = merged([(max(0, s["start"]), min(len(data), s["stop"])) for s in found.as_py() or ()])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest()))
                if with_bytes:
                    kept_bytes.append(rest)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns.append(pa.array(kept_bytes, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return held.mapInArrow(run, schema)
