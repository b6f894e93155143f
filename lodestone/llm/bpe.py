"""Byte-level BPE with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be merged
over, so every place with such a pair is a certain cut.  Words are cut there,
the fragments are encoded on their own by the vocabulary's merges, and the ids
are concatenated.  Words and their ids are remembered in a bounded cache.

Fragments are merged pair by pair, the pair of least rank first and the leftmost
of equal ones.  The new words of many texts are merged together, one pair of
each fragment a round, as array operations; long fragments keep their pairs in a
heap, so that their cost stays near linear.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import id_and_text, sparing, texts

#: Word pattern of byte-level vocabularies (a fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 120_000
CACHE_WORD = 64
LONG = 48
WIDTH = 24
MASK = (1 << WIDTH) - 1
NEVER = 1 << 60
TOGETHER = 1 << 20
Piece = tuple[str, int, bytes]


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (its JSON text)."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        model = spec["model"]
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("a plain vocabulary is needed: no dropout, no prefix or suffix of subwords, no byte fallback")
        self.vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        vocab = self.vocab
        #: id of the left token above that of the right one -> rank above the id of what they make.
        self.pairs: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault(vocab[x] << WIDTH | vocab[y], rank << WIDTH | vocab[x + y])
        self.byte_ids = [vocab[c] for c in letters]
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.first_ids = np.array(self.byte_ids, dtype=np.int64)
        of_letter = {c: b for b, c in enumerate(letters)}
        self.letters = letters
        self.token_bytes = {i: bytes(of_letter[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        #: Whether a pair of bytes, the first one above the second, is inside a token.
        self.inside = np.zeros(1 << 16, dtype=bool)
        self.inside[[a << 8 | b for t in self.token_bytes.values() for a, b in zip(t, t[1:])]] = True
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        self.cut_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = regex.compile(WORDS).findall
        self.known_added: dict[str | int, Piece] = {i: (str(i), 1, self.token_bytes[i]) for i in self.added.values()}
        self.known = dict(self.known_added)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a forced boundary stands before each byte; the first is none."""
        out = np.zeros(len(data), dtype=bool)
        out[1:] = ~self.inside[data[:-1].astype(np.int64) << 8 | data[1:]]
        return out

    def fragments(self, word: bytes) -> list[bytes]:
        """A word cut at every pair of bytes that is inside no token."""
        at = [0, *np.nonzero(self.cuts(np.frombuffer(word, dtype=np.uint8)))[0].tolist(), len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, merged fragment by fragment."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        begins = self.cuts(data)
        begins[0] = True
        begins[ends[:-1]] = True
        part = np.cumsum(begins) - 1
        starts = np.nonzero(begins)[0]
        sizes = np.diff(np.append(starts, len(data)))
        done_ids, done_parts = [], []
        for k in np.nonzero(sizes > LONG)[0].tolist():
            own = self._merged_long(data[starts[k] : starts[k] + sizes[k]].tobytes())
            done_ids.append(np.array(own, dtype=np.int64))
            done_parts.append(np.full(len(own), k))
        short = np.repeat(sizes <= LONG, sizes)
        ids, own = self.first_ids[data[short]], part[short]
        while len(ids):
            keys = ids[:-1] << WIDTH | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where((self.keys[at] == keys) & (own[:-1] == own[1:]), self.made[at], NEVER)
            rank = np.append(rank, NEVER)
            first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(own))))
            going = least != NEVER
            done_ids.append(ids[~going])
            done_parts.append(own[~going])
            ids, own, rank, least = ids[going], own[going], rank[going], least[going]
            if not len(ids):
                break
            best = np.nonzero(rank == least)[0]
            best = best[np.concatenate([[True], own[best[1:]] != own[best[:-1]]])]
            ids[best] = rank[best] & MASK
            keep = np.ones(len(ids), dtype=bool)
            keep[best + 1] = False
            ids, own = ids[keep], own[keep]
        ids, own = np.concatenate(done_ids), np.concatenate(done_parts)
        order = np.argsort(own, kind="stable")
        ids, own = ids[order].tolist(), own[order]
        # a part's word: how many words end at or before the part's first byte
        word = np.searchsorted(ends, starts[own], side="right")
        edges = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        return [ids[i:j] for i, j in zip(edges, edges[1:])]

    def _merged_long(self, fragment: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in fragment]
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int, j: int) -> None:
            own = ids[i] << WIDTH | ids[j]
            if own in self.pairs:
                heapq.heappush(heap, (self.pairs[own], i, own))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, own = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] << WIDTH | ids[j] != own:
                continue  # one of the two was merged before
            ids[i], ids[j] = rank & MASK, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def word_ids(self, word: str) -> list[int]:
        return self.merged([word.encode()])[0]

    def pieces(self, text: str) -> list[str | int]:
        """A text's words, and the ids of added tokens between them."""
        if self.cut_added is None:
            return self.words(text)
        out: list[str | int] = []
        at = 0
        for m in self.cut_added.finditer(text):
            out += self.words(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.words(text[at:]) if at else self.words(text)

    def learn(self, words: set[str]) -> dict[str | int, Piece]:
        """The ids of words that aren't remembered; short words are remembered, up to a bound."""
        fresh = list(words)
        found: dict[str | int, Piece] = {}
        for word, ids in zip(fresh, self.merged([w.encode() for w in fresh])):
            found[word] = (",".join(map(str, ids)), len(ids), self.decode_bytes(ids))
        if len(self.known) + len(found) > CACHE_ENTRIES:
            self.known = dict(self.known_added)
        self.known |= {w: x for w, x in found.items() if len(w) <= CACHE_WORD}
        return found

    def encoded(self, texts: Iterable[str]) -> Iterator[list[Piece]]:
        """(ids joined by commas, their number, their bytes) of each piece of each text in turn; new words of many texts are merged together."""
        held: list[list[str | int]] = []
        fresh: set[str] = set()
        size = 0
        for text in texts:
            own = self.pieces(text)
            held.append(own)
            fresh.update(w for w in own if w not in self.known)
            size += len(text)
            if size >= TOGETHER:
                yield from self._told(held, fresh)
                held, fresh, size = [], set(), 0
        yield from self._told(held, fresh)

    def _told(self, held: list[list[str | int]], fresh: set[str]) -> Iterator[list[Piece]]:
        known, found = self.known.get, self.learn(fresh)  # learning may start a new table
        for own in held:
            yield [known(w) or found[w] for w in own]

    def encode(self, text: str) -> list[int]:
        return [int(i) for own in self.encoded([text]) for ids, _, _ in own for i in ids.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; byte sequences that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(text: str) -> Codec:
    return Codec(text)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row's whole text.

    Null and empty texts have 0 tokens and the hash of the empty string.
    Repeated rows come back repeated; a null doc_id stays null; no rows in, no
    rows out.  The file at ``path`` is read on the driver and sent to the
    executors (a vocabulary, of fixed size).
    """
    found = encode_rows(id_and_text(docs), path, with_ids)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))


ADDED = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encode_rows(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """``docs`` with the number of tokens of each row's whole text, both hashes, and the ids; all columns stay.

    Null and empty texts have no ids.  A column of ``docs`` with one of the new
    names gives way to it.  Repeated rows come back repeated; no rows in, no
    rows out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    new = [f.split(" ")[0] for f in ADDED.split(", ")][: 4 if with_ids else 3]
    kept = docs.select(*[c for c in docs.columns if c not in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            yield encoded(own, batch)

    def encoded(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ids_hash, text_hash, ids = [], [], [], [np.zeros(0, dtype=np.int32)]
        for found in own.encoded(texts(batch)):
            joined = ",".join([f[0] for f in found])
            counts.append(sum([f[1] for f in found]))
            ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
            raw = b"".join([f[2] for f in found])
            text_hash.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            if joined and with_ids:
                ids.append(np.array(joined.split(","), dtype=np.int32))
        columns = [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
        if with_ids:  # numbers stay in arrays: as objects they would take nine times the memory
            ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    added = [T.StructField(n, t, True) for n, t in zip(new, (T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())))]
    return kept.mapInArrow(sparing(run), T.StructType([*kept.schema.fields, *added]))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text) for every row.

    Null and empty ids give the empty text; bytes that aren't UTF-8 become
    U+FFFD.  Repeated rows come back repeated; a null doc_id stays null; other
    columns are ignored; no rows in, no rows out.  An id that the vocabulary
    doesn't have is an error.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value)
        for batch in batches:
            out = [own.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
