"""Texts to chunks: packing is sequential, so it runs over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.config import DEFAULT, Settings
from lodestone.functions.memory import release

#: Characters of the chunks that a worker gives at once, or one text's chunks if they have more.
BATCH_CHARS = 1 << 20

_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_CLAUSE = re.compile(r"([0-9]+(?:\.[0-9]+)*)\.?\s")


def depth(line: str) -> int:
    m = _CLAUSE.match(line)
    return m[1].count(".") + 1 if m else 0


def hard_split(text: str, most: int) -> Iterator[str]:
    """Pieces of at most ``most`` characters, cut at the last space of the window's second half if there is one."""
    while len(text) > most:
        space = text.rfind(" ", 0, most)
        at = space if space > most * 0.5 else most
        yield text[:at].strip()
        text = text[at:].strip()
    if text:
        yield text


def pack(paragraph: str, most: int) -> list[str]:
    """A paragraph as pieces of at most ``most`` characters, by lines if it has any and else by sentences."""
    if len(paragraph) <= most:
        return [paragraph]
    by_line = "\n" in paragraph
    glue = "\n" if by_line else " "
    units: Iterable[str] = paragraph.split("\n") if by_line else (s.strip() for s in _SENTENCE.split(paragraph))
    done: list[str] = []
    held = ""
    for unit in filter(None, units):
        if len(unit) > most:
            done += [held] if held else []
            done += hard_split(unit, most)
            held = ""
        elif held and len(held) + len(unit) + 1 > most:
            done.append(held)
            held = unit
        else:
            held = held + glue + unit if held else unit
    return [*done, held] if held else done


def tail(text: str, size: int) -> str:
    """The last ``size`` characters, from the first space on; a shorter text whole."""
    if size <= 0:
        return ""
    if len(text) <= size:
        return text
    end = text[-size:]
    return end[end.find(" ") + 1 :] if " " in end else ""


def clauses(text: str, settings: Settings) -> list[str]:
    """Lines grouped under their first-level clause; a short group takes in the next one."""
    groups: list[list[str]] = []
    for line in text.split("\n"):
        if not groups or depth(line) == 1:
            groups.append([])
        groups[-1].append(line)
    out: list[str] = []
    for block in filter(None, ("\n".join(g).strip() for g in groups)):
        if out and len(out[-1]) < settings.min_block_chars and len(out[-1]) + len(block) <= settings.chunk_chars:
            out[-1] += "\n" + block
        else:
            out.append(block)
    return out


def _clean(paragraph: str) -> str:
    return re.sub(r" {2,}", " ", re.sub(r"[ \t]*\n[ \t]*", "\n", paragraph)).strip()


def chunk_text(text: str | None, settings: Settings = DEFAULT) -> list[str]:
    """Chunks of a text: whole clauses where they fit, else packed pieces with an overlap.

    Null, empty and blank texts have no chunks.
    """
    most = settings.chunk_chars
    units = [p for p in map(_clean, _PARAGRAPH.split(text or "")) if p]
    if settings.structural_chunking:
        units = [c for p in units for c in clauses(p, settings)]
    done: list[str] = []
    held = ""
    for unit in units:
        if settings.structural_chunking and len(unit) <= most and depth(unit.split("\n", 1)[0]) == 1:
            done += [held.strip()] if held.strip() else []
            done.append(unit.strip())
            held = ""
            continue
        for piece in pack(unit, most):
            if held and len(held) + len(piece) + 1 > most:
                done.append(held.strip())
                kept = tail(held, min(settings.chunk_overlap, max(0, most - len(piece) - 1)))
                held = f"{kept} {piece}" if kept else piece
            else:
                held = f"{held} {piece}" if held else piece
    return [*done, held.strip()] if held.strip() else done


def build_chunks(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(collection, code, title, text, ...) -> one row per chunk with its id ``code#index``.

    Texts are taken one by one and chunks are given in batches of about
    ``BATCH_CHARS``, so that a worker's memory follows neither the number nor
    the length of the rows that it is sent.
    """
    others = [c for c in docs.columns if c not in ("text", "index", "id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            places: list[int] = []
            texts: list[str] = []
            chars = 0
            for row, text in enumerate(batch.column(len(others))):
                made = chunk_text(text.as_py(), settings)
                rows += [row] * len(made)
                places += range(len(made))
                texts += made
                chars += sum(map(len, made))
                if chars >= BATCH_CHARS:
                    yield chunk_rows(batch, rows, places, texts)
                    rows, places, texts, chars = [], [], [], 0
            if rows:
                yield chunk_rows(batch, rows, places, texts)
            release()

    def chunk_rows(batch: pa.RecordBatch, rows: list[int], places: list[int], texts: list[str]) -> pa.RecordBatch:
        kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(others)]]
        return pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=[*others, "index", "text"])

    shape = StructType([*(docs.schema[c] for c in others), StructField("index", IntegerType()), StructField("text", StringType())])
    rows = docs.select(*others, F.col("text").cast("string").alias("text")).mapInArrow(run, shape)
    return rows.withColumn("id", F.concat_ws("#", "code", F.col("index").cast("string")))
