"""Host-level quality rules.

Each document is held against fixed rules.  Failures of each rule are added up
by host (the ``source`` column), the hosts' failure rates are shrunk towards the
corpus by a beta prior fitted to the hosts themselves, and the verdict on a host
is joined back to its documents.

A host is rejected if the shrunken rate of any rule stands out from the corpus:
its odds are ``HOST_ODDS`` times the corpus' or more, and the rate is at least
``HOST_FLOOR``.  So hosts are judged against the corpus that they are in, and a
corpus of one host, or of hosts alike, loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import byte_texts, cut

SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
SPACES = bytes([32, *range(9, 14)])
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
HOST_ODDS = 4.0
HOST_FLOOR = 0.2
STRENGTH = (1.0, 1e6)
#: Rejected hosts up to this number are broadcast; more are joined salted.
BROADCAST_HOSTS = 100_000
SALTS = 16
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rules that hosts are held against, as SQL conditions over the measures; the first two are the base rules.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first time included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(window))))
    if len(set(windows)) == n:
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    mark = b"\x01" * window
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i : i + window] = mark
            covered[j : j + window] = mark
    return covered.count(1)


def measures(data: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = data.split()
    chars = len(data.translate(None, SPACES + CONTINUATION))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, sum(map(data.count, SYMBOLS)), dup, repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, host, measures, base_failed) by row; null texts are empty, a null source is the host ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(x) for x in byte_texts(batch)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "host", *NAMES])

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    rows = source.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{n} long" for n in NAMES))
    return rows.withColumn("base_failed", F.expr(f"{RULES['few_words']} OR {RULES['repeats']}"))


def _prior(hosts: float, n: float, f: float, q: float) -> tuple[float, float]:
    """(mean, strength) of the beta prior from the sums over hosts: how many, rows, failures, failures squared by rows."""
    m = f / max(1, n)
    between = max(0.0, q / max(1, n) - m * m - m * (1 - m) * hosts / max(1, n))
    return m, min(STRENGTH[1], max(STRENGTH[0], m * (1 - m) / between - 1 if between > 0 else STRENGTH[1]))


def host_verdicts(rows: DataFrame, odds: float = HOST_ODDS, floor: float = HOST_FLOOR) -> DataFrame:
    """(host, n_docs, n_<rule>, rate_<rule>, rejected) from measured rows.

    Each rule has its own prior, by moments: mean m of all rows; the spread of
    the hosts' rates beyond what chance gives sets the prior's strength (within
    STRENGTH).  The sums behind the priors are one row; hosts themselves stay
    distributed.  No rows in, no hosts out.
    """
    counts = [F.count_if(F.expr(rule)).alias(f"n_{name}") for name, rule in RULES.items()]
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), *counts)
    sums = [F.sum(f"n_{name}").alias(f"f_{name}") for name in RULES]
    squares = [F.sum(F.col(f"n_{name}").cast("double") * F.col(f"n_{name}") / F.col("n_docs")).alias(f"q_{name}") for name in RULES]
    s = hosts.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("n"), *sums, *squares).first()
    out, rejected = hosts, F.lit(False)
    for name in RULES:
        m, strength = _prior(s["hosts"] or 0, s["n"] or 0, s[f"f_{name}"] or 0, s[f"q_{name}"] or 0.0)
        rate = (F.col(f"n_{name}") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
        out = out.withColumn(f"rate_{name}", rate)
        rejected = rejected | ((rate >= floor) & (rate * F.lit(1 - m) >= F.lit(odds * m) * (1 - rate)))
    return out.withColumn("rejected", rejected)


def _with_verdict(rows: DataFrame, bad: DataFrame, broadcast_hosts: int) -> DataFrame:
    """Rows with ``rejected`` (null where the host isn't): broadcast up to a checked size, salted beyond it."""
    if bad.count() <= broadcast_hosts:
        return rows.join(F.broadcast(bad), "host", "left")
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", *NAMES), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["host", "salt"], "left").drop("salt")


def judged(docs: DataFrame, odds: float = HOST_ODDS, floor: float = HOST_FLOOR, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(doc_id, measures, base_failed, kept) for every row.

    kept is false if the document failed, or else if its host was rejected.
    Empty and null texts have no words and fail; a null source is the host ''.
    Repeated rows come back repeated and count each; a null doc_id stays null;
    other columns are ignored; no rows in, no rows out.
    """
    rows = cut(measured(docs))
    bad = cut(host_verdicts(rows, odds, floor).filter("rejected").select("host", "rejected"))
    kept = ~F.col("base_failed") & F.col("rejected").isNull()
    return _with_verdict(rows, bad, broadcast_hosts).select("doc_id", *NAMES, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, odds: float = HOST_ODDS, floor: float = HOST_FLOOR) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and whose host isn't rejected; all columns stay.

    Rows are judged one by one, so a null or repeated doc_id does no harm.
    """
    rows = cut(measured(docs))
    bad = cut(host_verdicts(rows, odds, floor).filter("rejected").select(F.col("host").alias("_host"), F.lit(True).alias("_rejected")))
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return _passing(docs).join(F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad, host == F.col("_host"), "left_anti")


def _passing(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = (measures(x) for x in byte_texts(batch))
                yield batch.filter(pa.array([m[0] >= MIN_WORDS and 100 * m[4] <= REPEAT_PERCENT * m[0] for m in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _sql() -> str:
    sums = ", ".join(f"sum(n_{r}) / sum(n) AS m_{r}, sum(n_{r}::DOUBLE * n_{r} / n) AS q_{r}" for r in RULES)
    between = ", ".join(f"m_{r}, greatest(0, q_{r} / n - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * hosts / n) AS t_{r}" for r in RULES)
    strength = ", ".join(
        f"m_{r}, least({STRENGTH[1]}, greatest({STRENGTH[0]}, CASE WHEN t_{r} > 0 THEN m_{r} * (1 - m_{r}) / t_{r} - 1 ELSE {STRENGTH[1]} END)) AS c_{r}" for r in RULES
    )
    rates = ", ".join(f"m_{r}, (n_{r} + m_{r} * c_{r}) / (n + c_{r}) AS rate_{r}" for r in RULES)
    bad = " OR ".join(f"(rate_{r} >= {HOST_FLOOR} AND rate_{r} * (1 - m_{r}) >= {HOST_ODDS} * m_{r} * (1 - rate_{r}))" for r in RULES)
    failures = ", ".join(f"count(*) FILTER (WHERE {rule}) AS n_{r}" for r, rule in RULES.items())
    return f"""h AS (SELECT host, count(*) AS n, {failures} FROM b GROUP BY host),
s AS (SELECT count(*) AS hosts, sum(n) AS n, {sums} FROM h),
v AS (SELECT n, {between} FROM s),
k AS (SELECT {strength} FROM v),
x AS (SELECT host, {rates} FROM h, k),
bad AS (SELECT host FROM x WHERE {bad})"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM d),
p AS (SELECT r, words, unnest(generate_series(1, greatest(0, len(words) - {WINDOW - 1}))) AS i FROM w),
q AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM p),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM q),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, generate_series(0, {WINDOW - 1}) AS g(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY r),
m AS (SELECT d.doc_id, d.host, len(w.words)::BIGINT AS n_words,
  length(regexp_replace(d.text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN dl USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM m),
{_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND host NOT IN (SELECT host FROM bad)) AS kept FROM b
"""
