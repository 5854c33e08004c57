"""Quality rules with the cross-document frequency of lines.

Base rules look at one document (length, repeated three-word windows). The
method looks across documents: lines are normalised (A-Z in lower case, words
joined by one space) and hashed with their host, and the distinct documents
with a line are counted per host. A line in more documents of a host than its
limit is removed from all of them. The limit is ``max_docs`` documents or the
share ``max_share`` of the host's documents, whichever is more, so that a
verdict does not turn with the size of the table. Documents left with less
than ``min_left`` of their words are rejected.

Rows: a document is an id, and each row without an id is one of its own; null
text is empty (no words, so the base rule fails); null hosts form one host;
repeated rows are judged row by row and count as one document; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from assetloom.llm.arrow import map_chunks, utf8
from assetloom.storage import Scratch

MIN_WORDS = 50
#: A line's limit: documents, and the part of its host's documents (one in so many).
MAX_DOCS, MAX_SHARE = 20, 100
MIN_LEFT = 0.25

SYMBOLS = b"#*$%&|<>"
#: Frequent lines up to this number may be broadcast (8 bytes each); more meet the lines in salted parts.
BROADCAST_LINES, SALTS = 1_000_000, 64
NOT_WORD_CHARS = b" \t\n\x0b\f\r" + bytes(range(0x80, 0xC0))

STATS = (
    "row long, doc_id long, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line_keys array<long>, line_words array<int>"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for shift in range(3):
        cover[shift : n - 2 + shift] |= twice
    return int(cover.sum())


def document_stats(text: bytes, host: bytes) -> tuple:
    """Base counts of one text, and its distinct lines with their words."""
    words: list[bytes] = []
    lines: dict[int, int] = {}
    exact: set[bytes] = set()
    with_word = 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            with_word += 1
            exact.add(line)
            words += own
            key = xxhash.xxh64_intdigest(host + b"\n" + b" ".join(own).lower()) - (1 << 63)
            lines[key] = lines.get(key, 0) + len(own)
    return (
        len(words), len(text.translate(None, NOT_WORD_CHARS)), len(text) - len(text.translate(None, SYMBOLS)),
        with_word - len(exact), repeated_words(words), list(lines), list(lines.values()),
    )


def _make():
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40

    def step(batch):
        nonlocal row
        hosts = [b"\1" + h if h is not None else b"\0" for h in batch.column("host").cast("binary").to_pylist()]
        found = [document_stats(t, h) for t, h in zip(utf8(batch.column("text")), hosts)]
        columns = list(zip(*found)) if found else [[]] * 7
        rows = list(range(row, row + len(found)))
        row += len(found)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_keys", "line_words")
        return {"row": rows, "doc_id": batch.column("doc_id"), "host": [xxhash.xxh64_intdigest(h) - (1 << 63) for h in hosts]} | dict(zip(names, columns))

    return step


def line_quality(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    host: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: int = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Return the counts and verdicts of every row.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_words, depleted, kept``.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    stats = scratch.save(map_chunks(given, _make, STATS), "stats")
    lines = stats.select("row", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select(
        "row", F.col("x.line_keys").alias("line"), F.col("x.line_words").alias("words")
    )
    frequent = scratch.save(_frequent(stats, max_docs, max_share), "frequent")
    if frequent.count() <= BROADCAST_LINES:
        hit = lines.join(F.broadcast(frequent), "line")
    else:  # by definition these lines are hot keys
        salts = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salts, ["line", "salt"])
    removed = hit.groupBy("row").agg(F.sum("words").alias("removed"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed_words = F.coalesce("removed", F.lit(0)).cast("long")
    out = stats.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), removed_words.alias("removed_words"),
    )
    depleted = F.col("n_words") - F.col("removed_words") < F.lit(min_left) * F.col("n_words")
    return out.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def _frequent(stats: DataFrame, max_docs: int, max_share: int) -> DataFrame:
    """Keys of the lines beyond their host's limit; a line's key holds its host."""
    # a row without an id is told apart by its number
    who = ("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("alone"))
    count = lambda frame, *key: frame.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    limits = count(stats.select("host", *who), "host").select("host", F.greatest(F.lit(max_docs), F.floor(F.col("n") / max_share)).alias("most"))
    found = count(stats.select("host", *who, F.explode("line_keys").alias("line")), "host", "line").where(F.col("n") > max_docs)
    return found.join(limits, "host").where("n > most").select("line")
