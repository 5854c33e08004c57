"""Token counts of a document's fields or sections, from one encoding of the whole.

A document is encoded once. The lengths of its tokens in bytes give their
offsets, and a binary search joins these intervals with those of the spans.
Tokens that cross a span's boundary are allocated by a rule:

- ``start``: the span that holds the token's first byte has it;
- ``end``: the span that holds its last byte has it;
- ``split``: each span has the share of the token's bytes that it holds.

Spans that cover the text without overlap share out all tokens under any rule.
Spans may also overlap or leave gaps; each counts for itself.

Rows: null and empty texts have no tokens and, by lines, one empty section;
spans are clipped to the text, null spans count nothing; repeated rows are
counted row by row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assetloom.llm.arrow import map_chunks, utf8

RULES = ("start", "end", "split")
SECTION = "section string, start long, end long"


class RankTokenizer:
    """A byte-level BPE from a file of ranks, with the length of each token in bytes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: bytes) -> np.ndarray:
        """Where each token of the text ends, in bytes."""
        if not text:
            return np.empty(0, np.int64)
        return np.cumsum(self.sizes[self.encoding.encode_to_numpy(text.decode())])


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each span by the rule, and how many tokens cross one of its boundaries.

    ``ends`` are the tokens' ends in bytes; spans are ``[start, stop)`` in bytes.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    full = stop > start
    # tokens that overlap a span: those from the one that holds its first byte to that of its last
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(starts, stop, "left")
    inner_first, inner_last = np.searchsorted(starts, start, "left"), np.searchsorted(ends, stop, "right")
    crossing = np.where(full, np.maximum(last - first, 0) - np.maximum(inner_last - inner_first, 0), 0)
    if rule == "start":
        count = last - inner_first
    elif rule == "end":
        count = inner_last - first
    else:
        count = np.maximum(inner_last - inner_first, 0).astype(float)
        for i in np.flatnonzero(crossing):
            edge = [t for t in {int(first[i]), int(last[i]) - 1} if starts[t] < start[i] or ends[t] > stop[i]]
            count[i] += sum((min(ends[t], stop[i]) - max(starts[t], start[i])) / (ends[t] - starts[t]) for t in edge)
    return np.where(full, count, 0), crossing


def line_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lines of a text with their newline, in bytes; they cover the text."""
    flat = np.frombuffer(text, np.uint8)
    cuts = np.flatnonzero(flat == 10) + 1
    starts = np.concatenate(([0], cuts[cuts < len(flat)]))
    return starts, np.append(starts[1:], len(flat))


def code_points(text: bytes) -> np.ndarray | None:
    """Code points before each byte offset; None if they are equal."""
    if text.isascii():
        return None
    flat = np.frombuffer(text, np.uint8)
    return np.concatenate(([0], np.cumsum((flat & 0xC0) != 0x80)))


def _step(path: str, pattern: str, rule: str, given_spans: bool):
    def make():
        tokenizer = RankTokenizer(path, pattern)

        def step(batch):
            names = batch.column("doc_id").to_pylist()
            spans = batch.column("spans").to_pylist() if given_spans else None
            out: dict[str, list] = {k: [] for k in ("doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens")}
            for i, text in enumerate(utf8(batch.column("text"))):
                points = code_points(text)
                ends = tokenizer.ends(text)
                if given_spans:
                    own = [x for x in spans[i] or [] if x and x["start"] is not None and x["end"] is not None]
                    labels = [x["section"] for x in own]
                    at = np.array([[x["start"], x["end"]] for x in own], np.int64).reshape(-1, 2)
                    size = len(text) if points is None else int(points[-1])
                    at = np.clip(at, 0, size)
                    at[:, 1] = np.maximum(at[:, 1], at[:, 0])
                    shown = at
                    if points is not None:  # the first byte of a code point has the offset where its count is first met
                        at = np.searchsorted(points, at, "left")
                        at = np.where(shown > 0, np.searchsorted(points, shown, "right") - 1, 0)
                    start, stop = at[:, 0], at[:, 1]
                else:
                    start, stop = line_spans(text)
                    labels = list(map(str, range(len(start))))
                    shown = np.stack([start, stop], axis=1) if points is None else np.stack([points[start], points[stop]], axis=1)
                tokens, crossing = attribute(ends, start, stop, rule)
                out["doc_id"] += [names[i]] * len(labels)
                out["section"] += labels
                out["doc_tokens"] += [len(ends)] * len(labels)
                for key, values in (("start", shown[:, 0]), ("end", shown[:, 1]), ("tokens", tokens), ("crossing", crossing)):
                    out[key].append(values)
            for key, kind in (("start", np.int64), ("end", np.int64), ("tokens", np.float64), ("crossing", np.int64)):
                out[key] = np.concatenate(out[key]).astype(kind) if out[key] else np.empty(0, kind)
            return out

        return step

    return make


def count_tokens(
    docs: DataFrame, ranks: str, pattern: str, rule: str = "start", spans: str | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Return ``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens`` for every span.

    ``ranks`` is the path of a file of token ranks, the same on every machine.
    ``spans`` names a column of ``array<struct<section, start, end>>`` in code
    points; without it the sections are the lines, each with its newline.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")]
    if spans:
        columns.append(F.col(spans).cast(f"array<struct<{SECTION.replace(' ', ':')}>>".replace(",:", ",")).alias("spans"))
    schema = f"doc_id long, {SECTION}, tokens double, crossing long, doc_tokens long"
    counted = map_chunks(docs.select(*columns), _step(ranks, pattern, rule, bool(spans)), schema)
    kind = "double" if rule == "split" else "long"
    return counted.select(
        "doc_id", "section", "start", "end", F.col("tokens").cast(kind).alias("n_tokens"), F.col("crossing").alias("n_crossing"), "doc_tokens"
    )


def joined_fields(fields: list[str], separator: str = "\n") -> tuple[Column, Column]:
    """One text of several columns, and the spans of the columns in it; null fields are empty."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for name, body in zip(fields, texts):
        end = at + F.length(body)
        spans.append(F.struct(F.lit(name).alias("section"), at.alias("start"), end.alias("end")))
        at = end + len(separator)
    return F.concat_ws(separator, *texts), F.array(*spans)
