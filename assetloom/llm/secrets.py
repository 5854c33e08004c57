"""Secret scans: fixed patterns, and automata inferred from the credentials they find.

The patterns (``assign``, ``access``, ``hex``) label credentials. All labelled
values set which other runs are candidates: their lengths, with a quarter of
slack, and whether they have letters and digits. A bounded sample of distinct
whole values per kind, the first by hash, and one of other runs train one
automaton per kind and one for the background. Every candidate of the whole
corpus is then scored over its whole length: it is a secret if the likelihood
under some kind's format beats the background's by ``margin`` nats a
character, and by more the fewer samples the format has, and its length is
near those of that kind.

Rows: null text is empty and has no spans; rows are scanned one by one, so
repeated rows and null ids are kept; an empty table trains nothing and gives
an empty result; extra columns are ignored or, in ``redact``, kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assetloom.llm.arrow import local_table, map_chunks, utf8
from assetloom.llm.automata import Automaton, infer
from assetloom.storage import Scratch

#: Fixed patterns and least lengths of the base kinds, in the order of ties.
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: The shortest run that may be a credential, as the patterns label it.
FLOOR = min(LEAST.values())
#: Runs from this length with a digit and a letter teach the background in any case.
TOKEN_LIKE = 16
DIGIT = re.compile(rb"[0-9]")
LETTER = re.compile(rb"[A-Za-z]")

#: Sampled values per kind, and four times as many other runs; bytes of either's values together.
SAMPLE, SAMPLE_BYTES = 400, 400_000
MARGIN = 0.5
FOUND = "format"

EXTRACT = (
    "doc_id long, base array<struct<kind:string,start:long,end:long>>, "
    "runs array<struct<start:long,end:long,value:string>>, creds array<struct<kind:string,value:string>>"
)
SPANS = "array<struct<kind:string,start:long,end:long>>"


def base_matches(text: bytes) -> list[tuple[str, int, int, bytes]]:
    """Spans of the base kinds in bytes, by start and kind, with the credential itself."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append(("assign", m.start(), m.end(), m[2]))
    if b"AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append(("access", m.start(), m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append(("hex", m.start(), m.end(), m[0]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class Shape(NamedTuple):
    """What the labelled values have: least and most length, and classes of (digit, letter)."""

    low: int
    high: int
    classes: frozenset[tuple[bool, bool]]

    def bounds(self) -> tuple[int, int]:
        return max(FLOOR, math.ceil(0.75 * self.low)), math.floor(1.25 * self.high)

    def fits(self, size: int, kind: tuple[bool, bool]) -> bool:
        low, high = self.bounds()
        return low <= size <= high and kind in self.classes


def class_of(value: bytes) -> tuple[bool, bool]:
    return DIGIT.search(value) is not None, LETTER.search(value) is not None


@lru_cache(64)
def _run(low: int) -> re.Pattern:
    return re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}+" % low)


def token_runs(text: bytes, taken: list[tuple], shapes: list[Shape]) -> list[tuple[int, int, bytes]]:
    """Runs that fit one of the shapes, and token-like ones for the background, that touch no base span.

    ``taken`` is in the order of ``base_matches``, so one sweep over both is enough.
    """
    out, at, reach = [], 0, 0
    for m in _run(min([TOKEN_LIKE, *(s.bounds()[0] for s in shapes)])).finditer(text):
        size, kind = len(m[0]), class_of(m[0])
        wanted = size >= TOKEN_LIKE and kind == (True, True) or any(x.fits(size, kind) for x in shapes)
        while at < len(taken) and taken[at][1] < m.end():
            reach, at = max(reach, taken[at][2]), at + 1
        if wanted and reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


class CodePoints:
    """Byte offsets of a text as code points."""

    def __init__(self, text: bytes):
        self.text = None if text.isascii() else text
        self.at, self.count = 0, 0

    def __call__(self, offset: int) -> int:
        if self.text is None:
            return offset
        if offset < self.at:
            self.at, self.count = 0, 0
        self.count += len(self.text[self.at : offset].decode())
        self.at = offset
        return self.count


def _label():
    def step(batch):
        found = [(k, v) for text in utf8(batch.column("text")) for k, _, _, v in base_matches(text)]
        classes = [class_of(v) for _, v in found]
        return {"kind": [k for k, _ in found], "size": [len(v) for _, v in found], "digit": [d for d, _ in classes], "letter": [x for _, x in classes]}

    return step


def _shapes(labelled: DataFrame) -> dict[str, Shape]:
    """The shape of each kind, from ``kind, size, digit, letter`` of all labelled values."""
    rows = labelled.groupBy("kind", "digit", "letter").agg(F.min("size").alias("low"), F.max("size").alias("high")).collect()
    out = {}
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if own:
            out[kind] = Shape(min(r["low"] for r in own), max(r["high"] for r in own), frozenset((r["digit"], r["letter"]) for r in own))
    return out


def _extract(shapes: list[Shape]):
    def step(batch):
        base, runs, creds = [], [], []
        for text in utf8(batch.column("text")):
            spans = base_matches(text)
            loose = token_runs(text, spans, shapes)
            point = CodePoints(text)
            base.append([{"kind": k, "start": point(s), "end": point(e)} for k, s, e, _ in spans])
            runs.append([{"start": point(s), "end": point(e), "value": v.decode()} for s, e, v in loose])
            creds.append([{"kind": k, "value": v.decode()} for k, _, _, v in spans])
        return {"doc_id": batch.column("doc_id"), "base": base, "runs": runs, "creds": creds}

    return step


def extract(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Base spans, loose runs (see ``token_runs``) and labelled credentials of every row."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shapes = list(_shapes(map_chunks(given.select("text"), _label, "kind string, size long, digit boolean, letter boolean")).values())
    return map_chunks(given, lambda: _extract(shapes), EXTRACT)


def _sample(values: DataFrame, size: int, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most ``size`` distinct whole values, the first by hash, and of ``most_bytes`` together.

    One that would exceed the bytes is passed over, but for the first.
    """
    distinct = values.select("value", F.octet_length("value").alias("size")).distinct()
    listed = distinct.select(F.xxhash64("value").alias("of"), "size").orderBy("of", "size").limit(size).collect()
    left, taken = most_bytes, []
    for r in listed:
        if r["size"] <= left or not taken:
            left -= r["size"]
            taken.append((r["of"],))
    chosen = F.broadcast(local_table(values.sparkSession, taken, "of long"))
    rows = distinct.withColumn("of", F.xxhash64("value")).join(chosen, "of").select("value").collect()
    return sorted(r["value"] for r in rows)


def fit_formats(extracted: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, Automaton], Automaton]:
    """Automata of the labelled kinds, and that of the background.

    ``sample`` and ``SAMPLE_BYTES`` bound the strings per kind that reach the
    driver.
    """
    creds = extracted.select(F.explode("creds").alias("x")).select("x.kind", "x.value")
    digit, letter = F.col("value").rlike("[0-9]"), F.col("value").rlike("[A-Za-z]")
    shapes = _shapes(creds.select("kind", F.length("value").alias("size"), digit.alias("digit"), letter.alias("letter")))
    formats = {}
    for kind in shapes:
        formats[kind] = infer(_sample(creds.where(F.col("kind") == kind), sample))
        formats[kind].shape = shapes[kind]
    other = _sample(extracted.select(F.explode("runs").alias("x")).select("x.value"), 4 * sample)
    return formats, fit_background(other, formats)


def fit_background(values: list[str], formats: dict[str, Automaton], rounds: int = 3) -> Automaton:
    """The automaton of runs that are no credentials.

    Credentials that the patterns miss are among the runs, so those that a
    format explains better than the background leave the sample before it is
    fitted again.
    """
    background = infer(values)
    for _ in range(rounds):
        kept = [v for v in values if not is_secret(v, formats, background, margin=0.0)]
        if len(kept) == len(values):
            break
        values, background = kept, infer(kept)
    return background


def is_secret(value: str, formats: dict[str, Automaton], background: Automaton, margin: float = MARGIN) -> bool:
    """Whether the run's likelihood under a format beats the background's, for each character by
    the margin and the uncertainty of the format's sample (one over the root of its size)."""
    kind = class_of(value.encode())
    near = [f for f in formats.values() if shape_of(f).fits(len(value), kind)]
    if not near:
        return False
    against = background.log_likelihood(value)
    return any(f.log_likelihood(value) - against > (margin + max(1, f.samples) ** -0.5) * len(value) for f in near)


def shape_of(automaton: Automaton) -> Shape:
    """The shape of all labelled values, or of any class if only the samples' lengths are known."""
    return getattr(automaton, "shape", None) or Shape(*automaton.lengths, frozenset((d, x) for d in (False, True) for x in (False, True)))


def _judge(model):
    def make():
        secret = lru_cache(50_000)(lambda value: is_secret(value, *model))

        def step(batch):
            kept = []
            for base, runs in zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist()):
                more = [{"kind": FOUND, "start": r["start"], "end": r["end"]} for r in runs if secret(r["value"])]
                order = {k: i for i, k in enumerate((*KINDS, FOUND))}
                kept.append(sorted(base + more, key=lambda x: (x["start"], order[x["kind"]])))
            return {"doc_id": batch.column("doc_id"), "base": batch.column("base"), "spans": kept}

        return step

    return make


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Return ``doc_id, base, spans`` for every row: spans of kind, start and end in code points."""
    scratch = Scratch(docs.sparkSession, "secrets")
    extracted = scratch.save(extract(docs, text, doc_id), "extracted")
    model = fit_formats(extracted, sample)
    kinds = f"doc_id long, base {SPANS}, spans {SPANS}"
    return map_chunks(extracted, _judge(model), kinds)


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias(f"n_{FOUND}"),
    )


def placeholder(value: bytes, key: bytes | None = None) -> bytes:
    """What stands for a secret in a redacted text.

    With a key, which the caller keeps, equal secrets get equal marks. Without
    one there is no mark, since a plain hash lets short secrets be guessed.
    """
    if key is None:
        return b"[SECRET]"
    return b"[SECRET-" + hashlib.blake2b(value, key=key, digest_size=8).hexdigest().encode() + b"]"


def redact_text(text: bytes, model, key: bytes | None = None) -> bytes:
    """The text with every secret span replaced."""
    spans = base_matches(text)
    loose = token_runs(text, spans, [shape_of(f) for f in model[0].values()])
    spans = [(s, e) for _, s, e, _ in spans] + [(s, e) for s, e, v in loose if is_secret(v.decode(), *model)]
    out, at = [], 0
    for start, end in _merged(spans):
        out += [text[at:start], placeholder(text[start:end], key)]
        at = end
    return b"".join([*out, text[at:]])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def redact(docs: DataFrame, text: str = "text", sample: int = SAMPLE, key: bytes | None = None) -> DataFrame:
    """``docs`` with secrets replaced by placeholders; ``n_chars``, if there, follows the text.

    Null texts stay null. ``key`` is that of ``placeholder``.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    extracted = scratch.save(extract(docs.withColumn("_none", F.lit(None).cast("long")), text, "_none"), "extracted")
    model = fit_formats(extracted, sample)
    scratch.drop(extracted)
    schema = docs.schema

    def make():
        def step(batch):
            out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = out[text].cast("binary").to_pylist()
            clean = [t if t is None else redact_text(t, model, key) for t in texts]
            out[text] = pa.array(clean, pa.binary()).cast(pa.string())
            if "n_chars" in out:
                old = out["n_chars"].to_pylist()
                out["n_chars"] = [o if a == b else len(b.decode()) for a, b, o in zip(texts, clean, old)]
            return out

        return step

    return map_chunks(docs, make, schema)
