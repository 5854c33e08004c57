"""Packing documents into fixed windows with their lexical neighbours.

Each document is encoded once. Document frequencies and the mean length are
those of the whole table. A document's key is its weightiest term of those
that other documents have too; documents of one key share a shard, keys are
put together into shards of bounded size, and a key too large for one is dealt
to several by id. So shards depend on the contents and not on the files. Each
shard has an inverted BM25 index over the token ids of its documents. A window
starts from a seed (what the last window left of a document, or the first
unused one); the index ranks all unused documents that share a term with the
seed, and the nearest fill the window greedily. The document at the window's end is cut there, and its
rest is the next seed, so windows have no padding. The last tokens of a shard,
fewer than a window, become sequences whose lengths are powers of two.

Rows: null text is empty and has the end id alone; repeated rows are packed
one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assetloom.llm.arrow import CHUNK_ROWS, bound_batches, give_back, local_table
from assetloom.llm.wordpieces import STEP_BYTES, pieces_of, steps
from assetloom.storage import Scratch

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 2_000_000
SHARD_DOCS = 60_000
#: Neighbours that are ranked first; further ones when these are used.
NEIGHBOURS = 16
#: Share of the documents from which a term's postings are kept as a row; the
#: rows have at most 1 / DENSE as many numbers as the shard has postings.
DENSE = 0.05
K1, B = 1.2, 0.75

#: Part of a shard that the plan fills where a key is dealt out by hash.
FILL = 0.9

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Corpus(NamedTuple):
    """What BM25 needs to know of the whole table."""

    docs: int
    tokens: int
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))

    def norm(self, sizes: np.ndarray) -> np.ndarray:
        return K1 * (1 - B + B * sizes / max(1.0, self.tokens / max(1, self.docs)))


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, term and count of each distinct term of at most 65,536 documents, by term and owner."""
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate(docs).astype(np.uint32) << np.uint32(16) | np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
    flat.sort()
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    counts = np.diff(np.append(first, len(flat)))
    pairs = flat[first]
    return (pairs & np.uint32(0xFFFF)).astype(np.int32), (pairs >> np.uint32(16)).astype(np.uint16), counts


class Bm25Shard:
    """An inverted index of the shard's documents over their token ids.

    ``corpus`` has the statistics of the whole table; without it the documents
    are the table.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        owners, terms, counts = term_counts(docs)
        own = np.bincount(terms, minlength=0x10000)
        corpus = corpus or Corpus(n, int(sizes.sum()), own)
        weight = (corpus.idf()[terms] * counts * (K1 + 1) / (counts + corpus.norm(sizes)[owners])).astype(np.float32)
        self.n = n
        self.post_docs, self.post_weight = owners, weight
        self.post_begin = np.concatenate(([0], np.cumsum(own)))
        order = np.argsort(owners, kind="stable")
        self.terms, self.weight = terms[order], weight[order]
        self.begin = np.searchsorted(owners[order], np.arange(n + 1))
        # terms of many documents as rows of a matrix, which add up faster than postings
        common = np.flatnonzero(own > n * DENSE)
        self.dense_row = np.full(0x10000, -1, np.int32)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), np.float32)
        dense = self.dense_row[terms]
        self.dense[dense[dense >= 0], owners[dense >= 0]] = weight[dense >= 0]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of the seed."""
        terms = self.terms[self.begin[doc] : self.begin[doc + 1]]
        rows = self.dense_row[terms]
        parts = [slice(self.post_begin[t], self.post_begin[t + 1]) for t in terms[rows < 0].tolist()]
        has = np.zeros(len(self.dense), np.float32)
        has[rows[rows >= 0]] = 1
        out = (has @ self.dense).astype(np.float64)
        if parts:
            hit = np.concatenate([self.post_docs[p] for p in parts])
            out += np.bincount(hit, np.concatenate([self.post_weight[p] for p in parts]), self.n)
        return out

    def neighbours(self, doc: int, used: np.ndarray, limit: int = NEIGHBOURS) -> list[int]:
        """The unused documents of the highest scores for the seed's terms."""
        return next(self.ranked(doc, used, limit), [])

    def ranked(self, doc: int, used: np.ndarray, limit: int = NEIGHBOURS) -> Iterator[list[int]]:
        """All unused documents that score above 0, the highest first, in lists of growing length.

        ``used`` may change between the lists.
        """
        scores = self.scores(doc)
        while True:
            scores[used] = 0
            limit = min(limit, self.n)
            top = np.argpartition(-scores, limit - 1)[:limit]
            top = top[scores[top] > 0]
            if not len(top):
                return
            yield top[np.lexsort((top, -scores[top]))].tolist()
            scores[top] = 0
            limit *= 4


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(doc, start, length, sequence, offset)`` of one shard, in order."""
    index = Bm25Shard(docs, corpus)
    used = np.zeros(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    unread, carry, sequence = 0, None, 0
    current: list[tuple[int, int, int]] = []
    while True:
        if carry is None:
            while unread < len(docs) and used[unread]:
                unread += 1
            if unread == len(docs):
                break
            carry = (unread, 0)
            used[unread] = True
        (doc, start), carry = carry, None
        seed, room, queue, more = doc, window, [], None
        current = []
        while room:
            length = min(room, len(docs[doc]) - start)
            current.append((doc, start, length))
            room -= length
            if start + length < len(docs[doc]):
                carry = (doc, start + length)
                break
            if not room:
                break
            if more is None:
                more = index.ranked(seed, used)
            if not queue:
                queue = next(more, [])[::-1]
            if queue:
                doc = queue.pop()
            else:
                while unread < len(docs) and used[unread]:
                    unread += 1
                if unread == len(docs):
                    break
                doc = unread
            used[doc], start = True, 0
        if room:
            break
        at = 0
        for d, s, n in current:
            out.append((d, s, n, sequence, at))
            at += n
        sequence += 1
        current = []
    total = sum(n for _, _, n in current)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    at = 0
    for d, s, n in current:
        while n:
            part = min(n, sizes[0] - at)
            out.append((d, s, part, sequence, at))
            s, n, at = s + part, n - part, at + part
            if at == sizes[0]:
                sizes.pop(0)
                sequence, at = sequence + 1, 0
    return out


#: Rows of the encoded table: documents, and each task's document frequencies.
DOCUMENT, STATISTICS = 0, 1


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        end = np.uint16(end_id)
        df, held, docs, tokens = np.zeros(0x10000, np.int64), [], 0, 0
        rows = lambda kind, names, ids: pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.int32()), names, pa.array(ids, pa.binary())], names=["kind", "doc_id", "ids"])
        for table in _grouped(batches, STEP_BYTES):
            texts, names = table["text"].combine_chunks(), table["doc_id"].combine_chunks()
            for begin, stop in steps(texts):
                flat, ends = pieces.encode(texts.slice(begin, stop - begin))
                own = [np.append(flat[ends[i] : ends[i + 1]], end).astype("<u2") for i in range(stop - begin)]
                for at in range(0, len(own), CHUNK_ROWS):
                    df += np.bincount(term_counts(own[at : at + CHUNK_ROWS])[1], minlength=0x10000)
                docs, tokens = docs + len(own), tokens + int(ends[-1]) + len(own)
                yield rows(DOCUMENT, names.slice(begin, stop - begin), [x.tobytes() for x in own])
        if docs:
            terms = np.flatnonzero(df)
            found = np.concatenate([[-1, docs, -2, tokens], np.stack([terms, df[terms]], axis=1).ravel()])
            yield rows(STATISTICS, pa.array([None], pa.int64()), [found.astype("<i8").tobytes()])
        give_back()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes: fewer and larger steps meet fewer distinct words."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 0.75 * most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _held(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    """The ids of a batch's rows, some rows at a time."""
    ids = batch.column(batch.schema.get_field_index("ids"))
    for at in range(0, len(ids), CHUNK_ROWS):
        yield [np.frombuffer(x, "<u2") for x in ids.slice(at, CHUNK_ROWS).to_pylist()]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a term and its document frequency; term -1 has the documents, -2 the tokens."""
    for batch in batches:
        for found in batch.column(batch.schema.get_field_index("ids")).to_pylist():
            term, df = np.frombuffer(found, "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])


def corpus_of(encoded: DataFrame) -> Corpus:
    """Statistics of all documents; at most one row for each id of the vocabulary reaches the driver."""
    parts = encoded.where(F.col("kind") == STATISTICS).select("ids").mapInArrow(_pairs, "term long, df long")
    rows = parts.groupBy("term").agg(F.sum("df").alias("df")).collect()
    found = {r["term"]: r["df"] for r in rows}
    df = np.zeros(0x10000, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return Corpus(found.get(-1, 0), found.get(-2, 0), df)


def keys(docs: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """Each document's weightiest term of those in two documents or more; its weightiest if none is."""
    owners, terms, counts = term_counts(docs)
    sizes = np.array([len(d) for d in docs], np.int64)
    weight = corpus.idf()[terms] * counts / (counts + corpus.norm(sizes)[owners])
    weight[corpus.df[terms] > 1] += 1e6
    order = np.argsort(owners, kind="stable")  # by term within a document, so the first of the weightiest counts
    owners, weight = owners[order], weight[order]
    begin = np.searchsorted(owners, np.arange(len(docs) + 1))
    top = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, begin[:-1]), np.diff(begin)))
    return terms[order[top[np.searchsorted(top, begin[:-1])]]].astype(np.int64)


def _keyed(corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of.cache_clear()  # all texts are encoded, and workers outlive their stage
        for batch in batches:
            some = [x for part in _held(batch) for x in part]
            of = np.concatenate([keys(some[at : at + CHUNK_ROWS], corpus) for at in range(0, len(some), CHUNK_ROWS)] or [np.empty(0, np.int64)])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "ids")]
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array([len(x) for x in some], pa.int64()), *columns], names=["key", "n", "doc_id", "ids"])
        give_back()

    return run


def shard_plan(loads: list[tuple[int, int, int]], shard_tokens: int, shard_docs: int = SHARD_DOCS) -> tuple[np.ndarray, np.ndarray, int]:
    """First shard and number of shards of each key, and the number of all shards.

    ``loads`` has key, documents and tokens. Small keys share a shard as long
    as it has room; a key beyond one shard is dealt to shards of its own.
    """
    first, parts = np.zeros(0x10000, np.int64), np.ones(0x10000, np.int64)
    shard, docs, tokens, total = -1, shard_docs, shard_tokens, 0
    for key, d, t in sorted(loads):
        if d > shard_docs or t > shard_tokens:
            parts[key] = min(d, math.ceil(max(d / shard_docs, t / shard_tokens) / FILL))
            first[key], total = total, total + parts[key]
            continue
        if docs + d > shard_docs or tokens + t > shard_tokens:
            shard, docs, tokens, total = total, 0, 0, total + 1
        first[key], docs, tokens = shard, docs + d, tokens + t
    return first, parts, int(total)


def _packer(corpus: Corpus, window: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        docs: list[np.ndarray] = []
        held, now, sequence = 0, None, 0

        def flush():
            nonlocal sequence, ids, docs, held
            packed = pack_shard(docs, window, corpus)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*packed))
            binary = pa.array([docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in packed], pa.binary())
            tokens = np.array([len(x) for x in docs], np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), binary, pa.array(tokens[doc]), pa.array(seq + sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(seq[-1]) + 1
            ids, docs, held = [], [], 0
            return out

        for batch in batches:
            shards, names, own = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "doc_id", "ids"))
            for shard, name, x in zip(shards, names, own):
                x = np.frombuffer(x, "<u2")
                if docs and (shard != now or held + len(x) > shard_tokens or len(docs) >= SHARD_DOCS):
                    yield flush()
                if shard != now:
                    now, sequence = shard, shard << 40
                ids.append(name)
                docs.append(x)
                held += len(x)
        if docs:
            yield flush()
        give_back()

    return run


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
    window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: the ids (little-endian, 32 bits) and their place.

    ``tokenizer`` is the path of a tokenizers file of the kind that
    ``wordpieces`` describes, the same on every machine. A document's ids are
    followed by ``end_id``.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    encoded = scratch.save(given.mapInArrow(_encoder(tokenizer, end_id), "kind int, doc_id long, ids binary"), "encoded")
    corpus = corpus_of(encoded)
    documents = encoded.where(F.col("kind") == DOCUMENT).select("doc_id", "ids")
    keyed = scratch.save(documents.mapInArrow(_keyed(corpus), "key int, n long, doc_id long, ids binary"), "keyed")
    scratch.drop(encoded)
    loads = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).collect()
    first, parts, total = shard_plan([tuple(r) for r in loads], shard_tokens)
    # a row for each term of the vocabulary that is a key
    plan = local_table(docs.sparkSession, [(r["key"], int(first[r["key"]]), int(parts[r["key"]])) for r in loads], "key int, first long, parts long")
    # rows without an id are told apart by their place
    salt = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())).bitwiseAND(F.lit((1 << 62) - 1))
    shard = (F.col("first") + salt % F.col("parts")).cast("int").alias("shard")
    dealt = keyed.join(F.broadcast(plan), "key").select(shard, "doc_id", "ids")
    dealt = dealt.repartitionById(max(1, total), "shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("ids"))
    return dealt.mapInArrow(_packer(corpus, window, shard_tokens), PIECES)


def checksum(ids: str) -> Column:
    """CRC-32 of a piece's ids."""
    return F.crc32(ids)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", checksum("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
