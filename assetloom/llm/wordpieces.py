"""Ids of a whitespace-dropping BPE tokenizer, whose merges never cross blanks.

Such a tokenizer gives a text the ids of its blank-separated chunks, one after
the other. Arrow kernels split the texts of a batch and find the distinct
chunks; chunks of plain letters, digits and marks are further cut into the
tokenizer's own pre-tokens, and only pre-tokens not met before go through its
merges. Other chunks are encoded as they stand. Ragged gathers put the ids
of pre-tokens, chunks and texts together, so no Python object is made per word.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens, and as many other chunks, that a worker remembers before it starts anew with those in use.
CACHE = 300_000
#: Bytes of text that are encoded at once.
STEP_BYTES = 4 << 20

_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]*$"
_CUT = r"([0-9]|[^a-zß-öø-ÿ0-9]+)"


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the slices ``which`` of a ragged array; also their new offsets."""
    starts = offsets[which]
    sizes = offsets[which + 1]
    sizes -= starts
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    starts -= ends[:-1]
    kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64  # half the memory where it is enough
    at = np.repeat(starts.astype(kind), sizes)
    at += np.arange(ends[-1], dtype=kind)
    return flat[at], ends


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    offsets = np.asarray(column.offsets, np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _byte_letters() -> dict[str, str]:
    """How the lower-case letters of ``_PLAIN`` beyond ASCII read in a byte-level vocabulary.

    There each byte is a character: printable ones stand for themselves, the
    others follow from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    show = lambda b: chr(b) if b in plain else chr(256 + others.index(b))
    letters = [*range(0xDF, 0xF7), *range(0xF8, 0x100)]
    return {chr(c): "".join(map(show, chr(c).encode())) for c in letters}


class _Store:
    """Ids by key, in one growing ragged array; keys are found by Arrow's hash join.

    Beyond ``most`` keys the store starts anew with those of the last call.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.encode, self.most = encode, most
        self.keys = pa.array([], pa.string())
        self.flat, self.offsets = np.empty(0, np.uint16), np.zeros(1, np.int64)
        self.last = np.empty(0, np.int64)

    def numbers(self, keys: pa.StringArray) -> np.ndarray:
        """Places of distinct keys in the store; what is new is encoded."""
        if len(self.keys) > self.most:
            self.keys = self.keys.take(pa.array(self.last))
            self.flat, self.offsets = gather(self.flat, self.offsets, self.last)
        at = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(pc.is_null(at))
        out = np.asarray(pc.fill_null(at, -1), np.int64)
        if len(new):
            out[out < 0] = len(self.keys) + np.arange(len(new))
            flats, sizes = [self.flat], [self.offsets]
            for i in range(0, len(new), 4000):
                flat, ends = self.encode(new.slice(i, 4000).to_pylist())
                flats.append(flat)
                sizes.append(ends + sizes[-1][-1])
            self.keys = pa.concat_arrays([self.keys, new])
            self.flat, self.offsets = np.concatenate(flats), np.concatenate(sizes)
        self.last = out
        return out

    def ids(self, keys: pa.StringArray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct keys, or of those picked from them by ``which``, ragged."""
        numbers = self.numbers(keys)
        return gather(self.flat, self.offsets, numbers if which is None else numbers[which])


class WordPieces:
    """Encodes texts to 16-bit ids, without special tokens added."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("the vocabulary must have 65,536 ids at most")
        self.ends = np.zeros(0x10000, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # pre-tokens are cut, in lower case and byte-level letters already, so only the merges are left to do
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.parts, self.others = _Store(self._pretokens, cache), _Store(self._each, cache)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
        return np.array([i for x in ids for i in x], np.uint16), ends

    def _pretokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many in one text; each ends with an end-of-word id, and the empty one has no ids."""
        own = [x for x in parts if x]
        text = " ".join(own)
        if not text.isascii():
            for letter, shown in self.letters.items():
                text = text.replace(letter, shown)
        flat = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(own):
            return self._each(parts)
        if len(own) < len(parts):
            ends = np.insert(ends, parts.index(""), ends[parts.index("") - 1] if parts.index("") else 0)
        return flat, ends

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, ragged."""
        plain = pc.and_not(pc.match_substring_regex(chunks, _PLAIN), pc.match_substring(chunks, "<|"))
        cut = pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _CUT, r" \1 ")
        parts, part_ends = _lists(pc.ascii_split_whitespace(cut))
        coded = parts.dictionary_encode()
        flat, ends = self.parts.ids(coded.dictionary, np.asarray(coded.indices))
        plain_ends = ends[part_ends]
        others = chunks.filter(pc.invert(plain))
        if not len(others):
            return flat, plain_ends
        other_flat, other_ends = self.others.ids(others)
        spots = np.asarray(plain.cast(pa.int8())).astype(bool)
        order = np.empty(len(chunks), np.int64)
        order[spots] = np.arange(spots.sum())
        order[~spots] = spots.sum() + np.arange(len(others))
        both_ends = np.concatenate([plain_ends, plain_ends[-1] + other_ends[1:]])
        return gather(np.concatenate([flat, other_flat]), both_ends, order)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids; null is empty."""
        words, ends = _lists(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
        coded = words.dictionary_encode()
        del words
        flat, chunk_ends = self._chunks(coded.dictionary)
        ids, word_ends = gather(flat, chunk_ends, np.asarray(coded.indices))
        return ids, word_ends[ends]


@lru_cache(1)
def pieces_of(path: str) -> WordPieces:
    """The process's encoder, whose store serves one task after another."""
    return WordPieces(path)


def steps(texts: pa.StringArray, most: int = STEP_BYTES):
    """Ranges of rows whose texts have about ``most`` bytes together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    upto = np.cumsum(np.asarray(sizes, np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, min(end, len(texts))
        at = end
