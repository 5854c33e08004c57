import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assetloom.llm import packing, queries, secrets, wordpieces
from assetloom.llm.arrow import local_table
from assetloom.llm.labelled import labelled_sample
from assetloom.llm.wordpieces import pieces_of

PATH = queries.tokenizer_path("word_bpe_49k.json")
ODD = [
    "Don't <|endoftext|> x'S ΑΣ σ İ ½²ª\xa0x y é '\x1c'", "", None, "  lead trail  ", "a" * 3000 + " it's 'tis I'LL 12,345.67 日本語 ß ÿŸ plain",
    "é Å K ﬁ   x y", "!!??..## a1b22c %%%", " line sep \u0085 x", "<|startoftext|>", "naïve CAFÉ é",
]


def test_ids_are_the_tokenizers(pieces, texts):
    some = [*ODD, *texts.values()]
    flat, ends = pieces.encode(pa.array(some, pa.string()))
    for i, text in enumerate(some):
        assert flat[ends[i] : ends[i + 1]].tolist() == pieces.tokenizer.encode(text or "", add_special_tokens=False).ids


SCRIPTS = {
    "cyrillic": [chr(c) for c in range(0x430, 0x450)], "greek": [chr(c) for c in range(0x3B1, 0x3C9)],
    "cjk": [chr(c) for c in range(0x4E00, 0x4E00 + 300)], "apostrophes": [*"aeinorst", "'", "l'", "n't"],
}


def scripted(name, n=10_000):
    """``n`` distinct words of a script, as texts of 250 words."""
    rng = random.Random(name)
    found = set()
    while len(found) < n:
        found.add("".join(rng.choice(SCRIPTS[name]) for _ in range(rng.randint(3, 9))))
    some = sorted(found)
    return [" ".join(some[at : at + 250]) for at in range(0, n, 250)]


@pytest.mark.parametrize("name", sorted(SCRIPTS))
def test_many_words_of_any_script(pieces, name):
    some = scripted(name)
    own = wordpieces.WordPieces(PATH)
    flat, ends = own.encode(pa.array(some))
    for i, text in enumerate(some):
        assert flat[ends[i] : ends[i + 1]].tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids


def test_scripts_are_packed(spark, pieces):
    rows = list(enumerate(t for name in sorted(SCRIPTS) for t in scripted(name)))
    want = {i: [*pieces.tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(packing.digest(packing.pack(frame, PATH)).collect(), want)


def test_cache_restarts(texts):
    small = wordpieces.WordPieces(PATH, cache=10)
    for text in list(texts.values())[:5]:
        flat, _ = small.encode(pa.array([text]))
        assert flat.tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, want):
    """Every id lies in one piece, sequences are gapless, and only powers of two are short."""
    docs, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        part = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        docs[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(docs) == set(want)
    for name, parts in docs.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(want[name])
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


@pytest.mark.parametrize("shard", [3_000, 2_000_000])
def test_pieces(documents, pieces, texts, shard):
    want = {i: [*pieces.tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    check(packing.digest(packing.pack(documents, PATH, shard_tokens=shard)).collect(), want)


def test_neighbours_are_lexical():
    rng = np.random.default_rng(2)
    topics = [rng.integers(1000 * k, 1000 * k + 60, 300).astype(np.uint16) for k in (1, 2, 3) for _ in range(20)]
    index = packing.Bm25Shard(topics)
    used = np.zeros(60, bool)
    used[[0, 5]] = True
    near = index.neighbours(0, used)
    assert len(near) == packing.NEIGHBOURS and all(1 <= d < 20 and d != 5 for d in near)


def test_messy(messy, pieces):
    some = messy.where("doc_id is not null and doc_id <> 8")
    want = {r["doc_id"]: [*pieces.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in some.collect()}
    check(packing.digest(packing.pack(some, PATH)).collect(), want)
    assert packing.pack(messy, PATH).where("start = 0").count() == messy.count()
    assert packing.pack(messy.limit(0), PATH).count() == 0


def test_shards_are_of_contents(spark, pieces):
    """Documents of one topic meet in a sequence although every file has one document of each topic."""
    rng = random.Random(6)
    vocabulary = [[f"{c}{d}zq{k}" for c in "bcdfg" for d in "klmnp"] for k in range(6)]
    rows = [(100 * k + i, " ".join(rng.choices(vocabulary[k], k=60))) for i in range(12) for k in range(6)]
    shapes = []
    for parts in (12, 1):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = packing.pack(frame, PATH, shard_tokens=8_000).collect()
        shapes.append(sorted((r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in out))
    assert shapes[0] == shapes[1]
    topics = defaultdict(list)
    for name, _, length, sequence, _ in shapes[0]:
        topics[sequence] += [name // 100] * length
    assert sum(max(map(t.count, set(t))) for t in topics.values()) > 0.6 * sum(map(len, topics.values()))


def test_statistics_are_of_the_table(spark):
    rows = [(i, f"common word{i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    encoded = frame.mapInArrow(packing._encoder(PATH, 1), "kind int, doc_id long, ids binary")
    corpus = packing.corpus_of(encoded)
    assert corpus.docs == 40 == corpus.df.max() and corpus.df[1] == 40
    ids = [np.frombuffer(r["ids"], "<u2") for r in encoded.where("kind = 0").collect()]
    assert corpus.tokens == sum(map(len, ids)) and corpus.df.sum() == sum(len(set(x.tolist())) for x in ids)


def test_shard_plan():
    loads = [(5, 10, 100), (7, 10, 300), (9, 1000, 5000), (11, 3, 800)]
    first, parts, total = packing.shard_plan(loads, 1000)
    assert first[5] == first[7] == 0 and parts[9] == 6 and total == 8
    assert len({int(first[k]) + p for k in (5, 9, 11) for p in range(parts[k])}) == total


def test_windows_use_all_neighbours():
    """Forty short documents of the seed's topic come before others, as does one that shares the seed's lightest term."""
    near = [np.array([1000, 2000 + i], np.uint16) for i in range(40)]
    far = [np.array([3000 + i, 4000 + i], np.uint16) for i in range(40)]
    docs = [x for pair in zip(near, far) for x in pair]
    packed = packing.pack_shard(docs, window=80)
    assert {d % 2 for d, _, _, sequence, _ in packed if sequence == 0} == {0}
    seed = np.concatenate([np.arange(100, 130), [7]]).astype(np.uint16)
    docs = [seed, *[np.array([500 + i], np.uint16) for i in range(9)], *[np.array([7, 7], np.uint16)] * 2]
    assert set(packing.Bm25Shard(docs).neighbours(0, np.arange(12) == 0)) == {10, 11}


def test_scores_are_of_all_terms():
    rng = np.random.default_rng(5)
    docs = [np.minimum(rng.zipf(1.3, 200), 60_000).astype(np.uint16) for _ in range(80)]
    mixed = packing.Bm25Shard(docs)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=0x10000)
    mean = sum(map(len, docs)) / 80
    for seed in (0, 40):
        want = [
            sum(np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean))
                for t in np.unique(docs[seed]) if (c := (d == t).sum()))
            for d in docs
        ]
        assert np.allclose(mixed.scores(seed), want, rtol=1e-4)


def test_driver_rows_start_no_python(spark):
    """An RDD of pickled rows would start a second Python daemon on each executor."""
    found = local_table(spark, [(1, 2), (3, None)], "key int, first long")
    assert found.dtypes == [("key", "int"), ("first", "bigint")]
    assert {tuple(r) for r in found.collect()} == {(1, 2), (3, None)}
    empty = local_table(spark, [], "of long")
    assert empty.dtypes == [("of", "bigint")] and empty.collect() == []
    for frame in (found, empty):
        assert "ExistingRDD" not in frame._jdf.queryExecution().toString()


def test_plan_and_samples_start_no_python(spark, monkeypatch):
    """No stage makes a DataFrame of Python rows."""
    monkeypatch.setattr(spark, "_createFromLocal", None, raising=False)
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('token: ab', id, 'cdef', id * 7919, ' text number ', id) AS text")
    labels = spark.range(60).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    assert packing.pack(docs, PATH).agg({"length": "sum"}).first()[0] > 60
    assert secrets.redact(docs).count() == 60
    assert len(labelled_sample(docs, labels, "toxic", 5, 0, 100)[0]) > 0


def test_encoder_goes_once_all_is_encoded():
    pieces_of(PATH)
    assert pieces_of.cache_info().currsize == 1
    corpus = packing.Corpus(0, 0, np.zeros(0x10000, np.int64))
    assert list(packing._keyed(corpus)(iter(()))) == []
    assert pieces_of.cache_info().currsize == 0
