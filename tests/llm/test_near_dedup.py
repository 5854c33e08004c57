import random

import numpy as np
import pytest

from assetloom.llm import near_dedup, queries
from tests.llm.conftest import SF
from tests.oracle import same


def plain(rows, shingle, threshold=80):
    """Smallest reachable id of every row, from all pairs."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(shingle, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k][1]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(frame, **options):
    rows = near_dedup.near_duplicates(frame, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def test_against_sql(spark):
    same(spark, SF, queries.queries()["op10_near_dedup"], queries.oracle_sql()["op10_near_dedup"])


def family(rng, size, words, edits):
    base = [f"v{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"u{rng.randrange(5000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("shingle,small", [(2, 32), (2, 1), (5, 32), (5, 1)])
def test_families(spark, monkeypatch, shingle, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    rng = random.Random(shingle)
    texts = [t for size, words, edits in ((40, 120, 14), (25, 40, 5), (30, 9, 3), (12, 4, 2)) for t in family(rng, size, words, edits)]
    texts += ["one", "one", "ONE", "two words", "Two  words", "", None, " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame, shingle=shingle) == plain(rows, shingle)


@pytest.mark.parametrize("ids", [500_000, 0])
def test_split_buckets(spark, monkeypatch, ids):
    """Buckets beyond a few rows are dealt to parts, by a broadcast of their keys or all alike, without any change of the result."""
    monkeypatch.setattr(near_dedup, "HOT", 4)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 6)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", ids)
    rng = random.Random(8)
    rows = list(enumerate(family(rng, 60, 80, 8) + family(rng, 30, 30, 3) + family(rng, 20, 6, 3)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame, shingle=2) == plain(rows, 2)


def test_split_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(3)] + [(3, 1)], "key long, nid long")
    right = spark.createDataFrame([(1, 40, "a"), (2, 3, "b")], "key long, c long, x string")
    out = near_dedup.split_join(left, right, "key", "nid", hot=5).collect()
    assert sorted((r["key"], r["nid"], r["x"]) for r in out) == [(1, i, "a") for i in range(40)] + [(2, i, "b") for i in range(3)]
    assert {r["salt"] for r in out if r["key"] == 1} == set(range(8)) and {r["salt"] for r in out if r["key"] == 2} == {0}


def test_only_tables_of_the_result_stay(spark, monkeypatch):
    from assetloom import storage

    made = []
    init = storage.Scratch.__init__
    monkeypatch.setattr(storage.Scratch, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    rows = list(enumerate(family(random.Random(2), 20, 60, 6)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    import os

    stored = [name for x in made if os.path.isdir(x.base) for name in os.listdir(x.base)]
    assert sorted(n[4:] for n in stored) == ["by-class", "sketched"] and out.count() == 20


def test_shuffled_ids_path(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rng = random.Random(3)
    rows = list(enumerate(family(rng, 20, 60, 6)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame, shingle=2) == plain(rows, 2)
    assert near_dedup.deduplicate(frame, shingle=2).count() == len({c for _, _, c in plain(rows, 2)})


def test_estimate_is_near():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        both = int(share * 2000)
        a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[:both], pool[2000 : 4000 - both]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        near = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(near[0] - true) < 0.12


def test_messy(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert got(messy, shingle=2) == plain(rows, 2)
    kept = near_dedup.deduplicate(messy, shingle=2)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 9, 10]
    assert near_dedup.near_duplicates(messy.limit(0)).count() == 0 == near_dedup.deduplicate(messy.limit(0)).count()


def test_rows_without_own_ids_stay(spark, messy):
    """Distinct texts stay though their ids are null or repeated; copies and near copies go."""
    kept = near_dedup.deduplicate(messy, shingle=2).collect()
    assert sorted((r["text"] for r in kept if r["doc_id"] is None), key=str) == [None, "x y z"]
    long = " ".join(f"t{k}" for k in range(60))
    rows = [
        (None, "a b c"), (None, "d e f"), (None, "d e f"), (None, None), (None, ""), (None, "k l m"), (None, long), (None, long + " end"),
        (1, "k l m"), (2, "n o p"), (2, "q r s"), (2, "q r s"), (2, "k l m"), (3, ""), (3, None), (4, "n o p"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicate(frame, shingle=2).collect()]
    near = [t for _, t in got if t and t.startswith(long)]
    assert len(near) == 1
    wordless = [i for i, t in got if not t]
    assert sorted(wordless, key=str) == [3, None, None]
    rest = sorted(((i, t) for i, t in got if t and not t.startswith(long)), key=str)
    assert rest == [(1, "k l m"), (2, "n o p"), (2, "q r s"), (None, "a b c"), (None, "d e f")]
