import re

import pytest

from assetloom.llm import mixing, queries
from tests.llm.conftest import SF
from tests.oracle import same


def plain_targets(sizes):
    """Reshares what caps leave over, round by round."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while budget > 1e-9 and open_:
        total = sum(weight[k] for k in open_)
        share = {k: budget * weight[k] / total for k in open_}
        budget = 0.0
        for k in list(open_):
            target[k] += share[k]
            if target[k] >= 2 * sizes[k]:
                budget += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                open_.discard(k)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_against_sql(spark):
    same(spark, SF, queries.queries()["op8_mixing"], queries.oracle_sql()["op8_mixing"])


@pytest.mark.parametrize("rows_per_range", [1, 20_000])
def test_targets_and_budgets(documents, rows_per_range):
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    rows = mixing.mix(documents, rows_per_range=rows_per_range).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and 0 <= target[s] - taken[s] < 1
    again = mixing.mix(documents.repartition(5), rows_per_range=rows_per_range).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_messy(messy):
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count()
    assert sum(r["size"] for r in rows) == sum(words(r["text"]) for r in messy.collect())
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(messy.limit(0)).count() == 0


def test_documents_hold_what_is_taken(messy):
    out = mixing.mix_documents(messy)
    assert out.columns == messy.columns
    taken = sum(r["taken"] for r in mixing.mix(messy).collect())
    assert sum(words(r["text"]) for r in out.collect()) == taken
    assert mixing.mix_documents(messy.limit(0)).count() == 0


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def total(frame):
    found = {}
    for r in frame.collect():
        found[r["source"]] = found.get(r["source"], 0) + words(r["text"])
    return found


@pytest.mark.parametrize("equal", ["id and text", "id and size", "null ids"])
def test_the_cut_is_exact_among_equal_rows(spark, equal):
    """400 rows that tie at the cut: the mixture has as many words as ``mix`` takes."""
    text = lambda k: " ".join(["word" if equal != "id and size" else f"w{k}x{j}" for j in range(80)])
    rows = [(None if equal == "null ids" else 7, text(k), "a") for k in range(400)] + [(100 + k, text(k) + " more", "b") for k in range(30)]
    if equal == "null ids":
        rows += [(None, text(k), "c") for k in range(300)]
    frame = frame_of(spark, rows).repartition(5)
    sizes = {}
    for _, body, s in rows:
        sizes[s] = sizes.get(s, 0) + words(body)
    out = total(mixing.mix_documents(frame))
    assert sum(out.values()) == sum(r["taken"] for r in mixing.mix(frame).collect())
    assert all(0 <= t - out[s] < 1 for s, t in plain_targets(sizes).items())


@pytest.mark.parametrize("few", [100_000, 3])
def test_hot_ids_and_many_sources(spark, monkeypatch, few):
    """A range whose rows repeat an id is split, and sources are summed in ranges, without any change of the result."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rng = __import__("random").Random(4)
    rows = [(rng.randrange(40) if k % 3 else 7, "w " * rng.randint(0, 9), rng.choice([*"abcdefghijk", None])) for k in range(600)]
    frame = frame_of(spark, rows).repartition(6)
    want = sorted(map(tuple, mixing.mix(frame, rows_per_range=100_000).collect()))
    split = sorted(map(tuple, mixing.mix(frame, rows_per_range=2).collect()))
    assert [x[:4] for x in split] == [x[:4] for x in want] and sum(x[4] for x in split) == sum(x[4] for x in want)
    assert sorted(x[4] for x in split) == sorted(x[4] for x in want)
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + words(text)
    got = total(mixing.mix_documents(frame, rows_per_range=2))
    assert all(0 <= t - got.get(s, 0) < 1 for s, t in plain_targets(sizes).items())
