from collections import Counter, defaultdict

import pytest

from assetloom.llm import line_quality, queries
from tests.llm.conftest import SF
from tests.oracle import same


def test_against_sql(spark):
    same(spark, SF, queries.queries()["op9_quality_rules"], queries.oracle_sql()["op9_quality_rules"])


def plain_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)})


def test_repeats(texts):
    for text in [*texts.values(), "a a a a", "a b c a b c", "a b", "", "a b c b c a b c"]:
        words = text.encode().split()
        assert line_quality.repeated_words(words) == plain_repeats(words)


SCHEMA = "doc_id long, text string, source string"


def plain_removed(rows, most):
    """Words that go from each row: those of lines in more than ``most`` distinct documents of the host."""
    found = defaultdict(set)
    normal = lambda line: " ".join(line.encode().lower().decode().split())
    for k, (i, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            found[host, normal(line)].add((i, k if i is None else None))
    return [sum(len(x.split()) for x in (t or "").split("\n") if x.split() and len(found[h, normal(x)]) > most) for _, t, h in rows]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_frequent_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", broadcast)
    line = "subscribe to our   NEWSLETTER today"
    rows = [(i, f"own words number {i} " * 30 + f"{i}\n{line.lower() if i % 2 else line}", "h") for i in range(6)]
    rows += [(20 + i, line + "\n" + line.upper(), "h") for i in range(2)] + [(30, line, "g")] + [(40, line, "h")] * 5
    rows += [(50, "again\nand again", "k")] * 9 + [(None, "no id\nat all", "k")] * 4 + [(60 + i, "the same text\nof two lines", None) for i in range(4)]
    out = line_quality.line_quality(spark.createDataFrame(rows, SCHEMA), max_docs=3).collect()
    got = sorted((str(r["doc_id"]), r["removed_words"]) for r in out)
    assert got == sorted((str(i), n) for (i, _, _), n in zip(rows, plain_removed(rows, 3)))
    by_id = {r["doc_id"]: r for r in out}
    assert {by_id[i]["removed_words"] for i in range(6)} == {5} and not by_id[0]["depleted"]
    assert by_id[20]["depleted"] and by_id[40]["depleted"] and by_id[60]["depleted"] and by_id[None]["depleted"]
    assert by_id[30]["removed_words"] == 0 == by_id[50]["removed_words"]


def test_copies_are_documents(spark):
    """505 documents share a footer, 500 of them with equal text."""
    rows = [(i, "one text\nthe footer", "h") for i in range(500)] + [(500 + i, f"words of {i} alone " * 20 + "\nthe footer", "h") for i in range(5)]
    out = line_quality.line_quality(spark.createDataFrame(rows, SCHEMA))
    assert out.where("doc_id < 500").select("removed_words").distinct().collect() == [(4,)]
    assert out.where("doc_id >= 500").select("removed_words").distinct().collect() == [(2,)]


def test_limit_follows_the_host(spark):
    """Thirty documents of a line are many in a host of 100, and few in one of 4,000."""
    make = lambda host, n: [(n + i, "a line of thirty" if i < 30 else f"line {i}", host) for i in range(n)]
    out = line_quality.line_quality(spark.createDataFrame(make("small", 100) + make("large", 4_000), SCHEMA))
    assert out.where("removed_words > 0").count() == 30 and out.where("removed_words > 0 and doc_id >= 4000").count() == 0


def test_messy(messy):
    rows = defaultdict(list)
    for r in line_quality.line_quality(messy).collect():
        rows[r["doc_id"]].append(r)
    assert sum(map(len, rows.values())) == messy.count() and len(rows[8]) == 2
    assert all(r["base_failed"] and r["n_words"] == 0 for i in (2, 3, 4) for r in rows[i])
    assert rows[5][0]["n_words"] == 60_000 and rows[10][0]["n_dup_lines"] == 1
    assert line_quality.line_quality(messy.limit(0)).count() == 0
