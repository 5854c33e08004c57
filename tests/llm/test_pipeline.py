"""The pipeline against plain versions of its decisions, stage by stage."""

import re

import corpus_pipeline
from assetloom.llm import queries, secrets, toxicity
from tests.llm.conftest import SF
from tests.llm.test_near_dedup import plain
from tests.llm.test_packing import check


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark, documents, labels, pieces):
    given = documents
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents, labels).collect()}
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = (given, given := stage(spark, given, SF).cache())
        if name != "packing":
            assert given.columns == documents.columns
    rows = lambda frame: [(r["doc_id"], r["text"]) for r in frame.collect()]
    before, after = outs["toxicity"]
    assert sorted(rows(after)) == sorted(r for r in rows(before) if scores[r[0]] < 0.5)
    before, after = outs["near duplicates"]
    assert {i for i, _ in rows(after)} == {i for i, _, c in plain(rows(before), 2) if i == c}
    before, after = outs["secrets"]
    model = secrets.fit_formats(secrets.extract(before))
    assert sorted(rows(after)) == sorted((i, secrets.redact_text(t.encode(), model).decode()) for i, t in rows(before))
    before, after = outs["mixing"]
    size, taken = {}, {}
    for r in before.collect():
        size[r["source"]] = size.get(r["source"], 0) + words(r["text"])
    for r in after.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    from tests.llm.test_mixing import plain_targets

    assert all(0 <= t - taken.get(s, 0) < 1 for s, t in plain_targets(size).items())
    before, after = outs["packing"]
    tokens = sum(len(pieces.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows(before))
    assert sum(r["length"] for r in after.collect()) == tokens
    assert all(len(r["ids"]) == 4 * r["length"] for r in after.collect())


def test_run_is_registered(spark):
    out = queries.queries()["pipeline"](spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    from assetloom import storage

    monkeypatch.setattr(storage, "shared_root", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    tables = [p for p in tmp_path.rglob("*") if p.is_dir() and any(p.glob("*.parquet"))]
    assert len(tables) == 1 and out.count() > 0


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=str)


def test_toxicity_stage_keeps_rows_without_text(spark, messy):
    """Rows without evidence score as clean, whatever is null; repeated rows stay."""
    out = stage("toxicity")(spark, messy, SF)
    assert out.schema == messy.schema and ids(out) == ids(messy)
    bad = spark.createDataFrame([(1, "you idiot, you stupid idiot scum " * 5), (2, "quiet words"), (None, None)], "doc_id long, text string")
    assert ids(stage("toxicity")(spark, bad, SF)) == [2, None]


def test_near_duplicate_stage_keeps_distinct_texts(spark, messy):
    """Equal and near texts are one row, of the smallest id; rows without words are one for each id, and all without one stay."""
    out = stage("near duplicates")(spark, messy, SF)
    assert out.columns == messy.columns and ids(out) == sorted([1, 2, 3, 4, 5, 7, 9, 10, None, None], key=str)
    assert sorted((r["text"] for r in out.collect() if r["doc_id"] is None), key=str) == [None, "x y z"]


def test_secret_stage_keeps_rows(spark, messy):
    """Every row stays as it is but for its secrets; null texts stay null."""
    out = stage("secrets")(spark, messy, SF)
    assert out.schema == messy.schema
    rows = lambda frame: sorted(map(str, (r for r in frame.collect() if r["doc_id"] != 9)))
    assert rows(out) == rows(messy)
    assert [r["text"] for r in out.collect() if r["doc_id"] == 9] == ['[SECRET]" é']


def test_mixing_stage_is_exact(spark, messy):
    """Rows without words go; every source, the null one too, meets its target to a word, and other columns follow their row."""
    from tests.llm.test_mixing import plain_targets

    out = stage("mixing")(spark, messy, SF)
    assert out.columns == messy.columns
    size, taken = {}, {}
    for r in messy.collect():
        size[r["source"]] = size.get(r["source"], 0) + words(r["text"])
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
        assert words(r["text"]) > 0 and r["n_chars"] == len(r["text"]) and (r["score"], r["key"], r["text_"]) == (0.5, "k", "t")
    assert all(0 <= t - taken.get(s, 0) < 1 for s, t in plain_targets(size).items())


def test_packing_stage_packs_every_row(spark, messy, pieces):
    """Each row is packed, a null text as its end id alone, and rows that repeat an id one by one."""
    out = stage("packing")(spark, messy, SF).collect()
    tokens = [len(pieces.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in messy.collect()]
    assert sum(r["length"] for r in out) == sum(tokens) and sum(r["start"] == 0 for r in out) == messy.count()
    some = messy.where("doc_id is not null and doc_id <> 8")
    want = {r["doc_id"]: [*pieces.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in some.collect()}
    check(stage("packing")(spark, some, SF).collect(), want)


def test_empty_tables(spark, messy):
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, messy.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == messy.columns)


def test_stages_in_a_row(spark, messy):
    given = messy
    for name, run in corpus_pipeline.STAGES:
        given = run(spark, given, SF)
    assert given.count() > 0 and {r["doc_id"] for r in given.select("doc_id").distinct().collect()} <= {1, 5, 7, 9, 10, None}
