import pytest

SF = "/root/testdata/sf0.001"

EXTRA = "score double, row long, key string, words int, size long, text_ string, n_words long, copy int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and clashing extra columns."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    secret = 'token = "' + "0123456789abcdef" * 3 + '" é'
    rows = [
        (1, "one two three four", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "en", None), (5, long, "en", "b"),
        (6, "one two three four", "de", "b"), (7, "word", "en", "a"), (8, "word", "en", "a"), (8, "word", "en", "a"), (None, "x y z", "en", "a"),
        (9, secret, "en", "c"), (10, "Released under the MIT License.\n\nline é\nline é\n", "en", "c"), (None, None, None, None),
    ]
    full = [(*r, len(r[1] or ""), 0.5, 1, "k", 2, 3, "t", 4, 5) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def few_labels(spark):
    rows = [(1, 1, 0), (5, 0, 1), (7, 1, 0), (9, None, None), (None, 1, 1), (99, 0, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def pieces():
    from assetloom.llm import queries, wordpieces

    return wordpieces.WordPieces(queries.tokenizer_path("word_bpe_49k.json"))
