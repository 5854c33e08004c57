"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents that the stage before kept, and
the folder of the input tables. It returns a DataFrame, which is written as
Parquet and reread for the next stage. All but the last keep the columns of
``documents``, and further columns if there are any, whatever their names.

Rows, stage by stage:

- toxicity: null and empty texts score as texts without evidence and stay, as
  do null ids and repeated rows;
- near duplicates: of linked rows one of the smallest id stays; rows without
  words are linked with nothing, one stays for each id, and all without an id;
- secrets: all rows stay, null texts as null;
- mixing: documents without words go; a null source is a source of its own;
  rows may come twice, and one for each source is cut; of rows that tie at the
  cut as many are taken as its budget holds;
- packing: null text is empty and has the end id alone; repeated rows are
  packed one by one; other columns are dropped.

Very long texts are whole in every stage, and an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm import mixing, near_dedup, packing, secrets, toxicity
from assetloom.llm.queries import table, tokenizer_path
from assetloom.storage import Scratch, cleared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs, shingle=2)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by placeholders."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: repeated epochs, and a cut at each source's budget."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences, with their ids and a checksum."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("*", packing.checksum("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores and tokenizers are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all stages applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with cleared(spark):  # a stage's own tables go once its result is written
            out = scratch.save(stage(spark, docs, sf_dir), "stage")
        if k:
            scratch.drop(docs)
        docs = out
    return docs
