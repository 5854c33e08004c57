"""Bounded samples of labelled documents for the classifiers, and their held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assetloom.llm.arrow import local_table
from assetloom.storage import Scratch

#: Bytes of all texts of a sample at most.
SAMPLE_BYTES = 48 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, most_bytes: int = SAMPLE_BYTES
) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``limit`` training rows, the first by a hash of the id.

    Only labels of documents that are there count. Rows of the held-out fold
    are never read here. An id labelled twice takes its larger label; null ids
    and null labels do not train; equal rows are one. Whole texts are taken in
    that order while they have ``most_bytes`` together, and one that would
    exceed them is passed over.
    """
    spark = docs.sparkSession
    train = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    named = train.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    there = named.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    ids = local_table(spark, chosen, "doc_id long, label int")
    scratch = Scratch(spark, "labelled")
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = scratch.save(docs.select("doc_id", text).join(F.broadcast(ids), "doc_id"), "rows")
    sizes = rows.select("doc_id", F.xxhash64("text").alias("of"), F.octet_length("text").alias("size")).distinct()
    left, taken = most_bytes, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "of").limit(limit).collect():
        if r["size"] <= left:
            left -= r["size"]
            taken.append((r["doc_id"], r["of"]))
    kept = local_table(spark, taken, "doc_id long, of long")
    found = rows.withColumn("of", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])
    found = found.select(F.xxhash64("doc_id").alias("place"), "doc_id", "of", "text", "label").toArrow().sort_by(
        [("place", "ascending"), ("doc_id", "ascending"), ("of", "ascending")]
    )
    scratch.drop(rows)
    return found["text"].to_pylist(), found["label"].to_pylist()
