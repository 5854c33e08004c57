"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key that is uniform by hashing (the MD5 of its id and a
seed), so the leading hex digits of the key cut each source into ranges of
nearly equal size without sampling, however large the source is. Sums by
(source, range) are partial aggregates; a window over these few sums gives
each range its offset, and a second window inside a range completes the
prefix sum. The budget of a source is whole epochs plus one cut, which falls
inside a single document.

Rows: null text has size 0; a null source is a source of its own, after all
others; repeated rows and null ids are mixed row by row; an empty table gives
an empty result. Ties of the key are ordered by id and size, so rows that tie
in all three are interchangeable and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assetloom.operators.ordered import running_sums
from assetloom.storage import Scratch

WORD = r"[^\x20\x09-\x0D]++"
BLANKS = "\t\n\x0b\f\r"
WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2
CAP = 2


def word_count(text: Column) -> Column:
    """Number of words in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Sources up to this number are summed in one task, and may be broadcast (a row of fixed size each).
FEW_SOURCES = 100_000


def _prefix(frame: DataFrame, scratch: Scratch, n: int, order: list[Column], **sums: Column) -> DataFrame:
    """``frame`` with running sums, the row's own included, in the given order.

    Beyond ``FEW_SOURCES`` rows, ranges of the order share the work.
    """
    if n <= FEW_SOURCES:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return frame.select("*", *[F.sum(c).over(upto).alias(k) for k, c in sums.items()])
    return running_sums(frame, scratch, order, FEW_SOURCES, **sums)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from one row ``(source, source_size)`` per source.

    Weights repeat over the sources by code point, null last. The targets
    share 3/2 of all sizes by weight, capped at twice a source's size; what a
    cap leaves over goes to the others by weight. At the end every uncapped
    source has the same level, target / weight, and the capped ones are those
    of the smallest cap / weight: so the level follows from running sums.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    sizes = scratch.save(sizes, "sizes")
    n, total = sizes.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    numbered = _prefix(sizes, scratch, n, [F.col("source").asc_nulls_last()], rn=F.lit(1)).withColumn("w", w.cast("long"))
    base = numbered.withColumn("cap", (F.col("source_size") * CAP).cast("long"))
    base = scratch.save(base.withColumn("ratio", F.col("cap").cast("double") / F.col("w")), "base")
    weight = base.agg(F.sum("w")).first()[0] or 0
    run = _prefix(base, scratch, n, [F.col("ratio"), F.col("rn")], caps=F.col("cap"), upto=F.col("w"))
    # 2 * budget = 3 * total is whole, so the numerator is exact
    level = (F.lit(SHARE_NUM * (total or 0)) - SHARE_DEN * (F.col("caps") - F.col("cap"))).cast("double") / (
        SHARE_DEN * (F.lit(weight) - F.col("upto") + F.col("w"))
    )
    first = run.withColumn("level", level).agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn", "level")))["level"]).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(float("inf") if first is None else first) * F.col("w"))
    return base.select("source", "source_size", target.alias("target"))


def order_key(doc_id: Column, seed: str) -> Column:
    """The hash-random key of a document."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


#: A range is hot if it has so many times the rows that it should have; then rows repeat an id.
HOT_RANGE = 4


def _ranges(rows: DataFrame, scratch: Scratch, rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their range, and the rows and words of each range.

    Keys are cut by their leading digits. Only rows with equal ids can make a
    range much larger than others; in such a range each key, size and
    partition of the input is a range of its own, in the same order.
    """
    n = rows.select(F.count(F.lit(1)).alias("n")).first()["n"]
    digits = 2
    while 16**digits * rows_per_range < n:
        digits += 1
    total = lambda frame: frame.groupBy("source", "range").agg(F.sum("size").alias("range_size"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    sums = scratch.save(total(rows), "ranges")
    hot = sums.where(F.col("n") > HOT_RANGE * rows_per_range).select(F.col("source").alias("h_source"), F.col("range").alias("h_range"))
    found = hot.count()
    if not found:
        return rows, sums
    whole = lambda c: F.lpad(c.cast("string"), 20, "0")
    own = F.concat("key", F.lit(":"), whole(F.col("size")), F.lit(":"), whole(F.spark_partition_id()))
    hot = F.broadcast(hot) if found <= FEW_SOURCES else hot
    rows = rows.withColumn("own", own).join(hot, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("range") == F.col("h_range")), "left")
    rows = rows.withColumn("range", F.when(F.col("h_range").isNotNull(), F.col("own")).otherwise(F.col("range"))).drop("own", "h_source", "h_range")
    rows = scratch.save(rows, "rows")
    return rows, scratch.save(total(rows), "split-ranges")


def _placed(docs: DataFrame, text: str, doc_id: str, source: str, weights: tuple[int, ...], seed: str, rows_per_range: int) -> DataFrame:
    """Every row with its source's epochs, and the words that the last pass takes of it."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order_key(F.col(doc_id), seed).alias("key")
    )
    scratch = Scratch(docs.sparkSession, "mix")
    rows, sums = _ranges(rows, scratch, rows_per_range)
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").cast("long").alias("source_size")), weights)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("p_source"), F.col("range").alias("p_range"), "offset", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(
        plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range"))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    once_more = F.least(F.col("size"), F.greatest(F.lit(0), rest - start)).cast("long")
    return placed.select("source", "key", "doc_id", "size", "source_size", "target", epochs.alias("epochs"), once_more.alias("once_more"))


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix-1",
    rows_per_range: int = 20_000,
) -> DataFrame:
    """Return ``doc_id, size, source_size, target, taken`` for every row.

    ``taken`` counts words with repeats: whole epochs of the source, then, in
    key order, one more pass that stops at the exact rest of the budget (whole
    words; the document at the cut gives its leading words).
    """
    placed = _placed(docs, text, doc_id, source, weights, seed, rows_per_range)
    taken = F.col("epochs") * F.col("size") + F.col("once_more")
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, whitespace kept."""
    parts = F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ")
    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("end"))
    upto = F.aggregate(
        parts, zero,
        lambda acc, p: F.when(acc["words"] >= n, acc).otherwise(
            F.struct(
                (acc["words"] + (F.length(p) > 0).cast("long")).alias("words"),
                (acc["end"] + F.length(p) + 1).cast("long").alias("end"),
            )
        ),
    )["end"]
    return F.substring(text, F.lit(1), F.greatest(upto, F.lit(0)).cast("int"))


def mix_documents(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix-1", rows_per_range: int = 20_000,
) -> DataFrame:
    """The mixture itself, with the columns of ``docs``.

    A document comes once for each epoch that takes it whole, and once more
    with its leading words if the cut falls inside it; documents that are not
    taken, and those without words, go. ``n_chars``, if there, follows the text.

    The prefix sums give each source's place of the cut, so rows are compared
    with it where they are, and texts move only above ``FEW_SOURCES`` sources.
    Rows that repeat the id and size of the document at the cut are numbered,
    and as many of them as the budget holds go with it.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    place = F.struct("key", "doc_id", "size")
    short = F.col("once_more") < F.col("size")
    # at each place: rows taken whole, rows in all, and the words of the one that is cut
    taken = _placed(docs, text, doc_id, source, weights, seed, rows_per_range).where("size > 0").select(
        "source", "epochs", "once_more", place.alias("place"), short.alias("short")
    )
    edge = F.min(F.when(F.col("short"), F.col("place"))).alias("cut")
    last = F.max(F.when(~F.col("short"), F.col("place"))).alias("last")
    cuts = taken.groupBy("source").agg(
        F.max("epochs").alias("epochs"), edge, last, F.max(F.when(F.col("short"), F.col("once_more"))).alias("part_words")
    )
    cuts = scratch.save(cuts, "cuts")
    few = cuts.count() <= FEW_SOURCES
    near = F.broadcast(cuts) if few else cuts
    names = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"))
    body, size = F.col("given")[text], word_count(F.col("given")[text])
    own = F.struct(order_key(F.col("given")[doc_id], seed).alias("key"), F.col("given")[doc_id].alias("doc_id"), size.alias("size"))
    rows = given.withColumn("own", own).where("own.size > 0").join(near, F.col("given")[source].eqNullSafe(near["source"]))
    before = F.coalesce(F.col("own") < F.col("cut"), F.lit(True))
    at_cut = F.coalesce(F.col("own") == F.col("cut"), F.lit(False))
    number = F.lit(0).cast("long")
    tied = F.coalesce(F.col("last") == F.col("cut"), F.lit(False))
    if not cuts.where(tied).isEmpty():
        full = taken.join(near.where(tied).select(F.col("source").alias("c_source"), "cut"), F.col("source").eqNullSafe(F.col("c_source")))
        full = full.where((F.col("place") == F.col("cut")) & ~F.col("short")).groupBy("source").agg(F.count(F.lit(1)).alias("full"))
        rows = _numbered(rows.where(at_cut & tied), scratch, near.drop("source").columns).join(
            scratch.save(full.select(F.col("source").alias("f_source"), "full"), "full"), F.col("given")[source].eqNullSafe(F.col("f_source"))
        ).drop("f_source").unionByName(rows.where(~(at_cut & tied)).drop("source").withColumns({"number": number, "full": number}))
    else:
        rows = rows.withColumns({"number": number, "full": number})
    once = before | (at_cut & (F.col("number") < F.col("full")))
    partly = at_cut & (F.col("number") == F.col("full")) & (F.col("part_words") > 0)
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), (F.col("epochs") + once.cast("long")).cast("int")),
        F.when(partly, F.array("part_words")).otherwise(F.array().cast("array<bigint>")),
    )
    out = rows.withColumn("words", F.explode(copies))
    new_text = F.when(F.col("words") > 0, leading_words(body, F.col("words"))).otherwise(body)
    columns = []
    for c in names:
        value = F.col("given")[c]
        if c == text:
            value = new_text
        elif c == "n_chars":
            value = F.when(F.col("words") > 0, F.length(new_text).cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)


def _numbered(rows: DataFrame, scratch: Scratch, keep: list[str]) -> DataFrame:
    """Rows with a number from 0 among those of their source and place, by the partition they were read in and within it."""
    rows = scratch.save(rows.select("given", F.struct("source", "own").alias("of"), *keep, F.spark_partition_id().alias("part")), "tied")
    counts = rows.groupBy("of", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("of").alias("o_of"), F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("of", "part").orderBy(F.xxhash64("given"))
    out = rows.withColumn("at", F.row_number().over(inside)).join(offsets, (F.col("part") == F.col("o_part")) & F.col("of").eqNullSafe(F.col("o_of")))
    return out.select("given", F.col("of.own").alias("own"), *keep, (F.col("at") - 1 + F.col("offset")).alias("number"))
