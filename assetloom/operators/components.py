"""Connected components of an undirected graph, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assetloom.storage import Scratch


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60
) -> DataFrame:
    """Return ``(node, component)`` for every endpoint of ``edges``.

    ``component`` is the smallest node reachable. Each round points every
    vertex at its smallest neighbour (or itself), follows that pointer once
    more, and contracts the graph along it. A vertex that is no local minimum
    merges away, so rounds grow with the logarithm of the vertices at most.
    Minima are partial aggregates, so a hub's edges never meet in one task.
    Self-loops keep their node as a component of its own; null endpoints are
    ignored; an empty input gives an empty result. The result is a stored
    table, the only one that stays.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pair = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    live = scratch.save(pair.distinct(), "edges")
    assign = None
    work = live.where("a <> b")
    for _ in range(max_rounds):
        both = work.select("a", "b").unionAll(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("p")
        )
        up = scratch.save(up, "up")
        over = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = scratch.save(
            up.join(over, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "jump"
        )
        to_a = jump.select(F.col("v").alias("a"), F.col("p").alias("na"))
        to_b = jump.select(F.col("v").alias("b"), F.col("p").alias("nb"))
        nxt = scratch.save(
            work.join(to_a, "a").join(to_b, "b").where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(),
            "edges",
        )
        if assign is None:
            new = scratch.save(jump.select(F.col("v").alias("node"), F.col("p").alias("component")), "assign")
        else:
            step = jump.select(F.col("v").alias("component"), F.col("p").alias("to"))
            new = scratch.save(
                assign.join(step, "component", "left")
                .select("node", F.coalesce("to", "component").alias("component")),
                "assign",
            )
        assign, work = new, nxt
        scratch.clear(live, assign, work)
        if work.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    loops = live.where("a = b").select(F.col("a").alias("node"))
    if not loops.isEmpty():
        alone = loops.distinct().join(assign, "node", "left_anti").withColumn("component", F.col("node"))
        assign = scratch.save(assign.select("node", "component").unionByName(alone), "components")
    scratch.clear(assign)
    return assign
