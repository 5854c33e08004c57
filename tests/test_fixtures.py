"""Micro-fixtures of the operators' boundaries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assetloom.functions import scalars
from assetloom.operators import activity, browse, decisions, duplicates, index, sizes
from assetloom.operators.components import connected_components
from assetloom.operators.deck import DeckSpec, card, chronological, deck, lookup, scan
from assetloom.operators.similarity import similar_pairs
from assetloom.sources import readers
from assetloom.streaming import refresh

DAY = dt.datetime(2024, 1, 1)
ASSET = "asset_id long, creation_date timestamp_ntz, media_type string"


def vectors(spark, rows):
    full = [(i, v, q, a) for i, v, q, a in rows]
    return spark.createDataFrame(full, "asset_id long, embedding array<float>, quality long, age long")


def bursts(spark, rows):
    return spark.createDataFrame(rows, "asset_id long, burst_id string")


def groups(frame):
    return [(r["keeper_id"], list(r["asset_ids"])) for r in frame.collect()]


def test_chain_is_one_group(spark):
    v = vectors(spark, [(1, [0.0], 1, 1), (2, [0.2], 1, 2), (3, [0.4], 1, 3)])
    assert groups(duplicates.duplicate_groups(v, 0.3)) == [(1, [1, 2, 3])]


def test_distance_at_threshold_is_no_pair(spark):
    v = vectors(spark, [(1, [0.0], 1, 1), (2, [0.5], 1, 2)])
    assert similar_pairs(v, 0.5).count() == 0


def test_empty_vectors_group_by_burst_only(spark):
    v = vectors(spark, [(1, [], 1, 1), (2, [], 1, 2), (3, None, 1, 3)])
    b = bursts(spark, [(1, "x"), (2, "x"), (3, None), (4, "x")])
    assert groups(duplicates.duplicate_groups(v, 0.3, b)) == [(1, [1, 2])]


def test_lengths_must_agree(spark):
    v = vectors(spark, [(1, [0.0, 0.0], 1, 1), (2, [0.0, 0.0, 0.0], 1, 2)])
    assert similar_pairs(v, 0.3).count() == 0


def test_unindexed_burst_members_vanish(spark):
    v = vectors(spark, [(1, [0.0], 1, 1)])
    assert duplicates.burst_edges(v, bursts(spark, [(1, "x"), (2, "x")])).count() == 0


def test_empty_burst_is_a_burst(spark):
    v = vectors(spark, [(1, [0.0], 1, 1), (2, [9.0], 1, 2)])
    assert duplicates.burst_edges(v, bursts(spark, [(1, ""), (2, "")])).count() == 1


def test_keeper_and_order(spark):
    v = vectors(spark, [(1, [0.0], 5, 9), (2, [0.0], 9, 7), (3, [0.0], 9, 8), (4, [0.0], 1, None)])
    assert groups(duplicates.duplicate_groups(v, 0.3)) == [(2, [4, 2, 3, 1])]


def test_groups_by_size_then_keeper(spark):
    v = vectors(spark, [(1, [0.0], 1, 1), (2, [0.0], 1, 2), (3, [5.0], 1, 3), (4, [5.0], 1, 4)])
    assert [k for k, _ in groups(duplicates.duplicate_groups(v, 0.3))] == [3, 1]


def test_preview_has_keeper_first(spark):
    rows = spark.createDataFrame([(1, 10, 6, i, 1, i) for i in range(1, 11)], "component long, c long, keeper_id long, asset_id long, quality long, age long")
    assert duplicates.group_previews(rows).first()["preview"] == [6, 1, 2, 3, 4, 5, 7, 8]
    assert duplicates.group_members(rows).where("is_keeper").collect() == [(6, 6, True)] and duplicates.group_sizes(rows).collect() == [(6, 6, 10)]


@pytest.mark.parametrize("threshold", [0.2, 0.6, 3.0])
def test_similarity_join_is_exact(spark, threshold):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(3)], 1, i) for i in range(150)]
    got = {tuple(r) for r in similar_pairs(vectors(spark, rows), threshold).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and sum((x - y) ** 2 for x, y in zip(a[1], b[1])) < threshold**2}
    assert got == want


def test_thresholds_nest(spark):
    rng = random.Random(6)
    v = vectors(spark, [(i, [rng.random(), rng.random()], 1, i) for i in range(60)])
    small, large = ([set(m) for _, m in groups(duplicates.duplicate_groups(v, t))] for t in (0.05, 0.1))
    assert all(any(s <= x for x in large) for s in small)


@pytest.mark.parametrize("parts", [1, 3])
def test_components(spark, parts):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(parts)
    assert {r["node"]: r["component"] for r in connected_components(frame).collect()} == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cutoff_is_inclusive_and_lists_ignore_it(spark):
    a = spark.createDataFrame([(1, DAY, "image"), (2, None, "image"), (3, DAY, "video"), (4, DAY - dt.timedelta(days=1), "image")], ASSET)
    assert [r["asset_id"] for r in scan(a, DeckSpec(start_from="2024-01-01")).collect()] == [1]
    assert {r["asset_id"] for r in scan(a, DeckSpec(ids=(3, 4, 9), start_from="2030-01-01")).collect()} == {3, 4}
    assert lookup(a, ()).count() == 0
    assert [r["asset_id"] for r in chronological(a).collect()] == [2, 4, 1, 3]
    with pytest.raises(ValueError):
        DeckSpec(media="paintings")


def test_largest_first_keeps_unsized(spark):
    a = spark.createDataFrame([(1, DAY, "image"), (2, DAY, "image"), (3, DAY, "image")], ASSET)
    s = spark.createDataFrame([(1, 5), (3, 9)], "asset_id long, bytes long")
    state = spark.createDataFrame([(3, True, False)], "asset_id long, reviewed boolean, marked boolean")
    rows = deck(a, DeckSpec(order="largest_first"), state, sizes=s)
    assert [(r["asset_id"], r["bytes"]) for r in rows.collect()] == [(1, 5), (2, 0)]
    assert card(rows, 1).first()["asset_id"] == 2 and card(rows, 2).count() == 0


def test_day_sections_drop_undated(spark):
    a = spark.createDataFrame([(1, DAY, "image"), (2, None, "image"), (3, DAY, "image"), (4, DAY + dt.timedelta(days=1), "image")], ASSET)
    assert [(r["day"], r["asset_ids"]) for r in browse.day_sections(a).collect()] == [(DAY + dt.timedelta(days=1), [4]), (DAY, [1, 3])]


def test_albums_need_images(spark):
    albums = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "album_id long, title string")
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (3, 3)], "album_id long, asset_id long")
    a = spark.createDataFrame([(1, DAY, "image"), (2, DAY, "video"), (3, None, "image")], ASSET)
    rows = [tuple(r) for r in browse.album_summaries(albums, members, a).collect()]
    assert rows == [(1, "Untitled", 1, 1), (3, "c", 2, 1)]


def replay(ops):
    reviewed, marked = set(), set()
    for _, asset, op in ops:
        if op == "reset":
            reviewed, marked = set(), set()
        elif op == "keep":
            reviewed.add(asset)
        elif op == "mark":
            reviewed.add(asset)
            marked.add(asset)
        elif op == "spare":
            marked.discard(asset)
        else:
            reviewed.discard(asset)
            marked.discard(asset)
    return reviewed, marked


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_replay(spark, seed, tmp_path):
    rng = random.Random(seed)
    ops = [(i, rng.randrange(12), rng.choice(["keep", "mark", "spare", "clear", "forget"])) for i in range(200)]
    ops[60] = (60, None, "reset")
    log = spark.createDataFrame(ops, "seq long, asset_id long, op string")
    rows = decisions.review_state(log).collect()
    got = {r["asset_id"] for r in rows if r["reviewed"]}, {r["asset_id"] for r in rows if r["marked"]}
    assert got == replay(ops) and got[1] <= got[0]
    source, state = str(tmp_path / "log"), str(tmp_path / "state")
    for lo in range(0, 200, 50):
        log.where((F.col("seq") >= lo) & (F.col("seq") < lo + 50)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        refresh.stream_decisions(stream, state, str(tmp_path / "progress")).awaitTermination()
    rows = refresh.state_of(refresh.latest(spark, state)).collect()
    assert ({r["asset_id"] for r in rows if r["reviewed"]}, {r["asset_id"] for r in rows if r["marked"]}) == got


def test_undo_is_one_step(spark):
    ops = [(1, "d", "mark"), (2, "d", "clear"), (3, "d", "clear"), (4, "d", "keep"), (5, "d", "spare"), (6, "d", "clear"), (7, "d", "forget"), (8, "d", "clear")]
    rows = decisions.undo_validity(spark.createDataFrame(ops, "seq long, deck string, op string"), "deck").orderBy("seq").collect()
    assert [(r["seq"], r["valid"]) for r in rows] == [(2, True), (3, False), (6, True), (8, False)]


def test_confirm_delete(spark):
    a = spark.createDataFrame([(1, DAY, "image"), (2, DAY, "image"), (3, DAY, "image")], ASSET)
    res = spark.createDataFrame([(1, 10), (1, 5), (2, 7), (9, 100)], "asset_id long, file_size long")
    marks = spark.createDataFrame([(1,), (2,), (9,)], "asset_id long")
    stay, record, forgotten = decisions.confirm_delete(a, res, marks)
    assert sorted(tuple(r) for r in forgotten.collect()) == [(i, "forget") for i in (1, 2, 9)]
    assert [r["asset_id"] for r in stay.collect()] == [3] and [tuple(r) for r in record.collect()] == [(3, 22)]
    assert decisions.confirm_delete(a, res, marks.where("asset_id = 9"))[1].count() == 0


def test_sizes(spark):
    a = spark.createDataFrame([(1,), (2,)], "asset_id long")
    res = spark.createDataFrame([(1, 10), (1, None)], "asset_id long, file_size long")
    assert {tuple(r) for r in sizes.asset_sizes(a, res).collect()} == {(1, 10), (2, 0)}
    assert sizes.total_size(res, a.where("asset_id = 7")).first()["bytes"] == 0
    cache, new = (spark.createDataFrame(x, "asset_id long, bytes long") for x in ([(1, 5), (3, 3)], [(1, 9), (2, 4)]))
    assert {tuple(r) for r in sizes.merge_cache(cache, new).collect()} == {(1, 9), (2, 4), (3, 3)}
    assert [tuple(r) for r in sizes.cache_misses(a, cache).collect()] == [(2,)]


def test_index_refresh_is_idempotent_and_streams(spark, tmp_path):
    old, new, library = (spark.createDataFrame(x, "asset_id long, quality int") for x in ([(1, 1), (2, 1)], [(2, 5), (3, 5)], [(2, 0), (3, 0), (4, 0)]))
    once = index.refresh(old, new, library)
    assert {tuple(r) for r in once.collect()} == {(2, 5), (3, 5)} == {tuple(r) for r in index.refresh(once, new, library).collect()}
    assert [r["asset_id"] for r in index.pending(library, once).collect()] == [4] and index.has_index(once)
    source, path = str(tmp_path / "rows"), str(tmp_path / "index")
    new.coalesce(1).write.parquet(source)
    seen = []
    listener = refresh.Progress(lambda rows, batch: seen.append(rows))
    spark.streams.addListener(listener)
    refresh.stream_index(spark.readStream.schema(new.schema).parquet(source), lambda: library, path, str(tmp_path / "progress")).awaitTermination()
    assert {tuple(r) for r in refresh.latest(spark, path).collect()} == {(2, 5), (3, 5)}
    spark.streams.removeListener(listener)


def test_activity(spark):
    log = spark.createDataFrame([(1, 12, 84_000_000), (2, 3, 5_600_000)], "seq long, count long, bytes_freed long")
    assert tuple(activity.totals(log).first()) == (15, 89_600_000)
    assert [(r["seq"], r["total_bytes"]) for r in activity.with_running_total(log, 1).collect()] == [(2, 89_600_000), (1, 84_000_000)]
    assert tuple(activity.totals(log.limit(0)).first()) == (0, 0)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.duration_badge(F.lit("video"), F.lit(125.5)).alias("a"), scalars.duration_badge(F.lit("image"), F.lit(10.0)).alias("b"),
        scalars.date_label(F.lit(None).cast("timestamp_ntz")).alias("c"), scalars.aspect(F.lit(0), F.lit(5)).alias("d"),
        scalars.swipe_class(F.lit(120)).alias("e"), scalars.swipe_class(F.lit(121)).alias("f"), scalars.swipe_class(F.lit(-121)).alias("g"),
        scalars.pixel_area(F.lit(100_000), F.lit(100_000)).alias("h"), scalars.progress(F.lit(1), F.lit(0)).alias("i"),
        scalars.byte_label(F.lit(999)).alias("j"), scalars.byte_label(F.lit(89_600_000)).alias("k"), scalars.byte_label(F.lit(1_234_567_890)).alias("l"),
        readers.decode_sizes(F.lit('{"a":')).alias("m"), readers.decode_ids(F.lit('["x","y"]')).alias("n"),
        readers.stored_date(F.lit(0)).cast("string").alias("o"), F.round(scalars.squared_distance(F.array(F.lit(1.0).cast("float")), F.array(F.lit(3.0).cast("float"))), 3).alias("p"),
    ).first()
    assert list(row) == ["2:06", "", "Unknown date", 1.0, "none", "keep", "delete", 10_000_000_000, 0.0, "999 bytes", "89.6 MB", "1.23 GB", {}, ["x", "y"], "2001-01-01 00:00:00", 4.0]
    assert scalars.sensitivity_threshold(6) == pytest.approx(0.30)
    with pytest.raises(ValueError):
        scalars.sensitivity_threshold(11)


def test_byte_label_is_exact(spark):
    """Just below a multiple of the unit a double would round up."""
    sizes = [9_007_199_999_999_999 // 10_000_000 * 10_000_000 + 4_999_999, 9_000_000_000_004_999_999, None]
    rows = spark.createDataFrame([(x,) for x in sizes], "size long").select(scalars.byte_label(F.col("size")).alias("label")).collect()
    assert [r["label"] for r in rows] == ["9007199.99 GB", "9000000000.00 GB", None]


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5)], "asset_id string, bytes long")
    path = str(tmp_path / "sizes")
    readers.write_snapshot(rows, path)
    assert [tuple(r) for r in readers.read_table(spark, path, "size_cache").collect()] == [("a", 5)]
    with pytest.raises(Exception):
        readers.write_snapshot(rows, path)


@pytest.mark.parametrize("tile", [8192, 7])
def test_similarity_join_by_cells_and_tiles(spark, monkeypatch, tile):
    from assetloom.operators import similarity

    monkeypatch.setattr(similarity, "TILE", tile)
    rng = random.Random(9)
    rows = [(f"id{i:03d}", [rng.random() for _ in range(2 + i % 3)], 1, i) for i in range(180)] + [("n1", [float("nan"), 0.0], 1, 1), ("n2", [None, 0.0], 1, 1), ("n3", [float("inf"), 0.0], 1, 1)]
    frame = spark.createDataFrame(rows, "asset_id string, embedding array<float>, quality long, age long")
    for threshold in (0.15, 0.7):
        got = [tuple(r) for r in similar_pairs(frame, threshold).collect()]
        want = {
            (a[0], b[0]) for a in rows[:180] for b in rows[:180]
            if a[0] < b[0] and len(a[1]) == len(b[1]) and sum((x - y) ** 2 for x, y in zip(a[1], b[1])) < threshold**2
        }
        assert set(got) == want and len(got) == len(want)
    assert similar_pairs(frame, 0.0).count() == 0


@pytest.mark.parametrize("rows", [3, 100_000])
def test_ranges_of_an_order(spark, rows):
    from assetloom.operators import ordered
    from assetloom.storage import Scratch

    rng = random.Random(rows)
    given = [(rng.choice("abc"), rng.randrange(10**12) * 7, rng.choice(["keep", "mark", "spare", "clear"])) for _ in range(60)]
    log = spark.createDataFrame(given, "deck string, seq long, op string")
    out = ordered.with_previous(log, Scratch(spark, "t"), ["deck", "seq"], ["deck", "op"], "before", rows).collect()
    ordered_rows = sorted(given)
    want = {x[1]: (y[0], y[2]) for y, x in zip(ordered_rows, ordered_rows[1:])}
    assert {r["seq"]: tuple(r["before"]) if r["before"] else None for r in out} == {x[1]: want.get(x[1]) for x in given}
    valid = {r["seq"]: r["valid"] for r in decisions.undo_validity(log, "deck", range_rows=rows).collect()}
    relevant = [x for x in ordered_rows if x[2] != "spare"]
    assert valid == {x[1]: i > 0 and relevant[i - 1][0] == x[0] and relevant[i - 1][2] in ("keep", "mark") for i, x in enumerate(relevant) if x[2] == "clear"}
    sums = activity.with_running_total(spark.createDataFrame([(s, s % 100) for _, s, _ in given], "seq long, bytes_freed long"), rows)
    got = [r["total_bytes"] for r in sums.collect()]
    total, want = 0, []
    for s in sorted(x[1] for x in given):
        total += s % 100
        want.append(total)
    assert got == want[::-1]


def test_failed_delete_changes_nothing(spark):
    a = spark.createDataFrame([(1, DAY, "image")], ASSET)
    done = decisions.confirm_delete(a, spark.createDataFrame([(1, 5)], "asset_id long, file_size long"), spark.createDataFrame([(9,)], "asset_id long"))
    assert done.survivors.count() == 1 and done.record.count() == 0 == done.forgotten.count()


def test_old_snapshots_go(spark, tmp_path):
    source, state = str(tmp_path / "log"), str(tmp_path / "state")
    for k in range(5):
        spark.createDataFrame([(k, k, "keep")], "seq long, asset_id long, op string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq long, asset_id long, op string").parquet(source)
        refresh.stream_decisions(stream, state, str(tmp_path / "progress")).awaitTermination()
    assert refresh.stored(spark, state) == [3, 4] and refresh.state_of(refresh.latest(spark, state)).where("reviewed").count() == 5
