"""Registered queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetloom.functions import scalars
from assetloom.operators import activity, browse, decisions, duplicates, index, similarity, sizes
from assetloom.operators.deck import DeckSpec, card, chronological, deck, lookup
from assetloom.plans.oracles import ORACLES
from assetloom.sources import carriers, readers
from assetloom.storage import Scratch
from assetloom.streaming import refresh

#: The reference's own thresholds find nothing in these vectors; this one does.
THRESHOLD = 1.1
LIBRARY_CHARS = 500
LOOKUP_IDS = (1, 5, 25, 125, 625, 3125, 999_999_999)

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[f.__name__] = f
    return f


def _state(spark, d):
    return decisions.review_state(carriers.decision_log(spark, d))


def _sizes(spark, d):
    return sizes.asset_sizes(carriers.assets(spark, d), carriers.resources(spark, d))


def _sizes_of(spark, d, condition):
    return sizes.asset_sizes(carriers.assets(spark, d).where(condition), carriers.resources(spark, d))


def _cache(spark, d):
    """The sizes of the images are known already."""
    return _sizes_of(spark, d, "media_type = 'image'")


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(carriers.asset_id("doc_id"), "n_chars")


def _labelled(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select(carriers.asset_id("doc_id"), "quality")


@query
def deck_chronological(spark, d):
    return deck(carriers.assets(spark, d), DeckSpec(start_from="1998-01-01"), _state(spark, d)).select("asset_id", "creation_date")


@query
def deck_largest_first(spark, d):
    spec = DeckSpec(media="all", order="largest_first")
    return deck(carriers.assets(spark, d), spec, _state(spark, d), sizes=_sizes(spark, d)).select("asset_id", "creation_date", "bytes")


@query
def deck_videos(spark, d):
    return deck(carriers.assets(spark, d), DeckSpec(media="videos"), _state(spark, d)).select("asset_id", "creation_date", "media_type")


@query
def deck_album(spark, d):
    spec = DeckSpec(album_id=7, keeper_id=40)
    return deck(carriers.assets(spark, d), spec, _state(spark, d), carriers.album_assets(spark, d)).select("asset_id", "creation_date", "is_keeper")


@query
def deck_duplicate_group(spark, d):
    spec = DeckSpec(ids=LOOKUP_IDS, media="photos", start_from="2030-01-01")
    return deck(carriers.assets(spark, d), spec, _state(spark, d)).select("asset_id", "media_type")


@query
def deck_card(spark, d):
    ordered = deck(carriers.assets(spark, d), DeckSpec(), _state(spark, d)).select("asset_id", "creation_date")
    return card(ordered, 10)


@query
def lookup_by_ids(spark, d):
    return chronological(lookup(carriers.assets(spark, d), LOOKUP_IDS)).select("asset_id", "creation_date")


@query
def album_catalogue(spark, d):
    return carriers.albums(spark, d).orderBy(F.col("title").asc_nulls_first(), "album_id")


@query
def asset_sizes(spark, d):
    return _sizes(spark, d)


@query
def total_size_marked(spark, d):
    return sizes.total_size(carriers.resources(spark, d), _state(spark, d).where("marked"))


@query
def size_cache_misses(spark, d):
    return sizes.cache_misses(carriers.assets(spark, d), _cache(spark, d))


@query
def size_cache_merge(spark, d):
    """All assets: new sizes of the misses, and of assets whose known sizes have changed since."""
    new = _sizes_of(spark, d, "media_type <> 'image' OR creation_date >= '1997-01-01'").withColumn("bytes", F.col("bytes") + 1)
    return sizes.merge_cache(_cache(spark, d), new)


@query
def size_cache_store(spark, d):
    """The cache written to its store and read back."""
    scratch = Scratch(spark, "store")
    cache = _sizes(spark, d).select(F.col("asset_id").cast("string").alias("asset_id"), "bytes")
    readers.write_snapshot(cache, f"{scratch.base}/size_cache")
    return readers.read_table(spark, f"{scratch.base}/size_cache", "size_cache")


@query
def stored_text(spark, d):
    """Lists and maps in their stored form, and the list decoded again."""
    events = spark.read.parquet(f"{d}/events.parquet")
    ids = F.array(F.col("event_id").cast("string"), F.col("event_type"))
    made = F.create_map(F.col("event_type"), F.col("event_id"))
    return events.select(
        "event_id", readers.encode(ids).alias("ids"), readers.encode(made).alias("sizes"),
        F.array_join(readers.decode_ids(readers.encode(ids)), "/").alias("decoded"), F.size(readers.decode_ids(F.lit("[1,"))).alias("corrupt"),
        readers.stored_date(F.col("event_id").cast("double")).cast("timestamp_ntz").alias("at"),
    )


def _events_as_assets(spark, d):
    """Errors have no date."""
    date = F.when(F.col("event_type") != "error", F.col("ts")).alias("creation_date")
    return spark.read.parquet(f"{d}/events.parquet").select(carriers.asset_id("event_id"), date)


@query
def day_sections(spark, d):
    return browse.day_sections(_events_as_assets(spark, d))


@query
def day_rows(spark, d):
    return browse.day_rows(_events_as_assets(spark, d)).select("day", "asset_id")


@query
def day_counts(spark, d):
    return browse.day_counts(_events_as_assets(spark, d))


@query
def album_summaries(spark, d):
    return browse.album_summaries(carriers.albums(spark, d), carriers.album_assets(spark, d), carriers.assets(spark, d))


@query
def review_state(spark, d):
    return _state(spark, d)


@query
def review_state_stream(spark, d):
    """The same state by micro-batches of the log."""
    scratch = Scratch(spark, "fold")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    log = source.select(F.col("event_id").alias("seq"), carriers.asset_id("user_id"), carriers._mapped("event_type", carriers.OPS).alias("op"))
    refresh.stream_decisions(log, f"{scratch.base}/state", f"{scratch.base}/progress").awaitTermination()
    return refresh.state_of(refresh.latest(spark, f"{scratch.base}/state"))


@query
def review_state_batches(spark, d):
    """The same state from a log that arrives in four files, one a batch: none is dropped."""
    scratch = Scratch(spark, "batches")
    log = carriers.decision_log(spark, d)
    log.repartitionByRange(4, "seq").write.parquet(f"{scratch.base}/log")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{scratch.base}/log")
    refresh.stream_decisions(source, f"{scratch.base}/state", f"{scratch.base}/progress").awaitTermination()
    return refresh.state_of(refresh.latest(spark, f"{scratch.base}/state"))


@query
def stream_progress(spark, d):
    """Batches and rows that a stream of four files reports as processed."""
    scratch = Scratch(spark, "reported")
    log = carriers.decision_log(spark, d)
    log.repartitionByRange(4, "seq").write.parquet(f"{scratch.base}/log")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch.base}/log")
    stream = refresh.stream_decisions(source, f"{scratch.base}/state", f"{scratch.base}/progress")
    stream.awaitTermination()
    return spark.createDataFrame([refresh.processed(stream)], "batches long, rows long")


@query
def review_state_after_reset(spark, d):
    return decisions.review_state(carriers.decision_log_with_resets(spark, d))


@query
def review_counts(spark, d):
    return decisions.review_counts(_state(spark, d))


@query
def toggle_ops(spark, d):
    return decisions.toggled(_state(spark, d), carriers.assets(spark, d))


@query
def undo_validity(spark, d):
    log = carriers.decision_log(spark, d).withColumnRenamed("asset_id", "deck")
    return decisions.undo_validity(log, "deck")


def _deletion(spark, d):
    return decisions.confirm_delete(carriers.assets(spark, d), carriers.resources(spark, d), _state(spark, d).where("marked"))


@query
def confirm_delete_survivors(spark, d):
    return _deletion(spark, d).survivors.select("asset_id")


@query
def confirm_delete_record(spark, d):
    return _deletion(spark, d).record


@query
def confirm_delete_state(spark, d):
    """The review state once the delete's decisions are in the log: nothing is marked."""
    log = carriers.decision_log(spark, d)
    after = log.agg(F.max("seq")).scalar() + 1
    forgotten = _deletion(spark, d).forgotten.select(after.alias("seq"), "asset_id", "op")
    return decisions.review_state(log.unionByName(forgotten))


def _albums_as_marks(spark, d):
    """Marks of which some are of assets that are gone."""
    return carriers.album_assets(spark, d).select(F.col("album_id").alias("asset_id")).distinct()


@query
def confirm_delete_some_gone(spark, d):
    return decisions.confirm_delete(carriers.assets(spark, d), carriers.resources(spark, d), _albums_as_marks(spark, d)).record


@query
def confirm_delete_all_gone(spark, d):
    """No mark resolves: the delete fails, and all assets stay without a row in the log or a decision."""
    done = decisions.confirm_delete(carriers.assets(spark, d).join(_albums_as_marks(spark, d), "asset_id", "left_anti"), carriers.resources(spark, d), _albums_as_marks(spark, d))
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count(done.survivors, "assets").unionByName(count(done.record, "records")).unionByName(count(done.forgotten, "decisions"))


@query
def similar_pairs(spark, d):
    return similarity.similar_pairs(carriers.feature_index(spark, d), THRESHOLD)


@query
def near_duplicate_groups(spark, d):
    return duplicates.duplicate_groups(carriers.feature_index(spark, d), THRESHOLD)


@query
def burst_edges(spark, d):
    return duplicates.burst_edges(carriers.feature_index(spark, d), carriers.bursts(spark, d))


@query
def duplicate_groups_all(spark, d):
    return duplicates.duplicate_groups(carriers.feature_index(spark, d), THRESHOLD, carriers.bursts(spark, d))


def _members(spark, d):
    index = carriers.feature_index(spark, d)
    return duplicates.members(index, duplicates.all_edges(index, THRESHOLD, carriers.bursts(spark, d)))


@query
def group_previews(spark, d):
    return duplicates.group_previews(_members(spark, d))


@query
def group_members(spark, d):
    return duplicates.group_members(_members(spark, d))


@query
def group_sizes(spark, d):
    return duplicates.group_sizes(_members(spark, d))


@query
def sensitivity_distance(spark, d):
    """The distance of every step of the slider, and beyond its ends."""
    return spark.range(12).select(F.col("id").alias("sensitivity"), scalars.sensitivity_distance(F.col("id")).alias("distance"))


@query
def squared_distance(spark, d):
    """Between each vector and the next one."""
    index = carriers.feature_index(spark, d).select(F.col("age"), "embedding")
    following = index.select((F.col("age") - 1).alias("age"), F.col("embedding").alias("following"))
    return index.join(following, "age").select("age", scalars.squared_distance(F.col("embedding"), F.col("following")).alias("distance"))


@query
def vector_decode(spark, d):
    """Vectors as they are read; those of label 0 are missing, and so empty."""
    index = carriers.feature_index(spark, d).withColumn("print", F.when(F.col("quality") != 0, F.col("embedding")))
    decoded = readers.vectors("print")
    return index.select("age", F.size(decoded).alias("n"), F.get(decoded, F.lit(0)).alias("first"))


@query
def index_pending(spark, d):
    return index.pending(_documents(spark, d), _labelled(spark, d)).select("asset_id")


@query
def index_indexed(spark, d):
    return index.indexed(_documents(spark, d), _labelled(spark, d)).select("asset_id")


@query
def index_purge(spark, d):
    return index.purge(_labelled(spark, d), _documents(spark, d).where(F.col("n_chars") >= LIBRARY_CHARS))


@query
def index_refresh(spark, d):
    library = _documents(spark, d)
    new = index.pending(library, _labelled(spark, d)).select("asset_id", F.lit(-1).alias("quality"))
    return index.refresh(_labelled(spark, d), new, library.where(F.col("n_chars") >= LIBRARY_CHARS))


@query
def index_upsert(spark, d):
    """A row of every document put into the index: those that are there are replaced."""
    new = _documents(spark, d).select("asset_id", (-F.col("n_chars")).cast("int").alias("quality"))
    return index.upsert(_labelled(spark, d).withColumn("quality", F.col("quality").cast("int")), new)


@query
def index_stream(spark, d):
    """The index as a stream of rows makes it, purged by the library."""
    scratch = Scratch(spark, "index")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/labels.parquet").schema).parquet(f"{d}/labels.parque[t]")
    rows = source.select(carriers.asset_id("doc_id"), "quality")
    library = lambda: _documents(spark, d).where(F.col("n_chars") >= LIBRARY_CHARS)
    refresh.stream_index(rows, library, f"{scratch.base}/index", f"{scratch.base}/progress").awaitTermination()
    return refresh.latest(spark, f"{scratch.base}/index")


@query
def index_point(spark, d):
    return index.point(_labelled(spark, d), 42).select("asset_id", "quality")


@query
def index_exists(spark, d):
    return index.exists(_labelled(spark, d))


@query
def index_exists_empty(spark, d):
    """Of an index that a library without assets has emptied."""
    return index.exists(index.purge(_labelled(spark, d), _documents(spark, d).where(F.col("n_chars") < 0)))


@query
def index_row_count(spark, d):
    return index.row_count(_labelled(spark, d))


@query
def activity_totals(spark, d):
    return activity.totals(carriers.delete_log(spark, d))


@query
def activity_log(spark, d):
    return activity.with_running_total(carriers.delete_log(spark, d))


@query
def stored_sizes(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 7 == 0, F.lit('{"x":')).otherwise(F.format_string('{"%d":%d}', "user_id", "event_id"))
    sizes_of = readers.decode_sizes(text)
    return events.select("event_id", F.size(sizes_of).alias("entries"), F.element_at(sizes_of, F.col("user_id").cast("string")).alias("bytes"))


@query
def duration_badge(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "video").otherwise("image")
    return events.select("event_id", scalars.duration_badge(kind, F.col("value")).alias("badge"))


@query
def date_label(spark, d):
    assets = carriers.assets(spark, d)
    date = F.when(F.col("asset_id") % 10 != 0, F.col("creation_date"))
    return assets.select("asset_id", scalars.date_label(date).alias("label"))


@query
def aspect(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select("p_partkey", scalars.aspect(F.col("p_size"), F.col("p_partkey") % 50).alias("aspect"))


@query
def pixel_area(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select("p_partkey", scalars.pixel_area(F.col("p_size") * 100_000, F.col("p_size") * 99_999).alias("area"))


@query
def byte_label(spark, d):
    assets = carriers.assets(spark, d)
    # the cube of an id above 2,097,151 is beyond 64 bits; decimals hold those of ids up to 4.6e12
    factor = F.col("asset_id").cast("decimal(19,0)")
    return assets.select("asset_id", scalars.byte_label((factor * factor).cast(scalars.WHOLE) * F.col("asset_id")).alias("label"))


@query
def count_label(spark, d):
    assets = carriers.assets(spark, d)
    return assets.select("asset_id", scalars.count_label(F.col("asset_id") % 4).alias("label"))


@query
def access_state(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    status = F.when(F.col("event_type") == "click", "authorized").when(F.col("event_type") == "view", "notDetermined").otherwise("limited")
    return events.select("event_id", scalars.access_state(status).alias("state"))


@query
def swipe_class(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", scalars.swipe_class(F.col("event_id") % 301 - 150).alias("action"))


@query
def review_progress(spark, d):
    counts = decisions.review_counts(_state(spark, d))
    return counts.select(scalars.progress(F.col("marked"), F.col("reviewed")).alias("progress"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
