"""Near-duplicate documents by HyperMinHash sketches, exact verification and components.

A document is the set of its distinct word shingles (A-Z in lower case). One
64-bit hash places each shingle in one of 256 buckets; a bucket keeps its
smallest value as a 16-bit register of leading-zero count and mantissa.
Empty buckets borrow from the first filled one in a fixed random order. Bands
of registers give candidates, the collision-corrected share of equal registers
discards those far below the threshold, and the rest are verified on the full
sets. At similarity 0.8 a pair shares no band with probability 3e-6.

Groups of any size are handled without all their pairs:

1. Documents with equal sets form one class; only classes are sketched on.
2. In each band bucket, all classes are compared with one centre, the class
   that shares most buckets (for copies of one text that is the original).
   Joins by bucket deal the rows of large buckets to several parts.
3. Buckets whose classes are by then in one component are finished. In the
   others every pair across components is compared: small buckets by a join,
   large ones in tiles of full sets, in which the rows outside the largest
   component meet all rows and only links come out.

Rows: null or wordless texts have an empty set and link with nothing; a text
shorter than a shingle is one shingle; repeated rows come out once each, with
equal results; null ids are kept and never the smallest unless alone; an empty
table gives an empty result; extra columns are ignored or, in ``deduplicate``,
kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from assetloom.llm.arrow import map_chunks, utf8
from assetloom.operators.components import connected_components
from assetloom.operators.joins import split_join
from assetloom.storage import Scratch

SHINGLE = 5
THRESHOLD = 80
BUCKETS = 256
BAND_ROWS = 6
BANDS = BUCKETS // BAND_ROWS
MANTISSA = 10
#: Margin of the estimate below the threshold: seven standard deviations of 256 registers.
SLACK = 0.18
#: Sets below this size have too few independent registers for the estimate to discard.
SURE_SIZE = 192
SMALL_BUCKET = 32
#: Shingles of a tile's rows, and of the rows outside the largest component that meet them.
TILE_ROWS, TILE_OUTSIDE = 250_000, 250_000
#: Ids, or keys of hot groups, up to this number may be broadcast (16 bytes each); more go through a shuffle.
BROADCAST_IDS = 500_000
#: Rows of a key beyond which a join deals them to several parts.
HOT = 512
WORD_CACHE = 100_000

_rng = np.random.default_rng(20)
_RANK = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.int16)
_BAND_MULTIPLIERS = _rng.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered while the words are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    take = min(size, len(words))
    count = len(words) - take + 1
    mixed = np.full(count, np.uint64(take))
    with np.errstate(over="ignore"):
        for i in range(take):
            mixed = _scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + values[i : i + count])
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


_STARTS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
_LOW = np.uint64((1 << 56) - 1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 256 registers of a non-empty set: leading zeros, then mantissa bits."""
    at = np.searchsorted(shingles, _STARTS)
    ends = np.append(at[1:], len(shingles))
    filled = at < ends
    where = np.flatnonzero(filled)
    low = shingles[at[where]] & _LOW
    exponent = np.frexp(low.astype(np.float64))[1]  # low < 2**exponent
    zeros = 56 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(BUCKETS, np.uint16)
    out[where] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        out[empty] = out[where[np.argmin(_RANK[empty][:, where], axis=1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per sketch and band."""
    parts = sketches[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
    with np.errstate(over="ignore"):
        keys = _scramble((parts * _BAND_MULTIPLIERS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity from equal registers, less the equalities expected by chance."""
    equal = (a == b).sum(axis=1)
    levels = np.arange(0, 50)

    def level_share(size):
        n = np.maximum(size / BUCKETS, 1.0)[:, None]
        return (1 - 2.0 ** -(levels + 1)) ** n - (1 - 2.0**-levels) ** n

    chance = BUCKETS * 2.0**-MANTISSA * (level_share(size_a) * level_share(size_b)).sum(axis=1)
    return (equal - chance) / (BUCKETS - chance)


def possible(a, b, size_a, size_b, threshold: int) -> np.ndarray:
    """Pairs that the sizes and the estimate do not rule out."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    sizes = 100 * small >= threshold * large
    return sizes & ((small < SURE_SIZE) | (estimate(a, b, size_a, size_b) >= threshold / 100 - SLACK))


def _sketches(column) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint16).reshape(-1, BUCKETS)


def _sketch_step(shingle: int):
    def make():
        hashes = WordHashes()

        def step(batch):
            sizes, keys, sketches = [], [], []
            for text in utf8(batch.column("text")):
                own = shingle_set(text, hashes, shingle)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sketches.append(registers(own).tobytes() if len(own) else None)
            return {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "set_key": keys, "sketch": sketches}

        return step

    return make


def _set_step(shingle: int):
    def make():
        hashes = WordHashes()

        def step(batch):
            sets = [shingle_set(t, hashes, shingle) for t in utf8(batch.column("text"))]
            return {
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "shingles": [s.view(np.int64) for s in sets],
            }

        return step

    return make


def _band_step():
    def step(batch):
        keys = band_keys(_sketches(batch.column("sketch")))
        ids = np.asarray(batch.column("nid"))
        return {"key": keys.ravel(), "nid": np.repeat(ids, BANDS)}

    return step


def _possible_step(threshold: int):
    def make():
        def step(batch):
            sizes = [np.asarray(batch.column(c)) for c in ("na", "nb")]
            good = possible(_sketches(batch.column("sa")), _sketches(batch.column("sb")), *sizes, threshold)
            return {c: np.asarray(batch.column(c))[good] for c in ("a", "b")}

        return step

    return make


def _tile_links(threshold: int):
    """Links across components between one tile's outsiders and its rows, on full sets.

    An inverted index over the rows' shingles counts all intersections of an
    outsider at once. It is linked once with each component it reaches.
    """

    def run(table: pa.Table) -> pa.Table:
        sets = table["shingles"].combine_chunks()
        flat, starts = np.asarray(sets.flatten()), np.concatenate(([0], np.cumsum(np.diff(np.asarray(sets.offsets)))))
        ids, comps, outside = np.asarray(table["nid"]), np.asarray(table["comp"]), np.asarray(table["other"])
        sizes = np.diff(starts)
        rows = np.flatnonzero(~outside)
        links_a, links_b = [], []
        if len(rows) and outside.any():
            shingles = np.concatenate([flat[starts[r] : starts[r + 1]] for r in rows])
            owners = np.repeat(np.arange(len(rows)), sizes[rows])
            order = np.argsort(shingles, kind="stable")
            shingles, owners = shingles[order], owners[order]
            for i in np.flatnonzero(outside):
                own = flat[starts[i] : starts[i + 1]]
                lo, hi = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
                hit = [owners[p:q] for p, q in zip(lo.tolist(), hi.tolist()) if q > p]
                if not hit:
                    continue
                common = np.bincount(np.concatenate(hit), minlength=len(rows))
                good = rows[100 * common >= threshold * (sizes[rows] + sizes[i] - common)]
                good = good[comps[good] != comps[i]]
                good = good[np.unique(comps[good], return_index=True)[1]]
                links_a.append(np.minimum(ids[good], ids[i]))
                links_b.append(np.maximum(ids[good], ids[i]))
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pa.table({"a": join(links_a), "b": join(links_b)})

    return run


def _salts() -> list[Column]:
    """With a bucket's other aggregates: the highest part that its rows are in."""
    return [F.max("salt").alias("salt")]


def _each_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("salt"))).alias("salt")


class _Join:
    """The similarity join over sketched classes; see the module's text."""

    def __init__(self, docs: DataFrame, shingle: int, threshold: int):
        self.docs, self.shingle, self.threshold = docs, shingle, threshold
        self.sets: DataFrame | None = None
        self.scratch = Scratch(docs.sparkSession, "near")
        self.sketched = self.scratch.save(
            map_chunks(docs, _sketch_step(shingle), "doc_id long, n_shingles long, set_key binary, sketch binary"), "sketched"
        )
        classes = (
            self.sketched.where("set_key is not null").groupBy("set_key")
            .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        )
        self.classes = self.scratch.save(classes.select(F.monotonically_increasing_id().alias("nid"), "*"), "classes")

    def buckets(self) -> DataFrame:
        """``key, salt, nid, c`` of the band buckets that hold two classes or more; ``salt`` splits the large ones."""
        rows = map_chunks(self.classes.select("nid", "sketch"), _band_step, "key long, nid long")
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        counts = self.scratch.save(counts, "counts")
        live = self.scratch.save(split_join(rows, counts, "key", "nid", HOT, BROADCAST_IDS), "buckets")
        self.scratch.drop(counts)
        return live

    def star_pairs(self, live: DataFrame) -> DataFrame:
        """Each class with the most widely shared class of each of its buckets."""
        shared = live.groupBy("nid").agg(F.sum("c").alias("pop"))
        centre = F.max(F.struct("pop", (-F.col("nid")).alias("neg"))).alias("top")
        centres = live.join(shared, "nid").groupBy("key").agg(centre, *_salts()).select("key", _each_salt(), (-F.col("top.neg")).alias("centre"))
        return live.join(centres, ["key", "salt"]).where("nid <> centre").select(
            F.least("nid", "centre").alias("a"), F.greatest("nid", "centre").alias("b")
        )

    def open_rows(self, live: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows of the buckets that still touch several components."""
        named = live.join(comps, live["nid"] == comps["node"], "left").select(
            "key", "salt", "nid", "c", F.coalesce("component", "nid").alias("comp")
        )
        named = self.scratch.save(named, "named")
        several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *_salts()).where("lo <> hi")
        rows = self.scratch.save(named.join(several.select("key", _each_salt()), ["key", "salt"]), "open")
        self.scratch.drop(named)
        return rows

    def small_pairs(self, rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("c") <= SMALL_BUCKET).select("key", "nid", "comp")
        other = rows.select("key", F.col("nid").alias("nid2"), F.col("comp").alias("comp2"))
        return rows.join(other, "key").where("comp < comp2").select(
            F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")
        )

    def large_links(self, rows: DataFrame) -> DataFrame:
        """Links across components inside the large buckets.

        Buckets with the same largest component are treated as one group, in
        which every row outside that component meets every row. Tiles hold a
        bounded number of shingles.
        """
        rows = rows.where(F.col("c") > SMALL_BUCKET)
        per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), *_salts())
        main = per.groupBy("key").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), *_salts()).select("key", _each_salt(), "main")
        members = rows.join(main, ["key", "salt"]).select("main", "nid", "comp").distinct()
        members = self.scratch.save(members.join(self.classes.select("nid", "n"), "nid"), "members")
        tiles = members.groupBy("main").agg(
            F.ceil(F.sum(F.when(F.col("comp") != F.col("main"), F.col("n")).otherwise(0)) / TILE_OUTSIDE).cast("int").alias("ot"),
            F.ceil(F.sum("n") / TILE_ROWS).cast("int").alias("rt"), F.count(F.lit(1)).alias("c"),
        )
        tiles = self.scratch.save(tiles, "tiles")
        sized = split_join(members, tiles, "main", "nid", HOT, BROADCAST_IDS).drop("salt", "c")
        wide = sized.join(self.sets_of(members.select("nid").distinct(), "large"), "nid")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "nid"), F.col(n)).cast("int")
        row = wide.select("main", "nid", "comp", "shingles", F.lit(False).alias("other"), spread("ot").alias("o"), part(1, "rt").alias("r"))
        outside = wide.where("comp <> main").select(
            "main", "nid", "comp", "shingles", F.lit(True).alias("other"), part(2, "ot").alias("o"), spread("rt").alias("r")
        )
        return row.unionByName(outside).groupBy("main", "o", "r").applyInArrow(_tile_links(self.threshold), "a long, b long")

    def sets_of(self, nodes: DataFrame, name: str) -> DataFrame:
        """``nid, shingles`` of the given classes, from the text of their representatives; a class is read once for all phases."""
        nodes = self.scratch.save(nodes, f"{name}-nodes")
        few = nodes.count() <= BROADCAST_IDS
        near = F.broadcast(nodes) if few else nodes
        new = nodes if self.sets is None else nodes.join(self.sets.select("nid"), "nid", "left_anti")
        ends = self.scratch.save(new.join(self.classes.select("nid", "rep", "set_key"), "nid"), f"{name}-ends")
        if not ends.isEmpty():
            ids = ends.select("rep").distinct()
            ids = F.broadcast(ids) if few else ids
            texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi")
            found = map_chunks(texts, _set_step(self.shingle), "set_key binary, shingles array<long>")
            found = ends.join(found.dropDuplicates(["set_key"]), "set_key").select("nid", "shingles")
            found = self.scratch.save(found, f"{name}-sets")
            self.sets = found if self.sets is None else self.sets.unionByName(found)
        self.scratch.drop(ends)
        if self.sets is None:
            return nodes.select("nid", F.lit(None).cast("array<long>").alias("shingles"))
        return self.sets.join(near, "nid", "left_semi")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and sketches do not rule out."""
        side = lambda x: self.classes.select(F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        wide = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        return map_chunks(wide, _possible_step(self.threshold), "a long, b long")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets reach the threshold."""
        pairs = self.scratch.save(pairs, f"{name}-likely")
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), name)
        both = pairs.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y")), "b"
        )
        common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
        out = self.scratch.save(common.where(100 * F.col("i") >= self.threshold * (F.col("t") - F.col("i"))).select("a", "b"), name)
        self.scratch.drop(pairs)
        return out

    def links(self) -> DataFrame:
        live = self.buckets()
        first = self.linked(self.likely(self.star_pairs(live)), "star")
        comps = connected_components(first, "a", "b")
        rows = self.open_rows(live, comps)
        self.scratch.drop(live, comps)
        links = first.unionByName(self.linked(self.likely(self.small_pairs(rows)), "rest"))
        if not rows.where(F.col("c") > SMALL_BUCKET).isEmpty():
            links = links.unionByName(self.scratch.save(self.large_links(rows), "large"))
        self.scratch.drop(rows)
        return links

    def result(self) -> DataFrame:
        comps = connected_components(self.links(), "a", "b")
        linked = self.classes.select("nid", "set_key", "rep").join(comps, F.col("nid") == F.col("node")).select("nid", "set_key", "rep", "component")
        linked = self.scratch.save(linked, "linked")
        least = self.scratch.save(linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("c")), "least")
        names = ["set_key", "component", "component_id"]
        alone = self.classes.join(comps, F.col("nid") == F.col("node"), "left_anti")
        alone = alone.select("set_key", F.col("nid").alias("component"), F.col("rep").alias("component_id"))
        by_class = split_join(linked, least, "component", "nid", HOT, BROADCAST_IDS).select(*names).unionByName(alone)
        by_class = Scratch(self.docs.sparkSession, "near-classes").save(by_class, "by-class")
        self.by_class = by_class
        self.scratch.clear(self.sketched)
        self.scratch.drop(comps)
        out = self.sketched.select("doc_id", "n_shingles", "set_key").join(self.by_class, "set_key", "left")
        component = F.coalesce("component_id", "doc_id")
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id, kept`` for every row.

    ``threshold`` is the least similarity in per cent. ``component_id`` is the
    smallest id that links reach, and ``kept`` marks that document.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _Join(given, shingle, threshold).result()


def _key_step(shingle: int, text: str):
    def make():
        hashes = WordHashes()

        def step(batch):
            sets = (shingle_set(t, hashes, shingle) for t in utf8(batch.column(text)))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"_set_key": keys}

        return step

    return make


def deduplicate(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with one row of each group, one with the smallest id.

    Rows of one id whose texts are not linked all stay, and so do unlinked
    rows without an id. Wordless rows that repeat an id are one row.
    """
    join = _Join(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle, threshold)
    scratch = Scratch(docs.sparkSession, "kept")
    by_id = join.result().groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    by_id = scratch.save(by_id, "by-id")
    if by_id.where("n > 1").isEmpty():
        gone = by_id.where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"))
        if gone.count() <= BROADCAST_IDS:
            gone = F.broadcast(gone)
        return docs.join(gone, docs[doc_id].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")
    # ids do not tell the rows apart: one row of each component, by id and set
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_key")).alias("least")
    least = join.sketched.join(join.by_class, "set_key").groupBy("component").agg(place)
    least = scratch.save(least.select(F.col("least.doc_id").alias("least_id"), F.col("least.set_key").alias("least_key")), "least")
    schema = StructType([*docs.schema.fields, StructField("_set_key", BinaryType())])
    keyed = scratch.save(map_chunks(docs, _key_step(shingle, text), schema), "keyed")
    stays = (keyed["_set_key"] == least["least_key"]) & keyed[doc_id].cast("long").eqNullSafe(least["least_id"])
    linked = keyed.join(least, stays, "left_semi").dropDuplicates([doc_id, "_set_key"])
    wordless = keyed.where(F.col("_set_key").isNull())
    named = wordless.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
    return linked.unionByName(named).unionByName(wordless.where(F.col(doc_id).isNull())).drop("_set_key")
