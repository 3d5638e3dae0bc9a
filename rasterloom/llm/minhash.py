"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document's set is its distinct k-word shingles (lower-cased A-Z).  The sketch splits the shingle
hashes over ``BUCKETS`` buckets and keeps, of each bucket's minimum, the count of leading zeros
(6 bits) and the next 10 bits (the mantissa): two bytes a bucket.  ``ROWS`` neighbouring registers,
empty ones filled by densification, make a band; documents that share a band are candidates.  A pair of candidates first passes the
exact size bound, then the collision-corrected Jaccard estimate with a margin of six standard
errors, and is a link only if the full sets confirm it.

Cost and completeness
  * Documents with equal sets are one class; only class representatives are compared.
  * Within a band's bucket no two members are paired blindly.  First each member is held against one
    hub; members that the links join into one component need no more tests there.  A few rounds
    choose other hubs; then every pair of members of one bucket whose components still differ is
    tested.  Thus each link between candidates either is tested or joins what is already joined.
  * A pair at the threshold shares no band with probability (1 - 0.8^4)^32, about 5e-8; the README has
    the recall measured against all pairs.

Defined cases: null or empty text, or text of white space only, has the empty set and links with
nothing; a null doc_id is never linked (component_id null, kept true); rows that repeat a doc_id
each get a row with that id, and where their texts differ each text is linked by itself; an empty
table gives an empty result; very long texts are one set each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import join_by_weight, weight_limit
from .components import connected_components
from .store import Workspace
from .words import Words, as_long, mix64, shingle_sets, slices

BUCKETS, ROWS, MANTISSA = 128, 4, 10
#: Members of a large bucket that are held against another block at once.
BLOCK = 256
#: Sets up to this size travel whole with their sketch into blocks.
SMALL = 400
_EMPTY = np.uint16(0xFFFF)
_PROBE = np.array([np.random.Generator(np.random.PCG64(i)).permutation(np.delete(np.arange(BUCKETS), i)) for i in range(BUCKETS)])
_REST = 57  # bits left beside the bucket's seven
#: Expected share of chance collisions, from the HyperMinHash paper (Yu and Weber).
_COLLISION = 0.169919487159739093975315012348630288992889


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """n x BUCKETS compressed minima; 0xFFFF where a bucket is empty."""
    n = len(bounds) - 1
    low = np.full(n * BUCKETS, np.uint64(1 << _REST), np.uint64)
    key = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds)) * BUCKETS + (sets & np.uint64(BUCKETS - 1)).astype(np.int64)
    np.minimum.at(low, key, sets >> np.uint64(7))
    empty = low >> np.uint64(_REST) > 0
    exponent = np.frexp(np.maximum(low, 1).astype(np.float64))[1]
    zeros = np.clip(_REST - exponent, 0, _REST).astype(np.uint64)
    mantissa = ((low << (zeros + np.uint64(1))) & np.uint64((1 << _REST) - 1)) >> np.uint64(_REST - MANTISSA)
    packed = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    packed[empty] = _EMPTY
    return packed.reshape(n, BUCKETS)


def densified(regs: np.ndarray) -> np.ndarray:
    """Fill each empty bucket from the first full one of its own fixed random order, so that a
    bucket of small sets too agrees with the probability of their similarity."""
    full = regs != _EMPTY
    out = regs.copy()
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    left = ~full[rows]
    for step in range(BUCKETS - 1):
        if not len(rows):
            break
        source = _PROBE[:, step]
        take = left & full[rows][:, source]
        r, c = np.nonzero(take)
        out[rows[r], c] = regs[rows[r], source[c]]
        left &= ~take
        more = left.any(axis=1)
        rows, left = rows[more], left[more]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of all bands, a row for each row of registers."""
    joined = densified(regs).reshape(len(regs), BUCKETS // ROWS, ROWS).view(np.uint64)[:, :, 0]
    return mix64(joined + np.arange(BUCKETS // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the buckets they rest on."""
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=1)
    same = ((a == b) & (a != _EMPTY)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = _COLLISION * used * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, same - chance) / np.maximum(1, used), used


def _sketch(k: int, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                sets, bounds = shingle_sets(words, k)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                prints = np.zeros((2, part.num_rows), np.uint64)
                if len(full):
                    prints[0, full] = np.add.reduceat(sets, bounds[:-1][full])
                    prints[1, full] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
                regs = registers(sets, bounds)
                columns = {"doc_id": part.column("doc_id"), "n_shingles": pa.array(size), "f1": as_long(prints[0]), "f2": as_long(prints[1]), "regs": pa.array([r.tobytes() if s else None for r, s in zip(regs, size, strict=True)], pa.binary())}
                if with_sets:
                    columns["items"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), as_long(sets))
                yield pa.record_batch(columns)

    return run


_SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, regs binary"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(regs)
            band = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
            yield pa.record_batch({"key": as_long(keys.ravel()), "band": pa.array(band), "id": pa.array(np.repeat(np.asarray(batch.column("id")), keys.shape[1]))})


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column("items_a"), batch.column("items_b")
            lo, hi = np.asarray(left.flatten()), np.asarray(right.flatten())
            la, ra = np.asarray(left.offsets) - left.offsets[0].as_py(), np.asarray(right.offsets) - right.offsets[0].as_py()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = lo[la[i] : la[i + 1]], hi[ra[i] : ra[i + 1]]
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            where = pa.array(np.flatnonzero(keep))
            yield pa.record_batch({"a": batch.column("a").take(where), "b": batch.column("b").take(where)})

    return run


def _likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    guess, used = estimate(a, b, n_a, n_b)
    t = percent / 100
    return guess >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(1, used))


def _prune(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b"))
            where = pa.array(np.flatnonzero(_likely(a, b, np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")), percent)))
            yield pa.record_batch({"a": batch.column("a").take(where), "b": batch.column("b").take(where)})

    return run


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of at most SMALL shingles in 32 bits a shingle; null for larger ones."""
    for batch in batches:
        lists = batch.column("items")
        flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        short = [np.unique(flat[a:b].astype(np.uint32)).tobytes() if b - a <= SMALL else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch({"id": batch.column("id"), "n_shingles": batch.column("n_shingles"), "regs": batch.column("regs"), "short": pa.array(short, pa.binary())})


def _across(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Likely pairs of different components between (or, on the diagonal, within) two blocks.

        A pair that shares an earlier band is left to that band's bucket.  Short sets are held against
        each other at once: 32-bit shingles can only add to an intersection, so no link is lost.
        """
        table = table.combine_chunks()
        i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        block, ids, component, n = (table.column(c).to_numpy() for c in ("block", "id", "component", "n_shingles"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys = band_keys(regs)[:, :band]
        sets = [None if s is None else np.frombuffer(s, np.uint32) for s in table.column("short").to_pylist()]
        right = np.flatnonzero(block == j)
        found = []
        for x in np.flatnonzero(block == i):
            y = right[component[right] != component[x]]
            if i == j:
                y = y[y > x]
            y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
            y = y[~(keys[y] == keys[x]).any(axis=1)]
            if len(y):
                y = y[_likely(regs[x][None, :], regs[y], n[x], n[y], percent)]
            if len(y) and sets[x] is not None:
                known = np.array([sets[k] is not None for k in y])
                held = y[known]
                if len(held):
                    size = np.array([len(sets[k]) for k in held])
                    shared = np.add.reduceat(np.isin(np.concatenate([sets[k] for k in held]), sets[x]), np.cumsum(size) - size).astype(np.int64)
                    lost = n[held] - size + n[x] - len(sets[x])  # shingles that 32 bits cannot tell apart
                    held = held[100 * (shared + lost) >= percent * (n[held] + n[x] - shared - lost)]
                y = np.concatenate([y[~known], held])
            if len(y):
                found.append(np.stack([np.full(len(y), ids[x]), ids[y]]))
        pairs = np.sort(np.concatenate(found, axis=1), axis=0) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return run


def _block_pairs(placed: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of large buckets: members go to blocks of about BLOCK, and each pair of blocks is
    one small group, in which only pairs that the sketches (and short sets) support are emitted."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    short = items.select("id", "n_shingles", "regs", "items").mapInArrow(_short_sets, "id long, n_shingles long, regs binary, short binary")
    members = placed.join(short, "id").select("key", "band", "id", "component", "n_shingles", "regs", "short", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "n_shingles", "regs", "short")
    return dealt.groupBy("key", "i", "j").applyInArrow(_across(percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, hub_rounds: int = 3) -> DataFrame:
    """Return doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Two documents link if 100 * |intersection| >= percent * |union| of their k-word shingle sets;
    components are what links reach, named by their smallest doc_id.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = work.keep(rows.mapInArrow(_sketch(k, False), _SKETCH), "sketch")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = work.keep(usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs"), F.count("*").alias("copies")), "classes")
    bands = classes.select("id", "regs").mapInArrow(_bands, "key long, band int, id long")
    shared = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    buckets = work.keep(bands.join(shared, "key"), "buckets")
    active = buckets.select("id").distinct()
    items = work.keep(rows.join(active.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(_sketch(k, True), _SKETCH + ", items array<long>").select(F.col("doc_id").alias("id"), "n_shingles", "regs", "items"), "items")

    def confirmed(pairs: DataFrame) -> DataFrame:
        brief = items.select("id", F.col("n_shingles").alias("n"), "regs")
        a, b = (brief.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}")) for s in "ab")
        likely = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").mapInArrow(_prune(percent), "a long, b long")
        a, b = (items.select(F.col("id").alias(s), F.col("items").alias(f"items_{s}")) for s in "ab")
        return likely.join(a, "a").join(b, "b").mapInArrow(_verify(percent), "a long, b long").distinct()

    tested = work.keep(buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = work.keep(confirmed(tested), "links")
    found = connected_components(work, links)
    for turn in range(1, hub_rounds + 1):
        placed = buckets.select("key", "band", "id").join(found, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
        open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "component")).alias("hub"), F.count("*").alias("n")).where("low < high")
        placed = work.keep(placed.join(open_keys.select("key", "n", F.col("hub.id").alias("hub"), F.col("hub.component").alias("hub_component")), "key"), "open")
        if placed.isEmpty():
            break
        if turn < hub_rounds:
            pairs = placed.where("component <> hub_component").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        else:
            few = placed.where(F.col("n") <= BLOCK // 4)
            other = few.select("key", F.col("id").alias("other"), F.col("component").alias("other_component"))
            pairs = few.join(other, "key").where("component < other_component").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
            pairs = pairs.unionAll(_block_pairs(placed.where(F.col("n") > BLOCK // 4), items, percent))
        pairs = work.keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = work.keep(confirmed(pairs), "links")
        tested, links = tested.unionAll(pairs), links.unionAll(more)
        if not more.isEmpty():
            found = connected_components(work, links)

    named = classes.select("f1", "f2", "n_shingles", "id", "copies").join(found, "id", "left").select("f1", "f2", "n_shingles", "copies", F.coalesce("component", "id").alias("component_id"))
    # copies of one text are one key: heavy ones are joined where they lie, and empty texts are not joined
    own = join_by_weight(usable.select("doc_id", "f1", "f2", "n_shingles"), named, ["f1", "f2", "n_shingles"], "copies", weight_limit(usable.count()))
    alone = sketched.where("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return own.select(columns).unionAll(alone.select(columns)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
