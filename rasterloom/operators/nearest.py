"""Nearest colours: argmin joins of pixels and centroids with the thread catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import LAB
from ..workspace import Rounds

#: Catalogue rows that one array holds; larger catalogues are dealt over several.
CHUNK = 4096


def _sq(lightness: float, left: Column | dict[str, Column], right: Column | dict[str, Column]) -> Column:
    l, a, b = ((left[c] - right[c]) * (left[c] - right[c]) for c in LAB)
    return F.lit(lightness) * l + a + b


def steps(distance_sq: Column) -> Column:
    """A squared distance in whole units of 1e-9, in which ties are decided; cheaper than rounding doubles."""
    return F.floor(distance_sq * 1e9 + 0.5)


class Colours:
    """A catalogue of bounded size as a matrix, in order; distances are compared in whole units of 1e-9."""

    def __init__(self, lab: np.ndarray, lightness: float = 1.0):
        self.lab, self.weight = lab.reshape(-1, 3), np.array([lightness, 1.0, 1.0])

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, squared distances, their units) of tiles of a batch's ok_* rows; a tile has a bounded number of distances."""
        own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in LAB], 1)
        high = max(1, (1 << 19) // max(1, len(self.lab)))
        for low in range(0, len(own), high):
            part = slice(low, min(len(own), low + high))
            d = sum(w * (own[part, k, None] - self.lab[None, :, k]) ** 2 for k, w in enumerate(self.weight))
            yield part, d, np.floor(d * 1e9 + 0.5)

    def first(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The nearest colour of each row, the first of equals, and its squared distance; -1 for a row without a colour."""
        at, far = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
        for part, d, s in self.tiles(batch):
            best = s.argmin(1)
            value = d[np.arange(len(d)), best]
            good = ~np.isnan(value)
            at[part], far[part] = np.where(good, best, -1), value
        return at, far


def nearest_literal(pixels: DataFrame, palette: list[tuple[int, float, float, float]], out: str = "label") -> DataFrame:
    """Nearest of a short palette (index, ok_l, ok_a, ok_b); the first of equals.  Pixels whose mask is false get null.

    The search is a step of its own in the plan, so that no filter on the label repeats it."""
    if not palette:
        return pixels.withColumn(out, F.lit(None).cast("int"))
    index, colours = np.array([j for j, *_ in palette]), Colours(np.array([lab for _, *lab in palette], float))
    names = [c for c in pixels.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _ = colours.first(batch)
            gone = at < 0
            if "mask" in names:
                gone = gone | ~np.asarray(batch.column("mask").fill_null(True).cast(pa.bool_()))
            yield pa.record_batch({c: batch.column(c) for c in names} | {out: pa.array(index[at], pa.int32(), mask=gone)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*names).schema)
    return pixels.select(*names).mapInArrow(run, f"{schema}, `{out}` int")


def first_of_colour(threads: DataFrame, order: list[Column], k: int = 1) -> DataFrame:
    """ord, number, ok_* of the first k rows of each colour.  A search for the k nearest needs no others, since rows of
    one colour are equally far and go by their order; a catalogue that repeats its colours shrinks before it travels."""
    at = F.row_number().over(Window.partitionBy(*LAB).orderBy(*order))
    return threads.select("ord", "number", *LAB).withColumn("__at", at).where(F.col("__at") <= k).drop("__at")


def _catalogue(threads: DataFrame, order: list[Column]) -> list[tuple[object, ...]] | None:
    """ord, number, ok_* of a catalogue of at most CHUNK colours in the given order; None if there are more."""
    rows = [tuple(r) for r in threads.select("ord", "number", *LAB).orderBy(*order).limit(CHUNK + 1).collect()]
    return rows if len(rows) <= CHUNK else None


def _beside(rows: DataFrame, threads: DataFrame) -> tuple[DataFrame, int]:
    """Each row with an array of the catalogue's colours (ord, number, ok_*), and in how many parts.

    A usual catalogue is one array, whose size is checked before it goes to every task; a larger one is
    dealt into arrays by a hash, and rows meet each of them in a shuffled join.
    """
    entry = F.sort_array(F.collect_list(F.struct("ord", "number", *LAB))).alias("entries")
    parts = max(1, -(-threads.count() // CHUNK))
    if parts == 1:
        return rows.join(F.broadcast(threads.agg(entry))), 1
    packed = threads.groupBy(F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int").alias("part")).agg(entry)
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(packed.hint("shuffle_hash"), "part"), parts


def _schema(rows: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)


def _measured(lightness: float) -> Column:
    """The entries with their distances from the row, as (steps, ord, number, d)."""
    own = {c: F.col(c) for c in LAB}
    return F.transform("entries", lambda t: F.struct(steps(_sq(lightness, own, t)).alias("s"), t["ord"].alias("ord"), t["number"].alias("number"), _sq(lightness, own, t).alias("d")))


def nearest_thread(rows: DataFrame, key: list[str], threads: DataFrame, excluded: DataFrame | None = None, lightness: float = 1.0) -> DataFrame:
    """key, ord, number, distance_sq: for each row the nearest catalogue colour not excluded; the first
    in catalogue order of equals, null if all are excluded.  Distances are to nine decimals."""
    free = first_of_colour(threads.join(excluded.select("number"), "number", "left_anti") if excluded is not None else threads, [F.col("ord")])
    known = _catalogue(free, [F.col("ord")])
    if known is not None:
        colours = Colours(np.array([r[2:] for r in known], float), lightness)
        ords, numbers = np.array([r[0] for r in known] or [0]), np.array([r[1] for r in known] or [""], object)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, far = colours.first(batch) if known else (np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan))
                row = {c: batch.column(c) for c in key}
                yield pa.record_batch(row | {"ord": pa.array(ords[at], pa.int32(), mask=at < 0), "number": pa.array(numbers[at], pa.string(), mask=at < 0), "d": pa.array(far, pa.float64(), mask=at < 0)})

        return rows.select(*key, *LAB).mapInArrow(run, f"{_schema(rows, key)}, ord int, number string, d double").select(*key, "ord", "number", F.round("d", 9).alias("distance_sq"))
    pairs, parts = _beside(rows.select(*key, *LAB), free)
    best = pairs.select(*key, F.array_min(_measured(lightness)).alias("best"))
    if parts > 1:
        best = best.groupBy(*key).agg(F.min("best").alias("best"))
    return best.select(*key, F.col("best.ord").alias("ord"), F.col("best.number").alias("number"), F.round("best.d", 9).alias("distance_sq"))


def snap(rows: DataFrame, key: list[str], palette: DataFrame, threads: DataFrame, radius: float = 0.2) -> DataFrame:
    """The nearest palette thread if it lies within the radius, else the nearest of the catalogue."""
    near = nearest_thread(rows, key, palette).where(F.col("distance_sq") < radius * radius).select(*key, F.col("number").alias("palette_number"))
    return nearest_thread(rows, key, threads).join(near, key, "left").select(*key, F.coalesce("palette_number", "number").alias("number"), F.col("palette_number").isNotNull().alias("from_palette"))


def rank_threads(rows: DataFrame, key: list[str], threads: DataFrame, k: int = 12) -> DataFrame:
    """The k nearest colours of each row by distance, then number in the order of the root locale."""
    local = [F.collate("number", "UNICODE"), F.col("number")]
    threads = first_of_colour(threads, local, k)
    known = _catalogue(threads, local)
    if known is not None:
        numbers, n = np.array([r[1] for r in known] or [""], object), len(known)
        # rows of one colour are measured once: before all rows of a colour that is not among the first k by (distance, first row)
        # come the first rows of these k
        lab, first, of = np.unique(np.array([r[2:] for r in known], float).reshape(-1, 3), axis=0, return_index=True, return_inverse=True)
        colours, size = Colours(lab), np.bincount(of.ravel(), minlength=len(lab))
        members = np.full((len(lab), max(1, size.max(initial=0))), -1)
        order = np.argsort(of.ravel(), kind="stable")
        members[of.ravel()[order], np.arange(n) - np.repeat(np.cumsum(size) - size, size)] = order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, d, s in colours.tiles(batch) if n else ():
                    good = np.flatnonzero(~np.isnan(d[:, 0]))
                    if not len(good):
                        continue
                    rank = s[good].astype(np.int64) * n  # rows of the catalogue are in order of number
                    near = np.argpartition(rank + first, k - 1, axis=1)[:, :k] if len(first) > k else np.broadcast_to(np.arange(len(first)), rank.shape)
                    top = members[near].reshape(len(good), -1)
                    rank = np.where(top < 0, np.iinfo(np.int64).max, np.repeat(np.take_along_axis(rank, near, 1), members.shape[1], axis=1) + top)
                    keep = min(k, n)
                    best = np.argpartition(rank, keep - 1, axis=1)[:, :keep] if rank.shape[1] > keep else np.broadcast_to(np.arange(keep), rank.shape)
                    best = np.take_along_axis(best, np.argsort(np.take_along_axis(rank, best, 1), axis=1), 1)
                    top = np.take_along_axis(top, best, 1)
                    at = pa.array(np.repeat(good + part.start, top.shape[1]))
                    row = {c: batch.column(c).take(at) for c in key}
                    yield pa.record_batch(row | {"number": pa.array(numbers[top.ravel()], pa.string()), "d": pa.array(np.take_along_axis(d[good], of.ravel()[top], 1).ravel()), "rank": pa.array(np.tile(np.arange(1, top.shape[1] + 1), len(good)), pa.int32())})

        return rows.select(*key, *LAB).mapInArrow(run, f"{_schema(rows, key)}, number string, d double, rank int").select(*key, "number", F.round("d", 9).alias("distance_sq"), "rank")
    pairs, parts = _beside(rows.select(*key, *LAB), threads)
    first = F.transform(_measured(1.0), lambda t: F.struct(t["s"].alias("s"), F.collate(t["number"], "UNICODE").alias("o"), t["number"].alias("number"), t["d"].alias("d")))
    best = pairs.select(*key, F.slice(F.array_sort(first), 1, k).alias("best"))
    if parts > 1:
        best = best.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    ranked = best.select(*key, F.posexplode_outer("best").alias("at", "t")).where("at is not null")
    return ranked.select(*key, F.col("t.number").alias("number"), F.round("t.d", 9).alias("distance_sq"), (F.col("at") + 1).alias("rank"))


def search_threads(threads: DataFrame, asked: str, k: int = 12) -> DataFrame:
    """The first k threads whose number begins with or name contains the text, in catalogue order."""
    q = asked.strip().lower()
    return threads.where(F.lower("number").startswith(q) | F.lower("name").contains(q)).orderBy("ord").limit(k)


def effective_threads(palette: DataFrame, replacements: DataFrame, threads: DataFrame) -> DataFrame:
    """palette(img, idx, number) with each number's replacement(number, to) if that is in the catalogue."""
    known = replacements.join(threads.select(F.col("number").alias("to")), "to", "left_semi")
    return palette.join(known, "number", "left").select("img", "idx", F.coalesce("to", "number").alias("number"))


def resolve_merges(palette: DataFrame, merges: DataFrame) -> DataFrame:
    """number, target: where a chain of merges(number, to) ends, however long; chains that come back stop
    before the repeated number, and a target outside the palette (or itself) leaves the number as it is."""
    rounds = Rounds(palette.sparkSession, "merges")
    now = palette.select("number").distinct().select("number", F.col("number").alias("target"), F.array("number").alias("seen"))
    steps = merges.select(F.col("number").alias("target"), "to")
    while True:
        moved = now.join(steps, "target", "left")
        go = F.col("to").isNotNull() & ~F.array_contains("seen", F.coalesce("to", F.lit("")))
        after = rounds.keep(moved.select("number", F.when(go, F.col("to")).otherwise(F.col("target")).alias("target"), F.when(go, F.array_append("seen", F.col("to"))).otherwise(F.col("seen")).alias("seen"), go.alias("go")))
        if after.where("go").isEmpty():
            break
        now = after.drop("go")
    inside = palette.select(F.col("number").alias("target")).distinct().withColumn("ok", F.lit(True))
    return now.select("number", "target").join(inside, "target", "left").select("number", F.when(F.col("ok"), F.col("target")).otherwise(F.col("number")).alias("target"))


def remap_labels(labels: DataFrame, remap: DataFrame) -> DataFrame:
    """Labels through remap(label, to); labels without a row and null stay."""
    return labels.join(remap.select("label", F.col("to").alias("__to")), "label", "left").withColumn("label", F.coalesce("__to", "label")).drop("__to")
