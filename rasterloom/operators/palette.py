"""Weighted k-means whose centres are catalogue threads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import LAB
from ..workspace import Rounds
from .nearest import _beside, _measured, _sq, first_of_colour, steps


#: Columns of the mean colour of a palette entry's pixels.
MEAN = ("mean_l", "mean_a", "mean_b")


def samples(pixels: DataFrame, stride: int, contrast_weight: float, ramp_weight: float | None = None) -> DataFrame:
    """Every stride-th worked pixel with its weight: ramp pixels little, contrasty ones more."""
    w = F.lit(1.0) + F.lit(contrast_weight) * F.col("contrast")
    if ramp_weight is not None:
        w = F.when(F.col("ramp"), F.lit(ramp_weight)).otherwise(w)
    return pixels.where((F.col("i") % stride == 0) & F.col("mask")).select("img", "i", *LAB, "ramp", w.alias("w"))


def slot_means(assigned: DataFrame, slot: str = "slot") -> DataFrame:
    """Weighted mean colour, weight, share of the weight and ramp share of each slot."""
    sums = assigned.groupBy("img", slot).agg(F.sum("w").alias("weight"), *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in LAB], F.avg(F.col("ramp").cast("double")).alias("ramp_share"))
    return sums.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("img")))


def closest_pair(palette: DataFrame, lightness: float = 1.4) -> DataFrame:
    """img, i, j, distance: the closest two entries of which not both are locked; first of equals.  Distances in lightness
    weigh ``lightness`` times as much.

    palette(img, idx, locked, ok_*) holds a few dozen rows an image, so its pairs are made and dropped inside one row, and
    only the palette itself is shuffled and sorted."""
    weight = dict(zip(LAB, (lightness, 1.0, 1.0), strict=True))
    packed = palette.groupBy("img").agg(F.collect_list(F.struct("idx", "locked", *LAB)).alias("all"))

    def nearest(p: Column) -> Column:
        others = F.filter("all", lambda q: (p["idx"] < q["idx"]) & ~(p["locked"] & q["locked"]))
        d2 = lambda q: sum(((q[c] - p[c]) * F.lit(w) * (q[c] - p[c]) * F.lit(w) for c, w in weight.items()), F.lit(0.0))
        return F.array_min(F.transform(others, lambda q: F.struct(F.round(F.sqrt(d2(q)), 9).alias("distance"), p["idx"].alias("i"), q["idx"].alias("j"))))

    best = packed.select("img", F.array_min(F.transform("all", nearest)).alias("m")).where("m is not null")
    return best.select("img", "m.i", "m.j", "m.distance")


def nearest_slot(rows: DataFrame, slots: DataFrame, out: str = "slot", key: str = "slot") -> DataFrame:
    """Add the nearest slot of the row's image, the first of equals; slots(img, slot, ok_*) are a few dozen
    rows an image.  Rows whose mask is false get null."""
    packed = slots.groupBy("img").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("slot"), *LAB))).alias("__slots"))
    own = {c: F.col(c) for c in LAB}
    best = F.array_min(F.transform("__slots", lambda t: F.struct(steps(_sq(1.0, own, t)).alias("d"), t["slot"].alias("slot"))))["slot"]
    if "mask" in rows.columns:
        best = F.when(F.coalesce(F.col("mask"), F.lit(True)), best)
    return rows.join(packed, "img", "left").withColumn(out, best).drop("__slots")


def _least_distance(slots: str) -> Column:
    own = {c: F.col(c) for c in LAB}
    return F.array_min(F.transform(slots, lambda t: F.round(_sq(1.0, own, t), 9)))


#: Pixels whose weights are summed before an image's sums are.
_BLOCK = 4096
#: Fixed value: the seed of the draws that palettes start from.
SEED = 1234567


def xorshift32(seed: int) -> Iterator[float]:
    """Draws from 0 to 1 of the 32-bit xorshift generator with shifts 13, 17 and 5."""
    state = seed & 0xFFFFFFFF or 0x9E3779B9  # fixed value: what a zero seed is replaced by
    while True:
        for shift in (13, -17, 5):
            state ^= (state << shift if shift > 0 else state >> -shift) & 0xFFFFFFFF
        yield state / 2**32


def weighted_draw(weighted: DataFrame, draw: float) -> DataFrame:
    """img, i, ok_*: of each image's rows weighted(img, i, ok_*, mass) the first at which the running sum of mass reaches
    ``draw`` times the whole; images without mass have none.  Sums run over blocks first and then inside one block."""
    rows = weighted.withColumn("block", F.floor(F.col("i") / _BLOCK))
    sums = rows.groupBy("img", "block").agg(F.sum("mass").alias("m"))
    by = Window.partitionBy("img")
    upto = sums.withColumn("upto", F.sum("m").over(by.orderBy("block"))).withColumn("goal", F.lit(draw) * F.sum("m").over(by)).where("goal is not null")
    reached = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("block", (F.col("goal") - F.col("upto") + F.col("m")).alias("rest"))))
    last = F.max(F.struct("block", F.col("m").alias("rest")))
    chosen = upto.where("m > 0").groupBy("img").agg(F.coalesce(reached, last).alias("b")).select("img", "b.block", "b.rest")
    inside = rows.join(chosen, ["img", "block"]).withColumn("c", F.sum("mass").over(by.orderBy("i")))
    row = F.struct("i", *LAB)
    return inside.groupBy("img").agg(F.coalesce(F.min(F.when(F.col("c") >= F.col("rest"), row)), F.max(row)).alias("r")).select("img", "r.*")


_SLOT = "img, slot, ord, number, ok_l, ok_a, ok_b, fixed"


def _free_threads(rows: DataFrame, threads: DataFrame, used: str) -> DataFrame:
    """Each row with the nearest colour that its list of used ones lacks, as best."""
    pairs, parts = _beside(rows, threads)
    best = F.array_min(F.filter(_measured(1.0), lambda t: ~F.array_contains(used, t["ord"])))
    if parts == 1:
        return pairs.withColumn("best", best)
    return pairs.withColumn("best", best).groupBy("img").agg(F.min("best").alias("best"))


def _nearest_few(rows: DataFrame, key: list[str], threads: DataFrame, k: int) -> DataFrame:
    """Each row's k nearest colours, as best: an array of (s, ord, number, d) in order."""
    pairs, parts = _beside(rows, threads)
    best = pairs.select(*key, F.slice(F.array_sort(_measured(1.0)), 1, k).alias("best"))
    if parts == 1:
        return best
    return best.groupBy(*key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def extract_palettes(sampled: DataFrame, threads: DataFrame, k: int, locked: tuple[str, ...] = (), halo: float = 1.1, iterations: int = 24) -> DataFrame:
    """img, idx, ord, number, ok_*, share, locked, mean_*: the palette of every image of the samples, lightest first.

    All images advance together and stay in Spark: a round is one projection (argmin over the image's own
    slots) and one aggregation, after which each free slot moves to the nearest thread that no other slot
    of its image has.  Starts are the locked threads, then threads nearest to samples that are drawn, seeded, with
    their weight (the first) and their weight times the squared distance to the nearest start (the others).  A slot
    without samples dies.  mean_* is the weighted mean colour of a slot's samples.  A catalogue may have any size: an
    image has at most k threads in use, so the k nearest of a slot's mean hold its nearest free one.
    """
    rounds = Rounds(sampled.sparkSession, "palette")
    data = rounds.keep(sampled)
    whole = rounds.keep(threads.select("ord", "number", *LAB))
    images = rounds.keep(data.select("img").distinct())
    k = max(1, min(k, whole.count()))
    library = rounds.keep(first_of_colour(whole, [F.col("ord")], k))
    wanted = sampled.sparkSession.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(locked))], "number string, slot int")
    kept = whole.join(wanted, "number").withColumn("slot", F.row_number().over(Window.orderBy("slot")) - 1).where(F.col("slot") < k)  # a few rows that the caller named
    fixed = kept.count()
    near = rounds.keep(library.unionByName(kept.select("ord", "number", *LAB)).dropDuplicates(["ord"]))  # all that a slot can take
    slots = rounds.keep(images.join(F.broadcast(kept.withColumn("fixed", F.lit(True)))).selectExpr(*_SLOT.split(", ")))
    draws = xorshift32(SEED)
    for at in range(fixed, k):
        mine = slots.groupBy("img").agg(F.collect_list(F.struct(*LAB)).alias("slots"), F.collect_list("ord").alias("used"))
        mass = F.when(F.col("slots").isNull(), F.col("w")).otherwise(_least_distance("slots") * F.col("w"))
        drawn = weighted_draw(data.join(mine, "img", "left").select("img", "i", *LAB, mass.alias("mass")), next(draws))
        starts = drawn.join(mine.select("img", "used"), "img", "left").select("img", *LAB, F.coalesce("used", F.array().cast("array<int>")).alias("used"))
        new = _free_threads(starts.select("img", *LAB, "used"), library, "used").select("img", F.lit(at).alias("slot"), "best.ord", "best.number").join(library.select("ord", *LAB), "ord").withColumn("fixed", F.lit(False))
        slots = rounds.keep(slots.unionByName(new))

    def means() -> DataFrame:
        return slot_means(nearest_slot(data, slots)).withColumnsRenamed({c: f"m{c}" for c in LAB})

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        """The slots of one image, each at the nearest of its colours that is free; k rows."""
        rows = rows.sort_values("slot")
        used, out = set(rows.loc[rows.fixed, "ord"].tolist()), []
        for r in rows.itertuples():
            to = r.ord
            if not r.fixed:
                if r.best is None:
                    continue
                to = next(t["ord"] for t in r.best if t["ord"] not in used)
                used.add(to)
            out.append((r.img, len(out), to, r.fixed, to != r.ord))
        return pd.DataFrame(out, columns=["img", "slot", "ord", "fixed", "moved"])

    for turn in range(iterations):
        best = _nearest_few(means().select("img", "slot", *[F.col(f"m{c}").alias(c) for c in LAB]), ["img", "slot"], library, k)
        known = slots.select("img", "slot", "ord", "fixed").join(best, ["img", "slot"], "left")
        moved = known.groupBy("img").applyInPandas(move, f"img {dict(slots.dtypes)['img']}, slot int, ord int, fixed boolean, moved boolean")
        after = rounds.keep(moved.join(near, "ord").selectExpr(*_SLOT.split(", "), "moved"))
        same = turn and after.where("moved").isEmpty() and after.count() == slots.count()
        slots = after.drop("moved")
        if same:
            break
    if halo <= 1:
        measured = slots.join(means().select("img", "slot", "share", "ramp_share"), ["img", "slot"], "left")
        stays = F.col("fixed") | (F.coalesce("ramp_share", F.lit(0.0)) <= halo)
        top = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("stays"), F.desc("share"), "slot")) == 1
        slots = rounds.keep(measured.withColumn("stays", stays).withColumn("top", top).where("stays or top").selectExpr(*_SLOT.split(", ")))
    mean = [F.coalesce(f"m{c}", c).alias(m) for c, m in zip(LAB, MEAN, strict=True)]
    known = slots.join(means().select("img", "slot", "share", *[f"m{c}" for c in LAB]), ["img", "slot"], "left")
    shares = known.select("img", "slot", "ord", "number", *LAB, "fixed", F.coalesce("share", F.lit(0.0)).alias("share"), *mean)
    idx = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("ok_l"), "number")) - 1
    return shares.withColumn("idx", idx).select("img", "idx", "ord", "number", *LAB, "share", F.col("fixed").alias("locked"), *MEAN)


def merge_close(palettes: DataFrame, threshold: float, lightness: float = 1.4) -> DataFrame:
    """Join the closest two entries of an image, not both locked, while they are under the threshold; the
    locked one or else the larger share survives, with the mean of both colours by share where there are mean_*.
    Distances are between threads, with lightness weighing ``lightness`` times as much.  An image is a few dozen entries."""
    weight = dict(zip(LAB, (lightness, 1.0, 1.0), strict=True))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        entries = [r._asdict() for r in rows.sort_values("idx").itertuples(index=False)]
        while True:
            pairs = [(round(sum(((a[c] - b[c]) * w) ** 2 for c, w in weight.items()), 12) ** 0.5, i, j) for i, a in enumerate(entries) for j, b in enumerate(entries) if i < j and not (a["locked"] and b["locked"])]
            best = min(pairs, default=None)
            if best is None or best[0] >= threshold:
                return pd.DataFrame(entries, columns=rows.columns).assign(idx=range(len(entries)))
            a, b = entries[best[1]], entries[best[2]]
            keep, gone = (a, b) if a["locked"] or (not b["locked"] and a["share"] >= b["share"]) else (b, a)
            both = keep["share"] + gone["share"]
            for c in MEAN:
                if c in keep and both > 0:
                    keep[c] = (keep[c] * keep["share"] + gone[c] * gone["share"]) / both
            keep["share"] = both
            entries = [e for e in entries if e is not gone]

    return palettes.groupBy("img").applyInPandas(run, palettes.schema)


def union_strokes(palette: DataFrame, strokes: DataFrame) -> DataFrame:
    """img, number of every thread that fills regions or sews strokes, once each."""
    return palette.select("img", "number").union(strokes.select("img", "number")).distinct()


def toggle_lock(locks: DataFrame, toggled: DataFrame) -> DataFrame:
    """locks(number) with each toggled number taken out if it is there and put in if it is not."""
    return locks.select("number").exceptAll(toggled.select("number")).union(toggled.select("number").exceptAll(locks.select("number"))).distinct()
