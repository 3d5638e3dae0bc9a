"""Ranks in linked lists and rings: inside tiles at once, and by pointer doubling from tile to tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Rounds
from .stencil import TILE, dealt


#: Key of a node that has none.
_NONE = np.iinfo(np.int64).max


def _segments(node: np.ndarray, prev: np.ndarray, linked: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
    """Walks inside one tile: nodes linked (those of which ``linked`` is set) with the node before them, which may be of another tile.

    A node is ``open`` if its walk comes from another tile; it is ``off`` steps behind the first of its segment, ``root``.  head is
    the least key of an open segment, which ``hold`` steps from its root has, or the head of a walk that the tile holds whole.
    """
    order = np.argsort(node)
    at = np.minimum(np.searchsorted(node, prev, sorter=order), len(node) - 1)
    before = np.where(linked & (node[order[at]] == prev), order[at], -1)
    jump = np.where(before < 0, np.arange(len(node)), before)
    off = (before >= 0).astype(np.int64)
    steps = max(1, len(node)).bit_length()
    for _ in range(steps):
        off, jump = off + off[jump], jump[jump]
    ring = before[jump] >= 0
    last = np.ones(len(node), bool)
    last[before[before >= 0]] = False
    open_ = ~ring & linked[jump]
    head, rank, hold = np.where(ring, key, key[jump]), np.where(ring, 0, off), np.zeros(len(node), np.int64)
    if ring.any():  # rings inside the tile: the least key and how far behind it
        to, hops = np.where(before < 0, np.arange(len(node)), before), 1
        for _ in range(steps):
            better = ring & (head[to] < head)
            head, rank = np.where(better, head[to], head), np.where(better, hops + rank[to], rank)
            to, hops = to[to], hops * 2
    of = np.flatnonzero(open_)
    if len(of):
        of = of[np.lexsort((off[of], key[of], jump[of]))]  # least key first
        first = np.concatenate([[True], jump[of][1:] != jump[of][:-1]])
        least = of[first][np.cumsum(first) - 1]
        head[of], hold[of] = key[least], off[least]
        rank[of] = off[of] - hold[of]
    return {"open": open_, "last": last & ~ring, "root": node[jump], "off": off, "hold": hold, "head": head, "rank": rank, "ring": ring, "before": prev[jump]}


def _mine(found: dict[str, np.ndarray], node: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether that is told, whether a node's walk stays) where the tile knows the heads of a node's walk and of its twin's."""
    order = np.argsort(node)
    at = order[np.minimum(np.searchsorted(node, twin, sorter=order), len(node) - 1)]
    told = (node[at] == twin) & ~found["open"] & ~found["open"][at]
    return told, told & (found["head"] <= found["head"][at]) & (found["head"] != _NONE)


#: What a walk inside a tile adds to its nodes.
WALKED = "open boolean, last boolean, ring boolean, root long, off long, hold long, rank long, before long, head long"


def walked_table(found: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    return {c: pa.array(found[c]) for c in ("open", "last", "ring", "root", "off", "hold", "rank", "before")} | {"head": pa.array(found["head"], mask=found["head"] == _NONE)}


def walk_darts(node: np.ndarray, prev: np.ndarray, linked: np.ndarray, key: np.ndarray, twin: np.ndarray) -> tuple[dict[str, pa.Array], np.ndarray]:
    """(WALKED and mine as columns, which rows stay) of a tile's darts; darts whose twin's walk stays instead are out."""
    found = _segments(node, prev, linked, np.where(key < 0, _NONE, key))
    told, mine = _mine(found, node, twin)
    stay = ~told | mine
    return {c: v.filter(pa.array(stay)) for c, v in (walked_table(found) | {"mine": pa.array(mine, mask=~told)}).items()}, stay


def _in_tiles(links: DataFrame, rows: int) -> DataFrame:
    """links with what ``_segments`` says of them."""
    names = [c for c in links.columns if c not in ("tile", "prev", "key")]
    kinds = dict(links.dtypes)

    def run(table: pa.Table) -> pa.Table:
        node, prev, key = (table.column(c).cast(pa.int64()) for c in ("node", "prev", "key"))
        found = _segments(node.to_numpy(), pc.fill_null(prev, 0).to_numpy(), pc.is_valid(prev).to_numpy(), pc.fill_null(key, _NONE).to_numpy())
        return pa.table({c: table.column(c) for c in names} | walked_table(found))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", {WALKED}"
    return dealt(links, rows, "img", "tile").groupBy("img", "tile").applyInArrow(run, schema)


def rank_chains(links: DataFrame, rounds: Rounds) -> DataFrame:
    """img, node, ..., head, rank, ring for links(img, node, prev, key, tile, ...).

    In a list, ``head`` is the key of its first node (that without a prev) and ``rank`` how far behind it a
    node is; in a ring, ``head`` is the least key (null keys are none) and ``rank`` counts from the node that
    has it.  Keys that decide are unique in their list or ring.  A tile is a bounded number of nodes; it is walked at once, so
    only the last nodes of segments that come from another tile go on in rounds.  After round k each of these knows what the 2^k
    segments before it hold, so there are as many rounds as the chain of most segments has binary digits; those that know their
    head leave the iteration.  A ring is through when a round lowers none of its keys.
    """
    return rank_walked(rounds.keep(_in_tiles(links, links.count())), rounds)


def rank_walked(walked: DataFrame, rounds: Rounds) -> DataFrame:
    """rank_chains of what is walked inside tiles: a kept table of img, node, ... and WALKED."""
    rest_of = walked.columns[2 : walked.columns.index("open")]
    whole = walked.where("not open").select("img", "node", *rest_of, "head", "rank", "ring")
    ends = walked.where("open and last")
    rest = rounds.keep(ends.select("img", "node", F.col("before").alias("to"), (F.col("off") + 1).alias("hops"), "head", "rank"))
    if rest.isEmpty():
        return whole
    known = rounds.keep(walked.where("not open and last").select("img", "node", "head", "rank", F.lit(False).alias("ring")))
    parts = [known]
    while not rest.isEmpty():
        far = [F.col("img"), F.col("node").alias("to"), F.col("head").alias("far_head"), F.col("rank").alias("far_rank")]
        told = known.select(*far, F.lit(None).cast("bigint").alias("next"), F.lit(0).cast("bigint").alias("more"), F.lit(True).alias("found"))
        going = rest.select(*far, F.col("to").alias("next"), F.col("hops").alias("more"), F.lit(False).alias("found"))
        met = rest.join(told.unionAll(going), ["img", "to"])
        better = F.coalesce(F.col("far_head") < F.col("head"), F.col("head").isNull() & F.col("far_head").isNotNull())
        takes = F.col("found") | better
        after = rounds.keep(met.select(
            "img", "node", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.when(takes, F.col("far_head")).otherwise(F.col("head")).alias("head"),
            F.when(takes, F.col("hops") + F.col("far_rank")).otherwise(F.col("rank")).alias("rank"), "found", (F.col("found") | better).alias("changed"),
        ))
        parts.append(after.where("found").select("img", "node", "head", "rank", F.lit(False).alias("ring")))
        known = _all(parts)
        rest = after.where("not found").select("img", "node", "to", "hops", "head", "rank")
        if after.where("changed").isEmpty():
            break
    settled = known.unionAll(rest.select("img", "node", "head", "rank", F.lit(True).alias("ring")))
    # what the node before a segment knows gives its nodes' ranks, unless the ring's least key lies between
    bases = ends.select("img", "root", "before").join(settled.select("img", F.col("node").alias("before"), F.col("head").alias("end_head"), (F.col("rank") + 1).alias("base"), F.col("ring").alias("round")), ["img", "before"]).drop("before")
    since = F.when((F.col("head") == F.col("end_head")) & F.col("round") & (F.col("off") >= F.col("hold")), F.col("off") - F.col("hold")).otherwise(F.col("base") + F.col("off"))
    between = walked.where("open").join(rounds.keep(bases), ["img", "root"])
    return whole.unionAll(between.select("img", "node", *rest_of, F.col("end_head").alias("head"), since.alias("rank"), F.col("round").alias("ring")))


def tile_of(x: Column, y: Column) -> Column:
    """The tile, as one number, that a place lies in."""
    return F.floor(y / TILE) * F.lit(1 << 24) + F.floor(x / TILE)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def directed_chains(darts: DataFrame, rounds: Rounds) -> DataFrame:
    """darts(img, node, twin, prev, key, tile, ...) that make up each chain once, with its id and their seq.

    A chain can be walked from both ends (a dart and its twin are one edge): the walk whose head is smaller stays.
    ids count an image's chains from 0 by head, so rings come last where their keys are larger.
    """
    return named_chains(rank_chains(rounds.keep(darts), rounds).withColumn("mine", F.lit(None).cast("boolean")), rounds)


def named_chains(ranked: DataFrame, rounds: Rounds) -> DataFrame:
    """directed_chains of ranked darts, of which ``mine`` says that they stay; null where that is to be found."""
    placed = ranked.drop("ring")
    edge = Window.partitionBy("img", F.least("node", "twin"))
    asked = placed.where("mine is null").withColumn("mine", F.col("head").isNotNull() & (F.col("head") == F.min("head").over(edge)))
    kept = rounds.keep(placed.where("mine").unionAll(asked.where("mine")).drop("mine"))
    heads = kept.where("rank = 0").select("img", "head", (F.row_number().over(Window.partitionBy("img").orderBy("head")).cast("int") - 1).alias("id"))
    return kept.join(heads, ["img", "head"]).withColumn("seq", F.col("rank").cast("int")).drop("head", "rank", "node", "twin")
