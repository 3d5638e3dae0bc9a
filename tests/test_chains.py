"""Chains walked tile by tile against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import chains, outline, vector
from rasterloom.workspace import Rounds


def plain(nodes):
    """{node: (head, rank, ring)} of {node: (prev, key)}."""
    out = {}
    for n in nodes:
        walk, at = [n], nodes[n][0]
        while at is not None and at != n:
            walk.append(at)
            at = nodes[at][0]
        if at is None:
            out[n] = nodes[walk[-1]][1], len(walk) - 1, False
        else:
            keys = [(nodes[w][1], k) for k, w in enumerate(walk) if nodes[w][1] is not None]
            out[n] = (*min(keys), True)
    return out


@pytest.mark.parametrize("tiles", [1, 2, 40])
def test_ranks_equal_plain_walks(spark, tiles):
    rng = random.Random(tiles)
    rows, want = [], {}
    for img in range(3):
        names = rng.sample(range(10_000), 700)
        keys = rng.sample(range(10_000), 700)
        nodes, at = {}, 0
        while at < len(names):
            size = min(rng.choice([1, 2, 5, 60, 250]), len(names) - at)
            ring = rng.random() < 0.5
            for k in range(size):
                first = at + size - 1 if ring else None
                nodes[names[at + k]] = (names[at + k - 1] if k else None if first is None else names[first]), keys[at + k] if k == 0 or rng.random() < 0.6 else None
            at += size
        near = {n: k * tiles // len(names) if rng.random() < 0.9 else rng.randrange(tiles) for k, n in enumerate(names)}
        rows += [(img, n, prev, key, near[n], f"said {n}") for n, (prev, key) in nodes.items()]
        want |= {(img, n): v for n, v in plain(nodes).items()}
    links = spark.createDataFrame(rows, "img int, node long, prev long, key long, tile long, said string")
    got = chains.rank_chains(links, Rounds(spark, "chains")).collect()
    assert {(r["img"], r["node"]): (r["head"], r["rank"], r["ring"]) for r in got} == want and len(got) == len(rows)
    assert all(r["said"] == f"said {r['node']}" for r in got)


def test_chains_of_one_tile_need_no_rounds(spark):
    """A list of a thousand nodes: ten rounds of tables if every node goes through them."""
    rounds = Rounds(spark, "chains")
    n = F.col("id")
    links = spark.range(1000).select(F.lit(0).alias("img"), n.alias("node"), F.when(n > 0, n - 1).alias("prev"), n.alias("key"), F.lit(0).cast("long").alias("tile"))
    assert [r["rank"] for r in chains.rank_chains(links, rounds).orderBy("node").collect()] == list(range(1000))
    assert rounds.n <= 3


@pytest.mark.parametrize("side", [5, 16])
def test_arcs_and_rings_are_the_same_in_small_tiles(spark, monkeypatch, side):
    """Darts are made and walked inside tiles; how large these are changes nothing."""
    noise = "cast(xxhash64(id) % 3 as int)"  # from -2 to 2
    pixels = spark.range(2 * 900).selectExpr("cast(id div 900 as int) as img", "cast(id % 30 as int) as x", "cast(id % 900 div 30 as int) as y", f"case when id % 13 > 0 then abs({noise}) when id % 2 = 0 then 2 end as comp")
    whole = sorted(map(tuple, outline.trace_arcs(pixels).collect()))
    rings = sorted(map(tuple, outline.assemble_rings(outline.trace_arcs(pixels)).collect()))
    assert len(whole) == vector.crack_edges(pixels).count()
    for module in (outline, chains):
        monkeypatch.setattr(module, "TILE", side)
    arcs = outline.trace_arcs(pixels)
    assert sorted(map(tuple, arcs.collect())) == whole
    assert sorted(map(tuple, outline.assemble_rings(arcs).collect())) == rings


def test_arcs_shuffle_pixels_and_not_darts(spark, monkeypatch):
    """One image without long arcs: pixels, walked darts and chains are all that is written (before: every round of doubling)."""
    made = []
    keep = Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df: (made.append(self.n), keep(self, df))[1])
    outline.trace_arcs(spark.range(900).selectExpr("0 as img", "cast(id % 30 as int) as x", "cast(id div 30 as int) as y", "cast(id * id * 7 % 11 % 3 as int) as comp")).count()
    assert len(made) <= 4
