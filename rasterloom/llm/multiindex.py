"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one for each half of the vector, span a grid of cells.  A vector a reaches cell (i, j)
at cost m_i^2 + m_j^2, where m_i is how far a's half must move to come as near to centroid i as to
its own.  Cells are visited in rising cost until the cost that reaches the target recall; that cost
is measured on sampled vectors and random neighbours of theirs at exactly the threshold, which are
the hardest to find.  Candidates in visited cells are verified by cosine in doubles.

Vectors of each length have codebooks of their own, fitted on at most ``SAMPLE`` vectors and
``SAMPLE_BYTES``; every vector is indexed.  Equal vectors are one class.  Visits are dealt by length and
first-half centroid, in chunks of residents and of visitors, so a hot cell spreads over many tasks.  A
task compares ``STEP`` visitors with ``STEP`` residents at once and returns the number of links each
vector gained and a spanning forest of the links instead of all pairs; a link that only one side's
traversal would find is counted for both.

Defined cases: null, empty and zero vectors and vectors with a null or non-finite component link
with nothing (n_links 0, their own component); vectors of different lengths are not compared; a null
vec_id is returned with component_id null and kept true; repeated rows of one vec_id with equal vectors
are one vector, and with different vectors each is linked by itself; an empty table gives an empty
result; other columns are ignored.
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

SAMPLE, SAMPLE_BYTES, PER_CELL, RESIDENTS, VISITORS, STEP = 20_000, 64 << 20, 16, 4096, 8192, 1024
RECALL = 0.9995


def _unit(raw: np.ndarray) -> np.ndarray:
    top = np.abs(raw).max(axis=1, keepdims=True)
    scaled = raw / np.where(top > 0, top, 1)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _squares(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)


class Codebooks:
    def __init__(self, sample: np.ndarray, size: int, threshold: float, recall: float, rounds: int = 8):
        rng = np.random.Generator(np.random.PCG64(11))
        self.half = max(1, sample.shape[1] // 2)
        self.books = [self._fit(part, size, rounds, rng) for part in self.split(sample)]
        self.gaps = [np.sqrt(np.maximum(_squares(c, c), 0)) + 1e-12 for c in self.books]
        pick = sample[rng.integers(0, len(sample), 4000)]
        noise = rng.normal(size=pick.shape)
        noise -= (noise * pick).sum(axis=1, keepdims=True) * pick
        noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-12)
        near = threshold * pick + np.sqrt(1 - threshold**2) * noise
        there = self.cells(near)
        self.limit = float(np.quantile(self.cost(pick, *there), recall))

    def split(self, v: np.ndarray) -> list[np.ndarray]:
        return [v[:, : self.half], v[:, self.half :] if v.shape[1] > 1 else v[:, :1] * 0]

    @staticmethod
    def _fit(part: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
        book = part[rng.choice(len(part), min(size, len(part)), replace=False)].copy()
        for _ in range(rounds):
            at = _squares(part, book).argmin(axis=1)
            total = np.zeros_like(book)
            np.add.at(total, at, part)
            n = np.bincount(at, minlength=len(book))
            book[n > 0] = total[n > 0] / n[n > 0, None]
        return book

    def moves(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half (own centroid, squared distance to move for every centroid)."""
        out = []
        for part, book, gap in zip(self.split(v), self.books, self.gaps, strict=True):
            d = _squares(part, book)
            own = d.argmin(axis=1)
            m = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * gap[own])
            out.append((own, m * m))
        return out

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (i, _), (j, _) = self.moves(v)
        return i, j

    def cost(self, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (_, a), (_, b) = self.moves(v)
        at = np.arange(len(v))
        return a[at, i] + b[at, j]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, all of one length at once."""
    for batch in batches:
        lists = batch.column("v")
        ends = np.asarray(lists.offsets)
        flat, size = np.asarray(lists.values, np.float64), np.diff(ends)
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            unit = _unit(flat[ends[rows][:, None] + np.arange(d)])
            at = pa.array(rows)
            yield pa.record_batch({"d": pa.array(np.full(len(rows), d, np.int32)), "id": batch.column("id").take(at), "n": batch.column("n").take(at), "u": pa.array([u.tobytes() for u in unit], pa.binary())})


_VISIT = "d int, i int, home boolean, j int, js array<int>, id long, n long, u binary"


def _visits(books: dict[int, Codebooks]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in np.unique(np.asarray(batch.column("d"))):
                own_length = batch.filter(pa.array(np.asarray(batch.column("d")) == d))
                for low in range(0, own_length.num_rows, 512):
                    yield visits(own_length.slice(low, 512), int(d))

    def visits(part: pa.RecordBatch, d: int) -> pa.RecordBatch:
        book = books[d]
        (own, a), (own_j, b) = book.moves(_vectors(part.column("u"), d))
        order = np.argsort(b, axis=1)
        rising = np.take_along_axis(b, order, axis=1)
        rows = [], [], [], []
        for r in range(part.num_rows):
            for i in np.flatnonzero(a[r] <= book.limit):
                last = int(np.searchsorted(rising[r], book.limit - a[r, i], side="right"))
                if last or i == own[r]:
                    for box, value in zip(rows, (r, int(i), bool(i == own[r]), order[r, :last].tolist()), strict=True):
                        box.append(value)
        at = pa.array(rows[0], pa.int64())
        taken = {c: part.column(c).take(at) for c in ("d", "id", "n", "u")}
        return pa.record_batch({"d": taken["d"], "i": pa.array(rows[1], pa.int32()), "home": pa.array(rows[2], pa.bool_()), "j": pa.array(own_j.astype(np.int32)).take(at), "js": pa.array(rows[3], pa.list_(pa.int32())), "id": taken["id"], "n": taken["n"], "u": taken["u"]})

    return run


class Forest:
    """What links connect, with one link for each join of two trees."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.edges: list[np.ndarray] = []

    def add(self, x: int, others: np.ndarray) -> None:
        """Link x with others."""
        root = self.root[others]
        new, first = np.unique(root, return_index=True)
        first, new = first[new != self.root[x]], new[new != self.root[x]]
        if len(new):
            self.edges.append(np.stack([np.full(len(new), x), others[first]]))
            self.root[np.isin(self.root, new)] = self.root[x]

    def links(self) -> np.ndarray:
        return np.concatenate([np.zeros((2, 0), np.int64), *self.edges], axis=1)


def _compare(books: dict[int, Codebooks], threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim = table.column("d")[0].as_py()
        book = books[dim]
        resident = np.asarray(table.column("resident").combine_chunks().to_numpy(zero_copy_only=False), bool)
        ids, n, j = (table.column(c).to_numpy() for c in ("id", "n", "j"))
        vectors = _vectors(table.column("u").combine_chunks(), dim)
        same = np.unique(ids, return_inverse=True)[1]  # a vector can be here as a resident and as a visitor
        lists = table.column("js").combine_chunks()
        here, size = np.flatnonzero(resident), np.diff(np.asarray(lists.offsets))
        flat, asking = np.asarray(lists.flatten()), np.repeat(np.arange(len(ids)), size)
        keep = ~resident[asking]
        flat, asking = flat[keep], asking[keep]
        by = np.argsort(flat, kind="stable")
        flat, asking = flat[by], asking[by]
        here = here[np.argsort(j[here], kind="stable")]
        gained, forest = np.zeros(len(ids), np.int64), Forest(int(same.max()) + 1)
        for cell in np.unique(j[here]):
            residents = here[np.searchsorted(j[here], cell) : np.searchsorted(j[here], cell, side="right")]
            visitors = asking[np.searchsorted(flat, cell) : np.searchsorted(flat, cell, side="right")]
            for low in range(0, len(residents), STEP):
                r = residents[low : low + STEP]
                (_, to_i), (_, to_j) = book.moves(vectors[r])
                for start in range(0, len(visitors), STEP):
                    a = visitors[start : start + STEP]
                    hit = (vectors[a] @ vectors[r].T >= threshold) & (ids[a][:, None] != ids[r][None, :])
                    linked = np.flatnonzero(hit.any(axis=1))
                    if not len(linked):
                        continue
                    a, hit = a[linked], hit[linked]
                    gained[a] += hit @ n[r]
                    i_a, j_a = book.cells(vectors[a])
                    missed = hit & ((to_i[:, i_a] + to_j[:, j_a]).T > book.limit)
                    gained[r] += n[a] @ missed
                    for x, row in zip(same[a].tolist(), hit, strict=True):
                        forest.add(x, same[r[row]])
        links, name = forest.links(), np.zeros(int(same.max()) + 1, np.int64)
        name[same] = ids
        got = np.flatnonzero(gained)
        return pa.table({
            "id": pa.array(np.concatenate([ids[got], name[links[0]]])), "gained": pa.array(np.concatenate([gained[got], np.zeros(links.shape[1], np.int64)])),
            "other": pa.array([None] * len(got) + name[links[1]].tolist(), pa.int64()),
        })

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding)."""
    work = Workspace(vectors.sparkSession, "multiindex")
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
    classes = work.keep(rows.where("v is not null").distinct().groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    packed = work.keep(classes.mapInArrow(_pack, "d int, id long, n long, u binary"), "unit")
    books: dict[int, Codebooks] = {}
    for r in packed.groupBy("d").count().orderBy("d").collect():
        dim, total = r["d"], r["count"]
        some = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = packed.where(F.col("d") == dim).select("id", "u").orderBy(F.xxhash64("id"), "id").limit(some).toArrow()
        size = int(np.clip(round(np.sqrt(total / PER_CELL)), 1, 4096))
        books[dim] = Codebooks(_vectors(sample.column("u").combine_chunks(), dim), size, threshold, recall)
    visits = work.keep(packed.mapInArrow(_visits(books), _VISIT), "visits")
    load = visits.groupBy("d", "i").agg(F.ceil(F.count(F.when(F.col("home"), 1)) / RESIDENTS).cast("int").alias("rs"), F.ceil(F.count("*") / VISITORS).cast("int").alias("qs"), F.count("*").alias("rows"))
    dealt = join_by_weight(visits, load, ["d", "i"], "rows", weight_limit(visits.count()))
    one, every = (lambda n: F.array(F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int"))), (lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    columns = ["d", "i", "r", "q", "resident", "j", "js", "id", "n", "u"]
    residents = dealt.where("home").withColumn("resident", F.lit(True)).withColumn("js", F.array().cast("array<int>")).withColumn("r", F.explode(one(F.col("rs")))).withColumn("q", F.explode(every(F.col("qs")))).select(columns)
    askers = dealt.where(F.size("js") > 0).withColumn("resident", F.lit(False)).withColumn("r", F.explode(every(F.col("rs")))).withColumn("q", F.explode(one(F.col("qs")))).select(columns)
    out = work.keep(residents.unionAll(askers).groupBy("d", "i", "r", "q").applyInArrow(_compare(books, threshold), "id long, gained long, other long"), "found")
    found = connected_components(work, out.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = classes.select("id", F.lit(0).cast("long").alias("gained")).unionAll(out.where("other is null").select("id", "gained")).groupBy("id").agg(F.sum("gained").alias("gained"))
    named = classes.join(links, "id").join(found, "id", "left").select("v", "n", (F.col("n") - 1 + F.col("gained")).alias("links"), F.coalesce("component", "id").alias("component"))
    # copies of one vector are one key: heavy ones are joined where they lie
    own = join_by_weight(rows.where("v is not null"), named, ["v"], "n", weight_limit(rows.count())).select("vec_id", "links", "component")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return own.unionAll(alone).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
