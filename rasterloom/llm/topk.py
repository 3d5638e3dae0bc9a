"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are integer vectors floor(scale * x).  A block holds the forward index of a range of like
documents with the largest and smallest value of each component, its term maxima.  Ranges are cut by
halving at the median of the component that varies most, so that maxima stay near what the block
holds.  For a query the sum over components of value times maximum (minimum where the query's value is
negative) bounds every score in the block.  Blocks are taken in falling order of that bound, scored
through the forward index, until the bound falls below the query's kth score; a bound equal to it is
still scored, since a tie may have a smaller id.  How much that saves depends on the vectors: on
clustered ones most blocks are left out, on evenly spread directions hardly any (see the README).

Both sides are cut into chunks of bounded size and each (query chunk, block chunk) pair is a task's
group: work is queries x vectors, no side is broadcast, and each pair returns at most k rows a query.

Defined cases: null vectors and vectors with a null or non-finite component take no part; an empty
vector scores 0; a shorter vector counts as padded with zeros; null ids take no part; equal scores
go to the smaller vec_id; repeated candidate ids are scored as separate rows, a query id that repeats
asks with its smallest vector, and a query never meets rows of its own id; scores beyond the range of a
long saturate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, CHUNK, QUERIES = 128, 8192, 1024
_LONG = 2**63 - 1


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of usable vectors; saturating at long."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of whole numbers as rows, padded with zeros."""
    lists = column.combine_chunks()
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values, np.int64)
    size = np.diff(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat[ends[0] : ends[-1]]
    return out


def _alike(values: np.ndarray) -> list[np.ndarray]:
    """Rows cut in halves at the median of the component that varies most, until they fit a block."""
    done, todo = [], [np.arange(len(values))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        part = values[rows].astype(np.float64)
        order = rows[np.argsort(part[:, part.var(axis=0).argmax()] if part.shape[1] else np.zeros(len(rows)), kind="stable")]
        half = -(-len(rows) // (2 * BLOCK)) * BLOCK
        todo += [order[:half], order[half:]]
    return done


class Blocks:
    """Ranges of at most ``BLOCK`` like documents with their term maxima."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        ranges = _alike(values)
        order = np.concatenate(ranges)
        self.ids, self.values = ids[order], values[order]
        self.edges = np.cumsum([0, *map(len, ranges)])
        self.high = np.maximum.reduceat(self.values, self.edges[:-1], axis=0)
        self.low = np.minimum.reduceat(self.values, self.edges[:-1], axis=0)
        self.scored = 0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of other documents, ties to the smaller id."""
        bound = np.maximum(query * self.high, query * self.low).sum(axis=1)
        order = np.argsort(-bound, kind="stable")
        scores, ids = np.zeros(0, self.values.dtype), np.zeros(0, np.int64)
        for b in order:
            if len(scores) == k and bound[b] < scores[-1]:
                break
            self.scored += 1
            at = slice(self.edges[b], self.edges[b + 1])
            s, who = self.values[at] @ query, self.ids[at]
            good = who != query_id
            if len(scores) == k:
                good &= s >= scores[-1]
            if good.any():
                scores, ids = np.concatenate([scores, s[good]]), np.concatenate([ids, who[good]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
        return scores, ids


def _search(k: int):
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        q, d = _matrix(queries.column("v")), _matrix(docs.column("v"))
        out = [np.zeros(0, np.int64)] * 3
        if len(q) and len(d):
            width = max(q.shape[1], d.shape[1])
            q, d = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, d))
            if float(np.abs(q).astype(float).max(initial=0)) * float(np.abs(d).astype(float).max(initial=0)) * width < 2**52:
                q, d = q.astype(np.float64), d.astype(np.float64)  # exact in doubles
            else:
                q, d = q.astype(object), d.astype(object)
            blocks = Blocks(np.asarray(docs.column("vec_id")), d)
            found = [(i, *blocks.search(i, row, k)) for i, row in zip(np.asarray(queries.column("query_id")), q, strict=True)]
            scores = np.array([min(_LONG, max(-_LONG - 1, int(s))) for _, ss, _ in found for s in ss], np.int64)
            out = [np.repeat([i for i, _, _ in found], [len(s) for _, s, _ in found]).astype(np.int64), np.concatenate([x for _, _, x in found]), scores]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of vectors(vec_id, embedding) for each
    row that meets the SQL condition is_query."""
    rows = integer_vectors(vectors, scale)
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(F.expr(is_query), 1)).alias("q")).first()
    parts, turns = max(1, -(-counted["n"] // CHUNK)), max(1, -(-counted["q"] // QUERIES))
    dealt = F.floor(F.col("vec_id") / BLOCK)
    docs = rows.withColumn("part", F.pmod(F.xxhash64(dealt), parts).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asks = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = asks.groupBy("part", "turn").cogroup(docs.groupBy("part", "turn")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
