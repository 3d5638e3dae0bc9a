"""Toxicity from the nearest labelled examples.

A text's terms are its lower-cased words and the beginnings of longer words (``BEGINNINGS``).
Similarity is the TF-IDF cosine over all terms (tf 1 + ln n, document frequencies over all
documents, norms over the whole text; a term that no example holds counts in the norm as one seen in
no document).  A term that examples tie to toxicity weighs 1 + its log-likelihood ratio times as much;
no term is left out.  The ``NEIGHBOURS`` nearest examples vote with their squared cosine, and each
vote counts for the labelled rows its example stands for; the base rate has ``PRIOR`` of the nearest
neighbour's weight.  Texts that share no term with an example score the base rate.

The examples lie in a block-max index: per block of like examples the largest weight of each frequent
term; rare terms' postings are summed exactly first and join the bound.  Each text's blocks of the
highest bounds are scored first, then those whose bound reaches its kth neighbour.

Bounds: at most ``EXAMPLES`` examples a class (the smallest hashes of the doc_id) serve as neighbours
and for the ratios; that bounds what is broadcast.  Document frequencies and class rates count all rows.

Defined cases: null or empty texts have no terms; null ids and labels teach nothing; a score
goes by the text alone, so a labelled example votes for its own text as for any copy of it; rows that repeat a doc_id each get a row, and one of them is an example; equal
cosines go to the earlier example in the order of blocks; very long texts are read whole; without
labelled rows of both classes each score is the overall rate (0 without labels); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .words import Words, as_long, mix64, slices

EXAMPLES, NEIGHBOURS, BLOCK, COMMON, STRIP = 600, 15, 64, 1024, 2
#: Over the error of a sum of COMMON products in single precision.
SLACK = 1e-4
#: Beginnings of longer words, in bytes, that are terms too.
BEGINNINGS = (5,)
#: Strength of the base rate against the nearest vote.
PRIOR = 0.5


def terms(words: Words) -> list[np.ndarray]:
    """The term hashes of each word, one array a kind; 0 where there is none."""
    return [words.hash, *(np.where(p > 0, mix64(p), np.uint64(0)) for p in (words.prefix(k) for k in BEGINNINGS))]


class Counts:
    """The distinct terms of each text of a slice and how often each occurs: of text i, ``place`` and
    ``count`` between ends[i] and ends[i + 1], place by place of the sorted vocabulary; terms outside it
    are over its size."""

    def __init__(self, column: pa.Array, vocabulary: np.ndarray):
        words = Words(column, lower=True, letters=True)
        size, shift = len(vocabulary), np.int64(41)
        kinds, first, again = np.unique(words.hash, return_index=True, return_inverse=True)
        pair, times = np.unique(words.owner() * max(1, len(kinds)) + again, return_counts=True)
        text, kind = pair // max(1, len(kinds)), pair % max(1, len(kinds))
        one = copy(words)
        one.hash, one.start, one.end = kinds, words.start[first], words.end[first]
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h in terms(one):
            at = np.searchsorted(vocabulary, h)
            known = np.append(vocabulary, np.uint64(0))[at] == h
            entry = np.where(known & (at < size), at, size + 1 + (h >> np.uint64(25)).astype(np.int64))[kind]
            there = h[kind] != 0
            keys.append((entry + (text << shift))[there])
            counts.append(times[there])
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, self.count = key[new], np.add.reduceat(count, new) if len(new) else count
        self.ends = np.searchsorted(key, np.arange(words.n + 1) << shift)
        self.place = key & ((np.int64(1) << shift) - 1)
        self.known = self.place < size


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), lower=True, letters=True)
            found, owner = [], []
            all_terms = np.stack(terms(words), axis=1) if len(words.hash) else np.zeros((0, 1 + len(BEGINNINGS)), np.uint64)
            for i in range(part.num_rows):
                own = np.unique(all_terms[words.first[i] : words.first[i + 1]])
                own = own[own != 0]
                found.append(own)
                owner.append(np.full(len(own), i))
            index = pa.array(np.concatenate(owner).astype(np.int64))
            yield pa.record_batch({"term": as_long(np.concatenate(found).astype(np.uint64)), "label": part.column("label").take(index)})


def _frequencies(vocabulary: np.ndarray):
    """One row a task and term: in how many of the task's texts the term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch):
                counts = Counts(part.column("text"), vocabulary)
                seen += np.bincount(counts.place[counts.known], minlength=len(vocabulary))
        at = np.flatnonzero(seen)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.record_batch({"t": pa.array(part.astype(np.int32)), "n": pa.array(seen[part])})

    return run


def _term_counts(vocabulary: np.ndarray):
    """Counts of the vocabulary's terms in each text (sorted uint64 vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                counts = Counts(part.column("text"), vocabulary)
                ends = np.append(0, np.cumsum(counts.known))[counts.ends].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[counts.known].astype(np.int32))) for x in (counts.place, counts.count)]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "terms": lists[0], "counts": lists[1]})

    return run


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """How strongly each term, in a of n0 and b of n1 examples, is tied to label 1; 0 where it is not."""

    def part(x: np.ndarray, row: np.ndarray, col: int) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1) * (n0 + n1) / np.maximum(row * col, 1)), 0.0)

    seen, rest = a + b, n0 + n1 - a - b
    g = 2 * (part(a, seen, n0) + part(b, seen, n1) + part(n0 - a, rest, n0) + part(n1 - b, rest, n1))
    return np.where(b * n0 > a * n1, np.maximum(g, 0.0), 0.0)


class BlockMaxIndex:
    """Unit vectors of examples by blocks, with each block's largest weight of each frequent term.

    Terms that few examples hold lie in postings, which are added up first; the ``COMMON`` most frequent
    terms lie in a matrix, of which a block is read only for texts that its bound lets in.
    """

    def __init__(self, rows: list[tuple[int, int, Any, Any]], weight: np.ndarray, stands_for: tuple[float, float]):
        rows = sorted(rows, key=lambda r: r[0])
        self.weight = weight
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[1] for r in rows], np.int64)
        self.mass = np.array([stands_for[r[1]] for r in rows], float)
        vectors = [self.vector(r[2], r[3]) for r in rows]
        term = np.concatenate([np.zeros(0, np.int64), *[v[0] for v in vectors]])
        order = self._alike(term, np.concatenate([np.zeros(0), *[v[1] for v in vectors]]), np.array([len(v[0]) for v in vectors], np.int64))
        self.ids, self.labels, self.mass, vectors = self.ids[order], self.labels[order], self.mass[order], [vectors[i] for i in order]
        term = np.concatenate([np.zeros(0, np.int64), *[v[0] for v in vectors]])
        who = np.repeat(np.arange(len(rows), dtype=np.int64), [len(v[0]) for v in vectors])
        by = np.argsort(term, kind="stable")
        self.who, self.x = who[by].astype(np.int32), np.concatenate([np.zeros(0), *[v[1] for v in vectors]])[by]
        self.first = np.searchsorted(term[by], np.arange(len(weight) + 1))
        self.common = np.argsort(-np.diff(self.first), kind="stable")[:COMMON]
        self._ready = False

    @staticmethod
    def _alike(term: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """An order of the examples in which each block holds the first example left and its nearest."""
        common = np.full(int(term.max(initial=-1)) + 1, -1)
        top = np.argsort(-np.bincount(term), kind="stable")[:COMMON] if len(term) else np.zeros(0, np.int64)
        common[top] = np.arange(len(top))
        dense = np.zeros((len(size), len(top)), np.float32)
        column, row = common[term], np.repeat(np.arange(len(size)), size)
        dense[row[column >= 0], column[column >= 0]] = x[column >= 0]
        left, out = np.arange(len(size)), []
        while len(left):
            near = np.argsort(-(dense[left] @ dense[left[0]]), kind="stable")
            near = np.append(0, near[near != 0])[:BLOCK]
            out.append(left[near])
            left = np.delete(left, near)
        return np.concatenate([np.zeros(0, np.int64), *out])

    def vector(self, at: Any, n: Any, beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length one with the squares of terms that no example holds."""
        at, n = np.asarray(at, np.int64), np.asarray(n, float)
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / max(1e-300, float(np.sqrt((w * w).sum() + beyond)))

    def _prepare(self) -> None:
        """The matrix and the blocks' maxima, built where they are used."""
        self.column = np.full(len(self.weight), -1)
        self.column[self.common] = np.arange(len(self.common))
        self.matrix = np.zeros((len(self.ids), len(self.common)))
        for c, t in enumerate(self.common):
            part = slice(self.first[t], self.first[t + 1])
            self.matrix[self.who[part], c] = self.x[part]
        self.edges = np.append(np.arange(0, len(self.ids), BLOCK), len(self.ids))
        self.peak = np.maximum.reduceat(self.matrix, self.edges[:-1], axis=0).astype(np.float32)
        self.single = self.matrix.astype(np.float32)
        self.scored = self.passed = 0
        self._ready = True

    def _rare(self, m: int, row: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What rare terms add to each (text, example), from their postings."""
        n = len(self.ids)
        rare = np.zeros((m, n))
        low, size = self.first[at], np.diff(self.first)[at]
        cuts = np.searchsorted(row, np.append(np.arange(0, m, STRIP), m))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):  # strips that stay in the cache
            entry = np.repeat(np.arange(a, b), size[a:b])
            shift = low[a:b] - np.cumsum(size[a:b]) + size[a:b]
            place = np.arange(len(entry)) + shift[entry - a]
            key = self.who[place] + ((row[a:b] - i * STRIP) * n)[entry - a]
            strip = rare[i * STRIP : (i + 1) * STRIP]
            strip += np.bincount(key, self.x[place] * w[entry], strip.size).reshape(strip.shape)
        return rare

    def search(self, m: int, row: np.ndarray, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest of each of m texts, given by entries (row, term, weight); cosines
        at nine decimals, ties to the earlier example; places left over are -1 and 0.

        Single precision, with ``SLACK`` for its error, decides what is looked at; what may be among the
        k nearest is computed again in doubles.
        """
        if not self._ready:
            self._prepare()
        n = len(self.ids)
        column = self.column[at]
        often = column >= 0
        frequent = np.zeros((m, len(self.common)))
        frequent[row[often], column[often]] = w[often]
        single = frequent.astype(np.float32)
        rare = self._rare(m, row[~often], at[~often], w[~often])
        bound = single @ self.peak.T + np.maximum.reduceat(rare, self.edges[:-1], axis=1) + SLACK
        score = np.full((m, n), -1, np.float32)

        def take(wanted: np.ndarray) -> np.ndarray:
            """Score the wanted (text, block)s; the kth scores so far."""
            for b in np.flatnonzero(wanted.any(axis=0)):
                some, part = np.flatnonzero(wanted[:, b]), slice(self.edges[b], self.edges[b + 1])
                found = single[some] @ self.single[part].T + rare[some, part].astype(np.float32)
                score[some, part] = found
                self.scored += len(some)
            return np.partition(score, n - k, axis=1)[:, n - k] if n >= k else np.full(m, -1, np.float32)

        blocks = bound.shape[1]
        best = np.zeros(bound.shape, bool)
        np.put_along_axis(best, np.argsort(-bound, axis=1, kind="stable")[:, : max(1, blocks // 8)], True, axis=1)
        best &= bound > SLACK
        kth = take(best)
        kth = take(~best & (bound > SLACK) & (bound >= kth[:, None]))
        self.passed += m * blocks
        text, example = np.nonzero((score >= kth[:, None] - 2 * SLACK) & (score > -1))
        exact = np.zeros(len(text))
        for low in range(0, len(text), 4096):
            t, e = text[low : low + 4096], example[low : low + 4096]
            exact[low : low + 4096] = np.round(np.einsum("ij,ij->i", frequent[t], self.matrix[e]) + rare[t, e], 9)
        order = np.lexsort((example, -exact, text))
        text, example, exact = text[order], example[order], exact[order]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        good = (place < k) & (exact > 0)
        who, cosine = np.full((m, k), -1), np.zeros((m, k))
        who[text[good], place[good]], cosine[text[good], place[good]] = example[good], exact[good]
        return who, cosine

    def nearest(self, at: Any, n: Any, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k nearest of one text."""
        at, w = self.vector(at, n)
        who, cosine = self.search(1, np.zeros(len(at), np.int64), at, w, k)
        return who[0][who[0] >= 0], cosine[0][who[0] >= 0]


def _score(index: BlockMaxIndex | None, vocabulary: np.ndarray, unseen: float, base: float, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                for part in slices(batch.slice(low, 256)):
                    yield scored(part)

    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        m = part.num_rows
        score, near, cosines = np.full(m, base), [[] for _ in range(m)], [[] for _ in range(m)]
        if index is not None:
            counts = Counts(part.column("text"), vocabulary)
            row = np.repeat(np.arange(m), np.diff(counts.ends))
            known = counts.known
            w = (1 + np.log(counts.count)) * np.where(known, index.weight[np.where(known, counts.place, 0)], unseen)
            w /= np.maximum(1e-300, np.sqrt(np.bincount(row, w * w, m)))[row]
            who, cosine = index.search(m, row[known], counts.place[known], w[known], NEIGHBOURS)
            vote = cosine**2 * index.mass[who]
            prior = PRIOR * index.mass.mean() * np.maximum(cosine[:, 0] ** 2, 1e-9)
            score = np.clip(((vote * index.labels[who]).sum(axis=1) + prior * base) / (vote.sum(axis=1) + prior), 0.0, 1.0)
            near = [index.ids[x[x >= 0]].tolist() for x in who[:, :3]]
            cosines = [c[x >= 0].tolist() for x, c in zip(who[:, :3], cosine[:, :3], strict=True)]
        carried = {c: part.column(c) for c in carry}
        return pa.record_batch(carried | {"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64()), "evidence": pa.array(near, pa.list_(pa.int64())), "cosines": pa.array(cosines, pa.list_(pa.float64()))})

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns of docs, doc_id, score, evidence (the nearest three examples' ids), cosines for
    every row of docs(doc_id, text, ...), learnt from labels(doc_id, label) of these documents, label 0 or 1."""
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    taught = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = sum(totals.values())
    base = totals.get(1, 0) / total if total else 0.0
    vocabulary, index, unseen = np.zeros(0, np.uint64), None, 1.0
    if len(totals) == 2:
        picks = [taught.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(EXAMPLES) for y in (0, 1)]
        picked = work.keep(picks[0].unionAll(picks[1]).dropDuplicates(["doc_id"]), "picked")
        chosen = work.keep(rows.join(picked, "doc_id").dropDuplicates(["doc_id"]), "examples")
        n = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
        n0, n1 = n.get(0, 0), n.get(1, 0)
        counts = chosen.repartition(24).mapInArrow(_distinct_terms, "term long, label int").groupBy("term").agg(F.sum(F.col("label").cast("long")).alias("b"), F.sum(1 - F.col("label").cast("long")).alias("a")).toArrow()
        term = np.asarray(counts.column("term")).view(np.uint64)
        order = np.argsort(term)
        vocabulary = term[order]
    if len(vocabulary):
        a, b = (np.asarray(counts.column(c), float)[order] for c in "ab")
        seen = rows.mapInArrow(_frequencies(vocabulary), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(vocabulary))
        df[np.asarray(seen.column("t"))] = np.asarray(seen.column("n"))
        unseen = float(np.log(1 + rows.count()) + 1)
        weight = (unseen - np.log(1 + df)) * (1 + likelihood_ratio(a, b, n0, n1))
        vectors = chosen.repartition(24).mapInArrow(_term_counts(vocabulary), "doc_id long, label int, terms array<int>, counts array<int>").toArrow()
        stands = (totals[0] / max(1, n0), totals[1] / max(1, n1))
        flat = [[x.values.to_numpy() for x in vectors.column(c)] for c in ("terms", "counts")]
        examples = zip(vectors.column("doc_id").to_pylist(), vectors.column("label").to_pylist(), *flat, strict=True)
        index = BlockMaxIndex([e for e in examples if len(e[2])], weight, stands)
    carried = docs.select(*[c for c in carry if c not in ("doc_id", "text")], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "".join(f"`{c}` {carried.schema[c].dataType.simpleString()}, " for c in carry)
    return carried.mapInArrow(_score(index, vocabulary, unseen, base, carry), f"{kinds}doc_id long, score double, evidence array<long>, cosines array<double>")
