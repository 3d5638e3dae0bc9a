"""Document quality from a linear-chain conditional random field over lines.

Each line has features of its own (letter case, symbols, digits, words that end in symbols, word
lengths, repetition inside the document) and those of the lines before and after it.  The chain
labels every line good or bad and forward-backward gives each line's marginal; the mean marginal of
"good", weighted by line length, is a document's quality, which a logistic curve fitted on the same
examples turns into the probability of the label good.

Labels are of documents, so lines are labelled by weak supervision: a good document's lines are good; a
bad document has at least one bad line, and which of its lines are bad is settled by alternation.  First
lines are told apart by their own features alone, with all lines of bad documents bad, so that a line
that good documents have as well is not held bad for its company; then the whole chain is fitted.  After
each of the ``TURNS`` fits, lines of bad documents with a marginal over ``SURE`` become good, except the
worst line of each.  Fitting maximises the L2-penalised conditional likelihood (Adam on the exact gradient).

Bounds: at most ``EXAMPLES`` labelled documents a class (the smallest hashes of the doc_id) with at most
``LINES`` lines a class, whole texts of these; examples weigh as their class does among all labelled
rows.  Every document is scored over its whole text.  The model is a few dozen numbers.

Defined cases: null and empty texts are one empty line; lines without characters weigh nothing unless
all are so; without labelled documents of both classes the score is the rate of good labels (0.5
without labels); null ids and labels teach nothing; rows that repeat a doc_id each get a row, and one of
them teaches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace
from .words import Words, gram_places, grams, mix64, slices

EXAMPLES, LINES, STEPS, RATE, PENALTY = 750, 100_000, 150, 0.1, 1e-3
SURE, TURNS = 0.5, 3
OWN = 11
_KIND = np.full(256, 4, np.uint8)  # 0 white space, 1 upper, 2 other letters, 3 digits, 4 symbols
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91], _KIND[97:123], _KIND[128:256], _KIND[48:58] = 1, 2, 2, 3


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def line_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, bounds): lines x OWN features, line lengths, first line of each text."""
    feed = np.flatnonzero(words.buf == 10)
    text_of = np.searchsorted(words.offsets, feed, side="right") - 1
    per_text = np.bincount(text_of, minlength=words.n) + 1
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    begins = np.sort(np.concatenate([words.offsets[:-1], feed + 1]), kind="stable")
    # a text's own start and the byte behind another text's last feed can be the same place
    ends = np.zeros(len(begins), np.int64)
    ends[:-1] = begins[1:]
    ends[bounds[1:] - 1] = words.offsets[1:]
    kind = _KIND[words.buf]
    tally = []
    for k in (1, 2, 3, 4):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        tally.append((total[ends] - total[begins]).astype(float))
    upper, lower, digit, symbol = tally
    solid = upper + lower + digit + symbol
    first, last = np.searchsorted(words.start, begins), np.searchsorted(words.start, ends)
    n = (last - first).astype(float)

    def per_line(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[last] - total[first]

    tail = kind[words.end - 1] == 4 if len(words.end) else np.zeros(0, bool)
    marked = tail & (words.end - words.start > 2) & (kind[np.maximum(words.end - 2, 0)] == 4) if len(tail) else tail
    shout = (kind[words.start] == 1) & (words.end - words.start > 2) & (kind[np.minimum(words.start + 1, len(kind) - 1)] == 1) if len(tail) else tail
    seen = np.zeros(len(words.hash))
    places, owner = gram_places(words.first, 3)
    if len(places):
        key = grams(words.hash, 3)[places] ^ mix64(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        seen[places] = again
    line_of = np.repeat(np.arange(len(begins)), (last - first))
    key = mix64(words.hash ^ mix64(line_of.astype(np.uint64) + np.uint64(1)))
    distinct = np.zeros(len(key))
    if len(key):
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        distinct[order] = new
    x = np.stack([
        _ratio(upper, upper + lower), _ratio(symbol, solid), _ratio(digit, solid), _ratio(per_line(marked.astype(float)), n), _ratio(per_line(tail.astype(float)), n),
        _ratio(per_line(shout.astype(float)), n), np.minimum(_ratio(solid, n), 30) / 10, np.log1p(n) / 5, _ratio(per_line(seen), n), _ratio(per_line(distinct), n), (n == 0).astype(float),
    ], axis=1)
    return x, solid, bounds


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bias, each line's own features and those of its neighbours in the same text (else zeros)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    edge = np.zeros((len(x), 2))
    edge[bounds[:-1], 0] = 1
    edge[bounds[1:] - 1, 1] = 1
    return np.concatenate([np.ones((len(x), 1)), x, before, after, edge], axis=1)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(score: np.ndarray, move: np.ndarray, bounds: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of label 1 per line, expected label pairs 2 x 2 weighted by text, log partition per text).

    score is the unary score of label 1 (label 0 has 0).  All texts advance together, line by line;
    those that have ended drop out.
    """
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    size, start = length[order], bounds[:-1][order]
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t lines
    unary = np.stack([np.zeros(len(score)), score], axis=1)
    for t in range(longest):
        at = start[: alive[t]] + t
        alpha[at] = unary[at] if t == 0 else unary[at] + _log_sum(alpha[at - 1][:, :, None] + move[None], 1)
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        beta[at] = _log_sum(move[None] + (unary[at + 1] + beta[at + 1])[:, None, :], 2)
    total = _log_sum(alpha[bounds[1:] - 1], 1)
    per_line = np.repeat(total, length)
    good = np.exp(alpha[:, 1] + beta[:, 1] - per_line)
    inner = np.ones(len(score), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    each = np.exp(alpha[at - 1][:, :, None] + move[None] + (unary[at] + beta[at])[:, None, :] - per_line[at][:, None, None])
    pairs = each.sum(axis=0) if weight is None else np.tensordot(np.repeat(weight, length)[at], each, 1)
    return good, pairs, total


class LineField:
    def __init__(self, width: int):
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w, self.move = np.zeros(width), np.zeros((2, 2))

    def fit(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> LineField:
        """Fit to documents with labels and weights; size is each line's length."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.mean[0], self.scale[self.scale < 1e-9] = 0.0, 1.0
        unit, weight = (x - self.mean) / self.scale, weight / weight.mean()
        bad = np.repeat(labels == 0, np.diff(bounds))
        y = 1.0 - bad
        own = np.arange(len(self.w) + 4) <= OWN
        for turn in range(TURNS):
            self._ascend(unit, y, bounds, weight, STEPS if turn < 2 else STEPS // 3, own if turn == 0 else np.ones(len(own), bool))
            good, _, _ = forward_backward(unit @ self.w, self.move, bounds)
            worst = good <= np.repeat(np.minimum.reduceat(good, bounds[:-1]), np.diff(bounds))
            y = np.where(bad & ((good <= SURE) | worst), 0.0, 1.0)
        self.lines = y
        self._calibrate(self._odds(x, size, bounds), labels, weight)
        return self

    def _ascend(self, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, weight: np.ndarray, steps: int, free: np.ndarray) -> None:
        """Raise the likelihood of the lines' labels y over the free parameters."""
        inner = np.ones(len(x), bool)
        inner[bounds[:-1]] = False
        at = np.flatnonzero(inner)
        each = np.repeat(weight, np.diff(bounds))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), each[at])
        theta = np.concatenate([self.w, self.move.ravel()])
        m, v = np.zeros(len(theta)), np.zeros(len(theta))
        for step in range(1, steps + 1):
            good, pairs, _ = forward_backward(x @ theta[:-4], theta[-4:].reshape(2, 2), bounds, weight)
            grad = np.concatenate([x.T @ (each * (y - good)), (seen - pairs).ravel()]) / len(weight) - PENALTY * theta
            grad[~free] = 0
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.move = theta[:-4], theta[-4:].reshape(2, 2)

    def _calibrate(self, odds: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """The logistic curve over the log odds of the mean marginals, by Newton steps with a small penalty."""
        z, self.curve = np.stack([odds, np.ones(len(odds))], axis=1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))
            grad = z.T @ (weight * (labels - p)) - 1e-2 * self.curve
            self.curve = self.curve + np.clip(np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad), -2, 2)

    def _odds(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each document."""
        good, _, _ = forward_backward(((x - self.mean) / self.scale) @ self.w, self.move, bounds)
        empty = np.add.reduceat(size, bounds[:-1]) == 0
        size = size + np.repeat(empty, np.diff(bounds))
        mean = np.clip(np.add.reduceat(good * size, bounds[:-1]) / np.add.reduceat(size, bounds[:-1]), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, x: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._odds(x, size, bounds) * self.curve[0] + self.curve[1], -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, size, bounds = line_features(Words(part.column("text")))
            packed = [np.column_stack([x[a:b], size[a:b]]).astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "lines": pa.array(np.diff(bounds)), "x": pa.array(packed, pa.binary())})


def _score(field: LineField | None, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if field is None:
                    score = np.full(part.num_rows, rate)
                else:
                    x, weights, bounds = line_features(Words(part.column("text")))
                    score = np.clip(field.score(with_neighbours(x, bounds), weights, bounds), 0, 1)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score)})

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for every row of docs(doc_id, text), learnt from labels(doc_id, label) of these documents,
    label 1 for good and 0 for bad."""
    work = Workspace(docs.sparkSession, "quality")
    taught = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    totals = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    rate = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    field = None
    if len(totals) == 2:
        order = F.xxhash64("doc_id", F.lit(3))
        once = taught.dropDuplicates(["doc_id"])
        picks = [once.where(F.col("label") == y).orderBy(order, "doc_id").limit(EXAMPLES) for y in (0, 1)]
        few = work.keep(picks[0].unionAll(picks[1]), "picked")
        found = work.keep(rows.join(few, "doc_id").mapInArrow(_features, "doc_id long, label int, lines long, x binary").dropDuplicates(["doc_id"]), "features")
        so_far = F.sum("lines").over(Window.partitionBy("label").orderBy(order, "doc_id"))  # at most EXAMPLES rows a label
        sample = found.where(F.col("lines") <= LINES).withColumn("so_far", so_far).where(F.col("so_far") <= LINES).orderBy("doc_id").select("label", "x").collect()
        labels_of = np.array([r["label"] for r in sample])
        if len(set(labels_of.tolist())) == 2:
            lines = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, OWN + 1).astype(float) for r in sample]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
            both = np.concatenate(lines)
            x = with_neighbours(both[:, :OWN], bounds)
            weight = np.array([totals[y] / (labels_of == y).sum() for y in labels_of.tolist()])
            field = LineField(x.shape[1]).fit(x, both[:, OWN], bounds, labels_of, weight)
    return rows.mapInArrow(_score(field, rate), "doc_id long, score double")
