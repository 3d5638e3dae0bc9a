"""Periodic runs of words by power-of-two names (Karp, Miller and Rosenberg).

Every place of a text gets a name for the 2^k words from there on: level 0 names words, level k + 1 names
pairs of level-k names 2^k apart, so equal names mean equal words, with no hash in between.  A place whose
name comes once in its text can begin no repetition; only the others are named on the next level.

For each period q the places 0, q, 2q, ... form a grid.  A stretch of period q and length 3q or more
holds two neighbouring cells of q words that are equal, which two names of level floor(log2 q) decide.
Equal cells that follow each other are one candidate: it is extended to both sides by the longest common
extension, descending through the levels.  The same stretch found for several periods keeps the least.

All of it runs on NumPy arrays over a slice of texts; grids are handled a bounded number of places at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

#: A run has at least this many words, and at least so many times its period.
SHORTEST, TIMES = 24, 3
#: Grid places compared at once.
GRID = 1 << 21

Rearrange = Callable[[int | None, int], "np.ndarray | None"]


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: the group of each member, and its number in the group."""
    who = np.repeat(np.arange(len(counts)), counts)
    return who, np.arange(len(who)) - (np.cumsum(counts) - counts)[who]


class Names:
    """The names of a slice's places, level by level; ``first`` is each text's first place (n + 1 entries)."""

    def __init__(self, word: np.ndarray, first: np.ndarray):
        self.first = first
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.deepest = np.full(len(first) - 1, -1)
        self.levels: list[np.ndarray] = []
        left = first[text + 1] - np.arange(len(word))  # words from a place to its text's end
        place, key, other = np.arange(len(word)), text, word.astype(np.int64)
        width = 1
        while len(place):
            name = self._name(place, key, other, len(word))
            self.levels.append(name)
            live = place[name[place] >= 0]
            self.deepest[text[live]] = len(self.levels) - 1
            # the next level: the place and the one 2^k on must both have names that repeat, inside a text
            # that is long enough for a period of 2^(k+1)
            size = np.diff(first)[text[live]]
            live = live[(left[live] >= 2 * width) & (size >= TIMES * 2 * width)]
            live = live[name[live + width] >= 0]
            place, key, other = live, name[live], name[live + width]
            width *= 2

    @staticmethod
    def _name(place: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Names that come again get numbers from 0, all other places numbers below 0 of their own."""
        name = -1 - np.arange(n)
        both = a.astype(np.int64) * (int(b.max()) + 1) + b  # a and b are below n, so this fits
        order = np.argsort(both, kind="stable")
        new = np.append(True, both[order[1:]] != both[order[:-1]])
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        again = size[number] > 1
        name[place[order[again]]] = number[again]
        return name

    def extend(self, a: np.ndarray, b: np.ndarray, level: np.ndarray, limit: np.ndarray, forwards: bool) -> np.ndarray:
        """How many words from a and b on (or before them, backwards) agree, at most limit."""
        same = np.zeros(len(a), np.int64)
        for k in range(int(level.max(initial=-1)), -1, -1):
            width = 1 << k
            for _ in range(2 if k == 0 else 1):
                may = np.flatnonzero((level >= k) & (same + width <= limit))
                shift = same[may] if forwards else -same[may] - width
                name = self.levels[k]
                equal = name[a[may] + shift] == name[b[may] + shift]
                same[may[equal]] += width
                if not equal.any():
                    break
        return same


def find_runs(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs as rows (text, start, length, period), by text, start and period; start counts from the text's first word.

    ``word`` holds a number for each word, equal for equal words, of one text after the other."""
    names = Names(word, first)
    size = np.diff(first)
    # a period q needs a level floor(log2 q) on which some name of the text comes again
    top = np.where(names.deepest >= 0, np.minimum(size // TIMES, 2 ** (names.deepest + 1) - 1), 0)
    text, q = _each(top)
    q = q + 1
    found = []
    cells = size[text] // q - 1  # cells m with m + 1 inside the text
    ends = np.cumsum(cells)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + GRID, "right")))
        found.append(_candidates(names, text[low:high], q[low:high], cells[low:high]))
        low = high
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))[: len(rows)]
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _candidates(names: Names, text: np.ndarray, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
    level = np.frexp(q.astype(float))[1] - 1
    out = []
    for k in np.unique(level).tolist():
        of = np.flatnonzero(level == k)
        name, width = names.levels[k], 1 << k
        which, m = _each(cells[of])
        row = of[which]
        at = names.first[text[row]] + m * q[row]
        alike = name[at] == name[at + q[row]]
        row, m, at = row[alike], m[alike], at[alike]
        tail = at + q[row] - width  # the cell's last 2^k words
        alike = name[tail] == name[tail + q[row]]
        row, m = row[alike], m[alike]
        if not len(row):
            continue
        fresh = np.append(True, (row[1:] != row[:-1]) | (m[1:] != m[:-1] + 1))
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(row) - 1)
        r, m0, m1 = row[fresh], m[fresh], m[last]
        base, period = names.first[text[r]], q[r]
        a, z = base + m0 * period, base + (m1 + 1) * period  # two equal cells begin at a; the last one begins at z
        deep = np.full(len(r), k)
        back = names.extend(a, a + period, deep, np.minimum(a - base, period - 1), False)
        ahead = names.extend(z, z + period, deep, np.minimum(names.first[text[r] + 1] - z - period, period - 1), True)
        start = a - back
        length = z + period + ahead - start
        keep = length >= np.maximum(SHORTEST, TIMES * period)
        out.append(np.stack([text[r], start - base, length, period], 1)[keep])
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) of the greatest exponent; ties: least start, then least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


RUN = "struct<start:long,length:long,period:long>"


def periodic_runs(docs: DataFrame, rearrange: Rearrange | None = None) -> DataFrame:
    """doc_id, n_words, runs, best and collapsed for every row of docs(doc_id, text).

    Words are runs of bytes outside space and 0x09-0x0D.  A run is a stretch of words with least period q
    (words q apart are equal), of at least 24 words and 3q, that no neighbouring word extends; ``runs`` has all of
    them by start and period, ``best`` that with the greatest length/period (ties: least start, then period; null
    without runs).  ``collapsed`` is the words that are left, joined by a space, when of each run only its first q
    words stay.  ``rearrange(doc_id, n)`` may give for a text of n words the word that stands at each place.

    A null text has no words, as an empty one; a null doc_id is carried along; repeated rows give repeated
    results; texts of any length are handled whole (memory goes with the longest); an empty table gives no row;
    other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                texts = [t.split() for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                if rearrange is not None:
                    for k, (i, w) in enumerate(zip(ids, texts, strict=True)):
                        source = rearrange(i, len(w))
                        if source is not None:
                            texts[k] = [w[s] for s in source.tolist()]
                first = np.cumsum([0, *map(len, texts)])
                word = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy()
                rows = find_runs(word, first)
                cut = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).tolist()
                runs: list[list[tuple[int, int, int]]] = []
                collapsed: list[bytes] = []
                for k, w in enumerate(texts):
                    mine = rows[cut[k] : cut[k + 1], 1:]
                    runs.append([tuple(r) for r in mine.tolist()])
                    if len(mine):
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
                        np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
                        w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(w))
                fields = ("start", "length", "period")
                kind = pa.struct([(f, pa.int64()) for f in fields])
                named = [[dict(zip(fields, r, strict=True)) for r in mine] for mine in runs]
                best = [dict(zip(fields, b, strict=True)) if (b := best_run(mine)) else None for mine in runs]
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()), "runs": pa.array(named, pa.list_(kind)),
                    "best": pa.array(best, kind), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")
