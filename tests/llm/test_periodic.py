"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_runs(w):
    """(start, length, period) of all runs."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def pieces(rng):
    w = []
    for _ in range(rng.randrange(6)):
        base = [f"v{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.randrange(1, 30))]
        w += (base * rng.randrange(1, 12))[: rng.randrange(1, 200)]
    return w


def test_runs_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(250):
        texts = [pieces(rng) for _ in range(rng.randrange(1, 5))] + [[]]
        code = {}
        word = np.array([code.setdefault(x, len(code)) for w in texts for x in w], np.int64)
        rows = periodic.find_runs(word, np.cumsum([0, *map(len, texts)])).tolist()
        for k, w in enumerate(texts):
            assert [tuple(r[1:]) for r in rows if r[0] == k] == plain_runs(w)


def test_bounded_grids_change_nothing(monkeypatch):
    word = np.array(list(range(100)) * 4 + [7] * 90 + [1, 2] * 30)
    want = periodic.find_runs(word, np.array([0, len(word)])).tolist()
    assert len(want) == 3
    monkeypatch.setattr(periodic, "GRID", 5)
    assert periodic.find_runs(word, np.array([0, len(word)])).tolist() == want


def test_query_equals_plain_runs(spark, tmp_path):
    rng = random.Random(11)
    rows = [(None, "a " * 30, "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0), (5, " \t\n", "", "", 0), (6, "\x0b".join(["é", "ß\x1f"] * 20), "", "", 0)]
    rows += [(k, rng.choice([" ", "\n", "\t "]).join(pieces(rng)), "en", "s", k) for k in range(10, 160)]
    rows += [(999, " ".join(f"w{rng.randrange(3000)}" for _ in range(9000)), "", "", 0), (20, rows[15][1], "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit("a column of a name that is used inside"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(w)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        numbers = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        want.append((i, len(runs), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 100
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
