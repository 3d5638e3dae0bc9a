"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Plain version of the damage: [(conv, turn, role, text)] of what is still there."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def order(row):
    role, text = row[2:]
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def repair(rows):
    """The result for one conversation's rows: every way to edit it, by recursion."""
    rows = sorted(rows, key=order)
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANKS)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(k, last, inserted):
        """(cost, edits, roles) from row k on; at most three insertions in a row are worth looking at."""
        found = []
        if k == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            cost, edits, said = best(k + 1, last, 0)
            found.append((4 + cost, "D" + edits, said))
            if faults[k] not in ("blank", "duplicate"):
                extra = 3 * (faults[k] == "truncated")
                for edit, role in [("K", rows[k][2]), ("R", "user"), ("R", "assistant")]:
                    if role[:1] and role[0] in after[last]:
                        cost, edits, said = best(k + 1, role[0], 0)
                        found.append((cost + extra + 3 * (edit == "R"), edit + edits, ((role, rows[k][3]), *said)))
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in after[last]:
                    cost, edits, said = best(k, role[0], inserted + 1)
                    found.append((3 + cost, "I" + edits, ((role, ""), *said)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    for k in range(len(rows), 0, -200):  # from the end, so that recursion stays shallow
        for last in after:
            best(k, last, 0)
    cost, audit, said = best(0, "", 0)
    known = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
    }


def check(df, rows, there):
    got = {r["conv_id"]: r.asDict() for r in df.collect()}
    assert len(got) == df.count() and set(got) == {r[0] for r in rows}
    for conv in got:
        want = repair([r for r in there if r[0] == conv]) | {"conv_id": conv}
        assert got[conv] == want


def table(seed, conversations, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", " \t\n", "", None, f"text {rng.randrange(5)}?", "nul\x00 é.\n "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows + rows[:7] + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (10**12, None, None, None)]


def test_query_equals_plain_search(spark, tmp_path):
    rows = table(1, 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.lit("a column of a name that is used inside")).withColumn("block", F.lit(1))
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    check(queries.op11_conversations(spark, str(tmp_path)), rows, damaged(rows))


def test_conversations_over_many_ranges(spark):
    """One conversation has most rows, many of them alike, and lies in all ranges."""
    rows = [(5, k // 5, ("user", "assistant")[k % 2], f"t {k % 50}." if k % 4 else "same.") for k in range(1500)] + table(2, 40)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = turns.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4))
        check(out, rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table_and_dropped_conversation(spark):
    assert turns.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = turns.repair_conversations(spark.createDataFrame([(1, 2, "user", "a.")], SCHEMA), F.lit(False)).first()
    assert (gone["cost"], gone["audit"], gone["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_tensor_program_is_bucketed(seed):
    """Conversations of very different lengths together give what each gives alone."""
    rng = np.random.default_rng(seed)
    size = np.append(rng.integers(0, 40, 60), [0, 1, 300])
    first = np.append(0, np.cumsum(size))
    who, gone, cut = rng.integers(0, 4, first[-1]), rng.random(first[-1]) < 0.2, rng.random(first[-1]) < 0.3
    cost, edits = turns.repair_all(who, gone, cut, first)
    for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
        alone, own = turns.repair_all(who[a:b], gone[a:b], cut[a:b], np.array([0, b - a]))
        assert alone[0] == cost[k] and own[0].tobytes() == edits[k].tobytes()
