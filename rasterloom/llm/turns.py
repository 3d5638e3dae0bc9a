"""Conversation structure repair by a time-major tensor program.

The cheapest edits that give a conversation the roles ``(s?(ua)+)?`` are a shortest path through four states
(nothing yet, after system, after user, after assistant).  Conversations are bucketed by length and padded; the
costs to go of a whole bucket are one array (turn, state, conversation), filled from the last turn to
the first with one vectorised step a turn; the edits are then read off forwards, again for all conversations of the
bucket at once, taking of equally cheap edits the one whose initial is least.

The rows are dealt by range of (conversation, turn), so that no key, however many rows it has, goes to
one task.  A conversation inside one range is repaired where it lies.  The first and the last of a range may go on in the
next one: their rows are written out in blocks, and what must be in one place for them is a few bytes a turn (the
faults and, as the result asks for it in one string, the edits), never their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

# What edits cost, and the state after each role by state (-1: not allowed).
RETURN, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # the only other role than system that may follow
_KEEP = np.array([[-1, _SYSTEM, _USER, -1], [-1, -1, _USER, -1], [-1, -1, -1, _ASSISTANT], [-1, -1, _USER, -1]])  # by state, by initial
_FAR = np.int64(1) << 60
_D, _I, _K, _R = b"DIKR"
#: Rows of an open conversation that travel together, and bytes of their texts.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Turns of closed conversations that are repaired together.
TOGETHER = 1 << 15

_BLANKS = " \t\n\x0b\x0c\r"


def turn_columns(role: Column, text: Column) -> dict[str, Column]:
    """What the repair asks of a row, as columns: who (0 other, 1 s, 2 u, 3 a), blank, cut, and a digest of role and text."""
    end = F.rtrim(text, F.lit(_BLANKS))
    first = F.substring(role, 1, 1)
    return {
        "who": F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).cast("int"), "blank": F.trim(end, F.lit(_BLANKS)) == "",
        "cut": ~F.substring(end, -1, 1).isin(".", "!", "?"), "digest": F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)),
    }


# --- the tensor program


def repair_bucket(who: np.ndarray, gone: np.ndarray, cut: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least costs, edits) of a bucket: arrays (turn, conversation) of initials, must-delete and truncated marks.

    Edits come as a byte matrix (conversation, 3 * turns + 2): before each turn two places for insertions, then the turn's
    own edit, 0 where there is none."""
    turns, n = who.shape
    back = np.empty((turns + 1, 4, n), np.int64)

    def insertions(cost: np.ndarray) -> None:
        user, assistant = cost[_USER].copy(), cost[_ASSISTANT].copy()
        cost[_USER] = np.minimum(user, assistant + INSERT)
        cost[_ASSISTANT] = np.minimum(assistant, user + INSERT)
        for state in (_START, _SYSTEM):
            cost[state] = np.minimum(cost[state], cost[_USER] + INSERT)

    back[turns] = np.array([0, _FAR, _FAR, 0])[:, None]
    insertions(back[turns])
    column = np.arange(n)

    def choices(t: int, state: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Costs of delete, keep and rerole in a state, and the states after the latter two."""
        after = back[t + 1]
        may = np.where(gone[t], _FAR, np.where(cut[t], TRUNCATED, 0))
        kept = _KEEP[state, who[t]]
        moved = np.broadcast_to(_NEXT[state], kept.shape)
        return after[state, column] + DELETE, np.where(kept < 0, _FAR, after[kept, column] + may), after[moved, column] + may + RETURN, kept, moved

    for t in range(turns - 1, -1, -1):
        inside = t < length
        for state in range(4):
            delete, keep, rerole, _, _ = choices(t, state)
            back[t, state] = np.where(inside, np.minimum(np.minimum(delete, keep), np.minimum(rerole, _FAR)), back[t + 1, state])
        insertions(back[t])  # at a padded turn this changes nothing

    edits = np.zeros((n, 3 * turns + 2), np.uint8)
    state = np.full(n, _START)
    for t in range(turns + 1):
        inside = t < length if t < turns else np.zeros(n, bool)
        for k in (0, 1):
            now = back[t, state, column]
            if t < turns:
                delete, keep, rerole, kept, moved = choices(t, state)
            insert = back[t, _NEXT[state], column] + INSERT == now
            here = insert & (inside | (length == t))
            if t < turns:
                here &= ~(inside & (delete == now))  # D comes before I, I before K
            edits[here, 3 * t + k] = _I
            state = np.where(here, _NEXT[state], state)
        if t < turns:
            now = back[t, state, column]
            delete, keep, rerole, kept, moved = choices(t, state)
            edit = np.where(delete == now, _D, np.where(keep == now, _K, _R))
            edits[inside, 3 * t + 2] = edit[inside]
            state = np.where(inside, np.where(edit == _D, state, np.where(edit == _K, kept, moved)), state)
    return back[0, _START], edits


def repair_all(who: np.ndarray, gone: np.ndarray, cut: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Least cost and edits of every conversation; ``first`` is each one's first row (n + 1 entries)."""
    size = np.diff(first)
    cost, edits = np.zeros(len(size), np.int64), [np.zeros(2, np.uint8)] * len(size)
    bucket = np.where(size > 0, np.ceil(np.log2(np.maximum(size, 1)) * 2).astype(np.int64), -1)  # lengths within a factor of 1.42
    for b in np.unique(bucket[size > 0]).tolist():
        every = np.flatnonzero(bucket == b)
        longest = int(size[every].max())
        for low in range(0, len(every), max(1, (1 << 21) // longest)):
            of = every[low : low + max(1, (1 << 21) // longest)]
            turn = np.arange(longest)[:, None]
            at = np.minimum(first[of] + turn, len(who) - 1)
            cost[of], matrix = repair_bucket(who[at], gone[at], cut[at], size[of])
            for k, c in enumerate(of.tolist()):
                edits[c] = matrix[k, : 3 * size[c] + 2]
    return cost, edits


def repaired(edits: np.ndarray, who: list[int], roles: list[str], texts: list[str], state: int = _START) -> tuple[list[str], int]:
    """The lines ``role:text`` after the edits (three places a row, two more at an end), and the state after them."""
    lines = []
    for k, edit in enumerate(edits.tolist()):
        if edit == _K:
            state = int(_KEEP[state, who[k // 3]])
            lines.append(f"{roles[k // 3]}:{texts[k // 3]}")
        elif edit in (_I, _R):
            state = int(_NEXT[state])
            lines.append(("user:" if state == _USER else "assistant:") + (texts[k // 3] if edit == _R else ""))
    return lines, state


# --- rows to conversations


def _faults(blank: np.ndarray, cut: np.ndarray, digest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(duplicate, truncated) as first faults of the rows of conversations one after the other."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((digest, of))  # stable, so rows of one digest stay in order
    seen = np.zeros(len(of), bool)
    seen[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
    duplicate = seen & ~blank
    return duplicate, cut & ~blank & ~duplicate


def _gaps(turns: np.ndarray) -> int:
    return int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0


def _measure(who: np.ndarray, blank: np.ndarray, cut: np.ndarray, digest: np.ndarray, turn: np.ndarray, null_turn: np.ndarray, first: np.ndarray) -> tuple[list[dict[str, object]], list[np.ndarray]]:
    """The numbers of every conversation, and its edits; equal digests come as equal numbers."""
    duplicate, truncated = _faults(blank, cut, digest, first)
    cost, edits = repair_all(who, blank | duplicate, truncated, first)
    legal = np.zeros(len(who), bool)
    legal[1:] = ((who[:-1] == 1) & (who[1:] == 2)) | ((who[:-1] == 2) & (who[1:] == 3)) | ((who[:-1] == 3) & (who[1:] == 2))
    legal[first[:-1][np.diff(first) > 0]] = True
    total = [np.append(0, np.cumsum(x)) for x in (blank, duplicate, truncated, ~legal)]
    out = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        counts = [int(t[b] - t[a]) for t in total]
        out.append({"gaps": _gaps(turn[a:b][~null_turn[a:b]]), "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": int(cost[k]), "audit": edits[k][edits[k] > 0].tobytes().decode()})
    return out, edits


_NUMBERS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ROW = "struct<turn:long,role:string,text:string,who:int,blank:boolean,cut:boolean,digest:string>"
_ARROW_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("who", pa.int32()), ("blank", pa.bool_()), ("cut", pa.bool_()), ("digest", pa.string())])
_FIRST = f"conv_id long, {_NUMBERS}, repaired_sha256 string, range int, block int, rows array<{_ROW}>"
_SINGLE = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _array(batch: pa.RecordBatch, name: str, of_null: object = None) -> np.ndarray:
    column = batch.column(name)
    return (column if of_null is None else column.fill_null(of_null)).to_numpy(zero_copy_only=False)


def _same(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Whether each row (but the first) is of the conversation of the row before it."""
    conv, null = _array(batch, "conv_id", 0), np.asarray(batch.column("conv_id").is_null())
    return (conv[1:] == conv[:-1]) & (null[1:] == null[:-1])


def _repair_closed(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Result rows of whole conversations; ``starts`` has each one's first row and the end."""
    there = _array(rows, "there").astype(bool)
    kept = rows.filter(pa.array(there))
    first = np.append(0, np.cumsum(there))[starts]
    null_turn = np.asarray(kept.column("turn").is_null())
    digest = kept.column("digest").dictionary_encode().indices.to_numpy()
    numbers, edits = _measure(*(_array(kept, c) for c in ("who", "blank", "cut")), digest, _array(kept, "turn", 0), null_turn, first)
    who, roles, texts = (kept.column(c).to_pylist() for c in ("who", "role", "text"))
    sha = []
    for e, a, b in zip(edits, first[:-1].tolist(), first[1:].tolist(), strict=True):
        lines, _ = repaired(e, who[a:b], roles[a:b], texts[a:b])
        sha.append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
    n = len(sha)
    row = {"conv_id": rows.column("conv_id").take(pa.array(starts[:-1]))}
    row |= {c: pa.array([x[c] for x in numbers], pa.int64()) for c in _SINGLE} | {"audit": pa.array([x["audit"] for x in numbers], pa.string())}
    row |= {"repaired_sha256": pa.array(sha, pa.string()), "range": pa.nulls(n, pa.int32()), "block": pa.nulls(n, pa.int32()), "rows": pa.nulls(n, pa.list_(_ARROW_ROW))}
    return pa.record_batch(row)


def _open_blocks(rows: pa.RecordBatch, where: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of one open conversation as blocks."""
    size = np.asarray(pa.compute.binary_length(rows.column("text")), np.int64)
    part = np.maximum.accumulate(np.maximum(np.arange(len(size)) // BLOCK_ROWS, np.cumsum(size) // BLOCK_BYTES))
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        piece = rows.slice(a, b - a)
        piece = piece.filter(piece.column("there"))
        struct = pa.StructArray.from_arrays([piece.column(f.name).cast(f.type) for f in _ARROW_ROW], fields=list(_ARROW_ROW))
        row = {"conv_id": rows.column("conv_id").slice(0, 1)} | {c: pa.nulls(1, pa.int64()) for c in _SINGLE} | {c: pa.nulls(1, pa.string()) for c in ("audit", "repaired_sha256")}
        lists = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
        yield pa.record_batch(row | {"range": pa.array([where], pa.int32()), "block": pa.array([block + k], pa.int32()), "rows": lists})


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range: closed conversations repaired, the first and the last one in blocks."""
    where, block = TaskContext.get().partitionId(), 0
    in_first = True
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        starts = np.append(0, np.flatnonzero(~_same(held, held.num_rows)) + 1)
        if in_first:
            if len(starts) == 1:  # all of it so far is the first conversation: its blocks need not wait
                for out in _open_blocks(held, where, block):
                    block += 1
                    yield out
                held = held.slice(held.num_rows - 1, 1)  # the row that says which conversation this is
                held = held.set_column(held.schema.get_field_index("there"), "there", pa.array([False])) if held.num_rows else None
                continue
            for out in _open_blocks(held.slice(0, int(starts[1])), where, block):
                block += 1
                yield out
            held, starts, in_first = held.slice(int(starts[1])), starts[1:] - starts[1], False
        if len(starts) > 1 and held.num_rows >= TOGETHER:
            yield _repair_closed(held.slice(0, int(starts[-1])), starts)
            held = held.slice(int(starts[-1]))
    if held is not None and not in_first:
        starts = np.append(0, np.flatnonzero(~_same(held, held.num_rows)) + 1)
        if len(starts) > 1:
            yield _repair_closed(held.slice(0, int(starts[-1])), starts)
        yield from _open_blocks(held.slice(int(starts[-1])), where, block)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of open conversations' blocks, sorted: one row a conversation, and the edits of each of its blocks."""
    held: list[pa.RecordBatch] = []

    def finish(blocks: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.asarray(blocks.column("turn").value_lengths(), np.int64)
        flat = {c: blocks.column(c).flatten() for c in ("turn", "who", "blank", "cut", "digest")}
        turn = flat["turn"]
        columns = [flat[c].to_numpy(zero_copy_only=False) for c in ("who", "blank", "cut")]
        digest = flat["digest"].dictionary_encode().indices.to_numpy()
        numbers, edits = _measure(*columns, digest, turn.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(turn.is_null()), np.array([0, len(turn)]))
        ends = 3 * np.cumsum(counts)
        ends[-1] += 2
        parts = [edits[0][a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        states, state = [], _START
        at = 0
        for p, c in zip(parts, counts.tolist(), strict=True):
            states.append(state)
            who = columns[0][at : at + c].tolist()
            for k, edit in enumerate(p.tolist()):
                state = int(_KEEP[state, who[k // 3]]) if edit == _K else int(_NEXT[state]) if edit in (_I, _R) else state
            at += c
        n = blocks.num_rows
        last = pa.array(np.arange(n) == n - 1)
        row = {"conv_id": blocks.column("conv_id"), "range": blocks.column("range"), "block": blocks.column("block"), "last": last}
        row |= {"edits": pa.array([p.tobytes() for p in parts], pa.binary()), "state": pa.array(states, pa.int32())}
        row |= {c: pa.array([None] * (n - 1) + [numbers[0][c]], pa.int64()) for c in _SINGLE} | {"audit": pa.array([None] * (n - 1) + [numbers[0]["audit"]], pa.string())}
        return pa.record_batch(row)

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [0, *(np.flatnonzero(~_same(batch, batch.num_rows)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and not bool(_same(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), part.slice(0, 1)]), 2)[0]):
                yield finish(pa.concat_batches(held))
                held = []
            held.append(part)
    if held:
        yield finish(pa.concat_batches(held))


def _block_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired lines of each block, as one string (null: none)."""
    for batch in batches:
        out: list[str | None] = []
        for edits, state, rows in zip(batch.column("edits").to_pylist(), batch.column("state").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            lines, _ = repaired(np.frombuffer(edits, np.uint8), *([r[c] for r in rows] for c in ("who", "role", "text")), state)
            out.append("\n".join(lines) if lines else None)
        keep = ["conv_id", "range", "block", "last", *_SINGLE, "audit"]
        yield pa.record_batch({c: batch.column(c) for c in keep} | {"lines": pa.array(out, pa.string())})


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks of conversations: the hash goes on from block to block, so texts are not gathered."""
    sha, begun = hashlib.sha256(), False
    for batch in batches:
        done: list[str] = []
        last = batch.column("last").to_pylist()
        for lines, end in zip(batch.column("lines").to_pylist(), last, strict=True):
            if lines is not None:
                sha.update((("\n" if begun else "") + lines).encode())
                begun = True
            if end:
                done.append(sha.hexdigest())
                sha, begun = hashlib.sha256(), False
        ends = batch.filter(pa.array(last, pa.bool_()))
        yield pa.record_batch({c: ends.column(c) for c in ("conv_id", *_SINGLE, "audit")} | {"repaired_sha256": pa.array(done, pa.string())})


def repair_conversations(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of
    turns(conv_id, turn, role, text).

    A conversation's rows are taken by turn, nulls first; rows of one turn by the MD5 digest of role and text.  A
    row's first fault counts: blank (no character but space and 0x09-0x0D), duplicate (role and text seen
    earlier, by digest), truncated (the last such character is none of ``.!?``).  Rows for which ``there`` is not
    true are no turns, but their conversation is in the result; one without turns has zeros and empty strings.
    Null roles and texts count as one space; a null conv_id is a conversation of its own; repeated rows are
    duplicates; an empty table gives no row; conversations of any length and texts of any size are handled whole; other
    columns are not looked at.
    """
    work = Workspace(turns.sparkSession, "turns")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there"))
    rows = plain.withColumns(turn_columns(F.col("role"), F.col("text"))).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "salt"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    first = work.keep(ranges.mapInArrow(_by_range, _FIRST), "ranges")
    names = ["conv_id", *_SINGLE, "audit", "repaired_sha256"]
    closed = first.where("block is null").select(*names)
    blocks = first.where("block is not null").select("conv_id", "range", "block", "rows")
    facts = blocks.select("conv_id", "range", "block", *[F.col(f"rows.{c}").alias(c) for c in ("turn", "who", "blank", "cut", "digest")])
    place = ["conv_id", "range", "block"]
    edits = facts.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_conversations, f"conv_id long, range int, block int, last boolean, edits binary, state int, {_NUMBERS}")
    edits = work.keep(edits, "edits")
    # a block's place is its own, so this join has one row a key on both sides
    lines = blocks.withColumnRenamed("conv_id", "of").join(edits, ["range", "block"]).where(F.col("of").eqNullSafe(F.col("conv_id"))).drop("of").mapInArrow(_block_lines, f"conv_id long, range int, block int, last boolean, {_NUMBERS}, lines string")
    opened = lines.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_hash_lines, f"conv_id long, {_NUMBERS}, repaired_sha256 string")
    return closed.unionByName(opened.select(*names))


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by crc32(conv_id:turn) % 20, and the condition on those that are still there."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    hurt = turns.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(part[2]).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(part[3], ".!?", "")).otherwise(part[3]).alias("text"))
    twice = hurt.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return twice, F.col("kind") != 0
