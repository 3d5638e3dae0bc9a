"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

``Transducer`` is compiled from a model file: the normaliser (character map, dummy prefix, white-space
escape, optional white-space clean-up), an arc for each piece, and the byte fallback.  Composing it
with an input gives a lattice over the input's positions, and the encoding is the lattice's shortest
path in the tropical semiring (min, +).  All chunks of a batch are composed and searched together, one
position after the other, as arrays.  The arcs' weights are

  * in unigram models minus the piece's log probability;
  * in BPE models 0 or infinity.  Sums of piece scores do not give the merge order's result, so the
    state carries the last piece, and an arc v after u weighs 0 if the merges turn the string uv into
    exactly u, v.  A sequence is the BPE encoding of its string exactly if all neighbours are such
    pairs; so each position has one state of finite weight, and the path is the library's encoding.

User-defined pieces are cut out first, longest first, as the library does.  No piece crosses from
other characters into white space (checked at compile time), so an input splits before each run of
escaped spaces and equal chunks share one search.  What a worker remembers between texts is bounded
by ``REMEMBERED`` chunks, forgotten when a task ends, and ``PAIRS`` weights: about 40 MB.

Defined cases: null text gives a null list, empty text an empty one; characters that no piece has
become their UTF-8 bytes (or the unknown id without byte fallback); white space is kept as the model
says; a null doc_id is carried along; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model file's place on every machine; the folder is installed, not part of this repository.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Chunks of at most 64 characters with their ids (about 200 bytes each), and weights of pairs of
#: pieces (32 bytes each), that a task remembers.
REMEMBERED, PAIRS = 120_000, 500_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _wire(data: bytes) -> Iterator[tuple[int, Any]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


def character_map(blob: bytes) -> dict[str, str]:
    """Source to target of a precompiled map: a double-array trie over UTF-8 bytes, whose leaves are
    places in a pool of null-terminated strings."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, pool = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    out: dict[str, str] = {}
    at, paths, letters = np.zeros(1, np.int64), [b""], np.arange(1, 256)
    while len(at):
        base = at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
        for i in np.flatnonzero(units[at] >> 8 & 1):
            if paths[i]:
                start = int(units[base[i]] & 0x7FFFFFFF)
                out[paths[i].decode("utf-8", "replace")] = pool[start : pool.index(0, start)].decode()
        child = base[:, None] ^ letters
        row, letter = np.nonzero((child < len(units)) & (units[np.minimum(child, len(units) - 1)] & 0x800000FF == letters))
        at, paths = child[row, letter], [paths[i] + bytes([x + 1]) for i, x in zip(row.tolist(), letter.tolist(), strict=True)]
    return out


class Table:
    """Whole numbers by keys of 0 or more, in open addressing; -1 for keys that are not there."""

    def __init__(self, bits: int):
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.size, self._shift, self._mask = 0, np.uint64(64 - bits), (1 << bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, at, left = np.full(len(keys), -1, np.int32), self._slot(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (there >= 0)
            at, left = (at[go] + 1) & self._mask, left[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        for key, at, value in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self._mask
            self.keys[at], self.values[at] = key, value
        self.size += len(keys)


class Transducer:
    def __init__(self, model: bytes):
        fields: dict[int, list[Any]] = {}
        for number, value in _wire(model):
            fields.setdefault(number, []).append(value)
        trainer, normal = (dict(_wire(b"".join(fields.get(n, [])))) for n in (2, 3))
        self.kind = trainer.get(3, _UNIGRAM)
        if self.kind not in (_UNIGRAM, _BPE) or trainer.get(24):
            raise ValueError("only unigram and BPE models with white space in front are supported")
        self.map = character_map(normal.get(2, b""))
        self.widest = max(map(len, self.map), default=0)
        self.dummy, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.fallback = bool(trainer.get(35, 0))
        self.ids: dict[str, int] = {}
        self.weight: list[float] = []
        self.text: list[str] = []
        self.user: dict[str, int] = {}
        self.unknown = 0
        self.byte_id = [0] * 256
        out: list[bytes] = []
        for i, raw in enumerate(fields[1]):
            piece = dict(_wire(raw))
            text, kind = piece.get(1, b"").decode(), piece.get(3, _NORMAL)
            self.text.append(text)
            self.weight.append(-piece.get(2, 0.0))
            out.append(text.replace(SPACE, " ").encode())
            if kind == _USER:
                self.user[text] = i
            elif kind == _NORMAL:
                self.ids[text] = i
            elif kind == _BYTE:
                self.byte_id[int(text[3:5], 16)] = i
                out[-1] = bytes([int(text[3:5], 16)])
            elif kind == _CONTROL:
                out[-1] = b""
            elif kind == _UNKNOWN:
                self.unknown, out[-1] = i, " ⁇ ".encode()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) or any(SPACE in p or " " in p for p in self.user):
            raise ValueError("a piece has white space behind other characters")
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.by_length = sorted(self.user, key=len, reverse=True)
        self.first = {c[0] for c in chain(self.map, self.user)}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.by_length)) + ")").split if self.user else None
        self.pool = np.frombuffer(b"".join(out), np.uint8)
        self.length = np.array([len(x) for x in out], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.floor = max(self.weight[i] for i in self.ids.values()) + 10.0
        self.letters = np.unique(np.frombuffer("".join(self.ids).encode("utf-32-le"), np.uint32))
        self.arcs, self.ends_piece = self._trie()
        self.cost = np.array(self.weight)
        self._built: dict[int, Any] = {}
        self._pairs = Table((2 * PAIRS).bit_length())
        self.forget()

    def _trie(self) -> tuple[Table, np.ndarray]:
        """Arcs as (state, letter) to state, and the piece that ends in each state or -1."""
        letter = {chr(c): i for i, c in enumerate(self.letters.tolist())}
        ends, arcs = [-1], {}
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                key = at * len(letter) + letter[c]
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                at = arcs[key]
            ends[at] = i
        table = Table(max(4, (3 * len(arcs)).bit_length()))
        table.put(np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int64))
        return table, np.array(ends)

    def forget(self) -> None:
        """Drop the chunks remembered; the weights stay, which are at most PAIRS."""
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _mapped(self, text: str) -> str:
        """The character map applied from the left, the longest match first; user pieces stay."""
        out, at, rest = [], 0, self.first
        while at < len(text):
            if text[at] not in rest:
                out.append(text[at])
                at += 1
                continue
            own = next((u for u in self.by_length if text.startswith(u, at)), None)
            if own is None:
                own = next((text[at : at + k] for k in range(self.widest, 0, -1) if text[at : at + k] in self.map), None)
                out.append(text[at] if own is None else self.map[own])
            else:
                out.append(own)
            at += len(own or text[at])
        return "".join(out)

    def normalise(self, text: str) -> str:
        if self.map:
            text = self._mapped(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", SPACE)

    def _edges(self, piece: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What stands at the right and at the left edge while the merges (the best-scored pair first,
        the leftmost of equals) build a piece, each with the weight of the merge that ends it; None
        if they never build it."""
        parts, ids, weight = list(self.text[piece]), self.ids, self.weight
        right, left = [[parts[-1], math.inf]], [[parts[0], math.inf]]
        while len(parts) > 1:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and weight[found] < best:
                    best, at = weight[found], i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == len(parts) - 1:
                right[-1][1] = best
                right.append([parts[-1], math.inf])
            if at == 0:
                left[-1][1] = best
                left.append([parts[0], math.inf])
        return [(x, w) for x, w in right], [(x, w) for x, w in left]

    def _follows(self, u: int, v: int) -> bool:
        """Whether arc v has weight 0 in the state that u leads to: no merge across their border comes
        before the merges that build u and v.  A negative u is the start or an unknown character."""
        for piece in (u, v):
            if piece >= 0 and piece not in self._built:
                self._built[piece] = self._edges(piece)
        if self._built[v] is None:
            return False
        if u < 0:
            return True
        ids, weight = self.ids, self.weight
        for a, ends_a in self._built[u][0]:
            for b, ends_b in self._built[v][1]:
                found = ids.get(a + b)
                if found is not None and weight[found] < ends_a and weight[found] <= ends_b:
                    return False
        return True

    def _weights(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Weights of arcs v in the states u; negative arcs read unknown characters."""
        if self.kind == _UNIGRAM:
            return np.where(v < 0, self.floor, self.cost[np.maximum(v, 0)])
        key = (np.maximum(u, -1) + 1) * len(self.text) + np.maximum(v, 0)
        good = self._pairs.get(key)
        new = np.unique(key[(good < 0) & (v >= 0)])
        if len(new):
            if self._pairs.size + len(new) > PAIRS:
                self._pairs = Table(max(2 * PAIRS, 2 * len(new)).bit_length())
            self._pairs.put(new, np.array([self._follows(k // len(self.text) - 1, k % len(self.text)) for k in new.tolist()], np.int64))
            missing = np.flatnonzero(good < 0)
            good[missing] = self._pairs.get(key[missing])
        return np.where((v < 0) | (good > 0), 0.0, np.inf)

    def shortest_paths(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of all chunks' shortest paths, chunk by chunk, and where each chunk's begin; -2 - code
        is an unknown character's arc; ties keep the earlier start.

        Weights are not negative, so costs are final at the position whose arcs are relaxed, and an arc
        to a position that costs no more than its start cannot improve it.
        """
        size = np.array([len(c) for c in chunks], np.int64)
        first = np.cumsum(size) - size
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.searchsorted(self.letters, code)
        letter[np.append(self.letters, 0)[letter] != code] = -1
        chunk = np.repeat(np.arange(len(size)), size)
        stop = (first + size)[chunk]
        # the lattice: every piece that begins at a character
        alive, state, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        step = 0
        while len(alive):
            inside = alive + step < stop[alive]
            alive, state = alive[inside], state[inside]
            read = letter[alive + step]
            state = np.where(read >= 0, self.arcs.get(state * len(self.letters) + np.maximum(read, 0)), -1)
            alive, state = alive[state >= 0], state[state >= 0].astype(np.int64)
            step += 1
            piece = self.ends_piece[state]
            hit = piece >= 0
            if step == 1:
                alone = np.ones(len(code), bool)
                alone[alive[hit]] = False
                found.append((np.flatnonzero(alone), 1, -2 - code[alone].astype(np.int64)))
            found.append((alive[hit], step, piece[hit]))
        start = np.concatenate([x[0] for x in found])
        end = np.concatenate([x[0] + x[1] for x in found])
        arc = np.concatenate([x[2] for x in found])
        depth = start - first[chunk[start]]
        order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        start, end, arc, depth = start[order] + chunk[start[order]], end[order] + chunk[start[order]], arc[order], depth[order]
        # relaxation; chunk i has the positions first[i] + i and on, one more than characters
        zero = first + np.arange(len(size))
        cost, last, come = np.full(len(code) + len(size), np.inf), np.full(len(code) + len(size), -1), np.zeros(len(code) + len(size), np.int64)
        cost[zero] = 0
        cuts = np.searchsorted(depth, np.arange(int(size.max(initial=0)) + 1))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, v = start[low:high], end[low:high], arc[low:high]
            may = cost[e] > cost[s]
            s, e, v = s[may], e[may], v[may]
            now = cost[s] + self._weights(last[s], v)
            better = now < cost[e]
            s, e, v = s[better], e[better], v[better]
            cost[e], last[e], come[e] = now[better], v, s
        at, who, steps = zero + size, np.arange(len(size)), []
        while True:
            going = at > zero[who]
            at, who = at[going], who[going]
            if not len(at):
                break
            steps.append((who, last[at]))
            at = come[at]
        who = np.concatenate([np.zeros(0, np.int64), *[w for w, _ in reversed(steps)]])
        path = np.concatenate([np.zeros(0, np.int64), *[x for _, x in reversed(steps)]])
        order = np.argsort(who, kind="stable")
        return path[order], np.searchsorted(who[order], np.arange(len(size) + 1))

    def _ids(self, path: np.ndarray) -> bytes:
        out: list[int] = []
        for found in path.tolist():
            if found >= 0:
                out.append(found)
            elif self.fallback:
                out.extend(self.byte_id[b] for b in chr(-2 - found).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return struct.pack(f"={len(out)}i", *out)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        path, cut = self.shortest_paths(new)
        plain, cuts = path.astype(np.int32).tobytes(), cut.tolist()
        odd = np.add.reduceat(path < 0, cut[:-1]).tolist() if len(new) else []
        return {c: self._ids(path[a:b]) if x else plain[4 * a : 4 * b] for c, a, b, x in zip(new, cuts[:-1], cuts[1:], odd, strict=True)}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = [self.normalise(t) for t in texts]
        split = [[self.chunks(x) if k % 2 == 0 else (x,) for k, x in enumerate(self.cut(t))] if self.cut else [self.chunks(t)] for t in whole]
        here: dict[str, bytes] = {}
        missing: list[str] = []
        for c in set(chain.from_iterable(part for text in split for part in text[::2])):
            ids = self._known.get(c) or self._older.get(c)
            if ids is None:
                missing.append(c)
            else:
                here[c] = ids
        for low in range(0, len(missing), 1 << 14):
            here.update(self._learn(missing[low : low + (1 << 14)]))
        if len(self._known) > REMEMBERED // 2:  # two generations: what is asked for again stays
            self._older, self._known = self._known, {}
        self._known.update((c, ids) for c, ids in here.items() if len(c) <= 64)
        held = {u: struct.pack("=i", i) for u, i in self.user.items()}
        ids_of = here.__getitem__
        return [np.frombuffer(b"".join([b"".join(map(ids_of, x)) if k % 2 == 0 else held[x[0]] for k, x in enumerate(text)]), np.int32) for text in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        size = self.length[ids]
        total = int(size.sum())
        if not total:
            return ""
        before = np.cumsum(size) - size
        data = self.pool[np.repeat(self.place[ids] - before, size) + np.arange(total)].tobytes()
        return data[1 if self.dummy and data[:1] == b" " else 0 :].decode("utf-8", "replace")


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str = MODEL) -> Transducer:
    if path not in _COMPILED:
        with open(path, "rb") as f:
            _COMPILED[path] = Transducer(f.read())
        gc.freeze()  # the model is for good; collections need not walk it
    return _COMPILED[path]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids, round_trip (decoding gives the text back) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            texts = batch.column("text")
            for low in range(0, batch.num_rows, 256):
                part = texts.slice(low, 256).to_pylist()
                found = iter(fst.encode_all([t for t in part if t is not None]))
                ids = [None if t is None else next(found) for t in part]
                ends = np.zeros(len(part) + 1, np.int32)
                np.cumsum([0 if x is None else len(x) for x in ids], out=ends[1:])
                offsets = pa.array(ends, mask=np.append([x is None for x in ids], False))
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(low, 256), "n_ids": pa.array([None if x is None else len(x) for x in ids], pa.int32()), "ids": pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    "round_trip": pa.array([None if x is None else fst.decode(x) == t for x, t in zip(ids, part, strict=True)], pa.bool_()),
                })
        fst.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids int, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text for every row of encoded(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for batch in batches:
            texts = [None if x is None else fst.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
