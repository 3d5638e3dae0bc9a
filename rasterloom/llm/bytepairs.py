"""Byte-pair encoding and decoding with a pair occurrence index.

A text is cut into pieces by the byte-level pattern, and the distinct pieces that a partition has not
met before are encoded together: their bytes become symbols in one linked array, an index maps every
pair of neighbours that has a merge rank to all its positions in all pieces, and active ranks are taken
in ascending order.  A merge joins all positions of its pair at once and enters the pairs that arise to
its left and right into their lists; positions that have changed since are dropped when their list is
taken.  Within a piece that is the order "lowest rank first, leftmost first", so the ids are the library's.

Decoding concatenates the tokens' bytes and replaces what is not UTF-8.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files are.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = f"{TOKENIZERS}/byte_bpe_50k.json"
#: Bytes of text whose pieces are encoded together; a longer text is handled alone.
TOGETHER = 1 << 25
#: Pieces remembered from one round of a partition to the next.
REMEMBERED = 1 << 20

# The characters that the byte-level pattern counts as white space, and its contractions.
_SPACE = "\t-\r \x85\xa0  -     　"
_SHORT = "'(?:[stmd]|re|ve|ll)"
#: Characters for which Python's ``\w``, ``\d`` and ``\s`` do not tell letters, numbers and spaces apart as
#: the pattern does, or that are not looked at here (all but Latin letters and common punctuation).
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-‏ -  -₟⃁-\U0010ffff]")
_PLAIN = re.compile(_SHORT + r"| ?[^\W\d_]+| ?\d+| ?[^\s\w]+(?:_+[^\s\w]*)*| ?_+[^\s\w]*(?:_+[^\s\w]*)*|\s+(?!\S)|\s+")


def _classes() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """The pattern with all letters and numbers spelt out, and one for characters that Python's tables lack."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Cn": []}
    start, before = 0, None
    for code in range(sys.maxunicode + 2):
        kind = unicodedata.category(chr(code)) if code <= sys.maxunicode else None
        kind = kind if kind == "Cn" or kind is None else kind[0]
        if kind != before:
            if before in kinds:
                kinds[before].append(f"{re.escape(chr(start))}-{re.escape(chr(code - 1))}")
            start, before = code, kind
    letters, numbers, unknown = ("".join(kinds[k]) for k in ("L", "N", "Cn"))
    return re.compile(f"{_SHORT}| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"), re.compile(f"[{unknown}]")


class _Numbered(dict):
    """Pieces numbered as they come."""

    def __missing__(self, piece: object) -> int:
        self[piece] = n = len(self)
        return n


class BytePairs:
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, back = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or spec.get("post_processor") or (cut.get("type"), back.get("type")) != ("ByteLevel", "ByteLevel") or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary {odd}")
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are not plain strings")
        # printable Latin-1 characters stand for their byte, the other bytes for characters from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary: dict[str, int] = model["vocab"]
        byte_id = {b: vocabulary[c] for c, b in letter.items()}
        self.byte_id = np.array([byte_id[b] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right, self.joined = left, right, np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.base = max([*vocabulary.values(), *added.values()]) + 1
        keys = left * self.base + right
        self._rank = np.argsort(keys, kind="stable")
        self._keys = np.append(keys[self._rank], np.iinfo(np.int64).max)
        token = {i: bytes(letter[c] for c in t) for t, i in vocabulary.items() if all(c in letter for c in t)} | {i: t.encode() for t, i in added.items()}
        size = np.array([len(token.get(i, b"")) for i in range(self.base)], np.int64)
        self.length, self.place = size, np.cumsum(size) - size
        self.pool = np.frombuffer(b"".join(token.get(i, b"") for i in range(self.base)), np.uint8)
        self.added = added
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._exact: tuple[re.Pattern[str], re.Pattern[str]] | None = None
        self._library = None
        self.forget()

    def forget(self) -> None:
        """Drop the pieces met so far."""
        self._seen = _Numbered()
        for i in self.added.values():
            self._seen[i]  # an added token is a piece of its own, known by its id
        self._ids, self._ends = np.array(list(self.added.values()), np.int64), np.arange(len(self.added) + 1)

    # --- cutting texts into pieces

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without added tokens."""
        if _ODD.search(text) is None:
            return _PLAIN.findall(text)
        if self._exact is None:
            self._exact = _classes()
        whole, unknown = self._exact
        if unknown.search(text) is None:
            return whole.findall(text)
        if self._library is None:  # characters that are newer than Python's tables: the library knows them
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces, in order."""
        number = self._seen.__getitem__
        if self._special is None or self._special.search(text) is None:
            found = self.pieces(text)
            return np.fromiter(map(number, found), np.int64, len(found))
        out: list[int] = []
        for k, part in enumerate(self._special.split(text)):
            out.extend([number(self.added[part])] if k % 2 else map(number, self.pieces(part)))
        return np.array(out, np.int64)

    # --- the pair occurrence index

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, -1 for none."""
        key = a * self.base + b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, np.append(self._rank, -1)[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's end."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        filled = size > 0
        after[end[filled] - 1], before[(end - size)[filled]] = -1, -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, a, b in zip(rank[np.append(0, cut)].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                if r in places:
                    places[r].append(at[a:b])
                else:
                    places[r] = [at[a:b]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            at = np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping places every second one, from the left
                fresh = np.append(True, after[at[:-1]] != at[1:])
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone], after[at] = self.joined[r], -1, then
            inner = then >= 0
            before[then[inner]] = at[inner]
            ahead = before[at]
            enter(np.concatenate([ahead[ahead >= 0], at[inner]]))
        alive = symbol >= 0
        return symbol[alive], np.append(0, np.cumsum(alive))[end] if len(words) else end

    def learn(self) -> None:
        """Encode the pieces that were numbered since the last call."""
        known = len(self._ends) - 1
        if known == len(self._seen):
            return
        new = [w.encode() for w in list(self._seen)[known:]]
        ids, ends = self.merge(new)
        self._ends = np.concatenate([self._ends, ends + len(self._ids)])
        self._ids = np.concatenate([self._ids, ids])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self._seen) > REMEMBERED:
            self.forget()
        split = [self.numbers(t) for t in texts]
        self.learn()
        out = []
        for w in split:
            first = self._ends[w]
            size = self._ends[w + 1] - first
            total = int(size.sum())
            out.append(self._ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)].astype("<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids that stand for no token give nothing."""
        ids = ids[ids < self.base].astype(np.int64)
        size = self.length[ids]
        return self.pool[np.repeat(self.place[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes().decode("utf-8", "replace")


_READ: dict[str, BytePairs] = {}


def vocabulary(path: str = MODEL) -> BytePairs:
    if path not in _READ:
        _READ[path] = BytePairs(path)
        gc.freeze()  # the vocabulary is for good; collections need not walk it
    return _READ[path]


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows regrouped to about ``limit`` bytes of text; a longer text comes in a group of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0), np.int64)
        low = 0
        while low < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(size[low:]), limit - total, "right"))
            if fits:
                held.append(batch.slice(low, fits))
                total += int(size[low : low + fits].sum())
                low += fits
            if low < batch.num_rows:
                if held:
                    yield pa.concat_batches(held)
                    held, total = [], 0
                else:
                    yield batch.slice(low, 1)
                    low += 1
    if held:
        yield pa.concat_batches(held)


def encode_documents(docs: DataFrame, model: str = MODEL, decode: bool = False, packed: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (and with ``decode`` the text that they decode to) for every row of docs(doc_id, text).

    ``ids`` is an array of ints, with ``packed`` a binary of little-endian unsigned 32-bit integers.  A null
    text counts as the empty text, which has no ids; a null doc_id is carried along; repeated rows give
    repeated results; long texts are encoded whole, and long pieces too; strings of added tokens in a text are
    those tokens, as in the library; an empty table gives no row; other columns of docs are not looked at.
    """
    schema = f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}" + (", decoded string" if decode else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in _groups(batches, TOGETHER):
            ids = own.encode_all(batch.column("text").to_pylist())
            low = 0
            while low < len(ids):  # results go out in parts, so that no part passes Arrow's offsets
                high, total = low, 0
                while high < len(ids) and (high == low or total + len(ids[high]) <= TOGETHER // 4):
                    total += len(ids[high])
                    high += 1
                part = ids[low:high]
                if packed:
                    column = pa.array([x.tobytes() for x in part], pa.binary())
                else:
                    ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(part).view(np.int32)))
                row = {"doc_id": batch.column("doc_id").slice(low, high - low), "n_tokens": pa.array([len(x) for x in part], pa.int64()), "ids": column}
                if decode:
                    row["decoded"] = pa.array([own.decode(x) for x in part], pa.string())
                yield pa.record_batch(row)
                low = high
        own.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text for every row of encoded(doc_id, ids), ids an array of ints or packed; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model)
        for batch in batches:
            column = batch.column("ids").to_pylist()
            texts = [own.decode(np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.array(x or [], np.int64)) for x in column]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
