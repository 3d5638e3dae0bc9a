"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  Two equal windows pick the same anchor:
the smallest hash among the ``GRAM``-word sequences inside (a minimiser), so an index of anchors,
about a fifth of all windows, finds every pair of equal windows.

``FingerprintIndex`` keeps the postings (anchor, doc_id) of past batches as immutable runs: tables
bucketed by anchor and sorted by anchor within each bucket.  A new batch becomes a run and is
merge-joined, bucket by bucket, with the runs there are; anchors found in more than one document
are suspects.  When a level holds ``fanout`` runs, they are merged into one run of the next level.  An
index with a path of its own outlives the session: its manifest, a versioned table beside the runs, says
which runs count, and opening it registers them again.

``remove_repeats`` verifies: documents emit the fingerprints of the windows with suspect anchors,
each window's smallest document is its owner, and all later documents lose the words it covers.  A
fingerprint is a 64-bit hash of the window beside the 64-bit hash of its anchor, both made of 64-bit word
hashes; texts themselves are not compared.  What meets at a hot window is a row for each batch of
documents, and it streams by in sorted order.

Up to ``SUSPECTS`` suspect anchors are looked up in a bitmap of at most 64 MB, which every task has, so the texts are read where they
lie; a window that is let in by mistake has one document and loses nothing.  More suspects are joined with the index's postings
instead, and each document gets the list of its own.  Both find the same windows.

Defined cases: null text has no words; a null doc_id neither removes nor loses anything; rows of one
doc_id count as one document and never remove from each other; documents under ``WINDOW`` words
have no windows; a very long text is one document, read whole; empty tables give empty results; other
columns are ignored unless they are carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import delete, versions
from .store import Workspace
from .words import Words, as_long, gram_places, grams, slices

WINDOW, GRAM = 13, 5
#: Text that a bucket's postings come from at most, before the number of shuffle partitions asks for more.
BUCKET_BYTES = 512 << 20
#: Suspect anchors that the bitmap takes, with 8 to 16 bits each, and the bits of one of its blocks.
SUSPECTS, BLOCK_BITS = 1 << 26, 1 << 19
_POSTING = "anchor bigint, doc_id bigint"
_MANIFEST = "level int, place int, name string, buckets int"


def window_anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, text) of every window."""
    places, owner = gram_places(words.first, WINDOW)
    if not len(places):
        return places, np.zeros(0, np.uint64), owner
    g = grams(words.hash, GRAM)
    low = g[places]
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(low, g[places + j], out=low)
    return places, low, owner


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, anchor, owner = window_anchors(Words(part.column("text")))
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            yield pa.record_batch({"anchor": as_long(anchor[new]), "doc_id": part.column("doc_id").take(pa.array(owner[new]))})


def _probes(anchor: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of the bitmap that an anchor has its bits in, and these bits."""
    bits = [((anchor >> np.uint64(k)) % np.uint64(BLOCK_BITS)).astype(np.int64) for k in (0, 17, 31)]
    return ((anchor >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64), bits


def _bitmap(suspects: DataFrame, n: int) -> np.ndarray:
    """The bitmap of n suspect anchors; its blocks are made apart, and their number is bounded by SUSPECTS."""
    blocks = 1
    while blocks * BLOCK_BITS < 8 * n:
        blocks *= 2

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, bool)
        for at in _probes(table.column("anchor").to_numpy().view(np.uint64), blocks)[1]:
            bits[at] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    block = F.pmod(F.shiftrightunsigned("anchor", 40), F.lit(blocks)).cast("int")
    made = suspects.select("anchor", block.alias("block")).groupBy("block").applyInArrow(fill, "block int, bits binary").toArrow()
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for k, bits in zip(made.column("block").to_pylist(), made.column("bits").to_pylist(), strict=True):
        out[k] = np.frombuffer(bits, np.uint8)
    return out


def _in_bitmap(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    block, bits = _probes(anchor, len(bitmap))
    hit = np.ones(len(anchor), bool)
    for at in bits:
        hit &= (bitmap[block, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def _in_lists(part: pa.RecordBatch, anchor: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each anchor is in the list that its document has in the column anchors."""
    lists = part.column("anchors")
    flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
    hit = np.zeros(len(anchor), bool)
    for i in range(part.num_rows):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            hit[a:b] = np.isin(anchor[a:b], flat[ends[i] : ends[i + 1]])
    return hit


def _suspect_windows(bitmap: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct windows of each document whose anchor is suspect: in the bitmap or, without one, in the document's list.

    Of a batch's documents with one window only the first can own it: the others lose it here and now
    (lost), and a window that a third of all documents hold goes on once for every batch, not once
    for every document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for part in slices(batch):
                words = Words(part.column("text"))
                places, anchor, owner = window_anchors(words)
                hit = _in_lists(part, anchor, owner) if bitmap is None else _in_bitmap(bitmap, anchor)
                places, anchor, owner = places[hit], anchor[hit], owner[hit]
                window = grams(words.hash, WINDOW)[places] if len(places) else np.zeros(0, np.uint64)
                found.append((anchor, window, np.asarray(part.column("doc_id"))[owner]))
            if not found:
                continue
            anchor, window, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, anchor, window))
            anchor, window, doc = anchor[order], window[order], doc[order]
            same = np.zeros(len(doc), bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (window[1:] == window[:-1])
            again = same.copy()
            again[1:] &= doc[1:] == doc[:-1]
            anchor, window, doc, same = anchor[~again], window[~again], doc[~again], same[~again]
            yield pa.record_batch({"anchor": as_long(anchor), "window": as_long(window), "doc_id": pa.array(doc), "lost": pa.array(same)})

    return run


def _losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, window) of what documents lose, from rows sorted by (window, anchor, doc_id): in each
    group all but the first document; state is one row."""
    owner: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, window, doc, lost = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "window", "doc_id", "lost"))
        first = np.ones(len(doc), bool)
        first[1:] = (window[1:] != window[:-1]) | (anchor[1:] != anchor[:-1])
        if owner is not None and (int(window[0]), int(anchor[0])) == owner[:2]:
            first[0] = False
        group = np.cumsum(first) - 1
        least = np.append(doc[first], owner[2] if owner else 0)[group]  # group -1 goes on from the batch before
        owner = int(window[-1]), int(anchor[-1]), int(least[-1])
        out = pa.array(np.flatnonzero(lost | (doc > least)))
        yield pa.record_batch({"doc_id": batch.column("doc_id").take(out), "window": batch.column("window").take(out)})


def _strip(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is left of each text without its lost windows; with ``whole`` a text that loses nothing stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                texts, lists = part.column("text").to_pylist(), part.column("windows")
                counts, removed, kept = words.counts, np.zeros(part.num_rows, np.int64), []
                for i, text in enumerate(texts):
                    own = text.encode().split() if text else []
                    listed = lists[i].as_py() if own else None
                    if listed:
                        h = grams(words.hash[words.first[i] : words.first[i + 1]], WINDOW)
                        at = np.flatnonzero(np.isin(h, np.array(listed, np.int64).view(np.uint64)))
                        depth = np.zeros(len(own) + 1, np.int64)
                        np.add.at(depth, at, 1)
                        np.add.at(depth, at + WINDOW, -1)
                        cover = np.cumsum(depth[:-1]) > 0
                        removed[i] = cover.sum()
                        own = compress(own, ~cover)
                    kept.append(text if whole and not removed[i] else b" ".join(own).decode())
                carried = {c: part.column(c) for c in part.schema.names if c not in ("text", "windows")}
                yield pa.record_batch(carried | {"n_words": pa.array(counts), "n_removed": pa.array(removed), "kept_text": pa.array(kept, pa.string())})

    return run


class FingerprintIndex:
    """Sorted immutable runs of (anchor, doc_id), merged level by level.

    With a path the index is opened if it is there, and kept; without one it goes when it is closed.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, path: str | None = None, text_bytes: int = 0):
        self.spark, self.fanout, self.kept = spark, fanout, path is not None
        self.work = Workspace(spark, "fingerprints")
        self.path = path.rstrip("/") if path else self.work.path
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // BUCKET_BYTES))
        self.levels: list[list[str]] = []
        found = versions(spark, f"{self.path}/manifest") if self.kept else []
        if found:
            for r in spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/v{found[-1]}").orderBy("level", "place").collect():  # a row a run
                self.buckets = r["buckets"]
                while len(self.levels) <= r["level"]:
                    self.levels.append([])
                if r["name"]:
                    self.levels[r["level"]].append(r["name"])
                    at = f"{self.path}/{r['name']}"
                    spark.sql(f"create table if not exists {r['name']} ({_POSTING}) using parquet clustered by (anchor) sorted by (anchor) into {self.buckets} buckets location '{at}'")

    def _save(self) -> None:
        """Make the runs there are the ones that count."""
        if self.kept:
            rows = [(k, i, name, self.buckets) for k, level in enumerate(self.levels) for i, name in enumerate(level or [""])]
            found = versions(self.spark, f"{self.path}/manifest")
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/v{found[-1] + 1 if found else 0}")
            for old in found[:-1]:
                delete(self.spark, f"{self.path}/manifest/v{old}")

    def _write(self, postings: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex[:12]}"
        dealt = postings.repartition(self.buckets, "anchor").distinct()
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add docs(doc_id, text) as a run; return the anchors that it shares with another document,
        in itself or in an earlier run."""
        before = self.runs()
        name = self._write(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_anchors, _POSTING))
        new = self.spark.table(name).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        suspects = new.where("low < high").select("anchor")
        for run in before:
            suspects = suspects.unionAll(new.join(run.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")), "anchor").where("low <> x or high <> y").select("anchor"))
        suspects = self.work.keep(suspects.distinct(), "suspects")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._save()
        return suspects

    def compact(self) -> None:
        """Merge each level that holds ``fanout`` runs into one run of the next level."""
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionAll(self.spark.table(name))
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(merged))
                self.levels[depth] = []
                self._save()
                for name in level:
                    self.spark.sql(f"drop table {name}")
                    delete(self.spark, f"{self.path}/{name}")

    def postings(self, suspects: DataFrame) -> DataFrame:
        """(anchor, doc_id) of every indexed document that has one of the suspect anchors."""
        found = [run.join(suspects, "anchor", "left_semi") for run in self.runs()]
        out = found[0]
        for more in found[1:]:
            out = out.unionAll(more)
        return out

    def close(self) -> None:
        """Take the runs out of the session's catalogue; the files of an index without a path go too."""
        for name in (name for level in self.levels for name in level):
            self.spark.sql(f"drop table {name}")
            if not self.kept:
                delete(self.spark, f"{self.path}/{name}")
        self.levels = []


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), batches: int = 4, fanout: int = 4, index: FingerprintIndex | None = None, history: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Return doc_id, the carried columns of docs, n_words, n_removed, kept_text for every row of
    docs(doc_id, text, ...).

    Every word is removed that a window covers whose word sequence also starts in a document with a
    smaller doc_id.  The documents enter an index of their own in ``batches`` ranges of doc_id.  With an
    index of earlier batches docs are its next batch, and history(doc_id, text) holds the documents
    indexed before, of which only those with suspect anchors are read on to verify.  With ``whole`` the
    kept_text of a document that loses nothing is its text as it was, null for null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = index is None
    if index is None:
        index = FingerprintIndex(spark, fanout, text_bytes=rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        cuts = rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) or []
        edges = [None, *sorted({int(c) for c in cuts}), None]
    else:
        edges = [None, None]
    work = index.work
    suspects = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        found = index.ingest(batch)
        suspects = found if suspects is None else suspects.unionAll(found)
        index.compact()
    suspects = work.keep(suspects.distinct(), "all_suspects")
    n = suspects.count()
    listed = None
    if n > SUSPECTS:
        listed = work.keep(index.postings(suspects).distinct().groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "listed")
    if own:
        index.close()
    known = rows if history is None else rows.unionByName(history.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    read = known.where("doc_id is not null") if listed is None else known.join(listed, "doc_id")
    windows = read.mapInArrow(_suspect_windows(_bitmap(suspects, n) if listed is None else None), "anchor long, window long, doc_id long, lost boolean")
    # rows that are lost already are dealt by document, so that they cannot pile up at their window
    dealt = windows.repartition(F.when(F.col("lost"), F.xxhash64("doc_id")).otherwise(F.xxhash64("window", "anchor"))).sortWithinPartitions("window", "anchor", "doc_id")
    lost = work.keep(dealt.mapInArrow(_losers, "doc_id long, window long").groupBy("doc_id").agg(F.collect_set("window").alias("windows")), "lost")
    if listed is not None:
        work.drop(listed)
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    kinds = "".join(f", `{c}` {carried.schema[c].dataType.simpleString()}" for c in carry)
    return carried.join(lost, "doc_id", "left").mapInArrow(_strip(whole), f"doc_id long{kinds}, n_words long, n_removed long, kept_text string")
