"""Byte pairs against the library's encoder and decoder."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import bytepairs, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [*"ab  '’sdtrevlmSTRE_12²½ⅷ\n\t\r\x1c\x1f\x85\xa0_-.!é漢字一ß 　Ᲊ🎉\U000105c0́\x00", "<|endoftext|>", "'ll", "'ve", "the", " and"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bytepairs.MODEL)


def texts():
    rng = random.Random(7)
    short = ["".join(rng.choices(ODD, k=rng.randrange(40))) for _ in range(300)]
    long = ["a" * 30_001, "ab" * 20_000, "é" * 9_999, " " * 5_000, "_" * 1_001, " ".join(f"word{rng.randrange(10**6)}" for _ in range(60_000))]
    return [None, "", " ", *short, *long, short[0], short[0]]


def test_query_equals_library(spark, library, tmp_path):
    rows = [(k if k != 7 else None, t, None, "s", 1) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("a column of a name that is used inside"))
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op12_byte_pairs(spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_arrays_and_decoding(spark, library):
    df = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts())], DOCS)
    encoded = bytepairs.encode_documents(df)
    for r in encoded.collect():
        assert r["ids"] == library.encode(texts()[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert all(r["text"] == (texts()[r["doc_id"]] or "") for r in bytepairs.decode_documents(encoded).collect())
    part = spark.createDataFrame([(1, [447, 50256, 10, 99999]), (2, None)], "doc_id long, ids array<int>")  # half a character, and an id that is none
    assert [r["text"] for r in bytepairs.decode_documents(part).orderBy("doc_id").collect()] == [library.decode([447, 50256, 10], skip_special_tokens=False), ""]
    assert bytepairs.encode_documents(spark.createDataFrame([], DOCS), decode=True).count() == 0


def test_rounds_of_a_partition_and_forgetting(library, monkeypatch):
    """Pieces met in one round are known in the next; forgetting them changes nothing."""
    own = bytepairs.BytePairs(bytepairs.MODEL)
    some = [t for t in texts() if t]
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    for limit in (1 << 20, 10):
        monkeypatch.setattr(bytepairs, "REMEMBERED", limit)
        for low in range(0, len(some), 50):
            assert [x.tolist() for x in own.encode_all(some[low : low + 50])] == want[low : low + 50]


def test_groups_keep_rows_and_bytes(spark):
    import pyarrow as pa

    rng = random.Random(3)
    batches = [pa.record_batch({"doc_id": pa.array(range(10 * k, 10 * k + 10)), "text": pa.array([None if rng.random() < 0.1 else "x" * rng.choice([0, 3, 40, 500]) for _ in range(10)])}) for k in range(20)]
    out = list(bytepairs._groups(iter(batches), 200))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(200))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 200 for b in out)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="no plain byte-level"):
        bytepairs.BytePairs(f"{bytepairs.TOKENIZERS}/word_bpe_49k.json")
