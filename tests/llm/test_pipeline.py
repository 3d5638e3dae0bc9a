"""The pipeline's stages, each on its own input, against plain Python."""

import os
import random
import zlib
from collections import Counter

import plain
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        t = text(60)
        if i % 5 == 0:
            t = t.replace(" ", " nasty ", 3)
        rows.append((i, t, "en", f"s{i % 2}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    passage = text(40)
    rows += [(200, rows[1][1], "en", "s0", 1), (201, rows[1][1] + " extra", "en", "s0", 1), (202, text(30) + " " + passage, "en", "s1", 1), (203, passage + "  " + text(30), "en", "s1", 1), (204, "", "en", "s1", 0), (205, None, "en", None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "mixing", "tokens"]
    clean = stages["toxicity"](spark, docs, folder)
    ids = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and ids == {i for i in range(120) if i % 5} | {200, 201, 202, 203, 204, 205}
    single = {r["doc_id"] for r in stages["near_dedup"](spark, docs, folder).collect()}
    assert single == set(range(120)) | {202, 203, 204, 205}
    cut = {r["doc_id"]: r for r in stages["substring_dedup"](spark, docs, folder).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert cut[200]["text"] == "" and cut[201]["text"] == "extra" and cut[202]["text"] == before[202]
    assert cut[203]["text"].split() == before[203].split()[40:] and cut[203]["n_chars"] == len(cut[203]["text"])
    assert all(cut[i]["text"] == before[i] for i in before if i not in (200, 201, 203))
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}


def test_stages_on_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = docs.where("doc_id = 0").selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.toxicity(spark, docs.unionAll(toxic), folder).where("doc_id is null").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, docs, folder)
        rows = sorted(map(str, own.collect()))
        wide = docs.selectExpr("*", "1 as original", "2 as copy", "3 as row", "4 as score", "5 as label", "6 as kept", "7 as n_removed")
        assert sorted(map(str, stage(spark, wide, folder).collect())) == rows, name
        assert stage(spark, docs.limit(0), folder).collect() == [], name
        assert set(map(str, stage(spark, docs.unionAll(docs), folder).collect())) >= (set(rows) if name in ("near_dedup", "substring_dedup", "tokens") else set()), name
        if name != "tokens":
            assert own.columns == docs.columns


def test_run_equals_brute_force(spark, folder):
    """All five stages one after the other, against plain Python and the library's encoder."""
    sentencepieces = pytest.importorskip("rasterloom.llm.sentencepieces")
    if not os.path.exists(sentencepieces.MODEL):
        pytest.skip("no model here")
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    texts, sources = {r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["source"] for r in rows}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    scores = plain.toxic_scores(texts, labels)
    texts = {i: t for i, t in texts.items() if scores[i][0] < corpus_pipeline.TOXIC}
    gone = plain.near_duplicates(texts)
    texts = plain.without_repeats({i: t for i, t in texts.items() if i not in gone})
    want = Counter({(i, None if texts[i] is None else tuple(library.encode(texts[i]))): n for i, n in plain.copies(texts, sources).items() if n})
    got = Counter((r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and gone and sum(want.values()) > 50


def test_run_gives_ids_for_every_copy(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r["ids"] is None or r["round_trip"] for r in rows)
    assert not {r["doc_id"] for r in rows} & ({i for i in range(120) if i % 5 == 0} | {200, 201})
