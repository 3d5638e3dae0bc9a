"""Every training-data operator against plain Python on small tables with the odd cases in them."""

import base64
import hashlib
import io
import math
import random
import time
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import htmltext, minhash, mixing, multiindex, quality, queries, sentencepieces, substring, topk, toxicity, warc
from rasterloom.llm.store import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Near and exact copies, shared passages, and null, empty, short and very long texts."""
    base, passage = words(120, 1), words(30, 2)
    texts = [" ".join(base)]
    for k in range(6):
        edited = list(base)
        for at in random.Random(k).sample(range(120), 2 + k):
            edited[at] = f"edit{k}"
        texts.append(" ".join(edited))
    texts += [texts[0], texts[0].upper(), "\t".join(base), " ".join(words(40, 3) + passage + words(20, 4)), " ".join(words(9, 5) + passage), " ".join(passage * 2)]
    texts += [None, "", " \n\t", "one", "one two", "one two", "É à ñ \x1f odd", " ".join(words(20_000, 6, 5000))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * i + 3, t, "en", f"s{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows + [(None, "null id " * 20, "en", "s0", 1)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect() if r["doc_id"] is not None]
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()) for i, w in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k=4).collect()}
    for i, s in sets.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), find(i), find(i) == i)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Chains of edits: each text is near its neighbours only, and all meet in few buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base, rows = words(100, 7), []
    for k in range(40):
        base = list(base)
        base[(k * 37) % 100] = f"n{k}"
        rows.append((k, " ".join(base), "en", "s", 1))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), k=4).collect()
    assert {r["component_id"] for r in got} == {0}


def test_estimate_and_densification():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    parts = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    regs = minhash.registers(np.concatenate(parts), np.array([0, len(parts[0]), len(parts[0]) + len(parts[1])]))
    guess, used = minhash.estimate(regs[:1], regs[1:], np.array([900]), np.array([900]))
    assert abs(guess[0] - 0.8) < 0.15 and used[0] == minhash.BUCKETS
    small = minhash.registers(parts[0][:5], np.array([0, 5]))
    assert (minhash.densified(small) != 0xFFFF).all()


@pytest.mark.parametrize("limit", [substring.SUSPECTS, 0])
def test_repeats_equal_brute_force(spark, docs, monkeypatch, limit):
    """Suspects in a bitmap and, with the limit at none, joined with the index."""
    monkeypatch.setattr(substring, "SUSPECTS", limit)
    rows = [(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()]
    first = {}
    for i, w in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs, batches=3, fanout=2).collect()}
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), sum(gone), want)
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_index_merges_levels(spark, docs):
    index = substring.FingerprintIndex(spark, fanout=2)
    rows = docs.where("doc_id is not null")
    found = [index.ingest(rows.where(f"doc_id % 4 = {k}")).count() for k in range(4)]
    index.compact()
    assert [len(level) for level in index.levels] == [0, 1] and sum(found) > 0
    postings = index.runs()[0]
    assert postings.count() == postings.distinct().count() > 0
    index.close()


def test_index_is_reopened_for_each_batch(spark, docs, tmp_path):
    """Batch by batch, with the index closed and opened between, gives what all at once gives."""
    at = f"file://{tmp_path}/index"
    want = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(docs).collect()}
    got, edges = {}, [-1, 60, 110, 10**9]
    for low, high in zip(edges[:-1], edges[1:]):
        index = substring.FingerprintIndex(spark, 2, path=at)
        batch, before = (docs.where((F.col("doc_id") > a) & (F.col("doc_id") <= b)) for a, b in ((low, high), (-1, low)))
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(batch, index=index, history=before).collect()}
        index.close()
    last = substring.FingerprintIndex(spark, 2, path=at)
    assert sum(map(len, last.levels)) == 2 and got == {i: v for i, v in want.items() if i is not None}
    last.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


PAGES = [(1, "http://a/x", "p" * 1200), (2, "http://a/y", "p" * 1200), (3, None, "short"), (4, "u\r\nv", "short"), (5, "z", None), (6, "http://b", "é" * 700), (9, "http://c", "p" * 1200), (None, "n", "null id")]


def test_archives_round_trip(spark):
    got = {r["page_id"]: r for r in warc.page_archive_records(spark, spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", 9) if i in (1, 2) else ("response", None))
    assert warc.page_archive_records(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_payloads_come_back(spark):
    work = Workspace(spark, "warc-test")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = work.keep(warc.write_archives(warc.mark_revisits(pages), f"{work.path}/a", archive_bytes=200), "m")
    assert manifest.count() > 2
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest).where("record_type = 'response'").collect()}
    assert back == {i: h or "" for i, _, h in PAGES if i not in (1, 2)}


def test_reader_refuses_damage():
    good = warc.encode_record("response", {"WARC-Record-ID": "<urn:uuid:0>", "Content-Type": "text/plain", "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()).decode()}, b"abc")
    assert [r["payload"] for r in warc.read_records(io.BytesIO(good + good))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    text = zlib.decompress(good, 31)
    for bad in (text.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"), text.replace(b"Content-Length: 3", b"Content-Length: 2")):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(packer.compress(bad) + packer.flush())))


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + k, [float(x) for x in base[k % 3] * 2 + rng.normal(size=8) * 0.05]) for k in range(12)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] + [1.0] * 7), (304, []), (305, [1.0, 2.0]), (None, rows[1][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top_k_equals_brute_force(spark):
    rows, df = vectors(spark)
    fine = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in fine if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0", k=5).collect()} == want
    huge = spark.createDataFrame([(0, [1e15, 1.0]), (1, [3e14, 7.0]), (2, [3e14, 7.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(huge, "vec_id = 0").orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    assert topk.top_k(df.limit(0), "vec_id % 2 = 0").count() == 0


def test_blocks_of_clustered_vectors_are_left_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (30, 16))
    values = (centres[rng.integers(0, 30, 6000)] + rng.integers(-30, 30, (6000, 16))).astype(float)
    blocks = topk.Blocks(np.arange(6000), values)
    scores = values[:20] @ values.T
    for i in range(20):
        found, ids = blocks.search(i, values[i], 10)
        order = [j for j in np.lexsort((np.arange(6000), -scores[i])) if j != i][:10]
        assert ids.tolist() == order and found.tolist() == scores[i][order].tolist()
    assert blocks.scored < 20 * (len(blocks.edges) - 1) / 4


def test_near_vectors_equal_brute_force(spark):
    rows, df = vectors(spark)
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: {j for j in fine if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.95} for i in fine}
    got = {r["vec_id"]: r for r in multiindex.near_vectors(df).collect()}
    for i, v in rows:
        if i is None:
            continue
        reach, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, ())), min(reach), min(reach) == i)
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert multiindex.near_vectors(df.limit(0)).count() == 0


def test_forest_keeps_what_is_connected():
    forest = multiindex.Forest(9)
    for x, others in ((1, [2, 3]), (2, [3]), (7, [8]), (3, [1, 2])):
        forest.add(x, np.array(others))
    assert sorted(map(tuple, forest.links().T.tolist())) == [(1, 2), (1, 3), (7, 8)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        bad, junk = i % 4 == 0, i % 3 == 0
        w = words(40, 1000 + i, 200)
        if bad:
            for at in rng.sample(range(40), 4):
                w[at] = rng.choice(["nasty", "vilefolk", "vilething"])
        if junk:
            w = [x.upper() + "$$$" for x in w]
        rows.append((i, " ".join(w[:20]) + "\n" + " ".join(w[20:]), int(bad), int(not junk)))
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "nasty " * 5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, good int")


def test_toxicity_finds_held_out(spark, labelled):
    taught = labelled.where("doc_id < 160 or doc_id is null").select("doc_id", F.col("toxic").alias("label"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(labelled, taught).collect()}
    assert len(got) == 243 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all((got[i]["score"] >= 0.3) == (i % 4 == 0) for i in range(160, 240))
    assert all(i % 4 == 0 for i in got[160]["evidence"]) and got[1001]["score"] < 0.3
    none = toxicity.score_toxicity(labelled, taught.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.0]


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in ("an", "the", "wolf", "é") for b in ("", "ing", "stone") for c in "xyz"] + ["idiot", "scum"]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) for i in range(90)} | {90: None, 91: "", 92: "!?", 93: "unknown wordsthatare long", 94: "The WOLFSTONEX  the"}
    labels = {i: int("idiot" in texts[i]) for i in range(60)}
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, label int")).collect()}
    want = plain.toxic_scores(texts, labels)
    for i, (score, cosines) in want.items():
        assert np.allclose(got[i]["cosines"], cosines, atol=2e-9) and abs(got[i]["score"] - score) < 1e-6, i


def test_scores_go_by_the_text_alone(spark, labelled):
    """A copy under another id, in another source, scores as its original, labelled or not."""
    taught = labelled.where("doc_id < 160").select("doc_id", F.col("toxic").alias("label"))
    copies = labelled.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 50_000)
    scored = toxicity.score_toxicity(labelled.where("doc_id is not null").unionAll(copies), taught)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(got) == 484 and all(got[i] == got[i + 50_000] for i in got if i < 50_000)


def test_toxicity_from_few_labels(spark):
    """Three toxic examples tie no single term surely to toxicity; the search still runs over all terms."""
    rows = [(i, " ".join(words(40, 900 + i, 2000) + (["scum", "idiot"] if i % 8 == 0 else []))) for i in range(40)]
    taught = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(24)], "doc_id long, label int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), taught).collect()}
    assert got[24]["score"] >= 0.3 and got[32]["score"] >= 0.3 and set(got[24]["evidence"]) >= {0, 8, 16}
    clean = [got[i] for i in range(25, 40) if i % 8]
    assert all(r["evidence"] for r in clean) and max(r["score"] for r in clean) < min(got[24]["score"], got[32]["score"])


def test_block_max_search_is_exact():
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 2), sorted(rng.choice(40, 5, replace=False).tolist()), rng.integers(1, 4, 5).tolist()) for i in range(300)]
    index = toxicity.BlockMaxIndex(rows, rng.uniform(1, 3, 40), (1.0, 1.0))
    dense = {}
    for i, _, at, n in rows:
        v = np.zeros(40)
        where, w = index.vector(at, n)
        v[where] = w
        dense[i] = v
    for i, _, at, n in rows[:20]:
        who, cosine = index.nearest(at, n, 7)
        want = sorted((dense[i] @ dense[j] for j in dense), reverse=True)[:7]
        assert np.allclose(cosine, want) and abs(cosine[0] - 1) < 1e-9


def test_quality_finds_held_out(spark, labelled):
    taught = labelled.where("doc_id < 160 or doc_id is null").select("doc_id", F.col("good").alias("label"))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(labelled, taught).collect()}
    assert len(got) == 243 and all((got[i] >= 0.7) == (i % 3 != 0) for i in range(160, 240)) and 0 <= got[1001] <= 1
    assert {r["score"] for r in quality.score_quality(labelled, taught.limit(0)).collect()} == {0.5}


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    bounds, score, move = np.array([0, 3, 4]), rng.normal(size=4), rng.normal(size=(2, 2))
    good, pairs, total = quality.forward_backward(score, move, bounds)
    expected, want_pairs = np.zeros(4), np.zeros((2, 2))
    for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        paths = list(product((0, 1), repeat=b - a))
        s = np.array([sum(score[a + k] * y for k, y in enumerate(p)) + sum(move[p[k], p[k + 1]] for k in range(len(p) - 1)) for p in paths])
        z = np.log(np.exp(s).sum())
        assert np.isclose(z, total[t])
        for p, v in zip(paths, np.exp(s - z), strict=True):
            expected[a:b] += np.array(p) * v
            for k in range(len(p) - 1):
                want_pairs[p[k], p[k + 1]] += v
    assert np.allclose(good, expected) and np.allclose(pairs, want_pairs)


@pytest.mark.skipif(not __import__("os").path.exists(sentencepieces.MODEL), reason="no model here")
def test_encoding_equals_the_library_and_comes_back(spark, docs):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepieces.MODEL)
    rng = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "é", "😀", "aaa", "ing", "12", "▁", ".", "中", "    ", "\x00", "return"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionAll(docs.select("doc_id", "text"))
    encoded = sentencepieces.encode_documents(more)
    got = {r["doc_id"]: r for r in encoded.collect()}
    for r in more.collect():
        row = got[r["doc_id"]]
        if r["text"] is None:
            assert row["ids"] is None and row["n_ids"] is None
        else:
            assert row["ids"] == library.encode(r["text"]) and row["n_ids"] == len(row["ids"])
            assert row["round_trip"] or "▁" in r["text"]
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode_documents(encoded).collect()}
    assert all(back[i] == library.decode(r["ids"]) for i, r in got.items() if r["ids"] is not None and "\x00" not in (back[i] or ""))


def field(number, value):
    """A protocol-buffer field with bytes or a small number in it."""
    if isinstance(value, int):
        return bytes([number << 3, value])
    size, out = len(value), bytes([number << 3 | 2])
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return out + bytes([size]) + value


@pytest.mark.skipif(not __import__("os").path.exists(sentencepieces.MODEL), reason="no model here")
@pytest.mark.parametrize("kind", ["unigram", "map", "user", "map and user"])
def test_other_models_equal_the_library(kind):
    """The installed model, changed to other kinds that need no training."""
    library = pytest.importorskip("sentencepiece")
    with open(sentencepieces.MODEL, "rb") as f:
        model = f.read()
    if kind == "unigram":
        model += field(2, field(3, 1))
    if "map" in kind:
        rules = library.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        blob = dict(sentencepieces._wire(dict(sentencepieces._wire(rules))[3]))[2]
        model += field(3, field(2, blob))
    if "user" in kind:
        model += field(1, field(1, b"<tool>") + field(3, 4)) + field(1, field(1, b"<tool>ing") + field(3, 4))
    want, fst = library.SentencePieceProcessor(model_proto=model), sentencepieces.Transducer(model)
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "é", "e\u0301", "ﬁ", "①", "ing", "<tool>", "<tool>", "12", ".", "中", "return", "ＡＢ", "쀀", "　", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text, ids in zip(texts, fst.encode_all(texts), strict=True):
        if kind == "unigram":  # piece scores are ranks here, with many near-ties: the path is at least as good as the library's
            total = lambda found: sum(want.get_score(i) for i in found)
            assert fst.decode(ids) == want.decode(ids.tolist()) and total(ids.tolist()) >= total(want.encode(text)) - 1e-3, text
        else:
            assert ids.tolist() == want.encode(text), text


def test_mixing_counts_and_shares(spark, docs):
    rows = [(i, "x" * 50, "en", "big" if i % 10 else "small", 50) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(df, {"big": 1.0, "small": 1.0}, seed=5)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 1500) < 150 and abs(n["big"] - 1500) < 150
    again = mixing.mix_sources(df.repartition(7), {"big": 1.0, "small": 1.0}, seed=5)
    assert sorted((r["doc_id"], r["copy"]) for r in out.select("doc_id", "copy").collect()) == sorted((r["doc_id"], r["copy"]) for r in again.select("doc_id", "copy").collect())
    odd = mixing.mix_sources(docs.withColumn("rate", F.lit(1)))
    assert odd.columns == [*docs.columns, "rate", "copy"] and odd.count() > 0
    assert mixing.mix_sources(empty(spark)).count() == 0
    large = mixing.mix_sources(df, {"big": 1e-9, "small": 1.0}, rate=100).groupBy("source").count().collect()  # a rate of 1000 from given weights
    assert {r["source"] for r in large} == {"small"} and abs(large[0]["count"] - 300_000) < 3_000


@pytest.mark.parametrize("size", [40_000, 4_000_000])
def test_mixing_repeats_a_tiny_source_beside_large_ones(spark, size):
    """At rates over 64, and over 745 where exp(-rate) is 0, counts invert the Poisson distribution."""
    big = spark.createDataFrame([(1000, "x", "en", "big", size)], DOCS).withColumn("text", F.expr(f"repeat('x', {size})"))
    tiny = spark.createDataFrame([(i, "x" if i == 0 else "", "en", None, 1) for i in range(8)], DOCS)
    mean = (size + 1) / (math.sqrt(size) + 1)
    assert mean > 64
    want = {}
    for i in range(8):
        u, n, total = int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:13], 16) / 2**52, 0, 0.0
        while (total := total + math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))) <= u:
            n += 1
        want[i] = n
    got = mixing.mix_sources(big.unionAll(tiny)).where("source is null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"))
    assert {r["doc_id"]: (r["n"], r["last"]) for r in got.collect()} == {i: (n, n) for i, n in want.items()}


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head</h1><p>one &amp; two<br>three<p>four <b>five</b>'
    '<ul><li>x<li>y</ul><div class="comments"><p>me too</p></div><script>var t = "</p>";</script></article><footer>foot</footer>'
)


def kept(page):
    return [t for t, _ in htmltext.blocks(page)[0]]


def test_marked_article(spark):
    assert kept(PAGE) == ["Head", "one & two three", "four five", "x", "y"] and htmltext.blocks(PAGE)[1]
    assert htmltext.blocks("") == ([], False) and kept("a < b <") == ["a < b <"]
    assert kept('<div id="content" class="no-sidebar"><p>kept</p></div><div>side</div>') == ["kept"]


@pytest.mark.parametrize("gone", [
    "<nav>x</nav>", "<aside>x</aside>", "<footer>x</footer>", "<form><p>x</p></form>", "<script>x</script>", "<style>x</style>", "<noscript>x</noscript>", "<button>x</button>", "<select><option>x</option></select>",
    "<textarea>x</textarea>", "<template>x</template>", "<svg><text>x</text></svg>", "<iframe>x</iframe>", "<dialog>x</dialog>", "<menu><li>x</li></menu>", "<div hidden>x</div>", '<p style="display: none">x</p>', '<div aria-hidden="true">x</div>',
    '<div role="navigation">x</div>', '<div role="alert">x</div>', '<div class="ad">x</div>', '<div class="advert-box">x</div>', '<ul class="breadcrumbs">x</ul>', '<div id="comments">x</div>', '<div class="comment-list">x</div>', '<div class="sidebar">x</div>',
    '<div class="newsletter">x</div>', '<div class="cookie-banner">x</div>', "<!-- x -->", '<div class="share"><a href="#">x</a></div>', '<div class="related"><a>x</a></div>',
])
def test_furniture_inside_an_article_goes(gone):
    assert kept(f"<article><p>before</p>{gone}<p>after</p></article>") == ["before", "after"]


@pytest.mark.parametrize("stays", [
    '<div class="share-price">x</div>', '<section class="legal">x</section>', '<div class="social-history">x</div>', '<div class="notice">x</div>', "<header><p>x</p></header>", '<div class="header">x</div>', "<label>x</label>", "<object>x</object>",
    "<math><mi>x</mi></math>", '<div class="menu-reform">x</div>', '<div class="ad-hoc">x</div>', "<fieldset>x</fieldset>", '<div class="search-for-truth">x</div>',
])
def test_names_alone_decide_nothing_inside_an_article(stays):
    assert kept(f"<article><div>before</div>{stays}<div>after</div></article>") == ["before", "x", "after"]


def test_suffix_array_decides_names_in_doubt(spark):
    """The same element stays where it is the page's own and goes where the host repeats it."""
    line = "please read our legal notice before you use this paper"
    page = lambda i, text: f'<article><p>{" ".join(words(20, i))}</p><div class="legal">{text}</div></article>'
    rows = [(i, "http://one/", page(i, line)) for i in range(3)] + [(9, "http://one/", page(9, "a court has said something new about the old case"))] + [(20 + i, "http://two/", page(20 + i, line)) for i in range(2)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(line not in got[i] for i in range(3)) and "court" in got[9] and all(line in got[20 + i] for i in range(2))


def test_revisions_and_quotes_stay(spark):
    story = [" ".join(words(25, 300 + k)) for k in range(8)]
    body = lambda parts: "".join(f"<p>{t}</p>" for t in parts)
    rows = [(1, "http://h/", body(story)), (2, "http://h/", body([*story[:7], " ".join(words(25, 400))])), (3, "http://h/", body(story))]
    quote = " ".join(words(30, 500))
    rows += [(10 + k, "http://h/", body([" ".join(words(25, 600 + k)), quote])) for k in range(2)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[3] == "\n\n".join(story) and got[2].startswith("\n\n".join(story[:7])) and all(quote in got[10 + k] for k in range(2))


def test_longest_repeats_equal_brute_force(spark):
    rng = random.Random(12)
    passages = [[f"p{k}w{j}" for j in range(12)] for k in range(4)]
    pages = []
    for i in range(12):
        text = [f"u{rng.randrange(12)}" for _ in range(10)]
        for k in rng.sample(range(4), 2):
            text += passages[k][rng.randrange(3) : 12 - rng.randrange(3)] + [f"u{rng.randrange(12)}" for _ in range(4)]
        pages.append(text)
    contents = htmltext._content(htmltext.Words(htmltext.pa.array([" ".join(p) for p in pages], htmltext.pa.large_string())))
    want = set()
    for i, page in enumerate(pages):
        for at in range(len(page) - htmltext.DEPTH + 1):
            for size in range(min(htmltext.SPAN, len(page) - at), htmltext.DEPTH - 1, -1):
                part = page[at : at + size]
                if len({contents[j] for j, other in enumerate(pages) if any(other[k : k + size] == part for k in range(len(other)))}) >= htmltext.PAGES:
                    want.add((i, at, size))
                    break
    df = spark.createDataFrame([(i, 7, f"<p>{' '.join(p)}</p>") for i, p in enumerate(pages)], "page_id long, host long, html string")
    suffixes = df.mapInArrow(htmltext._suffixes, htmltext._SUFFIX)
    assert {(r["page_id"], r["at"], r["words"]) for r in htmltext.repeated_places(suffixes).collect()} == want and len(want) > 30
    heavy = [(r["page_id"], r["at"], r["words"]) for r in htmltext.repeated_places(suffixes, limit=0).collect()]
    assert len(heavy) == len(want) and set(heavy) == want  # beginnings that are counted give the same lengths as sorted ones


def test_length_of_repeats_decides(spark):
    """Six words that three pages share are a phrase; in a longer block they are no evidence, as a whole block they are."""
    phrase = "as far as we know today"
    block = lambda i: f"{' '.join(words(2, 70 + i))} {phrase} {' '.join(words(1, 80 + i))}"
    page = lambda i, text: f'<article><p>{" ".join(words(20, i))}</p><div class="legal">{text}</div></article>'
    long = " ".join(words(14, 9))
    rows = [(i, "http://a/", page(i, block(i))) for i in range(4)] + [(10 + i, "http://b/", page(10 + i, phrase)) for i in range(4)]
    rows += [(20 + i, "http://c/", page(20 + i, f"{long} {words(1, 90 + i)[0]}")) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(phrase in got[i] for i in range(4)) and not any(phrase in got[10 + i] for i in range(4)) and not any(long in got[20 + i] for i in range(4))


@pytest.mark.parametrize("odd", ["<a ", '<a title="x ', "<div>", "<p><b>", "<", "</", "<!--", "<![CDATA[", "<script>", "<li><b>", "<article>", "<b><i></p>"])
def test_malformed_megabyte_takes_seconds(odd):
    began = time.perf_counter()
    htmltext.blocks(odd * (1_000_000 // len(odd)))
    assert time.perf_counter() - began < 20


def test_unfinished_tags_and_odd_quotes():
    assert kept('hi <a title="x>y z') == ["hi"] and kept("hi <b") == ["hi"] and kept("a <!-- b") == ["a"] and kept("1 < 2 </ x>3") == ["1 < 2 3"]
    assert kept("<p title='a>b'>x</p><p class=a\"b>y</p>") == ["x", "y"] and kept('<a href=x">link</a> z') == ["link z"]


@pytest.mark.parametrize("wrapper", [
    '<div class="content-sidebar-wrap">{}</div>', '<div class="menu-open page">{}</div>', '<div class="header-fixed">{}</div>', '<div class="ads-enabled">{}</div>', '<div id="sidebar-left">{}</div>', '<form id="aspnetForm">{}</form>',
    "<header>{}</header>", '<div class="modal-ready"><div class="social">{}</div></div>', '<section class="comments-on">{}</section>', '<div role="form">{}</div>', '<td class="related">{}</td>',
])
def test_what_wraps_the_article_stays(wrapper):
    beside = '<nav>menu</nav><div class="sidebar"><article><p>teaser</p></article></div><div class="comments"><p>me too</p></div>'
    article = "<article><h1>Head</h1><p>one two three four</p></article>"
    assert kept(wrapper.format(article + beside)) == ["Head", "one two three four"] or "comments" in wrapper
    plain = "<h1>Head</h1><p>one two three four</p>"
    assert kept(wrapper.format(plain + "<nav>menu</nav>") + "<p>x</p>")[:2] == ["Head", "one two three four"] or "comments" in wrapper


def test_planted_pages_give_their_articles(spark, tmp_path):
    """The whole query on pages put together from articles and furniture, whose text is known."""
    rng = random.Random(8)
    around = ["<nav><ul><li><a>menu</a></ul></nav>", '<div class="ad">buy now</div>', "<aside><p>side</p></aside>", "<footer>foot</footer>", '<div class="cookie-banner"><p>we use them</p></div>', "<form><p>mail</p></form>", '<div id="comments"><p>me too</p></div>', "<script>if (a < b) x()</script>"]
    inside = ["<script>var t='</p>'</script>", '<div class="newsletter"><p>join</p></div>', "<!-- <p>no</p> -->", '<ul class="breadcrumbs"><li>home</ul>', "<style>p{}</style>"]
    rows, want = [], {}
    for i in range(120):
        parts, text = [], []
        for k in range(rng.randrange(1, 6)):
            said = words(rng.randrange(1, 30), 1000 + 10 * i + k)
            text.append(" ".join(said) + " & <b> é")
            parts.append(f"<{(tag := rng.choice(['p', 'h2', 'div', 'blockquote']))} class='c{k}'>" + rng.choice([" ", "\n\t", "<br>", " <i></i> "]).join(said) + f" &amp; &lt;b&gt; <b>&eacute;</b></{tag}>")
            parts += rng.sample(inside, rng.randrange(3))
        mark = rng.choice(["article", "main"])
        page = "".join(rng.sample(around, rng.randrange(5))) + f"<{mark}>{''.join(parts)}</{mark}>" + "".join(rng.sample(around, rng.randrange(5)))
        rows.append((i, f"http://h{i % 3}/", rng.choice(["<html><body>{}</body></html>", '<div class="header-wrap">{}</div>', "{}"]).format(page)))
        want[i] = "\n\n".join(text)
    spark.createDataFrame(rows + [(900, None, None), (901, "x", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in queries.op8_html_text(spark, str(tmp_path)).collect()}
    assert {i: got[i]["text"] for i in want} == want and all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[900]["text"] == got[901]["text"] == ""


def test_suffix_array_drops_what_a_host_repeats(spark):
    chrome = "<div>all the sections of our great daily paper</div>"
    rows = [(i, "http://host/a", f"{chrome}<p>{' '.join(words(30, 50 + i))}</p><div>read more stories from our daily paper now</div>") for i in range(4)]
    rows += [(10, "http://other/", f"{chrome}<p>alone here</p>"), (11, "http://host/b", None), (12, None, PAGE), (13, "http://host/c", chrome), (None, "http://host/d", "<p>no id</p>")]
    got = {r["page_id"]: r for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i]["text"] == " ".join(words(30, 50 + i)) and got[i]["n_chars"] == len(got[i]["text"])
    assert got[10]["text"] == "all the sections of our great daily paper\n\nalone here"
    assert got[11]["text"] == "" and got[12]["text"].startswith("Head") and got[None]["text"] == "no id"
    assert got[13]["text"] == "all the sections of our great daily paper"  # nothing else: a copy, kept whole
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- odd tables, for every operator

CLASHES = ("score", "label", "id", "n", "v", "copy", "rate", "mass", "key", "row", "component", "component_id", "kept", "anchor", "anchors", "windows", "low", "high", "host", "head", "content", "repeated", "digest", "keep", "bytes", "record_type", "query_id", "part", "turn", "rank", "u", "d", "i", "j", "regs", "f1", "n_shingles", "term", "cdf", "total", "__n", "__source", "__key", "ids", "held_out", "so_far", "lines")


def labels_of(docs):
    return docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))


OPERATORS = {
    "warc": ("pages", lambda spark, t: warc.page_archive_records(spark, t).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")),
    "topk": ("embeddings", lambda spark, t: topk.top_k(t, "vec_id % 2 = 0", k=3)),
    "minhash": ("documents", lambda spark, t: minhash.near_duplicates(t, k=4)),
    "substring": ("documents", lambda spark, t: substring.remove_repeats(t).select("doc_id", "n_words", "n_removed", "kept_text")),
    "toxicity": ("documents", lambda spark, t: toxicity.score_toxicity(t, labels_of(t)).select("doc_id", "score")),
    "sentencepieces": ("documents", lambda spark, t: sentencepieces.encode_documents(t)),
    "mixing": ("documents", lambda spark, t: mixing.mix_sources(t)),
    "htmltext": ("pages", lambda spark, t: htmltext.extract_text(t)),
    "multiindex": ("embeddings", lambda spark, t: multiindex.near_vectors(t)),
    "quality": ("documents", lambda spark, t: quality.score_quality(t, labels_of(t))),
}


@pytest.fixture(scope="module")
def tables(spark, docs):
    long = " ".join(words(60_000, 77, 9000))
    pages = [(i, f"http://h/{i % 2}", f"<article><p>{' '.join(words(300, i % 4))}</p></article>") for i in range(8)] + [(8, None, None), (9, "http://h/", ""), (10, "http://h/", f"<p>{long}</p>"), (None, "u", "<p>x</p>")]
    return {
        "documents": docs.unionAll(spark.createDataFrame([(900, long, "en", "s1", len(long))], DOCS)),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"), "embeddings": vectors(spark)[1],
    }


def as_text(rows):
    return sorted(str({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict(True).items()}) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_repeated_rows_and_empty_tables(spark, tables, name):
    if name == "sentencepieces" and not __import__("os").path.exists(sentencepieces.MODEL):
        pytest.skip("no model here")
    table, run = OPERATORS[name]
    own = tables[table]
    want = run(spark, own)
    rows = want.collect()
    extra = own.select("*", *[F.lit(7).alias(c) for c in CLASHES if c not in own.columns])
    got = run(spark, extra)
    if name == "mixing":
        assert got.columns == [*extra.columns, "copy_"] and len(set(got.columns)) == len(got.columns)
        got = got.select(*own.columns, F.col("copy_").alias("copy"))
    assert as_text(got.collect()) == as_text(rows)
    assert run(spark, own.limit(0)).collect() == []
    key = own.columns[0]
    twice = run(spark, own.unionAll(own.where(f"{key} is not null")))
    assert twice.columns == want.columns
    again = twice.collect()
    once = {r[key if name != "topk" else "query_id"] for r in again}
    assert once == {r[key if name != "topk" else "query_id"] for r in rows}
    if name in ("minhash", "substring", "sentencepieces", "htmltext", "multiindex"):  # repeated rows change nothing but their number
        named = lambda found: {str(sorted(r.asDict(True).items())) for r in found}
        assert named(again) == named(rows)


def test_lines_differ_inside_bad_documents():
    """One bad line among good ones: the field finds which, though only documents are labelled."""
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "house", "of", "green", "river", "walks", "slowly"]) for _ in range(9))
    bad = lambda: " ".join("%$#@" + str(rng.randrange(99)) for _ in range(9))
    texts = ["\n".join(good() for _ in range(6)) if k % 2 else "\n".join(good() if j < 3 else bad() for j in range(6)) for k in range(80)]
    x, size, bounds = quality.line_features(quality.Words(quality.pa.array(texts, quality.pa.large_string())))
    wide = quality.with_neighbours(x, bounds)
    field = quality.LineField(wide.shape[1]).fit(wide, size, bounds, np.arange(80) % 2, np.ones(80))
    want = np.array([[1] * 6 if k % 2 else [1, 1, 1, 0, 0, 0] for k in range(80)]).ravel()
    assert (field.lines == want).mean() > 0.95 and (field.lines == want).reshape(80, 6)[1::2].all()
    assert ((field.score(wide, size, bounds) >= 0.7) == (np.arange(80) % 2 == 1)).all()
