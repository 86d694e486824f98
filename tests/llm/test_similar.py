"""Similar documents and the near-dedup stage against exact Jaccard similarity."""

import random

import pytest
from pyspark.sql import Row

import corpus_pipeline
from attesta.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(4, 9))) for _ in range(n)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def table_of(spark, rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en", source="x", n_chars=len(t or "")) for i, t in rows], SCHEMA)


def test_pairs_at_exactly_080_and_075(spark):
    rng, texts = random.Random(5), []
    for n, shared in ((90, 80), (91, 78)):
        for _ in range(60):
            base = words(rng, n + 4)
            texts += [" ".join(base), " ".join(base[: shared + 4] + words(rng, n - shared))]
    sets = [shingles(t) for t in texts]
    assert {len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 240, 2)} == {0.8, 0.75}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table_of(spark, enumerate(texts))).collect()}
    assert sum(got[i + 1] == i for i in range(0, 120, 2)) >= 59
    assert all(got[i] == i for i in range(120, 240))


@pytest.mark.parametrize("block", [1024, 4])
def test_components_against_exact_links(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", min(block, 64))
    monkeypatch.setattr(simhash, "SHINGLES", 200 * block)
    rng, texts = random.Random(6), []
    for _ in range(4):
        text = words(rng, 204)
        for _ in range(25):
            texts.append(" ".join(text))
            if rng.random() < 0.4:
                text = texts[rng.randrange(len(texts) - len(texts) % 25 if len(texts) % 25 else len(texts) - 25, len(texts))].split()
            at = rng.randrange(0, 190)
            n = rng.choice((3, 10, 18, 24))
            text = text[:at] + words(rng, n) + text[at + n :]
    sets = [shingles(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(table_of(spark, enumerate(texts))).collect()}
    assert 4 < len(set(want)) < 80
    assert [got[i] for i in range(len(texts))] == want


def near_dedup(spark, rows):
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, table_of(spark, rows), None).collect()), key=str)


def test_rows_without_id_and_with_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, d), (3, c), (3, d), (4, e), (4, e)]
    # Copies of texts with an id go, one row without id stays for its own text, and id 3 keeps one of its texts only.
    assert near_dedup(spark, rows) == sorted([(1, a), (None, b), (3, c), (2, d), (4, e)], key=str)
    assert near_dedup(spark, []) == []


def test_a_large_place_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(8)
    base = rng.getrandbits(256)
    prints = [(i, (base ^ (1 << rng.randrange(256))).to_bytes(32, "big")) for i in range(1000)]
    classes = spark.createDataFrame(prints, "node long, fp binary")
    sizes = simhash._dealt(classes).groupBy("place", "salt").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 100
    assert sizes.agg({"count": "sum"}).first()[0] == 1000 * simhash.WIDE_TABLES
