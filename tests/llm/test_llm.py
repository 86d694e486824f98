"""The ten training-data operators against brute force, and on rows that break careless code."""

import math
import random
import re
import timeit
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import components, decontaminate, embeddings, licenses, lines, packing, quality, queries, simhash, spans, toxicity, urls
from attesta.llm.common import shared_dir, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "   \n\n "), (None, "a b c d e f"), (5, "x " * 3000), (6, "é ß 漢字 \U0001f600\n" * 3)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats and ties, with columns named like those that operators make."""
    rows = [(i, t, None, "s", None, "h", "p", 7) for i, t in ODD]
    return spark.createDataFrame(rows, DOC + ", fp string, component_id string, n_removed int")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == shared_dir(spark)


# Components


@pytest.mark.parametrize("chunk", [1 << 20, 8])
def test_components_of_chains_and_stars(spark, chunk, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(60)] + [(7, None), (9000, 9000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in root}
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == want
    assert len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 URL filters


def brute_verdict(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    labels, parts = ["a", "b", "com", "net", "x"], ["", "/", "/e", "/en", "/en/", "/en/7", "/de/8?q=/en/", "#/en/"]
    made = [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))}{rng.choice(parts)}" for _ in range(400)]
    made += [None, "", "no scheme", "HTTP://A.COM/en/7", "http://", "ftp://x.com:80/e", "http://a..com/en/", "http://é.COM/en/", "a://b://com/en/", "http://com\n/en/"] * 2
    rules = [("block", "com", "/en/"), ("allow", "a.com", "/en/7"), ("block", "net", ""), ("allow", "b.net", "/e"), ("block", "x", "/en"), ("allow", "x", "/en/"), ("allow", "com", "/")]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(made)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.rule_table(spark, rules)).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(made)}


def test_urls_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, urls.rule_table(spark)).count() == 0
    rules = spark.createDataFrame([("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    one = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urls.judge(one, rules).first()["verdict"] == "allow"


# 2 Benchmark decontamination


def brute_matches(text, item):
    w, b = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in (text, item))
    grams = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
    best = 0.0
    for s in range(max(1, len(w) - len(b) + 1)):
        x, y = grams(w[s : s + len(b)]), grams(b)
        low = sum(min(x.count(g), y.count(g)) for g in set(x))
        high = sum(max(x.count(g), y.count(g)) for g in {*x, *y})
        best = max(best, low / high if high else 0)
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(rng.randrange(18, 50))) for _ in range(12)]
    texts = []
    for k in range(120):
        item = items[k % 12].split()
        for _ in range(rng.choice((0, 0, 1, 2, 5, 20))):
            item[rng.randrange(len(item))] = word()
        texts.append(" ".join([word() for _ in range(rng.randrange(60))] + item * (k % 3 > 0) + [word() for _ in range(rng.randrange(60))]))
    found = decontaminate.matches(docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    want = {(d, i) for d, t in enumerate(texts) for i, b in enumerate(items) if brute_matches(t, b) >= 0.8}
    assert got == want
    assert len(want) > 20


def test_hamming_index_is_exact():
    rng = random.Random(9)
    held = [rng.getrandbits(64) for _ in range(300)]
    index = decontaminate.HammingIndex(held, radius=20, blocks=7)
    for f in held[:20]:
        for flips in (0, 7, 20, 21):
            g = f ^ sum(1 << b for b in rng.sample(range(64), flips))
            assert index.within(g) == {i for i, x in enumerate(held) if (x ^ g).bit_count() <= 20}


def items_of(texts, shingle=5):
    codes = [decontaminate.shingle_codes(decontaminate.word_codes(t.encode()), shingle) for t in texts]
    held = [set(c.tolist()) for c in codes]
    weigh = {c: math.log1p(len(texts) / sum(c in h for h in held)) for h in held for c in h}
    rows = [(i, len(t.split()), c.view(np.int64).tolist(), [weigh[x] for x in c.tolist()]) for i, (t, c) in enumerate(zip(texts, codes, strict=True))]
    return decontaminate.Items(rows, len(texts), shingle, 0.8, 20, 7), codes


@pytest.mark.parametrize(("windows", "candidates"), [(4096, 1 << 20), (3, 5)])
def test_no_window_is_passed_over(monkeypatch, windows, candidates):
    # Few words, so that items share many shingles; all windows of all items are compared one by one.
    monkeypatch.setattr(decontaminate, "WINDOWS", windows)
    monkeypatch.setattr(decontaminate, "CANDIDATES", candidates)
    rng = random.Random(11)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    texts = []
    for k in range(120):
        at, n = rng.randrange(300), rng.choice((20, 33, 60))
        item = base[at : at + n]
        for _ in range(k % 3):
            item[rng.randrange(n)] = rng.choice("abcdefgh")
        texts.append(" ".join(item))
    items, codes = items_of(texts)
    words = base + [rng.choice("abcdefgh") for _ in range(200)] + base[50:200]
    mine = decontaminate.shingle_codes(decontaminate.word_codes(" ".join(words).encode()), 5)
    want = {}
    for k, c in enumerate(codes):
        known = items.weights[k]
        for lo in range(len(mine) - len(c) + 1):
            s = decontaminate.weighted_jaccard(mine[lo : lo + len(c)], c, lambda x: known.get(x, items.rare))  # noqa: B023
            if s >= 0.8:
                want.setdefault(k, []).append((lo, s))
    found = items.find(" ".join(words).encode())
    assert {i for i, *_ in found} == set(want)
    assert len(want) > 20
    for k, all_of in want.items():
        got = sorted((start, n) for i, start, n, _ in found if i == k)
        assert all(a + n <= b for (a, n), (b, _) in zip(got, got[1:], strict=False))
        assert max(s for i, *_, s in found if i == k) == pytest.approx(max(s for _, s in all_of))


def test_decontamination_of_long_texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(2000)]
    items, _ = items_of(texts)
    words = []
    while len(words) < 100_000:
        words += [rng.choice(vocab) for _ in range(31)] + texts[rng.randrange(2000)].split()[3:8]
    words[70_000:70_040] = texts[7].split()
    raw = " ".join(words).encode()
    began = timeit.default_timer()
    assert [f[:3] for f in items.find(raw)] == [(7, 70_000, 40)]
    assert timeit.default_timer() - began < 10
    once, _ = items_of(["a a a a a a"])
    assert len(once.find(b"a " * 30_000)) == 5000


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "a b c d e f"), (4, "a b c d e f")], "item_id long, text string")
    got = decontaminate.matches(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(None, 4)}
    assert decontaminate.clean(odd, bench).count() == len(ODD)
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0
    assert decontaminate.matches(odd.limit(0), bench).count() == 0


def test_short_items_and_blocks_of_items(spark, monkeypatch):
    docs = docs_of(spark, ["say yes we can now", "yes we", "a b c d e f g", "nothing"])
    bench = spark.createDataFrame([(1, "Yes we can"), (2, "a b c d e f g"), (3, "")], "item_id long, text string")
    places = lambda **o: {(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in decontaminate.matches(docs, bench, **o).collect()}
    assert places() == {(2, 2, 0, 7)}
    assert places(least=1) == {(0, 1, 1, 3), (2, 2, 0, 7)}
    monkeypatch.setattr(decontaminate, "ITEMS", 1)
    assert places(least=1) == {(0, 1, 1, 3), (2, 2, 0, 7)}


# 3 Line dedup


def brute_lines(docs, k):
    first, gone = {}, defaultdict(set)
    real = {d: [i for i, x in enumerate(t.split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)] for d, t in docs}
    for d, t in docs:
        ls, at = t.split("\n"), real[d]
        for p in range(len(at) - k + 1):
            run = tuple(ls[i] for i in at[p : p + k])
            if first.setdefault(run, (d, p)) != (d, p):
                gone[d].update(at[p : p + k])
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in docs}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_lines_against_brute_force(spark, k):
    rng = random.Random(k)
    docs = [(d, "\n".join(rng.choice(["a", "b", "c", "d e", "", "  ", "é"]) for _ in range(rng.randrange(0, 14)))) for d in range(80)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()}
    assert got == brute_lines(docs, k)


def test_runs_are_maximal(spark):
    df = docs_of(spark, ["a\nb\nc\nd", "x\na\nb\nc\nd\ny", "b\nc\nz"])
    assert {(r["id"], r["start"], r["n_lines"]) for r in lines.repeated_runs(df, 2).collect()} == {(1, 1, 4), (2, 0, 2)}


def test_lines_of_odd_rows(spark, odd):
    got = lines.dedup_lines(odd, 2)
    assert got.count() == len(ODD)
    assert {(r["doc_id"], r["text"], r["n_lines"]) for r in got.where("doc_id < 4").collect()} == {(1, None, 0), (2, "", 1), (3, "one", 1)}
    assert got.where("doc_id = 6").first()["n_removed"] == 2
    assert lines.dedup_lines(odd.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(odd, 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


# 4 License scans


@pytest.mark.parametrize(
    ("text", "base", "labels"),
    [
        ("Released under the MIT License.", "mit", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by", "cc-by,cc-by-nc"), ("licensed under the terms of the GNU Lesser General Public License, version 3", "", "gpl"),
        ("the GNU General Public License", "gpl", "gpl"), ("apachelicense mit, license: apache\nlicense", "apache,mit", "apache,mit"), ("Licensed under the Creative Commons Attribution 4.0 International License", "", "cc-by"),
        ("Licensed under the Creative Commons Attribution one two three four five License", "", ""), ("permit license", "", ""), ("", "", ""),
    ],
)
def test_license_labels(spark, text, base, labels):
    r = licenses.scan(docs_of(spark, [text])).first()
    assert (r["base_labels"], r["labels"]) == (base, labels)


def test_license_places_against_brute_force(spark):
    rng = random.Random(1)
    pool = "mit license apache cc by gnu general public é ß9 x".split()
    texts = ["".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(60)) for _ in range(40)]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        assert got[d] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_templates():
    with pytest.raises(ValueError):
        licenses.compile_template("x", "<<beginOptional>>a")
    with pytest.raises(ValueError):
        licenses.compile_template("x", "<<var;3>> a")
    a = licenses.compile_template("x", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;2>> e")
    said = lambda t: a.accepts(t.encode().split(), 0)
    assert [said(t) for t in ("a d e", "a b d e", "a b c d x e", "a b c d x y e", "a d x y z e", "a c d e", "a d")] == [3, 4, 6, 7, None, None, None]


def test_licenses_of_odd_rows(spark, odd):
    assert licenses.scan(odd).count() == len(ODD)
    assert licenses.scan(odd.limit(0)).count() == 0


# 5 Embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((240, 32))
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + rng.standard_normal(32) * rng.uniform(0.01, 0.3)
        x[i + 2] = x[i] * 2
    x[200:210] = x[199]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [math.nan] * 32), (903, [None] * 32), (904, []), (None, x[0].tolist()), (905, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=4).collect()}
    assert len(got) == len(rows)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(240))
    assert found <= near.sum()
    assert found >= 0.97 * near.sum()
    assert all(got[i]["n_links"] >= 10 for i in range(199, 210))
    assert {got[i]["component_id"] for i in range(199, 210)} == {199}
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 5
    assert {r["vec_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] != 1} == {2: 1, 3: 1, 4: 0}


def test_embedding_query_recall(spark):
    v = table(spark, SF, "embeddings").toPandas()
    u = np.stack(v["embedding"].to_numpy()).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = queries.op5_embedding_near_dedup(spark, SF).toPandas().set_index("vec_id")["n_links"]
    want = dict(zip(v["vec_id"].tolist(), near.sum(axis=1).tolist(), strict=True))
    assert all(got[i] <= n for i, n in want.items())
    assert got.sum() >= 0.97 * near.sum()


@pytest.mark.parametrize("size", [32, 64, 384])
def test_recall_by_band_of_cosine(spark, size):
    rng, bands, each = np.random.default_rng(size), ((0.95, 0.955), (0.955, 0.96), (0.96, 0.97)), 400
    rows = []
    for k, (lo, hi) in enumerate(bands):
        a, b = rng.standard_normal((2, each, size))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        c = rng.uniform(lo + 1e-6, hi, (each, 1))
        rows += [(2 * (k * each + i) + j, v.tolist()) for i, pair in enumerate(zip(a, c * a + np.sqrt(1 - c * c) * b, strict=True)) for j, v in enumerate(pair)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("vec_id % 2 = 0").toPandas()
    for k in range(len(bands)):
        found = got[got["vec_id"].between(2 * k * each, 2 * (k + 1) * each - 1)]["n_links"]
        assert len(found) == each
        assert (found > 0).mean() >= 0.93


# 6 and 10 Learned scores


def auc(scores, marks):
    good, bad = ([s for s, m in zip(scores, marks, strict=True) if m == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "modulus", "held", "least"), [("op6_quality_classifier", "quality", 3, 1, 0.97), ("op10_toxicity", "toxic", 5, 0, 0.85)])
def test_held_out_accuracy(spark, name, label, modulus, held, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got) == table(spark, sf, "documents").count()
    assert got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % modulus == held) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    both = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    out = both[both["held_out"]]
    assert auc(out["score"].tolist(), out[label].tolist()) >= least


def test_scores_of_odd_rows(spark, odd):
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    ranker = quality.train(odd, marks)
    scores = {r["doc_id"]: r["score"] for r in quality.score(odd, ranker).collect()}
    assert scores[1] == scores[2]
    assert quality.score(odd, ranker).count() == len(ODD)
    assert quality.train(odd.limit(0), marks).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.train(odd, marks.where("quality = 1")).score(np.zeros((1, len(quality.FEATURES))))[0] > 0.5
    lexicon = toxicity.learn(odd, marks.withColumnRenamed("quality", "toxic"))
    assert lexicon.weights == ()
    assert {r["score"] < 0.5 for r in toxicity.score(odd, lexicon).collect()} == {True}


def test_scores_depend_on_the_text_alone(spark):
    df = table(spark, SF, "documents")
    ranker = quality.train(df, table(spark, SF, "labels"))
    a = quality.score(df.select("doc_id", "text"), ranker).collect()
    b = quality.score(df.withColumn("lang", F.lit("zz")).repartition(7), ranker).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_marked_and_shouted_words_against_patterns():
    rng = random.Random(2)
    pool = ["A", "B", "É", "a", " ", "\n", "\t", "\v", "#", "!", "_", "0", ".", ")", "\x1c", "\x85", "漢"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(40))).encode()
        marked = re.findall(rb"[^\s.,;:'\")\]\w\x80-\xff]{2,}(?=\s|$)", text)
        shouted = re.findall(rb"(?:(?<=\s)|^)[A-Z\x80-\xff]{3,}[^a-z\s]*(?=\s|$)", text)
        assert quality._marked_and_shouted(np.frombuffer(text, dtype=np.uint8)) == (len(marked), len(shouted))


@pytest.mark.parametrize("unit", ["中", "ы", "#", " ", "A", "\n"])
def test_scoring_takes_time_in_line_with_the_text(unit):
    def took(n):
        text = (unit * n + "abc").encode()
        return min(timeit.repeat(lambda: (quality.features(text), toxicity.fold(text.decode())), number=1, repeat=3))

    assert took(1_000_000) < 8 * took(250_000) + 0.05


def test_folding_and_exceptions():
    assert toxicity.fold("Sсum, SCUM 5cum a$cum") == " scum scum scum ascum "
    assert toxicity.fold("1d10t!") == " idiot "
    assert toxicity.fold("") == "  "
    lexicon = toxicity.Lexicon((("trash", 5.0), ("achl*", 3.0)), ("trash can",))
    raw = lambda t: lexicon.raw(t.encode(), lexicon.automaton()) * math.log2(4 + toxicity.fold(t).count(" "))
    assert raw("Trash tr4sh") == pytest.approx(10)
    assert raw("the trash can") == 0
    assert raw("the trash can trash") == pytest.approx(5)
    assert raw("achlich achl trashy") == pytest.approx(3)


# 7 Sentence spans


def brute_sentences(text):
    """Sentences as lists of words, found character by character."""
    found, said, i = [], "", 0
    while i < len(text):
        said += text[i]
        j = i + 1
        while text[i] in ".!?…,;:" and j < len(text) and text[j] in "\"'”’“»«)]":
            j += 1
        if text[i] == "\n" or text[i] in "。！？，；：" or (text[i] in ".!?…,;:" and j < len(text) and text[j].isspace()):
            found.append(said)
            said = ""
            i = j if text[i] in ".!?…,;:" else i + 1
        else:
            i += 1
    return [s.lower().split() for s in [*found, said] if s.split()]


def brute_spans(docs, k=2, least=12):
    """Sentences of each document that lie in a run of ``k`` sentences and ``least`` words which stands before."""
    first, gone = {}, defaultdict(set)
    for d, t in docs:
        said = brute_sentences(t)
        for i in range(len(said)):
            for j in range(i + k, len(said) + 1):
                run = tuple(w for s in said[i:j] for w in s)
                if len(run) >= least:
                    if first.setdefault(run, (d, i)) != (d, i):
                        gone[d].update(range(i, j))
                    break
    return gone


GERMAN = "Morgen sah der alte Mann aus dem Haus in der Gasse, und die Katze lief ihm nach. Er rief: »Komm her!« Doch sie blieb stehen. Am Abend kam er wieder; die Tür war zu, das Licht war aus."
ENGLISH = "Yesterday the president met Angela Merkel in Berlin and I spoke to them. Later, over tea, we agreed. The minutes (all 12 pages) went out on Monday; nobody replied to Mr. Smith by Friday."


def test_sentences_of_two_languages():
    assert brute_sentences("Er rief: »Komm her!« Doch sie blieb.") == [["er", "rief:"], ["»komm", "her!"], ["doch", "sie", "blieb."]]
    for text in (GERMAN, ENGLISH, "a\n\n b. \tc", "一。二！三", "x,y 3.5 km. z", ""):
        assert [text[a:b].lower().split() for a, b in spans.sentences(text)] == brute_sentences(text)
    assert [" ".join(s) for s in brute_sentences(ENGLISH)][0] == "yesterday the president met angela merkel in berlin and i spoke to them."


def test_spans_set_into_running_text(spark):
    texts = [GERMAN, f"Vorher stand hier noch etwas {GERMAN} und so weiter", ENGLISH, f"we heard that {ENGLISH[10:]} and left", "Gut. Ja. Nein.", "Gut. Ja. Nein."]
    got = {r["doc_id"]: r["text"] for r in spans.dedup_spans(docs_of(spark, texts)).collect()}
    want = brute_spans(list(enumerate(texts)))
    for d, t in enumerate(texts):
        left = [w for i, s in enumerate(brute_sentences(t)) if i not in want[d] for w in s]
        bare = lambda said: re.sub("[«»]", "", said).split()
        assert bare(got[d].lower()) == bare(" ".join(left))
    assert "Katze" not in got[1] and got[1].startswith("Vorher stand hier noch etwas Morgen sah der alte Mann")
    assert got[4] == got[5] == "Gut. Ja. Nein."
    assert "agreed" not in got[3]


def test_spans_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(3, 14))).capitalize() + "."
    pool = [" ".join(sentence() for _ in range(8)) for _ in range(5)]
    docs = [(d, " ".join([sentence() for _ in range(rng.randrange(4))] + [word(), rng.choice(pool)] * (d % 2) + [sentence() for _ in range(rng.randrange(4))])) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(set)
    for r in spans.repeated_spans(df).collect():
        got[r["doc_id"]].update(range(r["start"], r["start"] + r["n_sentences"]))
    want = brute_spans(docs)
    assert {d: s for d, s in got.items() if s} == {d: s for d, s in want.items() if s}
    texts = dict(docs)
    for r in spans.dedup_spans(df).collect():
        kept = [texts[r["doc_id"]][a:b] for i, (a, b) in enumerate(spans.sentences(texts[r["doc_id"]])) if i not in want[r["doc_id"]]]
        assert r["text"].split() == " ".join(kept).split()
        assert r["n_removed"] == len(want[r["doc_id"]])


def test_passages_of_over_50_words_are_found(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(2, 7)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(3, 14))).capitalize() + "."
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(30)]
    docs = [f"{' '.join(word() for _ in range(30))} {passages[i % 30]} {sentence()}" for i in range(60)]
    found = {(r["first_doc_id"], r["doc_id"]) for r in spans.repeated_spans(docs_of(spark, docs)).collect()}
    assert found == {(i, i + 30) for i in range(30)}


def test_spans_of_odd_rows(spark, odd):
    assert spans.repeated_spans(odd).count() == 0
    cleaned = spans.dedup_spans(odd)
    assert cleaned.count() == len(ODD)
    assert cleaned.where("doc_id = 1").first()["text"] is None
    assert spans.repeated_spans(odd.limit(0)).count() == 0


# 8 Packing


def test_packing_round_trip(spark):
    df = table(spark, SF, "documents")
    got = packing.pack_documents(df, group=16, keep_ids=True).collect()
    encode = packing.Encoder(*packing.default_files())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert 1 <= r["length"] <= 2048
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    for d, text in df.select("doc_id", "text").collect():
        parts = sorted(by_doc[d], key=lambda r: r["start"])
        ids = [i for p in parts for i in p["ids"]]
        assert ids == encode.slow.encode(text or "", add_special_tokens=False).ids + [1]
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert {p["doc_tokens"] for p in parts} == {len(ids)}
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert sum(p["length"] for p in parts) <= 2048


def test_fast_ids_equal_the_tokenizers():
    encode = packing.Encoder(*packing.default_files())
    rng = random.Random(12)
    pool = ["a", " ", "\n", "\t", "é", "ß", "漢", "\U0001f600", "'s", "'LL", "12", "½", "٣", " ", "​", "﻿", "ǅ", "!!", "<|endoftext|>", "\r\n", "́", "\x00", "　"]
    for _ in range(400):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        assert encode(t.encode()).tolist() == encode.slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "a", "7", "#", "中", " \xa0"])
def test_ids_of_very_long_runs(unit):
    encode = packing.Encoder(*packing.default_files())
    for n in (9_000 // len(unit.encode()), 1_000_000):
        text = "x" + unit * n + "a"
        assert encode(text.encode()).tolist() == encode.slow.encode(text, add_special_tokens=False).ids


def test_packing_of_very_long_runs(spark):
    texts = ["x" + u * n + "a" for u in " \na7" for n in (1_000_000, 2_000_000)]
    rows = packing.pack_documents(docs_of(spark, texts)).collect()
    encode = packing.Encoder(*packing.default_files())
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(encode(t.encode())) + 1 for i, t in enumerate(texts)}
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_first_fit_decreasing_against_plain_search():
    rng = random.Random(3)
    for _ in range(20):
        sizes = np.array([rng.randrange(1, 65) for _ in range(rng.randrange(0, 80))], dtype=np.int64)
        where, offset = packing.first_fit_decreasing(sizes, 64)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(64)
            want[i] = (b, 64 - room[b])
            room[b] -= int(sizes[i])
        assert {i: (int(where[i]), int(offset[i])) for i in range(len(sizes))} == want


def test_packing_of_odd_rows(spark, odd):
    got = packing.pack_documents(odd)
    assert got.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == len(ODD)
    assert {r["length"] for r in got.where("doc_id in (1, 2)").collect()} == {1}
    assert packing.pack_documents(odd.limit(0)).count() == 0


# 9 SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force():
    rng = random.Random(8)
    texts = ["", " \t\x0b", "One", "one two", "A b C d", "é  ß\x85x y z", "\x1cx\x1dy z w"] + [" ".join(rng.choice("abcdeFG") for _ in range(rng.randrange(3, 90))) for _ in range(30)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("place", [512, 3])
def test_near_fingerprints_against_brute_force(spark, place, monkeypatch):
    monkeypatch.setattr(simhash, "PLACE", place)
    rng = random.Random(14)
    held = [0]
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            held.append(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4)))
    held += [0xF00 | 1 << b for b in range(16, 60)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in held})
    links = simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(f, f) == find(f) for f in signed)


def test_simhash_of_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 4)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_wide_bit_counts():
    h = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    for n in (0, 1, 48, 49, 145, 1000):
        want = [int(sum(int(x) >> (63 - b) & 1 for x in h[:n])) for b in range(64)]
        assert simhash.bit_counts(h[:n]).tolist() == want


def test_similar_documents_at_eight_tenths(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeiklmnorst") for _ in range(rng.randrange(2, 7)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(200)]
        near = list(base)
        for at in rng.sample(range(200), 2):
            near[at] = word()
        texts += [" ".join(base), " ".join(near)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of(spark, [*texts, None, ""])).collect()}
    assert sum(got[i + 1] == i for i in range(0, 120, 2)) >= 59
    assert all(got[i] == i for i in range(0, 120, 2))
    assert got[121] == 120
