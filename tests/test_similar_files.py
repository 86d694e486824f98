"""Similar files: class rows, links and counts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import fuzzy
from attesta.operators import similar

LETTERS = fuzzy._ALPHABET


def signatures(seed, n):
    """Signatures in families: mutations of a few, with copies, doubled blocks, short and odd ones."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([20, 64]))) for _ in range(5)]

    def mutated(s):
        s = list(s)
        for _ in range(rng.choice([0, 1, 4, 12, 20])):
            at = rng.randrange(len(s))
            s[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [rng.choice(LETTERS)]])
        return "".join(s)[:64]

    out = ["3::", "3:AAAA:BB", "3:AAAAAA:BB", "x:abc", None, "", "3:abc:", "12:aaaaaaaaaaaa:bbbbbbbbbbbb"]
    for _ in range(n):
        a, b = rng.choice(bases), rng.choice(bases)
        block = rng.choice([3, 96, 96, 192])
        out.append(f"{block}:{mutated(a)}:{mutated(b)[:32]}" if rng.random() < 0.8 else f"{block}:COMMONRUN{mutated(a)[:30]}:{mutated(b)[:20]}")
    return out + rng.choices(out, k=n // 2)


def test_edits_against_the_table():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal if x == y else min(row[j], row[j - 1]) + 1
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcdAB+/") for _ in range(rng.randrange(65))) for _ in range(2))
        assert fuzzy._edits(a, b) == table(a, b)


@pytest.mark.parametrize("chunk", [512, 3])
@pytest.mark.parametrize("threshold", [60, 1])
def test_summary_against_all_pairs(spark, chunk, threshold, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    rng = random.Random(chunk)
    files = [(i, s, rng.choice([None, "", f"sha{s}", f"sha{i}"])) for i, s in enumerate(signatures(threshold, 120))]
    hashes = spark.createDataFrame(files, "node long, fuzzy string, sha256 string")
    want, pairs = {}, set()
    for i, s, x in files:
        if s is None or s.count(":") < 2 or not s.split(":")[0].isdigit():
            continue
        links = [(j, fuzzy.compare(s, t)) for j, t, y in files if j != i and t is not None and not (x and x == y)]
        links = [(j, v) for j, v in links if v >= threshold]
        want[i] = len(links)
        pairs |= {(min(i, j), max(i, j), v) for j, v in links}
    got = {r["node"]: r for r in similar.summary(hashes, threshold).collect()}
    assert {k: r["n_links"] for k, r in got.items()} == want
    assert all(r["members"] >= 1 and r["class"] <= k and got[r["class"]]["class"] == r["class"] for k, r in got.items())
    assert {tuple(r) for r in similar.similar_files(hashes, threshold).collect()} == pairs


def test_copies_cost_a_row_each(spark):
    sig = "96:" + "abcdefgh" * 8 + ":" + "ABCDEFGH" * 4
    hashes = spark.range(20_000).selectExpr("id AS node", f"'{sig}' AS fuzzy", "cast(id % 5000 AS string) AS sha256")
    assert similar.class_links(similar.classes_of(hashes)).count() == 0
    got = similar.summary(hashes)
    assert got.count() == 20_000 and {(r["class"], r["members"], r["n_links"]) for r in got.distinct().limit(50).collect()} == {(0, 20_000, 19_996)}


def test_a_hot_gram_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 50)
    rng = random.Random(9)
    rows = [(i, f"96:HOTGRAM{''.join(rng.choice(LETTERS) for _ in range(50))}:") for i in range(400)]
    classes = similar.classes_of(spark.createDataFrame(rows, "node long, fuzzy string"))
    seen = spark.sparkContext.accumulator(0)
    before = similar._links_in

    def counted(rows, threshold):
        seen.add(1 if rows.num_rows else 0)
        assert rows.num_rows < 200
        return before(rows, threshold)

    monkeypatch.setattr(similar, "_links_in", counted)
    similar.class_links(classes).count()
    assert seen.value >= 36
    assert similar.class_links(classes.limit(0)).count() == 0


def test_rows_of_grams_are_narrow_and_hot_grams_go_to_few_pieces(spark):
    classes = spark.createDataFrame([("3:abcdefgh:ABCDEFG", 1)], "signature string, class long")
    rows = similar._parts(classes)
    assert rows.columns == ["class", "signature", "block", "gram"] and -(-2000 // similar.CHUNK) == 1
    assert {similar._part(r["signature"], r["block"])[:7].lower() for r in rows.collect()} == {"abcdefg"}
    assert [similar._part("3:abcdefgh:ABCDEFG", b) for b in (3, 6)] == ["abcdefgh", "ABCDEFG"]


def plain_hash(data):
    """A signature byte by byte."""
    rolled, window, mixed = [], [0] * 7, 0
    for b in data:
        window = [*window[1:], b]
        mixed = (mixed << 5 ^ b) & 0xFFFFFFFF
        rolled.append((sum(window) + sum(i * x for i, x in enumerate(window, 1)) + mixed) & 0xFFFFFFFF)

    def pieces(block, length):
        out, h = "", 0x27
        for b, r in zip(data, rolled, strict=True):
            h = (h * 0x01000193 ^ b) & 63
            if r % block == block - 1 and len(out) < length - 1:
                out, h = out + LETTERS[h], 0x27
        return out + LETTERS[h]

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(pieces(block, 64)) < 32:
        block //= 2
    return f"{block}:{pieces(block, 64)}:{pieces(block * 2, 32)}"


def test_hashes_of_many_against_bytes():
    rng = random.Random(4)
    some = [bytes(rng.choices(range(m), k=n)) for m in (2, 30, 256) for n in (1, 6, 7, 8, 64, 192, 193, 900, 7000, *range(20, 60))]
    some += [b"\xff" * 3000, b"ab" * 700, *(x[:at] for x in some[:40] for at in range(max(1, len(x) - 9), len(x)))]
    assert fuzzy.fuzzy_hashes([None, b"", *some, None], 5000) == [None, None, *map(plain_hash, some), None]
    assert [fuzzy.fuzzy_hash(x) for x in some[:60]] == [plain_hash(x) for x in some[:60]] and fuzzy.fuzzy_hash(b"") == "3::"
    assert fuzzy.fuzzy_hashes(["é".encode() * 9]) == [plain_hash("é".encode() * 9)]


def test_contents_are_hashed_once(spark):
    hashed = spark.range(5).select(fuzzy.fuzzy(F.col("id").cast("string").cast("binary")).alias("fuzzy"), F.col("id").alias("node"))
    assert similar._signed(hashed)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def families(seed, n, odd):
    """Signatures of the same few runs with parts changed; with ``odd`` some are long or have other characters."""
    rng = random.Random(seed)
    bases = ["".join(rng.choice(LETTERS) for _ in range(64)) for _ in range(3)]

    def near(base, changes):
        s = list(base)
        for _ in range(changes):
            s[rng.randrange(len(s))] = rng.choice("é😀~ab" if odd and rng.random() < 0.3 else LETTERS)
        return "".join(s) + (base if odd and rng.random() < 0.2 else "")

    return [f"{rng.choice([48, 96])}:{near(rng.choice(bases), rng.randrange(22))}:{near(rng.choice(bases)[:32], rng.randrange(12))}" for _ in range(n)]


@pytest.mark.parametrize("odd", [False, True])
def test_links_are_scored_in_arrays(spark, odd, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 20)
    monkeypatch.setattr(similar, "TOGETHER", 100)
    files = [(f"n{i}", s) for i, s in enumerate(families(8, 130, odd))]
    want = {i: [v for j, t in files if j != i and (v := fuzzy.compare(s, t)) >= 60] for i, s in files}
    if not odd:
        monkeypatch.setattr(similar, "compare", lambda a, b: 1 / 0)
    got = similar.summary(spark.createDataFrame(files, "node string, fuzzy string").withColumn("sha256", F.lit(None).cast("string")))
    assert {r["node"]: (r["n_links"], r["best"]) for r in got.collect()} == {i: (len(v), max(v, default=None)) for i, v in want.items()}
    assert sum(map(len, want.values())) > 500


def test_grams_within_a_common_run_are_not_exchanged(spark):
    rng = random.Random(2)
    run = "".join(rng.choice(LETTERS) for _ in range(40))
    classes = spark.createDataFrame([(i, f"96:{x}{run}{x * 2}:") for i, x in enumerate("abcd")], "class long, signature string")
    assert similar._dealt(classes)._df.count() == 4
    assert {(r["a"], r["b"]) for r in similar.class_links(classes).collect()} == {(i, j) for i in range(4) for j in range(i + 1, 4)}
