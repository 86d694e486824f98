"""Conversation tries, BPE and fill-in-middle against brute force, the library and SQL."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import bpe, infill, queries, tries

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "   \n\n "), (None, "a b\nc"), (5, "x " * 3000), (6, "é ß 漢字 \U0001f600\n" * 3), (7, "a<P>b\nc"), (8, "\n"), (9, "\r\n\r\n"), (-10, "no newline")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "t", 7, "o", "f", [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long, output string, form string, decoded array<int>")


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


# 11 Conversation prefix trie


def brute_trie(rows, block=100, modulus=6):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by.items()}
    made = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % modulus
        base = c - c % block if c >= 0 else -(-c - -c % block)  # as SQL's remainder has it
        made[c] = by.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(made[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows, **more):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digests", F.lit("clash")).withColumn("top", F.lit(1))
    return sorted((tuple(r) for r in tries.prefix_trie(tries.share_heads(tries.sequences(frame)), **more).collect()), key=repr)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 3 * n), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "bot", None]) if t > 1 else "user", rng.choice(["a", "é😀", "", None, "long text"]) if t else "hello"))
    return rows


@pytest.mark.parametrize("limit", [1, 40, None])
def test_trie_against_brute_force(spark, limit):
    rows = talks(3, 250)
    assert trie_rows(spark, rows, limit=limit) == brute_trie(rows)


def test_shared_openings_copies_and_chains(spark):
    """A long opening that all share, copies of one conversation, conversations that grow turn by turn."""
    opening = [("user", f"turn {i}") for i in range(40)]
    rows = [(c, i, *turn) for c in range(1, 90) for i, turn in enumerate(opening + [("bot", str(c))] * (c % 3))]
    rows += [(100 * c, i, *turn) for c in range(2, 30) for i, turn in enumerate(opening[:c])]
    assert trie_rows(spark, rows, limit=60) == trie_rows(spark, rows) == brute_trie(rows)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 8)
    rows = [(c, 0, "user", "same") for c in range(0, 12_000, 20)] + [(7, 0, "user", "same"), (7, 0, "user", "same"), (8, 5, None, None)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "lost"), (0, None, "user", "first"), (0, -3, "a", "second"), (0, 1, "b", "x"), (0, 1, "b", "x"), (0, 1, "a", None), (0, 1, "a", ""), (-5, 0, "u", "neg"), (-205, 0, None, None), (100, 0, "u", ""), (199, 0, "u", "z" * 300_000), (2**62, 0, "u", "big")]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 0, "user", "lost")]) == []


def test_conversations_of_many_turns(spark):
    rows = [(c, i, "user", str(i % 11)) for c in (1, 2, 300) for i in range(2000)]
    assert trie_rows(spark, rows, limit=100) == brute_trie(rows)


# 12 BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_file())


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(bpe.default_file())


def test_ids_equal_the_librarys(model, library):
    rng = random.Random(1)
    pool = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "1", "23", "'s", "'ll", "!", "<|endoftext|>", "‍", "̀", "\x85", "\xa0", " ", "Ᲊ", "ɤ", "\U00032000", "　", "\x1c", "\r\n", "ой", "ا", "²", "ª"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text.encode()) == want, text
        assert model.decode(want).decode() == library.decode(want, skip_special_tokens=False) == text
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert model.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_classes_of_characters_equal_the_librarys(model, library):
    """Letters, numbers, blanks and the rest, of assigned and unassigned code points."""
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0)] if not 0xD800 <= c < 0xE000]
    assert any(unicodedata.category(c) == "Cn" for c in points)
    for some in range(0, len(points), 500):
        for before in "a1! ":
            text = "\n".join(before + c for c in points[some : some + 500])
            assert model.split(text, text.encode()) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("length", [1, 7, 8, 9, 32, 33, 63, 64, 65, 1000])
def test_long_and_short_words_merge_alike(model, library, length):
    rng = random.Random(length)
    for letters in ("ab", "a", "thein", "é中"):
        word = "".join(rng.choice(letters) for _ in range(length))
        assert model.encode_word(word.encode()) == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "a", "7", "#", "中文", "ы"])
def test_very_long_runs(model, library, unit):
    text = "x" + unit * (1_000_000 // len(unit)) + "a"
    assert model.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_remembered_words_are_bounded(model, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    want = [model.encode(f"word{i} and{i}".encode()) for i in range(200)]
    assert len(model.words) <= 50
    assert [model.encode(f"word{i} and{i}".encode()) for i in range(200)] == want


def test_unknown_ids_and_broken_bytes(model):
    assert model.decode([]) == b""
    assert model.decode([-1, 99_999_999, *model.encode(b"ok")]) == b"ok"
    assert model.decode(model.encode("é".encode())[:1] if len(model.encode("é".encode())) > 1 else [model.byte_ids[0xC3]]) == "�".encode()


def test_bpe_of_odd_rows(spark, odd, library):
    got = bpe.encode(odd)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in ODD), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert bpe.encode(odd.limit(0)).count() == 0


def test_bpe_query(spark, library):
    rows = {r["doc_id"]: r for r in queries.op12_bpe_round_trip(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = rows[doc_id]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 13 Fill-in-middle


UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"^[\t\n\v\f\r ]*[^\t\n\v\f\r ]*[\t\n\v\f\r ]*|[^\t\n\v\f\r ]+[\t\n\v\f\r ]*", "chars": r"[\s\S]"}


def brute_infill(doc_id, text, units="lines", seed=7, rate=100, spm=50):
    text = text or ""
    parts = [p for p in re.findall(UNITS[units], text) if p]
    assert "".join(parts) == text
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("units", list(UNITS))
def test_infill_against_brute_force(spark, units):
    rng = random.Random(4)
    texts = [t for _, t in ODD] + ["".join(rng.choice(["a", "<S", ">", "\n", " ", "\r", "é", "😀", "<P>" if rng.random() < 0.1 else "<", "M>"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = infill.transform(docs, units=units, rate=80).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    for r in out.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_infill(r["doc_id"], texts[r["doc_id"]], units, rate=80)
        assert r["back"] == (texts[r["doc_id"]] or "")
    assert {r["form"] for r in out.collect()} == {"plain", "psm", "spm"}


def test_infill_of_odd_rows(spark, odd):
    got = infill.transform(odd)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((i, *brute_infill(i, t)) for i, t in ODD), key=repr)
    assert infill.transform(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.transform(odd, marks=("<P>", "<P>", "<M>"))


def test_bits_are_found():
    rng = random.Random(8)
    for width in (1, 2, 63, 64, 65, 1000):
        x = rng.getrandbits(width) | 1
        places = [i for i in range(width) if x >> i & 1]
        assert [infill.nth_bit(x, k) for k in range(len(places))] == places


def test_infill_of_very_long_texts():
    for text in ("a" * 3_000_000, "\n" * 2_000_000, "中\n" * 500_000):
        for units in ("lines", "chars"):
            n, form, _, _, output = infill.rearrange(text.encode(), (5, 1_000_000_007, 0, 0), 100, 50, units, (b"<P>", b"<S>", b"<M>"))
            assert form == "spm" and len(output) == len(text.encode()) + 9
            assert n == (len(text) if units == "chars" else max(1, text.count("\n")))
