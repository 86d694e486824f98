"""Recovery phrases against brute force over every window and every replacement."""

import hashlib
import random
import string

import pytest

from attesta.operators import mnemonics


def wordlist(seed=5):
    rng, words = random.Random(seed), set()
    while len(words) < 2048:
        words.add("".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 8))))
    return sorted(words)


WORDS = wordlist()


def phrase(n, rng):
    raw = rng.randbytes(n * 4 // 3)
    bits = "".join(f"{b:08b}" for b in raw) + f"{hashlib.sha256(raw).digest()[0]:08b}"[: n // 3]
    return [WORDS[int(bits[i : i + 11], 2)] for i in range(0, len(bits), 11)]


def holds(words):
    bits = "".join(f"{WORDS.index(w):011b}" for w in words)
    cut = len(bits) * 32 // 33
    raw = int(bits[:cut], 2).to_bytes(cut // 8, "big")
    return bits[cut:] == f"{hashlib.sha256(raw).digest()[0]:08b}"[: len(bits) - cut]


def found(spark, texts, **options):
    words = spark.createDataFrame(list(enumerate(WORDS)), "place int, word string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    return sorted(mnemonics.find_phrases(rows, words, **options).collect(), key=lambda r: (r["id"], r["state"], r["offset"]))


def slips(word):
    letters = string.ascii_lowercase
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return (out | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}) - {word}


def greedy(words):
    at, out = 0, []
    while at + 12 <= len(words):
        n = next((k for k in (24, 21, 18, 15, 12) if at + k <= len(words) and holds(words[at : at + k])), 0)
        if n:
            out.append((at, n))
        at += n or 1
    return out


def test_one_slip_against_all_edits():
    rng = random.Random(1)
    near = {w: slips(w) for w in rng.sample(WORDS, 40)}
    others = [*WORDS, *(s for w in near for s in rng.sample(sorted(near[w]), 20)), "ab", "abc", "acb", "bca"]
    for w, edits in near.items():
        assert all(mnemonics.one_slip(w, o) == (o in edits) for o in others)
    looked = mnemonics.Phrases(WORDS, 1)
    for w in rng.sample(others, 60):
        assert looked.meant(w) == tuple(i for i, x in enumerate(WORDS) if x in slips(w))


def test_exact_runs_against_brute_force(spark):
    rng, texts, want = random.Random(2), [], []
    for i in range(40):
        run = rng.choices(WORDS, k=rng.randint(11, 13)) if i % 4 == 3 else [w for _ in range(3) for w in (phrase(rng.choice((12, 15, 18, 21, 24)), rng) if rng.random() < 0.6 else rng.choices(WORDS, k=rng.randint(1, 20)))]
        texts.append("Zz9 " + "\n- ".join(w.title() for w in run) + " zz")
        places = [4 + sum(len(w) + 3 for w in run[:k]) for k in range(len(run))]
        hits = greedy(run)
        want += [(i, "valid", places[a], n, " ".join(run[a : a + n])) for a, n in hits]
        if not hits and len(run) >= 12:
            want.append((i, "unchecked", 4, len(run), " ".join(run)))
    assert [(r["id"], r["state"], r["offset"], r["n_words"], r["phrase"]) for r in found(spark, texts)] == want
    assert {w[1] for w in want} == {"valid", "unchecked"}


def test_near_against_brute_force(spark):
    rng, texts, want = random.Random(3), [], []
    for i in range(24):
        said = phrase(rng.choice((12, 15, 24)), rng)
        at = rng.randrange(len(said))
        wrong = rng.choice(sorted(s for s in slips(said[at]) if s not in WORDS and 2 <= len(s) <= 9))
        said[at] = wrong
        texts.append(" ".join(said))
        meant = [w for w in WORDS if wrong in slips(w)]
        place = 0
        while place + 12 <= len(said):
            for n in (24, 21, 18, 15, 12):
                if place + n <= len(said) and place <= at < place + n:
                    good = [t for t in ([*said[place:at], m, *said[at + 1 : place + n]] for m in meant) if holds(t)]
                    if good:
                        want.append((i, len(" ".join(said[:place])) + (place > 0), n, " ".join(said[place : place + n]), " ".join(good[0]), len(good)))
                        place += n - 1
                        break
            place += 1
    got = [r for r in found(spark, texts, typos=1) if r["state"] == "near"]
    valid = {r["id"] for r in found(spark, texts) if r["state"] == "valid"}  # a run beside the slip that holds by chance
    assert [(r["id"], r["offset"], r["n_words"], r["written"], r["phrase"], r["fits"]) for r in got if r["id"] not in valid] == [w for w in want if w[0] not in valid]
    assert len(set(w[0] for w in want) - valid) >= 20


def test_two_slips_need_two_typos(spark):
    rng = random.Random(4)
    said = phrase(24, rng)
    clear = [k for k, w in enumerate(said) if len(w) == 8][:2]
    text = " ".join(w[:-1] if k in clear else w for k, w in enumerate(said))
    assert not [r for r in found(spark, [text], typos=1) if r["n_words"] == 24]
    assert [r["phrase"] for r in found(spark, [text], typos=2) if r["n_words"] == 24] == [" ".join(said)]


def test_odd_rows(spark):
    rng = random.Random(6)
    good = phrase(12, rng)
    words = spark.createDataFrame(list(enumerate(WORDS)), "place int, word string")
    rows = [(None, " ".join(good), 1), (1, None, 2), (2, "", 3), (3, "İ " + " ".join(good), 4), (3, "İ " + " ".join(good), 4), (4, " and ".join(good), 5), (5, (" " * 13).join(good), 6), (6, "x" * 300_000 + " " + "\n".join(good), 7)]
    df = spark.createDataFrame(rows, "id long, body string, offset long")
    got = sorted(((r["id"] or 0, r["offset"], r["state"]) for r in mnemonics.find_phrases(df, words).collect() if r["state"] == "valid"))
    assert got == [(0, 0, "valid"), (3, 2, "valid"), (3, 2, "valid"), (6, 300_001, "valid")]
    assert mnemonics.find_phrases(df.limit(0), words, typos=1).count() == 0
    for bad in (words.limit(2047), words.withColumn("word", words["word"].substr(1, 3)), spark.createDataFrame([(0, None)], "place int, word string")):
        with pytest.raises(ValueError):
            mnemonics.find_phrases(df, bad)
    assert mnemonics.wordlist_problems(WORDS[::-1][:-1])[:2] == ["2047 words, not 2048", "not in alphabetical order"]
