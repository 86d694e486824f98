"""Text extraction returns all readable text of its input."""

import random
import re
import time

from pyspark.sql import functions as F

from attesta.operators import textindex


def test_long_texts_and_blocks_are_read_to_their_end(spark):
    text = "some words " * 40_000 + "needle"
    docs = spark.createDataFrame([(1, 0, bytearray(text.encode()))], "evidence_id long, offset long, data binary")
    assert docs.select(textindex.extracted(F.col("data"))).first()[0] == text
    assert textindex.index_regions(docs).first()["body"] == text


def test_scripts_beyond_ascii():
    said = "Größe und Füße, naïve Häuser"
    assert textindex.extract(said.encode()) == said
    for text in (said, "Привет, это простой текст", "Καλημέρα σε όλους", "東京で日本語の文章を読む", "שלום לכולם"):
        for shift in (b"", b"\xff"):
            assert textindex.extract(b"\x00\x00" + shift + text.encode("utf-16-le") + b"\x00\x00\xff") == text
    assert textindex.extract(b"only plain ascii words here") == "only plain ascii words here"


def test_noise_reads_as_nothing_long():
    import random

    noise = random.Random(3).randbytes(1 << 16)
    said = textindex.extract(noise)
    assert max(map(len, said.split())) < 16
    # Four ASCII characters in a row come up by chance; ideographs in a row hardly.
    assert sum("\u4e00" <= c <= "\ud7a3" for c in said) < 100


def test_plain_text_is_read_in_little_time():
    text = b"Words of a letter, set out at some length. \n" * 20_000
    started = time.process_time()
    assert textindex.extract(text) == " ".join(text.decode().split())
    assert time.process_time() - started < 0.6


def test_utf16_runs_are_those_of_the_patterns():
    patterns = {"latin": rb"(?:[\t\x20-\x7e\xa0-\xff]\x00|[\x00-\x7f]\x01){4,}", "letters": rb"(?:[\x20-\x40\x5b-\x60\x7b-\x7e]\x00|[\x00-\xff][\x03-\x06\x0e\x10]){4,}", "ideographs": rb"(?:[\x00-\xff][\x30\x4e-\x9f\xac-\xd7]|[\x01-\xee]\xff|[\x20-\x40]\x00){4,}"}
    rng = random.Random(3)
    said = ["straße", "日本語のテキストを読む", "Привет мир", "hello world", "한국어텍스트입니다", "\n\na\nb\nc\nd\ne\nf\ng", "ｆｕｌｌｗｉｄｔｈ", "\x00"]
    for _ in range(2000):
        data = b"".join(rng.choice([rng.choice(said).encode("utf-16-le"), rng.choice(said).encode(), rng.randbytes(rng.randrange(9))]) for _ in range(rng.randrange(7)))
        for shift in (0, 1):
            wanted = set()
            for script, pattern in patterns.items():
                at = shift
                while m := re.compile(pattern).search(data, at):
                    at = m.end() if (m.start() - shift) % 2 == 0 else m.start() + 1
                    if (m.start() - shift) % 2 == 0 and textindex._plausible(m[0], m[0].decode("utf-16-le", "replace"), script):
                        wanted.add((m.start(), m.end(), script))
            assert {r for r in textindex._wide_runs(data, shift) if textindex._plausible(data[r[0] : r[1]], data[r[0] : r[1]].decode("utf-16-le", "replace"), r[2])} == wanted


def test_regions_look_for_text_once(spark):
    text = b"Words of a letter, set out at some length. " * 90
    docs = spark.createDataFrame([(1, 0, bytearray(text))], "evidence_id long, offset long, data binary")
    plan = textindex.index_regions(docs).select("id", "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_region_text") == 1
