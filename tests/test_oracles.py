"""Every registered query against its SQL twin, over whole small tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from attesta import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) else x
    return x


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_related_pairs_from_classes(spark):
    from attesta.operators import artefacts

    rows = [(m, i) for m in range(40) for i in ("a", "b", "c", "d") if (m + ord(i)) % 3]
    held = {m: {i for x, i in rows if x == m} for m, _ in rows}
    df = spark.createDataFrame(rows, "member long, item string")
    of = {r["member"]: r["class"] for r in artefacts.class_members(df).collect()}
    pairs = {(r["a"], r["b"]): r["shared"] for r in artefacts.related(artefacts.item_classes(df)).collect()}
    for x in held:
        for y in held:
            if of[x] < of[y]:
                assert pairs.get((of[x], of[y]), 0) == len(held[x] & held[y])
            elif of[x] == of[y]:
                assert held[x] == held[y]


def _texts(duck):
    return {r[0]: r[1].encode() for r in duck.execute("SELECT doc_id, text FROM documents WHERE length(text) > 0").fetchall()}


def test_piece_digests_against_hashlib(spark, duck):
    import hashlib

    got = {(r["evidence_id"], r["offset"], r["sha256"]) for r in registry.queries()["piece_digests"](spark, str(DATA)).collect()}
    assert got == {(d, o, hashlib.sha256(t[o : o + 4096]).hexdigest()) for d, t in _texts(duck).items() for o in range(0, len(t), 4096)}


def test_carve_blocks_against_find(spark, duck):
    rules = {"license": b"Licensed under", "release": b"Released"}
    want = set()
    for d, t in _texts(duck).items():
        for name, head in rules.items():
            at = t.find(head)
            while at >= 0:
                want.add((d, name, at))
                at = t.find(head, at + 1)
    got = {(r["evidence_id"], r["name"], r["offset"]) for r in registry.queries()["carve_blocks"](spark, str(DATA)).collect()}
    assert got == want


def test_structure_template_against_bytes(spark, duck):
    got = {r["page_id"]: (r["magic"], r["rest"]) for r in registry.queries()["structure_template"](spark, str(DATA)).collect()}
    for page, html in duck.execute("SELECT page_id, html FROM pages WHERE length(html) >= 8").fetchall():
        raw = html.encode()
        assert got[page] == (raw[:4].decode("latin-1").rstrip("\0"), raw[4:8].decode("latin-1").rstrip("\0"))


def test_search_blocks_against_find(spark, duck):
    import re

    got = registry.queries()["search_blocks"](spark, str(DATA)).select("evidence_id", "offset", "encoding", "term").collect()
    texts = _texts(duck)
    for term in {r["term"] for r in got}:
        want = {(d, m.start()) for d, t in texts.items() for m in re.finditer(re.escape(term.encode()), t, re.IGNORECASE)}
        assert {(r["evidence_id"], r["offset"]) for r in got if r["term"] == term and r["encoding"] == "ascii"} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 300
