"""The index on disk: same ranks as in memory, folders read, scopes replaced and removed."""

import pytest

from attesta.operators import textindex, textstore

ROWS = [
    (1, "a.txt", "/a.txt", "red fox and red hen", 19, "e1", "p1", None), (2, "b.txt", "/b.txt", "The red, RED fox", 16, "e1", "p2", "usn"),
    (3, "c.txt", "/c.txt", None, 9, "e2", "p1", "raw"), (4, "d.txt", "/d.txt", "", 0, "e2", "p1", None), (5, "e.txt", "/e.txt", "... !", 5, "e2", "p1", None),
    (6, "f.txt", "/f.txt", "grün fox", 9, None, None, "raw"),
]
TYPES = "id long, name string, path string, body string, size long, evidence string, part string, kind string"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "ix")
    textstore.build(spark.createDataFrame(ROWS, TYPES), path)
    return path


def found(df):
    return {r["id"]: (r["matched"], round(r["score"], 9)) for r in df.collect()}


def test_ranks_as_in_memory(spark, store):
    docs = spark.createDataFrame(ROWS, TYPES).where("id in (1, 2, 6)")
    for terms, mode in ((["red fox", "hen"], "any"), (["red", "fox"], "all"), (["nothing"], "any"), (["!"], "any")):
        assert found(textstore.ranked(spark, store, terms, mode)) == found(textindex.ranked(textindex.postings(docs), terms, mode))
    assert set(found(textstore.ranked(spark, store, ["red"], evidence="e1", part="p2"))) == {2}


def test_only_folders_of_the_terms_are_read(spark, store):
    plan = textstore.postings(spark, store, ["red fox"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "In(term, [fox,red])" in plan


def test_report_and_status(spark, store):
    held = textstore.documents(spark, store)
    got = {(r["evidence"], r["part"]): r for r in textstore.build_report(held, ["evidence", "part"]).collect()}
    r = got["e2", "p1"]
    assert (r["candidates"], r["indexed"], r["with_content"], r["empty"], r["unreadable"], r["no_text"], r["coverage"]) == (3, 0, 2, 1, 1, 1, 0.0)
    s = textstore.status(held).first()
    assert (s["documents"], s["file_documents"], s["usn_documents"], s["raw_documents"], s["complete"]) == (3, 1, 1, 1, True)


def test_scope_is_replaced_and_removed(spark, store):
    textstore.build(spark.createDataFrame([(9, "z", "/z", "blue hen", 8, "e1", "p1", None)], TYPES), store)
    assert set(found(textstore.ranked(spark, store, ["hen"]))) == {9}
    assert set(found(textstore.ranked(spark, store, ["red"]))) == {2}
    textstore.clear(spark, store, "e1", "p2")
    assert not found(textstore.ranked(spark, store, ["red"]))
    assert set(found(textstore.ranked(spark, store, ["fox"]))) == {6}
    textstore.build(spark.createDataFrame([(10, "y", "/y", "grey cat", 8, "e/1*", "", None)], TYPES), store)
    assert set(found(textstore.ranked(spark, store, ["cat"], evidence="e/1*", part=""))) == {10}
    textstore.clear(spark, store, "e/1*", "")
    assert not found(textstore.ranked(spark, store, ["cat"])) and found(textstore.ranked(spark, store, ["fox"]))
    textstore.clear(spark, store)
    assert textstore.documents(spark, store).count() == 0


def docs(spark, *rows):
    """Files (id, body, evidence, part)."""
    return spark.createDataFrame([(i, "", "", body, len(body or ""), e, p, None) for i, body, e, p in rows], TYPES)


def ids(spark, path, term, **more):
    return set(found(textstore.ranked(spark, path, [term], **more)))


def test_a_rebuild_leaves_no_old_hit(spark, tmp_path):
    path = str(tmp_path / "ix")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    textstore.build(docs(spark, (1, " ".join(words), "e", "p"), (2, "alpha", "e", "q")), path)
    textstore.build(docs(spark, (1, "omega", "e", "p")), path)
    assert {i for w in words for i in ids(spark, path, w)} == {2}
    assert ids(spark, path, "omega") == {1}
    textstore.build(docs(spark, (1, "", "e", "p")), path)
    assert not ids(spark, path, "omega") and textstore.documents(spark, path, "e", "p").count() == 1
    textstore.build(docs(spark), path, scopes=[("e", "q")])
    assert not ids(spark, path, "alpha") and textstore.documents(spark, path).count() == 1


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    textstore.build(docs(spark, (1, "old words", "e", "p")), path)
    save = textstore._save

    def failing(df, to, by=()):
        if "/documents/" in to:
            raise OSError("disk full")
        save(df, to, by)

    monkeypatch.setattr(textstore, "_save", failing)
    for change in (textstore.build, textstore.add):
        with pytest.raises(OSError):
            change(docs(spark, (1, "new words", "e", "p"), (2, "more", "e", "p")), path)
    monkeypatch.undo()
    assert ids(spark, path, "old") == ids(spark, path, "words") == {1} and not ids(spark, path, "new")
    assert textstore.documents(spark, path).count() == 1
    assert textstore.vacuum(spark, path, older_than=0) and ids(spark, path, "old") == {1}


def test_add_remove_and_compact(spark, tmp_path):
    path = str(tmp_path / "ix")
    textstore.build(docs(spark, (1, "red fox", "e", "p"), (2, "red hen", "e", "p"), (3, "red cat", "f", None)), path)
    textstore.add(docs(spark, (2, "blue hen", "e", "p"), (4, "blue fox", "e", "p"), (3, "blue cat", "e", "p")), path)
    assert ids(spark, path, "red") == {1, 3} and ids(spark, path, "blue") == {2, 3, 4}
    textstore.add(docs(spark, (2, "green hen", "e", "p")), path)
    textstore.remove(spark.createDataFrame([("f", None, 3), ("e", "p", 99)], "evidence string, part string, id long"), path)
    textstore.remove(spark.createDataFrame([("e", "p", 1)], "evidence string, part string, id long"), path)
    want = {"red": set(), "blue": {3, 4}, "green": {2}, "hen": {2}, "fox": {4}}
    before = textstore.opened(spark, path)
    held = {t: found(textstore.ranked(spark, path, [t])) for t in want}
    assert {t: set(x) for t, x in held.items()} == want and len(before.segments) == 3
    after = textstore.compact(spark, path, buckets=3)
    assert len(after.segments) == 1 and after.dead is None
    assert {t: found(textstore.ranked(spark, path, [t])) for t in want} == held
    assert {t: found(textstore.ranked(spark, path, [t], version=before)) for t in want} == held
    textstore.add(docs(spark, (7, "late fox", "g", "p")), path)
    assert ids(spark, path, "fox") == {4, 7} and ids(spark, path, "fox", evidence="g", part="p") == {7}
    assert textstore.vacuum(spark, path, older_than=0) and ids(spark, path, "fox") == {4, 7}
    with pytest.raises(Exception):
        textstore.ranked(spark, path, ["fox"], version=before).collect()


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "ix")
    first = textstore.build(docs(spark, (1, "one", "e", "p")), path)
    begun = textstore.ranked(spark, path, ["one"])
    textstore.build(docs(spark, (1, "two", "e", "p")), path)
    textstore.clear(spark, path)
    assert set(found(begun)) == {1} and ids(spark, path, "one", version=first) == {1} and not ids(spark, path, "two")
    assert textstore.versions(spark, path) == [1, 2, 3]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "ix")
    first = textstore.build(docs(spark, (1, "one", "e", "p")), path)
    textstore.build(docs(spark, (1, "two", "e", "p")), path)
    with pytest.raises(RuntimeError):
        textstore._commit(spark, path, first)
    assert ids(spark, path, "two") == {1}


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "ix")
    assert not ids(spark, path, "one") and textstore.documents(spark, path).count() == 0
    assert textstore.status(textstore.documents(spark, path)).first()["documents"] == 0
    textstore.build(docs(spark), path)
    textstore.add(docs(spark, (1, "o'ne two", "e'1", "p\\")), path)
    assert ids(spark, path, "two", evidence="e'1", part="p\\") == {1}


def test_compacting_equal_buckets_exchanges_no_posting(spark, store, monkeypatch):
    textstore.add(spark.createDataFrame([(1, "a.txt", "/a.txt", "a blue fox", 10, "e1", "p1", None)], TYPES), store)
    before, ranks = sorted(map(tuple, textstore.postings(spark, store).select("term", "id", "field", "pos", "evidence", "part").collect())), found(textstore.ranked(spark, store, ["fox", "blue"]))
    plans, save, split = [], textstore._save, spark.conf.get(textstore._SPLIT)
    monkeypatch.setattr(textstore, "_save", lambda df, path, by=(): (plans.append((path, df._jdf.queryExecution().optimizedPlan().toString())), save(df, path, by)))
    after = textstore.compact(spark, store)
    plan = next(p for path, p in plans if "/postings/" in path)
    assert "Repartition" not in plan and "Rebalance" not in plan and spark.conf.get(textstore._SPLIT) == split
    assert len(after.segments) == 1 and after.dead is None
    assert sorted(map(tuple, textstore.postings(spark, store).select("term", "id", "field", "pos", "evidence", "part").collect())) == before
    assert found(textstore.ranked(spark, store, ["fox", "blue"])) == ranks


def test_ranking_reads_the_index_once(spark):
    docs = spark.createDataFrame(ROWS, TYPES).where("id in (1, 2, 6)")
    sizes = spark.createDataFrame([(1, 9), (2, 9), (6, 9)], "id long, length long")
    plan = textindex.ranked(textindex.postings(docs), ["red fox", "hen"], sizes=sizes)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


@pytest.mark.parametrize("name", ["stored_index_query", "stored_index_after_replace_and_clear", "stored_index_after_add_and_compact"])
def test_ranks_go_by_the_texts_that_are_there(spark, tmp_path, name):
    import duckdb

    from attesta import registry

    texts = ["the license", "", None, "of the license", "", "rest of the text", None, "license", "of the same"]
    rows = [(i, t, ("en", "de", "fr", None)[i * 3 % 4], ("src1", "src2", None)[i // 3 % 3], (0, None, len(t or ""))[i % 3]) for i, t in enumerate(texts * 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {i: (m, s) for i, m, s in con.execute(f"SELECT id, matched, score FROM ({registry.oracle_sql()[name]})").fetchall()}
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert want and len(got) == len(want) and {r["id"]: (r["matched"], r["score"]) for r in got} == want
