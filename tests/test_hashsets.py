"""Hash sets imported, imported again and removed, on rows that break careless code."""

from attesta.operators import hashsets

SETS = "id long, name string, kind string, source string, imported_at long, examiner string, entries long"
NEW = "name string, kind string, source string, imported_at long, examiner string"
ENTRY = "set_id long, algo string, digest string, label string"
DIGEST = "name string, source string, algo string, digest string, label string"


def test_import_again_new_refused_and_removed(spark):
    sets = spark.createDataFrame([(4, "bad", "known_bad", "x", 1, "ann", 2), (7, "good", "known_good", None, 1, None, 1)], SETS)
    entries = spark.createDataFrame([(4, "md5", "aa", "old"), (4, "md5", "bb", None), (7, "sha1", "cc", "")], ENTRY)
    lists = spark.createDataFrame(
        [("bad", "notable", "y", 5, "bob"), ("bad", "notable", "z", 4, "bob"), ("new", "known_bad", None, 5, "bob"), ("also", "known_good", "s", None, None), ("good", "odd", "q", 9, "bob"), ("none", "notable", "n", 9, "bob"), (None, "notable", "y", 1, "b")], NEW,
    )
    digests = spark.createDataFrame([("bad", "y", "md5", "DD", "d"), ("bad", "y", "md5", "DD", "d"), ("bad", "z", "md5", "ee", "e"), ("new", None, "md5", "ff", None), ("also", "s", "md5", "aa", ""), ("good", "q", "md5", "11", ""), ("none", "n", "md5", "", "")], DIGEST)
    told = {(r["name"], r["source"]): (r["entries"], r["refused"]) for r in hashsets.judged(lists, digests).collect()}
    assert told == {("bad", "y"): (2, None), ("bad", "z"): (1, "replaced"), ("new", None): (1, None), ("also", "s"): (1, None), ("good", "q"): (1, "kind"), ("none", "n"): (0, "empty"), (None, "y"): (0, "name")}
    after, held = hashsets.imported(sets, entries, lists, digests)
    assert sorted(tuple(r) for r in after.select("id", "name", "kind", "entries").collect()) == [(4, "bad", "notable", 2), (7, "good", "known_good", 1), (8, "also", "known_good", 1), (9, "new", "known_bad", 1)]
    assert {r["id"]: r["examiner"] for r in after.collect()} == {4: "ann", 7: None, 8: None, 9: "bob"}
    assert sorted((r["set_id"], r["digest"]) for r in held.collect()) == [(4, "dd"), (4, "dd"), (7, "cc"), (8, "aa"), (9, "ff")]
    left, rest = hashsets.removed(after, held, spark.createDataFrame([("bad",), ("unknown",), (None,), ("bad",)], "name string"))
    assert sorted(r["id"] for r in left.collect()) == [7, 8, 9] and sorted(r["set_id"] for r in rest.collect()) == [7, 8, 9]


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (SETS, ENTRY, NEW, DIGEST)]
    after, held = hashsets.imported(*none)
    assert after.count() == held.count() == 0
    one = spark.createDataFrame([("a", "notable", "s", 1, "b")], NEW), spark.createDataFrame([("a", "s", "md5", "aa", "")], DIGEST)
    after, held = hashsets.imported(none[0], none[1], *one)
    assert [(r["id"], r["entries"]) for r in after.collect()] == [(1, 1)] and held.first()["set_id"] == 1
