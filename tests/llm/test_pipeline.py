"""The pipeline, stage by stage, against brute force on its own input."""

from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import quality
from attesta.llm.common import table

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {xxhash.xxh64_intdigest(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)} if w else set()


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    for df in seen[1:-1]:
        assert df.dtypes == docs.dtypes
    first, good, lined, apart, clean, packed = seen

    ranker = quality.train(first, table(spark, SF, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    want = {r["doc_id"] for r in first.collect() if ranker.score(np.array([quality.features((r["text"] or "").encode())]))[0] >= 0.5}
    assert {r["doc_id"] for r in good.select("doc_id").collect()} == want
    marks = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert sum(marks.get(i) == 1 for i in want) >= 0.97 * sum(m == 1 for m in marks.values())

    assert lined.count() == good.count()
    runs, left = {}, {r["doc_id"]: r["text"] for r in lined.collect()}
    for r in good.orderBy("doc_id").collect():
        ls, gone = r["text"].split("\n"), set()
        real = [i for i, x in enumerate(ls) if x.strip(" \t\n\x0b\f\r")]
        for p in range(len(real) - 1):
            if runs.setdefault((ls[real[p]], ls[real[p + 1]]), (r["doc_id"], p)) != (r["doc_id"], p):
                gone.update(real[p : p + 2])
        assert left[r["doc_id"]] == "\n".join(x for i, x in enumerate(ls) if i not in gone)

    kept = {r["doc_id"] for r in apart.select("doc_id").collect()}
    sets, held = {d: shingles(t) for d, t in left.items()}, defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    best = defaultdict(float)
    for d, s in sets.items():
        for e in {e for x in s for e in held[x] if e != d}:
            j = len(s & sets[e]) / len(s | sets[e])
            best[d] = max(best[d], j)
            if j >= 0.85:
                assert not (d in kept and e in kept)
    assert sum(not sets[d] for d in kept) <= 1
    assert all(best[d] >= 0.5 for d in sets if d not in kept and sets[d])

    leaks = {r["text"] for r in table(spark, SF, "benchmark").collect()}
    gone = kept - {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert {d for d in kept if any(b in left[d] for b in leaks)} == gone
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept - gone


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns[:3] == ["doc_id", "start", "length"]
    assert corpus_pipeline.ORACLE_SQL is None
