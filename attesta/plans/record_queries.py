"""Search, index, artefact and case-record queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import artefacts, casebook, search, textindex, textstore
from ..operators.scratch import cut, shared_dir
from .base import EV, contents, query, table, timeline

_TERMS = ("stand", "mitted", "the and")


@query("search_names", "SELECT doc_id AS id, 'doc-' || doc_id || '.txt' AS name FROM documents WHERE contains('doc-' || doc_id || '.txt', 'doc-12') OR contains('doc-' || doc_id || '.txt', '7.txt')")
def search_names(spark, d):
    return search.search_names(contents(spark, d), ["DOC-12", "7.txt"]).select("id", "name")


_ASCII_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HITS = f"""t AS (SELECT doc_id AS id, {_ASCII_LOW} AS low FROM documents), w AS (SELECT unnest(['licensed', 'thing', 'in the']) AS term),
p AS (SELECT id, term, length(term) AS k, string_split(low, term) AS parts FROM t, w WHERE contains(low, term)),
q AS (SELECT id, term, k, unnest(range(1, len(parts))) AS i, parts FROM p),
h AS (SELECT id, term, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * k AS BIGINT) AS "offset" FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "offset", term) AS rn, count(*) OVER (PARTITION BY id) AS alln FROM h)"""


@query("search_literal", f"WITH {_HITS} SELECT id, term, \"offset\" FROM n WHERE rn <= 1000000")
def search_literal(spark, d):
    return search.search_texts(contents(spark, d), ["licensed", "THING", "in the"], per_file=1_000_000).select("id", F.lower("term").alias("term"), F.col("offset").cast("long").alias("offset"))


@query("search_capped", f"WITH {_HITS} SELECT id, term, \"offset\", CASE WHEN rn = 20 AND alln > 20 THEN alln - 20 ELSE 0 END AS more FROM n WHERE rn <= 20")
def search_capped(spark, d):
    return search.search_texts(contents(spark, d), ["licensed", "thing", "in the"]).select("id", "term", F.col("offset").cast("long").alias("offset"), "more")


_MAIL = r"[a-z0-9._]+@[a-z0-9.]+[.][a-z]{2,}"


@query("search_regex", f"SELECT id, match, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{_MAIL}')) AS match FROM documents) GROUP BY ALL")
def search_regex(spark, d):
    return search.search_regex(contents(spark, d), _MAIL)


@query("search_blocks")
def search_blocks(spark, d):
    text = contents(spark, d).where("body is not null")
    blocks = text.select(F.col("id").alias("evidence_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / 4096)), lambda i: F.substring(F.col("body").cast("binary"), i * 4096 + 1, F.lit(4096)))).alias("i", "data"))
    return search.search_blocks(blocks.select("evidence_id", (F.col("i") * 4096).cast("long").alias("offset"), "data"), ["licensed under"])


_TOK = "tok AS (SELECT doc_id AS id, unnest(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x, i: {'term': x, 'pos': i - 1})) AS t FROM documents), ix AS (SELECT id, t.term AS term, t.pos AS pos FROM tok)"


def _index(spark, d):
    return textindex.postings(contents(spark, d), ("body",))


def _sizes(spark, d):
    return textindex.document_sizes(contents(spark, d), ("body",))


@query("index_terms", f"WITH {_TOK} SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM ix GROUP BY term")
def index_terms(spark, d):
    return _index(spark, d).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


@query("index_phrase", f"WITH {_TOK}, s AS (SELECT id, pos - i AS start, count(*) AS n FROM ix JOIN (VALUES ('licensed', 0), ('under', 1), ('the', 2)) w(t, i) ON term = t GROUP BY ALL) SELECT id, count(*) AS hits FROM s WHERE n = 3 GROUP BY id")
def index_phrase(spark, d):
    return textindex.phrase_hits(_index(spark, d), "Licensed under the")


def _bm25(mode_filter: str) -> str:
    return f"""WITH {_TOK}, sizes AS (SELECT id, count(*) AS length FROM ix GROUP BY id), whole AS (SELECT count(*)::DOUBLE AS docs, avg(length) AS mean FROM sizes),
a AS (SELECT id, 0 AS q, count(*) AS hits FROM ix WHERE term = 'license' GROUP BY id),
b AS (SELECT id, 1 AS q, count(*) AS hits FROM (SELECT id, pos - i AS start, count(*) AS n FROM ix JOIN (VALUES ('of', 0), ('the', 1)) w(t, i) ON term = t GROUP BY ALL) WHERE n = 2 GROUP BY id),
h AS (SELECT * FROM a UNION ALL SELECT * FROM b), df AS (SELECT q, count(*)::DOUBLE AS df FROM h GROUP BY q)
SELECT id, count(*) AS matched, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM h JOIN df USING (q) JOIN sizes USING (id), whole GROUP BY id {mode_filter}"""


@query("index_query_any", _bm25(""))
def index_query_any(spark, d):
    return textindex.ranked(_index(spark, d), ["license", "of the"], sizes=_sizes(spark, d)).withColumn("score", F.round("score", 6))


@query("index_query_all", _bm25("HAVING count(*) = 2"))
def index_query_all(spark, d):
    return textindex.ranked(_index(spark, d), ["license", "of the"], "all", _sizes(spark, d)).withColumn("score", F.round("score", 6))


def _stored_files(spark, d):
    """``documents`` as indexed files of one scope a language."""
    return contents(spark, d).drop("name", "path").withColumns({"evidence": F.col("part"), "part": F.lit("")}).withColumn("kind", F.when(F.col("id") % 3 == 0, "raw").when(F.col("id") % 3 == 1, "usn"))


def _sized(files):
    """``files`` with the size of the text they hold: ranks go by texts, whatever ``n_chars`` says of an earlier or missing one."""
    return files.withColumn("size", F.length("body"))


def _stored(spark, files, asked, *changes):
    """What ``asked`` finds in an index of ``files`` built for this call, after ``changes`` to it; the index goes again."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    textstore.build(files, path)
    for change in changes:
        change(path)
    found = cut(asked(path))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return found


def _stored_ranks(spark, d, *changes):
    asked = lambda path: textstore.ranked(spark, path, ["license", "of the"]).withColumn("score", F.round("score", 6))
    return _stored(spark, _sized(_stored_files(spark, d)), asked, *changes)


@query("stored_index_query", _bm25(""))
def stored_index_query(spark, d):
    return _stored_ranks(spark, d)


def _bm25_of(documents: str) -> str:
    """The ranks over other documents than those of the table."""
    return _bm25("").replace("FROM documents", "FROM changed").replace("WITH ", f"WITH changed AS ({documents}), ", 1)


@query("stored_index_after_replace_and_clear", _bm25_of("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN source || ' license of the' ELSE text END AS text FROM documents WHERE lang IS DISTINCT FROM 'de'"))
def stored_index_after_replace_and_clear(spark, d):
    """English texts are replaced by short ones, German ones cleared."""
    short = contents(spark, d).where("part = 'en'").select("id", F.concat("evidence", F.lit(" license of the")).alias("body"), F.col("part").alias("evidence"), F.lit("").alias("part"))
    return _stored_ranks(spark, d, lambda path: textstore.build(_sized(short), path), lambda path: textstore.clear(spark, path, "de"))


@query("stored_index_after_add_and_compact", _bm25_of("SELECT doc_id, lang, CASE WHEN source = 'src1' THEN 'the license of the web' ELSE text END AS text FROM documents"))
def stored_index_after_add_and_compact(spark, d):
    """Documents of one source are added again with other texts, then segments are merged."""
    again = contents(spark, d).where("evidence = 'src1'").select("id", F.lit("the license of the web").alias("body"), F.col("part").alias("evidence"), F.lit("").alias("part"))
    return _stored_ranks(spark, d, lambda path: textstore.add(_sized(again), path), lambda path: textstore.compact(spark, path))


_STATUS = """d AS (SELECT doc_id, lang, CASE WHEN coalesce(n_chars, 0) = 0 THEN 'empty' WHEN text IS NULL THEN 'unreadable' WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'no_text' ELSE 'indexed' END AS status FROM documents)"""


@query("stored_index_report", f"""WITH {_STATUS} SELECT coalesce(lang, '') AS evidence, '' AS part, count(*) AS candidates, count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status <> 'empty') AS with_content,
count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status = 'unreadable') AS unreadable, count(*) FILTER (WHERE status = 'no_text') AS no_text,
CASE WHEN count(*) FILTER (WHERE status <> 'empty') = 0 THEN 1.0 ELSE round(count(*) FILTER (WHERE status = 'indexed')::DOUBLE / count(*) FILTER (WHERE status <> 'empty'), 4) END AS coverage FROM d GROUP BY ALL""")
def stored_index_report(spark, d):
    return _stored(spark, _stored_files(spark, d), lambda path: textstore.build_report(textstore.documents(spark, path), ["evidence", "part"]))


@query("stored_index_status", f"""WITH {_STATUS} SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 2) AS file_documents, count(*) FILTER (WHERE doc_id % 3 = 1) AS usn_documents, count(*) FILTER (WHERE doc_id % 3 = 0) AS raw_documents, count(*) FILTER (WHERE doc_id % 3 = 0) > 0 AS complete FROM d WHERE status = 'indexed'""")
def stored_index_status(spark, d):
    return _stored(spark, _stored_files(spark, d), lambda path: textstore.status(textstore.documents(spark, path)))


@query("index_query_snippets")
def index_query_snippets(spark, d):
    docs = contents(spark, d)
    return textindex.query(textindex.postings(docs), docs, ["license"], limit=50, scope=F.col("part") == "en").select("id", "matched", F.round("score", 6).alias("score"), "snippet")


@query("index_coverage", "SELECT lang AS kind, count(*) AS candidates, count(*) FILTER (WHERE length(text) > 0) AS indexed FROM documents GROUP BY lang")
def index_coverage(spark, d):
    docs = contents(spark, d)
    return textindex.coverage(docs.select(F.col("part").alias("kind"), F.coalesce(F.length("body") > 0, F.lit(False)).alias("indexed")))


@query("visible_text")
def visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.visible_text(F.col("html")).alias("text"))


@query("sanitised_pages")
def sanitised_pages(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitised(F.col("html")).alias("s")).select("page_id", "s.html", F.array_join("s.removed", ",").alias("removed"))


@query("extracted_text")
def extracted_text(spark, d):
    return contents(spark, d).select("id", textindex.extracted(F.col("body").cast("binary")).alias("text"))


def _browser(spark, d):
    pages, e = table(spark, d, "pages"), table(spark, d, "events")
    urls = pages.select((F.col("page_id") % 200).alias("id"), F.col("page_id").alias("seq"), "url", F.concat(F.lit("Page "), "page_id").alias("title"), F.lit(1).alias("visit_count"), F.lit(0).alias("typed_count"))
    visits = e.where("event_type = 'view'").select(F.col("event_id").alias("visit_id"), (F.col("user_id") % 230).alias("url_id"), F.when(F.col("event_id") % 9 != 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("visited_at"))
    return visits, urls


_B = """u AS (SELECT page_id % 200 AS id, arg_max(url, page_id) AS url, 'Page ' || max(page_id) AS title FROM pages GROUP BY 1),
v AS (SELECT event_id AS visit_id, user_id % 230 AS url_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS visited_at FROM events WHERE event_type = 'view'),
hist AS (SELECT visit_id, url, title, visited_at FROM v LEFT JOIN u ON url_id = id)"""


@query("browser_history", f"WITH {_B} SELECT * FROM hist")
def browser_history(spark, d):
    return artefacts.browser_history(*_browser(spark, d)).select("visit_id", "url", "title", "visited_at")


@query("browser_urls_without_visits", f"WITH {_B} SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM hist WHERE url IS NOT NULL)")
def browser_urls_without_visits(spark, d):
    visits, urls = _browser(spark, d)
    history = artefacts.browser_history(visits, urls)
    return artefacts.urls_without_visits(urls, history).select(F.col("seq").alias("page_id"), "url")


@query("browser_products", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Firefox' END AS product FROM events")
def browser_products(spark, d):
    path = F.element_at(F.array(F.lit(r"C:\Users\a\AppData\Local\Google\Chrome\User Data\History"), F.lit("C:/Users/a/Mozilla/Firefox/Profiles/x/places.sqlite"), F.lit("/home/a/notes.txt")), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", artefacts.product_of(path).alias("product"))


@query("recycle_full_outer", "SELECT coalesce(d.doc_id, l.doc_id) AS suffix, d.n_chars AS n_chars, l.quality AS quality, CASE WHEN l.doc_id IS NULL THEN 'metadata' WHEN d.doc_id IS NULL THEN 'content' END AS orphan FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l USING (doc_id)")
def recycle_full_outer(spark, d):
    metadata = table(spark, d, "documents").where("doc_id % 3 != 0").select(F.lit("b").alias("bin"), F.lit("s").alias("sid"), F.col("doc_id").cast("string").alias("suffix"), "n_chars")
    content = table(spark, d, "labels").select(F.lit("b").alias("bin"), F.lit("s").alias("sid"), F.col("doc_id").cast("string").alias("suffix"), "quality")
    return artefacts.recycled(metadata, content).select(F.col("suffix").cast("long").alias("suffix"), "n_chars", "quality", "orphan")


@query("unlinked_messages", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3)")
def unlinked_messages(spark, d):
    c = table(spark, d, "conversations")
    return artefacts.unlinked(c.withColumnRenamed("conv_id", "node"), c.where("turn >= 3").select(F.col("conv_id").alias("node"))).select(F.col("node").alias("conv_id"), "turn")


_RELATED = """m AS (SELECT DISTINCT user_id AS member, event_type || '/' || (event_id % 3) AS item FROM events), g AS (SELECT member, string_agg(item, ',' ORDER BY item) AS items FROM m GROUP BY 1),
c AS (SELECT items, min(member) AS member, count(*) AS members FROM g GROUP BY 1), i AS (SELECT member, items, unnest(string_split(items, ',')) AS item FROM c)"""


def _belongings(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("member"), F.concat_ws("/", "event_type", F.col("event_id") % 3).alias("item"))


@query("related_evidence", f"WITH {_RELATED} SELECT a.member AS a, b.member AS b, count(*) AS shared FROM i a JOIN i b ON a.item = b.item AND a.member < b.member GROUP BY ALL")
def related_evidence(spark, d):
    return artefacts.related(artefacts.item_classes(_belongings(spark, d)))


@query("related_members", f"WITH {_RELATED} SELECT g.member, c.member AS class, c.members FROM g JOIN c USING (items)")
def related_members(spark, d):
    return artefacts.class_members(_belongings(spark, d)).select("member", "class", "members")


def _audit(spark, d):
    """A chain per conversation; each seventh conversation has its second entry altered afterwards."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    steps = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("steps"))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<seq:bigint,at:string,examiner:string,action:string,detail:string,prev_hash:string,hash:string>>").alias("rows"))

    def add(acc, s):
        at, examiner = s["turn"].cast("string"), F.when(s["turn"] % 2 == 0, F.lit("A. Examiner"))
        h = casebook.audit_hash(acc["last"], at, examiner, s["role"], F.lit("said"))
        row = F.struct(s["turn"].cast("long").alias("seq"), at.alias("at"), examiner.alias("examiner"), s["role"].alias("action"), F.lit("said").alias("detail"), acc["last"].alias("prev_hash"), h.alias("hash"))
        return F.struct(h.alias("last"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    chain = steps.select("conv_id", F.explode(F.aggregate("steps", start, add)["rows"]).alias("r")).select("conv_id", "r.*")
    second = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) == 2
    return chain.withColumn("detail", F.when((F.col("conv_id") % 7 == 0) & second, "altered").otherwise(F.col("detail")))


@query("audit_verify", "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM c) SELECT conv_id, count(*) AS entries, min(CASE WHEN conv_id % 7 = 0 AND rn = 2 THEN turn END) IS NULL AS intact, CAST(min(CASE WHEN conv_id % 7 = 0 AND rn = 2 THEN turn END) AS BIGINT) AS broken_at FROM n GROUP BY conv_id")
def audit_verify(spark, d):
    return casebook.audit_verdict(_audit(spark, d), ["conv_id"])


def _notes(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("examiner"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "examiner", F.lag(F.col("conv_id") * 1000 + F.col("turn")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("replaces"), F.when(F.col("conv_id") % 4 == 0, "2024").alias("retracted_at"))


_N = "n AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, min(role) AS examiner FROM conversations GROUP BY ALL)"


@query("note_history", f"WITH {_N} SELECT id, first_value(id) OVER (PARTITION BY conv_id ORDER BY turn) AS root, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS version FROM n")
def note_history(spark, d):
    return casebook.note_history(_notes(spark, d)).select("id", "root", "version")


@query("current_notes", f"WITH {_N}, x AS (SELECT id, first_value(examiner) OVER (PARTITION BY conv_id ORDER BY turn) AS author, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, conv_id FROM n) SELECT id, author FROM x WHERE back = 1 AND conv_id % 4 <> 0")
def current_notes(spark, d):
    return casebook.current_notes(_notes(spark, d)).select("id", "author")


@query("tag_counts", "SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS tag, count(*) AS n FROM labels GROUP BY 1")
def tag_counts(spark, d):
    return casebook.tag_counts(table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("tag")))


@query("attack_summary", "SELECT 'T' || (doc_id % 12) AS technique, arg_min('tactic-' || doc_id, doc_id) AS tactic, arg_min('name-' || doc_id, doc_id) AS name, count(*) FILTER (WHERE quality = 1) AS asserted, count(*) FILTER (WHERE quality = 0) AS proposed FROM labels GROUP BY 1")
def attack_summary(spark, d):
    t = table(spark, d, "labels")
    tags = t.select(F.concat(F.lit("T"), F.col("doc_id") % 12).alias("technique"), F.when(F.col("quality") == 1, "asserted").otherwise("proposed").alias("status"), F.concat(F.lit("tactic-"), "doc_id").alias("tactic"), F.concat(F.lit("name-"), "doc_id").alias("name"), F.lit("2024").alias("created_at"), F.col("doc_id").alias("id"))
    return casebook.attack_summary(tags)


@query("case_pulse", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels")
def case_pulse(spark, d):
    return casebook.pulse({n: table(spark, d, n) for n in ("documents", "pages", "labels")})


@query("triage", f"WITH {EV} SELECT CASE action WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity, action AS kind, count(*) AS n FROM ev GROUP BY ALL")
def triage(spark, d):
    e = timeline(spark, d)
    return casebook.triage(e.select(F.when(F.col("action") == "error", "high").when(F.col("action") == "purchase", "medium").otherwise("low").alias("severity"), F.col("action").alias("kind")))


_TAGS = """t AS (SELECT DISTINCT user_id % 60 AS evidence_id, 1 AS part, event_id % 40 AS node, event_type AS tag FROM events),
i AS (SELECT DISTINCT user_id % 60 AS evidence_id, 1 AS part, 'k' || (user_id % 60 % 17) AS key, user_id % 60 % 4 <> 0 AS live FROM events),
g AS (SELECT key, count(*) AS c, min(evidence_id) AS e FROM i WHERE live GROUP BY key),
k AS (SELECT evidence_id, coalesce(c, 0) AS c, e FROM i LEFT JOIN g USING (key) WHERE NOT live)"""


@query("tag_reassociation", f"WITH {_TAGS} SELECT t.evidence_id, t.node, t.tag, CASE WHEN c = 1 THEN e END AS new_evidence, CASE WHEN k.evidence_id IS NULL THEN 'kept' WHEN c = 0 THEN 'lost' WHEN c > 1 THEN 'ambiguous' WHEN EXISTS (SELECT 1 FROM t x WHERE x.evidence_id = e AND x.node = t.node AND x.tag = t.tag) THEN 'duplicate' ELSE 'moved' END AS status FROM t LEFT JOIN k ON k.evidence_id = t.evidence_id")
def tag_reassociation(spark, d):
    e = table(spark, d, "events")
    tags = e.select((F.col("user_id") % 60).alias("evidence_id"), F.lit(1).alias("part"), (F.col("event_id") % 40).alias("node"), F.col("event_type").alias("tag")).distinct()
    ids = e.select((F.col("user_id") % 60).alias("evidence_id"), F.lit(1).alias("part")).distinct().select("evidence_id", "part", F.concat(F.lit("k"), F.col("evidence_id") % 17).alias("key"), (F.col("evidence_id") % 4 != 0).alias("live"))
    return casebook.reassociate(tags, ids).select("evidence_id", "node", "tag", "new_evidence", "status")


@query("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return casebook.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_name", F.lit("changed")), ["c_custkey"])


@query("merged_partitions", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def merged_partitions(spark, d):
    docs = table(spark, d, "documents")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 != 0")
    return even.unionByName(odd).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("star_join_revenue", "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
