"""Relations over parsed artefacts: journals, browsers, recycle bins, mail and shadow copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.times import from_unix, from_webkit
from .intervals import merge
from .scratch import cut

#: Rows that meet in one task of ``related_to``, on average, and rows of the asked that come to all tasks at once.
MEETINGS, ASKED = 1_000_000, 500_000


def journal_fold(journal: DataFrame) -> DataFrame:
    """One row per name without case and file: records, all reasons, first and last time, the name as first read."""
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons"))))
    return journal.groupBy(F.lower("name").alias("key"), "mft").agg(
        F.count("*").alias("records"), reasons.alias("reasons"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.min_by("name", "usn").alias("name")
    )


def gone_names(folded: DataFrame, entries: DataFrame) -> DataFrame:
    """Folded names with ``gone``: deleted in the journal, and the file has no such name now."""
    live = entries.select("mft", F.lower("name").alias("key"), F.lit(True).alias("_live")).distinct()
    out = folded.join(live, ["mft", "key"], "left")
    return out.withColumn("gone", F.array_contains("reasons", "deleted") & F.col("_live").isNull()).drop("_live")


def browser_history(visits: DataFrame, urls: DataFrame) -> DataFrame:
    """Visits with the URL row they point at, newest first with null as oldest; of several rows with
    one id the last by ``seq`` counts."""
    pages = urls.groupBy("id").agg(F.max_by(F.struct("url", "title", "visit_count", "typed_count"), "seq").alias("u"))
    out = visits.join(pages, visits["url_id"] == pages["id"], "left")
    return out.select("visit_id", "u.*", "visited_at").orderBy(F.coalesce("visited_at", F.lit("")).desc(), "visit_id")


def urls_without_visits(urls: DataFrame, history: DataFrame) -> DataFrame:
    """URL rows whose url no visit shows, with a note."""
    return urls.join(history.select("url").distinct(), "url", "left_anti").withColumn("note", F.lit("no visit recorded"))


def chromium_downloads(downloads: DataFrame, chains: DataFrame) -> DataFrame:
    """Downloads with the last URL of their redirect chain (id, chain_index, url), null where none is kept."""
    last = chains.groupBy("id").agg(F.max_by("url", "chain_index").alias("url"))
    return downloads.join(last, "id", "left").select(
        "id", F.col("target_path").alias("target"), "url", from_webkit(F.col("start_time")).alias("started_at"), from_webkit(F.col("end_time")).alias("finished_at"),
        F.col("received_bytes").alias("bytes"), "total_bytes", F.coalesce(F.col("opened") != 0, F.lit(False)).alias("opened"), F.lit("chromium").alias("source"),
    )


def firefox_downloads(annotations: DataFrame, attributes: DataFrame, places: DataFrame) -> DataFrame:
    """Annotations that name a download's target, with the page they belong to; the time is that of its last visit."""
    named = attributes.where(F.col("name") == "downloads/destinationFileURI").select(F.col("id").alias("anno_attribute_id")).distinct()
    pages = places.select(F.col("id").alias("place_id"), "url", "last_visit_date")
    said = annotations.join(named, "anno_attribute_id", "left_semi").join(pages, "place_id", "left")
    return said.select("id", F.col("content").alias("target"), "url", from_unix(F.col("last_visit_date"), "us").alias("started_at"), F.lit("firefox").alias("source"))


def chromium_cookies(cookies: DataFrame) -> DataFrame:
    """Cookies of a Chromium profile under common names; a value that is kept encrypted is told, not read."""
    flag = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    return cookies.select(
        F.col("host_key").alias("host"), "name", "path", from_webkit(F.col("creation_utc")).alias("created_at"), from_webkit(F.col("expires_utc")).alias("expires_at"), from_webkit(F.col("last_access_utc")).alias("last_access"),
        flag("is_secure").alias("secure"), flag("is_httponly").alias("http_only"), (F.coalesce(F.octet_length("encrypted_value"), F.lit(0)) > 0).alias("encrypted"), F.lit("chromium").alias("source"),
    )


def firefox_cookies(cookies: DataFrame) -> DataFrame:
    """Cookies of a Firefox profile under the same names; ``expiry`` is in seconds, the other times in microseconds."""
    flag = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    return cookies.select(
        "host", "name", "path", from_unix(F.col("creationTime"), "us").alias("created_at"), from_unix(F.col("expiry")).alias("expires_at"), from_unix(F.col("lastAccessed"), "us").alias("last_access"),
        flag("isSecure").alias("secure"), flag("isHttpOnly").alias("http_only"), F.lit(False).alias("encrypted"), F.lit("firefox").alias("source"),
    )


def recovered_urls(records: DataFrame) -> DataFrame:
    """Deleted rows that hold a URL, of ``values`` ARRAY<STRUCT<text STRING, number BIGINT>>.

    url: the first text with a web or file scheme; title: the first other text of over three characters;
    visited_at: the first number that reads as a time, in microseconds since 1601 or since 1970.
    """
    texts = F.filter(F.transform("values", lambda v: v["text"]), lambda t: t.isNotNull())
    url = F.try_element_at(F.filter(texts, lambda t: t.rlike("^(https?|ftp|file)://")), F.lit(1))
    title = F.try_element_at(F.filter("_texts", lambda t: (t != F.col("url")) & (F.length(t) > 3)), F.lit(1))
    webkit = lambda n: (n > F.lit(10**16)) & (n < F.lit(14 * 10**16))
    stamp = F.try_element_at(F.filter(F.transform("values", lambda v: v["number"]), lambda n: webkit(n) | ((n > F.lit(10**15)) & (n < F.lit(2 * 10**15)))), F.lit(1))
    out = records.withColumns({"_texts": texts, "url": url, "_stamp": stamp}).where("url is not null")
    seen = F.when(webkit(F.col("_stamp")), from_webkit(F.col("_stamp"))).otherwise(from_unix(F.col("_stamp"), "us"))
    return out.withColumns({"title": title, "visited_at": seen, "deleted": F.lit(True)}).drop("_texts", "_stamp", "values")


def cache_key_url(key: Column) -> Column:
    """The URL within a browser's HTTP cache key, null where the key holds none.

    A key is a URL itself, or ``credential/upload/[_dk_... ]url``: the part behind the second slash,
    and behind its last space where it starts with the mark of a partitioned cache.
    """
    rest = F.regexp_extract(key, r"(?s)^[^/]*/[^/]*/(.*)$", 1)
    inner = F.when(rest.startswith("_dk_"), F.when(F.contains(rest, F.lit(" ")), F.regexp_extract(rest, r"(?s)^.* (.*)$", 1)).otherwise("")).otherwise(rest)
    return F.when(key.rlike("^(https?|ftp|file|wss?)://"), key).when(inner.rlike("(?i)^[a-z][a-z0-9+.-]*:"), inner)


def http_status(head: Column) -> Column:
    """The status of the last HTTP status line in a text, null without one."""
    return F.try_element_at(F.regexp_extract_all(head, F.lit(r"HTTP/\d(?:\.\d)? +(\d{3})"), F.lit(1)), F.lit(-1)).cast("int")


PRODUCTS = (("\\google\\chrome\\", "Chrome"), ("\\microsoft\\edge\\", "Edge"), ("\\brave-browser\\", "Brave"), ("\\opera software\\", "Opera"), ("\\vivaldi\\", "Vivaldi"), ("\\mozilla\\firefox\\", "Firefox"))


def product_of(path: Column) -> Column:
    """The browser whose profile a path lies in; the first that fits."""
    said = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    out = None
    for part, name in PRODUCTS:
        test = F.contains(said, F.lit(part))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def recycled(metadata: DataFrame, content: DataFrame) -> DataFrame:
    """Recycle-bin records of (bin, sid, suffix) with both halves, and which half an orphan is."""
    key = ["bin", "sid", "_key"]
    i = metadata.withColumn("_key", F.lower("suffix")).drop("suffix").withColumn("_i", F.lit(True))
    r = content.withColumn("_key", F.lower("suffix")).drop("suffix").withColumn("_r", F.lit(True))
    orphan = F.when(F.col("_r").isNull(), "metadata").when(F.col("_i").isNull(), "content")
    return i.join(r, key, "full").withColumn("orphan", orphan).drop("_i", "_r").withColumnRenamed("_key", "suffix")


def unlinked(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Messages that no folder holds."""
    return messages.join(links.select("node").distinct(), "node", "left_anti")


def overlay(layers: DataFrame, by: list[str]) -> DataFrame:
    """The block of the first layer (smallest ``layer``) that has it, for each place."""
    rest = [c for c in layers.columns if c not in (*by, "layer")]
    return layers.groupBy(*by).agg(F.min("layer").alias("layer"), F.min_by(F.struct(*rest), "layer").alias("_b")).select(*by, "layer", "_b.*")


def raid_address(blocks: DataFrame, members: int, stripe_blocks: int, level: int = 5) -> DataFrame:
    """Adds row, member and member_block of each logical block of a stripe set.

    Level 0 has no parity; level 5 rotates it from the last member down, and data follow after it.
    """
    data = members if level == 0 else members - 1
    stripe = F.floor(F.col("block") / stripe_blocks)
    row = F.floor(stripe / data)
    at = stripe % data
    member = at if level == 0 else (F.lit(members - 1) - row % members + 1 + at) % members
    return blocks.withColumns({"row": row, "member": member.cast("int"), "member_block": (row * stripe_blocks + F.col("block") % stripe_blocks).cast("long")})


def parity_mismatch(words: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a stripe set whose 64-bit words over all members do not cancel out."""
    return words.groupBy(*by).agg(F.bit_xor("word").alias("parity")).where("parity != 0")


def parity_ranges(words: DataFrame, chunk: int, members: int, by: list[str], tasks: int | None = None) -> DataFrame:
    """(*by, start, end, n): logical ranges of a stripe set whose rows do not cancel out; ``n`` rows in each.

    Words are (*by, row, word at the same place of each member, at); a row is wrong if any of its words is.
    Wrong rows are merged in ``tasks``, if given.
    """
    wrong = parity_mismatch(words, [*by, "row", "at"]).select(*by, "row").distinct()
    span = chunk * (members - 1)
    return merge(wrong.select(*by, (F.col("row") * span).alias("start"), ((F.col("row") + 1) * span).alias("end")), by, tasks=tasks)


def mirror_ranges(sectors: DataFrame, primary: Column, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Where the members of mirrored sets differ from the primary: ranges (*by, start, end), and per set a summary.

    Sectors are (*by, member, offset, length, content), ``content`` being the bytes or a digest of them; a place that
    the primary lacks is not compared.  Summaries are (*by, compared_bytes, differing_ranges, differing_bytes,
    differing_members); sets that agree have a row of zeros.  Members meet by sector, so a set of any size is many
    tasks' work.
    """
    base = sectors.where(primary).select(*by, "offset", "length", F.col("content").alias("_base"))
    met = base.join(sectors.where(~primary).select(*by, "offset", "member", "content"), [*by, "offset"], "left")
    told = met.withColumn("_differs", F.col("member").isNotNull() & ~F.col("content").eqNullSafe(F.col("_base")))
    places = told.where("_differs").select(*by, F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end")).distinct()
    ranges = merge(places, by).drop("n")
    sums = ranges.groupBy(*by).agg(F.count("*").alias("differing_ranges"), F.sum(F.col("end") - F.col("start")).alias("differing_bytes"))
    members = told.where("_differs").groupBy(*by).agg(F.array_sort(F.collect_set("member")).alias("differing_members"))
    every = base.groupBy(*by).agg(F.sum("length").alias("compared_bytes"))
    out = every.join(sums, by, "left").join(members, by, "left")
    kind = sectors.schema["member"].dataType
    return ranges, out.select(*by, "compared_bytes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("differing_ranges", "differing_bytes")), F.coalesce("differing_members", F.array().cast(ArrayType(kind))).alias("differing_members"))


# Windows logon types, fixed values.
LOGON_TYPES = {
    2: "interactive", 3: "network", 4: "batch", 5: "service", 7: "unlock", 8: "network, clear text", 9: "new credentials",
    10: "remote interactive (Remote Desktop)", 11: "cached interactive",
}


def described(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Events with the description of their (provider, event_id), null where none is known.

    Where the catalogue marks an event ``with_logon`` and the event has a ``logon_type``, its meaning follows.
    """
    more = [c for c in ("with_logon",) if c in catalogue.columns]
    out = events.join(catalogue.select("provider", "event_id", "description", *more), ["provider", "event_id"], "left")
    if not more or "logon_type" not in events.columns:
        return out.drop(*more)
    names = F.create_map(*(F.lit(x) for pair in LOGON_TYPES.items() for x in pair))
    kind = F.col("logon_type").cast("int")
    suffix = F.concat(F.lit(" (logon type "), kind, F.lit(": "), F.coalesce(F.try_element_at(names, kind), F.lit("unrecognised")), F.lit(")"))
    return out.withColumn("description", F.concat("description", F.when(F.col("with_logon") & kind.isNotNull(), suffix).otherwise(""))).drop("with_logon")


def latest_usable(versions: DataFrame, by: list[str], usable, sequence: str = "sequence") -> DataFrame:
    """The newest version of each thing that is ``usable``, a column; things without one are left out."""
    rest = [c for c in versions.columns if c not in by]
    return versions.where(usable).groupBy(*by).agg(F.max_by(F.struct(*rest), sequence).alias("_v")).select(*by, "_v.*")


def inventory(rows: DataFrame) -> DataFrame:
    """Programs of an application inventory in registry rows (path, name, value): one row per key."""
    wanted = ("LowerCaseLongPath", "FileId", "Name", "Publisher", "Version", "LinkDate", "Size", "ProductName")
    held = rows.where(F.lower("path").rlike(r"(^|\\)inventoryapplicationfile\\[^\\]+$") & F.col("name").isin(*wanted))
    out = held.groupBy("path", "modified").agg(*(F.max(F.when(F.col("name") == w, F.col("value"))).alias(w) for w in wanted))
    # The id is four zeros and a SHA-1.
    return out.select("path", "modified", F.col("LowerCaseLongPath").alias("program"), F.when(F.length("FileId") == 44, F.substring("FileId", 5, 40)).alias("sha1"), F.col("Name").alias("name"), F.col("Publisher").alias("publisher"), F.col("Version").alias("version"), F.col("LinkDate").alias("linked_at"), F.col("Size").cast("long").alias("size"), F.col("ProductName").alias("product"))


def item_classes(belongings: DataFrame) -> DataFrame:
    """(class, items, members): members that have the very same items, of (member, item), named by the least of them."""
    held = belongings.groupBy("member").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return held.groupBy("items").agg(F.min("member").alias("class"), F.count("*").alias("members")).select("class", "items", "members")


def class_members(belongings: DataFrame) -> DataFrame:
    """(member, class, items, members): the class that each member is in."""
    held = belongings.groupBy("member").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return held.join(item_classes(belongings), "items")


def related(classes: DataFrame) -> DataFrame:
    """(a, b, shared): how many items two classes of members have in common, where they have any.

    Members with the same items meet as one class, so pairs grow with what members have, not with how
    many there are; ``class_members`` tells who is behind a class.
    """
    each = classes.select("class", F.explode("items").alias("item"))
    both = each.withColumnRenamed("class", "a").join(each.withColumnRenamed("class", "b"), "item").where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))


def related_to(belongings: DataFrame, asked: DataFrame) -> DataFrame:
    """(member, related, shared): for each asked member the others that have items of it, and how many.

    The work is what the asked have and who else has it, whatever the number of members; no pairs of others meet.
    Rows are dealt by the other member over as many tasks as there are ``MEETINGS``, and what the asked have comes to
    them, in slices of ``ASKED`` rows; so pairs are counted where they meet and never exchanged.
    """
    own = cut(belongings.distinct())
    wanted = cut(own.join(asked.select("member").distinct(), "member", "left_semi"))
    total, meetings = own.join(wanted.groupBy("item").agg(F.count("*").alias("n")), "item").agg(F.lit(wanted.count()), F.coalesce(F.sum("n"), F.lit(0))).first()
    slices = max(1, -(-total // ASKED))
    tasks = max(8, -(-meetings // (slices * MEETINGS)))
    dealt = own.withColumnRenamed("member", "related").repartition(tasks, "related")
    counted = []
    for i in range(slices):
        some = F.broadcast(wanted.where(F.pmod(F.xxhash64("member"), F.lit(slices)) == i))
        counted.append(dealt.join(some, "item").where("member != related").groupBy("member", "related").agg(F.count("*").alias("shared")))
    return reduce(DataFrame.unionByName, counted)
