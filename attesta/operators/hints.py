"""Known columns of well-known databases and the times they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unreversed_host
from ..functions.times import from_mac_absolute, from_unix, from_webkit

# (table, column, kind) of databases that browsers, phones and messengers keep, fixed values.
HINTS = (
    ("urls", "last_visit_time", "webkit"), ("visits", "visit_time", "webkit"), ("downloads", "start_time", "webkit"), ("downloads", "end_time", "webkit"), ("cookies", "creation_utc", "webkit"), ("cookies", "expires_utc", "webkit"), ("cookies", "last_access_utc", "webkit"),
    ("moz_places", "last_visit_date", "unix_us"), ("moz_places", "rev_host", "reversed_host"), ("moz_historyvisits", "visit_date", "unix_us"), ("moz_cookies", "expiry", "unix_s"), ("moz_cookies", "lastAccessed", "unix_us"), ("moz_cookies", "creationTime", "unix_us"),
    ("moz_bookmarks", "dateAdded", "unix_us"), ("moz_formhistory", "firstUsed", "unix_us"), ("moz_formhistory", "lastUsed", "unix_us"), ("history_visits", "visit_time", "mac"), ("sms", "date", "unix_ms"), ("calls", "date", "unix_ms"), ("messages", "timestamp", "unix_ms"),
    ("LSQuarantineEvent", "LSQuarantineTimeStamp", "mac"), ("ZCALLRECORD", "ZDATE", "mac"),
)
DECODERS = {"webkit": from_webkit, "unix_s": from_unix, "unix_ms": lambda c: from_unix(c, "ms"), "unix_us": lambda c: from_unix(c, "us"), "mac": from_mac_absolute, "reversed_host": unreversed_host}


def decoded(rows: DataFrame, table: str, hints=HINTS) -> DataFrame:
    """``rows`` of a table with a ``<column>_decoded`` beside each known column."""
    known = {c: k for t, c, k in hints if t.lower() == table.lower()}
    return rows.withColumns({f"{c}_decoded": DECODERS[k](F.col(f"`{c}`")) for c, k in known.items() if c in rows.columns})
