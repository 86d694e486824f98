"""Sections of a system report as path filters over registry rows (path, name, value, modified)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rot13
from ..functions.times import from_filetime, to_iso


@dataclass(frozen=True)
class Section:
    """Keys whose lower-cased path matches, and the values that are told (all where none is named)."""

    name: str
    path: str
    values: tuple[str, ...] = ()
    turned: bool = False


_CONTROL = r"(?:currentcontrolset|controlset\d{3})\\"
# Where Windows keeps what a report tells, fixed values; paths are below the hive's root.
SECTIONS = (
    Section("system", r"microsoft\\windows nt\\currentversion", ("ProductName", "CurrentBuild", "CurrentBuildNumber", "InstallDate", "RegisteredOwner", "EditionID", "DisplayVersion")),
    Section("computer_name", _CONTROL + r"control\\computername\\computername", ("ComputerName",)),
    Section("time_zone", _CONTROL + r"control\\timezoneinformation", ("TimeZoneKeyName", "Bias", "ActiveTimeBias", "StandardName", "DaylightName")),
    Section("last_shutdown", _CONTROL + r"control\\windows", ("ShutdownTime",)),
    Section("autostart", r"(?:software\\)?microsoft\\windows\\currentversion\\run(?:once)?"),
    Section("services", _CONTROL + r"services\\[^\\]+", ("DisplayName", "ImagePath", "Start")),
    Section("usb_storage", _CONTROL + r"enum\\usbstor\\[^\\]+\\[^\\]+", ("FriendlyName", "ParentIdPrefix", "ContainerID")),
    Section("mounted_devices", r"mounteddevices"),
    Section("network_profiles", r"microsoft\\windows nt\\currentversion\\networklist\\profiles\\[^\\]+", ("ProfileName", "Description", "DateCreated", "DateLastConnected")),
    Section("interfaces", _CONTROL + r"services\\tcpip\\parameters\\interfaces\\[^\\]+", ("DhcpIPAddress", "IPAddress", "DhcpServer", "Domain", "LeaseObtainedTime")),
    Section("typed_urls", r"software\\microsoft\\internet explorer\\typedurls"),
    Section("recent_documents", r"software\\microsoft\\windows\\currentversion\\explorer\\recentdocs(?:\\[^\\]+)?"),
    Section("user_assist", r"software\\microsoft\\windows\\currentversion\\explorer\\userassist\\[^\\]+\\count", (), True),
    Section("profiles", r"microsoft\\windows nt\\currentversion\\profilelist\\s-1-[^\\]+", ("ProfileImagePath",)),
)


def report(rows: DataFrame, sections: tuple[Section, ...] = SECTIONS) -> DataFrame:
    """section, path, name, value and modified of the values that sections tell.

    One pass over the rows: a row is matched against every section in one expression.
    """
    path = F.lower("path")
    hits = F.array_compact(F.array(*(
        F.when(path.rlike(f"^{s.path}$") & (F.lower("name").isin(*(v.lower() for v in s.values)) if s.values else F.col("name").isNotNull()), F.struct(F.lit(s.name).alias("section"), F.lit(s.turned).alias("turned")))
        for s in sections
    )))
    out = rows.where("name is not null").select("path", "name", "value", "modified", F.explode(hits).alias("h"))
    return out.select("h.section", "path", F.when(F.col("h.turned"), rot13(F.col("name"))).otherwise(F.col("name")).alias("name"), "value", "modified")


def section_counts(told: DataFrame) -> DataFrame:
    return told.groupBy("section").agg(F.count("*").alias("n"))


def shutdown_time(told: DataFrame) -> DataFrame:
    """The last shutdown as a time; the registry keeps it as eight bytes, told in hexadecimal."""
    raw = F.col("value")
    turned = F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.substring(raw, i, F.lit(2)))), "")
    return told.where("section = 'last_shutdown'").select("path", to_iso(from_filetime(F.conv(turned, 16, 10))).alias("at"))


def path_of_keys(keys: DataFrame, depth: int = 64) -> DataFrame:
    """Paths of (key_offset, parent_offset, name) rows by looking twice as far up each round."""
    at = keys.select("key_offset", F.col("parent_offset").alias("up"), F.when(F.col("parent_offset").isNull(), "").otherwise(F.col("name")).alias("path"))
    step = 1
    while step < depth:
        above = at.select(F.col("key_offset").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = at.join(above, "up", "left")
        longer = F.when(F.coalesce(F.col("_path"), F.lit("")) == "", F.col("path")).otherwise(F.concat_ws("\\", "_path", "path"))
        at = joined.select("key_offset", F.col("_up").alias("up"), longer.alias("path"))
        step *= 2
    return at.select("key_offset", "path")
