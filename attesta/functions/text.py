"""String functions of listings, exports and searches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def extension_of_name(name: Column) -> Column:
    """Text after the last dot, lower-cased; empty without a dot."""
    return F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(""))


def extension_of_file(name: Column) -> Column:
    """As above, but names that begin with their only dot and extensions over 12 characters have none."""
    found = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.when(F.length(found) <= 12, found).otherwise("")


def like_contains(c: Column, needle: str) -> Column:
    """Substring test that ignores the case of A-Z only and takes no character for a wildcard."""
    return F.contains(ascii_lower(c), F.lit("".join(_LOWER[_UPPER.index(x)] if x in _UPPER else x for x in needle)))


def csv_safe(c: Column) -> Column:
    """Guards text that a spreadsheet would run as a formula."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def rot13(c: Column) -> Column:
    letters = _UPPER + _LOWER
    turned = _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13]
    return F.translate(c, letters, turned)


def unreversed_host(c: Column) -> Column:
    """A host stored backwards, as some browsers do, without the dot it then ends with."""
    return F.regexp_replace(F.reverse(c), r"^\.", "")


def excerpt(c: Column, at: Column, before: int = 32, after: int = 32) -> Column:
    """Text round a 1-based position, with what cannot be printed shown as a middle dot."""
    start = F.greatest(at - before, F.lit(1))
    return F.regexp_replace(F.substring(c, start, at + after - start), r"[^\x20-\x7e -￿]", "·")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def casefold(c: Column) -> Column:
    """Full case folding; plain lower-casing serves where a text is ASCII."""

    @F.arrow_udf(T.StringType())
    def fold(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())

    return F.when(c.rlike(r"^[\x00-\x7f]*$"), F.lower(c)).otherwise(fold(c))


class _Visible(HTMLParser):
    HIDDEN = frozenset({"script", "style", "head", "title", "template", "noscript"})
    BLOCKS = frozenset({"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "blockquote", "pre"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_of(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return " ".join("".join(parser.parts).split())


@F.arrow_udf(T.StringType())
def visible_text(html: pa.Array) -> pa.Array:
    """What a reader of an HTML page sees, as one line of text."""
    return pa.array([visible_of(h) for h in html.to_pylist()], pa.string())


_ACTIVE_TAGS = frozenset({"script", "iframe", "object", "embed", "form", "link", "meta", "base", "applet", "frame", "frameset"})
_LINKS = frozenset({"href", "src", "srcset", "action", "formaction", "background", "poster", "data", "xlink:href"})


class _Sanitiser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.removed, self.hidden = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in _ACTIVE_TAGS:
            self.removed.append(f"<{tag}>")
            if tag in ("script", "iframe", "object", "applet", "frameset"):
                self.hidden.append(tag)
            return
        if self.hidden:
            return
        kept = []
        for name, value in attrs:
            remote = name in _LINKS and not (value or "").strip().lower().startswith(("#", "data:image/"))
            if name.startswith("on") or remote or (name == "style" and "url(" in (value or "").lower()):
                self.removed.append(f"{tag} {name}")
            else:
                kept.append(f' {name}="{(value or "").replace("&", "&amp;").replace(chr(34), "&quot;")}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif not self.hidden and tag not in _ACTIVE_TAGS:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


@F.arrow_udf(T.StructType().add("html", "string").add("removed", T.ArrayType(T.StringType())))
def sanitised(html: pa.Array) -> pa.Array:
    """HTML without scripts, handlers, frames and remote references, and what was taken out."""
    rows = []
    for h in html.to_pylist():
        if h is None:
            rows.append(None)
            continue
        parser = _Sanitiser()
        parser.feed(h)
        parser.close()
        rows.append({"html": "".join(parser.out), "removed": parser.removed})
    return pa.array(rows, pa.struct([("html", pa.string()), ("removed", pa.list_(pa.string()))]))
