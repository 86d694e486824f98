"""Fill-in-middle: a text is cut at two unit boundaries and its middle is moved to the end.

Texts are handled as UTF-8 bytes and masks over them as big integers, one bit a byte.
``bytes.translate`` makes the mask of a class of bytes, shifts and boolean operations turn it into a
mask of the last bytes of units, ``bit_count`` counts the units, and the k-th of them is found by
halving the mask again and again.  All of it is linear in the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _class(members) -> bytes:
    return bytes(49 if b in members else 48 for b in range(256))


_NEWLINE = _class(b"\n")
_FOLLOWS = _class(range(0x80, 0xC0))  # bytes that go on with a code point
_BLANK = _class(b"\t\n\v\f\r ")


def mask(raw: bytes, kind: bytes) -> int:
    """Bit i is set where byte i of ``raw`` belongs to the class."""
    return int(raw.translate(kind)[::-1] or b"0", 2)


def unit_ends(raw: bytes, units: str = "lines") -> int:
    """The mask of the last byte of every unit of ``raw``.

    ``lines`` end with a newline, ``words`` before the next word (blanks belong to the word before them,
    leading ones to the first), ``chars`` are code points.  What is left at the end is a unit as well.
    """
    if not raw:
        return 0
    last = 1 << (len(raw) - 1)
    if units == "lines":
        return mask(raw, _NEWLINE) | last
    if units == "words":
        word = ((last << 1) - 1) ^ mask(raw, _BLANK)
        starts = word & ~(word << 1)
        starts &= starts - 1  # the first unit starts with the text
        return starts >> 1 | last
    if units == "chars":
        return (((last << 1) - 1) ^ mask(raw, _FOLLOWS)) >> 1 | last
    raise ValueError(f"unknown units: {units}")


def nth_bit(x: int, k: int) -> int:
    """The place of the k-th set bit of ``x``, both from 0."""
    width, place = x.bit_length(), 0
    while width > 1:
        half = width // 2
        low = x & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            x, width = low, half
        else:
            x, width, k, place = x >> half, width - half, k - below, place + half
    return place


def cut_after(ends: int, k: int) -> int:
    """The byte offset behind the first ``k`` units."""
    return nth_bit(ends, k - 1) + 1 if k else 0


def _code_points(raw: bytes) -> int:
    return len(raw) - mask(raw, _FOLLOWS).bit_count()


def rearrange(raw: bytes, draws, rate: int, spm: int, units: str, marks: tuple[bytes, bytes, bytes]):
    """(n, form, prefix_chars, middle_chars, output) of one text under four drawn numbers."""
    ends = unit_ends(raw, units)
    n = ends.bit_count()
    if not raw or any(m in raw for m in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, raw
    first, second = sorted(d % (n + 1) for d in draws[:2])
    a, b = cut_after(ends, first), cut_after(ends, second)
    head, middle, tail = raw[:a], raw[a:b], raw[b:]
    p, s, m = marks
    form = "spm" if draws[3] % 100 < spm else "psm"
    output = s + tail + p + head + m + middle if form == "spm" else p + head + s + tail + m + middle
    return n, form, _code_points(head), _code_points(middle), output


def transform(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, units: str = "lines", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of every document.

    The cuts and the form follow from ``seed`` and the id alone, so a lost task gives the same again and rows
    that repeat an id are cut alike by their own lengths.  ``rate`` per cent of texts are rearranged, of these
    ``spm`` per cent with the suffix first.  A null text is empty; an empty text, and one that spells a mark,
    stays plain with null lengths.  A null id draws as an empty one and stays null.  Whole texts of any length
    are cut; other columns are left out, whatever their names; an empty table gives an empty result.
    """
    if len(set(marks)) < 3 or not all(marks) or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("the three marks must differ and none may hold another")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    kind = documents.schema[id_col].dataType.simpleString()
    raw_marks = tuple(m.encode() for m in marks)

    def run(batches):
        for batch in batches:
            h = list(zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True))
            rows = [rearrange(raw, d, rate, spm, units, raw_marks) for raw, d in zip(utf8(batch.column(1)), h, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                [id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    shaped = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), *draws)
    return shaped.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``transform`` made ``output`` of; needs no more than the output and its form."""
    p, s, m = marks

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = """
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents
), drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM base
), cut AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                 WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
