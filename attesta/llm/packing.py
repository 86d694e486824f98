"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's ids are cut into pieces of the sequence length and a remainder.  Pieces go to groups by
a hash of their document and start beside a drawn number, each group of about ``GROUP`` pieces is packed by itself, and the number
of groups follows the number of pieces, so a group fits a task at any size of the table.  The tree
holds the free room of every open sequence and the larger of two rooms at each inner node; the first
sequence that fits a piece is found by one walk from the root.

Ids come from a byte-level BPE.  Texts are encoded by the rank table of the same vocabulary, whose
ids equal those of the tokenizer file and cost a sixth of the time.  A text that spells a special
token goes through the tokenizer file itself, which reads it as that token, and so does a text with a
very long run of blanks or of anything else without a blank, on which the faster one can fail.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8

LENGTH, END, GROUP = 2048, 1, 4096
#: Bytes of a run of blanks, or of a run without one, above which the tokenizer file itself reads a text.
RUN = 10_000
_SPECIAL = b"<|endoftext|>"
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_loaded: dict = {}


def longest_run(text: bytes) -> int:
    """Bytes of the longest run of ASCII blanks or of other bytes."""
    blank = _BLANK[np.frombuffer(text, dtype=np.uint8)]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return int(np.diff(np.concatenate(([0], turns, [len(text)]))).max()) if len(text) else 0


class Encoder:
    """Ids of a text as ``tokenizers`` gives them for ``json_path`` without special tokens added."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: bytes) -> np.ndarray:
        said = text.decode("utf-8", "replace")
        if self.fast is None or _SPECIAL in text or len(text) > RUN and longest_run(text) > RUN:
            return np.array(self.slow.encode(said, add_special_tokens=False).ids, dtype="<u4")
        try:
            return np.array(self.fast.encode_ordinary(said), dtype="<u4")
        except BaseException as failure:  # a panic of the compiled library is no Exception
            if type(failure).__name__ != "PanicException":
                raise
            return np.array(self.slow.encode(said, add_special_tokens=False).ids, dtype="<u4")


def default_files() -> tuple[str, str | None, str | None]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(documents: DataFrame, files=None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids where asked for."""
    files = files or default_files()
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()} | ({"ids": pa.list_(pa.int64())} if keep_ids else {})

    def run(batches):
        if files not in _loaded:
            _loaded[files] = Encoder(*files)
        encode = _loaded[files]
        for batch in batches:
            out: list = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = np.append(encode(text), np.array([end], dtype="<u4")).astype("<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    out.append((doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.tolist(),) if keep_ids else ()))
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins count from 0.  Equal lengths keep their order."""
    n = len(lengths)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    tree = [room] * (2 * leaves)
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        where[i], offset[i] = node - leaves, room - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return where, offset


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 17) -> DataFrame:
    """``parts`` with sequence_id and offset.  Every piece lies in exactly one sequence, gapless from 0.

    Needs doc_id, start and length (1 to ``length``); keeps every other column.  Equal rows are
    packed as pieces of their own.  An empty table gives an empty result.
    """
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", F.rand(seed)), F.lit(groups)).cast("long"))
    dealt = cut(dealt)
    names = parts.columns

    def run(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "start")])
        where, offset = first_fit_decreasing(order.column("length").to_numpy(), length)
        base = (order.column("_group")[0].as_py() << 32) if len(order) else 0
        out = order.select(names)
        return out.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(documents: DataFrame, files=None, length: int = LENGTH, end: int = END, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """All ``documents`` as pieces in sequences of at most ``length`` ids.

    A document's ids are followed by ``end``; a null or empty text is that one id.  Columns: doc_id,
    start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset.  Rows that repeat a doc_id are
    packed each, and a null doc_id stays null.  Other columns are ignored.
    """
    return pack(cut(pieces(documents, files, length, end, id_col, text_col, keep_ids)), length, group)
