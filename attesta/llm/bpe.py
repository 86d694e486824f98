"""Byte-level BPE: encoding and decoding with a published vocabulary.

A text is split into words by the pattern of the vocabulary, and each word is merged by itself.  A
short word lies in a contiguous array of parts beside the ranks of its adjacent pairs: the smallest
rank is looked for by a scan, the boundary between its two parts goes, and the two ranks beside it
are looked up anew.  Words of up to ``SHORT`` bytes are rows of one matrix each step of which scans and
merges all of them.  Scans of a word of n bytes cost n * n, so longer words keep the same ranks in a heap
over a linked list, which gives the same parts in n * log n.

Ids are those of the ``tokenizers`` library for the same file, special tokens in the text included.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import utf8, worker_store

SHORT = 64
#: Bytes of text whose words are looked up together.
PIECE = 4 << 20
#: Words that a worker remembers at most; beyond it begins anew.
REMEMBERED = 400_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BITS = 20
_ID = (1 << _BITS) - 1
_NONE, _LAST = 1 << 62, 2**31 - 1
# Texts of code points below U+0180, whose UTF-8 bytes are these, are split by the same pattern with its classes spelt out.
_LATIN = 0x180
_LATIN_BYTES = bytes(range(0xC6))


def _latin_pattern() -> str:
    def members(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(_LATIN) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers, blank = members("L"), members("N"), "\\t-\\r \\x85\\xa0"
    return rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{blank}{letters}{numbers}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A byte-level vocabulary read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, splits, added = said["model"], said["pre_tokenizer"] or {}, said["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or said["normalizer"] or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex", True) or said["decoder"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or need word bounds are not supported")
        letters, vocab = byte_letters(), model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in added}
        for token, i in self.added.items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges.setdefault(vocab[a] << _BITS | vocab[b], rank << _BITS | vocab[a + b])
        self.splitter, self.latin = regex.compile(PATTERN), re.compile(_latin_pattern())
        # Code points that this Python doesn't know as assigned may belong to other classes in the library.
        self.library = Tokenizer.from_file(path).pre_tokenizer
        pairs = np.array([*sorted((k, v >> _BITS) for k, v in self.merges.items()), (_NONE, _LAST)], dtype=np.int64)
        self.pairs, self.rank_of = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        self.merged = np.zeros(len(model["merges"]) + 1, dtype=np.int32)
        self.merged[[v >> _BITS for v in self.merges.values()]] = [v & _ID for v in self.merges.values()]
        self.byte_table = np.array(self.byte_ids, dtype=np.int32)
        # Bytes of all tokens behind one another, with the start and the length of each.
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: Little-endian 32-bit ids by word.
        self.words: dict[str, bytes] = {}
        names = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(names) + ")") if names else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts, ``_LAST`` where they don't merge."""
        key = left.astype(np.int64) << _BITS | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.rank_of[at], np.int32(_LAST))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, 40), (40, SHORT)):
            which = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(which):
                self._merge_rows([words[i] for i in which.tolist()], sizes[which], which, out, high)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = np.array(self._encode_long([self.byte_ids[b] for b in words[i]]), dtype="<i4").tobytes()
        return out

    def _merge_rows(self, words: list[bytes], n: np.ndarray, which: np.ndarray, out: list[bytes], width: int) -> None:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        parts, n = self.byte_table[raw], n.copy()
        # One column more than there are pairs, so that the last step has a rank to look at.
        ranks = np.full(parts.shape, _LAST, dtype=np.int32)
        ranks[:, :-1] = np.where(np.arange(width - 1) < (n - 1)[:, None], self._ranks(parts[:, :-1], parts[:, 1:]), _LAST)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            over = best == _LAST
            if over.any():
                ended = parts[over][np.arange(parts.shape[1]) < n[over][:, None]].astype("<i4").tobytes()
                ends = (np.cumsum(n[over]) * 4).tolist()
                for i, a, z in zip(which[over].tolist(), [0, *ends], ends, strict=False):
                    out[i] = ended[a:z]
                going = ~over
                which, parts, ranks, n, at, best = which[going], parts[going], ranks[going], n[going], at[going], best[going]
                if not len(which):
                    return
            # The boundary behind part ``at`` goes, and with it a column of both arrays.
            m, w = parts.shape
            rows, columns = np.arange(m), np.arange(w)
            parts[rows, at] = self.merged[best]
            parts = parts[columns != at[:, None] + 1].reshape(m, w - 1)
            ranks = ranks[columns != at[:, None]].reshape(m, w - 1)
            n -= 1
            for where, has in ((at, at + 1 < n), (at - 1, at > 0)):
                r, c = rows[has], where[has]
                ranks[r, c] = self._ranks(parts[r, c], parts[r, c + 1])

    def encode_word(self, word: bytes) -> list[int]:
        return np.frombuffer(self.encode_words([word])[0], dtype="<i4").tolist()

    def _encode_long(self, parts: list[int]) -> list[int]:
        look, n = self.merges.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := look(parts[i] << _BITS | parts[i + 1])) is not None]
        heapify(waiting)
        while waiting:
            rank, i, a, b = heappop(waiting)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = rank & _ID, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := look(parts[i] << _BITS | parts[k])) is not None:
                    heappush(waiting, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := look(parts[h] << _BITS | parts[i])) is not None:
                heappush(waiting, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def split(self, text: str, raw: bytes) -> list[str]:
        if not raw.translate(None, _LATIN_BYTES):
            return self.latin.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.splitter.findall(text)

    def _pieces(self, raw: bytes) -> list[list[str] | int]:
        """Lists of words of a text, and the ids of special tokens between them."""
        text = raw.decode("utf-8", "replace")
        if self.marks is None or not self.marks.search(text):
            return [self.split(text, raw)]
        return [self.added[p] if p in self.added else self.split(p, p.encode()) for p in self.marks.split(text) if p]

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole UTF-8 texts, as little-endian 32-bit numbers.  Words not met before are merged together."""
        known, new, found = self.words, set(), []
        for raw in texts:
            pieces = self._pieces(raw)
            ids = [piece.to_bytes(4, "little") if isinstance(piece, int) else list(map(known.get, piece)) for piece in pieces]
            missing = any(None in x for x in ids if isinstance(x, list))
            if missing:
                new.update(w for x, piece in zip(ids, pieces, strict=True) if isinstance(x, list) for w, k in zip(piece, x, strict=True) if k is None)
            found.append(pieces if missing else b"".join(x if isinstance(x, bytes) else b"".join(x) for x in ids))
        words = list(new)
        fresh = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        known.update(fresh)
        done = [x if isinstance(x, bytes) else b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in x) for x in found]
        if len(known) > REMEMBERED or any(len(w) > 1000 for w in words):
            self.words = {}
        return done

    def encode(self, raw: bytes) -> list[int]:
        """Ids of a whole UTF-8 text."""
        return np.frombuffer(self.encode_texts([raw])[0], dtype="<i4").tolist()

    def decode(self, ids) -> bytes:
        """The text of ``ids`` as UTF-8; bytes that form no code point become U+FFFD.  Unknown ids say nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.tokens))]
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        raw = self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def loaded(path: str) -> Bpe:
    store = worker_store()
    if ("bpe", path) not in store:
        store["bpe", path] = Bpe(path)
    return store["bpe", path]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None = None):
    """A column function: ids (array<int>) of whole texts; a null text has no ids.  Texts of any length are encoded whole."""
    path = path or default_file()

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        model, done, waiting, size = loaded(path), [], [], 0
        for raw in utf8(texts):
            waiting.append(raw)
            size += len(raw)
            if size > PIECE:
                done += model.encode_texts(waiting)
                waiting, size = [], 0
        done += model.encode_texts(waiting)
        ends = np.cumsum([0, *(len(ids) // 4 for ids in done)])
        if ends[-1] > 2**31 - 1:
            raise ValueError("a batch holds too many ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(done), dtype="<i4"), pa.int32()))

    return encode


def decoder(path: str | None = None):
    """A column function: texts of ids; null or no ids give the empty text."""
    path = path or default_file()

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        model = loaded(path)
        ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(ids).to_pylist())]).tolist()
        flat = ids.flatten().fill_null(-1).to_numpy()
        return pa.array([model.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary()).cast(pa.string())

    return decode


def encode(documents, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """``id_col``, ids and decoded (the text of the ids) of every document.

    A null text counts as empty and has no ids.  Rows stay as they are: ids may repeat or be null, and equal
    rows give equal results.  Other columns are left out, whatever their names; an empty table gives an
    empty result.
    """
    coded = documents.select(F.col(id_col), encoder(path)(F.col(text_col).cast("string")).alias("ids"))
    return coded.withColumn("decoded", decoder(path)(F.col("ids")))
