"""Wallet recovery phrases: runs of words of a 2048-word list, held against their own checksum.

A phrase has 12, 15, 18, 21 or 24 words.  The place of each word in the list is 11 bits; the last
bits, one for three words, are the first of the SHA-256 of the others.  A text's runs depend on that
text alone, so texts are neither exchanged nor gathered; the list goes to the tasks, which its fixed
length allows, and is refused at any other.

Words that are written wrong are found by a deletion neighbourhood: a word and a list word are at most
one slip apart (a letter too many, too few, another one, two neighbours swapped) only if leaving out
at most one letter of each gives a common rest, so the list is kept by its rests.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words in a phrase, longest first; the length of the list; words; what may stand between two words of a run.
LENGTHS = (24, 21, 18, 15, 12)
WORDS = 2048
WORD = re.compile(r"[a-z]{3,8}")
BETWEEN = re.compile(r"[\s,;.:)(\[\]|/*_-]{0,12}|[\s\d.,;:)(\[\]#-]{0,12}")

_WRITTEN = re.compile(r"[a-z]+")
_SCHEMA = "offset long, n_words int, state string, phrase string, redacted string, alternatives array<int>, written string, fits int"


def checksum_holds(places: list[int]) -> bool:
    """Whether the places of a phrase's words carry their own checksum."""
    if len(places) not in LENGTHS:
        return False
    bits, check = 0, len(places) // 3
    for place in places:
        bits = bits << 11 | place
    digest = hashlib.sha256((bits >> check).to_bytes(len(places) * 4 // 3, "big")).digest()
    return bits & ((1 << check) - 1) == digest[0] >> (8 - check)


def rests(word: str) -> set[str]:
    """A word and what is left of it without any one letter."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_slip(a: str, b: str) -> bool:
    """Whether two different words are one letter more, less or other, or one swap of neighbours, apart."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) < len(b):
        return a[at:] == b[at + 1 :]
    swapped = a[at : at + 2] == b[at : at + 2][::-1] and a[at + 2 :] == b[at + 2 :]
    return a != b and (a[at + 1 :] == b[at + 1 :] or swapped)


def wordlist_problems(words: list[str]) -> list[str]:
    """What keeps a list, in its order, from being one of the standard's kind; a wrong word invents no phrase but can hide one."""
    found = []
    if len(words) != WORDS:
        found.append(f"{len(words)} words, not {WORDS}")
    if len(set(words)) != len(words):
        found.append("repeated words")
    if words != sorted(words):
        found.append("not in alphabetical order")
    if not all(WORD.fullmatch(w) for w in words):
        found.append("words other than three to eight small letters")
    if len({w[:4] for w in words}) != len(words):
        found.append("words that share their first four letters")
    return found


class Phrases:
    """A list of words and the search of one text."""

    def __init__(self, words: list[str], typos: int = 0):
        if len(words) != WORDS or len(set(words)) != WORDS or not all(WORD.fullmatch(w) for w in words):
            raise ValueError(f"a list has {WORDS} different words of three to eight small letters")
        self.words, self.typos = words, typos
        self.place = {w: i for i, w in enumerate(words)}
        self.by_rest: dict[str, list[str]] = defaultdict(list)
        self.meant_by: dict[str, tuple[int, ...]] = {}
        for w in words if typos else ():
            for rest in rests(w):
                self.by_rest[rest].append(w)

    def meant(self, word: str) -> tuple[int, ...]:
        """Places of the list words one slip away from ``word``."""
        if word not in self.meant_by:
            if len(self.meant_by) > 100_000:
                self.meant_by.clear()
            near = {w for rest in rests(word) for w in self.by_rest.get(rest, ())}
            self.meant_by[word] = tuple(sorted(self.place[w] for w in near if one_slip(w, word)))
        return self.meant_by[word]

    @staticmethod
    def _runs(text: str, tokens, belongs):
        """Maximal runs of at least 12 tokens that belong and have no more than punctuation between them."""
        run, end = [], None
        for m in tokens:
            known = belongs(m[0])
            if run and not (known and BETWEEN.fullmatch(text, end, m.start())):
                if len(run) >= LENGTHS[-1]:
                    yield run
                run = []
            if known:
                run.append((m.start(), m[0]))
            end = m.end()
        if len(run) >= LENGTHS[-1]:
            yield run

    def find(self, text: str) -> list[tuple]:
        lowered = text.lower()
        if len(lowered) != len(text):  # letters whose small form is longer stay, so offsets hold
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = [row for run in self._runs(lowered, WORD.finditer(lowered), self.place.__contains__) for row in self._valid(run)]
        if self.typos:
            taken = [(r[0], r[-1]) for r in found if r[2] == "valid"]
            for run in self._runs(lowered, _WRITTEN.finditer(lowered), lambda w: w in self.place or (2 <= len(w) <= 9 and bool(self.meant(w)))):
                found += self._near(run, taken)
        return [row[:-1] for row in found]

    def _row(self, run, at, n, state, places, alternatives=(), fits=1):
        said = [w for _, w in run[at : at + n]]
        phrase = [self.words[p] for p in places] if places else said
        last, word = run[at + n - 1]
        return (run[at][0], n, state, " ".join(phrase), f"{phrase[0]} … {phrase[-1]} ({n} words)", list(alternatives), " ".join(said), fits, last + len(word))

    def _valid(self, run):
        places = [self.place[w] for _, w in run]
        at, some = 0, False
        while at + LENGTHS[-1] <= len(run):
            good = [n for n in LENGTHS if at + n <= len(run) and checksum_holds(places[at : at + n])]
            if good:
                some = True
                yield self._row(run, at, good[0], "valid", places[at : at + good[0]], good[1:])
            at += good[0] if good else 1
        if not some:
            yield self._row(run, 0, len(run), "unchecked", None, fits=0)

    def _near(self, run, taken):
        wrong = [i for i, (_, w) in enumerate(run) if w not in self.place]
        at = low = 0
        while at + LENGTHS[-1] <= len(run):
            while low < len(wrong) and wrong[low] < at:
                low += 1
            row = next((r for n in LENGTHS if at + n <= len(run) if (r := self._mended(run, at, n, wrong, low))), None)
            if row and not any(row[0] < end and start < row[-1] for start, end in taken):
                yield row
                at += row[1]
            else:
                at += 1

    def _mended(self, run, at, n, wrong, low):
        slips = list(itertools.takewhile(lambda i: i < at + n, wrong[low : low + self.typos + 1]))
        if not 1 <= len(slips) <= self.typos:
            return None
        places, first, fits = [self.place.get(w, 0) for _, w in run[at : at + n]], None, 0
        for meant in itertools.product(*(self.meant(run[i][1]) for i in slips)):
            for i, p in zip(slips, meant, strict=True):
                places[i - at] = p
            if checksum_holds(places):
                fits += 1
                first = first or list(places)
        return self._row(run, at, n, "near", first, fits=fits) if first else None


def find_phrases(texts: DataFrame, wordlist: DataFrame, id_col: str = "id", text_col: str = "body", typos: int = 0) -> DataFrame:
    """The phrases of whole texts: ``id_col``, offset (code points), n_words, state, phrase, redacted, alternatives, written, fits.

    ``wordlist`` has columns place (its order) and word.  At each place of a run the longest phrase
    with a good checksum counts and the search goes on behind it (``valid``, with the other lengths
    that hold there); a run without any is one row (``unchecked``).  With ``typos``, windows of which
    one to so many words are one slip from a list word and that a replacement makes good are
    ``near``: the first good replacement in list order as ``phrase``, the words as ``written``, and the
    number of good ones as ``fits``; by chance one of 16 replacements of 12 words is good.  They do
    not overlap each other or a valid phrase.  Case is ignored.  Null and empty texts have no rows, a null
    id stays null, repeated rows are searched each, other columns are ignored; a list of another
    length, with repeats or other words raises ValueError.
    """
    listed = [r["word"] for r in wordlist.select("place", "word").orderBy("place").limit(WORDS + 1).collect()]
    if any(w is None for w in listed):
        raise ValueError("a list has no null words")
    phrases = Phrases(listed, typos)
    kind = dict(texts.select(id_col).dtypes)[id_col]
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32())

    def run(batches):
        for batch in batches:
            took, rows = [], []
            for i, text in enumerate(batch.column(1)):
                found = phrases.find(text.as_py() or "")
                took += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    return texts.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")
