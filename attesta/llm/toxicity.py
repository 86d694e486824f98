"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases.

Texts are folded first: compatibility forms, homoglyphs of other scripts, digits and signs that
stand for letters, accents and case.  What is left of a text are runs of letters between single
spaces.  A term matches a whole run, or as a stem the beginning of a longer one; each run counts with
the largest weight it matches.  The sum of the weights, without those inside an exception phrase, is
divided by the logarithm of the text's length, and a logistic curve makes it 0 to 1.

Terms and weights are learned: a term's weight is its log odds between texts of label 1 and 0,
counted in distinct neighbourhoods, so copies of one text count once.  A neighbour with which a term
occurs mostly in texts of label 0 makes an exception phrase.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8
from .quality import scorer

SAMPLE, TERMS, EXCEPTIONS, STEMS = 20_000, 2_000, 2_000, (4, 8)
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝӏмтвнкαεορνικτυχηɡıℓ", "aeopcyxijsdhqwlmtbhkaeopviktuxngil", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = dict(zip("@$!|", "asii", strict=True))
_LETTERS = {ord(a): b for a, b in {**HOMOGLYPHS, **DIGITS}.items()}
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_REST = re.compile(r"[\W\d_]+")
_MARKS = re.compile(r"[̀-ͯ]")


def fold(text: str) -> str:
    """Runs of folded letters, each with one space before and after."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    text = _INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return " " + _REST.sub(" ", text.translate(_LETTERS)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights, exception phrases, and the curve from normalised sums to 0 to 1.

    A term that ends with ``*`` is a stem.
    """

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    middle: float = 0.5
    slope: float = 8.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 1, None))
        for term, weight in self.weights:
            pattern = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            found.add_word(pattern, (len(pattern) - 1, -weight if term.endswith("*") else weight))
        if len(found):
            found.make_automaton()
        return found

    def raw(self, text: bytes, automaton: ahocorasick.Automaton) -> float:
        folded = fold(text.decode("utf-8", "replace"))
        if not len(automaton):
            return 0.0
        runs: dict[int, float] = {}
        excepted = []
        for last, (back, weight) in automaton.iter(folded):
            if weight is None:
                excepted.append((last - back, last))
            elif weight > 0 or folded[last + 1] != " ":  # a stem, marked by the sign, needs more of its run
                runs[last - back] = max(abs(weight), runs.get(last - back, 0.0))
        if excepted:
            reach, at, covered = 0, 0, sorted(excepted)
            for start in sorted(runs):
                while at < len(covered) and covered[at][0] <= start:
                    reach = max(reach, covered[at][1])
                    at += 1
                if folded.find(" ", start + 1) <= reach:
                    del runs[start]
        return sum(runs.values()) / math.log2(4 + folded.count(" "))

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.middle), -30, 30)))


def _marked(labels: DataFrame, label: str, sample: int, id_col: str) -> DataFrame:
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    return marked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from at most ``sample`` labelled rows, the first by a hash of the id.

    ``terms`` bounds the lexicon, strongest terms first.  Labels that are null or neither 0 nor 1
    and null ids are passed over.  Without rows of both labels the lexicon is empty.
    """
    rows = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(_marked(labels, label, sample, id_col)), "_id").select("_y", "_text")

    def neighbourhoods(batches):
        for batch in batches:
            y, before, term, after = [], [], [], []
            for mark, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = fold(text.decode("utf-8", "replace")).split()
                found = list(set(zip(["", *words], words, [*words[1:], ""])))  # noqa: B905
                y += [mark] * len(found)
                before += [x[0] for x in found]
                term += [x[1] for x in found]
                after += [x[2] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(before, pa.string()), pa.array(term, pa.string()), pa.array(after, pa.string())], ["y", "before", "term", "after"])

    seen = cut(rows.mapInArrow(neighbourhoods, "y int, before string, term string, after string").where("length(term) > 2").distinct())
    count = lambda y: F.sum((F.col("y") == y).cast("long"))
    totals = {r[0]: r[1] for r in seen.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon(())
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    spread = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    stems = F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda k: F.when(F.length("term") > k, F.concat(F.substring("term", F.lit(1), k), F.lit("*"))))
    forms = seen.groupBy("y", "term").count().select("y", "count", F.explode(F.array_compact(F.concat(F.array("term"), stems))).alias("term"))
    sums = lambda y: F.sum(F.when(F.col("y") == y, F.col("count")).otherwise(0))
    # A stem that one word accounts for says no more than the word, and would match others by accident.
    top = F.max(F.when(F.col("y") == 1, F.col("count")).otherwise(0)).alias("top")
    told = forms.groupBy("term").agg(sums(1).alias("p"), sums(0).alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("words"), top).where("p >= 5")
    ranked = told.where(~F.endswith("term", F.lit("*")) | ((F.col("words") >= 3) & (F.col("top") <= 0.8 * F.col("p")))).select("term", "p", "n", odds.alias("w"), (odds / spread).alias("z"))
    chosen = ranked.where(f"z >= 4 and w >= {math.log(8)}").orderBy(F.desc("z"), "term").limit(terms).collect()
    weights = tuple((r["term"], min(float(r["w"]), 8.0)) for r in chosen)
    if not weights:
        return Lexicon(())
    near = seen.where(F.col("term").isin([t for t, _ in weights if not t.endswith("*")]))
    phrases = near.where("before != ''").select("y", F.concat_ws(" ", "before", "term").alias("phrase")).unionByName(near.where("after != ''").select("y", F.concat_ws(" ", "term", "after").alias("phrase")))
    kept = phrases.groupBy("phrase").agg(count(1).alias("p"), count(0).alias("n")).where("n >= 3 and n >= 4 * p").orderBy(F.desc("n"), "phrase").limit(EXCEPTIONS).collect()
    lexicon = Lexicon(weights, tuple(r["phrase"] for r in kept))
    return calibrated(lexicon, rows, sample)


def calibrated(lexicon: Lexicon, rows: DataFrame, sample: int) -> Lexicon:
    """``lexicon`` with the curve whose middle parts the labels of ``rows`` (_y, _text) most evenly."""

    def raws(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.raw(t, automaton) for t in utf8(batch.column(1))], pa.float64())], ["y", "s"])

    got = rows.mapInArrow(raws, "y int, s double").orderBy(F.xxhash64("s", "y"), "y", "s").limit(sample).collect()
    y, s = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    values = np.unique(s)
    if len(values) < 2:
        return lexicon
    middles = (values[:-1] + values[1:]) / 2
    middles = middles if len(middles) < 2000 else np.quantile(middles, np.linspace(0, 1, 2000))
    right = np.array([((s >= m) == (y == 1)).sum() for m in middles])
    middle = float(middles[np.argmax(right)])
    return Lexicon(lexicon.weights, lexicon.exceptions, middle, 4.0 / max(middle, 1e-3))


class _Scorer:
    """A lexicon whose automaton is built once in each Python worker."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "automaton": None}

    def vector(self, text: bytes) -> float:
        self.automaton = self.automaton or self.lexicon.automaton()
        return self.lexicon.raw(text, self.automaton)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return self.lexicon.score(raw)


def score(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, score (0 to 1) and the columns ``keep`` of every document; null texts count as empty.

    The score is a function of the whole text alone, so rows that repeat are scored alike and a null id
    stays null.  A column ``score`` of the documents is left out unless renamed.  An empty table gives an
    empty result.
    """
    model = _Scorer(lexicon)
    return documents.select(id_col, scorer(model, model.vector)(F.col(text_col).cast("string")).alias("score"), *keep)
