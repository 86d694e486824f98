"""Quality classifier: Bradley-Terry pairwise ranking over features of the text.

A document's score is linear in features of its whole text.  Weights maximise the likelihood that
the better document of a preference pair wins, which is logistic loss on feature differences.  The
decision threshold is a quantile of the scores of the labelled documents, the one at which accuracy
on both labels is most even; a logistic curve around it turns scores into 0 to 1.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of their id; scoring
covers every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

SAMPLE = 20_000
_KINDS = np.zeros(256, dtype=np.int64)
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"#$%&*@^~|<>{}[]\\/+=_`", bytes(range(128, 256))), start=1):
    _KINDS[list(_chars)] = _name
_N_KINDS = 10
FEATURES = ("log_bytes", *(f"kind_{i}" for i in range(_N_KINDS)), "log_words", "mean_word", "distinct_words", "top_word", "distinct_pairs", "short_words", "distinct_lines", "top_byte", "marked_words", "shouted_words")
# Classes of bytes of a word: blank, small, those that may begin a shouted word, those that mark a word at its end.
_BLANK, _SMALL, _LOUD, _MARK = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\v\f", bytes(range(97, 123)), bytes([*range(65, 91), *range(128, 256)]), bytes(set(range(128)) - set(b" \t\n\r\v\f.,;:'\")]_" + bytes([*range(48, 58), *range(65, 91), *range(97, 123)])))))


def _marked_and_shouted(data: np.ndarray) -> tuple[int, int]:
    """Words that end with two marks or more; words of three large or foreign letters and more without a small letter."""
    blank = np.concatenate(([True], _BLANK[data], [True]))
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    size, mark, loud = ends - starts, _MARK[data], _LOUD[data]
    long, three = ends[size >= 2], size >= 3
    marked = int((mark[long - 1] & mark[long - 2]).sum())
    at, small = starts[three], np.concatenate(([0], np.cumsum(_SMALL[data])))
    shouted = int((loud[at] & loud[at + 1] & loud[at + 2] & (small[ends[three]] == small[at])).sum())
    return marked, shouted


def features(text: bytes) -> np.ndarray:
    """The features of a whole UTF-8 text; the empty text has its own fixed ones."""
    data = np.frombuffer(text, dtype=np.uint8)
    raw = np.bincount(data, minlength=256)
    size = max(len(text), 1)
    kinds = np.bincount(_KINDS, weights=raw, minlength=_N_KINDS) / size
    words = text.lower().split()
    n = max(len(words), 1)
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    distinct, counts = np.unique(codes, return_counts=True) if len(words) else (codes, np.zeros(1))
    pairs = len(np.unique(codes[:-1] * 31 + codes[1:])) if len(words) > 1 else 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked, shouted = _marked_and_shouted(data)
    return np.array(
        [
            np.log1p(len(text)), *kinds, np.log1p(len(words)), min(len(text) / n, 40.0), len(distinct) / n, counts.max() / n, pairs / max(n - 1, 1),
            sum(len(w) < 3 for w in words) / n, len(set(lines)) / max(len(lines), 1), raw.max() / size, marked / n, shouted / n,
        ]
    )


@dataclass(frozen=True)
class Ranker:
    """Weights, the score at the threshold, and the slope that makes scores into 0 to 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        # A sum for each row, whose rounding does not depend on the rows beside it as a product's may.
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, ridge: float = 1e-3, steps: int = 60, seed: int = 5) -> Ranker:
    """Bradley-Terry weights from rows ``x`` marked ``y`` 0 or 1, by Newton steps on the pair loss.

    Pairs are drawn among all better-worse pairs of the given rows.  With one label only, every
    document scores as that label's; with no rows, 0.5.
    """
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        side = 0.0 if not len(y) else (1.0 if len(good) else -1.0)
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -side, 4.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / n - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cuts = np.quantile(s, np.linspace(0, 1, 513))
    middle = (cuts[:-1] + cuts[1:]) / 2
    even = np.array([(s[good] >= c).mean() + (s[bad] < c).mean() for c in middle])
    best = middle[np.flatnonzero(even >= even.max() - 1e-12)]
    spread = max(np.quantile(s, 0.9) - np.quantile(s, 0.1), 1e-6)
    return Ranker(mean, scale, w, float(np.median(best)), float(4 / spread))


def _features_of(documents: DataFrame, keep: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t).tolist() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [keep, "x"])

    return documents.mapInArrow(run, f"{keep} int, x array<double>")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """Fits on at most ``sample`` rows of ``labels`` (id, label 0 or 1), the first by a hash of the id.

    Labels that are null or neither 0 nor 1 and ids that are null are passed over.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    marked = marked.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # Where ids repeat and rows are too many, the same are taken whatever the order of tasks.
    rows = _features_of(texts.join(F.broadcast(marked), "_id").select("_y", "_text"), "_y").orderBy(F.xxhash64("x"), "_y").limit(sample).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    x = np.array([r[1] for r in rows]) if rows else np.zeros((0, len(FEATURES)))
    return fit(x, np.array([r[0] for r in rows]))


def score(documents: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, score (0 to 1) and the columns ``keep`` of every document; null texts count as empty.

    The score is a function of the whole text alone, so rows that repeat are scored alike and a null id
    stays null.  A column ``score`` of the documents is left out unless renamed.  An empty table gives an
    empty result.
    """
    return documents.select(id_col, scorer(ranker, features)(F.col(text_col).cast("string")).alias("score"), *keep)


def scorer(model, vector):
    """A column function that scores whole texts by ``model`` over ``vector`` of their bytes."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        return pa.array(model.score(np.array([vector(t) for t in utf8(texts)])))

    return of
