"""Quality scores by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (one of label 1 over one of label 0).
A document's strength is linear in its features, the chance that one document
is preferred to another is the logistic function of the difference of their
strengths, and the weights minimise that logistic loss over the pairs (with a
ridge, by Newton's method). A quantile of the labelled documents' strengths is
the threshold; a strength at the threshold has the score `cut`, and scores
follow the logistic function around it.

Features come from the text alone, from all of it: shares of kinds of bytes,
lengths of words and lines, and how often words, pairs of words and lines
repeat. Only the model is fitted on a sample: at most `fit_rows` labelled
documents, those with the smallest hashes of their ids.

Defined cases: a null text is empty and has a score like any other; a null
label or a label of a missing document counts for nothing, the largest label of
a document counts; without both labels every score is `cut` or above; a null id
is scored and isn't held out; repeated rows are scored apiece; an empty table
gives no rows. Extra columns are kept; those named like a new column are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from origo.llm import textkit
from origo.llm.common import ship

FOLDS = 5
_BLOCK = 2048  # rows of a fit that are held at once
_KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"()-?", b"!", b"#$%&*@^~=+_", b"<>[]{}|\\/`", b"\n", bytes(range(128, 256)))
_KIND = np.full(256, len(_KINDS), dtype=np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k
NAMES = (
    "log_words", "upper", "lower", "digit", "stop", "shout", "symbol", "bracket", "newline", "high_bytes", "word_bytes", "longest_word",
    "distinct_words", "distinct_pairs", "twice_running", "commonest_word", "log_lines", "repeated_lines", "symbol_words", "caps_words",
)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return run[bounds[1:]] - run[bounds[:-1]]


def _repeats(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's keys: how many differ, and how often the commonest occurs."""
    n = len(bounds) - 1
    distinct, most = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if len(keys):
        of = np.repeat(np.arange(n), np.diff(bounds))
        order = np.lexsort((keys, of))
        k, o = keys[order], of[order]
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
        distinct = np.bincount(o[new], minlength=n)
        np.maximum.at(most, o[new], np.diff(np.concatenate((new, [len(k)]))))
    return distinct, most


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    out = np.zeros((len(column), len(NAMES)))
    for a, b, words in textkit.words_of(column):
        data, bounds, first = words.data, words.bounds, words.first
        size, n = np.maximum(np.diff(bounds), 1), words.counts
        kind = _KIND[data]
        shares = [_per_text(kind == k, bounds) / size for k in range(len(_KINDS))]
        length, h = words.end - words.start, words.hashes()
        some = np.maximum(n, 1)
        run = np.concatenate(([0], np.cumsum(kind == 0)))
        caps = (run[words.end] - run[words.start]) * 2 > length
        run = np.concatenate(([0], np.cumsum((kind >= 4) & (kind <= 6))))
        odd = run[words.end] - run[words.start] > 1
        longest = np.zeros(b - a)
        np.maximum.at(longest, np.repeat(np.arange(b - a), n), length)
        distinct, most = _repeats(h, first)
        pairs, pair_first = words.windows(2, h)
        n_pairs = np.maximum(np.diff(pair_first), 1)
        twice = np.concatenate((h[1:] == h[:-1], [False]))[: len(h)]
        if len(h):
            twice[first[1:][n > 0] - 1] = False
        # Lines: polynomial hashes of their words, from the same prefix sums.
        newline = np.flatnonzero(data == 10)
        line_of_word = np.searchsorted(newline, words.start)
        text_of_word = np.repeat(np.arange(b - a), n)
        begins = np.flatnonzero(np.concatenate(([True], (line_of_word[1:] != line_of_word[:-1]) | (text_of_word[1:] != text_of_word[:-1])))) if len(h) else np.empty(0, dtype=np.int64)
        ends = np.concatenate((begins[1:], [len(h)])) if len(begins) else begins
        up, down = textkit._WORDS.get(len(h) + 1)
        line = textkit._ranges(up[:-1], down, h, begins, ends) if len(begins) else np.empty(0, dtype=np.uint64)
        line_bounds = np.searchsorted(begins, first)
        lines = np.diff(line_bounds)
        out[a:b] = np.column_stack([
            np.log1p(n), *shares, _per_text(length, first) / some, np.log1p(longest), distinct / some,
            np.where(np.diff(pair_first) > 0, _repeats(pairs, pair_first)[0] / n_pairs, 1.0), _per_text(twice, first) / some, most / some,
            np.log1p(lines), 1 - _repeats(line, line_bounds)[0] / np.maximum(lines, 1), _per_text(odd, first) / some, _per_text(caps, first) / some,
        ])
    return out


@dataclass(frozen=True)
class Model:
    """Weights over standardised features and their hinges, and the map from
    strengths to scores."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return _expanded(x, self.centre, self.scale, self.knots) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strengths(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _expanded(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, knots: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate([z, *(np.maximum(z - k, 0) for k in knots)], axis=1)


def _newton(rows: Callable[[int, int], np.ndarray], n: int, ridge: float, y: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Weights of least logistic loss: that y (or 1) for each of n rows; `rows` makes
    those from one number to another, so that few of them are held at once."""
    y = np.ones(n) if y is None else y
    width = rows(0, 0).shape[1]
    w = np.zeros(width)
    for _ in range(steps):
        gradient, hessian = np.zeros(width), np.zeros((width, width))
        for a in range(0, n, _BLOCK):
            d = rows(a, a + _BLOCK)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            gradient += d.T @ (p - y[a : a + _BLOCK])
            hessian += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hessian / n + ridge * np.eye(width), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_model(x: np.ndarray, y: np.ndarray, *, pairs: int = 60_000, ridge: float = 1e-3, cut: float = 0.3, keep: float = 4.0, seed: int = 5) -> Model:
    """The model of labelled rows; the same rows give the same model. `keep`:
    how much worse it is to reject a share of label 1 than to accept as large a
    share of label 0."""
    dice = np.random.default_rng(seed)
    width = x.shape[1]
    centre = np.median(x, axis=0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(axis=0) if len(x) else np.ones(width), 1e-6)
    knots = np.quantile(np.clip((x - centre) / scale, -8, 8), (0.05, 0.25, 0.75, 0.95), axis=0) if len(x) else np.zeros((4, width))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(centre, scale, knots, np.zeros(width * (1 + len(knots))), 0.0, 1.0, cut)
    z = _expanded(x, centre, scale, knots)
    better, worse = dice.choice(good, pairs), dice.choice(bad, pairs)
    w = _newton(lambda a, b: z[better[a:b]] - z[worse[a:b]], pairs, ridge)
    s = z @ w
    # The quantile of all strengths that parts the labels best.
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(y[order] == 0) / len(bad), np.cumsum(y[order] == 1) / len(good)
    at = int(np.argmax(below_bad - keep * below_good))
    quantile = (at + 0.5) / len(s)
    threshold = float(np.quantile(s, quantile))
    slope = float(_newton(lambda a, b: np.column_stack([s[a:b] - threshold, np.ones(len(s[a:b]))]), len(s), 1e-3, (y == 1).astype(float))[0])
    return Model(centre, scale, knots, w, threshold, max(slope, 1e-3), cut)


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 20_000, **options) -> Model:
    """Learn from labelled documents that aren't held out."""
    ship(docs.sparkSession)
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    taken = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_id", "_text", "_y")  # `fit_rows` rows of two numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([features(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), textkit.binaries(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["id", "x"])

    rows = sorted((r["id"], bytes(r["x"])) for r in taken.mapInArrow(work, "id string, x binary").orderBy("id", "x").limit(fit_rows).collect())
    x = np.array([np.frombuffer(r, dtype=np.float64) for _, r in rows]).reshape(len(rows), len(NAMES) + 1)
    return fit_model(x[:, :-1], x[:, -1].astype(int), **options)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score between 0 and 1; higher: label 1 is likelier."""
    ship(docs.sparkSession)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(features(batch.column(at))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted`."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, cut=cut, **options)
    scored = score(docs.drop("held_out", "predicted"), model, text_col=text_col)
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= cut).cast("int"))
