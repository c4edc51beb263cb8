"""Languages of texts: averaged embeddings of hashed subwords, a linear softmax on
top, stochastic gradient descent in numpy, and calibrated rejection.

A text's subwords are all stretches of two to four bytes of its words, with the
separator before and after a word (words: ASCII letters and bytes above 0x7F, A to Z
lower-cased). Each is hashed to a bucket with an embedding; the mean of a text's
embeddings goes through a linear layer and a softmax over the languages.

Fitting: at most `fit_rows` labelled rows that aren't held out, as evenly over the
languages as they allow, those with the smallest hashes of their ids; a fifth of
them only calibrates. There the logits get a factor a * n**b, n being the number of
subwords (short texts tell less), that makes the scores likeliest; and the least
score is found from which on at least `precision` of the texts are right. Texts
below it are predicted, but not `accepted`.

Prediction: the linear layer is multiplied into the embeddings, so a text's logits
are sums of a whole number for each bucket and language. They don't depend on how
texts are cut into slices, and every byte of every text counts.

Defined cases: a null text, or one without a letter, is `und` with score 0 and not
accepted; so is every text if no labelled row is left; with one language every other
text has it with score 1; null languages are not learned from; rows with null ids
are not held out and not learned from; repeated rows are scored apiece; ties of
logits go to the language that sorts first; texts of any length are taken whole; an
empty table gives no rows. Extra columns are kept; those named like a new column are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from origo.llm import textkit
from origo.llm.common import ship

FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
BITS, ORDERS, WIDTH = 15, (2, 3, 4), 16
_FIXED = 1 << 16  # logits of buckets are whole multiples of 1 / _FIXED
_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_LETTER = _ASCII.copy()
_LETTER[0x80:] = True
_LOWER = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
_NEW = (("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("accepted", T.BooleanType()))


def subwords(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all subwords, and each text's first."""
    texts = np.arange(len(bounds))
    edges = bounds + texts  # a separator before each text, and behind the last
    room = np.ones(len(data) + len(bounds), dtype=bool)
    room[edges] = False
    bytes_ = np.full(len(room), 0x20, dtype=np.uint8)
    bytes_[room] = _LOWER[data]
    letter, code = bytes_ != 0x20, bytes_.astype(np.uint32)
    grown = code
    for n in range(2, max(ORDERS) + 1):
        grown = grown[:-1] | code[n - 1 :] << np.uint32(8 * (n - 1))
        if n in ORDERS:
            inner = letter[:-1] | letter[1:] if n == 2 else np.logical_and.reduce([letter[k : len(letter) - n + 1 + k] for k in range(1, n - 1)])
            at = np.flatnonzero(inner)
            yield (grown[at] * np.uint32(_ODD[n])) >> np.uint32(32 - BITS), np.searchsorted(at, edges)


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    run = np.concatenate(([0], np.cumsum(_ASCII[data])))
    found = run[bounds[1:]] > run[bounds[:-1]]
    for i in np.flatnonzero(~found & (np.diff(bounds) > 0)):
        found[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Logits of each language and bucket, and what calibration found."""

    languages: tuple[str, ...]
    table: np.ndarray
    factor: float
    power: float
    least: float

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text whether it has a language, its number, and its score."""
        known, best, score = np.zeros(len(column), dtype=bool), np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        if not len(column) or not self.languages:
            return known, best, score
        data, all_bounds = textkit.utf8(column)
        for a, b in textkit.slices(all_bounds):
            part, bounds = data[all_bounds[a] : all_bounds[b]], all_bounds[a : b + 1] - all_bounds[a]
            known[a:b] = has_letter(part, bounds)
            sums, n = np.zeros((b - a, len(self.languages)), dtype=np.int64), np.zeros(b - a, dtype=np.int64)
            for bucket, first in subwords(part, bounds):
                some = np.flatnonzero(np.diff(first))
                n += np.diff(first)
                if len(some):
                    for k, row in enumerate(self.table):
                        sums[some, k] += np.add.reduceat(row[bucket], first[some], dtype=np.int64)
            p = _softmax(self.logits(sums, n))
            best[a:b], score[a:b] = p.argmax(axis=1), p.max(axis=1)
        score[~known] = 0
        return known, best, score

    def logits(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.maximum(n, 1)[:, None]
        return self.factor * n**self.power * (sums / n / _FIXED)


def fit_model(rows: list[tuple[str, np.ndarray, np.ndarray]], *, epochs: int = 6, rate: float = 0.5, precision: float = 0.99, seed: int = 13) -> Model:
    """The model of rows (language, buckets, counts); the same rows in the same
    order give the same model."""
    languages = tuple(sorted({r[0] for r in rows}))
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), 1 << BITS), dtype=np.int32), 1.0, 0.0, 0.0)
    y = np.array([languages.index(r[0]) for r in rows])
    dice = np.random.default_rng(seed)
    turn = dice.permutation(len(rows))
    aside, used = np.sort(turn[: len(rows) // 5]), turn[len(rows) // 5 :]
    embedding = dice.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(languages)), dtype=np.float32)
    steps, step = epochs * len(used), 0
    for _ in range(epochs):
        for i in dice.permutation(used):
            _, bucket, count = rows[i]
            share = (count / count.sum()).astype(np.float32)
            own = embedding[bucket]
            mean = share @ own
            wrong = _softmax(mean @ layer)
            wrong[y[i]] -= 1
            pace = np.float32(rate * (1 - step / steps))
            back = layer @ wrong
            layer -= pace * np.outer(mean, wrong)
            # A bucket's share of the mean is small; its step is not made as small.
            embedding[bucket] = own - pace * np.outer(np.sqrt(share), back)
            step += 1
    table = np.rint((embedding @ layer).T.astype(np.float64) * _FIXED).astype(np.int32)
    plain = Model(languages, table, 1.0, 0.0, 0.0)
    sums = np.array([table[:, rows[i][1]].astype(np.int64) @ rows[i][2].astype(np.int64) for i in aside]).reshape(len(aside), len(languages))
    return calibrated(plain, sums, np.array([rows[i][2].sum() for i in aside], dtype=np.int64), y[aside], precision)


def calibrated(model: Model, sums: np.ndarray, n: np.ndarray, y: np.ndarray, precision: float) -> Model:
    """`model` with the factor and power of least loss, and the least accepted score."""
    if not len(y):
        return model
    found = []
    for power in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5):
        for factor in np.geomspace(0.1, 100, 61):
            tried = Model(model.languages, model.table, float(factor), power, 0.0)
            # As if one more row had been wrong, so that no score becomes certain.
            p = _softmax(tried.logits(sums, n)) * (1 - 1 / (len(y) + 2)) + 1 / (len(y) + 2) / len(model.languages)
            found.append((-float(np.log(p[np.arange(len(y)), y]).mean()), power, float(factor)))
    _, power, factor = min(found)
    told = Model(model.languages, model.table, factor, power, 0.0)
    p = _softmax(told.logits(sums, n))
    right, score = p.argmax(axis=1) == y, p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    ends = np.append(score[order][1:] != score[order][:-1], True)  # equal scores go together
    good = np.flatnonzero(ends & (np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision))
    # Where all rows are right their least score says nothing; a calibrated score does.
    least = min(float(score[order[good[-1]]]), precision) if len(good) else float("inf")
    return Model(model.languages, model.table, factor, power, least)


def held_out(doc_id: Column) -> Column:
    """Whether a document must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 2_000, **options) -> Model:
    """Learn from at most `fit_rows` labelled documents that aren't held out; they
    reach the driver as at most 2**15 buckets with a count each."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), held_out(F.col(id_col)).alias("_out"))
    rows = rows.filter("_id is not null and _lang is not null and not _out")
    # Of each language the rows whose hash falls under a share that leaves some
    # 2 * fit_rows of them, so that no language is sorted whole; of these the first.
    # A sample of fit_rows rows holds at most so many languages: the commonest ones.
    n = rows.groupBy(F.col("_lang").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_of").limit(fit_rows)
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) / (1 << 40)
    near = rows.select("_id", "_lang", place.alias("_place")).join(F.broadcast(n), F.col("_lang") == F.col("_of")).filter(F.col("_place") * F.col("_n") < 2 * fit_rows)
    turn = F.row_number().over(W.partitionBy("_lang").orderBy("_place", "_id"))
    known = near.withColumn("_turn", turn).filter(F.col("_turn") <= fit_rows).orderBy("_turn", "_place", "_id", "_lang").limit(fit_rows)
    known = known.select(F.col("_id").alias("_k"), F.col("_lang").alias("_l")).distinct()
    taken = rows.join(F.broadcast(known), (F.col("_id") == F.col("_k")) & (F.col("_lang") == F.col("_l"))).select("_id", "_lang", "_text")  # `fit_rows` rows of two short strings

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textkit.utf8(batch.column(2))
            buckets, counts = [], []
            for a, b in zip(bounds, bounds[1:]):
                some = [x for x, _ in subwords(data[a:b], np.array([0, b - a]))] if has_letter(data[a:b], np.array([0, b - a]))[0] else []
                which, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.empty(0), np.empty(0))
                buckets.append(which.astype(np.uint16).tobytes())
                counts.append(n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["id", "lang", "buckets", "counts"])

    found = taken.mapInArrow(work, "id string, lang string, buckets binary, counts binary").filter("length(buckets) > 0").orderBy("id", "lang", "buckets", "counts").limit(fit_rows).collect()
    return fit_model([(r["lang"], np.frombuffer(r["buckets"], dtype=np.uint16), np.frombuffer(r["counts"], dtype=np.uint32)) for r in found], **options)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `held_out`, `lang_pred`, `score` and `accepted`."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "accepted").withColumn("held_out", held_out(F.col(id_col)))
    at = docs.columns.index(text_col)
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, best, score = model.predict(batch.column(at))
            lang = names.take(pa.array(np.where(known, best, len(names) - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score), pa.array(known & (score >= model.least))], names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in _NEW[1:])]))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from `docs`' own labels and predict the language of all its texts."""
    return predict(docs, fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), id_col=id_col, text_col=text_col)
