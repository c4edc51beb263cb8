"""Held-out accuracy, calibration, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from origo.llm import language

SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "ka ke ki ko ku".split(), "cc": "bé ké né zé té".split(), "dd": "日本 本日 月火 火月 水木".split()}


def say(dice, lang, n):
    return " ".join("".join(dice.choice(SYLLABLES[lang]) for _ in range(dice.randint(1, 4))) for _ in range(n))


def made(n=600, seed=2):
    dice = random.Random(seed)
    return [(i, say(dice, lang := dice.choice("aa bb aa aa cc dd".split()), dice.choice([1, 3, 30, 200])), lang) for i in range(n)]


def test_identify(spark):
    rows = made()
    odd = [(9000, None, "aa"), (9001, "", "aa"), (9002, "12 + 3 = 15 \n", "bb"), (9003, "—…", "cc"), (9004, "a", None), (9005, "日" * 50_000, "dd"), (None, "ba be bi", "aa"), (0, *rows[0][1:]), (None, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({c: F.lit("z") for c in ("score", "_id", "_turn", "held_out")}).repartition(4)
    model = language.fit(docs)
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows) + len(odd) and all(r["_id"] == "z" for r in found)
    out = [r for r in found if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in out) and not any(r["held_out"] for r in found if r not in out)
    usual = [r for r in out if r["doc_id"] < 9000]
    assert len(usual) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in usual]) > 0.98
    assert np.mean([r["lang"] == r["lang_pred"] for r in usual if r["accepted"]]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in found)
    told = {r["doc_id"]: r for r in found}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 and not told[i]["accepted"] for i in (9000, 9001, 9002, 9003))
    assert told[9004]["lang_pred"] in SYLLABLES and told[9005]["lang_pred"] == "dd"


def test_labels_of_held_out_rows_count_for_nothing(spark):
    rows = made(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(other.repartition(7))
    assert a.languages == b.languages and (a.table == b.table).all() and (a.factor, a.power, a.least) == (b.factor, b.power, b.least)


def test_rare_languages_are_learned(spark):
    """A sample that is smaller than the commonest language holds all of them."""
    dice = random.Random(1)
    rows = [(i, say(dice, "aa" if i >= 40 else "bbccdd"[i % 3 * 2 :][:2], 20), "aa" if i >= 40 else "bbccdd"[i % 3 * 2 :][:2]) for i in range(2000)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=60)
    assert model.languages == ("aa", "bb", "cc", "dd")


def test_slices_change_nothing(monkeypatch):
    rows = [(lang, *map(np.concatenate, zip(*[np.unique(b, return_counts=True) for b, _ in language.subwords(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))]))) for _, t, lang in made(100)]
    model = language.fit_model(rows)
    texts = pa.array([t for _, t, _ in made(60, 5)] + [None, "x"])
    whole = model.predict(texts)
    monkeypatch.setattr(language.textkit, "slices", lambda bounds: ((k, k + 1) for k in range(len(bounds) - 1)))
    assert all((a == b).all() for a, b in zip(whole, model.predict(texts)))


def test_few_labels(spark):
    schema = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    none = language.identify(spark.createDataFrame([(1, "some text", None)], schema)).first()
    assert (none["lang_pred"], none["score"], none["accepted"]) == ("und", 0.0, False)
    one = language.identify(spark.createDataFrame([(1, "some text", "en"), (3, "5", "en")], schema)).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in one] == [("en", 1.0), ("und", 0.0)]


@pytest.mark.parametrize("right", [1.0, 0.9])
def test_calibration(right):
    """Scores are about as often right as they say."""
    dice = np.random.default_rng(3)
    y = np.where(dice.random(4000) < right, 0, 1)
    model = language.Model(("a", "b"), np.zeros((2, 1), dtype=np.int32), 1.0, 0.0, 0.0)
    sums = np.tile(np.array([[language._FIXED * 10, 0]]), (4000, 1))
    found = language.calibrated(model, sums, np.full(4000, 10), y, 0.99)
    score = language._softmax(found.logits(sums[:1], np.array([10]))).max()
    assert abs(score - right) < 0.02 and (found.least <= 0.99 if right == 1 else found.least == float("inf"))
