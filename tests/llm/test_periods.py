"""Runs against every period of every place, planted repeats, odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from origo.llm import periods, textkit


def brute(words, least=6, copies=4):
    found = {}
    for q in range(1, len(words) // copies + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        begin = None
        for i, s in enumerate(same):
            begin = i if s and begin is None else begin
            if not s and begin is not None:
                if i + q - begin >= max(least, copies * q):
                    found.setdefault((begin, i + q), q)
                begin = None
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("least, copies", [(6, 4), (2, 2), (5, 3)])
def test_runs(least, copies):
    dice = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(dice.randint(1, 6)):
            words = [dice.choice("abcdeéfghijklmnop"[: dice.choice([1, 2, 3, 17])]) for _ in range(dice.randint(0, 60))]
            unit, n = words[: dice.randint(1, 6)], len(words) // 3
            texts.append(" ".join(words[:n] + unit * dice.randint(0, 9) + words[n:]))
        for _, _, words in textkit.words_of(pa.array(texts)):
            start, end, period = periods.runs_of(words, np.arange(words.first[-1]), least, copies)
            text = np.searchsorted(words.first, start, side="right") - 1
            got = [sorted(zip((start - words.first[text])[text == k].tolist(), (end - start)[text == k].tolist(), period[text == k].tolist())) for k in range(len(texts))]
            assert got == [brute(t.split(), least, copies) for t in texts]


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"aabbaa", dtype=np.uint8)
    start = np.array([0, 2, 4])
    first, group = textkit.grouped(data, start, start + 2, np.zeros(3, dtype=np.uint64))
    assert first.tolist() == [0, 1] and group.tolist() == [0, 1, 0]


def rearranged(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_find(spark):
    dice = random.Random(4)
    say = lambda n: [dice.choice(["one", "two", "three", "é", "four"]) + dice.choice(["", "", "x", "yy"]) for _ in range(n)]
    texts = {i: "  ".join(say(dice.randint(0, 200))) for i in range(60)} | {100: "w " * 5000, 101: "\t\n ", 102: "", 103: "a b\x0bc " * 2000 + "x" * 100_000, 104: "no run here"}
    rows = [(i, t, "z") for i, t in texts.items()] + [(None, "a a a a a a a", "z"), (None, None, "z"), (105, None, "z"), (3, texts[3], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("order", F.lit("z")).repartition(3)
    for plant in (False, True):
        found = periods.find(docs, plant=plant).collect()
        assert len(found) == len(rows) and all(r["order"] == "z" for r in found)
        for r in found:
            words = (r["text"] or "").split()
            words = rearranged(r["doc_id"], words) if plant and r["doc_id"] is not None else words
            runs = brute(words) if len(words) < 3000 else [(0, len(words), len(set(words)))] if r["doc_id"] == 100 else None
            if runs is None:
                assert [tuple(x) for x in r["runs"]][:1] == [(0, 6000, 3)] or plant
                continue
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            assert [tuple(x) for x in r["runs"]] == runs and r["n_runs"] == len(runs) and r["n_words"] == len(words)
            assert r["collapsed_text"] == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periods.find(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find(docs, copies=1)
