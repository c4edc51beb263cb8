"""Divergences against whole-number arithmetic over all terms, and odd tables."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from origo.llm import divergence

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs=10, top=10):
    groups, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, source, text in rows:
        found = TERM.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        groups[lang or "", source or ""].update(found)
        docs.update({(lang or "", t) for t in found})
    out = []
    for lang in {k for k, _ in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least_docs)
        of = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(of.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(whole)
        shares = {s: p(c) for s, c in of.items()}
        for s, mine in shares.items():
            pairs = sorted((-sum(f(mine[t], other[t]) for t in kept), o.encode()) for o, other in shares.items() if o != s)
            above = sorted((-f(mine[t], q[t]), t) for t in kept if of[s][t] and mine[t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", above)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def made(n, seed):
    dice = random.Random(seed)
    words = [a + b for a in ("The", "an", "é", "zß", "x") for b in ("one", "TWO", "ÄÖ", "日本", "")]
    rows = []
    for _ in range(n):
        lang, source = dice.choice(["en", "en", "en", "de", None, ""]), dice.choice(["a", "a", "a", "b", "é", "zz", None])
        text = "".join(dice.choice(words) + dice.choice([" ", ", ", "\n", "1", "\x7f"]) for _ in range(dice.randint(0, 40)))
        rows.append((lang, source, dice.choice([text, text, text, text, None, ""])))
    return rows + [("one", "only", "here " * 20)] + [("none", s, "rare") for s in "abc"] + [("en", "long", "the One " * 30_000 + "x" * 100_000)] + [("en", "silent", "1 2 3")]


@pytest.mark.parametrize("size", [32 << 20, 1000])
def test_audit(spark, size):
    rows = made(400, 3)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("z") for c in ("term", "n", "docs", "block", "kept")}).repartition(5)
    found = divergence.audit(docs, block_bytes=size)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert [t for _, t in found.dtypes] == ["string"] * 4 + ["bigint", "int"]


def test_small_slices_and_equal_hashes(spark, monkeypatch):
    """Slices of one text, and hashes that collide: nothing changes."""
    monkeypatch.setattr(divergence, "SLICE_BYTES", 1)
    monkeypatch.setattr(divergence.xxhash, "xxh64_intdigest", len)
    data = np.frombuffer("Ab cd AB aB".encode(), dtype=np.uint8)
    found = divergence._counts(data, np.array([0, 5, len(data)]), np.array([1, 0]))
    assert sorted(zip(*(found.column(c).to_pylist() for c in ("term", "group", "n", "docs")))) == [("ab", 0, 2, 1), ("ab", 1, 1, 1), ("cd", 1, 1, 1)]


def test_shares_are_exact():
    dice = random.Random(1)
    for _ in range(200):
        count, more, kept = dice.randrange(10**15), dice.randrange(10**15), dice.randrange(1, 10**6)
        assert int(divergence.share(np.array([count]), np.array([count + more]), kept)[0]) == 1 + 10**9 * (count + 2) // (count + more + 2 * kept)
    with pytest.raises(OverflowError):
        divergence.share(np.array([1]), np.array([10**16]), 1)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    assert divergence.audit(spark.createDataFrame([(None, None, None)], "lang string, source string, text string")).count() == 0
