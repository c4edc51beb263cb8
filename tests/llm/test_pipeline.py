"""The pipeline, stage by stage, against brute force on each stage's own input."""

import collections
import tracemalloc

import numpy as np
import pytest
from test_operators import brute_contaminated, brute_lines, brute_links, words

import corpus_pipeline
from origo.llm import common, components, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    dice = np.random.default_rng(12)
    vocabulary = ["".join(dice.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    say = lambda k: " ".join(dice.choice(vocabulary, k))
    item, block = say(40), "\n".join(say(6) for _ in range(4))
    docs, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = say(80) + ".\n" + say(50) + "." if good else " ".join(w.upper() + "!!" for w in say(60).split())
        if good and i % 5 == 0:
            text += "\n" + block
        if good and i % 7 == 0:
            text += " " + item
        if good and i % 11 == 0 and docs:
            text = next(d[1] for d in reversed(docs) if d[0] % 4)
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    top = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", [(0, item), (1, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return top


def test_stages(spark, folder, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, states = docs.dtypes, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], folder).write.parquet(f"{tmp_path}/{name}")
        states.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(s.dtypes == columns for s in states[:-1])
    taken = [[(r["doc_id"], r["text"]) for r in s.collect()] for s in states[:-1]]
    whole, good, thin, single, clean = taken
    kept = {i for i, _ in good}
    assert {i for i, _ in whole if i < 1000 and i % 4} <= kept and sum(i % 4 == 0 for i in kept if i < 1000) <= 3
    assert sorted(thin, key=repr) == [r[:2] for r in brute_lines(good)]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in states[2].collect())
    blank = [i for i, t in thin if not words(t)]
    assert sorted(i for i, _ in single) == sorted({g for i, g, *_ in brute_links([r for r in thin if words(r[1])])} | set(blank))
    hit = {i for i, _ in brute_contaminated(single, [(0, spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 0").first()["text"])])}
    assert hit and {i for i, _ in clean} == {i for i, _ in single} - hit
    packed = states[-1].collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in clean}
    again = corpus_pipeline.run(spark, folder).collect()
    key = lambda rows: collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(again) == key(packed)


def test_lines_repeat_in_the_pipeline_with_other_neighbours(spark, folder):
    rows = [(i, f"head {i}\nthe line that all repeat\ntail {i}", "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, folder).collect()}
    assert found == {0: (rows[0][1], len(rows[0][1])), 1: ("head 1\ntail 1", 13), 2: ("head 2\ntail 2", 13)}


def test_empty(spark, folder, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_the_driver_gives_back_memory_after_checkpoints(spark, monkeypatch):
    shares, given_back = [], common.given_back
    monkeypatch.setattr(common, "given_back", lambda session, share=0.5: shares.append(share) or given_back(session, share))
    assert common.checkpointed(spark.range(5)).count() == 5 and shares == [0.5]
    assert not given_back(spark, 1.0) and given_back(spark, 0.0)


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """Rounds are most of what the driver has to plan, so none is run to see that there is nothing to do."""
    plans = []
    monkeypatch.setattr(components, "checkpointed", lambda df: plans.append(df) or common.checkpointed(df))
    found = lambda links: sorted(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    stars = [(5, -2), (-2, 7), (9, 8), (9, 8), (3, 3), (None, 4), (1, None)]
    assert found(stars) == [(-2, -2), (5, -2), (7, -2), (8, 8), (9, 8)] and len(plans) == 1  # before: 3
    assert found([]) == [] and len(plans) == 2
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    assert found(path) == [(i, 0) for i in range(41)] + [(i, 100) for i in (100, 101, 102)] and len(plans) > 3
    plan = plans[3]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 4  # before: 16, as a union plans all that leads to it twice


def test_the_fit_holds_few_pairs_at_once():
    dice = np.random.default_rng(2)
    y = (dice.random(500) < 0.6).astype(int)
    x = dice.normal(size=(500, len(quality.NAMES))) + y[:, None]
    tracemalloc.start()
    model = quality.fit_model(x, y)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 20e6  # before: 98e6, with all 60,000 pairs at once
    assert ((model.scores(x) >= 0.3) == (y == 1)).mean() > 0.95
