"""The operators against brute force, and over odd tables."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from origo.llm import chat, decontam, jaccard, lines, nearest, packing, private, quality, sharding, substring, textkit

DOC = T.StructType.fromJson({"type": "struct", "fields": [
    {"name": "doc_id", "type": "long", "nullable": True, "metadata": {}}, {"name": "text", "type": "string", "nullable": True, "metadata": {}}]})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(n=60, seed=1):
    """Texts with copies, near copies, shared passages, repeats and oddities."""
    dice = np.random.default_rng(seed)
    vocabulary = ["".join(dice.choice(list("abcdefgé"), 6)) for _ in range(4000)]
    say = lambda k: " ".join(dice.choice(vocabulary, k))
    passage = say(70)
    texts = []
    for i in range(n):
        kind = i % 6
        text = say(120) + "\n" + say(30)
        if kind == 1 and texts:
            text = texts[-1]
        elif kind == 2 and texts:
            text = texts[-1].replace(words(texts[-1])[5], "xx")
        elif kind == 3:
            text = say(40) + "\n" + passage + "\n" + say(10)
        elif kind == 4:
            text = "\n".join(["one line", "two line", "", "three line", "four line", say(8)] * 2)
        texts.append(text)
    return list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "short"), (1004, "short"), (None, texts[0]), (None, None), (0, texts[0]), (1005, "w " * 3000), (1006, "x" * 50_000)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOC)


def test_word_hashes():
    texts = ["a b  a\tc", None, "", "éa b", " x ", "a b a c"]
    got = list(textkit.words_of(pa.array(texts), 4))
    flat = [w for _, _, part in got for w in part.hashes().tolist()]
    said = [w for t in texts for w in words(t)]
    assert len(flat) == len(said) and len(set(zip(flat, said))) == len(set(said)) == len(set(flat))
    _, _, part = next(textkit.words_of(pa.array(["a b c a b c", "a b c"])))
    h, first = part.windows(3, part.hashes())
    assert first.tolist() == [0, 4, 5] and h[0] == h[3] == h[4] != h[1]


# --- 1 ------------------------------------------------------------------------


def brute_links(rows):
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None) for i, w in ((i, words(t)) for i, t in rows)]
    counts = collections.Counter(s for _, s in sets if s)
    links = {s: [o for o in counts if o != s and len(s & o) >= 0.8 * len(s | o)] for s in counts}
    group = {s: s for s in counts}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for s, others in links.items():
        for o in others:
            group[root(o)] = root(s)
    last = lambda i: (i is None, i)
    least = {}
    for i, s in sets:
        if s:
            least[root(s)] = min(least.get(root(s), i), i, key=last)
    return sorted(((i, least[root(s)], counts[s], sum(counts[o] for o in links[s]) + counts[s] - 1, len(links[s])) if s else (i, i, 1, 0, 0) for i, s in sets), key=repr)


def test_jaccard_runs_reach_the_recall(spark):
    """Pairs at 0.8 and a little above, in small nodes after several splits and
    with one run to begin with: repeated runs find all that the recall promises."""
    assert jaccard.missed(0.8, 1) == pytest.approx(0.16) and jaccard.missed(0.8, 3) == pytest.approx(0.3576, abs=1e-3)
    dice = np.random.default_rng(9)
    rows = []
    for i in range(400):
        w = [f"p{i}w{k}" for k in range(100)]
        rows.append((2 * i, " ".join(w)))
        w[20], w[60] = "x", "y"  # 86 of 106 shingles stay common
        rows.append((2 * i + 1, " ".join(w)))
    dice.shuffle(rows)
    df = spark.createDataFrame([(int(i), str(t)) for i, t in rows], DOC).repartition(4)
    found = jaccard.join(df, bucket=20, runs=1, recall=0.9999).filter("n_links = 1 and class_id = 2 * floor(doc_id / 2)").count()
    assert found == 800


def test_the_recall_of_runs_that_share_a_sketch():
    """Against drawn sketches; as few runs as needed, and more for deeper trees."""
    dice = np.random.default_rng(1)
    for splits, runs in ((3, 10), (8, 10)):
        agreeing = dice.binomial(jaccard.PLACES, 0.8, 20_000) / jaccard.PLACES
        drawn = np.mean([jaccard.missed(0.8, splits, a) ** runs for a in agreeing])
        assert jaccard.lost(0.8, splits, runs) == pytest.approx(drawn, rel=0.1)
    assert jaccard.lost(0.8, 8, 10) > 0.005  # what independent runs would not show
    needed = [jaccard.runs_needed(0.8, s, 0.999) for s in (1, 3, 5, 8, 16)]
    assert needed == sorted(needed) and needed[1] <= 10 < needed[3]
    assert all(jaccard.lost(0.8, s, n) <= 0.001 < jaccard.lost(0.8, s, n - 1) for s, n in zip((1, 3, 5, 8, 16), needed))


@pytest.mark.parametrize("options", [{}, {"bucket": 2, "depth": 2, "block": 2}])
def test_jaccard_join(docs, rows, options):
    found = jaccard.join(docs, **options).select("doc_id", "class_id", "n_copies", "n_links", "n_linked_sets")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_links(rows)


def test_jaccard_dedup(docs, rows, nothing):
    kept = jaccard.dedup(docs)
    groups = {g for i, g, *_ in brute_links(rows)}
    blank = sum(not words(t) for _, t in rows)
    assert kept.count() == len({(g) for i, g, *_ in brute_links([r for r in rows if words(r[1])])}) + blank and groups
    assert kept.columns == ["doc_id", "text"]
    assert jaccard.join(nothing).count() == 0 and jaccard.dedup(nothing).count() == 0


def test_jaccard_large_group(spark):
    base = [f"w{i}" for i in range(300)]
    near = [(i, " ".join(base[: 5 * 40] + [f"u{i}"] + base[200:])) for i in range(60)] + [(100, " ".join(base[::-1]))]
    found = {r["doc_id"]: r for r in jaccard.join(spark.createDataFrame(near, DOC), bucket=10, depth=2, block=7).collect()}
    assert all(found[i]["n_links"] == 59 and found[i]["class_id"] == 0 for i in range(60)) and found[100]["n_links"] == 0


def test_jaccard_groups_of_null_and_repeated_ids(spark):
    lone, other, twice, again = (" ".join(f"{name}{k}" for k in range(60)) for name in "abcd")
    df = spark.createDataFrame([(None, lone), (None, lone), (None, lone + " end"), (None, other), (7, twice), (8, twice + " end"), (7, again), (9, again)], DOC)
    kept = sorted((r["doc_id"], r["text"].removesuffix(" end")) for r in jaccard.dedup(df).na.fill(-1).collect())
    assert kept == [(-1, lone), (-1, other), (7, twice), (7, again)]
    groups = {}
    for r in jaccard.join(df).collect():
        groups.setdefault(r["group_key"], []).append(r["doc_id"])
    assert sorted((sorted(g, key=repr) for g in groups.values()), key=repr) == [[7, 8], [7, 9], [None] * 3, [None]]


def test_jaccard_common_line_makes_no_group(spark):
    """Texts with one common line: whatever places it fills, they are no candidates,
    as texts that are alike are."""
    common = " ".join(f"common{k}" for k in range(9))
    rows = [(i, common + "\n" + " ".join(f"d{i}w{k}" for k in range(14))) for i in range(400)]
    alike = [(1000 + i, " ".join(f"a{k}" for k in range(60)) + f" end{i}") for i in range(40)]
    texts = spark.createDataFrame(rows + alike, DOC).select("doc_id", F.lit(0).cast("long").alias("text_key"), "text").repartition(3)
    classes = texts.mapInArrow(jaccard._sketched(5), "doc_id long, text_key long, c long, size long, sketch binary, brief binary").persist()
    links, again = jaccard.candidate_links(classes, 0.8, first=1, runs=10, bucket=10, depth=16, margin=0.3, dense=0.7)
    near = {r["c"] for r in classes.filter("doc_id >= 1000").collect()}
    found = {r["node"] for r in jaccard.components(links).collect()}
    assert found == near and len(again) > 1


def test_jaccard_added_runs_take_what_was_split_often(spark, monkeypatch):
    dice = np.random.default_rng(4)
    alike = [[f"a{k}" for k in range(100)] for _ in range(60)]
    for i, w in enumerate(alike):
        w[i], w[(i * 7 + 50) % 100] = f"x{i}", f"y{i}"
    rows = [" ".join(w) for w in alike] + [" ".join(f"d{i // 2}w{k}" for k in range(100)) + f" {i % 2}" for i in range(200)]
    df = spark.createDataFrame([(i, rows[i]) for i in dice.permutation(len(rows)).tolist()], DOC).repartition(3)
    links, passes = jaccard.candidate_links, []
    monkeypatch.setattr(jaccard, "candidate_links", lambda classes, *a, **k: passes.append(classes.count()) or links(classes, *a, **k))
    found = jaccard.join(df, bucket=20, dense=2.0).select("doc_id", "n_linked_sets").collect()
    assert len(passes) > 1 and passes[0] == len(rows) and max(passes[1:]) <= len(alike)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    said = {i: sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["n_linked_sets"] for r in found} == said


def test_jaccard_blocks_follow_the_sizes_of_sets(spark):
    df = spark.createDataFrame([(5, 100), (128, 10**7), (129, 40_000), (1280, 300_000), (1280, 10**7), (12_800, 3_000_000)], "n long, s long")
    assert [r[0] for r in df.select(jaccard._blocks(F.col("n"), F.col("s"), 128)).collect()] == [1, 1, 1, 3, 10, 25]


# --- 2 ------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    "a@b.c-d_x@y.z", "é a@b.com@c.d 😀 1.2.3.4.5.6.7.8 300.1.1.1 001.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-11114 5", "+1 (361) 555-8283+44 20 7946 0958 ++12",
    "x" * 100_000, "1 " * 5000, "a@b.cc " * 700, None, "", "1.1.1.1." * 300, "9" * 50_000, "@" * 500 + "a@b." * 500, "tel 555-123-4567, john (at) mail (dot) org", "+12345678  +1" + " " * 900,
]


def test_private_base_spans(spark):
    df = spark.createDataFrame([*enumerate(ODD), (None, ODD[0])], DOC)
    found = private.find(df).select("doc_id", private.said(F.col("base")).alias("base"), "spans", F.col("base").alias("b")).collect()
    assert len(found) == len(ODD) + 1
    for r in found:
        assert r["base"] == brute_spans(ODD[r["doc_id"] or 0])
        assert {tuple(x) for x in r["b"]} <= {tuple(x) for x in r["spans"]}


def test_private_additions(spark, nothing):
    """Forms that the base patterns miss, among look-alikes: what is added, and how
    much of what should be. Fails if nothing is added."""
    dice = np.random.default_rng(2)
    digits = lambda n: "".join(map(str, dice.integers(0, 10, n)))
    fill = lambda k: " ".join("".join(dice.choice(list("abcdefgh"), 6)) for _ in range(k))
    octets = lambda sep: sep.join(map(str, dice.integers(1, 255, 4)))
    texts, near, decoys = [], {}, set()
    for i in range(900):
        said, more = [], ""
        if i % 3 == 0:
            said = [f"+1 ({digits(3)}) 555-{digits(4)}", f"{fill(1)}@{fill(1)}.org", octets("."), "4111111111111111"]
        elif i % 3 == 1 and i % 9 == 1:
            kind = ("phone", "email", "ip")[i // 9 % 3]
            more = {"phone": f"({digits(3)}) 555-{digits(4)}", "email": f"{fill(1)} (at) {fill(1)} [dot] org", "ip": octets("[.]")}[kind]
        elif i % 3 == 2:
            said = [("2024-03-15", "12.05.2024", "10/11 2023", f"{digits(2)}-{digits(2)}-{digits(2)}", "1.2.3", "1.2.3.4.5", "4111111111111112", "9" * 13, "1234 5678 9012 34")[i // 3 % 9]]
            decoys.add(i)
        text = fill(4)
        for x in said:
            text += f" {x} {fill(3)}"
        if more:
            near[i] = (kind, len(text) + 1, len(text) + 1 + len(more))
            text += f" {more} {fill(3)}"
        texts.append((i, text))
    df = spark.createDataFrame(texts, DOC).repartition(3)
    found = {r["doc_id"]: r for r in private.find(df).collect()}
    added = {(i, *x) for i, r in found.items() for x in set(map(tuple, r["spans"])) - set(map(tuple, r["base"]))}
    wanted = {(i, *x) for i, x in near.items()}
    assert all(",".join(":".join(map(str, x)) for x in r["base"]) == brute_spans(texts[i][1]) for i, r in found.items())
    assert len(added & wanted) >= 0.95 * len(wanted) and len(added & wanted) >= 0.95 * len(added)
    assert {k for _, k, *_ in added} == {"phone", "email", "ip"} and not {i for i, *_ in added} & decoys
    assert private.find(df.filter("doc_id % 3 <> 0")).filter(F.size("spans") > F.size("base")).count() == 0  # nothing verified to learn from


@pytest.mark.parametrize("planted", [40, 200, 800])
def test_private_additions_however_many(spark, planted):
    """Numbers without a plus, written as those with one, are found whether they are
    few or twice as many as these; dates are left alone."""
    dice = np.random.default_rng(planted)
    number = lambda: f"({dice.integers(200, 999)}) 555-{dice.integers(1000, 9999)}"
    rows = [(i, f"Please call me on +1 {number()} any day.") for i in range(400)]
    rows += [(1000 + i, f"It was built on {dice.integers(10, 28)}.{dice.integers(10, 12)}.{dice.integers(1900, 2020)} by hand.") for i in range(300)]
    rows += [(5000 + i, f"Please call me on {number()} any day.") for i in range(planted)]
    df = spark.createDataFrame(rows, DOC).repartition(4)
    found = {r["doc_id"]: [(x["kind"], x["start"]) for x in r["spans"]] for r in private.find(df).collect()}
    right = sum(any(k == "phone" for k, _ in found[5000 + i]) for i in range(planted))
    wrong = sum(bool(found[1000 + i]) for i in range(300))
    assert right >= 0.95 * planted and wrong <= 0.2 * (right + wrong)
    assert all(found[i] == [("phone", 18)] for i in range(400))


def test_private_redaction(spark, nothing):
    good, bad = "4111111111111111", "4111111111111112"
    df = spark.createDataFrame([(i, f"call +1 555 010 {i:04d} or card {good if i % 2 else bad} at 10.0.0.{i % 300}") for i in range(400)], DOC)
    clean = {r["doc_id"]: r["text"] for r in private.redact(df).collect()}
    assert clean[1] == "call [phone] or card [card] at [ip]" and clean[2] == f"call [phone] or card {bad} at [ip]"
    assert private.find(nothing).count() == 0


# --- 3 ------------------------------------------------------------------------


def brute_windows(rows, width=50):
    rank = lambda i: (i is None, i)
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i, key=rank)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - width + 1) if rank(first[tuple(w[k : k + width])]) < rank(i) for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"bucket_windows": 50, "group_bytes": 2000}])
def test_substring(docs, rows, nothing, options):
    found = substring.dedup(docs, 50, **options)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()), key=repr) == brute_windows(rows)
    assert substring.dedup(nothing).count() == 0


def test_substring_of_many_null_ids(spark, rows):
    lost = [(None, t) for _, t in made(40, 5)[:40]]
    df = spark.createDataFrame(rows + lost, DOC).repartition(3)
    found = substring.dedup(df, 50, bucket_windows=500, group_bytes=4000)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found.collect()), key=repr) == brute_windows(rows + lost)


# --- 4 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing(docs, rows, tokenizer, nothing):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer)
    found = packing.pack(docs, tokenizer, 256, island_items=20).collect()
    ids = collections.Counter()
    for i, t in rows:
        x = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        start, to, piece = 0, len(x) % 256 or min(len(x), 256), 0
        while start < len(x):
            ids[(i, piece, start, to - start, zlib.crc32(np.array(x[start:to], "<u4").tobytes()))] += 1
            start, to, piece = to, to + 256, piece + 1
    assert ids == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found)
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:k]) for k in range(len(items))] and sum(n for _, n in items) <= 256
    assert len(bins) <= -(-sum(r["length"] for r in found) // 256) * 1.1 + 3
    assert packing.pack(nothing, tokenizer).count() == 0


def test_special_strings_keep_the_library_ids(tokenizer):
    from tokenizers import Tokenizer

    encode, tk = packing._encoder(tokenizer), Tokenizer.from_file(tokenizer)
    for text in ("a <|endoftext|> b", "", " ", "\x00é😀" * 9, "x" * 5000, " " * 5000, "don't 12,3"):
        assert encode(text) == tk.encode(text, add_special_tokens=False).ids


def test_genetic_steps_keep_every_item():
    dice = np.random.default_rng(2)
    lengths = dice.integers(1, 100, 300).tolist()
    plain = packing.Packing(lengths, 100).best_fit(list(range(300)))
    best = packing.evolve(lengths, 100, 1, 20)
    assert sorted(i for b in best.bins for i in b) == list(range(300)) and max(best.fill) <= 100 and len(best.bins) <= len(plain.bins)
    # Lengths that fill 60 bins; best fit alone takes 70.
    parts = [x for _ in range(60) for a in [int(dice.integers(380, 499))] for b in [int(dice.integers(250, (1000 - a) // 2))] for x in (a, b, 1000 - a - b)]
    fit = len(packing.Packing(parts, 1000).best_fit(list(range(180))).bins)
    found = packing.evolve(parts, 1000, 1, 100)
    assert fit >= 67 and len(found.bins) <= 63 and sorted(i for b in found.bins for i in b) == list(range(180)) and max(found.fill) <= 1000
    assert len(packing.evolve(parts, 1000, 1, 0).bins) == fit
    adopted = packing._adopt(plain, [(50, 50), (99, 1), (1000,)])
    assert sorted(i for b in adopted.bins for i in b) == list(range(300)) and max(adopted.fill) <= 100


def test_packing_beats_best_fit_and_islands_meet(spark, tokenizer):
    """Documents whose lengths fill 60 sequences exactly; best fit needs more, and
    islands by themselves do. Fails if crossover does nothing."""
    dice = np.random.default_rng(5)
    parts = [x for _ in range(60) for a in [int(dice.integers(380, 499))] for b in [int(dice.integers(250, (1000 - a) // 2))] for x in (a, b, 1000 - a - b)]
    encode = packing._encoder(tokenizer)
    texts = [(i, " a" * (n - 1)) for i, n in enumerate(parts)]
    assert all(len(encode(t)) + 1 == n for (_, t), n in zip(texts[:20], parts))
    df = spark.createDataFrame(texts, DOC)
    used = lambda **o: packing.pack(df, tokenizer, 1000, **o).select("sequence_id").distinct().count()
    plain = used(generations=0)
    assert plain >= 67 and used() <= 63
    assert used(island_items=20, fan=3, merge_bins=8) <= 66
    found = packing.pack(df, tokenizer, 1000, island_items=20, fan=3, merge_bins=8).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(180))
    fill = collections.Counter()
    for r in sorted(found, key=lambda r: r["offset"]):
        assert fill[r["sequence_id"]] == r["offset"]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1000


# --- 5 ------------------------------------------------------------------------


def test_quality(spark, nothing):
    dice = np.random.default_rng(4)
    vocabulary = ["".join(dice.choice(list("abcdefgh"), 5)) for _ in range(500)]
    texts, labels = [], []
    for i in range(600):
        w = dice.choice(vocabulary, 60)
        good = i % 3 != 0
        texts.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w[:30]) + " buy" * 20, "x"))
        labels.append((i, int(good)))
    texts += [(9001, None, "x"), (None, "", "x"), (1, texts[1][1], "x"), (9002, "word " * 20_000, "x")]
    labels += [(None, 1), (5, None), (77_777, 1)]
    df, known = spark.createDataFrame(texts, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.classify(df, known).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    told = [(r["predicted"], int(r["doc_id"] % 3 != 0)) for r in found if r["held_out"] and r["doc_id"] < 600]
    assert sum(a == b for a, b in told) / len(told) > 0.97
    assert quality.classify(nothing, known).count() == 0
    assert {r["predicted"] for r in quality.classify(df, known.limit(0)).collect()} == {1}


def test_held_out_labels_are_not_learned(spark):
    df = spark.createDataFrame([(i, f"text {i} " * (1 + i % 4)) for i in range(100)], DOC)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    one = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    other = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(100)], "doc_id long, quality int")
    a, b = quality.fit(df, one), quality.fit(df, other)
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


# --- 6 ------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = "x\\<|y\\|\x00\x01\x02<|im_end|>\\n\\\\<\\|\n"
    turns = [(1, 0, "a\\nb\nc", odd), (1, 1, "assistant", odd), (1, 2, None, None), (1, 2, None, None), (2, None, "assistant", "\\"), (None, 0, "user", ""), (3, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    out = chat.format_chats(chat.events(df))
    back = {r[0]: [tuple(x) for x in r[1]] for r in out.select("conv_id", chat.read_back(F.col("formatted"))).collect()}
    assert back == {1: [("a\\nb\nc", odd), ("assistant", odd), ("user", ""), ("user", "")], 2: [("assistant", "\\")], None: [("user", "")], 3: [("user", "long " * 50_000)]}
    for r in chat.digests(out).collect():
        said = back[r["conv_id"]]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r["n_turns"] == len(said) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert chat.digests(chat.format_chats(chat.events(df.limit(0)))).count() == 0


def test_chat_events_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "Hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 1, "regenerate", None, None),
        (1, 4, 1, "delta", None, "Good "), (1, 5, 1, "delta", None, "day"), (1, 6, 0, "edit", None, "hello"), (1, 7, 2, "delta", None, "?"), (1, 8, 1, "delta", None, "!"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").withColumn("copy", F.lit(1))
    found = chat.messages(df).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in found] == [("user", "hello"), ("assistant", "Good day!"), ("user", "?")]


def brute_fold(log):
    """Events, one after another, applied to a dictionary of messages."""
    said = {}
    for conv, seq, turn, kind, role, text in sorted(log, key=lambda e: (e[1], e[3] == "delta")):
        now = said.setdefault((conv, turn), [None, ""])
        now[0] = now[0] or role
        now[1] = now[1] + (text or "") if kind == "delta" else "" if kind == "regenerate" else text or ""
    return sorted((conv, turn, role or "user", text) for (conv, turn), (role, text) in said.items())


@pytest.mark.parametrize("seed", range(3))
def test_chat_fold_against_brute_force(spark, seed):
    dice = np.random.default_rng(seed)
    log = []
    for conv in range(25):
        for seq in range(int(dice.integers(1, 40))):
            kind = str(dice.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]))
            role = "assistant" if kind == "message" else None
            log.append((conv, seq, int(dice.integers(0, 5)), kind, role, None if dice.random() < 0.1 else f"{seq}<|im_end|>\\ "))
    dice.shuffle(log)
    log = [(int(c), int(q), int(t), str(k), r, x) for c, q, t, k, r, x in log]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").withColumn("copy", F.lit(1))
    want = brute_fold(log)
    assert sorted(tuple(r) for r in chat.messages(df).select("conv_id", "turn", "role", "text").collect()) == want
    back = chat.format_chats(df).select("conv_id", chat.read_back(F.col("formatted")).alias("said")).collect()
    assert sorted((r["conv_id"], *x) for r in back for x in r["said"]) == sorted((c, role, text) for c, _, role, text in want)


def test_chat_of_many_turns(spark):
    df = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("ab").alias("text"))
    began = time.monotonic()
    r = chat.digests(chat.format_chats(chat.events(df))).first()
    assert (r["n_turns"], r["loss_chars"]) == (100_000, 200_000) and time.monotonic() - began < 120


# --- 7 ------------------------------------------------------------------------


def shingled(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return w


def brute_contaminated(rows, items):
    out = {}
    for i, t in rows:
        w = shingled(t)
        for j, item in items:
            v = shingled(item)
            if not v or not w:
                continue
            k, n = min(5, len(v)), min(len(v), len(w))
            grams = lambda x, k=k: collections.Counter(" ".join(x[a : a + k]) for a in range(len(x) - k + 1))
            weight = lambda c: sum(len(g) * m for g, m in c.items())
            own = grams(v)
            for s in range(len(w) - n + 1):
                win = grams(w[s : s + n])
                both, either = weight(own & win), weight(own | win)
                sim = both / either if either else 0
                if sim >= 0.8 and sim > out.get((i, j), (0, 0))[1] + 1e-12:
                    out[(i, j)] = (s, sim)
    return {k: (s, round(x, 9)) for k, (s, x) in out.items()}


def test_decontamination(spark, nothing):
    dice = np.random.default_rng(8)
    vocabulary = ["".join(dice.choice(list("abcdefghé"), 7)) for _ in range(900)]
    say = lambda k: list(dice.choice(vocabulary, k))
    items = [(j, " ".join(say(n))) for j, n in enumerate([60, 40, 80, 5, 3, 120, 30])] + [(7, None), (8, " "), (9, "same same same same same same same same")]
    rows = []
    for i in range(70):
        body = say(150)
        if i % 2:
            j = i // 2 % 7
            item = items[j][1].split()
            change = i // 14
            for _ in range(change if len(item) > 20 else 0):
                item[int(dice.integers(1, len(item)))] = "changed"
            if i % 5 == 0:
                item.insert(len(item) // 2, "added")
            body[40:40] = [x.upper() + "," for x in item]
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (103, " ".join(items[0][1].split()[:55])), (104, "same " * 40), (None, items[1][1]), (105, "w " * 5000)]
    df, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in decontam.find(df, bench).collect()}
    want = brute_contaminated(rows, items)
    assert found == want and len({round(s, 3) for _, s in want.values()}) > 3
    kept = decontam.clean(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.find(nothing, bench).count() == 0 and decontam.find(df, bench.limit(0)).count() == 0


def test_decontamination_of_uneven_shingles(spark):
    """Words of very different lengths, shared and not, and items that repeat
    themselves: what the exact similarity counts, the fingerprints must let through."""
    dice = np.random.default_rng(3)
    vocabulary = ["".join(dice.choice(list("abcdefghij"), int(n))) for n in dice.choice([1, 2, 3, 5, 8, 13, 30, 90], 2000)]
    say = lambda k: list(dice.choice(vocabulary, k))
    long = "q" * 4000
    items = [say(30) for _ in range(20)] + [say(12) + [long] + say(12) for _ in range(6)] + [(say(4) * 9)[: 30 + k] for k in range(6)] + [["again"] * 25 + say(15)]
    rows = []
    for i in range(200):
        item = list(items[i % len(items)])
        for _ in range(i // 66):  # up to three changes
            at = int(dice.integers(0, len(item)))
            if item[at] != long:
                item[at : at + 1] = [] if dice.random() < 0.5 else say(1)
        rows.append((i, " ".join(say(20) + item + say(20))))
    # Only what surrounds one long word is shared.
    rows.append((900, " ".join(say(30) + items[20][8:18] + say(30))))
    bench = [(j, " ".join(item)) for j, item in enumerate(items)]
    df, known = spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(bench, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in decontam.find(df, known).collect()}
    want = brute_contaminated(rows, bench)
    assert found == want and (900, 20) in want and len(want) > 60


@pytest.mark.parametrize("heavy", [2, 4, 6])
def test_decontamination_of_few_heavy_shingles(spark, heavy):
    """An even number of heavy shingles, and light ones that differ: plain signs would
    cancel in half of all bits and leave these to the light ones."""
    items, rows = [], []
    for i in range(500):
        words = [f"a{i:03}x{k:02}" for k in range(heavy + 5)]
        words[heavy - 1] = f"b{i}".ljust(160, "z")
        items.append((i, " ".join(words)))
        rows.append((i, " ".join(["before", *words[:-1], "other", "behind"])))
    df, bench = spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated([rows[0]], [items[0]])[(0, 0)]
    assert 0.8 <= want[1] < 0.97
    found = decontam.find(df, bench).filter("doc_id = item_id and start = 1").count()
    assert found == 500


def test_decontamination_by_items_that_repeat(spark):
    """Many items of one length that repeat a shingle meet only windows that hold an
    anchor of theirs."""
    dice = np.random.default_rng(8)
    say = lambda k: [f"w{x}" for x in dice.integers(0, 3000, k)]
    items = [(i, " ".join((say(6) * 2 + say(8))[:20])) for i in range(40)]
    rows = [(i, " ".join(say(30) + items[i % 40][1].split()[: 20 - i // 40] + say(30))) for i in range(120)]
    df, bench = spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 9)) for r in decontam.find(df, bench).collect()}
    assert found == brute_contaminated(rows, items) and len(found) >= 80


def test_windows_are_hashed_as_their_shingles_say(spark):
    """The running sums against fingerprints made from each window alone."""
    text = "a b a b a b c d e f a b a b a c c c c c c c d e".split()
    spots = spark.createDataFrame([(1, text, 8, 3, 6, [0, 1, 2])], "doc long, words array<string>, length int, k int, shingles int, cells array<int>")
    got = {r["start"]: r["print"] for r in decontam._windows(spots, 3, 2).collect()}
    sets = [(s, sorted({" ".join(text[p : p + 3]) for p in range(s, s + 6)})) for s in range(len(text) - 7)]
    rows = spark.createDataFrame(sets, "start long, grams array<string>").select("start", F.explode("grams").alias("g"))
    vote = decontam._vote(F.char_length("g"))
    want = rows.groupBy("start").agg(*decontam._votes(F.xxhash64("g"), vote), F.sum(vote).alias("total")).select("start", decontam._majority(F.col("total")).alias("print"))
    want = {r["start"]: r["print"] for r in want.collect()}
    assert got.items() <= want.items() and len(got) == len(want)


# --- 8 ------------------------------------------------------------------------


def brute_lines(rows, run=3):
    rank = lambda i: (i is None, i)
    seen, bare = {}, {}
    for i, t in rows:
        if t is not None:
            bare[(i, t)] = [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")]
    for (i, t), full in bare.items():
        n = [x for x in full if x]
        for k in range(max(1, len(n) - run + 1) if n else 0):
            key = (min(run, len(n)), *n[k : k + run])
            seen[key] = min(seen.get(key, (i, k)), (i, k), key=lambda p: (rank(p[0]), p[1]))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t, 0, 0))
            continue
        at = [k for k, x in enumerate(bare[(i, t)]) if x]
        n = [bare[(i, t)][k] for k in at]
        gone = {at[k + j] for k in range(max(1, len(n) - run + 1) if n else 0) if seen[(min(run, len(n)), *n[k : k + run])] != (i, k) for j in range(min(run, len(n)))}
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t, len(n), len(gone)))
    return sorted(out, key=repr)


def test_lines(docs, rows, nothing):
    # An id with two texts has an order of its own, so the brute version has one text an id.
    extra = rows + [(2000 + i, t) for i, (_, t) in enumerate(rows[:12])] + [(3000, "p\n\n q \nr\ns"), (3001, "z\np\nq\n\nr\ns\ny"), (3002, "p\nq"), (3003, "p\nq\n"), (3004, "r\n" * 400)]
    df = docs.sparkSession.createDataFrame(extra, DOC).withColumn("n_lines", F.lit("clash"))
    found = lines.dedup(df)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()), key=repr) == brute_lines(extra)
    assert lines.dedup(nothing).count() == 0


def test_lines_alone(spark):
    long = "a line of several words"
    texts = [(0, f"x0\n{long}\ny0"), (1, f"x1\ny1\n  {long} \nz1"), (2, long), (3, f"{long}\nshort\nx3"), (4, "short\nx4\n\nown words\nown  words\nown words"), (None, f"{long}\nend"), (5, None)]
    texts += [(100 + i, f"{long}\nu{i}") for i in range(300)]
    df = spark.createDataFrame(texts, DOC).repartition(4)
    want = {0: texts[0][1], 1: "x1\ny1\nz1", 2: "", 3: "short\nx3", 4: "short\nx4\n\nown words\nown  words", None: "end", 5: None} | {100 + i: f"u{i}" for i in range(300)}
    found = lines.dedup(df, alone=2).collect()
    assert {r["doc_id"]: r["text"] for r in found} == want and len(found) == len(texts)
    assert {r["doc_id"]: r["n_removed"] for r in found if r["doc_id"] is None or r["doc_id"] < 6} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 0}
    assert {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()} == dict(texts)


def test_a_text_of_many_equal_lines(spark):
    """The work grows with the lines; the square of these would take hours."""
    began = time.monotonic()
    df = spark.createDataFrame([(1, "again\n" * 100_000), (2, "\n".join(["once", *["again"] * 50_000]))], DOC)
    found = {r["doc_id"]: r for r in lines.dedup(df).collect()}
    assert found[1]["text"] == "again\n" and found[1]["n_removed"] == 99_999
    assert found[2]["text"] == "once" and found[2]["n_removed"] == 50_000
    assert time.monotonic() - began < 120


# --- 9 ------------------------------------------------------------------------


def test_sharding(spark, rows, nothing, tmp_path):
    hot = [(5000 + i, "the same text") for i in range(400)]
    df = spark.createDataFrame(rows + hot, DOC)
    found = sharding.shard(df, 8, ranges=64).collect()
    assert len(found) == len(rows) + 400
    load, slots, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of[r["text_crc32"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows + hot)
    small = [s for c, s in of.items() if c != zlib.crc32(b"the same text")]
    assert all(len(s) == 1 for s in small)
    assert sharding.shard(nothing).count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), 8, ranges=64)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(found)


def test_shards_are_even(spark):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 900)) for i in range(4000)], DOC)
    load = collections.Counter()
    for r in sharding.shard(df, 10).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 10 and max(load.values()) < 1.02 * min(load.values())


def test_shards_of_many_small_and_equal_rows(spark):
    """Half of the rows are empty, under a hundredth of the bytes: they share a
    shard and are numbered in many pieces. Rows that agree in all columns are hot."""
    rows = [(i, "") for i in range(3000)] + [(i, f"{i} " * 400) for i in range(3000)]
    df = spark.createDataFrame(rows, DOC)
    found = sharding.shard(df, 8, ranges=32, piece_rows=100).collect()
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert len(found) == 6000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r["shard"] for r in found if r["text_crc32"] == 0}) == 1
    same = spark.createDataFrame([(7, "one row " * 20)] * 4000 + [(i, f"other {i} " * 20) for i in range(4000)], DOC)
    load = collections.Counter()
    for r in sharding.shard(same, 8, ranges=64).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.1 * min(load.values())


def test_pieces_of_a_range_are_many_tasks(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    plan = sharding.shard(df, 8, ranges=32, piece_rows=100)
    spread = plan.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 2000


# --- 10 -----------------------------------------------------------------------


def test_nearest(spark):
    dice = np.random.default_rng(6)
    x = dice.normal(size=(1500, 24))
    x[100:400] = x[50]  # one vector many times, queries among them
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0, None] * 12), (5200, [1.0] * 3), (None, [1.0] * 24), (5250, [1e-300] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = [tuple(r) for r in nearest.search(df, 5).collect()], nearest.exact(df, 5)
    a, b = {(q, v) for q, _, v, _ in got}, {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(a & b) >= 0.95 * len(b)
    truth = {(q, r): (v, s) for q, r, v, s in want}
    same = [abs(s - truth[(q, r)][1]) < 1e-12 for q, r, v, s in got if truth[(q, r)][0] == v]
    assert all(same) and {v for q, _, v, _ in got if q == 50} == {100, 101, 102, 103, 104}
    few = nearest.search(df.filter("vec_id in (0, 1, 2)"), 5).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert nearest.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"rerank": 16}])
def test_nearest_in_a_cluster_of_near_copies(spark, options):
    dice = np.random.default_rng(7)
    x = dice.normal(size=(2600, 24))
    x[:2000] = x[0] + 1e-3 * dice.normal(size=(2000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in nearest.search(df, 5, **options).collect())
    assert got == [r[:3] for r in nearest.exact(df, 5)]


def test_codes_leave_few_vectors_to_compare(spark):
    dice = np.random.default_rng(9)
    x = dice.normal(size=(6000, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    left = nearest.index(df, 5).left
    assert left.filter("crowded").count() == 0 and left.count() < 0.02 * 120 * 6000
    got = sorted(tuple(r)[:3] for r in nearest.search(df, 5).collect())
    assert got == [r[:3] for r in nearest.exact(df, 5)]


def test_bounds_of_codes_hold():
    dice = np.random.default_rng(10)
    x = nearest._unit(np.concatenate([dice.normal(size=(700, 15)), np.eye(15), -np.eye(15)]))
    books = nearest.fit_levels(x[:300])
    codes, errors = nearest.encoded(books, x)
    assert (np.diff(errors.mean(axis=0)) < 0).all()
    for i in range(0, 700, 70):
        tables = [b.tables(x[i : i + 1])[0] for b in books]
        near, low, high = nearest._scan(tables, codes.T.copy(), errors.T.copy(), np.arange(len(x)) != i, 5, 32, 1e-4)
        cos = x @ x[i]
        assert ((low - 1e-5 <= cos[near]) & (cos[near] <= high + 1e-5)).all()
        best = [j for j in np.argsort(-cos) if j != i][:5]
        assert set(best) <= set(near.tolist()) and len(near) < len(x) - 1


def test_nearest_of_repeated_ids(spark):
    dice = np.random.default_rng(8)
    x = dice.normal(size=(61, 8))
    x[7] = x[0] + 1e-3
    x[50] = x[30]  # the least vector of id 50, so the one that asks
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist()), (7, (x[0] - 2e-3).tolist()), (0, x[20].tolist()), (0, x[0].tolist())]  # equal and different vectors of an id
    rows += [(50, x[30].tolist())] * 9 + [(51, x[30].tolist()), (52, x[30].tolist())] * 2  # an id that asks fills the front of its group
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for options in ({}, {"query_block": 1, "code_block": 8, "rerank": 4}):
        got = sorted((q, r, v, round(s, 12)) for q, r, v, s in nearest.search(df, 5, **options).collect())
        assert got == [(q, r, v, round(s, 12)) for q, r, v, s in nearest.exact(df, 5)]
    assert [v for q, _, v, _ in got if q == 50] == [30] + [51] * 2 + [52] * 2
