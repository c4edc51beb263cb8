"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Texts are cut into words (letters and digits, lower case), and an item of the
benchmark is looked for in every window of as many words as it has. A document
is contaminated by an item if a window's shingles of `width` words are similar to
the item's: weighted Jaccard similarity of `similarity` or more, where a shingle
weighs its characters as often as it occurs.

1. Which windows can be similar at all: a similar window shares more of an
   item's weight than all but `1 - similarity` of it, so it holds one of any
   shingles that weigh more than that together. Those with the longest words
   are an item's anchors. A bitmap of the anchors' words, then one of the
   anchors, finds where texts may hold one; bitmaps have a fixed size, and can
   only let too much through. Only windows without an anchor are left out, and
   they are similar to nothing.
2. Every other window of the size of an item has a 64-bit SimHash of its
   different shingles. A shingle votes with the square root of its weight, so the
   cosine of two sets is 2 * similarity / (1 + similarity) at least, whatever the
   weights. For each bit its vote is multiplied by one of 16 evenly spaced numbers
   around zero, by a hash of shingle and bit: so even two heavy shingles hardly ever
   cancel, and light ones decide a bit as seldom as the angle says (with plain signs,
   an even number of heavy shingles leaves half of all bits to the light ones). The
   radius is the mean distance at that angle and 4.6 standard deviations (23 bits at
   0.8). Votes are running sums over the starts of windows (a shingle counts from
   behind its last copy on), so the work is in proportion to the words.
3. A multi-index finds the candidates: fingerprints are eight blocks; an item is
   entered under each block and all its values within radius / 8 bits, a window
   looks up its eight blocks. Two fingerprints within the radius agree so in one
   block at least, so the index misses none; then the whole distance is tested.
   An item that repeats shingles, whose weighted similarity a set does not bound,
   is compared with the windows of its size that hold one of its own anchors.
4. Candidates are compared exactly.

Each pair of a document and an item is one row, whatever the number of windows.

Defined cases: null and empty texts and items match nothing; an item of fewer
than `width` words is one shingle; a document of fewer words than an item is one
window; a null id is kept as null, repeated rows match apiece; repeated items are
items of their own; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm.common import checkpointed, parts_for

BITS = 1 << 20
BLOCKS = 8
LEVELS = 16  # numbers that a vote is multiplied by
LANES = 0xF0000000F  # two levels of a hash, 32 bits apart


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _shingle(words: Column, at: Column, k: Column, width: int) -> Column:
    """The `k` words from `at` on, `width` at most. Word by word: a slice would copy
    the whole array each time."""
    return F.concat_ws(" ", *[F.when(k > j, F.get(words, at + j)) for j in range(width)])


def shingles_of(words: Column, k: Column, width: int) -> Column:
    """All runs of `k` of the words, which are as many at least."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _shingle(words, i, k, width))


def radius_for(similarity: float, sigmas: float = 4.6) -> int:
    """The Hamming distance of 64 bits that fingerprints of this similarity keep."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(64, math.ceil(64 * p + sigmas * math.sqrt(64 * p * (1 - p))))


def _vote(weight: Column) -> Column:
    """The square root of a weight, to a quarter."""
    return F.round(F.sqrt(weight) * 4).cast("long")


def _levels(h: Column) -> list[Column]:
    """Four hashes of a shingle: a level from 0 to 15 for each of 64 bits."""
    return [F.xxhash64(h, F.lit(j)).alias(f"g{j}") for j in range(4)]


def _votes(h: Column, vote: Column, levels: list[Column] | None = None) -> list[Column]:
    """Sums of votes times levels for the 64 bits, bits i and i + 32 in the two halves
    of a sum. `levels` are those of `h`, where columns hold them."""
    levels = _levels(h) if levels is None else levels
    # Levels k and k + 8 of a hash lie 32 bits apart: one shift takes both.
    return [F.sum(vote * F.shiftrightunsigned(levels[i // 8], 4 * (i % 8)).bitwiseAND(F.lit(LANES))).alias(f"v{i}") for i in range(32)]


def _held() -> list[Column]:
    return [F.col(f"g{j}") for j in range(4)]


def _majority(total: Column) -> Column:
    """The fingerprint of the sums v0 to v31: where levels lie above their middle."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        for value, votes in ((1 << i, F.col(f"v{i}").bitwiseAND((1 << 32) - 1)), (1 << i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            bits = bits.bitwiseOR(F.when(votes * 2 > total * (LEVELS - 1), F.lit(value - (1 << 64) if value >> 63 else value)).otherwise(F.lit(0).cast("long")))
    return bits


def _blocks(fingerprint: Column) -> Column:
    """The blocks of a fingerprint, with their numbers."""
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, 8 * b).bitwiseAND(255).cast("int").alias("value")) for b in range(BLOCKS)])


def _places(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(BITS - 1), F.shiftrightunsigned(h, 24).bitwiseAND(BITS - 1)


def _bitmap(hashes: DataFrame) -> Column:
    """A bitmap of a column `h` of hashes: BITS / 64 numbers, whatever the rows."""
    at = hashes.select(F.explode(F.array(*_places(F.col("h")))).alias("i"))
    rows = at.groupBy(F.shiftright("i", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("b")).collect()
    held = {r["w"]: r["b"] for r in rows}
    if not held:
        return F.lit(None).cast("array<bigint>")
    return F.split(F.lit(",".join(str(held.get(w, 0)) for w in range(BITS // 64))), ",").cast("array<bigint>")  # folded to one literal


def _in(bitmap: Column, h: Column) -> Column:
    def has(i: Column) -> Column:
        return F.call_function("shiftright", F.get(bitmap, F.shiftright(i, 6).cast("int")), i.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    a, b = _places(h)
    return has(a) & has(b)


def _items(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    items = (
        benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
        .filter(F.size("words") > 0)
        .withColumn("k", F.least(F.lit(width), F.size("words")))
    )
    return items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", F.size("words").alias("length"), "k", shingles_of(F.col("words"), F.col("k"), width).alias("grams")
    )


def _counted(items: DataFrame) -> DataFrame:
    """A row for each different shingle of an item: `weight`, of all its copies,
    and its longest `word`."""
    grams = items.select("item", "k", "length", F.explode("grams").alias("gram")).groupBy("item", "k", "length", "gram").agg(F.count(F.lit(1)).alias("n"))
    longest = F.array_max(F.transform(F.split("gram", " ", -1), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))
    return grams.withColumn("longest", longest).select(
        "item", "k", "length", "gram", "n", F.xxhash64("gram").alias("h"), F.char_length("gram").alias("chars"), (F.char_length("gram") * F.col("n")).alias("weight"),
        F.col("longest.w").alias("word"), F.col("longest.n").alias("word_chars"),
    )


def _anchors(counted: DataFrame, similarity: float) -> DataFrame:
    """Shingles that weigh more than `1 - similarity` of an item together, those
    with the longest words first."""
    order = Window.partitionBy("item").orderBy(F.desc("word_chars"), "gram")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = counted.withColumn("before", before).withColumn("total", F.sum("weight").over(Window.partitionBy("item")))
    return taken.filter(F.col("before") <= F.lit(1 - similarity + 1e-9) * F.col("total")).select("item", "k", "length", "h", F.xxhash64("word").alias("word"))


def _index(counted: DataFrame, within: int) -> DataFrame:
    """The multi-index of the items that repeat no shingle: `length, block, value,
    item, own`, a row for each block and value within so many bits of it."""
    prints = counted.select("item", "length", "chars", "n", *_levels(F.col("h"))).groupBy("item", "length").agg(*_votes(F.col("h"), _vote(F.col("chars")), _held()), F.sum(_vote(F.col("chars"))).alias("total"), F.max("n").alias("most"))
    prints = prints.filter("most = 1").select("item", "length", _majority(F.col("total")).alias("own")).withColumn("b", F.explode(_blocks(F.col("own"))))
    near = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda v: F.bit_count(v.bitwiseXOR(F.col("b.value"))) <= within)
    return prints.select("length", F.col("b.block").alias("block"), F.explode(near).alias("value"), "item", "own")


def _windows(spots: DataFrame, width: int, tasks: int) -> DataFrame:
    """`doc, length, start, print` of every window that holds a spot, from
    `doc, words, length, k, shingles (of a window), cells`; a cell is the number of a
    spot over that of a window's shingles. Some windows beside these may come, too."""
    m, last = F.col("shingles"), F.size("words") - F.col("k")
    around = F.transform("cells", lambda c: F.sequence(F.greatest((c - 1) * m + 1, F.lit(0)), F.least((c + 2) * m - 2, last)))

    def told(p: Column) -> Column:
        gram = _shingle(F.col("words"), p, F.col("k"), width)
        return F.struct(p.alias("p"), F.xxhash64(gram).alias("h"), _vote(F.char_length(gram)).alias("vote"))

    at = spots.repartition(tasks, "doc", "length").select("doc", "length", "shingles", F.explode(F.transform(F.array_sort(F.array_distinct(F.flatten(around))), told)).alias("x"))
    at = at.select("doc", "length", "shingles", "x.*").withColumn("last", F.lag("p").over(Window.partitionBy("doc", "length", "h").orderBy("p")))
    # From which start on a shingle is in a window and is the first of its copies
    # there; from where on it is in one; from where on it is in none.
    begins = F.greatest(F.col("p") - F.col("shingles") + 1, F.lit(0))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    steps = F.array(
        F.struct(F.greatest(begins, F.coalesce(F.col("last") + 1, F.lit(0))).alias("start"), F.col("vote").alias("vote"), zero.alias("n")),
        F.struct(begins.alias("start"), zero.alias("vote"), one.alias("n")),
        F.struct((F.col("p") + 1).alias("start"), (-F.col("vote")).alias("vote"), (-one).alias("n")),
    )
    changes = at.select("doc", "length", "shingles", *_levels(F.col("h")), F.explode(steps).alias("s")).groupBy("doc", "length", "shingles", F.col("s.start").alias("start")).agg(
        *_votes(F.col("h"), F.col("s.vote"), _held()), F.sum("s.vote").alias("total"), F.sum("s.n").alias("n")
    )
    upto = Window.partitionBy("doc", "length").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    sums = changes.select("doc", "length", "shingles", "start", *[F.sum(c).over(upto).alias(c) for c in (*[f"v{i}" for i in range(32)], "total", "n")])
    return sums.filter(F.col("n") == F.col("shingles")).select("doc", "length", "shingles", "start", _majority(F.col("total")).alias("print"))


def _similarity(own: Column, other: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles as multisets."""
    weight = lambda grams: F.aggregate(grams, F.lit(0), lambda a, g: a + F.char_length(g))
    plain = (F.size(F.array_distinct(own)) == F.size(own)) & (F.size(F.array_distinct(other)) == F.size(other))
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    shared = F.when(plain, weight(F.array_intersect(own, other))).otherwise(
        F.aggregate(F.array_intersect(own, other), F.lit(0), lambda a, g: a + F.char_length(g) * F.least(count(own, g), count(other, g)))
    )
    return shared / (weight(own) + weight(other) - shared)


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, width: int = 5, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", radius: int | None = None) -> DataFrame:
    """`doc_id, text_key, item_id, start, similarity`: for each document and item
    with a similar window the most similar one (the first of these); `start` in
    words, `text_key` a hash of the document's text."""
    radius = radius_for(similarity) if radius is None else radius
    items = checkpointed(_items(benchmark, item_col, item_text_col, width))
    n_items = items.count()
    few = parts_for(n_items, 256)  # items in a partition, as these tables are read several times
    counted = checkpointed(_counted(items).coalesce(few))
    anchors = checkpointed(_anchors(counted, similarity).coalesce(few))
    n_grams = counted.count()
    # A small benchmark goes to where the texts are: at most 2,048 items (296
    # entries of the index each at radius 23) and 2**17 shingles.
    small = F.broadcast if n_items <= 2048 and n_grams <= 1 << 17 else lambda df: df
    ks = sorted(r["k"] for r in anchors.select("k").distinct().collect())  # numbers up to `width`
    word_map, gram_map = _bitmap(anchors.select(F.col("word").alias("h"))), _bitmap(anchors.select("h"))

    def near(i: Column) -> Column:
        """Places and hashes of shingles with word i that may be anchors."""
        tried = [F.struct((i - o).alias("at"), F.when((i - o >= 0) & (i - o + k <= F.size("words")), F.xxhash64(_shingle(F.col("words"), i - o, F.lit(k), k))).alias("h")) for k in ks for o in range(k)]
        return F.filter(F.array(*tried), lambda t: t["h"].isNotNull() & F.coalesce(_in(gram_map, t["h"]), F.lit(False)))

    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    some = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.coalesce(_in(word_map, F.xxhash64(F.get("words", i))), F.lit(False)))
    spots = words.withColumn("spots", F.when(F.size("words") > 0, some).otherwise(F.array().cast("array<int>")))
    hits = F.array_distinct(F.flatten(F.transform("spots", near))) if ks else F.array().cast("array<struct<at:int,h:bigint>>")
    # No filter before the checkpoint: it would be pushed below, and there the
    # words would be made anew for each word.
    held = checkpointed(spots.withColumn("hits", hits).select("doc_id", "text_key", F.when(F.size("hits") > 0, F.struct(F.monotonically_increasing_id().alias("doc"), "words", "hits")).alias("x")))
    held = held.filter(F.col("x").isNotNull()).select("doc_id", "text_key", "x.*")
    met = held.select("doc", F.size("words").alias("n"), F.explode("hits").alias("x")).select("doc", "n", "x.at", "x.h")
    cells = checkpointed(
        met.join(small(anchors.select("k", "length", "h").distinct()), "h")
        .withColumn("shingles", F.least("length", "n") - F.col("k") + 1)
        .groupBy("doc", "length", "k", "shingles").agg(F.collect_set(F.floor(F.col("at") / F.col("shingles")).cast("int")).alias("cells"))
    )
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    # The hashing and the comparison are the work, so rows are dealt to many tasks whatever their bytes.
    windows = checkpointed(_windows(cells.join(held.select("doc", "words"), "doc"), width, max(parallel, parts_for(cells.count(), 512))))
    asked = windows.select("doc", "length", "start", "print", F.explode(_blocks(F.col("print"))).alias("b")).select("doc", "length", "start", "print", "b.block", "b.value")
    close = asked.join(small(_index(counted, radius // BLOCKS)), ["length", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("own"))) <= radius)
    # Items that repeat shingles: windows that hold an anchor of theirs, found by the
    # stretches of starts that these windows lie in.
    repeating = anchors.join(counted.groupBy("item").agg(F.max("n").alias("most")).filter("most > 1").select("item"), "item", "left_semi").select("item", "k", "length", "h")
    spans = met.join(small(repeating), "h").withColumn("shingles", F.least("length", "n") - F.col("k") + 1).withColumn("low", F.greatest(F.col("at") - F.col("shingles") + 1, F.lit(0)))
    stretch = lambda c: F.floor(F.col(c) / F.col("shingles"))
    spans = spans.select("doc", "length", "item", "low", "at", F.explode(F.sequence(stretch("low"), stretch("at"))).alias("stretch"))
    held_by = windows.withColumn("stretch", stretch("start")).join(spans, ["doc", "length", "stretch"]).filter((F.col("start") >= F.col("low")) & (F.col("start") <= F.col("at")))
    close = close.select("doc", "item", "start").unionByName(held_by.select("doc", "item", "start"))
    pairs = checkpointed(close.groupBy("doc", "item").agg(F.collect_set("start").alias("starts")))
    both = pairs.join(small(items), "item").join(held.select("doc", "doc_id", "text_key", F.col("words").alias("said")), "doc")
    both = both.repartition(max(parallel, parts_for(pairs.count(), 128)), "doc", "item")
    shingles = F.least(F.col("length"), F.size("said")) - F.col("k") + 1
    both = both.withColumn("shingles", shingles).withColumn("own", shingles_of(F.col("said"), F.col("k"), width))
    exact = F.transform(
        "starts",
        lambda s: F.struct(_similarity(F.transform(F.sequence(s, s + F.col("shingles") - 1), lambda p: F.get("own", p)), F.col("grams")).alias("similarity"), (-s).alias("back")),
    )
    best = checkpointed(both.select("doc_id", "text_key", "item_id", "shingles", F.size("own").alias("n"), F.array_max(exact).alias("best")))
    return best.filter(F.col("best.similarity") >= similarity - 1e-12).select("doc_id", "text_key", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, width: int = 5, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without contaminated ones."""
    found = find(docs, benchmark, similarity, width, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_col]) == found["_key"]), "left_anti")
