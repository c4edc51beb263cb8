"""N-gram Jaccard join by chosen paths.

Documents are sets of shingles of `width` words; two are linked if the Jaccard
similarity of their sets is `similarity` or more. Documents with the same set
are one class, whatever their number.

1. Each class has a MinHash sketch, whose places stand for tokens of its set.
   In each of some runs the classes are split recursively: a node of the tree
   chooses places by its own dice, 1 / similarity of them on average, and a class
   goes to the child that its value at the place names. So a pair of similar
   classes stays together with a chance that repeated runs raise to the recall
   wanted: the children that a pair of this similarity shares are a branching
   process, so the chance that a run of so many splits misses it is known
   (0.16 after one split, 0.36 after three, for a pair whose sketches agree in as
   many places as its similarity says). Runs share the places of the sketch, so the
   chance that all miss is taken as the mean over how many of these agree, and
   runs are repeated until it is `1 - recall` at most. Only classes that were split
   more often than the first runs allow for take part in those that are added: a
   pair is apart no later than the first of its two classes stops being split.
2. Nodes of at most `bucket` classes are compared by brute force on short
   sketches, with a margin far below the similarity. Larger nodes split again,
   but for those that are dense: that hold a share of `dense` of the node above
   them, which does so as well, so about that much is their mean similarity. One
   place is not enough: all texts with one very common line may have the same value
   there. A place that was chosen further up parts nothing and tells nothing of
   that. A dense node, and one that
   is large after `depth` splits, is taken as one group of candidates without
   comparing, which can only bring more pairs before the exact comparison.
3. Candidates make groups: the connected components of what was found, kept
   distributed. In each group all sets are compared exactly, from whole texts,
   large groups in pairs of blocks of `block` classes, or of up to BLOCKS times as
   many of short texts, so no task holds a group.
   Pairs are counted where they are found and never leave a task; what leaves it
   is a number of links for each class and links that span what is connected.

Defined cases: a null or blank text has an empty set, and no links; a text of
fewer than `width` words is one shingle of all its words; a null id compares as
larger than all others; repeated rows have a row each and are copies of one
another; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm import textkit
from origo.llm.common import checkpointed, parts_for, redealt, ship
from origo.llm.components import components

PLACES = 64
MOST_RUNS = 2000  # no recall below 1 - 1e-6 asks for more after 16 splits at 0.8
LAST_ID = (1 << 63) - 1
DENSE = 2  # so many places in a row tell that a node is dense
BLOCKS, SHINGLES, ROWS = 4, 1 << 18, 1024  # blocks are joined up to so many, if they hold so many shingles together; rows of a task of the exact comparison
_A = textkit.mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_B = textkit.mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _sets(words: textkit.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, and the bounds of each text's."""
    h, first = words.windows(width, words.hashes(), short=True)
    n = len(first) - 1
    if not len(h):
        return h, np.zeros(n + 1, dtype=np.int64)
    of = np.repeat(np.arange(n), np.diff(first))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):  # many short sorts take half as long as one of pairs
        h[a:b].sort()
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
    return h[new], np.searchsorted(of[new], np.arange(n + 1))


def _set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set that is not empty, as a signed number."""
    run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(textkit.mix(h + np.uint64(0x5851F42D4C957F2D)))))
    return textkit.mix(run[bounds[1:]] - run[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _sketched(width: int):
    """Documents to their class, its number of shingles, and its sketches: 32 bits a
    place, and 8 bits a place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in textkit.words_of(batch.column(2)):
                h, bounds = _sets(words, width)
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                sketch = np.zeros((b - a, PLACES), dtype="<u4")
                x = np.empty_like(h)
                for k in range(PLACES if len(some) else 0):
                    np.multiply(h, _A[k], out=x)
                    np.add(x, _B[k], out=x)
                    sketch[some, k] = np.minimum.reduceat(x, bounds[:-1][some]) >> np.uint64(32)
                brief = (sketch * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                at = np.arange(b - a + 1) * PLACES
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(_set_keys(h, bounds), mask=sizes == 0), pa.array(sizes, pa.int64()), textkit.binaries(sketch.ravel(), at), textkit.binaries(brief.ravel(), at)],
                    names=["doc_id", "text_key", "c", "size", "sketch", "brief"],
                )

    return work


def _split(nodes: DataFrame, similarity: float) -> DataFrame:
    """Children of nodes (path, c, sketch, n, near, used), with `up` for n: each node chooses one place, and a
    second one with the chance that makes 1 / similarity on average. `used` has a bit for each place of a path;
    one that is chosen again keeps all of a node together, whatever they are, so `up` is null then."""
    dice = F.pmod(F.xxhash64("path", F.lit("second")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    one, two = (F.pmod(F.xxhash64("path", F.lit("place"), F.lit(turn)), F.lit(PLACES)).cast("int") for turn in (0, 1))
    places = F.when((dice < F.lit(1 / similarity - 1)) & (one != two), F.array(one, two)).otherwise(F.array(one))
    each = nodes.select("path", "c", "sketch", "n", "near", "used", F.explode(places).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    path = F.xxhash64("path", "place", F.substring("sketch", F.col("place") * 4 + 1, F.lit(4)))
    return each.select(path.alias("path"), "c", F.when(F.col("used").bitwiseAND(bit) == 0, F.col("n")).alias("up"), "near", F.col("used").bitwiseOR(bit).alias("used"))


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(least: int):
    """Nodes of one path after another to links of classes whose short sketches
    agree in `least` places: links to the least class of what is connected."""

    def node(c: np.ndarray, brief: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(c, kind="stable")
        c, brief = c[order], brief[order]
        linked = np.zeros((len(c), len(c)), dtype=bool)
        step = max(1, (1 << 22) // (len(c) * PLACES))
        for i in range(0, len(c), step):
            linked[i : i + step] = (brief[i : i + step, None, :] == brief[None]).sum(axis=2, dtype=np.uint8) >= least
        label = _labels(linked)
        far = label != np.arange(len(c))
        return c[far], c[label[far]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in _with_end(batches):
            if batch is None:
                path, c, brief = held if held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, PLACES), np.uint8))
                upto = len(path)
            else:
                path, c = (batch.column(k).to_numpy() for k in (0, 1))
                brief = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, PLACES)
                if held:
                    path, c, brief = (np.concatenate(x) for x in zip(held, (path, c, brief)))
                upto = int(np.searchsorted(path, path[-1])) if len(path) else 0
                held = path[upto:], c[upto:], brief[upto:]
            edge = np.concatenate(([0], np.flatnonzero(np.diff(path[:upto])) + 1, [upto])) if upto else np.zeros(1, dtype=np.int64)
            sizes = np.diff(edge)
            two = edge[:-1][sizes == 2]
            hit = two[(brief[two] == brief[two + 1]).sum(axis=1) >= least]
            a, b = [np.maximum(c[hit], c[hit + 1])], [np.minimum(c[hit], c[hit + 1])]
            for i in np.flatnonzero(sizes > 2):
                x, y = node(c[edge[i] : edge[i + 1]], brief[edge[i] : edge[i + 1]])
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return work


def _with_end(batches: Iterator) -> Iterator:
    yield from (b for b in batches if b.num_rows)
    yield None


def missed(similarity: float, splits: int, agreement: float | None = None) -> float:
    """The chance that a pair shares no node after so many splits of one run:
    extinction of a branching process. `agreement` is the share of places in which
    the pair's sketches agree, the similarity itself if it isn't given."""
    agreement = similarity if agreement is None else agreement
    second, q = min(1.0, 1 / similarity - 1), 0.0
    for _ in range(splits):
        apart = 1 - agreement + agreement * q
        q = (1 - second) * apart + second * apart * apart
    return q


def lost(similarity: float, splits: int, runs: int) -> float:
    """The chance that all of some runs miss a pair just at the similarity. All runs
    choose among the same PLACES, so they are independent only given in how many of
    these a pair agrees; the chance is the mean over that number."""
    agreeing = [math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k) for k in range(PLACES + 1)]
    return sum(p * missed(similarity, splits, k / PLACES) ** runs for k, p in enumerate(agreeing))


def runs_needed(similarity: float, splits: int, recall: float, least: int = 1) -> int:
    """How many runs find a pair just at the similarity with a chance of `recall`."""
    runs = least
    while lost(similarity, splits, runs) > 1 - recall and runs < MOST_RUNS:
        runs += 1
    return runs


def candidate_links(classes: DataFrame, similarity: float, *, first: int, runs: int, bucket: int, depth: int, margin: float, dense: float) -> tuple[DataFrame, list[DataFrame]]:
    """Links a, b between classes that span every pair that may be similar and
    that a run from number `first` on has in one node; and for each split after the
    first one the classes `c` that it split."""
    least = int(np.floor(PLACES * (similarity - margin)))
    roots = F.explode(F.transform(F.sequence(F.lit(first), F.lit(first + runs - 1)), lambda r: F.xxhash64(r, F.lit("run")))).alias("path")
    start = [F.lit(None).cast("long").alias("n"), F.lit(0).alias("near"), F.lit(0).cast("long").alias("used")]
    nodes = _split(classes.select(roots, "c", "sketch", *start), similarity)
    near = F.when(F.col("up").isNull(), F.col("near")).when(F.col("n") >= dense * F.col("up"), F.col("near") + 1).otherwise(0)
    links, again = None, []
    for level in range(1, depth + 1):
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("head")).filter("n > 1")
        nodes = checkpointed(nodes.join(redealt(sizes, "path"), "path"))
        few = nodes.filter(F.col("n") <= bucket).select("path", "c").join(classes.select("c", "brief"), "c")
        found = few.select("path", "c", "brief").repartition("path").sortWithinPartitions("path").mapInArrow(_compared(least), "a long, b long")
        many = nodes.filter(F.col("n") > bucket)
        whole = near >= DENSE if level < depth else F.lit(True)
        found = found.unionByName(many.filter(whole).select(F.col("c").alias("a"), F.col("head").alias("b")))
        links = found if links is None else links.unionByName(found)
        many = many.filter(~whole).select("path", "c", "n", near.alias("near"), "used")
        if not many.count():  # isEmpty runs job after job where nothing is left
            break
        again.append(many.select("c"))
        nodes = _split(many.join(classes.select("c", "sketch"), "c"), similarity)
    return links, again


def _split_beyond(passes: list[list[DataFrame]], splits: int) -> DataFrame:
    """The classes that some runs split more than so many times, of what
    `candidate_links` says of each pass."""
    held = None
    for again in passes:
        if len(again) >= splits:
            held = again[splits - 1] if held is None else held.unionByName(again[splits - 1])
    return held.distinct()


def _intersections(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many keys each pair of the n sets shares."""
    keys, at = np.unique(h, return_inverse=True)
    shared = np.bincount(at, minlength=len(keys)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    at, of = number[at[keep]], of[keep]
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out, width = np.zeros((n, n), dtype=np.float32), int(at[-1]) + 1 if len(at) else 0
    step = max(1, min(width, max(256, (1 << 22) // max(n, 1))))
    for a in range(0, width, step):
        x, y = np.searchsorted(at, (a, a + step))
        hot = np.zeros((n, step), dtype=np.float32)
        hot[of[x:y], at[x:y] - a] = 1
        out += hot @ hot.T
    return out


def _blocks(n: Column, shingles: Column, block: int) -> Column:
    """How many blocks a group is cut into. Each class goes to all of them, so they
    are as few as the sizes of the sets allow."""
    joined = F.greatest(F.ceil(n / (BLOCKS * block)), F.ceil(shingles / SHINGLES))
    return F.least(F.ceil(n / block), joined).cast("int")


def _exact(width: int, similarity: float):
    """Groups, one after another, to numbers of links and spanning links."""

    def group(t: pa.Table) -> Iterator[tuple]:
        c_col, side, copies = (t.column(k).to_numpy() for k in ("c", "side", "copies"))
        hs, ofs, c, sides, counts, sizes = [], [], [], [], [], []
        seen = set()
        for chunk_at, chunk in enumerate(t.column("text").chunks):
            base = sum(len(x) for x in t.column("text").chunks[:chunk_at])
            for a, b, words in textkit.words_of(chunk):
                h, bounds = _sets(words, width)
                keys = _set_keys(h, bounds)
                for i in range(b - a):
                    j = base + a + i
                    own = (int(c_col[j]), int(side[j]))
                    # An id that several texts have brings in texts of other classes.
                    if keys[i] == c_col[j] and own not in seen:
                        seen.add(own)
                        hs.append(h[bounds[i] : bounds[i + 1]])
                        ofs.append(np.full(bounds[i + 1] - bounds[i], len(c)))
                        c.append(own[0])
                        sides.append(own[1])
                        counts.append(int(copies[j]))
                        sizes.append(int(bounds[i + 1] - bounds[i]))
        if len(c) < 2:
            return
        n = np.array(sizes, dtype=np.float64)
        common = _intersections(np.concatenate(hs), np.concatenate(ofs), len(c)).astype(np.float64)
        linked = common >= similarity * (n[:, None] + n[None] - common) - 1e-9
        np.fill_diagonal(linked, False)
        sides = np.array(sides)
        if (sides != 0).any():
            linked &= sides[:, None] != sides[None]  # two blocks: only pairs across
        weights = np.array(counts)
        c = np.array(c, dtype=np.int64)
        order = np.argsort(c, kind="stable")
        linked, c, weights = linked[order][:, order], c[order], weights[order]
        label = _labels(linked)
        some = linked.any(axis=1)
        yield from zip(c[some].tolist(), linked.sum(axis=1)[some].tolist(), (linked @ weights)[some].tolist(), c[label[some]].tolist())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["c", "links", "linked", "root"])

        for batch in _with_end(batches):
            rows: list[tuple] = []
            if batch is None:
                if held:
                    rows += group(pa.Table.from_batches(held))
            else:
                at = batch.column("part").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    if held and held[0].column("part")[0].as_py() != int(at[a]):
                        rows += group(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
            yield out(rows)

    return work


def join(docs: DataFrame, similarity: float = 0.8, width: int = 5, *, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.999, runs: int = 10, bucket: int = 1000, depth: int = 16, margin: float = 0.3, dense: float = 0.7, block: int = 128) -> DataFrame:
    """A row for each document: `doc_id`; `text_key`, a hash of its text;
    `group_key`, a name that all that links connect share and no others do, null
    without words; `class_id`, the least id of these, which other groups may have
    as well if ids are null or repeated; `copy_of`, the
    least id with the same set; `n_copies`, how many documents have this set;
    `n_links`, how many other documents are linked to it, copies among them;
    `n_linked_sets`, how many other sets are; `is_empty`, whether its set is."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = checkpointed(texts.mapInArrow(_sketched(width), "doc_id long, text_key long, c long, size long, sketch binary, brief binary"))
    classes = checkpointed(
        rows.filter(F.col("c").isNotNull()).groupBy("c")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("brief").alias("brief"))
        .select("c", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("text_key"), "copies", "size", "sketch", "brief")
    )
    # `runs` at once; then as many as the splits that were needed make necessary, of
    # the classes that were split that often.
    options = dict(bucket=bucket, depth=depth, margin=margin, dense=dense)
    links, again = candidate_links(classes, similarity, first=1, runs=runs, **options)
    passes, splits = [again], 1 + len(again)
    while (more := runs_needed(similarity, splits, recall, runs) - runs) > 0:
        enough = max(s for s in range(splits) if runs_needed(similarity, s, recall, runs) == runs)
        some = checkpointed(classes.join(_split_beyond(passes, enough), "c", "left_semi")) if enough else classes
        added, again = candidate_links(some, similarity, first=runs + 1, runs=more, **options)
        links, splits, runs = links.unionByName(added), max(splits, 1 + len(again)), runs + more
        passes.append(again)
    groups = components(links).withColumnRenamed("node", "c")
    told = checkpointed(groups.join(classes.select("c", "rep", "text_key", "copies", "size"), "c"))
    sizes = told.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    members = told.join(redealt(sizes, "component"), "component")
    # Groups of more than a block: a class meets every block, pairs of blocks
    # are parts of their own. side: 0 in one block, else 1 or 2.
    blocks = _blocks(F.col("n"), F.col("shingles"), block)
    mine = F.pmod(F.xxhash64("c", F.lit("block")), F.col("blocks")).cast("int")
    parts = checkpointed(
        members.withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"),
            F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
            "c", "rep", "text_key", "copies", (F.col("blocks") > 1).alias("split"),
        )
    )
    together = parts.join(texts.select(F.col("doc_id").alias("rep"), "text_key", "text"), ["rep", "text_key"]).select("part", "side", "c", "copies", "text")
    tasks = max(parts.sparkSession.sparkContext.defaultParallelism, parts_for(parts.count(), ROWS))  # a count, so that small groups don't share few tasks
    found = checkpointed(
        together.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_exact(width, similarity), "c long, links long, linked long, root long")
    )
    counted = found.groupBy("c").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    split = parts.filter("split").select("c").distinct()
    whole = found.join(split, "c", "left_anti").select("c", F.col("root").alias("component"))
    spanning = found.join(split, "c", "left_semi").select(F.col("c").alias("a"), F.col("root").alias("b"))
    connected = whole.unionByName(components(spanning).withColumnRenamed("node", "c"))
    named = classes.select("c", "rep", "copies").join(counted, "c", "left").join(connected, "c", "left").withColumn("component", F.coalesce("component", "c"))
    heads = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.join(redealt(heads, "component"), "component").select("c", "rep", "copies", "links", "linked", "component", "class_id")

    def known(least: Column) -> Column:
        return F.when(least != LAST_ID, least)

    return rows.select("doc_id", "text_key", "c").join(named, "c", "left").select(
        known(F.col("doc_id")).alias("doc_id"), "text_key", F.col("component").alias("group_key"), known(F.coalesce("class_id", "doc_id")).alias("class_id"),
        known(F.coalesce("rep", "doc_id")).alias("copy_of"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        (F.coalesce("linked", F.lit(0).cast("long")) + F.coalesce("copies", F.lit(1).cast("long")) - 1).alias("n_links"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_linked_sets"), F.col("c").isNull().alias("is_empty"),
    )


def dedup(docs: DataFrame, similarity: float = 0.8, width: int = 5, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each group that links connect: the one of the
    least id. Documents without words stay."""
    found = join(docs, similarity, width, id_col=id_col, text_col=text_col, **options)
    least = Window.partitionBy("group_key").orderBy(F.col("doc_id").asc_nulls_last(), "text_key")
    stays = found.filter(~F.col("is_empty")).withColumn("_n", F.row_number().over(least)).filter("_n = 1")
    stays = stays.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("_id"), F.col("text_key").alias("_key"))
    # Rows travel as one struct, so no name of theirs can meet one used here.
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text_col).alias("_key"), F.struct(*docs.columns).alias("_row"))
    blank = F.coalesce(F.regexp_replace(F.col("_row").getField(text_col), "[\\x20\\t-\\r]+", "") == "", F.lit(True))
    once = Window.partitionBy("_id", "_key").orderBy(F.lit(1))
    kept = keyed.filter(~blank).join(stays, ["_id", "_key"]).withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    whole = kept.select("_row").unionByName(keyed.filter(blank).select("_row"))
    return whole.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
