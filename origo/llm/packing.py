"""Best-fit packing by a grouping genetic algorithm on islands.

Every document is tokenised and ended with id 2; only documents of more than
`limit` ids are cut, into pieces of `limit` ids of which the first may be
shorter. Whole-length pieces are sequences of their own. All other pieces are
dealt to islands of bounded size by a hash, and each island evolves a small
population of packings:

* the first packing is plain best fit; a packing is a list of bins, and fewer bins
  are fitter, then fuller ones (the sum of squared fills);
* crossover injects whole well-filled bins of one parent into a copy of the
  other, removes the bins that hold duplicates of what was injected and some of
  the least filled ones, and packs the pieces displaced by this anew, each bin by
  the one or two pieces that fit best in what room is left;
* after some generations the best bins of each island migrate to the next one,
  as patterns of lengths: a bin is a multiset of lengths, and an island that has
  pieces of these lengths takes the bin over and evolves on;
* at the end islands meet: the least filled bins of `fan` islands make a new
  island, which evolves in the same way, until one is left. So what the islands
  cannot fill is some bins for the whole table and not for each of them.

An island whose bins are as few as the sum of its lengths allows stops at once.

Only lengths and ids take part, so a row is some bytes; texts are never
shuffled.

Defined cases: a null text is empty, and an empty text is the one id 2; a null
id is kept; repeated rows are packed apiece; an empty table gives no rows.
Extra columns are not carried.
"""

from __future__ import annotations

import base64
import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm.common import checkpointed, parts_for, ship

END_ID = 2
SPECIAL = "<|endoftext|>"
_ENCODERS: dict = {}


def _encoder(path: str):
    """Ids of a text: the same as the tokenizers library gives for the file at
    `path`, but by the faster library where that is sure to agree."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        exact, fast = Tokenizer.from_file(path), None
        if path.endswith("byte_bpe_50k.json"):
            import tiktoken

            from public_tokenizers import PATTERN

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if fast is not None and SPECIAL not in text and len(text) < 2_000_000:
                try:
                    return fast.encode_ordinary(text)
                except ValueError:  # its pattern matcher gives up on some texts
                    pass
            return exact.encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row, doc_id, piece, start, length, ids_crc32` of every piece of every
    document; `row` tells repeated documents apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            rows, ids = batch.column(0).to_pylist(), batch.column(1)
            doc_ids = ids.to_pylist()
            for row, doc, text in zip(rows, doc_ids, batch.column(2)):
                found = encode(text.as_py() or "")
                found.append(END_ID)
                raw, n = np.array(found, dtype="<u4").tobytes(), len(found)
                at, k = 0, 0
                to = n % limit or min(n, limit)
                while at < n:
                    for column, x in zip(out, (row, doc, k, at, to - at, zlib.crc32(raw[4 * at : 4 * to]))):
                        column.append(x)
                    at, to, k = to, to + limit, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], ids.type), pa.array(out[2], pa.int32())] + [pa.array(x, pa.int64()) for x in out[3:]],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins over items of given lengths, packed by best fit.

    `bins` holds lists of items, `fill` their lengths together; open bins are
    found by their free room.
    """

    def __init__(self, lengths: list[int], limit: int):
        self.lengths, self.limit = lengths, limit
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def copy_of(self, keep: list[int]) -> Packing:
        new = Packing(self.lengths, self.limit)
        new.bins = [self.bins[b] for b in keep]
        new.fill = [self.fill[b] for b in keep]
        return new

    def inject(self, items: list[int]) -> None:
        self.bins.append(items)
        self.fill.append(sum(self.lengths[i] for i in items))

    def best_fit(self, items: list[int]) -> Packing:
        """Put each item, longest first, where the least room is left."""
        rooms: list[list[int]] = [[] for _ in range(self.limit + 1)]
        for b, f in enumerate(self.fill):
            rooms[self.limit - f].append(b)
        free = [r for r in range(1, self.limit + 1) if rooms[r]]
        owned: set[int] = set()
        for i in sorted(items, key=self.lengths.__getitem__, reverse=True):
            n = self.lengths[i]
            at = bisect.bisect_left(free, n)
            if at == len(free):
                b, room = len(self.bins), self.limit
                self.bins.append([])
                self.fill.append(0)
                owned.add(b)
            else:
                room = free[at]
                b = rooms[room].pop()
                if not rooms[room]:
                    del free[at]
                if b not in owned:  # bins are shared between packings until changed
                    self.bins[b] = list(self.bins[b])
                    owned.add(b)
            self.bins[b].append(i)
            self.fill[b] += n
            left = room - n
            if left:
                if not rooms[left]:
                    bisect.insort(free, left)
                rooms[left].append(b)
        return self

    def best_fill(self, items: list[int], dice: random.Random) -> Packing:
        """Put each item into new bins that are filled as well as one item or two
        can fill what room is left; first, items that fill an open bin just go there."""
        of: dict[int, list[int]] = {}
        for i in items:
            of.setdefault(self.lengths[i], []).append(i)
        for b, f in enumerate(self.fill):
            if f < self.limit and of.get(self.limit - f):
                self.bins[b] = [*self.bins[b], of[self.limit - f].pop()]
                self.fill[b] = self.limit
        free = sorted(n for n, some in of.items() if some)

        def take(n: int) -> None:
            bin_.append(of[n].pop())
            if not of[n]:
                del free[bisect.bisect_left(free, n)]

        while free:
            bin_: list[int] = []
            room = self.limit - free[-1]
            take(free[-1])
            while free and free[0] <= room:
                if of.get(room):
                    take(room)
                    room = 0
                    break
                half = free[: bisect.bisect_right(free, room // 2)]
                pair = next((x for x in (half if dice.random() < 0.5 else reversed(half)) if len(of.get(room - x, ())) > (2 * x == room)), None)
                if pair is not None:
                    take(pair)
                    take(room - pair)
                    room = 0
                    break
                upto = bisect.bisect_right(free, room)
                n = free[upto - 1 if dice.random() < 0.6 else dice.randrange(upto)]
                take(n)
                room -= n
            self.bins.append(bin_)
            self.fill.append(self.limit - room)
        return self

    def fitness(self) -> tuple[int, int]:
        return -len(self.bins), sum(f * f for f in self.fill)


def _crossover(a: Packing, b: Packing, dice: random.Random) -> Packing:
    """A child of `a` with well-filled bins of `b`: those it injects displace bins
    of `a` that hold the same items, the least filled bins go as well, with some of
    the others, and what is displaced by all this is packed anew."""
    order = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    good = order[: max(1, len(order) // 2)]
    own = set(map(frozenset, a.bins))
    take = [k for k in dice.sample(good, min(len(good), 8)) if frozenset(b.bins[k]) not in own]
    taken = {i for k in take for i in b.bins[k]}
    poor = sorted(range(len(a.bins)), key=a.fill.__getitem__)[: dice.randrange(2, 12)]
    drop = set(poor) | set(dice.sample(range(len(a.bins)), min(len(a.bins), dice.randrange(1, 24))))
    drop |= {k for k, items in enumerate(a.bins) if not taken.isdisjoint(items)}
    displaced = [i for k in drop for i in a.bins[k] if i not in taken]
    child = a.copy_of([k for k in range(len(a.bins)) if k not in drop])
    for k in take:
        child.inject(b.bins[k])
    return child.best_fill(displaced, dice)


def _adopt(a: Packing, patterns: list[tuple[int, ...]]) -> Packing:
    """A child of `a` with bins of the given lengths, as far as it has items."""
    of: dict[int, list[int]] = {}
    for i, n in enumerate(a.lengths):
        of.setdefault(n, []).append(i)
    bins = []
    for pattern in patterns:
        got = []
        for n in pattern:
            if not of.get(n):
                break
            got.append(of[n].pop())
        if len(got) == len(pattern):
            bins.append(got)
        else:
            for i in got:
                of[a.lengths[i]].append(i)
    taken = {i for items in bins for i in items}
    drop = {k for k, items in enumerate(a.bins) if any(i in taken for i in items)}
    displaced = [i for k in drop for i in a.bins[k] if i not in taken]
    child = a.copy_of([k for k in range(len(a.bins)) if k not in drop])
    for items in bins:
        child.inject(items)
    return child.best_fit(displaced)


def evolve(lengths: list[int], limit: int, seed: int, generations: int, population: int = 4, elites: list[tuple[int, ...]] = (), start: list[list[int]] | None = None) -> Packing:
    """The best packing found. `elites`: patterns that migrated here; `start`:
    the bins this island had before."""
    dice = random.Random(seed)
    items = list(range(len(lengths)))
    first = Packing(lengths, limit)
    if start is None:
        first.best_fit(items)
    else:
        for one in start:
            first.inject(one)
    least = -(-sum(lengths) // limit)
    if len(first.bins) <= least:
        return first
    people = [first]
    while len(people) < population:
        # Others start from a random half of the bins, the rest packed anew.
        keep = [k for k in range(len(first.bins)) if dice.random() < 0.5]
        kept = {i for k in keep for i in first.bins[k]}
        people.append(first.copy_of(keep).best_fit([i for i in items if i not in kept]))
    if elites:
        people[-1] = _adopt(first, list(elites))
    for _ in range(generations):
        people.sort(key=Packing.fitness, reverse=True)
        if len(people[0].bins) <= least:
            break
        a, b = people[0], people[1 + dice.randrange(len(people) - 1)]
        if dice.random() < 0.5:
            a, b = b, a
        child = _crossover(a, b, dice)
        if child.fitness() > people[-1].fitness():
            people[-1] = child
    return max(people, key=Packing.fitness)


def _islands(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """`work` on each run of rows of one island; islands may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        island = batch.column("island").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(island)) + 1).tolist(), len(island)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0].column("island")[0].as_py() != int(island[a]):
                yield work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield work(pa.Table.from_batches(held))


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, *, id_col: str = "doc_id", text_col: str = "text", island_items: int = 8192, rounds: int = 2, generations: int = 100, elite_bins: int = 64, merge_bins: int = 32, fan: int = 32) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset` of every piece."""
    ship(docs.sparkSession)
    cut = checkpointed(pieces(docs, tokenizer, limit, id_col=id_col, text_col=text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    partial = F.col("length") < limit
    islands = parts_for(cut.filter(partial).count(), island_items)
    small = cut.filter(partial).select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(islands)).cast("int").alias("island"), "row", "doc_id", "piece", "start", "length", "ids_crc32"
    )
    fields = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    state = small.withColumn("bin", F.lit(-1).cast("long")).withColumn("elites", F.lit(None).cast("binary"))

    def turn(sends: bool, seed: int, islands: int):
        def work(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            news = [x for x in t.column("elites").to_pylist() if x is not None]
            own = t.filter(pa.compute.is_valid(t.column("length")))
            own = own.sort_by([("row", "ascending"), ("piece", "ascending")])
            island = t.column("island")[0].as_py()
            lengths = own.column("length").to_pylist()
            bins = own.column("bin").to_numpy()
            start = None
            if len(bins) and bins[0] >= 0:
                order = np.argsort(bins, kind="stable")
                start = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)]
            patterns = [tuple(map(int, p.split())) for x in news for p in x.decode().split(",") if p]
            steps = generations * min(20, max(1, island_items // max(1, len(lengths))))  # as much work for small islands
            best = evolve(lengths, limit, seed * 1_000_003 + island, steps, elites=patterns, start=start)
            number, offset, poor = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
            least = set(sorted((k for k, n in enumerate(best.fill) if n < limit), key=best.fill.__getitem__)[:merge_bins])
            for k, items in enumerate(best.bins):
                at = 0
                for i in items:
                    number[i], offset[i], poor[i] = k, at, k in least
                    at += lengths[i]
            own = own.to_batches()[0] if own.num_rows else own
            columns = [own.column(c) for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32")]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            elite: list = [None] * len(lengths)
            to = [island] * len(lengths)
            if sends and len(lengths):
                # The best bins go to the next island of the ring, in a row of their own.
                top = sorted(range(len(best.bins)), key=lambda k: (-best.fill[k], k))[:elite_bins]
                sent = ",".join(" ".join(str(lengths[i]) for i in best.bins[k]) for k in top).encode()
                columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns]
                number, offset, poor = np.append(number, -1), np.append(offset, 0), np.append(poor, 0)
                elite.append(sent)
                to.append((island + 1) % islands)
            return pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), *columns, pa.array(number), pa.array(offset), pa.array(poor.astype(bool)), pa.array(elite, pa.binary())],
                names=["island", *names, "bin", "offset", "poor", "elites"],
            )

        return lambda batches: _islands(batches, work)

    def evolved(state: DataFrame, sends: bool, seed: int, islands: int) -> DataFrame:
        dealt = state.select("island", "row", "doc_id", "piece", "start", "length", "ids_crc32", "bin", "elites").repartition("island").sortWithinPartitions("island")
        return checkpointed(dealt.mapInArrow(turn(sends, seed, islands), f"island int, {fields}, bin long, offset long, poor boolean, elites binary"))

    for k in range(rounds):
        state = evolved(state, k < rounds - 1, k + 1, islands)
    # An island's bins have numbers that tell the level and the island, whole
    # pieces have numbers below zero; neither needs a sort over all rows.
    packed, level = None, 0
    while True:
        done = state if islands == 1 else state.filter(~F.col("poor"))
        number = F.lit(level << 58) + F.col("island").cast("long") * F.lit(1 << 32) + F.col("bin")
        done = done.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")
        packed = done if packed is None else packed.unionByName(done)
        if islands == 1:
            break
        state = state.filter("poor").withColumn("bin", F.pmod("island", F.lit(fan)) * F.lit(1 << 32) + F.col("bin")).withColumn("island", F.floor(F.col("island") / fan).cast("int"))
        islands, level = parts_for(islands, fan), level + 1
        state = evolved(state, False, rounds + level, islands)
    whole = cut.filter(~partial).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)
