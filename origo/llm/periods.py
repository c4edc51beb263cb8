"""Runs: stretches of words that repeat periodically, by suffix trees.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of `copies` * q words and `least` words at least, that no neighbouring
word extends keeping the period.

Every text is worked on by itself, in slices of some megabytes of texts:

1. In a run, every word lies in a window of some few words that occurs again in
   the same text. The tree is built over the stretches that such windows cover;
   no other words can belong to a run, and no run leaves its stretch.
2. The suffix tree is held as its leaves in order (a suffix array by doubled
   prefixes) and its inner nodes as intervals of leaves. Ranks of every doubling
   stay, so the common length of any two suffixes or prefixes is exact.
3. At a node of depth d, each leaf i of all children but the largest is tested for
   the leaves i + d and i - d: if these lie below the node and the words d apart
   then differ, a branching tandem repeat of period d ends there. As the largest
   child is left out, a leaf is visited log n times at most.
4. Such a repeat is rotated to the left as long as words d apart agree. Repeats of
   one stretch with several periods are merged into one with the smallest: a run.

Word identity rests on bytes: words with equal hashes are compared.

Defined cases: a null or empty text has no words and no run; a null id is worked
on like any other, and repeated rows apiece; texts of any length are taken whole
(a text longer than a slice is a slice of its own, with some 200 bytes a word
that repeats); an empty table gives no rows; ties between runs go to the smallest
start, then the smallest period. Extra columns are kept; those named like a new
column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from origo.llm import textkit
from origo.llm.common import ship

_CHUNK = 1 << 20
_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_NEW = (("n_words", T.LongType()), ("n_runs", T.LongType()), ("runs", _RUNS), ("collapsed_text", T.StringType()))


def _levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and for each k the ranks of their first 2**k symbols.
    The last symbol, and one behind every text, must occur once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    begins = np.concatenate(([True], s[1:] != s[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    levels, length = [rank], 1
    while True:
        held = rank[order]
        alone = np.concatenate((held[1:] != held[:-1], [True])) & np.concatenate(([True], held[1:] != held[:-1]))
        at = np.flatnonzero(~alone)
        if not len(at):
            return order, levels
        who = order[at]
        old, then = rank[who], rank[who + length]
        turn = np.lexsort((then, old))
        who, old, then = who[turn], old[turn], then[turn]
        order[at] = who
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = new_old | np.concatenate(([True], then[1:] != then[:-1]))
        place = np.arange(len(who))
        rank = rank.copy()
        rank[who] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_old, place, 0))
        levels.append(rank)
        length *= 2


def _ahead(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree from x and y on."""
    x, y, begin = x.copy(), y.copy(), x
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][x] == levels[k][y]
        x[same] += 1 << k
        y[same] += 1 << k
    return x - begin


def _behind(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols agree just before x and y, where x < y."""
    x, y, begin = x.copy(), y.copy(), x
    for k in range(len(levels) - 1, -1, -1):
        far = np.flatnonzero(x >= 1 << k)
        same = far[levels[k][x[far] - (1 << k)] == levels[k][y[far] - (1 << k)]]
        x[same] -= 1 << k
        y[same] -= 1 << k
    return begin - x


def _nodes(common: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest ones on both sides where `common` is smaller.
    `common` begins and ends with -1."""
    minima, k = [common], 0
    longest = int(np.diff(np.flatnonzero(common <= 0)).max(initial=1))
    while 2 << k <= longest:
        m = minima[-1]
        minima.append(np.minimum(m[: len(m) - (1 << k)], m[1 << k :]))
        k += 1
    left, right, value = at.copy(), at + 1, common[at]
    for k in range(len(minima) - 1, -1, -1):
        m, size = minima[k], 1 << k
        can = np.flatnonzero(right < len(m))
        can = can[m[right[can]] >= value[can]]
        right[can] += size
        can = np.flatnonzero(left >= size)
        can = can[m[left[can] - size] >= value[can]]
        left[can] -= size
    return left - 1, right


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and period of the branching tandem repeats of a string of numbers,
    and the ranks of its prefixes."""
    order, levels = _levels(symbols)
    n = len(order)
    nothing = np.empty(0, dtype=np.int64)
    leaf_at = np.empty(n, dtype=np.int64)
    leaf_at[order] = np.arange(n)
    common = np.full(n + 1, -1, dtype=np.int64)
    common[1:n] = _ahead(levels, order[:-1], order[1:])
    at = np.flatnonzero(common > 0)
    if not len(at):
        return nothing, nothing, levels
    left, right = _nodes(common, at)
    # A node: leaves from `left` to before `right`; its children meet at its places.
    turn = np.lexsort((at, right, left))
    at, left, right = at[turn], left[turn], right[turn]
    new = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    head = np.flatnonzero(new)
    meets = np.diff(np.concatenate((head, [len(at)])))
    # Children of each node: one more than its places.
    first = head + np.arange(len(head))
    begin = np.empty(len(at) + len(head), dtype=np.int64)
    end = np.empty_like(begin)
    inner = np.ones(len(begin), dtype=bool)
    inner[first] = False
    begin[first], begin[inner] = left[head], at
    last = first + meets
    inner[:] = True
    inner[last] = False
    end[last], end[inner] = right[head], at
    node = np.repeat(np.arange(len(head)), meets + 1)
    size = end - begin
    most = np.maximum.reduceat(size, first)[node]
    largest = np.flatnonzero(size == most)
    largest = largest[np.concatenate(([True], node[largest][1:] != node[largest][:-1]))]
    small = np.ones(len(begin), dtype=bool)
    small[largest] = False
    begin, size, node = begin[small], size[small], node[small]
    depth, low, high = common[at[head]], left[head], right[head]

    starts, periods = [nothing], [nothing]
    total = np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(_CHUNK, total[-1] + _CHUNK, _CHUNK), side="left") + 1 if len(total) else nothing
    a = 0
    for b in np.minimum(cuts, len(size)):
        if a < b:
            count = size[a:b]
            before = np.cumsum(count) - count
            leaf = order[np.repeat(begin[a:b] - before, count) + np.arange(int(count.sum()))]
            of = np.repeat(node[a:b], count)
            d = depth[of]
            for start in (leaf, leaf - d):
                other = np.where(start == leaf, leaf + d, start)
                place = leaf_at[np.maximum(other, 0)]
                ok = np.flatnonzero((other >= 0) & (place >= low[of]) & (place < high[of]))
                ok = ok[symbols[start[ok] + d[ok]] != symbols[start[ok] + 2 * d[ok]]]
                starts.append(start[ok])
                periods.append(d[ok])
            a = b
    return np.concatenate(starts), np.concatenate(periods), levels


def _runs(symbols: np.ndarray, least: int, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of a string of numbers."""
    start, period, levels = branching_repeats(symbols)
    end = start + 2 * period
    start = start - _behind(levels, start, start + period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), dtype=bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(least, copies * period)
    return start[keep], end[keep], period[keep]


def _repeated(windows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which windows occur again in their text."""
    keys = textkit.mix(windows + np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first)) * np.uint64(textkit.BYTE_BASE))
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), dtype=bool)


def runs_of(words: textkit.Words, order: np.ndarray, least: int = 6, copies: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (numbers of words of all texts together) and period of all runs of
    some texts whose word i is `words`' word order[i]; sorted by start and period."""
    nothing = np.empty(0, dtype=np.int64)
    h = words.hashes()[order]
    width = min(max(least - q, (copies - 1) * q) for q in range(1, least + 1))
    windows, first = words.windows(width, h)
    hit = np.flatnonzero(_repeated(windows, first))
    if not len(hit):
        return nothing, nothing, nothing
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = hit - first[of[hit]] + words.first[of[hit]]
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    edge = np.concatenate(((np.diff(kept) > 1) | (np.diff(text[kept]) > 0), [True]))  # behind a stretch
    _, word = textkit.grouped(words.data, words.start[order[kept]], words.end[order[kept]], textkit.mix(h[kept] + text[kept].astype(np.uint64) * np.uint64(textkit.WORD_BASE)))
    # Stretches one after another, each with a symbol of its own behind it.
    place = np.arange(len(kept)) + np.concatenate(([0], np.cumsum(edge[:-1])))
    symbols = np.full(len(kept) + int(edge.sum()), -1, dtype=np.int64)
    symbols[place] = word
    symbols[symbols < 0] = len(kept) + np.arange(int(edge.sum()))
    start, end, period = _runs(symbols, least, copies)
    back = np.full(len(symbols), -1, dtype=np.int64)
    back[place] = kept
    start, end = back[start], back[end - 1] + 1
    turn = np.lexsort((period, start))
    return start[turn], end[turn], period[turn]


def planted(doc_ids: list, counts: np.ndarray) -> np.ndarray:
    """Word order of texts into some of which a period is planted: with h the CRC-32
    of the decimal id and g = h // 10, a text of n words with h % 10 = 0 goes on
    from word a = g % n with its words a to a + p over and over, where
    p = 1 + (n - a) // (3 + g % 8)."""
    first = np.concatenate(([0], np.cumsum(counts)))
    order = np.arange(first[-1])
    for k, (i, n) in enumerate(zip(doc_ids, counts.tolist())):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            order[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def _collapsed(words: textkit.Words, order: np.ndarray, kept: np.ndarray) -> pa.Array:
    """For each text its kept words, joined by one space."""
    at = np.flatnonzero(kept)
    first = np.searchsorted(at, words.first)
    begin, size = words.start[order[at]], (words.end - words.start)[order[at]]
    # A byte more behind each word but the last of a text is its space.
    room = size + 1
    ends = first[1:][np.diff(first) > 0] - 1
    room[ends] -= 1
    bounds = np.concatenate(([0], np.cumsum(room)))
    out = np.full(bounds[-1], 0x20, dtype=np.uint8)
    raw, inner = textkit.gathered(words.data, begin, begin + size)
    out[np.repeat(bounds[:-1] - inner[:-1], size) + np.arange(len(raw))] = raw
    return textkit.strings(out, bounds[first])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, copies: int = 4, plant: bool = False) -> DataFrame:
    """`docs` with `n_words`, `n_runs`, `runs` (start, length, period in words, by
    start, then period) and `collapsed_text` (the words that no run holds behind its
    first period, joined by one space). With `plant`, words are first rearranged as
    `planted` says, so that there is something to find."""
    if least < 2 or copies < 2:
        raise ValueError("a run is two copies of two words at least")
    ship(docs.sparkSession)
    docs = docs.drop(*[c for c, _ in _NEW])
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col) if plant else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in textkit.words_of(batch.column(text_at)):
                part = batch.slice(a, b - a)
                order = planted(part.column(id_at).to_pylist(), words.counts) if plant else np.arange(words.first[-1])
                start, end, period = runs_of(words, order, least, copies)
                drop = np.zeros(len(order) + 1, dtype=np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, end, -1)
                text = np.searchsorted(words.first, start, side="right") - 1
                n_runs = np.bincount(text, minlength=b - a)
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - words.first[text], end - start, period)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_runs))), pa.int32()), runs)
                new = [pa.array(words.counts, pa.int64()), pa.array(n_runs, pa.int64()), lists, _collapsed(words, order, np.cumsum(drop[:-1]) == 0)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(c for c, _ in _NEW)])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in _NEW)]))
