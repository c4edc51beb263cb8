"""How far the sources of a language differ in their use of terms.

A term is a longest run of bytes that are ASCII letters or above 0x7F, with A to Z
lower-cased. A language keeps the terms that at least `least_docs` of its documents
hold. Every (language, source) group, and every language as a whole, gives each
kept term, whether it holds it or not, the smoothed share

    p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))

where N is the sum of its counts of kept terms and V the number of these. Two
shares diverge by f(p, q) = floor((p - q)**2 / (p + q)), in whole numbers:

* part `pair`: a group against each other source of its language, f summed over all
  kept terms;
* part `term`: the `top` kept terms that a group holds and uses more than its
  language does, with their f.

How: a table of 256 entries finds the boundaries of terms over the concatenated
bytes of many texts; xxhash groups the slices, and every slice is compared with the
bytes of the first of its group. A task adds its slices up to counts of (language,
source, term), deals them into blocks by a hash of language and term, and hands each
block on as one compressed row. A block then holds all counts of its terms, so it
knows which are kept; what it keeps is written down once, and sums over blocks give
N and V. A language's part of a block is a sparse matrix of sources by terms (rows
one after another); divergences of a row from all later ones are sums over its own
entries (equal counts together) and, by reduceat, over the entries of the later rows,
so the work is sources times entries, not sources squared times terms.

Defined cases: null text, language or source are empty strings; a group without
terms takes part with counts of 0; without kept terms all pairs diverge by 0; a
language of one source has no pairs; ties of value go by the item's UTF-8 bytes;
repeated rows count apiece; an empty table gives no rows; texts of any length are
taken whole. Other columns, whatever their names, are not read. Totals must stay
below 9 * 10**15 occurrences a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from origo.llm import textkit
from origo.llm.common import checkpointed, parts_for, ship

SCALE_STEPS = 3  # 10**9 in steps of 1000, so that no product leaves 64 bits
SLICE_BYTES = 2 << 20
MOST_CELLS = 1 << 19  # that a task holds before it hands them on
MOST_GROUPS = 100_000  # (language, source) groups of some dozen bytes, that a broadcast may hold
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = "block long, lang string, terms long, sums array<struct<source: string, n: long>>, raw binary"
_FOUND = "lang string, source string, part string, item string, value long"


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and the begin and end of every term; no term
    reaches over a bound of two texts."""
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    return _LOWER[data], np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _counts(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> pa.Table:
    """`group, term, key, n, docs` of some texts of given groups: occurrences, and
    documents with one; `key` is the term's hash."""
    low, start, end = terms(data, bounds)
    raw = low.tobytes()
    keys = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), dtype=np.uint64, count=len(start))
    first, term = textkit.grouped(low, start, end, keys)
    text = np.searchsorted(bounds, start, side="right") - 1
    held, n = np.unique(term * len(group) + text, return_counts=True)
    width = int(group.max()) + 1
    cell = held // len(group) * width + group[held % len(group)]
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else order
    of = first[cell[head] // width]
    total = np.add.reduceat(n, head) if len(head) else n
    docs = np.diff(np.concatenate((head, [len(cell)])))
    return pa.table({"group": cell[head] % width, "term": textkit.strings(*textkit.gathered(low, start[of], end[of])), "key": keys[of], "n": total, "docs": docs})


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _summed(tables: list[pa.Table], by: list[str]) -> pa.Table:
    whole = pa.concat_tables(tables)
    found = whole.group_by(by, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.rename_columns([*by, "n", "docs"])


def _dealt(blocks: int):
    """Texts to rows (block, counts of its terms). An empty term with 0 stands for
    each group, so that groups without terms are known."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        held: list[pa.Table] = []
        by = ["group", "term", "key"]

        def flush(table: pa.Table) -> pa.RecordBatch:
            names = list(codes)
            seeds = np.array([xxhash.xxh64_intdigest(lang) for lang, _ in names], dtype=np.uint64)
            group = table.column("group").to_numpy()
            block = (textkit.mix(table.column("key").to_numpy() ^ seeds[group]) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block = block[order]
            langs, sources = (pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1))
            cells = pa.Table.from_arrays([langs, sources, table.column("term"), table.column("n"), table.column("docs")], schema=_CELLS).take(pa.array(order))
            cuts = [*np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))).tolist(), len(block)]
            raws = [_packed(cells.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(raws, pa.binary())], names=["block", "raw"])

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            group = np.array([codes.setdefault(x, len(codes)) for x in rows], dtype=np.int64)
            data, bounds = textkit.utf8(batch.column(2))
            for a, b in textkit.slices(bounds, SLICE_BYTES):
                held.append(_counts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], group[a:b]))
                if sum(map(len, held)) > MOST_CELLS:
                    held = [_summed(held, by)]
                    if len(held[0]) > MOST_CELLS // 2:
                        yield flush(held.pop())
        if codes:
            zero = np.zeros(len(codes), dtype=np.int64)
            held.append(pa.table({"group": np.arange(len(codes)), "term": [""] * len(codes), "key": np.array([xxhash.xxh64_intdigest(s) for _, s in codes], dtype=np.uint64), "n": zero, "docs": zero}))
            yield flush(_summed(held, by))

    return work


def _settled(least_docs: int):
    """All counts of a block to a row for each of its languages: how many terms it
    keeps, the sum of each source, and the kept counts."""

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[pa.Table] = []
        for batch in batches:
            cells += [_unpacked(raw) for raw in batch.column("raw").to_pylist()]
            if sum(map(len, cells)) > MOST_CELLS:
                cells = [_summed(cells, ["lang", "source", "term"])]
        whole = _summed(cells, ["lang", "source", "term"])
        docs = whole.group_by(["lang", "term"], use_threads=False).aggregate([("docs", "sum")])
        kept = docs.filter(pc.or_(pc.equal(docs.column("term"), ""), pc.greater_equal(docs.column("docs_sum"), least_docs))).select(["lang", "term"])
        whole = whole.join(kept, ["lang", "term"], join_type="inner", use_threads=False).select(["lang", "source", "term", "n"])
        for lang in pc.unique(whole.column("lang")).to_pylist():
            own = whole.filter(pc.equal(whole.column("lang"), lang)).select(["source", "term", "n"])
            sums = own.group_by("source", use_threads=False).aggregate([("n", "sum")])
            own = own.filter(pc.not_equal(own.column("term"), ""))
            entries = [{"source": s, "n": n} for s, n in zip(sums.column("source").to_pylist(), sums.column("n_sum").to_pylist())]
            kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
            columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([lang], pa.string()), pa.array([pc.count_distinct(own.column("term")).as_py()], pa.int64()), pa.array([entries], kind), pa.array([_packed(own)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "lang", "terms", "sums", "raw"])

    work.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return work


def kept_terms(docs: DataFrame, least_docs: int, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_bytes: int = 32 << 20) -> DataFrame:
    """`block, lang, terms, sums, raw`: the kept terms of each language in blocks,
    about one for each `block_bytes` of text, written to the shared folder."""
    ship(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    blocks = parts_for(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], block_bytes)
    dealt = rows.mapInArrow(_dealt(blocks), "block long, raw binary")
    return checkpointed(dealt.groupBy("block").applyInArrow(_settled(least_docs), _KEPT))


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exactly."""
    whole = np.asarray(total, dtype=np.int64) + 2 * kept
    if whole.size and int(whole.max()) >= (1 << 63) // 1000:
        raise OverflowError("too many occurrences for whole numbers of 64 bits")
    rest, quotient = np.asarray(count, dtype=np.int64) + 2, 0
    for _ in range(SCALE_STEPS):
        high, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + high
    return 1 + quotient


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Block:
    """Some kept terms of one language: a sparse matrix of sources by terms."""

    def __init__(self, names: list[str], totals: np.ndarray, kept: int, whole: int, source: np.ndarray, term: np.ndarray, n: np.ndarray, size: int):
        order = np.lexsort((term, source))
        self.names, self.size = names, size
        self.source, self.term, n = source[order], term[order], n[order]
        self.first = np.searchsorted(self.source, np.arange(len(names) + 1))
        if not kept:
            return
        self.zero = share(np.zeros(len(names)), totals, kept)
        self.share = share(n, totals[self.source], kept)
        sums = np.zeros(size, dtype=np.int64)
        np.add.at(sums, self.term, n)
        self.whole = share(sums, np.full(size, whole), kept)

    def pairs(self, row: int) -> np.ndarray:
        """Divergences, over these terms, of a row from all later ones."""
        later = np.zeros(len(self.names) - row - 1, dtype=np.int64)
        if not self.size or not len(later):
            return later
        own = np.full(self.size, self.zero[row])
        a, b = self.first[row], self.first[row + 1]
        own[self.term[a:b]] = self.share[a:b]
        # As if the later rows held no term; equal shares of the row together.
        values, times = np.unique(own, return_counts=True)
        for v, t in zip(values, times):
            later += t * divergence(v, self.zero[row + 1 :])
        # What their own entries change.
        at = slice(b, self.first[-1])
        mine = own[self.term[at]]
        change = divergence(mine, self.share[at]) - divergence(mine, self.zero[self.source[at]])
        begin = self.first[row + 1 : -1] - b
        some = np.flatnonzero(np.diff(np.append(begin, len(change))) > 0)
        if len(some):
            later[some] += np.add.reduceat(change, begin[some])
        return later

    def above(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, term and value of each source's `top` terms above the language."""
        q = self.whole[self.term]
        at = np.flatnonzero(self.share > q)
        value = divergence(self.share[at], q[at])
        order = np.lexsort((self.term[at], -value, self.source[at]))
        at, value = at[order], value[order]
        source = self.source[at]
        turn = np.arange(len(at)) - np.searchsorted(source, source, side="left")
        return source[turn < top], self.term[at][turn < top], value[turn < top]


def _diverging(top: int):
    """Rows of `kept_terms` with their language's groups to parts of pairs and terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, totals = [x["source"] for x in row["groups"]], np.array([x["n"] for x in row["groups"]], dtype=np.int64)
                cells = _unpacked(row["raw"])
                coded = cells.column("term").combine_chunks().dictionary_encode()
                words = coded.dictionary.cast(pa.binary()).to_pylist()
                order = sorted(range(len(words)), key=words.__getitem__)
                place = np.empty(len(words), dtype=np.int64)
                place[order] = np.arange(len(words))
                term = place[coded.indices.to_numpy()]
                source = pc.index_in(cells.column("source").combine_chunks(), pa.array(names, pa.string())).to_numpy().astype(np.int64)
                block = _Block(names, totals, row["kept"], int(totals.sum()), source, term, cells.column("n").to_numpy(), len(words))

                def out(part: str, source: list, item: list, value: np.ndarray, lang: str = row["lang"]) -> pa.RecordBatch:
                    one = lambda x: pa.array([x] * len(value), pa.string())
                    return pa.RecordBatch.from_arrays([one(lang), pa.array(source, pa.string()), one(part), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

                for k, name in enumerate(names):
                    value, others = block.pairs(k), names[k + 1 :]
                    yield out("pair", [name] * len(others) + others, others + [name] * len(others), np.concatenate((value, value)))
                if words:
                    source, term, value = block.above(top)
                    yield out("term", [names[s] for s in source], [words[order[t]].decode() for t in term], value)

    return work


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """`lang, source, part, item, value, rank`, as described above; ranks from 1 for
    each group and part."""
    blocks = kept_terms(docs, least_docs, text_col=text_col, lang_col=lang_col, source_col=source_col, block_bytes=block_bytes)
    groups = blocks.select("lang", F.explode("sums").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    # A language's groups are a list: each of its blocks is compared with all of them.
    # Without kept terms one block stands for all.
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    langs = langs.join(blocks.groupBy("lang").agg(F.sum("terms").alias("kept"), F.min("block").alias("least")), "lang").withColumnRenamed("lang", "_lang")
    langs = F.broadcast(langs) if groups.count() <= MOST_GROUPS else langs
    told = blocks.join(langs, F.col("lang") == F.col("_lang")).filter("terms > 0 or (kept = 0 and block = least)")
    found = told.select("lang", "raw", "kept", "groups").mapInArrow(_diverging(top), _FOUND)
    sums = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
