"""Substring deduplication by Rabin-Karp hashes of every window of words.

A window is `width` consecutive words of one document. A word is removed if a
window covers it whose words also start in a document with a smaller id.

1. Every task hashes all windows of its documents. Of equal windows in its
   reach it keeps those of the smallest document once; that the others are
   repeats is settled there and then. So a passage that a third of all
   documents share leaves a task once, not once for each document.
2. The hashes kept are dealt by hash range, packed, and each range is counted:
   hashes that another document with a smaller id has as well are repeats.
3. Repeats go back by groups of documents, meet the (compressed) texts, and
   repeated windows merge into maximal removal intervals.

Hashes have 64 bits, so among w windows about w**2 / 2**65 are taken for
repeats wrongly (under one in ten billion windows at 30 GB of text).

Defined cases: a null text has no words, and a document of under `width` words
keeps them all; rows with the same id are one document for the comparison and
keep a row each; a null id compares as larger than all others and equal to
itself; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from origo.llm import textkit
from origo.llm.common import parts_for, ship

LAST_ID = np.iinfo(np.int64).max
_CODEC = "zstd"


def _pack(ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """Hashes of documents, both in the order of ids, as bytes."""
    cut = np.flatnonzero(np.diff(ids)) + 1
    first = np.concatenate(([0], cut)) if len(ids) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.concatenate((first, [len(ids)]))).astype("<u4")
    return b"".join((np.uint32(len(first)).tobytes(), ids[first].astype("<i8").tobytes(), counts.tobytes(), hashes.astype("<u8").tobytes()))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ids = np.frombuffer(raw, "<i8", n, 4)
    counts = np.frombuffer(raw, "<u4", n, 4 + 8 * n)
    return np.repeat(ids, counts), np.frombuffer(raw, "<u8", -1, 4 + 12 * n)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _group(ids: np.ndarray, groups: int, spread: int = 1, rows: np.ndarray | None = None) -> np.ndarray:
    """The group of each document by its id. Null ids are one document, however
    many rows they have: these rows are dealt to `spread` groups of their own."""
    at = (textkit.mix(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    lost = ids == LAST_ID
    if lost.any():
        at[lost] = groups + (np.zeros(lost.sum(), dtype=np.int64) if rows is None else rows[lost] % spread)
    return at


class _Found:
    """Repeats, gathered and handed on as rows (1, group of documents, packed)."""

    def __init__(self, groups: int, spread: int, most: int = 1 << 20):
        self.groups, self.spread, self.most, self.n = groups, spread, most, 0
        self.ids: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []

    def add(self, ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        if len(ids):
            self.ids.append(ids)
            self.hashes.append(hashes)
            self.n += len(ids)
        if self.n >= self.most:
            yield from self.rows()

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        if self.n:
            ids, hashes = np.concatenate(self.ids), np.concatenate(self.hashes)
            self.ids, self.hashes, self.n = [], [], 0
            group = _group(ids, self.groups)
            order = np.lexsort((ids, group))
            ids, hashes, group = ids[order], hashes[order], group[order]
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                for k in range(self.spread if group[a] >= self.groups else 1):  # all groups of null ids need theirs
                    yield 1, int(group[a]) + k, _pack(ids[a:b], hashes[a:b])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, at, raw = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(at, pa.int64()), pa.array(raw, pa.binary())], names=["kind", "at", "raw"])


def _hashed(width: int, buckets: int, groups: int, spread: int, most: int = 1 << 20):
    """Documents to rows (0, bucket, packed hashes) and (1, group, packed repeats)."""

    def flush(ids: list, hashes: list, found: _Found) -> Iterator[pa.RecordBatch]:
        doc, h = np.concatenate(ids), np.concatenate(hashes)
        ids.clear()
        hashes.clear()
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        out = list(found.add(doc[doc > least], h[doc > least]))
        doc, h = doc[new], h[new]  # by hash, so each bucket is a slice
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            order = np.argsort(doc[a:b], kind="stable")
            out.append((0, int(k), _pack(doc[a:b][order], h[a:b][order])))
        yield _rows(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids, hashes, held = _Found(groups, spread), [], [], 0
        for batch in batches:
            doc = _ids(batch.column(0))
            for a, b, words in textkit.words_of(batch.column(1)):
                h, first = words.windows(width, words.hashes())
                if len(h):
                    ids.append(np.repeat(doc[a:b], np.diff(first)))
                    hashes.append(h)
                    held += len(h)
                if held >= most:
                    held = 0
                    yield from flush(ids, hashes, found)
        if held:
            yield from flush(ids, hashes, found)
        yield _rows(list(found.rows()))

    return work


def _counted(groups: int, spread: int):
    """Rows sorted by kind and bucket to repeats (1, group, packed)."""

    def settle(raws: list[bytes], found: _Found) -> Iterator[tuple[int, int, bytes]]:
        both = [_unpack(x) for x in raws]
        doc, h = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
        order = np.argsort(h, kind="stable")
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.concatenate((first, [len(h)]))))
        yield from found.add(doc[doc > least], h[doc > least])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, at = _Found(groups, spread), [], None
        for batch in batches:
            out = []
            for kind, bucket, raw in zip(*(batch.column(k).to_pylist() for k in ("kind", "at", "raw"))):
                if kind:
                    out.append((1, bucket, raw))
                    continue
                if bucket != at and held:
                    out += settle(held, found)
                    held = []
                at = bucket
                held.append(raw)
            yield _rows(out)
        yield _rows([*(settle(held, found) if held else ()), *found.rows()])

    return work


def _texts(groups: int, spread: int):
    """Documents to rows (group, compressed ids and texts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            group = _group(_ids(batch.column(0)), groups, spread, turn + np.arange(batch.num_rows))
            turn += batch.num_rows
            order = np.argsort(group, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(order)]
            at, raw = [], []
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    part = batch.take(pa.array(order[a:b]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
                        out.write_batch(part)
                    at.append(int(group[order[a]]))
                    raw.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw, pa.binary())], names=["at", "raw"])

    return work


def _intervals(hit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of words that the windows starting at `hit` cover."""
    if not len(hit):
        return hit, hit
    gap = np.flatnonzero(np.diff(hit) > width)
    return hit[np.concatenate(([0], gap + 1))], hit[np.concatenate((gap, [len(hit) - 1]))] + width


def _removed(width: int, id_type: pa.DataType):
    """Of one group: its repeats and its texts to what is kept."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = [_unpack(x) for x in left.column("raw").to_pylist()]
        doc = np.concatenate([x[0] for x in pairs]) if pairs else np.empty(0, dtype=np.int64)
        h = np.concatenate([x[1] for x in pairs]) if pairs else np.empty(0, dtype=np.uint64)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "removed": [], "kept_text": []}
        for raw in right.column("raw").to_pylist():
            for batch in pa.ipc.open_stream(raw):
                ids = _ids(batch.column(0))
                out["doc_id"] += batch.column(0).to_pylist()
                for a, b, words in textkit.words_of(batch.column(1)):
                    hashes, first = words.windows(width, words.hashes())
                    for i in range(a, b):
                        k, n = words.first[i - a], int(words.counts[i - a])
                        x, y = np.searchsorted(doc, [ids[i], ids[i]], side="left")[0], np.searchsorted(doc, ids[i], side="right")
                        starts, ends = _intervals(np.flatnonzero(np.isin(hashes[first[i - a] : first[i - a + 1]], h[x:y])) if x < y else np.empty(0, dtype=np.int64), width)
                        text, base = words.text_of(i - a), words.bounds[i - a]
                        kept, at = [], 0
                        for s, e in [*zip(starts.tolist(), ends.tolist()), (n, n)]:
                            if at < s:
                                kept += text[words.start[k + at] - base : words.end[k + s - 1] - base].split()
                            at = e
                        out["n_words"].append(n)
                        out["n_removed"].append(int((ends - starts).sum()))
                        out["removed"].append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
                        out["kept_text"].append(b" ".join(kept).decode())
        interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"doc_id": id_type, "n_words": pa.int64(), "n_removed": pa.int64(), "removed": interval, "kept_text": pa.string()}
        return pa.table({c: pa.array(out[c], kinds[c]) for c in kinds})

    return work


def dedup(docs: DataFrame, width: int = 50, *, id_col: str = "doc_id", text_col: str = "text", bucket_windows: int = 1 << 20, group_bytes: int = 16 << 20) -> DataFrame:
    """`doc_id, n_words, n_removed, removed (array of [start, end) in words),
    kept_text (the kept words, joined by one space)` of every document."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size, lost = texts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (F.octet_length("text"), F.when(F.col("doc_id").isNull(), F.octet_length("text")))]).first()
    buckets, groups, spread = parts_for(size // 6, bucket_windows), parts_for(size, group_bytes), parts_for(lost, group_bytes)
    schema = "kind byte, at long, raw binary"
    repeats = (
        texts.mapInArrow(_hashed(width, buckets, groups, spread), schema)
        .repartition(buckets + groups + spread, "kind", "at")
        .sortWithinPartitions("kind", "at")
        .mapInArrow(_counted(groups, spread), schema)
        .select("at", "raw")
    )
    packed = texts.mapInArrow(_texts(groups, spread), "at long, raw binary")
    return repeats.groupBy("at").cogroup(packed.groupBy("at")).applyInArrow(
        _removed(width, pa.int64()), "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"
    )
