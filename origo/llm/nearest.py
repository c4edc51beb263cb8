"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Vectors are normalised and cut into subspaces of a few dimensions; each
subspace has 16 codewords, so a code is four bits. Codewords and codes minimise
an anisotropic loss: the part of the residual that is parallel to the vector
weighs `eta` times as much as the orthogonal part, because it is what changes
large inner products. What a level of codes leaves is coded again by the next
one, for the same loss; each level leaves about a third of the one before.

1. Only codes and the lengths of their residuals meet the queries, in blocks. A
   search adds up one small table for each subspace (pairs of four-bit codes are
   read as one byte). A sum misses its cosine by the length of the residual at
   most, so sums of all levels for the entries of the `rerank` best first sums
   give a k-th best cosine that is reached for sure; an entry whose sum and
   residual together don't reach it is none of the k nearest, and goes before
   its next level is looked at. What is left leaves the block as ids.
2. The k-th lower bound over all blocks cuts these again; the few that stay
   fetch their vectors, and exact cosines in double precision decide.
3. Where more than `crowd` entries of a block stay for a query, as in a group of
   near copies, codes tell nothing apart: that query meets the vectors of that
   block, all of them, and k of them leave.

So the result is exact, and vectors move only for what codes leave open.

The codebooks are fitted on a bounded sample; every row is indexed. Of
equal vectors the rows of their `k + 1` smallest different ids are indexed, `k`
rows of an id at most: whatever id asks, these hold the k smallest other ones,
and ties go to smaller ids.

Defined cases: vectors that are null, zero, of another dimension than most, or
hold null or non-finite components take no part, neither do rows of a null id;
with fewer than k candidates a query returns them all; a repeated id asks once,
by its least vector, its rows are candidates of other ids only, each for itself;
an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm.common import checkpointed, parts_for, released, ship
from origo.llm.textkit import binaries

CODEWORDS = 16


@dataclass(frozen=True)
class Codebook:
    """`words`: subspaces x 16 x width; `eta`: the weight of parallel error."""

    words: np.ndarray
    eta: float

    @property
    def width(self) -> int:
        return self.words.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows of subspaces, the last one padded with zeros."""
        m, _, w = self.words.shape
        out = np.zeros((len(x), m * w))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def encode(self, rest: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of what is left of unit vectors x: coordinate descent on the
        anisotropic loss |r|^2 + (eta - 1) <r, x>^2 of the residual r."""
        some = [self._encode(rest[a : a + 1024], unit[a : a + 1024], sweeps) for a in range(0, len(unit), 1024)]
        return np.concatenate(some) if some else np.empty((0, len(self.words)), dtype=np.uint8)

    def _encode(self, rest: np.ndarray, unit: np.ndarray, sweeps: int) -> np.ndarray:
        # Subspaces first, so that each step below reads one block of memory.
        x, t = (self.split(v).transpose(1, 0, 2) for v in (unit, rest))
        by_width = self.words.transpose(0, 2, 1)
        square = (self.words**2).sum(axis=2)[:, None, :] - 2 * (t @ by_width)  # but for |t|^2, the same for all codewords
        along = (t * x).sum(axis=2)[:, :, None] - x @ by_width
        codes = square.argmin(axis=2)
        rows = np.arange(len(rest))
        mine = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0]
        parallel = mine.sum(axis=0)
        for _ in range(sweeps):
            for j in range(len(self.words)):
                others = parallel - mine[j]
                loss = square[j] + (self.eta - 1) * (others[:, None] + along[j]) ** 2
                codes[j] = loss.argmin(axis=1)
                mine[j] = along[j][rows, codes[j]]
                parallel = others + mine[j]
        codes = codes.T
        return codes.astype(np.uint8)

    def left(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes leave."""
        return rest - self.words[np.arange(len(self.words))[None], codes].reshape(len(rest), -1)[:, : rest.shape[1]]

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """For each query and pair of subspaces the inner products of all 256
        pairs of codewords."""
        dots = np.einsum("qmw,mcw->qmc", self.split(unit), self.words)
        if dots.shape[1] % 2:
            dots = np.concatenate([dots, np.zeros((len(dots), 1, CODEWORDS))], axis=1)
        low, high = dots[:, 0::2], dots[:, 1::2]
        return (low[:, :, None, :] + high[:, :, :, None]).reshape(len(dots), -1, 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.uint8)], axis=1)
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def fit(rest: np.ndarray, unit: np.ndarray, width: int = 2, eta: float = 2.6, rounds: int = 8, seed: int = 3) -> Codebook:
    """Codebooks for what is left of unit vectors, by alternating codes and
    codewords, both for the anisotropic loss; the step for codewords solves
    weighted least squares by subspace."""
    dice = np.random.default_rng(seed)
    m = -(-unit.shape[1] // width)
    words = np.zeros((m, CODEWORDS, width))
    book = Codebook(words, eta)
    x, y = book.split(unit), book.split(rest)
    words[:] = np.stack([y[dice.choice(len(y), CODEWORDS), j] for j in range(m)])
    for _ in range(rounds):
        codes = book.encode(rest, unit, 1)
        residual = y - words[np.arange(m)[None], codes]
        parallel = (residual * x).sum(axis=(1, 2))
        for j in range(m):
            others = parallel - (residual[:, j] * x[:, j]).sum(axis=1)
            for c in range(CODEWORDS):
                mine = codes[:, j] == c
                if mine.any():
                    v, t = x[mine, j], y[mine, j]
                    a = mine.sum() * np.eye(width) + (eta - 1) * v.T @ v
                    b = t.sum(axis=0) + (eta - 1) * ((others[mine] + (v * t).sum(axis=1))[:, None] * v).sum(axis=0)
                    words[j, c] = np.linalg.solve(a, b)
            residual[:, j] = y[:, j] - words[j, codes[:, j]]
            parallel = others + (residual[:, j] * x[:, j]).sum(axis=1)
    return book


def fit_levels(unit: np.ndarray, levels: int = 3, width: int = 2, eta: float = 2.6, rounds: int = 8) -> list[Codebook]:
    """A codebook for each level, fitted on what the levels before it leave."""
    books, rest = [], unit
    for level in range(levels):
        books.append(fit(rest, unit, width, eta, rounds, seed=3 + level))
        rest = books[-1].left(rest, books[-1].encode(rest, unit))
    return books


def encoded(books: list[Codebook], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of all levels side by side, and after each level the length of
    the residual, in single precision and never below it."""
    codes, errors, rest = [], [], unit
    for book in books:
        plain = book.encode(rest, unit)
        rest = book.left(rest, plain)
        codes.append(packed(plain))
        errors.append(np.sqrt((rest * rest).sum(axis=1)))
    error = np.stack(errors, axis=1)
    return np.concatenate(codes, axis=1), np.nextafter(error.astype(np.float32), np.float32(np.inf))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow for any finite row but zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _edge(bounds: np.ndarray, k: int) -> float:
    """The k-th largest, if there are so many."""
    return float(np.partition(bounds, len(bounds) - k)[len(bounds) - k]) if len(bounds) >= k else -np.inf


def _scan(tables: list[np.ndarray], codes: np.ndarray, errors: np.ndarray, other: np.ndarray, k: int, rerank: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries that are `other` the places of those that may be among the
    k nearest, with the least and the greatest cosine they can have. `codes`:
    a row for each byte of all levels, `errors`: a row for each level."""

    def sums(level: int, at: np.ndarray | slice) -> np.ndarray:
        lut = tables[level]
        mine = codes[level * len(lut) : (level + 1) * len(lut)]
        total = lut[0][mine[0][at]]
        for table, c in zip(lut[1:], mine[1:]):
            total = total + table[c[at]]
        return total

    levels = len(tables)
    total, near = sums(0, slice(None)), other.nonzero()[0]
    edge = -np.inf
    if len(total) > rerank:
        first = np.argpartition(-total, rerank - 1)[:rerank]
        first = first[other[first]]
        edge = _edge(total[first] + sum(sums(level, first) for level in range(1, levels)) - errors[-1][first], k)
    total = total[near]
    for level in range(levels):
        if level:
            total = total + sums(level, near)
        error = errors[level][near]
        edge = max(edge, _edge(total - error, k))
        stays = total + error >= edge - slack
        near, total = near[stays], total[stays]
    error = errors[-1][near]
    return near, total - error, total + error


def _cosines(unit: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors have equal cosines wherever they are."""
    return (unit * asked).sum(axis=1)


def _nearest(unit: np.ndarray, ids: np.ndarray, asked: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the k nearest of a block, ties to smaller ids."""
    near = other.nonzero()[0]
    cos = (unit @ asked)[near]
    near = near[cos >= _edge(cos, k) - 1e-12]
    cos = _cosines(unit[near], asked)
    top = np.lexsort((ids[near], -cos))[:k]
    return ids[near][top], cos[top]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (top["n"] if top else 0))


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


@dataclass(frozen=True)
class Index:
    """`entries`: vec_id, print, block, v; `asked`: query_id, q, v; `left`: for
    each query what the codes leave open, see `index`."""

    entries: DataFrame
    asked: DataFrame
    left: DataFrame


def index(vectors: DataFrame, k: int = 5, *, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 4096, levels: int = 3, width: int = 2, eta: float = 2.6, rerank: int = 384, crowd: int = 128, query_block: int = 1024, code_block: int = 32768) -> Index | None:
    """Codes of all rows, scanned for all queries; None if no vector is usable.
    `left` has `query_id, q, block, crowded, vec_id, print, low, high`: an entry
    that may be among the k nearest and the bounds of its cosine, or, if more
    than `crowd` of a block may, the k greatest lower bounds of that block."""
    spark = vectors.sparkSession
    ship(spark)
    rows = checkpointed(_usable(vectors, id_col, vector_col))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not drawn:
        return None
    books = fit_levels(_unit(np.array([r["v"] for r in drawn])), levels, width, eta)
    n = rows.count()
    # Several blocks, so several tasks, of a small table too; 32 MB of vectors in one.
    n_blocks = max(parts_for(n, code_block), parts_for(8 * n * len(drawn[0]["v"]), 1 << 25), min(16, parts_for(n, 1024)))
    # An id that asks is no candidate of its own, so k + 1 different ids; rows
    # that agree in id and vector are counted before any of them is moved.
    number = Window.partitionBy("v").orderBy("vec_id")
    entries = checkpointed(
        rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
        .withColumn("n", F.row_number().over(number)).filter(F.col("n") <= k + 1)
        .select("vec_id", F.xxhash64("v").alias("print"), "v", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("vec_id", "print", F.pmod(F.xxhash64("vec_id", "print"), F.lit(n_blocks)).cast("int").alias("block"), "v")
    )
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    q_blocks = parts_for(asked.count(), query_block)
    asked = checkpointed(asked.select("query_id", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("q"), "v"))
    released(rows)
    slack = 1e-6 * (1 + levels * len(books[0].words))  # more than single precision can lose in the sums

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = encoded(books, _unit(_rows(batch.column(3))))
                raw = binaries(codes.ravel(), np.arange(len(codes) + 1) * codes.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), raw, _lists(errors)], names=["vec_id", "print", "block", "code", "error"])

    codes = entries.mapInArrow(encode, "vec_id long, print long, block int, code binary, error array<float>")
    # Each block of codes meets each block of queries: the stated queries
    # against all rows. Codes are repeated, vectors of entries are not.
    codes = codes.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    asking = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    kinds = {"query_id": np.int64, "q": np.int32, "block": np.int32, "crowded": np.bool_, "vec_id": np.int64, "print": np.int64, "low": np.float64, "high": np.float64}

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in kinds}
        if left.num_rows and right.num_rows:
            ids, prints = right.column("vec_id").to_numpy(), right.column("print").to_numpy()
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1).T.copy()
            errors = right.column("error").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).T.copy()
            unit, qs = _unit(_rows(left.column("v").combine_chunks())), left.column("query_id").to_numpy()
            q, block = left.column("q")[0].as_py(), left.column("block")[0].as_py()
            for i in range(len(qs)):
                near, low, high = _scan([book.tables(unit[i : i + 1])[0] for book in books], code, errors, ids != qs[i], k, rerank, slack)
                crowded = len(near) > crowd
                if crowded:
                    top = np.argsort(-low)[:k]
                    near, low, high = near[top], low[top], np.full(k, high.max())
                for c, x in zip(kinds, (qs[i], q, block, crowded)):
                    found[c].append(np.full(len(near), x))
                for c, x in zip(("vec_id", "print", "low", "high"), (ids[near], prints[near], low, high)):
                    found[c].append(x)
        return pa.table({c: np.concatenate(x).astype(kinds[c]) if x else np.empty(0, kinds[c]) for c, x in found.items()})

    scanned = asking.groupBy("q", "block").cogroup(codes.groupBy("q", "block")).applyInArrow(
        scan, "query_id long, q int, block int, crowded boolean, vec_id long, print long, low double, high double"
    )
    of_query = Window.partitionBy("query_id")
    place = F.row_number().over(of_query.orderBy(F.desc("low")))
    edge = F.coalesce(F.max(F.when(F.col("n") == k, F.col("low"))).over(of_query), F.lit(float("-inf")))
    left = scanned.withColumn("n", place).withColumn("edge", edge).filter(F.col("high") >= F.col("edge") - 2 * slack).drop("n", "edge")
    return Index(entries, asked, checkpointed(left))


def search(vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row whose id is divisible by
    `every` the k nearest other rows by cosine, nearest first, ties to smaller
    ids. Options are those of `index`."""
    found = index(vectors, k, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = _cosines(_unit(_rows(batch.column(3))), _unit(_rows(batch.column(2))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids, entry = right.column("vec_id").to_numpy(), _unit(_rows(right.column("v").combine_chunks()))
            unit, qs = _unit(_rows(left.column("v").combine_chunks())), left.column("query_id").to_numpy()
            for i in range(len(qs)):
                near, cos = _nearest(entry, ids, unit[i], ids != qs[i], k)
                for x, y in zip(out, (np.full(len(near), qs[i]), near, cos)):
                    x.append(y)
        return pa.table({c: np.concatenate(x) if x else np.empty(0, kind) for c, x, kind in zip(("query_id", "vec_id", "score"), out, (np.int64, np.int64, np.float64))})

    pairs = found.left.filter(~F.col("crowded")).select("query_id", "vec_id", "print").distinct()
    vectors_of = found.entries.select("vec_id", "print", F.col("v").alias("entry_v"))
    fetched = pairs.join(found.asked.drop("q"), "query_id").join(vectors_of, ["vec_id", "print"])
    few = fetched.select("query_id", "vec_id", "v", "entry_v").mapInArrow(compare, "query_id long, vec_id long, score double")
    crowds = found.left.filter("crowded").select("query_id", "q", "block").distinct()
    asked = crowds.join(found.asked.drop("q"), "query_id")
    places = crowds.select(F.col("q").alias("entry_q"), F.col("block").alias("entry_block")).distinct()
    blocks = found.entries.join(places, F.col("block") == F.col("entry_block")).select("entry_q", "entry_block", "vec_id", "v")
    many = asked.groupBy("q", "block").cogroup(blocks.groupBy("entry_q", "entry_block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return few.unionByName(many).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, k: int = 5, *, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> list[tuple[int, int, int, float]]:
    """The true neighbours of a small table, to measure recall against."""
    rows = sorted((r["vec_id"], r["v"]) for r in _usable(vectors, id_col, vector_col).collect())
    ids, x = np.array([i for i, _ in rows], dtype=np.int64), np.array([v for _, v in rows])
    found = []
    # Rows of an id stand by vector, so the first one asks.
    for i in np.unique(ids, return_index=True)[1] if len(ids) else ():
        if ids[i] % every == 0:
            cos = (_unit(x) * _unit(x[i : i + 1])).sum(axis=1)
            order = [j for j in np.lexsort((ids, -cos)) if ids[j] != ids[i]][:k]
            found += [(int(ids[i]), r + 1, int(ids[j]), float(cos[j])) for r, j in enumerate(order)]
    return found
