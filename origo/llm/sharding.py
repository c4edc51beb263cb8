"""Sharding by sampled splitters.

Records are ordered by a key (here a hash of the text, then the doc_id), a
size-weighted sample of keys gives quantile boundaries of many fine ranges, and
the exact sizes of these ranges decide which shard each one goes to. A range
that is larger than its fair share, because one key has many records, is
subdivided by a hash of a number that each row has. Neighbouring ranges fill a
shard up to its quantile of all bytes; a few ranges then move from the fullest
to the emptiest shards, so shards differ by less than one fine range.

Equal texts have equal keys, so they share a shard, unless together they hold
over half a shard's bytes: only such a group is dealt to several shards. A range
of many rows, however few bytes they have, stays in its shard, but its rows are
numbered in pieces of their own, each from where the piece before it ends. Rows
are dealt by their own numbers, so rows that agree in all columns are, too.

Texts are read once; sizes and hashes, some bytes a row, are kept for the rest.
Nothing is sized by the data on the driver: the sample, the fine ranges and
pieces and their sizes are bounded by parameters.

Defined cases: a null text has no bytes and the crc of an empty text; a null id
sorts first; repeated rows are rows of their own; an empty table has no rows.
Extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm.common import checkpointed, parts_for

RECORD_BYTES = 16  # each record's fixed share of a shard


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def splitters(records: DataFrame, ranges: int, sample: int, seed: int = 7) -> list[int]:
    """At most `ranges - 1` keys that cut the records into ranges of about equal
    bytes, from a sample of about `sample` records drawn with chances in
    proportion to size."""
    total, count = records.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return []
    # A record of size s is drawn with chance min(1, sample * s / total); those
    # drawn surely keep their whole weight, the others the same weight each.
    chance = F.col("size") * F.lit(sample / total)
    dice = (F.xxhash64("key", "row", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    drawn = (
        records.filter(dice < chance)
        .groupBy("key")
        .agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("w"))
        .toPandas()  # about `sample` rows at most, whatever the input
        .sort_values("key")
    )
    if drawn.empty:
        return []
    run = drawn["w"].to_numpy().cumsum()
    at = np.searchsorted(run, run[-1] * np.arange(1, ranges) / ranges)
    return sorted(set(drawn["key"].to_numpy()[np.minimum(at, len(run) - 1)].tolist()))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts that are at most the key, by binary search over a
    tree of comparisons; the cuts lie in one array literal."""
    if not cuts:
        return F.lit(0)
    steps = max(1, (len(cuts)).bit_length())
    array = F.expr("array(" + ", ".join(f"bigint('{c}')" for c in cuts) + ")")  # folded to one literal
    low, high = F.lit(0), F.lit(len(cuts))
    search = F.struct(low.alias("low"), high.alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(array, mid) <= key)
        return F.when(s["low"] >= s["high"], s).otherwise(
            F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(mid).alias("high"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), search, step)["low"]


def _deal(sizes: list[int], shards: int) -> list[int]:
    """A shard for each fine range, in order: each shard is filled to its
    quantile of all bytes, then ranges move from the fullest shard to the
    emptiest as long as that makes the two more equal."""
    total, done, of = sum(map(int, sizes)), 0, []
    for size in sizes:
        of.append(min(shards - 1, int((done + size / 2) * shards / max(1, total))))
        done += int(size)
    load, holds = [0] * shards, [[] for _ in range(shards)]
    for i, at in enumerate(of):
        load[at] += int(sizes[i])
        holds[at].append(i)
    for _ in range(4 * len(sizes)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        best = min(holds[full], key=lambda i: abs(gap / 2 - sizes[i]), default=None)
        if best is None or sizes[best] <= 0 or sizes[best] >= gap:
            break
        holds[full].remove(best)
        holds[empty].append(best)
        of[best] = empty
        load[full] -= int(sizes[best])
        load[empty] += int(sizes[best])
    return of


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", ranges: int = 2048, sample: int = 16384, piece_rows: int = 1 << 17, pieces: int = 1 << 15) -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard` of every record,
    under the law `bytes`: the shards' sizes are near equal. A piece that is
    numbered in one go has about `piece_rows` rows, and more only where the table
    has over `pieces` times as many."""
    records = checkpointed(_sizes(docs, id_col, text_col))
    cuts = splitters(records, ranges, sample)
    placed = records.withColumn("range", _range_of(F.col("key"), cuts))
    sizes = {r["range"]: (int(r["size"]), int(r["n"])) for r in placed.groupBy("range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}  # `ranges` rows at most
    total, rows = sum(x for x, _ in sizes.values()), sum(n for _, n in sizes.values())
    # Subdividing overfull ranges: a key of over half a shard, and there are
    # fewer than 2 * shards of these, is dealt out.
    overfull = [at for at, (size, _) in sizes.items() if size * 2 * shards > total]
    part = F.lit(0)
    if overfull:
        keys = placed.filter(F.col("range").isin(overfull)).groupBy("key").agg(F.sum("size").alias("size"))
        hot = {r["key"]: -(-r["size"] * shards * 16 // total) for r in keys.filter(F.col("size") * (2 * shards) > total).collect()}
        if hot:
            many = F.create_map(*[F.lit(x) for pair in sorted(hot.items()) for x in pair])
            dealt = F.pmod(F.xxhash64("row", F.lit(11)), F.try_element_at(many, F.col("key"))).cast("int") + 1
            part = F.coalesce(dealt, F.lit(0))
    # Rows of a range are numbered in so many pieces.
    most = max(piece_rows, parts_for(rows, pieces))
    split = F.expr("array(" + ", ".join(str(parts_for(sizes.get(at, (0, 0))[1], most)) for at in range(len(cuts) + 1)) + ")")  # folded to one literal
    placed = placed.withColumn("part", part).withColumn("piece", F.pmod(F.xxhash64("row", F.lit(13)), F.get(split, F.col("range"))).cast("int"))
    counted = placed.groupBy("range", "part", "piece").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["range", "part", "piece"])
    fine = counted.groupby(["range", "part"], as_index=False)["size"].sum()
    fine["shard"] = np.array(_deal(fine["size"].tolist(), shards), dtype="int32")
    counted = counted.merge(fine[["range", "part", "shard"]], on=["range", "part"])
    counted["base"] = counted.groupby("shard")["n"].cumsum() - counted["n"]
    plan = counted[["range", "part", "piece", "shard", "base"]].astype({"range": "int32", "part": "int32", "piece": "int32", "shard": "int32", "base": "int64"})
    # `ranges` rows, the parts of under 2 * `shards` keys (16 * `shards` together)
    # and, as ranges of several pieces have `piece_rows` rows, `pieces` for each of these at most.
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan, "range int, part int, piece int, shard int, base long"))
    within = Window.partitionBy("range", "part", "piece").orderBy("key", "doc_id", "size", "text_crc32", "row")
    return (
        placed.withColumn("at", F.row_number().over(within))
        .join(plan, ["range", "part", "piece"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write the records, with `slot`, to one folder `shard=N` for each shard,
    slots in order; columns of these names are replaced."""
    where = shard(docs, shards, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_crc32", "shard", "slot")
    # A row that occurs several times has as many places; each gets one of them.
    where = where.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy("slot")))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("_id"), crc.alias("_crc"), F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("_row"))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_id", "_crc").orderBy(F.lit(1))))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_crc") == F.col("text_crc32")) & (F.col("_turn") == F.col("turn"))
    (
        rows.join(where, same)
        .select("_row.*", "shard", "slot")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").partitionBy("shard").parquet(path)
    )
