"""Line deduplication by winnowing, in DataFrame functions only.

Lines that aren't blank are hashed. Of each window of `run` consecutive lines
the least hash is a fingerprint, so a repeated run of `run` lines or more always
shares one with its earlier copy, at the same line. Fingerprints that occur once
go. The others join their places: each window around one joins the first place
(smallest document, then smallest line) of the same lines, which is a row for a
place, however many places there are. Matches that follow one another in both
documents extend each other both ways, to the longest stretches of equal lines;
the later copy is deleted. All steps are rows of a line or a stretch, so the work
on a document is in proportion to its lines, however they repeat.

So a line is deleted if, and only if, one of the runs of `run` lines that hold
it occurs earlier. Blank lines stay and don't count. A document of fewer lines
is one run of all its lines; it is deleted if an earlier document has just
these lines. Lines are compared without white space at their ends, by 64-bit
hashes.

With `alone`, a line of at least so many words is deleted wherever it occurs
earlier, whatever stands beside it, too. Its first place always stays: a run
that is deleted occurs earlier, and so does each of its lines.

Defined cases: a null text stays null, an empty text empty; a null id comes
after all others; rows that agree in id and text are one document, and keep a
row each; rows of one id with different texts are different documents, in the
order of a hash of the text; a document all of whose lines are repeats becomes
empty and stays; an empty table stays empty. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm.common import checkpointed, redealt

_LAST = (1 << 63) - 1


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _windows(run: int) -> Column:
    """Of each window of `run` lines of `own` (of all lines, if there are fewer)
    the place of its first least hash, its start, and a hash of its lines."""
    n = F.size("own")
    # One by one: a slice would copy the whole array for each window.
    part = lambda i: F.filter(F.array(*[F.get("own", i + j) for j in range(run)]), lambda x: x.isNotNull())
    at = lambda i: (i + F.array_position(part(i), F.array_min(part(i))) - 1).cast("int")
    window = lambda i: F.struct(at(i).alias("at"), i.alias("start"), F.xxhash64(F.least(n, F.lit(run)), part(i)).alias("key"))
    return F.transform(F.sequence(F.lit(0), F.greatest(n - run, F.lit(0))), window)


def _stretches(matches: DataFrame, run: int) -> DataFrame:
    """`_doc, _text, start, end`: matches (`place`, `origin`, each with a start)
    that follow one another in both documents are one stretch. They are dealt by
    document once, for this and for gathering a document's stretches."""
    line = Window.partitionBy("_doc", "_text", "_from", "_from_text", "by").orderBy("start")
    rows = matches.select(
        F.col("place._doc").alias("_doc"), F.col("place._text").alias("_text"), F.col("origin._doc").alias("_from"), F.col("origin._text").alias("_from_text"),
        (F.col("place.start") - F.col("origin.start")).alias("by"), F.col("place.start").alias("start"), F.col("place.lines").alias("lines"),
    ).repartition("_doc", "_text")
    first = (F.col("start") > F.lag("start").over(line) + 1) | F.lag("start").over(line).isNull()
    numbered = rows.withColumn("first", first.cast("int")).withColumn("stretch", F.sum("first").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_doc", "_text", "_from", "_from_text", "by", "stretch").agg(
        F.min("start").alias("start"), (F.max("start") + F.least(F.lit(run), F.max("lines"))).alias("end")
    ).select("_doc", "_text", "start", "end")


def _later(hashed: DataFrame) -> DataFrame:
    """`_doc, _text, start, end` of the `long` lines that have an earlier place."""
    lines = F.filter(F.transform("own", lambda x, i: F.struct(x.alias("key"), i.alias("start"))), lambda x: F.get("long", x["start"]))
    places = hashed.select("_doc", "_text", F.explode(lines).alias("x")).select("x.key", F.struct("_doc", "_text", "x.start").alias("place"))
    firsts = places.groupBy("key").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "origin")
    later = places.join(redealt(firsts, "key"), "key").filter(F.col("place") != F.col("origin"))
    return later.select("place._doc", "place._text", "place.start", (F.col("place.start") + 1).alias("end"))


def dedup(docs: DataFrame, run: int = 3, *, alone: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without repeated runs of lines, and `n_lines` (not blank),
    `n_removed`; without repeated lines of `alone` words or more, if given."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Rows travel as one struct, so no name of theirs can meet one used here.
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_doc"), F.xxhash64(text_col).alias("_text"), F.struct(*columns).alias("_row"))
    text = F.col("_row").getField(text_col)
    lines = F.filter(F.transform(F.split(text, "\n", -1), _bare), lambda x: x != "")
    own = [F.transform(lines, lambda x: F.xxhash64(x)).alias("own")]
    if alone is not None:
        own.append(F.transform(lines, lambda x: F.rlike(x, F.lit(rf"^\S+(?:\s+\S+){{{max(alone, 1) - 1}}}"))).alias("long"))
    hashed = checkpointed(
        keyed.filter(text.isNotNull())
        .select("_doc", "_text", *own)
        .filter(F.size("own") > 0)
        .dropDuplicates(["_doc", "_text"])
    )
    # The windows of a fingerprint follow one another, at most `run` of them. Only
    # the array of fingerprints is made into rows.
    windows = hashed.withColumn("windows", _windows(run)).select("_doc", "_text", F.size("own").alias("lines"), "own", "windows")
    groups = F.transform(
        F.filter(F.transform("windows", lambda w, i: F.struct(w["at"].alias("at"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get("windows", x["i"] - 1)["at"] != x["at"])),
        lambda x: F.struct(
            F.get("own", x["at"]).alias("print"),
            F.filter(F.array(*[F.get("windows", x["i"] + j) for j in range(run)]), lambda w: w["at"] == x["at"]).alias("windows"),
        ),
    )
    prints = windows.select("_doc", "_text", "lines", F.explode(groups).alias("g")).select("_doc", "_text", "lines", "g.print", "g.windows")
    shared = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print")
    places = (
        prints.join(redealt(shared, "print"), "print")
        .select("_doc", "_text", "lines", F.explode("windows").alias("w"))
        .select(F.col("w.key").alias("key"), F.struct("_doc", "_text", F.col("w.start").alias("start"), "lines").alias("place"))
    )
    firsts = places.groupBy("key").agg(F.min("place").alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "origin")
    matches = places.join(redealt(firsts, "key"), "key").filter(F.col("place") != F.col("origin"))
    found = _stretches(matches, run)
    if alone is not None:
        found = found.unionByName(_later(hashed))
    removed = found.groupBy("_doc", "_text").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    whole = (
        keyed.join(removed, ["_doc", "_text"], "left")
        .withColumn("_lines", F.split(text, "\n", -1))
        .withColumn("_full", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _bare(F.get("_lines", i)) != ""))
        .withColumn("_gone", F.array_distinct(F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["start"], s["end"] - 1), lambda i: F.get("_full", i))))))
    )
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    new = F.when(F.size("_gone") > 0, F.array_join(kept, "\n")).otherwise(text)
    return whole.select(
        *[(new if c == text_col else F.col("_row").getField(c)).alias(c) for c in columns],
        F.coalesce(F.when(text.isNotNull(), F.size("_full")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(text.isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("n_removed"),
    )
