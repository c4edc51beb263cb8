"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans of four kinds are found by fixed patterns and a check of form; they
always stay. Beside them generators with high recall propose spans, which may
overlap base ones: whatever has the shape of a kind, with or without what the
base patterns ask for (a number of groups without a plus, addresses with a
written-out or bracketed "at" and dots, digits in groups of any width). Boosted
trees judge each proposal by its format, without the part that only base spans
have, and by its context. What they learn from is whether a proposal lies on a
verified base span; the checks themselves (check digit, octets, number of digits
after a plus) are no features. So a proposal without a verified span is taken if
it is written, and stands, as verified ones do, and unlike the dates, versions
and numbers that the generators propose as well.

The trees are fitted on a bounded sample, by kind and label; they are written out
as one expression. A threshold for each kind, calibrated over all held-out
proposals of the table, selects what is added: above it at least `precision` of
the held-out proposals are right: verified, or as many of the unlabelled as the
distribution of verified ones says. A proposal that has the form of a base span
but failed its check is never added, nor is one that overlaps a base span.

Patterns begin only where a match can begin and never backtrack over what they
have taken, so time is linear in the text.

Defined cases: a null text is empty and has no spans; a null id is kept;
repeated rows have a row each; an empty table gives no rows; without both
labels in the sample, or verified spans of a kind, nothing is added (of it). Extra columns are not carried.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from origo.llm.common import checkpointed

LEAST_REACHED = 0.25  # share of verified proposals above a margin, from which on it tells how many unlabelled are right

# Kinds in order, and for each a pattern whose leftmost
# non-overlapping matches are the base candidates of that kind.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the texts must hold for a pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){5}", "phone": r"\+[0-9]"}
# What generators propose: shapes of a kind, whether or not base spans.
_AT, _DOT = r"(?:@|\x20?[\[({](?i:at)[\])}]\x20?|\x20(?i:at)\x20)", r"(?:\.|\x20?[\[({](?i:dot)[\])}]\x20?|\x20(?i:dot)\x20)"
NEAR = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.\]])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){2,5}+(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){11,18}+(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9+(])(?<![0-9][\x20.()/-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}+(?![0-9])",
}
NEAR_NEEDS = {
    "email": r"@|[\[({](?i:at)[\])}]|\x20(?i:at)\x20[A-Za-z0-9-]+\x20(?i:dot)\x20", "ip": r"[0-9]\[?\.\]?[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){11}",
    "phone": r"[0-9]{2}\)?[\x20./-]?[0-9]{2,4}[\x20./-][0-9]{2}",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
CUES = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|pay|acc", "phone": r"(?i)tel|phone|call|fax|mobil"}
FEATURES = ("kind", "n_digits", "n_chars", "n_separators", "n_groups", "widest", "narrowest", "last_group", "slashes", "cue", "letter_before", "letter_after", "digit_near")
_SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
_BLOCK = 128


def _before_each(lengths: Column) -> Column:
    """Sums of all lengths before each, in blocks, so that long arrays are no
    quadratic work."""

    def summed(array: Column | str, a: Column, b: Column) -> Column:
        # One by one: a slice would copy the whole array each time.
        return F.when(b > a, F.aggregate(F.sequence(a, F.greatest(b - 1, a)), F.lit(0), lambda acc, i: acc + F.get(array, i))).otherwise(0)

    size = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int")), lambda b: summed(lengths, b * _BLOCK, F.least((b + 1) * _BLOCK, size)))
    at = lambda i: F.floor(i / _BLOCK).cast("int")
    held = F.struct(lengths.alias("lengths"), blocks.alias("blocks"))
    # Through a fold of one step, so that the sums of blocks are made once.
    return F.aggregate(
        F.array(held), F.array().cast("array<int>"),
        lambda _, x: F.transform(F.sequence(F.lit(0), F.size(x["lengths"]) - 1), lambda i: summed(x["blocks"], F.lit(0), at(i)) + summed(x["lengths"], at(i) * _BLOCK, i)),
    )


def _with_spans(df: DataFrame, text: str, name: str, pattern: str, needs: str) -> DataFrame:
    """`df` with the matches of a pattern: code points, and what is around."""
    some = F.col(text).rlike(needs)
    df = df.withColumn("_hits", F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    found = F.size("_hits") > 0
    df = df.withColumn("_gaps", F.when(found, F.split(text, pattern, -1)))
    df = df.withColumn("_lens", F.when(found, F.transform(F.sequence(F.lit(0), F.size("_hits") - 1), lambda i: F.char_length(F.get("_gaps", i)) + F.char_length(F.get("_hits", i)))))
    df = df.withColumn("_at", F.when(found, _before_each(F.col("_lens"))))

    def span(i: Column) -> Column:
        hit, gap, after = F.get("_hits", i), F.get("_gaps", i), F.get("_gaps", i + 1)
        start = F.get("_at", i) + F.char_length(gap)
        before = F.when((gap == "") & (i > 0), F.get("_hits", i - 1)).otherwise(gap)
        return F.struct(
            start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("hit"),
            F.right(before, F.lit(24)).alias("before"), F.left(after, F.lit(2)).alias("after"),
        )

    spans = F.when(found, F.transform(F.sequence(F.lit(0), F.size("_hits") - 1), span)).otherwise(F.array().cast(_SPAN))
    return df.withColumn(name, spans).drop("_hits", "_gaps", "_lens", "_at")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(F.pmod(i, F.lit(2)) == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(n == 0, False).otherwise(F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)), F.lit(10)) == 0)


def _holds(kind: str, x: Column) -> Column:
    """The check of form of a base candidate."""
    if kind == "ip":
        return x["hit"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return _luhn(_digits(x["hit"]))
    if kind == "phone":
        return F.char_length(_digits(x["hit"])).between(8, 15)
    return F.lit(True)


def _core(kind: str, hit: Column) -> Column:
    """What a proposal has in common with base spans."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(hit, _AT, "@"), _DOT, ".")
    if kind == "ip":
        return F.regexp_replace(hit, r"[\[\]]", "")
    return F.regexp_replace(hit, r"^\+[0-9]{1,3}[\x20.-]?", "") if kind == "phone" else hit


def _features(kind: str, x: Column) -> Column:
    """Format and context of a proposal, in the order of FEATURES."""
    core = _core(kind, x["hit"])
    groups = F.filter(F.split(core, "[^0-9A-Za-z]+" if kind == "email" else "[^0-9]+", -1), lambda g: g != "")
    widths = F.transform(groups, lambda g: F.char_length(g))
    numbers = (
        F.lit(KINDS.index(kind)), F.char_length(_digits(core)), F.char_length(core), F.char_length(F.regexp_replace(core, "[0-9A-Za-z]", "")), F.size(groups), F.array_max(widths),
        F.array_min(widths), F.element_at(widths, -1), F.char_length(F.regexp_replace(core, "[^/]", "")),
    )
    flags = (
        x["before"].rlike(CUES[kind]), x["before"].rlike(r"\p{L}$"), x["after"].rlike(r"^\p{L}"),
        x["before"].rlike(r"[0-9][\x20./-]?$") | x["after"].rlike(r"^[\x20./-]?[0-9]"),
    )
    return F.array(*[F.coalesce(n, F.lit(0)).cast("double") for n in numbers], *[f.cast("double") for f in flags])


def _may_add(kind: str, x: Column) -> Column:
    """Whether a proposal is beyond the base patterns, so that no check of theirs
    has turned it down."""
    if kind == "email":
        return ~x["hit"].contains("@")
    if kind == "ip":
        return x["hit"].contains("[") & _holds(kind, F.struct(_core(kind, x["hit"]).alias("hit")))
    if kind == "card":
        return ((F.char_length(_digits(x["hit"])) < 16) | x["hit"].contains(".")) & _luhn(_digits(x["hit"]))
    return ~x["hit"].contains("+")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, and for each kind `base_k` and `near_k`: arrays of spans; proposals
    have `features`, `verified` (whether on a base span) and `free` (whether they
    may be added)."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _with_spans(df, "text", f"_base_{kind}", BASE[kind], NEEDS[kind])
        df = _with_spans(df, "text", f"_near_{kind}", NEAR[kind], NEAR_NEEDS[kind])
    held = lambda kind: F.filter(f"_base_{kind}", lambda x: _holds(kind, x)).alias(f"_base_{kind}")
    df = df.select("doc_id", *map(held, KINDS), *[f"_near_{k}" for k in KINDS])
    meets = lambda x, b: (b["start"] < x["end"]) & (x["start"] < b["end"])

    def base(kind: str) -> Column:
        return F.transform(f"_base_{kind}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(f"base_{kind}")

    def near(kind: str) -> Column:
        apart = lambda x: ~functools.reduce(operator.or_, [F.exists(f"_base_{k}", lambda b: meets(x, b)) for k in KINDS])
        return F.transform(
            f"_near_{kind}",
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), _features(kind, x).alias("features"),
                F.exists(f"_base_{kind}", lambda b: meets(x, b)).alias("verified"), (_may_add(kind, x) & apart(x)).alias("free"),
            ),
        ).alias(f"near_{kind}")

    return df.select("doc_id", *map(base, KINDS), *map(near, KINDS))


def _written_out(debug: str, features: Column) -> Column:
    """A tree, from its public text form, as nested conditions."""
    lines = [(len(s) - len(s.lstrip()), s.strip()) for s in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", s)]
    at = 0

    def node() -> Column:
        nonlocal at
        _, said = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", said):
            return F.lit(float(m[1]))
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", said)
        yes = node()
        at += 1  # the line "Else"
        no = node()
        return F.when(F.get(features, F.lit(int(m[1]))) <= float(m[2]), yes).otherwise(no)

    return node()


def fit(found: DataFrame, *, fit_rows: int = 4000, trees: int = 8, depth: int = 3, precision: float = 0.8):
    """A function from a proposal's features and kind to whether it is taken, or
    None if the sample lacks one of the labels. At most `fit_rows` proposals, as
    many of each kind and label, are learned from; the thresholds are of all
    proposals of the held-out third of rows."""
    rows = found.select("doc_id", F.explode(F.concat(*[F.transform(f"near_{k}", lambda x: F.struct(x["start"].alias("start"), x["verified"].alias("verified"), x["free"].alias("free"), x["features"].alias("features"))) for k in KINDS])).alias("x"))
    order = F.xxhash64("doc_id", "x.start", F.lit(17))
    rows = rows.select(order.alias("order"), F.col("x.verified").cast("double").alias("label"), F.col("x.free").cast("double").alias("free"), *[F.get("x.features", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])
    rows = checkpointed(rows.withColumn("held_out", F.pmod("order", F.lit(3)) == 0))
    turn = Window.partitionBy("kind", "label").orderBy("order", *FEATURES)
    sample = rows.filter(~F.col("held_out")).withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= max(1, fit_rows // (2 * len(KINDS))))
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(sample.select("label", "order", *FEATURES))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=17).fit(vectors.coalesce(1).sortWithinPartitions("order", *FEATURES))
    weights, texts = list(model.treeWeights), [t.toDebugString for t in model.trees]

    def margin(features: Column) -> Column:
        return F.round(sum((F.lit(float(w)) * _written_out(t, features) for w, t in zip(weights, texts)), F.lit(0.0)), 6)

    # Calibration, on the held-out margins of a kind. A verified span is right; what a
    # check turned down is wrong; what may be added is unlabelled, and some of it is
    # right. As right ones look like verified ones, as large a share of both lies
    # above any margin: so there are at most as many of them as (those above) / (that
    # share), whatever the margin, and the least of these bounds is their number. The
    # threshold is the lowest margin above which the wanted share is right. Equal
    # margins are one row; a sum of the values of eight small trees has few.
    judged = rows.filter("held_out").withColumn("features", F.array(*FEATURES)).groupBy("kind", margin(F.col("features")).alias("margin")).agg(
        F.sum("label").alias("good"), F.sum("free").alias("free"), F.count(F.lit(1)).alias("n")
    )
    above, whole = Window.partitionBy("kind").orderBy(F.desc("margin")), Window.partitionBy("kind")
    sums = judged.select("kind", "margin", *[F.sum(c).over(above).alias(c) for c in ("good", "free", "n")])
    sums = sums.withColumn("reached", F.try_divide("good", F.max("good").over(whole)))
    # One standard deviation is allowed for, as a count of a few says little.
    bound = F.when(F.col("reached") >= LEAST_REACHED, (F.col("free") + F.sqrt(F.col("free") + 1)) / F.col("reached"))
    sums = sums.withColumn("added", F.coalesce(F.min(bound).over(whole) * F.col("reached"), F.lit(0.0)))
    # The share is kept both of all proposals and of what is added alone.
    whole_share, added_share = F.least(F.col("good") + F.col("added"), "n") / F.col("n"), F.coalesce(F.try_divide("added", "free"), F.lit(1.0))
    kept = sums.filter((F.col("good") > 0) & (F.least(whole_share, added_share) >= precision)).groupBy("kind").agg(F.min("margin").alias("least")).collect()  # a row for each kind
    least = {int(r["kind"]): r["least"] for r in kept}
    return lambda kind, features: margin(features) >= F.lit(least[KINDS.index(kind)]) if KINDS.index(kind) in least else F.lit(False)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`doc_id, base, spans`: arrays of (kind, start, end) in code points, in the
    order of kinds, then starts."""
    found = checkpointed(candidates(docs, id_col=id_col, text_col=text_col))
    taken = fit(found, **options)

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def added(kind: str) -> Column:
        if taken is None:
            return F.array().cast("array<struct<kind:string,start:int,end:int>>")
        return named(kind, F.filter(f"near_{kind}", lambda x: x["free"] & taken(kind, x["features"])))

    base = {k: named(k, F.col(f"base_{k}")) for k in KINDS}
    return found.select("doc_id", F.concat(*base.values()).alias("base"), F.concat(*[F.array_sort(F.concat(base[k], added(k))) for k in KINDS]).alias("spans"))


def said(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; rows are matched
    to their spans by id, so ids must differ."""
    spans = find(docs, id_col=id_col, text_col=text_col, **options)
    spans = spans.select(F.col("doc_id").alias("_id"), F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"]))).alias("_spans"))
    # Rows travel as one struct, so no name of theirs can meet one used here.
    rows = docs.select(F.col(id_col).alias("_doc"), F.struct(*docs.columns).alias("_row"))
    text = F.col("_row").getField(text_col)
    put = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"))
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))),
    )
    joined = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")), "left")
    new = F.when(F.size("_spans") > 0, put).otherwise(text)
    return joined.select(*[(new if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
