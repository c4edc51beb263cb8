"""Queries opN over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from origo.llm.common import table


def tokenizer() -> str:
    """The tokenizer file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.jaccard import join

    return join(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8, 5).select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "n_linked_sets")


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.private import KINDS, find, said

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.substring import dedup

    found = dedup(table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer(), 1024)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.chat import digests, events, format_chats

    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_chats(events(turns)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.decontam import find

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, table(spark, sf_dir, "benchmark"), 0.8, 5).select("doc_id", "item_id", "start", "similarity")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.lines import dedup

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.nearest import search

    return search(table(spark, sf_dir, "embeddings"), 5)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.periods import find

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000L * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from origo.llm.language import identify

    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def queries() -> dict:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_private_data": op2_private_data,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality": op5_quality,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_decontamination": op7_decontamination,
        "op8_line_dedup": op8_line_dedup,
        "op9_sharding": op9_sharding,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_source_divergence": op12_source_divergence,
        "op13_language_id": op13_language_id,
    }


SUBSTRING_SQL = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS d FROM s GROUP BY 1),
g AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 50)) AS k FROM s JOIN f USING (h) WHERE f.d < s.doc_id),
a AS (SELECT doc_id, unnest(ws) AS x, unnest(range(0, len(ws))) AS k FROM w),
k AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.k) AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.k = g.k WHERE g.k IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1"""

LINES_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
b AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare FROM l),
f AS (SELECT doc_id, pos, bare, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE bare <> ''),
r AS (SELECT doc_id, k, n, CASE WHEN n < 3 THEN CASE WHEN k = 1 THEN [n::VARCHAR, bare, lead(bare) OVER w] END ELSE CASE WHEN k <= n - 2 THEN ['3', bare, lead(bare) OVER w, lead(bare, 2) OVER w] END END AS run
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
s AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS turn FROM r WHERE run IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + least(n, 3))) AS k FROM s WHERE turn > 1),
d AS (SELECT f.doc_id, f.pos FROM f JOIN g USING (doc_id, k)),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos WHERE d.pos IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM f GROUP BY 1), m AS (SELECT doc_id, count(*) AS n_removed FROM d GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN text IS NULL THEN NULL WHEN n_removed > 0 THEN coalesce(kept, '') ELSE text END AS text
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

# A run of period q and length L >= q + 5 has a row for each of its words i but the last q + 4: the five words from i
# occur again at i + q. Consecutive such rows of one q are a maximal stretch with period q; its least q is its period.
CRC_SQL = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)), lambda b, k: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)))"
PERIODS_SQL = f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  xor({CRC_SQL.format("doc_id::VARCHAR")}, 4294967295) AS h FROM documents),
b AS (SELECT *, len(ws) AS n, h // 10 AS g FROM t), c AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM b),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1]) ELSE ws END AS ws FROM c),
f AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 5], ' ')) AS x FROM (SELECT doc_id, ws, unnest(range(0, n - 4)) AS i FROM d)),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.x = y.x AND x.i < y.i),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p),
m AS (SELECT doc_id, q, min(i) AS start, max(i) + 5 + q - min(i) AS length FROM s GROUP BY doc_id, q, k),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
o AS (SELECT doc_id, count(*) AS n_runs, max(ROW(length, -start, -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(0, n)) AS i FROM d) w LEFT JOIN g USING (doc_id, i) WHERE g.i IS NULL GROUP BY 1),
z AS (SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best[2] AS start, best[1] AS length, -best[3] AS period, lines, kept FROM d LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM z"""

DIVERGENCE_SQL = r"""WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM t),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT lang, source FROM t), v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
x AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term),
g AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM x JOIN v USING (lang)),
y AS (SELECT lang, term, sum(n) AS n FROM x GROUP BY 1, 2),
l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM y JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM g JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10"""

# Sets of shingles of five words; links at 0.8 from exact counts of what two sets share; groups by all paths of links.
JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) > 0 THEN list_sort(list_distinct(list_transform(range(greatest(len(ws) - 4, 1)), lambda i: array_to_string(ws[i + 1:i + 5], ' ')))) END AS grams FROM w),
k AS (SELECT doc_id, md5(array_to_string(grams, chr(10))) AS c, grams FROM s),
c AS (SELECT c, min(doc_id) AS rep, count(*) AS copies, any_value(grams) AS grams FROM k WHERE c IS NOT NULL GROUP BY 1),
g AS (SELECT c, len(grams) AS n, unnest(grams) AS gram FROM c),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.c <> b.c GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE shared >= 0.8 * (n - shared)),
r(c, other) AS (SELECT c, c FROM c UNION SELECT l.b, r.other FROM r JOIN l ON r.c = l.a),
m AS (SELECT r.c, min(rep) AS class_id FROM r JOIN c ON r.other = c.c GROUP BY 1),
n AS (SELECT l.a AS c, count(*) AS sets, sum(copies) AS docs FROM l JOIN c ON l.b = c.c GROUP BY 1)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(rep, doc_id) AS copy_of, coalesce(copies, 1) AS n_copies,
  CAST(coalesce(docs, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, coalesce(sets, 0) AS n_linked_sets FROM k LEFT JOIN c USING (c) LEFT JOIN m USING (c) LEFT JOIN n USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": JACCARD_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op11_periodic_runs": PERIODS_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op6_chat_formatting": CHAT_SQL, "op8_line_dedup": LINES_SQL}
