"""Extra columns, whatever their names, go through untouched."""

from pyspark.sql import functions as F

from origo.llm import decontam, jaccard, lines, nearest, packing, private, quality, sharding, substring

NAMES = ["_doc", "_text", "_row", "_id", "_key", "_n", "_y", "_spans", "_crc", "_turn", "own", "text_key", "size", "key", "range", "class_id", "words", "hits", "at", "raw", "row", "length", "v", "n", "a"]


def test_clashing_names(spark, tmp_path):
    rows = [(i, f"text of number {i} with mail a{i}@b.org and some more words", f"z{i}") for i in range(30)] + [(None, None, "z"), (30, "text of number 3 with mail a3@b.org and some more words", "z30")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").select("doc_id", "text", "mark", *[F.col("mark").alias(n) for n in NAMES])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").withColumn("_id", F.lit(1))
    bench = spark.createDataFrame([(0, "text of number 7 with mail")], "item_id long, text string").withColumn("words", F.lit(1))

    def whole(df, n):
        found = df.collect()
        assert len(found) == n and all(r[c] == r["mark"] for r in found for c in NAMES)
        return found

    whole(lines.dedup(docs), 32)
    whole(jaccard.dedup(docs), 31)
    whole(quality.classify(docs, labels), 32)
    whole(decontam.clean(docs, bench), 31)
    assert {r["text"] for r in whole(private.redact(docs), 32) if r["doc_id"] == 1} == {"text of number 1 with mail [email] and some more words"}
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    whole(spark.read.parquet(str(tmp_path / "shards")), 32)
    assert jaccard.join(docs).count() == substring.dedup(docs).count() == 32
    assert decontam.find(docs, bench).count() == 1
    vectors = docs.withColumn("embedding", F.array(F.col("doc_id").cast("double"), F.lit(1.0))).withColumn("vec_id", F.col("doc_id"))
    assert nearest.search(vectors, 2, every=10).filter("rank = 1").count() == 4
    import public_tokenizers

    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 32
