import corpus_pipeline as P
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "mixing", "SentencePiece encoding"]


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema))
    extra = extra.withColumns({"score": F.lit("mine"), "kept": F.lit(1), "copies": F.lit(2.5)})
    rows, before = extra, extra.count()
    counts = [before]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.schema.names == extra.schema.names, name
        rows = out.cache()
        counts.append(rows.count())
        assert rows.where("score <> 'mine' or kept <> 1 or copies <> 2.5").count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2]
    last = P.STAGES[-1][1](spark, rows, SF)
    assert last.count() == counts[4] and last.where("not round_trip").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_labelled_sound_documents_come_through_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    kept = P.quality_classifier(spark, docs, SF).select("doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    assert bad.join(kept, "doc_id").count() <= 0.1 * bad.count()
