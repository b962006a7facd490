"""A training-data pipeline over `documents`: every stage takes the rows that the one before it kept.

A stage sets the columns of its input aside under names of its own while its operator works, so a column that is called like something the
operator makes comes through unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import divergence_rules, quality_gbt, simhash, soft_mixing, sp_unigram
from offerlake.llm.catalog import bounded_batches
from offerlake.session import work_path

# Some stages cannot be said in SQL: trained models, fitted rates, classes of links.
ORACLE_SQL = None


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    bounded_batches(docs.sparkSession)
    names = {c: f"in{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of a half or more stay."""
    rows, names = aside(docs)
    known = labels(spark, sf_dir).withColumnRenamed("doc_id", names["doc_id"])
    scored = quality_gbt.score(rows, known, F.lit(True), text=names["text"], doc_id=names["doc_id"], into="score")
    return back(scored.where("score >= 0.5"), names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near enough to a language reference stay."""
    rows, names = aside(docs)
    return back(divergence_rules.judge(rows, text=names["text"], lang=names["lang"]).where("kept"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    rows, names = aside(docs)
    return back(simhash.one_of_each(rows, text=names["text"], doc_id=names["doc_id"]), names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of a document as its rate asks. The sound domain keeps its tokens, so its documents have rates of about one or
    more, and the others are thinned out."""
    rows, names = aside(docs)
    mixed, _ = soft_mixing.mix(rows, labels(spark, sf_dir), text=names["text"], doc_id=names["doc_id"])
    return back(mixed.withColumn("copy", F.explode(F.expr("array_repeat(1, cast(copies as int))"))), names)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    rows, names = aside(docs)
    out = sp_unigram.encode_and_check(rows, text=names["text"])
    return out.select(F.col(names["doc_id"]).alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded_sha256", "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again as the next one's input."""
    root = work_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{root}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
