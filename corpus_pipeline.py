"""A corpus from documents to packed sequences: rejected, repeated and leaked documents go,
personal data is masked, what is left is packed.

Every stage takes all rows that the one before it kept, written as Parquet and read again, so
a lost executor costs one stage's tasks at most. All but the last return the columns of ``documents``.

Defined results: a null text counts as empty in every stage, and stays null until it is packed, as its end token alone; a document
without words is judged by its shape and site, is no copy of another, holds no benchmark item and nothing to mask. Very long
texts are taken whole, and cut only by the packing, into pieces. Rows that share an id are one document to the Jaccard join, which
keeps the one with the smallest text, and rows each to the others; of equal documents that with the smallest id stays; rows without an
id all stay. Other columns pass through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from tessella.llm.common import shared_folder, table


def accepted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels")).where("accepted").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (five words, similarity 0.8)."""
    return jaccard_join.representatives(docs, n=5, p=4, q=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, exact or edited."""
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") == 0).select("row.*")


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it masked in their texts."""
    out = pii.sanitise(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")])
    put = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(put.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: a row a piece, with its ids and its place."""
    return packing.pack(docs, with_ids=True).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES = [
    ("quality classifier", accepted_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", sanitised),
    ("best-fit packing", packed),
]

#: The classifier, the alignment and the packing have no SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the cluster's shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), shared_folder(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
