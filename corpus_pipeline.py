"""From raw documents to packed token sequences, in five stages.

toxicity drops documents whose calibrated score reaches the operator's limit;
jaccard keeps the document with the smallest doc_id of each group of linked
ones; decontamination drops documents that hold benchmark windows; secrets puts
a mark in place of each secret; packing cuts what is left into token sequences.
Each stage returns the columns of documents, but for the last, whose rows are
pieces.

Defined results: null texts, and those without words, pass the filters (they hold nothing to reject) and
give one piece; rows repeated in id and text are one; an empty table
gives no rows; columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import default_vocabulary, hash_bucket, scratch, table
from concord.llm.decontaminate import decontaminate
from concord.llm.jaccard import jaccard_components
from concord.llm.packing import pack
from concord.llm.secrets import find_secrets
from concord.llm.toxicity import score_toxicity, train

MARK = "[SECRET]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(hash_bucket("doc_id", 3) != 1)
    scored = score_toxicity(docs, train(docs, labels, scratch(spark, "pipeline-toxicity")))
    # As the operator has it, words are of 0-9, letters and everything beyond ASCII.
    wordless = ~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    return scored.where((F.col("predicted") == 0) | wordless).select(docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays; documents without words are linked with nothing and stay."""
    found = jaccard_components(docs, scratch(spark, "pipeline-jaccard"))
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = docs.join(keep.select("doc_id"), "doc_id", "left_semi")
    if keep.where("n > 1").limit(1).count():
        # Repeated ids: of rows alike in id and text one stays.
        kept = kept.dropDuplicates(["doc_id", "text"])
    # A null id is in no group.
    return kept.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document that holds a window of an item goes on, however long it is: op1's share of words is for its report alone."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = find_secrets(docs, redact=MARK)
    if "n_chars" in docs.columns:
        changed = F.size("secrets") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_vocabulary(), scratch(spark, "pipeline-packing"))


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Trees and best-fit packing are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
