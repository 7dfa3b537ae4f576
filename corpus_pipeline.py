"""A training corpus from raw documents, in five stages.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are
cut, sources are mixed to their target weights (a document taken twice stands twice),
and what is left is encoded.  Each stage but the last returns the columns of its input,
whatever their names; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import encode_documents, word_vocabulary
from llm.common import drop_path, fresh, shared_folder, table
from llm.line_dedup import dedup_lines
from llm.mixing import mix, unit_of
from llm.near_dedup import near_duplicates
from llm.toxicity import THRESHOLD
from llm.toxicity import toxicity as score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity, learned from all labels, is at the threshold or over.

    Null and empty texts have the score of no n-gram; rows alike in text stay or go together.
    """
    name = fresh(docs, "score")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(name) < THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8.

    Null, empty and blank texts have no group and stay.  Of rows that share the smallest id
    of a group, the least by text hash and then by all other columns stays.
    """
    told = near_duplicates(docs).where("kept")
    key, n, of = fresh(docs, "kept_key"), fresh(docs, "kept_rows"), fresh(docs, "kept_id")
    grouped = told.where("class_id is not null").groupBy("doc_id", "class_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    one = grouped.groupBy("doc_id", "class_id").agg(F.min(F.struct("row_key", "n")).alias("first")).select("doc_id", "first.row_key", "first.n")
    alone = told.where("class_id is null").select("doc_id", "row_key", F.lit(1).cast("long").alias("n")).distinct()
    picked = one.unionByName(alone).select(F.col("doc_id").alias(of), F.col("row_key").alias(key), F.col("n").alias(n))
    kept = docs.join(picked, docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(key))).select(*docs.columns, n)
    single = kept.where(F.col(n) == 1).select(*docs.columns)
    # Rows alike in id and text: the partial minimum keeps a hot id from filling one task.
    row = fresh(docs, "row")
    again = kept.where(F.col(n) > 1).select("doc_id", "text", F.struct(*docs.columns).alias(row))
    return single.unionByName(again.groupBy("doc_id", "text").agg(F.min(row).alias(row)).select(f"{row}.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut; n_chars counts what is left; documents left without text go.

    Null and empty texts stay as they are; ties go by id and place.
    """
    gone = fresh(docs, "removed")
    done = dedup_lines(docs, removed=gone)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.where(~((F.size(gone) > 0) & (F.trim(F.col("text")) == ""))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts have no words and are never taken; rows alike in id, source and
    text are taken alike.
    """
    own, unit, copies, number = (fresh(docs, n) for n in ("own_unit", "mix_unit", "copies", "copy_no"))
    taken = mix(docs).where("copies > 0").select(F.col("unit").alias(unit), F.col("copies").alias(copies)).distinct()
    joined = docs.withColumn(own, unit_of()).join(taken, F.col(own) == F.col(unit))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(number)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mix holds; null is encoded as the empty text."""
    return encode_documents(docs, word_vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL can't express the classifier or the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; only the last stays."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
