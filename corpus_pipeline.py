"""A corpus pipeline of five stages.

Each stage takes what its predecessor kept, as a table with the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import decontamination, jaccard_join, packing, pii, quality
from auditlake.llm.queries import table, tokenizer_path
from auditlake.store import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(spark, docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; repeated rows of it go too, other texts under its id stay.  Rows without an id are in no group and stay."""
    groups = jaccard_join.join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    one = docs.where("doc_id is not null").join(groups, docs["doc_id"] == groups["__keep"], "left_semi")
    return one.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(cut(packing.pieces(docs, tokenizer_path()), "pieces"))


STAGES = [("quality rules", keep_good), ("n-gram Jaccard join", keep_one_of_each), ("benchmark decontamination", keep_uncontaminated), ("PII", blank_personal_data), ("best-fit packing", pack)]

#: Training and packing can't be said in SQL; the tests of the operators and of this pipeline hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
