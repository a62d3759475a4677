"""A corpus from raw documents: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor
kept. All but the last return the columns of documents.

Defined cases: null and empty texts go through like others (the quality stage may reject them, the last one packs
their closing id); documents without an id are never removed as copies or as contaminated; rows that repeat a doc_id are
judged together where documents are compared, and stay or go together; further columns, whatever their names, are
carried to the last stage; empty tables of documents, labels or benchmark give results of the usual columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontam, packing, pii, quality, simhash
from strandline.llm.common import shared_dir, table

STAGES = [
    ("quality classifier", quality.stage),
    ("near-duplicates", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("personal data", pii.stage),
    ("packing", packing.stage),
]

#: Fingerprints, tokens and fitted models have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
