"""A corpus pipeline over ``documents``: each stage's result is written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkpolicy.llm.common import shared_path, table
from sparkpolicy.llm.language_id import keep_identified
from sparkpolicy.llm.minhash import keep_distinct
from sparkpolicy.llm.packing import pack_documents
from sparkpolicy.llm.quality import keep_quality
from sparkpolicy.llm.secrets import redact_secrets

#: (name, function); a function takes (spark, docs, sf_dir).
STAGES = [
    ("language_id", keep_identified),
    ("quality", keep_quality),
    ("near_dedup", keep_distinct),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

#: Tokenising and the models can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: a row for each piece of a document that all stages keep.

    Documents with a null or empty text or without a letter go in the first stage; of repeated rows one stays after the third; an
    empty table gives no row. Each stage says what it does with other cases.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
