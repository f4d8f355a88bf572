"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import OP3_SQL, op3_embedding_dedup
from .fingerprints import op1_fingerprints
from .language_id import op4_language_id
from .licenses import op6_licenses
from .minhash import OP10_SQL, op10_minhash
from .packing import op5_packing
from .quality import op8_quality
from .secrets import op2_secrets
from .sentencepieces import op7_sentencepiece
from .warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secrets": op2_secrets,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op9_warc": OP9_SQL, "op10_minhash": OP10_SQL}
