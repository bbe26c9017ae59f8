"""A training corpus out of `documents`: each stage works on all that the one before kept.

Quality first, as it is cheap and shrinks the rest; whole copies before passages, so that passages are only sought in one
document of each group; benchmark passages after that, in the text that will be used; packing last.

A row with a null doc_id has no copies and no passages to lose, so only quality and decontamination can drop it; two rows
with one doc_id are one document for near_dedup, where both stay or both go, and no earlier than each other for
suffix_dedup. An empty table passes through all stages. Other columns of documents stay up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from tessera.llm._session import remove, shared_dir

STAGES = [
    ("quality", quality.stage),
    ("near_dedup", near_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: A fitted classifier, suffix arrays' cuts and token ids are beyond SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's result kept as Parquet in the shared folder until the next one is there; the
    last one's stays, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        if before:
            remove(spark, before)
        before = f"{place}/{name}"
        docs = spark.read.parquet(before)
    return docs
