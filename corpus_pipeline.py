"""A corpus from raw documents to token digests: five stages, each written as Parquet and read again by the next.

Defined results: documents with a null or empty text go in the first stage, as they have no language; rows with a null
doc_id, lang or source take part like others (a null source is a source of its own in the mixture). Repeated rows and
near copies leave one row of their group. An empty table gives an empty result. Columns of documents beyond those that
the stages name, under whatever names, go through up to the last stage as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martflow.llm.bpe import encoded_stage
from martflow.llm.jaccard_join import unique_stage
from martflow.llm.language_id import language_stage
from martflow.llm.mixing import mixed_stage
from martflow.llm.quality_rules import kept_stage
from martflow.llm.shared import Scratch, clear_left, table

STAGES = [
    ("language_id", language_stage),
    ("quality_rules", kept_stage),
    ("jaccard_join", unique_stage),
    ("mixing", mixed_stage),
    ("bpe", encoded_stage),
]

#: SQL can express neither the model of the first stage nor the codes of the last: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline. A stage's table is removed once the next one has been written; the last reads lazily."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.written(stage(spark, docs, sf_dir), name)
        scratch.free(before)
        clear_left()
    return STAGES[-1][1](spark, docs, sf_dir)
