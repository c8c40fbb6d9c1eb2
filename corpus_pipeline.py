"""From raw documents to packed token sequences, one stored table per stage.

Quality rules drop documents, language identification drops those it cannot tell, the n-gram
join keeps one document of each group of near copies, and packing lays out what is left.
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

import changeflow  # noqa: E402
from changeflow.llm.language_id import language_stage  # noqa: E402
from changeflow.llm.near_join import near_stage  # noqa: E402
from changeflow.llm.packing import packing_stage  # noqa: E402
from changeflow.llm.quality_rules import quality_stage  # noqa: E402
from changeflow.plans.storage import new_folder  # noqa: E402

# Functions that run in Python workers travel with the job, wherever the workers start.
cloudpickle.register_pickle_by_value(changeflow)

STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_stage),
    ("packing", packing_stage),
]

#: Language identification cannot be put in SQL; the tests hold the chain against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
