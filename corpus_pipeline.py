"""From raw documents to packed training windows: five stages, each written and read again.

toxicity drops documents that the subword model scores as toxic; near_duplicates keeps one document of each group linked by the
5-gram Jaccard similarity; decontamination drops documents that hold benchmark passages; secrets masks secrets inside the texts;
packing cuts the ids of what is left into windows and returns its pieces with their ids.

A stage's result must be written before the next stage is called: by then the intermediate folders of the stage before are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, jaccard, packing, secret_scan, toxicity
from foliospark.llm.work import crc32_mod, made, release, stash, table

_SPENT: list[str] = []  # folders that only the last stage's unwritten result needed


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Deletes what the stage before left behind, and notes what this one makes."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _SPENT)
        _SPENT.clear()
        before = set(made())
        out = function(spark, docs, sf_dir)
        _SPENT.extend(f for f in made() if f not in before)
        return out
    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the model does not score as toxic; null and empty texts are scored like any other, repeated rows alike.
    The model learns from labelled documents that are not held out; without any, all rows stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 5) != 0)
    return toxicity.without_toxic(docs, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, equal rows included; texts without words are linked with nothing and all stay."""
    return jaccard.keep_one(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words are hit by benchmark passages in less than one of twenty; texts without words stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets inside the texts masked; a null text stays null."""
    return secret_scan.redact(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, with their ids; a null or empty text has its end id alone, repeated rows have pieces of their own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Model scores, shingle classes and token ids are beyond SQL; tests compare the rows with a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of everything that the stages keep of `documents`."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, function in STAGES:
        docs = stash(function(spark, docs, sf_dir), f"stage-{name}")
        release(spark, last)
        last = made()[-1:]
    release(spark, _SPENT)
    _SPENT.clear()
    return docs
