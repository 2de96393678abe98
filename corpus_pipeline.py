"""The corpus pipeline: quality rules, near copies, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm import packing, pii, quality, simhash
from cloudloom.llm.nearcopies import NEAR_RADIUS, NEAR_SHINGLE, SIMILARITY
from cloudloom.llm.shared import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, with all columns. Null and blank texts go; repeated rows are judged alike; no rows give none."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more.

    The least doc_id of a class stays, nulls last, then the least hash of the text. Repeated rows, null and
    blank texts are classes like any other; whole texts count, however long; no rows give none.
    """
    return simhash.deduplicate(docs, shingle=NEAR_SHINGLE, radius=NEAR_RADIUS, similarity=SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars follows the text.

    A null text stays null, and so does its n_chars; repeated rows stay, cut alike; no rows give none.
    """
    redacted = pii.redact(docs)
    return redacted.selectExpr(*[f"cast(length(text) as bigint) as {c}" if c == "n_chars" else f"`{c}`" for c in redacted.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences; a null text is one piece, a repeated row is packed again."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: fingerprints, the span classifier and the tokenizer are beyond it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
