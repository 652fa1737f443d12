"""The corpus pipeline: quality, near copies, repeated passages, mixture, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import mixing, ngram_join, packing, quality, suffix_dedup
from panelmill.llm.common import fresh, settle
from panelmill.llm.tokens import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that aren't held out, calls good.

    Null and empty texts get the score of no features and stay or go by it; equal texts get equal scores, so repeated rows stay or go
    together. Ids may be null or repeat. An empty table gives an empty one; columns and their names stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = fresh(docs.columns, "score", "predicted")
    return quality.classify(docs, labels, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Rows without words (null, empty, white texts) all stay; of repeated rows with words one stays; unlike rows of one id or without
    an id all stay. An empty table gives an empty one; columns and their names stay as they are.
    """
    return ngram_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in documents of smaller ids; n_chars counts what is left of a text that lost some.

    Every row stays, if with an empty text. Null texts stay null; a null id is greater than all others; equal rows, and unlike texts
    of one id, take nothing from each other. An empty table gives an empty one; columns and their names stay as they are.
    """
    rest = suffix_dedup.remove_repeats(docs, with_text=True, carry=[c for c in docs.columns if c != "text"])
    out = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(out["n_chars"])
    return rest.select(*[out[c].alias(c) for c in docs.columns])


def mixing_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; the one at a source's budget is cut after its last word taken.

    Rows without words are never taken. A null source is a source, the last one; null and repeated ids and repeated rows are documents of
    their own. An empty table gives an empty one; columns and their names stay as they are.
    """
    return mixing.take_mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; rows are treated as by pack_documents."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_targets", mixing_targets),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier, nor the tokens; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
