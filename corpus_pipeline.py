"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark texts, packing.

Each stage takes the documents that its predecessor kept, with all their columns, and its decisions take effect; between
stages the documents are a Parquet table in the shared folder.

In all stages a null text counts as empty, a null id is kept like any other, repeated rows are rows of their own (of which
stage 2 keeps one), texts of any length are read whole, and no documents give no documents. Columns beside doc_id and
text pass through under any names: while a stage works they have names that no operator uses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logyield.llm import decontaminate, jaccard, packing, quality, suffix
from logyield.llm.common import kept_table, table, without
from logyield.llm.labelled import training_rows
from logyield.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def other_columns_apart(stage: Stage) -> Stage:
    """The stage on documents whose other columns are renamed, and renamed back in what it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
        apart = {c: f"kept column {i}" for i, c in enumerate(others)}
        out = stage(spark, docs.withColumnsRenamed(apart), sf_dir)
        return out.withColumnsRenamed({a: c for c, a in apart.items()})

    return run


@other_columns_apart
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network accepts (probability at least ``Params.threshold``)."""
    params = quality.Params()
    rows = training_rows(docs, table(spark, sf_dir, "labels"), "quality", params.most_rows)
    scored = quality.with_scores(docs, quality.fit(rows, params))
    return scored.where(F.col("_score") >= params.threshold).drop("_score")


@other_columns_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 75 % common shingles hold together."""
    return jaccard.one_per_component(docs)


@other_columns_apart
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that an earlier document has; emptied documents go."""
    return suffix.without_repeats(docs)


@other_columns_apart
def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hashed = docs.withColumn("_row", jaccard.row_hash(docs))
    index = decontaminate.build_index(hashed, key="_row")
    found = decontaminate.report(index, table(spark, sf_dir, "benchmark"))
    dropped = kept_table(found.where("n_hit > 0").select(F.col("id").alias("_row")).distinct(), "contaminated")
    return without(hashed, dropped, "_row").drop("_row")


@other_columns_apart
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in sequences of 1024."""
    packed = packing.pack(docs.select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_texts", benchmark_texts),
    ("best_fit_packing", best_fit_packing),
]

#: Training a network and tokenising are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
