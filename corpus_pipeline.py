"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame with the columns
of documents, but for the last, which returns the packed pieces. run() writes each stage's rows as Parquet in the shared
folder and reads them again for the next. What a stage wrote on its way, and its input, is deleted once its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skarn.llm import decontaminate, language, packing, pii, simhash, similar
from skarn.llm.common import discard, materialize, scratch


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go."""
    with scratch(spark):
        return language.keep_known(docs, language.fit(language.labelled_sample(docs)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays.

    Found by SimHash and covering anchors, as op3 does, with fingerprints wide enough for this rule. Decided row by row: rows are told apart by id and text.
    """
    with scratch(spark):
        return simhash.keep_first(docs, similar.similar_groups(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", known_languages),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: No stage but decontamination can be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
