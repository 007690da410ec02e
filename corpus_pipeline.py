"""From raw documents to a training mix: each stage applies one operator of `plumbline.llm`.

Every stage takes all rows its predecessor kept and returns the columns of documents;
the last adds the words each document contributes. Nulls, empty texts, repeated rows and
empty tables are treated as the operators say. Text that lost a part gets a new `n_chars`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import fm_index, language, mixing, near_dups, suffix_dedup
from plumbline.llm.common import q
from plumbline.session import cut

PASSAGE_WORDS = 51  # words a passage has that is cut wherever it comes again
MIN_SCORE = 0.3  # a language with less than this share of the windows' votes is a rejection


def _with_text(d: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of `docs` with another text and its length; a null text stays null."""
    new = F.when(F.col("text").isNotNull(), F.col(text))
    size = F.when(F.col("text").isNotNull(), F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return d.select(*[new.alias("text") if c == "text" else size.alias("n_chars") if c == "n_chars" else q(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: without a letter, or told with less than MIN_SCORE, they go."""
    d = language.identify_language(docs)
    return d.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*[q(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_WORDS words or more, or of 400 bytes or more, that come anywhere else."""
    return _with_text(suffix_dedup.remove_repeats(docs, as_text=True, n_words=PASSAGE_WORDS), docs, "kept")


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows of benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(fm_index.find_contamination(docs, items, remove=True), docs, "clean")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words each contributes to the mix."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
]
ORACLE_SQL = None  # a trained network and hashed signatures have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) - 1 else docs
    return docs
