"""A training corpus from documents: quality rules, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores it as Parquet in the shared folder and
hands the stored table to the next. All but the last return the columns of ``docs``; where a stage changes texts,
``n_chars`` follows. Null texts count as empty: the quality rules reject them. Further columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import golay_simhash, language_crf, line_rules, pii_offsets, vector_packing
from runscope.llm.common import shared_folder, written
from runscope.llm.queries import language_model, tokenizer_file

#: A document stays if a language has so much probability over its words.
MIN_LANGUAGE_SCORE = 0.4


def _with_rows(docs: DataFrame) -> DataFrame:
    """``row``, all other columns in one struct whose names can meet no other, and ``text``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), "text")


def _columns(made: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` again, with another text."""
    values = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return made.select(*[values.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and so do documents that fail or lose too much."""
    judged = line_rules.clean_lines(_with_rows(docs), keep=["row"]).where("kept")
    return _columns(judged, docs, F.col("cleaned_text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that has a fair share of their words, go.

    The model learns from the languages given here; where none is, every document with letters stays. A document
    without a language gets the predicted one.
    """
    model = language_model(docs)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = language_crf.identify(held, model, keep=["row"])
    if model.labels:
        found = found.where((F.col("lang_pred") != language_crf.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    else:
        found = found.where("n_letter_words > 0")
    filled = F.coalesce(F.col("row.lang"), F.when(F.lit(bool(model.labels)), F.col("lang_pred")))
    return found.select(*[filled.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return golay_simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    found = pii_offsets.find_personal_data(_with_rows(docs), keep=["row"])
    return _columns(found, docs, F.col("redacted_text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    return vector_packing.pack_texts(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Training, components and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{shared_folder(spark)}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
