"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    entropy_secrets,
    golay_simhash,
    language_crf,
    line_rules,
    merge_automaton,
    period_runs,
    pii_offsets,
    posting_lists,
    quality_fm,
    systematic_mix,
    token_count_cache,
    vector_packing,
    zone_negatives,
)
from .common import held_out, shared_folder
from .oracles import OP4, OP10, OP11, OP13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {
    "op4_entropy_secrets": OP4,
    "op10_line_rules": OP10,
    "op11_systematic_mix": OP11,
    "op13_zone_negatives": OP13,
}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def language_model(docs: DataFrame) -> language_crf.Model:
    """Learned from text and language of the two thirds of the documents that are not held out."""
    usable = docs.where(F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    return language_crf.train(*language_crf.sample(usable, "text", "lang"))


@query("op1_language_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_crf.identify(docs, language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_letter_words")


@query("op2_pii_offsets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are those of the base spans; ``spans`` has the deobfuscated ones too."""
    found = pii_offsets.find_personal_data(read(spark, sf_dir, "documents"), with_text=False)

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii_offsets.KINDS),
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query("op3_posting_lists")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_entropy_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entropy_secrets.find_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[entropy_secrets.count_of("base_spans", k).alias(f"n_{k}") for k in entropy_secrets.KINDS[:3]],
        F.sha2(entropy_secrets.spans_text("base_spans"), 256).alias("base_sha256"),
        entropy_secrets.spans_text("spans").alias("spans"),
    )


@query("op5_golay_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(read(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_merge_automaton")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_automaton.encode_texts(
        read(spark, sf_dir, "documents"),
        tokenizer_file("word_bpe_49k.json"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


@query("op7_token_count_cache")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so that every distinct text is encoded."""
    return token_count_cache.token_counts(
        read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), shared_folder(spark)
    )


@query("op8_vector_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = vector_packing.pack_texts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query("op9_quality_fm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels of the two thirds of the documents that are not held out; scores all."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    usable = F.coalesce(~held_out(F.col("doc_id")), F.lit(False))
    about = ["n_chars"]  # all the metadata that may take part
    sampled = quality_fm.sample(docs, labels, usable, "text", "doc_id", "quality", metadata=about)
    scored = quality_fm.score(docs, quality_fm.train(*sampled, more=len(about)), metadata=about)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_line_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(read(spark, sf_dir, "documents"), with_text=False)


@query("op11_systematic_mix")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return systematic_mix.systematic_mix(read(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """In every tenth document by checksum of its id, the words from a random place on repeat the first ones from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("text").cast("string"), F.lit(systematic_mix.WORD), 0))
    sized = marked.select("*", words.alias("words")).select("*", F.size("words").alias("n"))
    places = sized.select("*", F.expr("g % n").alias("a")).select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    periodic = F.expr("transform(words, (w, i) -> IF(i < a, w, element_at(words, CAST(a + (i - a) % p + 1 AS INT))))")
    return places.select("doc_id", F.when(F.col("n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_period_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.find_runs(with_periods(read(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digested = found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        period_runs.best_run("runs").alias("best"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
        "n_words",
    )
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return digested.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256", "n_words"
    )


@query("op13_zone_negatives")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return zone_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
