"""The registered query of each operator and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, neardup, neighbours, quality
from .bpe import encode_texts
from .common import table
from .hmm import lm_scores
from .html import main_text
from .linededup import line_report
from .mixing import mix
from .neardup import near_duplicates
from .neighbours import nearest
from .passages import repeated_passages
from .quality import quality_rules
from .resample import importance_resample
from .runs import periodic_runs, run_report, with_planted_run
from .shards import assigned


def op1_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across (or within) documents, a row for each document and partner. Null, empty and shorter texts give none, nor do rows without doc_id; see repeated_passages for ties, repeated rows and an empty table."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every row of documents; null and empty texts fail the base rule, null languages and sources are groups of their own."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages; null and empty pages give an empty text. Repeated rows give repeated results."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of documents, null as empty. Repeated rows give repeated results."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every row of documents; null and empty texts and rows without doc_id are linked with nothing."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of documents; null texts have none, null sources are one source, repeated rows are documents of their own."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completions of every conversation with an assistant turn, its last reply against a parroted one. Null roles count as user, null texts as empty."""
    pairs = chat.preferences(chat.parroted(chat.turns_of(table(spark, sf_dir, "conversations"))))
    trained = [chat.trained_chars(F.col(f"{s}_segments")).alias(f"{s}_trained") for s in ("chosen", "rejected")]
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", *trained, "prefers")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every row of documents that repeat an earlier line, equal or within two edits; null and empty texts have no lines."""
    return line_report(table(spark, sf_dir, "documents"))


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of documents under a model learnt from those not held out; null and empty texts have the end token only."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for each row of embeddings whose vec_id is divisible by 100; null, zero and non-finite vectors take no part."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every row of documents, every tenth of which gets a periodic tail; null and empty texts have none. See periodic_runs for ties, overlaps and repeated rows."""
    docs = table(spark, sf_dir, "documents")
    return run_report(periodic_runs(docs.select("doc_id", with_planted_run(docs["doc_id"], docs["text"]).alias("text"))))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all rows of documents towards the texts of benchmark, and a draw of 5 % of those with 20 words; null and empty texts weigh 0. See importance_resample for ties and repeated rows."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard of 16 and a slot in it for every row of documents, near equal in bytes, words and rows; null and empty texts have size 1. See assigned for groups, ties and repeated rows."""
    packed = assigned(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compact_windows": op1_compact_windows,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_preference_format": op7_preference_format,
    "op8_line_dedup": op8_line_dedup,
    "op9_hidden_markov": op9_hidden_markov,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resample": op12_importance_resample,
    "op13_vector_packing": op13_vector_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.ORACLE,
    "op5_minhash_near_dedup": neardup.ORACLE,
    "op7_preference_format": chat.ORACLE,
    "op10_hilbert_neighbours": neighbours.ORACLE,
}
