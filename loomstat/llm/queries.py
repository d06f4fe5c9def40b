"""The operators' queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.registry import Catalogue
from loomstat.session import table

from . import chat_format, decontamination, exact_dedup, jaccard_join, lattice_lm, mixing, substring_dedup, token_output, toxicity, url_filter

CATALOGUE = Catalogue()


@CATALOGUE.query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model).select("doc_id", (toxicity.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@CATALOGUE.query("op2_exact_dedup", exact_dedup.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@CATALOGUE.query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@CATALOGUE.query("op4_url_filter", url_filter.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@CATALOGUE.query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("rate", "copies")


@CATALOGUE.query("op6_chat_format", chat_format.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = chat_format.PROBE_TEXT
    probe = spark.createDataFrame([(chat_format.PROBE_ID, 0, "user", text), (chat_format.PROBE_ID, 1, "assistant", text)], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(probe)))


@CATALOGUE.query("op7_lattice_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"))


@CATALOGUE.query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@CATALOGUE.query("op9_token_output")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


@CATALOGUE.query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True)
