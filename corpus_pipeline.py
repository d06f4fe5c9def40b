"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Stages but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import decontamination, jaccard_join, mixing, token_output, toxicity
from loomstat.llm.common import stored
from loomstat.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled rows outside the held-out fold, doesn't reject."""
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), short_items=True).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by their copies in the mix; a document without words isn't counted by it and stays once."""
    mixed = mixing.mixed(docs, keep=("text", "lang", "n_chars"), named_source=True)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies").cast("int"))
    return mixed.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs, memo=token_output.SMALL_MEMO)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]
#: Stages 1, 2 and 5 have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
