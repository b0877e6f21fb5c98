"""A training corpus from raw documents: reject, deduplicate, decontaminate, sanitise, mix.

Each stage reads what the one before it kept, written as Parquet in the shared folder. The last one says how often the mix
takes each document; `run` gives the mix itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.llm import decontaminate, jaccard, mixing, pii, quality
from loomshift.llm.common import Scratch, columns, fold
from loomshift.llm.registry import query
from loomshift.session import configure, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the same fold as the query of the operator."""
    configure(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.accepted(docs, quality.fit(docs.select("doc_id", "text"), labels, fold(F.col("doc_id")) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents."""
    configure(spark)
    return jaccard.unique(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    configure(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose them replaced."""
    configure(spark)
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with how often the mix takes them."""
    configure(spark)
    return mixing.mix(docs)


def drawn(docs: DataFrame) -> DataFrame:
    """The mix: each document as often as it is taken, numbered by `copy` from 1; those not taken are left out."""
    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("repeats").cast("long")))
    return docs.select(*columns(docs, ("copy",)), F.explode(copies).alias("copy"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources", source_mix),
]

# fitted models and graph classes have no SQL; tests compare the stages with plain Python
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, and the mix drawn."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = scratch.store(stage(spark, docs, sf_dir))
        if hasattr(docs, "_folder"):
            scratch.drop(docs)
        docs = done
    return drawn(docs)
