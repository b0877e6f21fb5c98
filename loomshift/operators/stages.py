"""The migration as stages: each takes and returns a DataFrame, so a run is a chain of
`transform` calls and one stage can run alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.operators import corpus, mapping, runstate


def discover(files: DataFrame) -> DataFrame:
    """Visible files with their type and, for targets, their output path."""
    return corpus.classify(files).withColumn("output_path", F.when(F.col("file_type") != "skip", corpus.output_path()))


def convert(discovered: DataFrame, dataset_map: Mapping[str, str] | DataFrame, path_map: Mapping[str, str] | DataFrame,
            project: str = mapping.PROJECT, bucket: str = mapping.BUCKET) -> DataFrame:
    """Run state rows of all targets, with the rewritten text and the review flags.

    The mappings are dicts or tables, datasets(hive_name, dataset) and prefixes(prefix, target), of any size."""
    rewritten = mapping.rewrite(corpus.targets(discovered), dataset_map, path_map, project, bucket)
    flagged = corpus.review_flags(rewritten, converted="converted", source_notes=F.col("source_notes"))
    return flagged.select(
        "rel_path", "file_type", "output_path",
        F.when(F.col("needs_review"), "review").otherwise("converted").alias("status"), "notes", "converted",
        F.lit(None).cast("boolean").alias("validation_passed"), F.lit(None).cast("string").alias("validation_error"),
    )


def validate(state: DataFrame, validations: DataFrame) -> DataFrame:
    """Outcomes of an outside validator, attached by output path."""
    return runstate.attach_validation(state, validations)


def report(state: DataFrame, keys: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """The counts of the run, over all files or by the keys."""
    return runstate.summary(state, keys, more)
