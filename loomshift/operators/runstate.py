"""Run state of a migration: merge, validation outcome, report, fix rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomshift import fixed
from loomshift.functions import text
from loomshift.operators import extract


def merge_state(old: DataFrame, new: DataFrame, key: str = "rel_path") -> DataFrame:
    """New rows replace old ones with the same key; the others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def attach_validation(conversions: DataFrame, validations: DataFrame) -> DataFrame:
    """Outcome of validations(output_path, success, error), errors without their transport prefix; files not validated keep
    what they had."""
    # a path validated twice counts as failed when one run failed
    outcome = validations.groupBy("output_path").agg(
        F.bool_and("success").alias("__ok"), F.min(F.when(~F.col("success"), extract.clean_error())).alias("__err")
    )
    joined = conversions.join(outcome, "output_path", "left")
    touched = F.col("__ok").isNotNull()
    return joined.withColumns(
        {
            "validation_passed": F.when(touched, F.col("__ok")).otherwise(F.col("validation_passed")),
            "validation_error": F.when(touched, F.col("__err")).otherwise(F.col("validation_error")),
        }
    ).drop("__ok", "__err")


def source_lookup(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """First existing source of each converted path, NULL when there is none."""
    out = F.col("output_path")
    suffix = text.suffix("output_path")

    def candidate(kind: str, key, rank: int):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rank).alias("rank"))

    def sibling(ext: str, rank: int):
        return candidate("path", text.with_suffix("output_path", ext), rank)

    same = candidate("path", out, 1)
    xml = candidate("name", F.concat(text.stem("output_path"), F.lit(".xml")), 2)
    options = (
        F.when(suffix == ".sql", F.array(sibling(".hql", 1), sibling(".hdl", 2)))
        .when((suffix == ".py") & F.startswith(out, F.lit("dags/")), F.array(same, xml))
        .when(suffix == ".sh", F.array(same, sibling(".ksh", 2)))
        .otherwise(F.array(same))
    )
    name = F.substring_index("rel_path", "/", -1)
    # one source per key, so the join adds no rows however often a name repeats
    by_path = files.select(F.lit("path").alias("kind"), F.col("rel_path").alias("key"), "rel_path")
    by_name = files.select(F.lit("name").alias("kind"), name.alias("key"), "rel_path").where(F.col("key").endswith(".xml"))
    sources = by_path.unionByName(by_name).groupBy("kind", "key").agg(F.min("rel_path").alias("source"))
    asked = outputs.select("output_path").distinct().select("output_path", F.explode(options).alias("c"))
    hits = asked.select("output_path", "c.kind", "c.key", "c.rank").join(sources, ["kind", "key"], "left")
    best = F.min_by("source", F.when(F.col("source").isNotNull(), F.col("rank")))
    return hits.groupBy("output_path").agg(best.alias("source"))


# --- report -------------------------------------------------------------------


def discovery_counts(classified: DataFrame) -> DataFrame:
    """Files per type, with a total of targets and of skipped files."""
    per_type = classified.groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("file_type") == "skip", "skipped").otherwise("targets")
    totals = per_type.groupBy(kind.alias("entry")).agg(F.sum("n").alias("n"))
    rows = per_type.where("file_type <> 'skip'").select(F.concat(F.lit("type:"), "file_type").alias("entry"), "n")
    return totals.unionByName(rows)


def first_targets(classified: DataFrame, limit: int = fixed.TARGET_LIMIT) -> DataFrame:
    """The first targets in order of path; beyond the limit a row without a path tells how many more there are (`more`)."""
    targets = classified.where("file_type <> 'skip'").select("file_type", "rel_path")
    shown = targets.orderBy("rel_path").limit(limit).withColumn("more", F.lit(None).cast("bigint"))
    left = targets.agg((F.count(F.lit(1)) - limit).alias("more")).where("more > 0")
    none = F.lit(None).cast("string")
    return shown.unionByName(left.select(none.alias("file_type"), none.alias("rel_path"), "more"))


def first_flagged(conversions: DataFrame, limit: int = fixed.FLAGGED_LIMIT) -> DataFrame:
    """The first files with errors or for review, each with its first note; beyond the limit a row tells how many more there are."""
    flagged = conversions.where(F.col("status").isin("error", "review"))
    shown = flagged.select("status", "rel_path", F.get("notes", F.lit(0)).alias("note")).orderBy("rel_path").limit(limit)
    left = flagged.agg((F.count(F.lit(1)) - limit).alias("more")).where("more > 0")
    more = left.select(F.lit("more").alias("status"), F.lit(None).cast("string").alias("rel_path"),
                       F.concat(F.lit("... ["), F.col("more").cast("string"), F.lit(fixed.MORE_FLAGGED)).alias("note"))
    return shown.unionByName(more)


def summary(conversions: DataFrame, keys: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """The six counts of the report, over all files or by the keys; validation is counted for `converted` files only."""
    status, passed = F.col("status"), F.col("validation_passed")
    return conversions.groupBy(*keys).agg(
        *more,
        F.count_if(status.isin("converted", "review")).alias("files_converted"),
        F.count_if((status == "converted") & passed).alias("dry_run_passed"),
        F.count_if((status == "converted") & ~passed).alias("dry_run_failed"),
        F.count_if(status == "review").alias("needs_review"),
        F.count_if(status == "error").alias("errors"),
        F.count_if(status == "skipped").alias("skipped"),
    )


def validation_tally(validations: DataFrame) -> DataFrame:
    ok = F.col("success")
    return validations.agg(
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes_processed"))), F.lit(0)).alias("bytes_passed"),
    )


def listing(conversions: DataFrame) -> DataFrame:
    """One row per file of the report: section, label and error text."""
    passed = F.col("validation_passed")
    label = F.when(passed, "validated").when(~passed, "failed").otherwise("skipped")
    section = (
        F.when(F.col("status") == "converted", "converted")
        .when(F.col("status") == "review", "needs review")
        .when(F.col("status") == "error", "conversion errors")
    )
    listed = conversions.where(F.col("status") != "skipped")
    return listed.select(
        "rel_path", "file_type", section.alias("section"), label.alias("label"),
        F.when((F.col("status") == "converted") & ~passed, F.col("validation_error")).alias("error"),
        "notes",
    )


def listing_notes(conversions: DataFrame) -> DataFrame:
    rows = listing(conversions).select("rel_path", "section", F.posexplode("notes").alias("pos", "note"))
    return rows.select("rel_path", "section", (F.col("pos") + 1).cast("bigint").alias("position"), "note")


def error_log(validations: DataFrame) -> DataFrame:
    """A text block per failed file."""
    rule = "-" * 64
    block = F.concat(F.lit("FILE: "), F.col("output_path"), F.lit(f"\n{rule}\n"), extract.clean_error(), F.lit("\n"))
    return validations.where(~F.col("success")).select("output_path", block.alias("value"))


def fix_rounds(failures: DataFrame, keys: list[str], max_rounds: int = fixed.MAX_FIX_ROUNDS) -> DataFrame:
    """Which repair rounds run: failures(keys, round, failures), round 0 before any repair.

    A round runs while failures are left and the count dropped in the round
    before, at most `max_rounds` times.
    """
    # one row per round and group, few by nature
    per_group = Window.partitionBy(*keys).orderBy("round")
    before = F.lag("failures").over(per_group)
    stuck = F.coalesce((F.col("failures") >= before) | (F.col("failures") == 0), F.lit(False))
    marked = failures.withColumn("previous", before).withColumn("__stuck", stuck)
    stopped = F.max("__stuck").over(per_group.rowsBetween(Window.unboundedPreceding, -1))
    runs = (F.col("round") <= max_rounds) & ~F.coalesce(stopped, F.lit(False))
    return marked.withColumn("ran", runs).withColumn(
        "progress", F.when(F.col("previous").isNotNull(), F.col("failures") < F.col("previous"))
    ).drop("__stuck")
