"""Operators over a table of files (rel_path, content): classify, select, search, edit."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift import fixed
from loomshift.functions import text
from loomshift.session import stored
from loomshift.sources import readers


def visible(files: DataFrame) -> DataFrame:
    """Without paths that have a part starting with a dot."""
    return files.where(~F.exists(F.split("rel_path", "/"), lambda p: F.startswith(p, F.lit("."))))


def file_type(scheduler_dirs: Sequence[str] = fixed.SCHEDULER_DIRS, test_dirs: Sequence[str] = fixed.TEST_DIRS) -> Column:
    parts = F.split(F.lower("rel_path"), "/")
    suffix = text.suffix("rel_path")

    def below(dirs):
        return F.arrays_overlap(parts, F.array(*[F.lit(d.lower()) for d in dirs]))

    content = F.col("content")
    spark_job = content.contains("SparkSession") | F.lower(content).contains("pyspark")
    return (
        F.when(suffix == ".hql", "hql")
        .when(suffix == ".hdl", "hdl")
        .when(suffix.isin(".sh", ".ksh"), "shell")
        .when((suffix == ".config") & content.contains("hivevar:"), "filters")
        .when(suffix == ".config", "config")
        .when((suffix == ".xml") & below(scheduler_dirs), "dag_xml")
        .when((suffix == ".py") & below(test_dirs), "test")
        .when((suffix == ".py") & spark_job, "pyspark")
        .otherwise("skip")
    )


def classify(files: DataFrame, scheduler_dirs: Sequence[str] = fixed.SCHEDULER_DIRS,
             test_dirs: Sequence[str] = fixed.TEST_DIRS) -> DataFrame:
    return visible(files).withColumn("file_type", file_type(scheduler_dirs, test_dirs))


def targets(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("file_type") != "skip")


def work_list(classified: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths, as they were asked for, with the type of the file they lead to and a status; bad requests stay as rows."""
    wanted = requested.select("rel_path").distinct().withColumn("__path", resolved("rel_path"))
    outside = F.col("__path").isNull()
    found = classified.select(F.col("rel_path").alias("__path"), "file_type")
    status = (
        F.when(outside, "outside the repository")
        .when(F.col("file_type").isNull(), "not found")
        .when(F.col("file_type") == "skip", "not a target")
        .otherwise("ok")
    )
    return wanted.join(found, "__path", "left").select("rel_path", "file_type", status.alias("status"))


def resolved(col: str) -> Column:
    """A relative path without `.` and `..` parts; NULL when it leaves the repository."""
    parts = F.filter(F.split(col, "/"), lambda p: ~p.isin("", "."))
    start = F.array().cast("array<string>")
    # a step up from the top makes the whole path NULL
    walked = F.aggregate(parts, start, lambda at, p: F.when(p != "..", F.concat(at, F.array(p)))
                         .when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1)))
    return F.when(~F.startswith(col, F.lit("/")), F.array_join(walked, "/"))


def output_path() -> Column:
    """Where a converted file lands: same tree, new suffix; scheduler files flat below dags/."""
    flat = [t for t, (_, dags) in fixed.OUTPUTS.items() if dags]
    kind = F.col("file_type")
    suffix = F.create_map(*[F.lit(x) for t, (ext, _) in fixed.OUTPUTS.items() for x in (t, ext)])
    base = F.when(kind.isin(flat), F.concat(F.lit("dags/"), text.stem("rel_path"))).otherwise(F.col("rel_path"))
    return text.with_suffix(base, F.try_element_at(suffix, kind))


def with_output_path(classified: DataFrame) -> DataFrame:
    return targets(classified).withColumn("output_path", output_path())


def output_collisions(planned: DataFrame) -> DataFrame:
    """Output paths that more than one source would write."""
    return (
        planned.groupBy("output_path")
        .agg(F.count(F.lit(1)).alias("sources"), F.min("rel_path").alias("first_source"),
             F.max("rel_path").alias("last_source"))
        .where("sources > 1")
    )


def review(kind, converted, source_notes: Column | None = None) -> tuple[Column, Column]:
    """(needs_review, notes) for a converted text of one file type."""
    kind, converted = F.col(kind), F.col(converted)
    todo = converted.contains("TODO:")
    hivevar = converted.contains("${hivevar:")
    residual = todo | F.lower(converted).contains("pyspark")
    needs = (
        F.when(kind == "hql", todo | hivevar)
        .when(kind.isin("hdl", "shell", "config"), todo)
        .when(kind.isin("pyspark", "test"), residual)
        .when(kind == "dag_xml", True)
        .otherwise(False)
    )
    candidates = [
        F.when(kind.isin("hql", "hdl", "shell", "config") & todo, fixed.NOTE_TODO),
        F.when((kind == "hql") & hivevar, fixed.NOTE_HIVEVAR),
        F.when((kind == "pyspark") & residual, fixed.NOTE_PYSPARK),
        F.when(kind == "test", fixed.NOTE_TESTS),
        F.when((kind == "test") & residual, fixed.NOTE_TODO),
        F.when(kind == "dag_xml", fixed.NOTE_DAG),
        F.when((kind == "dag_xml") & converted.contains("ExternalTaskSensor"), fixed.NOTE_SENSOR),
        F.when(kind == "filters", fixed.NOTE_FILTERS),
    ]
    notes = F.array_compact(F.array(*candidates))
    if source_notes is not None:
        notes = F.concat(F.coalesce(source_notes, F.array().cast("array<string>")), notes)
    return needs, notes


def review_flags(df: DataFrame, kind: str = "file_type", converted: str = "content",
                 source_notes: Column | None = None) -> DataFrame:
    needs, notes = review(kind, converted, source_notes)
    return df.withColumn("needs_review", needs).withColumn("notes", notes)


# --- listing and search -------------------------------------------------------


def glob_list(files: DataFrame, pattern: str, limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """Matching paths in order, at most `limit`, then one row with the number left out."""
    matches = files.where(F.col("rel_path").rlike(text.glob_pattern(pattern))).select("rel_path")
    shown = matches.orderBy("rel_path").limit(limit).select(F.lit("file").alias("kind"), F.col("rel_path").alias("entry"))
    left = matches.agg((F.count(F.lit(1)) - limit).alias("more")).where("more > 0")
    rest = left.select(
        F.lit("more").alias("kind"),
        F.concat(F.lit("... ["), F.col("more").cast("string"), F.lit(" more — narrow the pattern]")).alias("entry"),
    )
    return shown.unionByName(rest)


def numbered_lines(df: DataFrame, col: str = "content") -> DataFrame:
    """One row per line; line_no counts from 1."""
    keep = [c for c in df.columns if c != col]
    exploded = df.select(*keep, F.posexplode(text.lines(col)).alias("pos", "line"))
    return exploded.select(*keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


# anchors, lookarounds and possessive parts can match a line but not the text around it
_LINE_BOUND = re.compile(r"(?<!\[)\^|\$|\(\?|\\[AZzGR]|[*+?}]\+")


def search_lines(files: DataFrame, pattern: str, glob: str = "**/*") -> DataFrame:
    """Every line that matches: rel_path, line_no, hit."""
    scoped = files.where(F.col("rel_path").rlike(text.glob_pattern(glob)))
    candidates = scoped.select("rel_path", "content")
    if not _LINE_BOUND.search(pattern):
        # texts without any match never reach the explode
        candidates = candidates.where(F.col("content").rlike(pattern))
    hits = numbered_lines(candidates).where(F.col("line").rlike(pattern))
    return hits.select("rel_path", "line_no", F.substring(text.strip("line"), 1, fixed.HIT_CHARS).alias("hit"))


ROUND_FILES = 2_000   # files of the first round of a search that ends early
MOST_FILES = 20_000   # a round of more files than that is the rest, in one scan
SHOWN_NAMES = 250     # names that a task gives the driver to place the end of a round


def grep(files: DataFrame, pattern: str, glob: str = "**/*", limit: int = fixed.HIT_LIMIT, first: int = ROUND_FILES) -> DataFrame:
    """The first hits in path order; at the limit a last row (without a path) says that the answer is cut.

    Files are read in ranges of the path order until the limit is met. The range is a condition on `rel_path`: it reaches the
    scan of a table that has the column, which then skips row groups of other paths, and elsewhere the content of other files
    is not worked out.
    """

    def read(low: str | None, high: str | None) -> DataFrame:
        return _between(files, low, high)

    return _in_rounds(files.select("rel_path"), read, pattern, glob, limit, first)


def grep_tree(spark: SparkSession, root: str, pattern: str, glob: str = "**/*", limit: int = fixed.HIT_LIMIT,
              first: int = ROUND_FILES) -> DataFrame:
    """As `grep`, over the files below a folder: one listing, and only the files of the ranges looked at are opened."""
    listed = stored(readers.list_files(spark, root).select("rel_path", "path", "size"), "listing")

    def read(low: str | None, high: str | None) -> DataFrame:
        return readers.open_files(spark, root, _between(listed, low, high))

    return _in_rounds(listed.select("rel_path"), read, pattern, glob, limit, first)


def _between(rows: DataFrame, low: str | None, high: str | None) -> DataFrame:
    above = rows if low is None else rows.where(F.col("rel_path") > low)
    return above if high is None else above.where(F.col("rel_path") <= high)


def _in_rounds(paths: DataFrame, read: Callable[[str | None, str | None], DataFrame], pattern: str, glob: str, limit: int, first: int) -> DataFrame:
    """Searches the next files in path order, each round some eight times as many, and stops at the limit; past MOST_FILES the rest is
    one round. A round costs a pass over the paths alone; where it ends is told by the paths whose hash falls into one of some
    classes, so that each task names SHOWN_NAMES of them at most."""
    inside = paths.where(F.col("rel_path").rlike(text.glob_pattern(glob)))
    low, n, left, shown = None, first, limit, []
    while left > 0:
        high = None
        if n <= MOST_FILES:
            classes = -(-n // SHOWN_NAMES)
            some = _between(inside, low, None).where(F.pmod(F.xxhash64("rel_path"), F.lit(classes)) == 0)
            names = some.orderBy("rel_path").limit(n // classes).collect()
            high = names[-1].rel_path if len(names) == n // classes else None
        hits = search_lines(read(low, high), pattern, glob).orderBy("rel_path", "line_no").limit(left)
        shown.append(stored(hits, "hits"))
        if high is None:
            break
        left -= shown[-1].count()
        low, n = high, n * 8
    found = reduce(DataFrame.unionByName, shown) if shown else search_lines(read(None, None).limit(0), pattern, glob)
    full = found.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    note = full.select(F.lit(None).cast("string").alias("rel_path"), F.lit(None).cast("bigint").alias("line_no"), F.lit(fixed.HITS_CUT).alias("hit"))
    # at most `limit` rows
    return found.orderBy("rel_path", "line_no").limit(max(limit, 1)).unionByName(note)


def line_window(files: DataFrame, offset: int = 0, limit: int = fixed.LINE_LIMIT) -> DataFrame:
    """Per file the lines from a 0-based offset, numbered from 1, and how many follow."""
    all_lines = text.lines("content")
    sized = files.select("rel_path", all_lines.alias("lines")).withColumn("n", F.size("lines").cast("bigint"))
    cut = sized.select(
        "rel_path",
        F.greatest(F.col("n") - F.lit(offset + limit), F.lit(0).cast("bigint")).alias("more"),
        F.posexplode(F.slice("lines", offset + 1, limit)).alias("pos", "line"),
    )
    return cut.select("rel_path", (F.col("pos") + offset + 1).cast("bigint").alias("line_no"), "line", "more")


def bulk_replace(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Exact-text edits: edits(rel_path, edit_no, old, new, replace_all), those of a path in the order of edit_no.

    An edit that fails changes nothing, and the next one goes on from there. One row per path with edits: rel_path,
    content (NULL for an unknown file), replaced (over all edits), statuses (one per edit) and status (the first that is not "edited").
    """
    entry = F.struct("edit_no", "old", "new", "replace_all")
    per_path = edits.groupBy("rel_path").agg(F.array_sort(F.collect_list(entry)).alias("edits"))
    none = F.array().cast("array<string>")
    start = F.struct(F.col("content").alias("content"), F.lit(0).cast("bigint").alias("replaced"), none.alias("statuses"))

    def apply(done: Column, edit: Column) -> Column:
        n = text.occurrences(done["content"], edit["old"])
        status = (
            F.when(done["content"].isNull(), "file not found")
            .when(edit["old"] == "", "empty search text")
            .when(n == 0, "not found")
            .when((n > 1) & ~edit["replace_all"], "not unique")
            .otherwise("edited")
        )
        edited = status == "edited"
        return F.struct(
            F.when(edited, F.replace(done["content"], edit["old"], edit["new"])).otherwise(done["content"]).alias("content"),
            (done["replaced"] + F.when(edited, n).otherwise(0)).alias("replaced"),
            F.concat(done["statuses"], F.array(status)).alias("statuses"),
        )

    joined = per_path.join(files.select("rel_path", "content"), "rel_path", "left")
    folded = joined.select("rel_path", F.aggregate("edits", start, apply).alias("e"))
    failed = F.filter("e.statuses", lambda s: s != "edited")
    return folded.select("rel_path", "e.content", "e.replaced", "e.statuses", F.coalesce(F.get(failed, F.lit(0)), F.lit("edited")).alias("status"))


def strip_settings(col: str = "content") -> Column:
    """Without SET hive/mapred lines and USE ${...} statements."""
    no_set = F.regexp_replace(col, r"(?im)^[ \t]*SET[ \t]+(?:mapreduce|hive|mapred)\.[^\n]*(?:\n|\z)", "")
    return F.regexp_replace(no_set, r"USE\s+\$\{\w+\};?\s*\n?", "")


def header_stamp(col: str = "content", path: str = "rel_path", kind: str = "file_type") -> Column:
    """A first line that names the source file, unless it is there already."""
    mark = F.when(F.col(kind).isin("hql", "hdl"), "--").otherwise("#")
    line = F.concat(mark, F.lit(" Converted from: "), F.substring_index(F.col(path), "/", -1))
    return F.when(F.startswith(F.col(col), line), F.col(col)).otherwise(F.concat(line, F.lit("\n"), F.col(col)))


def looks_like_ddl(col: str = "content") -> Column:
    """DDL by its opening words; comment lines in front are skipped."""
    body = F.regexp_replace(col, r"\A(?:\s*--[^\n]*(?:\n|\z))*\s*", "")
    opening = F.upper(F.substring(body, 1, max(len(p) for p in fixed.DDL_PREFIXES)))
    found = F.startswith(opening, F.lit(fixed.DDL_PREFIXES[0]))
    for prefix in fixed.DDL_PREFIXES[1:]:
        found = found | F.startswith(opening, F.lit(prefix))
    return found


def sql_outputs(converted: DataFrame) -> DataFrame:
    """Converted SQL files that are not below a dags folder."""
    parts = F.split("output_path", "/")
    return converted.where((text.suffix("output_path") == ".sql") & ~F.array_contains(parts, "dags"))


def requested_sql(converted: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested outputs, named with or without .sql, with a status; unknown ones stay as rows."""
    named = F.when(text.suffix("output_path") == ".sql", F.col("output_path")).otherwise(text.with_suffix("output_path", ".sql"))
    wanted = requested.select(named.alias("output_path")).distinct()
    known = converted.select("output_path").distinct().withColumn("__known", F.lit(True))
    status = F.when(F.col("__known"), "ok").otherwise("not found")
    return wanted.join(known, "output_path", "left").select("output_path", status.alias("status"))


def ddl_files(converted: DataFrame, is_ddl: Column | None = None) -> DataFrame:
    """Files recorded as DDL; only when the state names none, files whose text looks like DDL.

    `is_ddl` stands in for the text when it was looked at before.
    """
    is_ddl = looks_like_ddl() if is_ddl is None else is_ddl
    recorded = F.col("file_type") == "hdl"
    any_recorded = converted.agg(F.coalesce(F.bool_or(recorded), F.lit(False)).alias("x")).scalar()
    detected = (text.suffix("output_path") == ".sql") & ~F.array_contains(F.split("output_path", "/"), "dags") & is_ddl
    return converted.where(F.when(any_recorded, recorded).otherwise(detected))
