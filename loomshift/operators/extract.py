"""Facts read out of texts: filters, parameters, scheduler events, functions, errors."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift import fixed
from loomshift.functions import text

# task functions travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(fixed)


def literal_map(rules: Mapping[str, str]) -> Column:
    """A mapping as one constant, whatever its size: read from a text when the plan is made."""
    return F.from_json(F.lit(json.dumps(dict(rules))), "map<string,string>")


# --- injected filters ---------------------------------------------------------


def filters_in(col: str = "content") -> Column:
    """Array of struct(name, predicate) for each `set hivevar:name=...;`, in text order."""
    names = F.regexp_extract_all(col, F.lit(fixed.HIVEVAR_FILTER), F.lit(1))
    bodies = F.transform(F.regexp_extract_all(col, F.lit(fixed.HIVEVAR_FILTER), F.lit(2)), text.strip)
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("predicate")))


def filter_rows(files: DataFrame) -> DataFrame:
    found = files.select("rel_path", F.posexplode(filters_in()).alias("pos", "f"))
    return found.select("rel_path", (F.col("pos") + 1).cast("bigint").alias("position"), "f.name", "f.predicate")


def filter_note(col: str = "content") -> Column:
    found = filters_in(col)
    names = F.array_join(F.transform(found, lambda f: f["name"]), ", ")
    return F.concat(F.lit("Defines "), F.size(found).cast("string"), F.lit(" injectable filters: "), names)


def inject_filters(df: DataFrame, filters: Sequence[tuple[str, str]]) -> DataFrame:
    """All named predicates, ANDed."""
    for _, predicate in filters:
        df = df.where(F.expr(predicate))
    return df


# --- run parameters -------------------------------------------------------------


def parameters(files: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Distinct @names per file with their type, STRING when not given."""
    known = literal_map(types)
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(fixed.PARAMETER), F.lit(1))))
    rows = files.select("rel_path", F.explode(names).alias("name"))
    return rows.withColumn("type", F.coalesce(F.try_element_at(known, F.col("name")), F.lit("STRING")))


def type_hints(errors: DataFrame, current: DataFrame) -> DataFrame:
    """Parameter types that an error text asks for: errors(rel_path, error), current(rel_path, name, type).

    Kept when the file uses the parameter, the type is allowed and differs.
    """
    hints = errors.where(F.col("error").rlike(fixed.PARAMETER_TYPE_ERROR)).select(
        "rel_path",
        F.regexp_extract("error", fixed.PARAMETER_TYPE_ERROR, 1).alias("name"),
        F.upper(F.regexp_extract("error", fixed.PARAMETER_TYPE_ERROR, 2)).alias("expected"),
    )
    allowed = hints.where(F.col("expected").isin(fixed.PARAMETER_TYPES))
    return allowed.join(current, ["rel_path", "name"]).where("expected <> type")


# --- scheduler events -------------------------------------------------------------

EVENT_SCHEMA = (
    "EventId string, Description string, "
    "Schedule struct<Expression:string,TimeZone:string>, "
    "Action struct<Command:string,TimeoutMinutes:string,RunAsUser:string>, "
    "Dependency array<string>, Dependencies struct<Dependency:array<string>>, "
    "OnFailure struct<RetryCount:string,RetryDelayMinutes:string,Email:string>, "
    "RetryCount string, RetryDelayMinutes string, Email string, "
    "OnSuccess struct<PublishEvent:string>, broken string"
)


def struct_fields(ddl: str) -> str:
    """The fields of a schema as they are written inside a struct."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def _parsed(schema: str, content: str = "content") -> Column:
    return F.from_xml(content, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def _event_id(broken: Column, content: str, path: str) -> Column:
    """The first EventId at any depth, else the name of the file."""
    found = F.when(~broken & F.col(content).contains("<EventId"), F.xpath_string(content, F.lit("//EventId")))
    return F.coalesce(F.nullif(found, F.lit("")), text.stem(path))


def event_note(content: str = "content", path: str = "rel_path") -> Column:
    e = _parsed("EventId string, broken string", content)
    broken = e.isNull() | e["broken"].isNotNull()
    event_id = _event_id(broken, content, path)
    return F.when(broken, F.lit(fixed.NOTE_XML)).otherwise(F.concat(F.lit("Event: "), event_id))


def events(files: DataFrame) -> DataFrame:
    """One row per scheduler file; malformed XML gives a note, not an error.

    The event is the root, or the first Event below it.
    """
    nested = EVENT_SCHEMA.removesuffix(", broken string")
    parsed = files.withColumn("r", _parsed(f"{nested}, Event array<struct<{struct_fields(nested)}>>, broken string"))
    root = F.col("r")
    below = F.get(root["Event"], F.lit(0))
    names = [f.name for f in T.StructType.fromDDL(nested)]
    event = F.struct(*[F.when(below.isNotNull(), below[n]).otherwise(root[n]).alias(n) for n in names], root["broken"].alias("broken"))
    parsed = parsed.withColumn("e", F.when(root.isNotNull(), event))
    broken = F.col("e").isNull() | F.col("e.broken").isNotNull()

    def whole(col: Column) -> Column:
        return col.try_cast("bigint")

    event_id = _event_id(broken, "content", "rel_path")
    ids = F.when(broken, F.array().cast("array<string>")).otherwise(
        F.coalesce("e.Dependency", "e.Dependencies.Dependency", F.array().cast("array<string>"))
    )

    def known(name: str) -> Column:
        return F.when(~broken, F.col(name))

    return parsed.select(
        "rel_path",
        event_id.alias("event_id"),
        F.lower(event_id).alias("dag_id"),
        known("e.Description").alias("description"),
        known("e.Schedule.Expression").alias("schedule"),
        known("e.Schedule.TimeZone").alias("time_zone"),
        known("e.Action.Command").alias("command"),
        whole(known("e.Action.TimeoutMinutes")).alias("timeout_minutes"),
        known("e.Action.RunAsUser").alias("run_as_user"),
        ids.alias("dependencies"),
        whole(F.coalesce(known("e.OnFailure.RetryCount"), known("e.RetryCount"))).alias("retry_count"),
        whole(F.coalesce(known("e.OnFailure.RetryDelayMinutes"), known("e.RetryDelayMinutes"))).alias("retry_delay_minutes"),
        F.coalesce(known("e.OnFailure.Email"), known("e.Email")).alias("email"),
        known("e.OnSuccess.PublishEvent").alias("publish_event"),
        F.when(broken, F.lit(fixed.NOTE_XML)).otherwise(F.concat(F.lit("Event: "), event_id)).alias("note"),
    )


def dependency_edges(found: DataFrame) -> DataFrame:
    """(upstream, downstream) as the waiting side states it."""
    return found.select(F.explode("dependencies").alias("upstream"), F.col("event_id").alias("downstream")).distinct()


def publish_edges(found: DataFrame) -> DataFrame:
    """(upstream, downstream) as the publishing side states it."""
    known = found.where(F.col("publish_event").isNotNull())
    return known.select(F.col("event_id").alias("upstream"), F.col("publish_event").alias("downstream")).distinct()


def missing_upstream(found: DataFrame) -> DataFrame:
    """Dependencies that name no existing event."""
    known = found.select(F.col("event_id").alias("upstream")).distinct()
    return dependency_edges(found).join(known, "upstream", "left_anti").select("downstream", "upstream")


def known_upstream(found: DataFrame) -> DataFrame:
    known = found.select(F.col("event_id").alias("upstream")).distinct()
    return dependency_edges(found).join(known, "upstream", "left_semi").select("downstream", "upstream")


def reconcile_edges(found: DataFrame) -> DataFrame:
    """Every edge with who states it: both, publish_only or depend_only."""
    published = publish_edges(found).withColumn("p", F.lit(True))
    waited = dependency_edges(found).withColumn("d", F.lit(True))
    status = (
        F.when(F.col("p").isNotNull() & F.col("d").isNotNull(), "both")
        .when(F.col("p").isNotNull(), "publish_only")
        .otherwise("depend_only")
    )
    return published.join(waited, ["upstream", "downstream"], "full").select("upstream", "downstream", status.alias("status"))


# --- functions, configuration, errors -----------------------------------------------


def function_usage(files: DataFrame, names: Sequence[str] = fixed.CATALOGUE) -> DataFrame:
    """How often each catalogued function is called in each file; no shuffle, a file is one row."""
    found = F.regexp_extract_all("content", F.lit(r"\b(\w++)\s*+\("), F.lit(1))
    calls = F.when(F.col("content").contains("("), F.transform(found, F.lower))
    listed = F.filter(calls, lambda c: c.isin(list(names)))
    per_file = F.transform(
        F.array_distinct("calls"),
        lambda f: F.struct(f.alias("function"), F.size(F.filter("calls", lambda c: c == f)).cast("bigint").alias("uses")),
    )
    return files.select("rel_path", listed.alias("calls")).select("rel_path", F.inline(per_file))


def config_entries(files: DataFrame, dataset_map: Mapping[str, str]) -> DataFrame:
    """key=value lines with what becomes of them: kept, renamed or removed."""
    renames = dict(fixed.CONFIG_RENAMES) | {k: k.upper() + "_DATASET" for k in dataset_map}
    values = dict(fixed.CONFIG_VALUES) | dict(dataset_map)
    new_names, new_values = literal_map(renames), literal_map(values)
    entry = r"^(\w+)=(.*)$"
    rows = files.select("rel_path", F.posexplode(text.lines("content")).alias("pos", "line")).where(F.col("line").rlike(entry))
    split = rows.select(
        "rel_path",
        (F.col("pos") + 1).cast("bigint").alias("line_no"),
        F.regexp_extract("line", entry, 1).alias("old_key"),
        F.regexp_extract("line", entry, 2).alias("old_value"),
    )
    removed = F.col("old_key").isin(fixed.CONFIG_REMOVED)
    renamed = F.try_element_at(new_names, F.col("old_key"))
    return split.select(
        "rel_path",
        "line_no",
        "old_key",
        F.when(removed, F.lit("removed")).when(renamed.isNotNull(), F.lit("renamed")).otherwise(F.lit("kept")).alias("action"),
        F.when(removed, F.lit(fixed.REMOVED_NOTE)).otherwise(
            F.concat(F.coalesce(renamed, "old_key"), F.lit("="), F.coalesce(F.try_element_at(new_values, F.col("old_key")), "old_value"))
        ).alias("new_line"),
    )


def error_class(stage: str = "error_type", col: str = "error") -> Column:
    """What kind of repair an error asks for; stage is SYNTAX, BQ_DRY_RUN, PYTEST or TODO_REVIEW."""
    s, e = F.col(stage), F.col(col)
    dry, tests = s == "BQ_DRY_RUN", s == "PYTEST"
    rules = [(dry, p, c) for p, c in fixed.DRY_RUN_ERRORS] + [(tests, p, c) for p, c in fixed.TEST_ERRORS]
    found = F.coalesce(*[F.when(where & e.rlike(phrase), kind) for where, phrase, kind in rules])
    return F.coalesce(found, F.when(s == "SYNTAX", "syntax").when(s == "TODO_REVIEW", "todo").when(dry | tests, "other"))


def clean_error(col: str = "error") -> Column:
    """Without the transport prefix that starts 400, 403 or 404."""
    parts = F.split(col, ": ", 3)
    prefixed = F.get(parts, F.lit(0)).rlike("^(?:400|403|404)") & (F.size(parts) >= 3)
    return F.when(prefixed, F.get(parts, F.lit(2))).otherwise(F.col(col))


# --- Python syntax --------------------------------------------------------------------


def _parse_error(source: str, name: str) -> str | None:
    """Parses, never runs."""
    try:
        compile(source, name, "exec", dont_inherit=True)
    except SyntaxError as e:
        return f"{fixed.SYNTAX_ERROR}{e.msg}" + (f" (line {e.lineno})" if e.lineno else "")
    except Exception as e:
        return f"{fixed.COMPILE_ERROR}{type(e).__name__}: {e}"
    return None


def python_syntax(files: DataFrame) -> DataFrame:
    """rel_path, language, error (NULL when the text parses) for Python files."""
    scripts = files.where(text.suffix("rel_path") == ".py").select("rel_path", "content")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import warnings

        warnings.simplefilter("ignore")
        for batch in batches:
            found = [_parse_error(s, n) for s, n in zip(batch["content"], batch["rel_path"])]
            yield pd.DataFrame({"rel_path": batch["rel_path"], "error": pd.Series(found, dtype="object")})

    checked = scripts.mapInPandas(check, "rel_path string, error string")
    return checked.select("rel_path", F.lit("python").alias("language"), "error")


def syntax_tally(checked: DataFrame) -> DataFrame:
    return checked.groupBy("language").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
