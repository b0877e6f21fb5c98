"""Lookups and rewrites driven by mapping tables: datasets, paths, names.

Rules are a dict, which becomes one constant, or a column that holds a map per row: `with_rules` finds in a table of any
size the rules that occur in each file, so the same rewrites serve both.
"""

from __future__ import annotations

import os.path
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift import fixed
from loomshift.functions import text
from loomshift.operators import extract
from loomshift.session import stored

BUCKET = fixed.DEFAULT_BUCKET
PROJECT = fixed.DEFAULT_PROJECT


_literal_map = extract.literal_map
Rules = Mapping[str, str] | Column


def _target(rules: Rules, key: Column) -> Column:
    """What the rules have for a key, else NULL."""
    return F.try_element_at(rules if isinstance(rules, Column) else _literal_map(rules), key)


def _longest_first(names) -> list[str]:
    return sorted(names, key=lambda n: (-len(n), n))


# --- datasets ---------------------------------------------------------------


def dataset_of(col, dataset_map: Rules) -> Column:
    name = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_target(dataset_map, name), name)


def dataset_lookup(df: DataFrame, name: str, datasets: DataFrame, out: str = "dataset") -> DataFrame:
    """Join form: datasets(hive_name, dataset); unmapped names stay as they are."""
    # the left side keeps its rows: one mapping per name
    unique = datasets.groupBy(F.col("hive_name").alias("__h")).agg(F.max("dataset").alias("__d"))
    return (
        df.join(unique, F.col(name) == F.col("__h"), "left")
        .withColumn(out, F.coalesce("__d", name))
        .drop("__h", "__d")
    )


# --- paths ------------------------------------------------------------------


def map_path(col, path_map: Rules, bucket: str = BUCKET, boundary: bool = False) -> Column:
    """Longest prefix wins; a path without one goes below the bucket."""
    path = F.col(col) if isinstance(col, str) else col

    def at(n: Column) -> Column:
        head = F.substr(path, F.lit(1), n)
        if boundary:
            rest = F.substr(path, n + 1, F.lit(1))
            head = F.when((rest == "") | (rest == "/") | F.endswith(head, F.lit("/")), head)
        return F.concat(_target(path_map, F.when(F.length(path) >= n, head)), F.substr(path, n + 1))

    # a lookup per length that occurs, not per rule
    if isinstance(path_map, Column):
        lengths = F.sort_array(F.array_distinct(F.transform(F.map_keys(path_map), F.length)), asc=False)
        tried = [F.get(F.filter(F.transform(lengths, at), lambda x: x.isNotNull()), F.lit(0))]
    else:
        tried = [at(F.lit(n)) for n in sorted({len(p) for p in path_map}, reverse=True)]
    return F.coalesce(*tried, F.concat(F.lit(bucket), path))


def longest_prefix_join(df: DataFrame, key: str, path: str, prefixes: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Longest-prefix match against a table prefixes(prefix, target) of any size.

    Each path is compared by equality at the prefix lengths that occur, so the
    join stays a hash join.  `key` identifies a row of `df`.
    Columns: key, path, prefix (NULL without a match), mapped.
    """
    unique = stored(prefixes.groupBy("prefix").agg(F.max("target").alias("target")), "prefixes")
    lengths = unique.agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("x")).scalar()
    p = F.col(path)
    tried = df.select(key, path, lengths.alias("__lengths")).select(key, path, F.explode("__lengths").alias("__n")).where(F.col("__n") <= F.length(p))
    # only matches are grouped, and paths meet them once
    hits = tried.withColumn("prefix", F.substr(p, F.lit(1), F.col("__n"))).join(unique, "prefix")
    best = hits.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct("prefix", "target"), "__n").alias("__best"))
    target = F.concat(F.col("__best.target"), F.substr(p, F.length("__best.prefix") + 1))
    return df.join(best, F.col(key).eqNullSafe(F.col("__key")), "left").select(
        key, path, F.col("__best.prefix").alias("prefix"), F.coalesce(target, F.concat(F.lit(bucket), p)).alias("mapped"))


def _shared(path_map: Rules, roots=()) -> str:
    return "" if isinstance(path_map, Column) else os.path.commonprefix([*path_map, *roots])


def _any_of(rules: Column, *more: str) -> Column:
    """Pattern of any key of a map, the longest first, or of one of the patterns given; without any it matches nothing."""
    longer = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    keys = F.transform(F.array_sort(F.map_keys(rules), longer), lambda k: F.regexp_replace(k, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    parts = F.concat(keys, F.array(*map(F.lit, more)).cast("array<string>"))
    return F.when(F.size(parts) > 0, F.concat(F.lit("(?:"), F.array_join(parts, "|"), F.lit(")"))).otherwise("(?!)")


def _prefix_pattern(path_map: Rules, roots=(), stop: str = "") -> str | Column:
    """Any of the prefixes, or a root with something before the stop after it.

    What they share comes first, so a search can skip ahead.
    """
    if isinstance(path_map, Column):
        return _any_of(path_map, *[re.escape(r) + f"(?=[^{stop}])" for r in roots])
    names = _longest_first(path_map)
    shared = _shared(path_map, roots)
    rests = [re.escape(n[len(shared):]) for n in names]
    rests += [re.escape(r[len(shared):]) + f"(?=[^{stop}])" for r in roots]
    return re.escape(shared) + "(?:" + "|".join(rests) + ")"


def _joined(*parts: str | Column) -> str | Column:
    if not any(isinstance(p, Column) for p in parts):
        return "".join(parts)
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def rewrite_quoted_paths(col, path_map: Rules, bucket: str = BUCKET, roots=("/corp/",),
                         quotes: str = "'") -> Column:
    """Storage paths inside quotes, moved to their targets."""
    out = F.col(col) if isinstance(col, str) else col
    if not isinstance(path_map, Column) and not path_map and not roots:
        return out
    for q in quotes:
        pattern = _joined(q, _prefix_pattern(path_map, roots, q), f"[^{q}]*{q}")
        out = text.substitute(
            out, pattern,
            lambda hit: F.concat(F.lit(q), map_path(F.substr(hit, F.lit(2), F.length(hit) - 2), path_map, bucket), F.lit(q)),
            needs=q + _shared(path_map, roots),
        )
    return out


def rewrite_bare_paths(col, path_map: Rules, bucket: str = BUCKET) -> Column:
    """Storage paths as bare words."""
    out = F.col(col) if isinstance(col, str) else col
    if not isinstance(path_map, Column) and not path_map:
        return out
    pattern = _joined(_prefix_pattern(path_map), r"\S+")
    return text.substitute(out, pattern, lambda hit: map_path(hit, path_map, bucket), needs=_shared(path_map))


# --- names ------------------------------------------------------------------


def _reference(hit: Column, dataset_map: Rules, project: str) -> Column:
    """Qualified name for a ${db}.table match, NULL when the db is not mapped."""
    db = F.regexp_extract(hit, fixed.DB_TABLE_REF, 1)
    table = F.regexp_extract(hit, fixed.DB_TABLE_REF, 2)
    dataset = _target(dataset_map, db)
    return F.concat(F.lit(f"`{project}."), dataset, F.lit("."), table, F.lit("`"))


def qualify_refs(col, dataset_map: Rules, project: str = PROJECT) -> Column:
    """${db}.table becomes a qualified reference where the db is mapped."""
    return text.substitute(
        col, fixed.DB_TABLE_REF, lambda hit: F.coalesce(_reference(hit, dataset_map, project), hit), needs="${"
    )


def qualify_notes(col, dataset_map: Rules, project: str = PROJECT) -> Column:
    """One note per rewritten reference, in text order."""
    name = F.col(col) if isinstance(col, str) else col
    hits = F.regexp_extract_all(name, F.lit(fixed.DB_TABLE_REF), F.lit(0))
    noted = F.transform(hits, lambda h: F.concat(h, F.lit(" → "), _reference(h, dataset_map, project)))
    return F.array_compact(noted)


def _names_pattern(dataset_map: Rules) -> str | Column:
    if isinstance(dataset_map, Column):
        return _any_of(dataset_map)
    return "(?:" + "|".join(re.escape(n) for n in _longest_first(dataset_map)) + ")" if dataset_map else "(?!)"


def rename_assigned(col, dataset_map: Rules) -> Column:
    """`=db` at a word end becomes `=dataset`."""
    return text.substitute(
        col, _joined("=", _names_pattern(dataset_map), r"\b"),
        lambda hit: F.concat(F.lit("="), _target(dataset_map, F.substr(hit, F.lit(2)))),
    )


def rename_quoted(col, dataset_map: Rules) -> Column:
    """A quoted db name becomes the quoted dataset."""

    def renamed(hit):
        quote = F.substr(hit, F.lit(1), F.lit(1))
        inner = F.substr(hit, F.lit(2), F.length(hit) - 2)
        return F.concat(quote, _target(dataset_map, inner), quote)

    return text.substitute(col, _joined("([\"'])", _names_pattern(dataset_map), r"\1"), renamed)


def residual_variables(col) -> Column:
    """${name} left in a SQL text becomes the run parameter @name."""
    return F.regexp_replace(col, r"\$\{(\w+)\}", "@$1")


def env_names(datasets: DataFrame) -> DataFrame:
    """Environment variable per mapped database: hive_name, env_name, dataset."""
    named = datasets.select("hive_name", F.concat(F.upper("hive_name"), F.lit("_DATASET")).alias("env_name"), "dataset")
    # several spellings can give one variable: the first spelling defines it
    return named.groupBy("env_name").agg(
        F.min("hive_name").alias("hive_name"), F.min_by("dataset", "hive_name").alias("dataset")
    )


def ddl_target(col: str, path: str, dataset_map: Mapping[str, str], project: str = PROJECT) -> Column:
    """Qualified target table of a DDL text: struct(db, dataset, table, ref)."""
    db = F.nullif(F.regexp_extract(col, fixed.USE_STATEMENT, 1), F.lit(""))
    table = F.coalesce(F.nullif(F.regexp_extract(col, fixed.CREATE_TABLE, 1), F.lit("")), text.stem(path))
    dataset = dataset_of(db, dataset_map)
    ref = F.concat(
        F.lit(f"`{project}."), F.coalesce(dataset, F.lit(fixed.UNKNOWN_DATASET)), F.lit("."), table, F.lit("`")
    )
    return F.struct(db.alias("db"), dataset.alias("dataset"), table.alias("table"), ref.alias("ref"))


# --- rewrites by tables of any size ---------------------------------------------


def substitute_by_table(files: DataFrame, pattern: str, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replaces matches in `content` by what `resolve` finds for them.

    `resolve` turns a frame of distinct matches (match) into (match, replacement)
    by joins; matches it leaves out stay. Matches are looked up apart from the texts and stored; the join back
    moves the texts once, and not at all while the matches are few enough to broadcast.
    """
    per_file = files.select("rel_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))).alias("match"))
    per_file = stored(per_file, "matches")
    lookup = resolve(per_file.select("match").distinct()).select("match", "replacement")
    # a path may occur twice; a match has one replacement
    entries = F.map_from_entries(F.collect_set(F.struct("match", "replacement")))
    needed = stored(per_file.join(lookup, "match").groupBy("rel_path").agg(entries.alias("__found")), "replacements")
    rewritten = text.substitute("content", pattern, lambda hit: F.coalesce(F.try_element_at(F.col("__found"), hit), hit))
    joined = files.join(needed, "rel_path", "left")
    content = F.when(F.col("__found").isNull(), F.col("content")).otherwise(rewritten)
    return joined.withColumn("content", content).drop("__found")


def _unique_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy(F.col("hive_name").alias("__db")).agg(F.max("dataset").alias("__dataset"))


def qualify_refs_by_table(files: DataFrame, datasets: DataFrame, project: str = PROJECT) -> DataFrame:
    def resolve(matches: DataFrame) -> DataFrame:
        named = matches.withColumn("__db", F.regexp_extract("match", fixed.DB_TABLE_REF, 1))
        table = F.regexp_extract("match", fixed.DB_TABLE_REF, 2)
        ref = F.concat(F.lit(f"`{project}."), "__dataset", F.lit("."), table, F.lit("`"))
        return named.join(_unique_datasets(datasets), "__db").select("match", ref.alias("replacement"))

    return substitute_by_table(files, fixed.DB_TABLE_REF, resolve)


def rename_dbs_by_table(files: DataFrame, datasets: DataFrame, pattern: str) -> DataFrame:
    """`pattern` matches a mark, the name and a mark, as in `=name` or a quoted name."""

    def resolve(matches: DataFrame) -> DataFrame:
        named = matches.withColumn("__db", F.regexp_extract("match", r"\w+", 0))
        renamed = F.replace("match", F.col("__db"), F.col("__dataset"))
        return named.join(_unique_datasets(datasets), "__db").select("match", renamed.alias("replacement"))

    return substitute_by_table(files, pattern, resolve)


def rewrite_quoted_paths_by_table(files: DataFrame, prefixes: DataFrame, bucket: str = BUCKET, root: str = "/corp/",
                                  quote: str = "'") -> DataFrame:
    """Quoted absolute paths below a prefix, or below the root, moved to their targets."""

    def resolve(matches: DataFrame) -> DataFrame:
        paths = matches.withColumn("__path", F.substr("match", F.lit(2), F.length("match") - 2))
        mapped = longest_prefix_join(paths, "match", "__path", prefixes, bucket)
        known = F.col("prefix").isNotNull() | (F.startswith("__path", F.lit(root)) & (F.col("__path") != root))
        return mapped.where(known).select("match", F.concat(F.lit(quote), "mapped", F.lit(quote)).alias("replacement"))

    return substitute_by_table(files, f"{quote}/[^{quote}]*{quote}", resolve)


# --- the rules of a table that occur in a file ------------------------------------------


# Heads of rules that one pattern holds; a table with more distinct heads gets shorter ones.
MAX_HEADS = 1000
HEAD_LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
_REWRITTEN = ("hql", "hdl", "shell", "config", "pyspark")


def trie_pattern(words: list[str]) -> str:
    """One pattern for any of the words, their common beginnings read once: a search fails at the first character that no word has."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        out = ""
        # an unbranched stretch is plain text
        while len(node) == 1 and "" not in node:
            (c, node), = node.items()
            out += re.escape(c)
        branches = [re.escape(c) + spelled(below) for c, below in sorted(node.items()) if c]
        if not branches:
            return out
        return out + "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    return spelled(trie) if trie else "(?!)"


def key_shapes(most: int, head_lengths: tuple[int, ...] = HEAD_LENGTHS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow` over one column of keys: the lengths that occur as (0, length), and the distinct beginnings of n characters
    as (n, head), n as long as there are at most `most` of them, or (-1, null). One pass that holds little, whatever the number of keys."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths: set = set()
        shorter = sorted(head_lengths)
        n, heads = shorter.pop(), set()
        for batch in batches:
            keys = batch.column(0).drop_null()
            lengths.update(pc.unique(pc.utf8_length(keys)).to_pylist())
            if n > 0:
                heads.update(pc.unique(pc.utf8_slice_codeunits(keys, 0, n)).to_pylist())
            while len(heads) > most:
                n = shorter.pop() if shorter else -1
                heads = {h[:n] for h in heads} if n > 0 else set()
        rows = [(0, str(x)) for x in lengths] + ([(n, h) for h in heads] if n > 0 else [(-1, None)])
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.string())], names=["n", "head"])

    return shapes


def shape_of(rules: DataFrame, key: str) -> tuple[list[int], list[str] | None]:
    """Lengths of the keys, and their distinct beginnings, as long as there are at most MAX_HEADS of them; None where even first
    characters are more."""
    found = stored(rules.select(key).mapInArrow(key_shapes(MAX_HEADS), "n int, head string").distinct(), "key-shapes")
    lengths = sorted(int(r.head) for r in found.where("n = 0").collect())
    # tasks may have stopped at different lengths
    least = found.where("n <> 0").agg(F.min("n")).first()[0] or 0
    for n in sorted((x for x in HEAD_LENGTHS if x <= least), reverse=True):
        heads = found.where("n > 0").select(F.substr("head", F.lit(1), F.lit(n)).alias("h")).distinct().limit(MAX_HEADS + 1).collect()
        if len(heads) <= MAX_HEADS:
            return lengths, [r.h for r in heads]
    return lengths, None


def _starts(content: Column, longest: int, heads: list[str] | None, behind: str = "") -> Column:
    """Every place of a text where a key of the rules may begin, as the text from there on, no longer than the longest key."""
    head = "" if heads is None else f"(?={trie_pattern(heads)})"
    pattern = rf"{behind}{head}(?=([\s\S]{{1,{longest}}}))"
    return F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))


def with_rules(classified: DataFrame, datasets: DataFrame | None, prefixes: DataFrame | None) -> DataFrame:
    """Adds maps `__names` and `__paths`: the rules whose key stands in the file at a place where a rewrite looks for it.

    A trie over the heads of the keys finds the places in one pass over each text; what stands there meets the rules
    by equality at the key lengths that occur, so a table of any size is only ever joined. Rules are one per key (the
    largest value), null keys or values are left out. Texts move once, in the join of the maps, or not at all where
    the maps are few enough to broadcast. Names that only arise from the target of a path are not looked for.
    """
    found = []
    kind, content = F.col("file_type"), F.col("content")
    for out, table, key, value in (("__names", datasets, "hive_name", "dataset"), ("__paths", prefixes, "prefix", "target")):
        if table is None:
            continue
        rules = table.select(F.col(key).alias("key"), F.col(value).alias("value"))
        lengths, heads = shape_of(rules, "key")
        # an empty key is no rule
        lengths, heads = [n for n in lengths if n > 0], heads and [h for h in heads if h]
        longest = max(lengths, default=1)
        quoted = _starts(content, longest, heads, "(?<=[=\"'{])" if out == "__names" else "(?<=[\"'])")
        starts = quoted if out == "__names" else F.when(kind.isin("shell", "config"), _starts(content, longest, heads)).otherwise(quoted)
        places = classified.where(kind.isin(*_REWRITTEN)).select("rel_path", F.explode(starts).alias("start"))
        places = places.select("rel_path", "start", F.explode(F.lit(lengths).cast("array<int>")).alias("n")).where(F.col("n") <= F.length("start"))
        tried = stored(places.select("rel_path", F.substr("start", F.lit(1), F.col("n")).alias("key")).distinct(), "tried-keys")
        # the table moves once and unsorted to the keys that occur; what it has of them is grouped, nulls do not count
        used = tried.select("key").distinct().hint("shuffle_hash").join(rules, "key").groupBy("key").agg(F.max("value").alias("value"))
        used = used.where(F.col("value").isNotNull())
        found.append(tried.join(used, "key").select("rel_path", F.lit(out).alias("kind"), F.struct("key", "value").alias("rule")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    if not found:
        return classified.withColumns({"__names": none, "__paths": none})
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    maps = [F.map_from_entries(F.collect_set(F.when(F.col("kind") == out, F.col("rule")))).alias(out) for out in ("__names", "__paths")]
    per_file = stored(every.groupBy("rel_path").agg(*maps), "used-rules")
    joined = classified.join(per_file, "rel_path", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("__names", "__paths")})


# --- all rewrites of one file -------------------------------------------------


def rewrite(classified: DataFrame, dataset_map: Mapping[str, str] | DataFrame, path_map: Mapping[str, str] | DataFrame,
            project: str = PROJECT, bucket: str = BUCKET) -> DataFrame:
    """Adds `converted` (the rewritten text) and `source_notes` by file type.

    Rules come as dicts or as tables, datasets(hive_name, dataset) and prefixes(prefix, target), with equal results."""
    own = classified.columns
    tables = [x if isinstance(x, DataFrame) else None for x in (dataset_map, path_map)]
    if any(x is not None for x in tables):
        classified = with_rules(classified, *tables)
        dataset_map, path_map = (F.col(c) if t is not None else given for c, t, given in
                                 zip(("__names", "__paths"), tables, (dataset_map, path_map)))
    kind = F.col("file_type")
    no_use = F.regexp_replace("content", r"USE\s+\$\{\w+\};?\s*\n?", "")
    hql = rewrite_quoted_paths(qualify_refs("content", dataset_map, project), path_map, bucket)
    hdl = rewrite_quoted_paths(qualify_refs(no_use, dataset_map, project), path_map, bucket)
    bare = rewrite_bare_paths("content", path_map, bucket)
    script = rename_quoted(rewrite_quoted_paths("content", path_map, bucket, roots=(), quotes="\"'"), dataset_map)
    converted = (
        F.when(kind == "hql", hql)
        .when(kind == "hdl", hdl)
        .when(kind == "shell", bare)
        .when(kind == "config", rename_assigned(bare, dataset_map))
        .when(kind == "pyspark", script)
        .otherwise(F.col("content"))
    )
    notes = (
        F.when(kind == "hql", qualify_notes("content", dataset_map, project))
        .when((kind == "hdl") & ~F.col("content").rlike(fixed.USE_STATEMENT), F.array(F.lit(fixed.NOTE_NO_USE)))
        .when(kind == "dag_xml", F.array(extract.event_note()))
        .when(kind == "filters", F.array(extract.filter_note()))
        .otherwise(F.array().cast("array<string>"))
    )
    return classified.select(*own, converted.alias("converted"), notes.alias("source_notes"))
