"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of all words. A source cannot give more than
`max_epochs` times its words: it is clamped there and the excess is dealt to the others
by weight, until none is above. A document is taken `floor(target / size)` times, and once
more while a seeded order of the source's documents (by id and text) has not reached the fraction; no
document is taken more than `max_epochs` times.

Defined cases: null text counts 0 words and has the hash of an empty one; null source is a source of its own, last in
order; null ids are told apart by their texts; of rows that agree in source, id and text the order takes as many as it needs,
any of them, so their copies differ by one at most; documents without words are taken like others, which adds no words; an
empty table gives an empty result; columns that clash with new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomshift.llm.common import Scratch, columns, fresh, ranked, word_count

NEW = ("size", "source_size", "target", "repeats", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int, scratch: Scratch) -> DataFrame:
    """`sizes` (source, source_size): adds the target of each source."""
    order = [F.col("source").asc_nulls_last()]
    table = scratch.store(
        ranked(sizes, order, "at", scratch).select(
            "source", "source_size",
            F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).alias("weight"),
        ))
    cap = F.col("source_size") * max_epochs
    level, clamped = 0.0, F.lit(False)
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        # three numbers a round; the level only rises, and each round clamps a source or ends
        full, free, n = table.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
            F.count(F.when(clamped, 1)),
        ).first()
        if not free:
            break
        level = float(total - full) / float(free)
        clamped = F.lit(level) * F.col("weight") > cap
        if table.filter(clamped).count() == n:
            break
    target = F.when(clamped, cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with size, source_size, target, repeats (whole copies the mix takes) and taken (their words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.select(*columns(docs, NEW))
    key_name, of, info = fresh(docs, "_key"), fresh(docs, "_of"), fresh(docs, "_cut")
    texts = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key: Column = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), texts).cast("binary"))
    narrow = scratch.store(docs.select(
        F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")))
    sizes = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, scratch)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    sizes = scratch.store(sizes.withColumn("whole", whole.cast("long"))
                          .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    # the order of a source is cut within one of 4096 bins of the key
    same = F.col("source").eqNullSafe(F.col("of"))
    bins = narrow.groupBy("source", F.substring("key", 1, 3).alias("bin")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin")
    bins = (bins.withColumn("upto", F.sum("words").over(upto))
            .join(sizes.select(F.col("source").alias("of"), "rest"), same).drop("of")
            .filter(F.col("upto") > F.col("rest"))
            .groupBy("source").agg(F.min(F.struct("bin", F.col("upto") - F.col("words"), "rest")).alias("b"))
            .select(F.col("source").alias("of"), "b.bin", F.col("b.col2").alias("before"), F.col("b.rest").alias("rest")))
    bins = scratch.store(bins)
    inside = (narrow.join(bins, same & (F.substring("key", 1, 3) == F.col("bin")))
              .groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest")))
    run = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0)))
    # the last rows taken once more are equal ones, of which so many are
    room = F.floor((2 * F.col("rest") + F.col("size") - 2 * F.col("before")) / (2 * F.col("size")))
    most = F.when(F.col("size") == 0, F.col("n")).otherwise(F.least("n", F.when(F.col("size") > 0, room)))
    last = (inside.filter(2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))
            .groupBy("source").agg(F.max(F.struct("key", "size", "n", most.alias("most"))).alias("cut")))
    nothing = F.struct(F.coalesce("bin", F.lit("")).alias("key"), F.lit(-1).cast("long").alias("size"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"))
    cuts = (sizes.join(bins.select("of", "bin"), same, "left").drop("of")
            .join(last.select(F.col("source").alias("of"), "cut"), same, "left")
            .select(F.col("source").alias(of), F.struct("source_size", "target", "whole", F.coalesce("cut", nothing).alias("cut")).alias(info)))
    cuts = scratch.store(cuts)
    scratch.drop(narrow, bins)
    split = not cuts.filter(F.col(f"{info}.cut.most") < F.col(f"{info}.cut.n")).isEmpty()
    out = docs.withColumn("size", word_count(F.col(text_col))).withColumn(key_name, key)
    out = out.join(cuts, F.col(source_col).eqNullSafe(F.col(of)), "left")
    cut = F.col(f"{info}.cut")
    place = F.struct(F.col(key_name).alias("key"), F.col("size"))
    edge = F.struct(cut["key"].alias("key"), cut["size"].alias("size"))
    names = [*columns(docs), "size", f"{info}.source_size", f"{info}.target"]

    def taken(rows: DataFrame, once_more: Column) -> DataFrame:
        repeats = F.least(F.lit(max_epochs), F.col(f"{info}.whole") + F.when(once_more, 1).otherwise(0))
        return rows.select(*names, repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))

    if not split:
        return taken(out, place <= edge)
    # equal rows at a cut are numbered, however many they are: within the part of the table they lie in, then over the parts
    part, number, earlier = (fresh(out, n) for n in ("_part", "_number", "_earlier"))
    at_cut = (place == edge) & (cut["most"] < cut["n"])
    few = scratch.store(out.filter(at_cut).withColumn(part, F.spark_partition_id()))
    counts = few.groupBy(of, part).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.select(F.col(of).alias("_of_source"), F.col(part).alias("_of_part"),
                         (F.sum("n").over(Window.partitionBy(of).orderBy(part)) - F.col("n")).alias(earlier))
    numbered = few.withColumn(number, F.row_number().over(Window.partitionBy(of, part).orderBy(F.lit(1))))
    numbered = numbered.join(sums, F.col(of).eqNullSafe(F.col("_of_source")) & (F.col(part) == F.col("_of_part")))
    return taken(out.filter(~at_cut), place <= edge).unionByName(taken(numbered, F.col(earlier) + F.col(number) <= cut["most"]))
