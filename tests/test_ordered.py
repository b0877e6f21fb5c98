"""Sliced groups must give what a plain window gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomshift.operators.ordered import OrderedGroups, first_rows, listed, listed_set, ranked


@pytest.fixture(scope="module")
def rows(spark):
    # one key holds most rows, another is NULL, order values tie
    base = spark.range(400).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"),
        (F.col("id") * 37 % 101).alias("o"),
        F.col("id").alias("tie"),
        F.when(F.col("id") % 5 == 0, F.col("id") * 2).alias("v"),
    )
    return base


@pytest.mark.parametrize("desc", [False, True])
def test_matches_plain_windows(rows, desc):
    order = ["-o", "tie"] if desc else ["o", "tie"]
    sort = [F.col("o").desc() if desc else F.col("o").asc(), F.col("tie").asc()]
    w = Window.partitionBy("k").orderBy(*sort)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    follow = w.rowsBetween(0, Window.unboundedFollowing)
    got = (
        OrderedGroups(rows, ["k"], order, max_rows=16)
        .row_number("rn")
        .running_sum(F.col("v"), "s")
        .running_max(F.col("v"), "m")
        .lag(F.col("v"), "lg")
        .lead(F.col("v"), "ld")
        .next_known(F.col("v"), "nx")
        .result()
    )
    want = rows.select(
        "*",
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.sum("v").over(run).alias("s"),
        F.max("v").over(run).alias("m"),
        F.lag("v").over(w).alias("lg"),
        F.lead("v").over(w).alias("ld"),
        F.first("v", ignorenulls=True).over(follow).alias("nx"),
    )
    key = lambda r: (r["k"] or "", r["tie"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == 400 and key


@pytest.mark.parametrize("desc", [False, True])
def test_ranks(rows, desc):
    w = Window.partitionBy("k").orderBy(F.col("o").desc() if desc else F.col("o").asc())
    got = ranked(rows, ["k"], "o", "r", "d", descending=desc, max_rows=16)
    want = rows.select(
        "*", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d")
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("order", [["o", "tie"], ["-o", "-tie"], ["o", "name"], ["d", "tie"], ["-d", "tie"]])
def test_ties_are_cut_by_the_next_column(spark, order):
    # one key, two values of the first column, NULLs and NaN among them
    tied = spark.range(300).select(
        F.lit(1).alias("k"), (F.col("id") % 2).alias("o"), F.col("id").alias("tie"),
        F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"),
        F.when(F.col("id") % 7 == 0, F.lit(None).cast("double")).when(F.col("id") % 7 == 1, F.lit(float("nan")))
        .otherwise((F.col("id") % 3).cast("double")).alias("d"),
    )
    groups = OrderedGroups(tied, ["k"], order, max_rows=20).row_number("rn")
    numbered = groups.result()
    assert groups.sliced
    largest = groups.df.groupBy("__part").count().agg(F.max("count")).first()[0]
    assert largest <= 20
    sort = [F.col(o.lstrip("-")).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    want = tied.select("tie", F.row_number().over(Window.partitionBy("k").orderBy(*sort)).alias("rn")).collect()
    got = numbered.select("tie", "rn").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_small_groups_stay_a_plain_window(rows):
    plain = OrderedGroups(rows, ["k"], ["o", "tie"]).row_number("rn").lag(F.col("v"), "lg").result()
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 1


def test_text_order_and_lists(rows):
    named = rows.withColumn("name", F.concat(F.lit("né"), F.lpad(F.col("tie").cast("string"), 3, "0")))
    parts = listed(named, ["k"], "name", ["name"], max_items=10, max_rows=16)
    whole = {}
    for r in parts.orderBy("part").collect():
        assert r["n"] == len(r["items"]) <= 10
        whole.setdefault(r["k"], []).extend(r["items"])
    want = {r["k"]: sorted(r["x"]) for r in named.groupBy("k").agg(F.collect_list("name").alias("x")).collect()}
    assert whole == want
    sets = listed_set(rows, ["k"], "o", max_items=1000, max_rows=16)
    want = {r["k"]: sorted(r["x"]) for r in rows.groupBy("k").agg(F.collect_set("o").alias("x")).collect()}
    assert {r["k"]: r["items"] for r in sets.collect()} == want


def test_first_rows_cut_before_the_shuffle(rows):
    top = first_rows(rows, ["k"], [F.col("o"), F.col("tie")], 3)
    assert top.where("k = 'hot'").count() == 3
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_second_pass_keeps_the_slices(rows):
    first = OrderedGroups(rows, ["k"], ["o", "tie"], max_rows=16).lag(F.col("tie"), "before")
    got = first.then(step=F.when(F.col("before") < F.col("tie"), 1).otherwise(0)).running_sum(F.col("step"), "s").result()
    w = Window.partitionBy("k").orderBy("o", "tie")
    want = rows.withColumn("before", F.lag("tie").over(w)).withColumn(
        "step", F.when(F.col("before") < F.col("tie"), 1).otherwise(0)
    ).withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_large_groups_are_found_in_a_sample(spark):
    # 60,000 of 90,000 rows in one group, against a limit of 20,000 (a tenth is sampled)
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 1000).alias("k"), (F.col("id") * 7919 % 90_001).alias("o")
    )
    groups = OrderedGroups(df, ["k"], ["o"], max_rows=20_000).row_number("rn")
    numbered = groups.result()
    assert groups.sliced
    assert groups.df.where("k = -1").groupBy("__part").count().agg(F.max("count")).first()[0] <= 20_000
    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert numbered.exceptAll(want).isEmpty()


@pytest.mark.parametrize("order", [["url"], ["steep"], ["-url"], ["-steep"]])
def test_uneven_orders_are_cut_evenly(spark, order):
    """Texts with a common start and numbers of very different size."""
    df = spark.range(4000).select(
        F.lit(1).alias("k"), F.concat(F.lit("https://host/"), (F.col("id") * 7919 % 4001).cast("string")).alias("url"),
        F.exp(F.col("id") / 10).alias("steep"))
    groups = OrderedGroups(df, ["k"], order, max_rows=100).row_number("rn")
    assert groups.result().agg(F.max("rn")).first()[0] == 4000
    assert groups.df.groupBy("__part").count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize(
    "order",
    [["ts", "id"], ["-ts", "-id"], ["-day", "name", "id"], ["amount", "-id"], ["-amount", "id"], ["-name", "id"], ["name", "-id"],
     ["flag", "-ts", "id"], ["big", "id"], ["-big", "id"], ["d", "id"], ["-d", "id"]],
)
def test_every_type_of_order(spark, order):
    mixed = spark.range(500).select(
        "id",
        F.when(F.col("id") % 5 > 1, F.lit(None).cast("int")).otherwise((F.col("id") % 3).cast("int")).alias("k1"),
        F.when(F.col("id") % 7 > 0, "a").otherwise(F.lit(None).cast("string")).alias("k2"),
        F.when(F.col("id") % 9 > 0, F.timestamp_seconds(F.col("id") * 977 % 1000 - 300)).cast("timestamp_ntz").alias("ts"),
        F.date_add(F.lit("1960-01-01").cast("date"), (F.col("id") * 31 % 40).cast("int")).alias("day"),
        ((F.col("id") * 17 % 90 - 45) / 4).cast("decimal(10,2)").alias("amount"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("commonprefix"), (F.col("id") * 7 % 60).cast("string"))).alias("name"),
        (F.col("id") % 2 == 0).alias("flag"),
        # numbers that a double cannot tell apart
        (F.lit(2**60) + F.col("id") * 13 % 500).alias("big"),
        F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).when(F.col("id") % 13 > 2, (F.col("id") % 17 - 8).cast("double")).alias("d"),
        F.when(F.col("id") % 4 == 1, F.col("id") * 3).alias("v"),
    )
    sort = [F.col(o.lstrip("-")).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    w = Window.partitionBy("k1", "k2").orderBy(*sort)
    groups = (
        OrderedGroups(mixed, ["k1", "k2"], order, max_rows=12)
        .row_number("rn").running_sum(F.col("id"), "s").running_max(F.col("v"), "m")
        .lag(F.col("v"), "lg").lead(F.col("v"), "ld").next_known(F.col("v"), "nx")
    )
    got = groups.result().select("id", "rn", "s", "m", "lg", "ld", "nx")
    assert groups.sliced
    assert groups.df.where("__split").groupBy("k1", "k2", "__part").count().agg(F.max("count")).first()[0] <= 12
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = mixed.select(
        "id", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("id").over(run).alias("s"), F.max("v").over(run).alias("m"),
        F.lag("v").over(w).alias("lg"), F.lead("v").over(w).alias("ld"),
        F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("nx"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
