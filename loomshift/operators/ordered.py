"""Ordered computations over groups of any size.

A window with PARTITION BY key puts a whole key into one task.  When the result is
built, large groups are looked for in a sample of the key and order columns.
Without any the result is the plain window.  A larger group is cut into slices at sampled
quantiles of its whole order, whatever the types; each slice is computed by its own
window, and a small table with one row per slice carries totals and edge values
across the cuts.  The sample decides where to cut, never what the result is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomshift.session import stored

# Rows one task may sort for one group.  N rows hold at most N / MAX_GROUP_ROWS
# larger groups, so the tables of large groups and of slices stay small beside
# the data; they are stored, and the planner broadcasts them by their real size.
MAX_GROUP_ROWS = 4_000_000
# Slices per max_rows rows, so that uneven slices still fit.
OVERSPLIT = 4
# A group of max_rows rows shows in the sample with about this many rows.
SAMPLE_ROWS = 2_000
SAMPLE_SEED = 11
# Spark cuts groups before the shuffle up to this rank.
GROUP_LIMIT = 1000
# Halvings that find the slice of a row among its group's cuts.
HALVINGS = 24

PART = "__part"
SPLIT = "__split"


class OrderedGroups:
    """Window-like columns over `keys`, ordered by `order`.

    `order` names columns, with a leading '-' for descending; NULLs and NaNs stand where
    Spark's sort puts them.  It should tell all rows of a group apart: rows that tie
    are in no fixed order and never cut.  Carried values (lag, lead, next_known) should be narrow.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], max_rows: int = MAX_GROUP_ROWS):
        self.df, self.keys, self.order = df, keys, order
        self.names = [o.lstrip("-") for o in order]
        self.descending = [o.startswith("-") for o in order]
        self.max_rows = max_rows
        self.sliced: bool | None = None  # not looked at yet
        self.specs: list[tuple[str, Callable[[], Column], Callable[[], dict[str, Column]], Callable[[], dict[str, Column]], Callable]] = []

    # -- slices --------------------------------------------------------------

    def _sort(self) -> list[Column]:
        return [F.col(n).desc() if d else F.col(n).asc() for n, d in zip(self.names, self.descending)]

    def _same_keys(self) -> Column:
        same = F.lit(True)
        for j, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
        return same

    def cuts(self) -> DataFrame | None:
        """Groups that may be too large, with the rows at which they are cut; None when there are none."""
        rate = min(1.0, SAMPLE_ROWS / self.max_rows)
        narrow = self.df.select(*dict.fromkeys([*self.keys, *self.names]))
        seen = narrow if rate == 1 else narrow.sample(rate, SAMPLE_SEED)
        counted = seen.groupBy(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(self.keys)]).agg(F.count(F.lit(1)).alias("__seen"))
        large = stored(counted.where(F.col("__seen") > self.max_rows * rate / 2), "large-groups")
        if large.isEmpty():
            return None
        number = [f"__k{j}" for j in range(len(self.keys))]
        order = [F.col(f"__o.o{i}").desc() if d else F.col(f"__o.o{i}").asc() for i, d in enumerate(self.descending)]
        rows = seen.join(large, self._same_keys()).select(
            *number, "__seen", F.struct(*[F.col(n).alias(f"o{i}") for i, n in enumerate(self.names)]).alias("__o"))
        parts = F.ceil(F.col("__seen") * OVERSPLIT / F.lit(self.max_rows * rate))
        ranked_rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*number).orderBy(*order)) - 1)
        first = F.floor(F.col("__rn") * parts / F.col("__seen")) > F.floor((F.col("__rn") - 1) * parts / F.col("__seen"))
        chosen = ranked_rows.where((F.col("__rn") > 0) & first).groupBy(*number).agg(
            F.array_sort(F.collect_list(F.struct("__rn", "__o"))).alias("__c"))
        return stored(chosen.select(*number, F.transform("__c", lambda c: c["__o"]).alias("__cuts")), "cuts")

    def _not_after(self, cut: Column) -> Column:
        """Whether the row at a cut stands at or before this row."""
        result = F.lit(True)
        for i in reversed(range(len(self.names))):
            at, own = cut[f"o{i}"], F.col(self.names[i])
            if self.descending[i]:
                before = (own.isNull() & at.isNotNull()) | F.coalesce(at > own, F.lit(False))
            else:
                before = (at.isNull() & own.isNotNull()) | F.coalesce(at < own, F.lit(False))
            result = before | (at.eqNullSafe(own) & result)
        return result

    def _slice(self) -> None:
        """Cuts the groups that need it, once."""
        if self.sliced is not None:
            return
        cuts = self.cuts()
        self.sliced = cuts is not None
        if not self.sliced:
            return
        joined = self.df.join(cuts, self._same_keys(), "left")

        def halve(range_: Column, _: Column) -> Column:
            low, high = range_["low"], range_["high"]
            middle = F.floor((low + high) / 2).cast("int")
            passed = self._not_after(F.get(F.col("__cuts"), middle))
            return F.when(low >= high, range_).otherwise(
                F.struct(F.when(passed, middle + 1).otherwise(low).alias("low"), F.when(passed, high).otherwise(middle).alias("high")))

        bounds = F.struct(F.lit(0).alias("low"), F.size("__cuts").alias("high"))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), bounds, halve, lambda r: r["low"])
        self.df = joined.select(
            *self.df.columns, F.when(F.col("__cuts").isNotNull(), place).otherwise(0).cast("bigint").alias(PART),
            F.col("__cuts").isNotNull().alias(SPLIT))

    # -- windows -------------------------------------------------------------

    @property
    def window(self):
        return Window.partitionBy(*self.keys, *([PART] if self.sliced else [])).orderBy(*self._sort())

    @property
    def slices(self):
        return Window.partitionBy(*self.keys).orderBy(PART)

    @property
    def before(self):
        return self.slices.rowsBetween(Window.unboundedPreceding, -1)

    def _add(self, out, local, totals, carries, combined) -> OrderedGroups:
        """`local` per slice, `totals` per slice (rows numbered by __rn), `carries` over the slices, `combined` from both."""
        self.specs.append((out, local, totals, carries, combined))
        return self

    def row_number(self, out: str = "row_number") -> OrderedGroups:
        return self._add(
            out,
            lambda: F.row_number().over(self.window).cast("bigint"),
            lambda: {f"{out}__t": F.count(F.lit(1))},
            lambda: {f"{out}__c": F.sum(f"{out}__t").over(self.before)},
            lambda local, carry: local if carry is None else local + F.coalesce(carry, F.lit(0)),
        )

    def running_sum(self, value: Column, out: str) -> OrderedGroups:
        return self._add(
            out,
            lambda: F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            lambda: {f"{out}__t": F.sum(value)},
            lambda: {f"{out}__c": F.sum(f"{out}__t").over(self.before)},
            lambda local, carry: local if carry is None else F.coalesce(local + carry, local, carry),
        )

    def running_max(self, value: Column, out: str) -> OrderedGroups:
        """NULLs are skipped."""
        return self._add(
            out,
            lambda: F.max(value).over(self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            lambda: {f"{out}__t": F.max(value)},
            lambda: {f"{out}__c": F.max(f"{out}__t").over(self.before)},
            lambda local, carry: local if carry is None else F.greatest(local, carry),
        )

    def lag(self, value: Column, out: str) -> OrderedGroups:
        """The edge of a slice is its last row by number, so any order can be carried."""
        return self._add(
            out,
            lambda: F.lag(F.struct(value.alias("v")), 1).over(self.window),
            lambda: {f"{out}__t": F.max_by(F.struct(value.alias("v")), "__rn")},
            lambda: {f"{out}__c": F.lag(f"{out}__t", 1).over(self.slices)},
            lambda local, carry: (local if carry is None else F.coalesce(local, carry))["v"],
        )

    def lead(self, value: Column, out: str) -> OrderedGroups:
        return self._add(
            out,
            lambda: F.lead(F.struct(value.alias("v")), 1).over(self.window),
            lambda: {f"{out}__t": F.min_by(F.struct(value.alias("v")), "__rn")},
            lambda: {f"{out}__c": F.lead(f"{out}__t", 1).over(self.slices)},
            lambda local, carry: (local if carry is None else F.coalesce(local, carry))["v"],
        )

    def next_known(self, value: Column, out: str) -> OrderedGroups:
        """First non-null value at or after the row: an as-of match without pairs."""
        return self._add(
            out,
            lambda: F.first(value, ignorenulls=True).over(self.window.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            lambda: {f"{out}__t": F.min_by(value, F.when(value.isNotNull(), F.col("__rn")))},
            lambda: {f"{out}__c": F.first(f"{out}__t", ignorenulls=True).over(self.slices.rowsBetween(1, Window.unboundedFollowing))},
            lambda local, carry: local if carry is None else F.coalesce(local, carry),
        )

    # -- result ------------------------------------------------------------------

    def then(self, **computed: Column) -> OrderedGroups:
        """A second pass over this one's columns: same slices, no further shuffle."""
        following = object.__new__(OrderedGroups)
        done = self._computed()
        following.__dict__.update(self.__dict__)
        following.df, following.specs = done.withColumns(computed), []
        return following

    def result(self) -> DataFrame:
        return self._computed().drop(PART, SPLIT)

    def _computed(self) -> DataFrame:
        self._slice()
        local = self.df.select("*", *[expr().alias(f"{out}__l") for out, expr, _, _, _ in self.specs])
        if not self.sliced:
            # nothing to carry
            whole = [combined(F.col(f"{out}__l"), None).alias(out) for out, _, _, _, combined in self.specs]
            return local.select(*self.df.columns, *whole)
        totals: dict[str, Column] = {}
        carries: dict[str, Column] = {}
        for _, _, t, c, _ in self.specs:
            totals.update(t())
            carries.update(c())
        per_slice = (
            self.df.where(SPLIT).withColumn("__rn", F.row_number().over(self.window))
            .groupBy(*self.keys, PART)
            .agg(*[expr.alias(name) for name, expr in totals.items()])
            .select(
                *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)],
                F.col(PART).alias("__slice"),
                *[expr.alias(name) for name, expr in carries.items()],
            )
        )
        condition = F.col(SPLIT) & (F.col(PART) == F.col("__slice")) & self._same_keys()
        joined = local.join(stored(per_slice, "slices"), condition, "left")
        return joined.select(
            *self.df.columns,
            *[combined(F.col(f"{out}__l"), F.col(f"{out}__c")).alias(out) for out, _, _, _, combined in self.specs],
        )


def ranked(df: DataFrame, keys: list[str], by: str, rank: str = "rank", dense: str = "dense_rank",
           descending: bool = False, max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """rank() and dense_rank() over keys ordered by one column.

    Without large groups these are plain windows.  Else rows are counted per value
    first, so ties of any number are one row; the numbered values are joined back, by
    broadcast when they are few.
    """
    order = ("-" if descending else "") + by
    if OrderedGroups(df, keys, [order], max_rows).cuts() is None:
        window = Window.partitionBy(*keys).orderBy(F.col(by).desc() if descending else F.col(by).asc())
        return df.select("*", F.rank().over(window).cast("bigint").alias(rank), F.dense_rank().over(window).cast("bigint").alias(dense))
    counts = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("__n"))
    numbered = OrderedGroups(counts, keys, [order], max_rows).row_number(dense).running_sum(F.col("__n"), "__upto").result()
    values = stored(
        numbered.select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, by])],
            (F.col("__upto") - F.col("__n") + 1).alias(rank), dense,
        ),
        "ranks",
    )
    condition = F.lit(True)
    for i, k in enumerate([*keys, by]):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(values, condition, "left").select(*df.columns, rank, dense)


def listed_rows(df: DataFrame, keys: list[str], value: str, order: list[str], max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Ordered list of a value per group, a row per item whatever its length: keys, position (from 1), value.

    NULL values are dropped.
    """
    known = df.where(F.col(value).isNotNull())
    numbered = OrderedGroups(known, keys, order, max_rows).row_number("position").result()
    return numbered.select(*keys, "position", F.col(value).alias("value"))


def listed(df: DataFrame, keys: list[str], value: str, order: list[str], max_items: int,
           max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Ordered lists of at most `max_items` values: keys, part (0 for the first), n, items."""
    rows = listed_rows(df, keys, value, order, max_rows)
    chunked = rows.withColumn("part", F.floor((F.col("position") - 1) / max_items).cast("bigint"))
    entry = F.struct("position", "value")
    return chunked.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["value"]).alias("items"),
    )


def listed_set(df: DataFrame, keys: list[str], value: str, max_items: int,
               max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Distinct values per group, sorted, in lists of at most `max_items`."""
    return listed(df.select(*keys, value).distinct(), keys, value, [value], max_items, max_rows)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "row_number") -> DataFrame:
    """First n rows per group.  Up to GROUP_LIMIT Spark cuts each map task to n rows per group
    before the shuffle (WindowGroupLimit), so a hot group stays small; number larger heads with OrderedGroups."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window).cast("bigint")).where(F.col(out) <= n)
