"""Row operators: joins by key, set operations, first rows, splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import storage
from tessera.functions import approx_equal, is_blank


def drop_incomplete(frame: DataFrame, present: Sequence[str] = (), not_blank: Sequence[str] = ()) -> DataFrame:
    """Rows in which the named columns are not null, and the named texts not blank."""
    for c in present:
        frame = frame.where(F.col(c).isNotNull())
    for c in not_blank:
        frame = frame.where(~is_blank(F.col(c)))
    return frame


def chain_join(first: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner equality joins one after another; each step is (table, key so far, key of the table). Null keys match nothing,
    repeated keys multiply. Which side is broadcast is left to the optimizer."""
    for table, left, right in steps:
        first = first.join(table, first[left] == table[right], "inner")
    return first


def assert_unique(key: Column, **tables: DataFrame) -> None:
    """Raises if two rows of one of the tables share a key; all tables are looked at in one shuffle of their keys."""
    keys = reduce(DataFrame.union, (t.select(key.alias("key"), F.lit(name).alias("table")) for name, t in tables.items()))
    twice = keys.groupBy("key", "table").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"{twice[0]['table']} table: the key {twice[0]['key']!r} occurs more than once")


def reconcile(
    left: DataFrame, right: DataFrame, key: str, numeric: Sequence[str] = (), exact: Sequence[str] = (), tolerance: float = 0.01,
    check_keys: bool = True,
) -> DataFrame:
    """Compares two tables by a unique key (null counts as the empty text): one row per common key with ``key``,
    ``<column>_ok`` for each compared column and ``all_ok``."""
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if check_keys:
        assert_unique(own, left=left, right=right)
    a = left.select(own.alias("key"), *(F.col(c).alias(f"__l_{c}") for c in (*numeric, *exact)))
    b = right.select(own.alias("key"), *(F.col(c).alias(f"__r_{c}") for c in (*numeric, *exact)))
    checks = {c: approx_equal(F.col(f"__l_{c}"), F.col(f"__r_{c}"), tolerance) for c in numeric}
    checks |= {c: F.col(f"__l_{c}").eqNullSafe(F.col(f"__r_{c}")) for c in exact}
    every = F.lit(True)
    for check in checks.values():
        every = every & check
    return a.join(b, "key").select("key", *(v.alias(f"{c}_ok") for c, v in checks.items()), every.alias("all_ok"))


def column_differences(left: Iterable[str], right: Iterable[str]) -> dict[str, list[str]]:
    """Column names shared and missing on either side, ignoring case."""
    a, b = ({c.lower() for c in x} for x in (left, right))
    return {"common": sorted(a & b), "left_only": sorted(a - b), "right_only": sorted(b - a)}


def keys_in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both tables (by position)."""
    return left.intersect(right)


def keys_in_left_only(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left table that the right one lacks (by position)."""
    return left.subtract(right)


def first_by(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order.

    Where the order is by names of columns (smallest first, nulls before all), each task keeps one row for each key before
    anything is shuffled, so a key with very many rows is no burden. Any other order ranks a key's rows in one task.
    """
    if not all(isinstance(o, str) for o in order) or {c.lower() for c in keys} >= {c.lower() for c in frame.columns}:
        ranked = frame.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.where("__rank = 1").drop("__rank")
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(frame.columns)))
    by = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)))
    first = frame.groupBy(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, by).alias("row"))
    return first.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(frame.columns)))


def take(frame: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first n rows in a total order."""
    return frame.orderBy(*order).limit(n)


def skip(frame: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The rows after the first n in a total order, in that order.

    The sorted rows are stored with their numbers of partition and row, so that the place where the rest begins follows
    from the partitions' sizes; ``offset`` would send all rows through one task.
    """
    spark = frame.sparkSession
    place = "__place"
    ranked = frame.orderBy(*order).withColumn(place, F.monotonically_increasing_id())
    ranked = storage.stored(ranked, storage.new_folder(spark, "skip"))
    part = F.shiftright(place, 33)
    sizes = {r["part"]: r["n"] for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = n
    for number in sorted(sizes):
        if sizes[number] > left:
            return ranked.where(F.col(place) >= (number << 33) + left).orderBy(place).drop(place)
        left -= sizes[number]
    return ranked.limit(0).drop(place)


def single(frame: DataFrame):  # noqa: ANN201
    """The only row; an error if there is none or another one."""
    rows = frame.take(2)
    if len(rows) != 1:
        raise ValueError("the sequence has no element" if not rows else "the sequence has more than one element")
    return rows[0]


def average_by(frame: DataFrame, key: str, value: str, out: str = "average") -> DataFrame:
    """The mean of a value for each key (null keys form one group), largest first, ties by key."""
    return frame.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias(out)).orderBy(F.col(out).desc(), F.col(key).asc_nulls_first())


def seeded_rank(seed: int, key: Column) -> Column:
    """A stable order key that depends on the seed: the md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split(frame: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """Adds ``is_test``: exactly floor(rows * share) rows, those last in the seeded order of the key.

    The order is cut at a threshold found by a count of the leading digits of the digest, so no task sorts all rows: only
    the rows that share the digits of the cut are ranked. Of rows with the key of the cut, as many as are needed are taken,
    by their other columns.
    """
    total = frame.count()
    wanted = int(total * test_share)
    digest = seeded_rank(seed, F.col(key))
    marked = frame.withColumn("__digest", digest)
    prefix = F.substring("__digest", 1, 3)
    counts = {r["p"]: r["n"] for r in marked.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    edge, after = None, 0
    for p in sorted(counts, reverse=True):
        if after + counts[p] >= wanted:
            edge = p
            break
        after += counts[p]
    if edge is None or wanted == 0:
        return marked.withColumn("is_test", F.lit(False)).drop("__digest")
    at_edge = marked.where(prefix == edge).select("__digest").orderBy(F.col("__digest").desc()).limit(wanted - after)
    cut = at_edge.agg(F.min("__digest").alias("least"), F.count(F.lit(1)).alias("n")).first()
    least, own = cut["least"], at_edge.where(F.col("__digest") == cut["least"]).count()
    if marked.where(F.col("__digest") == least).count() == own:
        return marked.withColumn("is_test", F.col("__digest") >= least).drop("__digest")
    tied = Window.partitionBy("__digest").orderBy(*(F.col(f"`{f.name}`") for f in frame.schema if f.dataType.typeName() not in ("map", "variant")))
    apart = marked.where(F.col("__digest") != least).withColumn("is_test", F.col("__digest") > least)
    equal = marked.where(F.col("__digest") == least).withColumn("is_test", F.row_number().over(tied) <= own)
    return apart.unionByName(equal).drop("__digest")


def fold_of(seed: int, key: Column, folds: int) -> Column:
    """The fold, from 0, that a key belongs to."""
    return F.pmod(F.conv(F.substring(seeded_rank(seed, key), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def one_hot(column: str, values: Mapping[str, object]) -> list[Column]:
    """1.0 or 0.0 for each named value."""
    return [F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0).alias(name) for name, v in values.items()]


def min_max_scaled(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_scaled`` from 0 to 1 (0 where all values are equal), by one aggregate of one row."""
    bounds = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    found = frame.agg(*bounds).first()
    scaled = {}
    for c in columns:
        low, high = found[f"__min_{c}"], found[f"__max_{c}"]
        span = None if low is None else float(high) - float(low)
        scaled[f"{c}_scaled"] = (F.col(c).cast("double") - F.lit(float(low))) / F.lit(span) if span else F.when(F.col(c).isNotNull(), 0.0)
    return frame.withColumns(scaled)


def _key(order: Sequence[str]) -> Column:
    return F.struct(*(F.col(c) for c in order))


def take_while(frame: DataFrame, keep: Column, order: Sequence[str]) -> DataFrame:
    """The rows, in the total order of some columns, before the first that fails the predicate (null fails). The first
    failure is one aggregate; no task sorts all rows."""
    first = frame.where(~F.coalesce(keep, F.lit(False))).agg(F.min(_key(order)).alias("k")).first()["k"]
    return frame if first is None else frame.where(_key(order) < F.struct(*(F.lit(first[c]).cast(frame.schema[c].dataType) for c in order)))


def skip_while(frame: DataFrame, skip: Column, order: Sequence[str]) -> DataFrame:
    """The rows from the first, in the total order of some columns, that fails the predicate (null fails)."""
    first = frame.where(~F.coalesce(skip, F.lit(False))).agg(F.min(_key(order)).alias("k")).first()["k"]
    if first is None:
        return frame.limit(0)
    return frame.where(_key(order) >= F.struct(*(F.lit(first[c]).cast(frame.schema[c].dataType) for c in order)))


def lookup(frame: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """For each key the sorted values. A key's values must fit one row."""
    return frame.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(out))


def feature_vector(frame: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Adds an array of the named columns as doubles, in their order; a null is a null in it."""
    return frame.withColumn(out, F.array(*(F.col(c).cast("double") for c in columns)))


def vector_columns(frame: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """The items of an array column as columns, in the place of the array."""
    kept = [F.col(f"`{c}`") for c in frame.columns if c != vector]
    return frame.select(*kept, *(F.get(F.col(vector), F.lit(i)).alias(n) for i, n in enumerate(names)))


def summary(frame: DataFrame, value: str) -> DataFrame:
    """One row: count of all rows, least, largest, mean and population deviation of a value (of no rows nulls and 0)."""
    v = F.col(value)
    return frame.agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation")
    )


def flatten(frame: DataFrame, values: str, out: str) -> DataFrame:
    """One row for each item of an array column, which is replaced by the item; rows without items give none."""
    kept = [F.col(f"`{c}`") for c in frame.columns if c != values]
    return frame.select(*kept, F.explode(values).alias(out))


def group_join(left: DataFrame, right: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Each row of the left table with aggregates of the right rows of its key (null where there are none). The right table
    is reduced to a row for each key before it is joined."""
    return left.join(right.groupBy(key).agg(*(v.alias(k) for k, v in aggregates.items())), key, "left")


def chunked(frame: DataFrame, size: int, group: str, order: Sequence[str], out: str = "chunk") -> DataFrame:
    """Adds the number, from 0, of the chunk of ``size`` rows that a row is in, in its group's total order. A group is
    ranked by one task."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return frame.withColumn(out, F.floor(place / size).cast("long"))


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The distinct rows of all tables (by position)."""
    return reduce(DataFrame.union, others, first).distinct()


def concatenated(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables, by column name."""
    return reduce(DataFrame.unionByName, others, first)


def any_all(frame: DataFrame, predicate: Column) -> DataFrame:
    """One row: whether any row, and whether every row, meets the predicate (null does not); of no rows false and true."""
    met = F.coalesce(predicate, F.lit(False))
    return frame.agg(F.coalesce(F.bool_or(met), F.lit(False)).alias("any"), F.coalesce(F.bool_and(met), F.lit(True)).alias("all"))


def extremes_by(frame: DataFrame, key: str, value: str, by: Sequence[str]) -> DataFrame:
    """For each key the value of the row that is first, and of that which is last, by a total order of some columns."""
    return frame.groupBy(key).agg(F.min_by(value, _key(by)).alias("least"), F.max_by(value, _key(by)).alias("largest"))
