"""Places within groups, and rows behind an offset, for tables of which one task can't sort a whole group.

Spark sorts each group of a window in one task, and gathers all rows in one for an OFFSET without LIMIT. Here rows are dealt
by range of their keys and order instead, so that a task's share does not grow with a group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task may sort; groups of no more are left to Spark.
MOST = 1_000_000
#: Rows behind an offset of no more than this are found by the heaps of a top-k.
MOST_HEAP = 100_000

#: A column's name, whether it descends and whether its nulls come first.
Key = tuple[str, bool, bool]
Stored = Callable[[DataFrame], DataFrame]


def sorting(order: list[Key]) -> list[Column]:
    ways = {(False, False): "asc_nulls_last", (False, True): "asc_nulls_first", (True, False): "desc_nulls_last", (True, True): "desc_nulls_first"}
    return [getattr(F.col(name), ways[down, first])() for name, down, first in order]


def tasks(df: DataFrame, total: int) -> int:
    """Tasks for so many rows: half of MOST each, or up to 4 * MOST while that spares those that deal them from sorting by target."""
    spark = df.sparkSession
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-2 * total // MOST), unsorted), -(-total // (4 * MOST)))


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else df.count()) or 0


def numbered(df: DataFrame, function: str, keys: list[str], order: list[Key], name: str, total: int, stored: Stored) -> DataFrame:
    """The rows with row_number, rank or dense_rank within their groups as column name.

    Ranges are numbered each on its own; to that comes what earlier ranges hold of the same group. Rows of equal order lie in
    one range, but for row_number, where any order of them will do.
    """
    ranges, dealt = [*[F.col(k) for k in keys], *sorting(order)], df
    if function == "row_number":
        dealt, ranges = df.withColumn("__tie", F.monotonically_increasing_id()), [*ranges, F.col("__tie")]
    parts = tasks(df, total)
    kept = stored(dealt.repartitionByRange(parts, *ranges).select(*df.columns, F.spark_partition_id().alias("__range")))
    size = F.count_distinct(F.struct(*[o for o, _, _ in order])) if function == "dense_rank" else F.count("*")
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = kept.groupBy("__range", *keys).agg(size.alias("__n")).withColumn("__before", before)
    # Only the first group of a range can have begun in an earlier one, so there are no more of these than ranges.
    earlier = sizes.where("__before > 0").select(F.col("__range").alias("__r"), "__before", *[F.col(k).alias(f"__k_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__range") == F.col("__r"))
    place = getattr(F, function)().over(Window.partitionBy("__range", *keys).orderBy(*sorting(order)))
    found = (place + F.coalesce("__before", F.lit(0))).cast("int")
    return kept.repartitionById(parts, F.col("__range")).join(F.broadcast(earlier), same, "left").select(*[found.alias(c) if c == name else c for c in df.columns])


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def settled(df: DataFrame) -> bool:
    """Whether a frame gives the same rows each time: one that only reads files, filters and projects."""

    def plain(node: Any) -> bool:
        children = node.children()
        return node.nodeName() in ("Project", "Filter", "LogicalRelation") and node.deterministic() and node.subqueries().isEmpty() and all(plain(children.apply(i)) for i in range(children.size()))

    return plain(df._jdf.queryExecution().optimizedPlan())


def skipped(df: DataFrame, order: list[Key], most: int, total: int, stored: Stored) -> DataFrame | None:
    """The rows in order without the first so many; None where they can't be told apart.

    The last row to be skipped is found first, with other columns as further keys. What comes behind it is then an ordinary
    filter and sort; of rows that equal it in every column, so many are given back as have not been skipped.
    """
    every = [*order, *[(c, False, False) for c in df.columns if c not in {o for o, _, _ in order}]]
    if not all(orderable(f.dataType) for f in df.schema.fields):
        return None
    df = df if settled(df) else stored(df)
    if most >= total:
        return df.limit(0)
    if most <= MOST_HEAP:
        last = df.orderBy(*sorting(every)).offset(most - 1).limit(1)
    else:
        last = numbered(df.withColumn("__place", F.lit(0)), "row_number", [], every, "__place", total, stored).where(F.col("__place") == most).drop("__place")
    last = F.broadcast(stored(last.toDF(*[f"__last_{c}" for c in df.columns])))
    beyond = F.lit(False)
    for name, down, first in reversed(every):
        a, b = F.col(name), F.col(f"__last_{name}")
        nulls = (b.isNull() & a.isNotNull()) if first else (a.isNull() & b.isNotNull())
        beyond = F.coalesce(a < b if down else a > b, F.lit(False)) | nulls | (a.eqNullSafe(b) & beyond)
    rest = df.crossJoin(last).where(beyond).select(*df.columns)
    copies = total - most - rest.count()
    if copies:
        rest = rest.union(df.sparkSession.range(copies).crossJoin(last).select(*[F.col(f"__last_{c}").alias(c) for c in df.columns]))
    return rest.repartitionByRange(tasks(df, total), *sorting(order)).sortWithinPartitions(*sorting(order))
