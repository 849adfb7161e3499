"""Row numbers and running sums over all rows or over large groups, without a single-partition window.

Rows are range partitioned and sorted; positions inside a partition are local, and only one number for each
partition (or group) is added to them. A group with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechlake.session import checkpointed

#: Buckets of a table's reproducible order, by its leading digits.
DIGITS = 3
#: Largest groups that meet their rows by broadcast; any other has at most one row in so many.
LARGEST = 64


def _sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted, with _p (partition) and _k (place in it). Written, so that both uses see the same partitions, whatever is lost between them."""
    placed = df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
    return checkpointed(placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_k", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))


def _offsets(per_partition: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over earlier partitions; a row for each partition."""
    return F.broadcast(per_partition.select("_p", F.coalesce(F.sum(value).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))


def row_numbers(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """df with its row number, from 1, in this order."""
    s = _sorted(df, order)
    base = _offsets(s.groupBy("_p").agg(F.count("*").alias("_n")), "_n")
    return s.join(base, "_p").withColumn(name, F.col("_before") + F.col("_k") + 1).drop("_p", "_k", "_before")


def group_row_numbers(df: DataFrame, group: list[str], order: list[Column], name: str = "rn", size: str = "n_group") -> DataFrame:
    """df with the row number in its group and the group's size. Null is a group. The largest groups are joined by broadcast, so that none gathers in one task."""
    ranked = row_numbers(df, [F.col(g) for g in group] + order, "_at")
    keys = [f"_group{k}" for k in range(len(group))]
    starts = ranked.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.min("_at").alias("_first"), F.count("*").alias(size))
    largest = F.broadcast(starts.orderBy(F.desc(size), *keys).limit(LARGEST))  # the same groups in both uses
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)]
    joined = ranked.join(largest, same).unionByName(ranked.join(largest, same, "left_anti").join(starts, same))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *keys)


def running_sums(df: DataFrame, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """df with the sum of ``value`` over all rows before each."""
    s = _sorted(df.withColumn("_v", value), order)
    base = _offsets(s.groupBy("_p").agg(F.sum("_v").alias("_n")), "_n")
    local = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return s.withColumn("_local", local).join(base, "_p").withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local")).drop("_p", "_k", "_v", "_local", "_before")


def group_running_sums(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """df with the sum of ``value`` over the rows before each in its group. Null is a group; a group may reach over many partitions."""
    s = _sorted(df.withColumn("_v", value), [F.col(g) for g in group] + order)
    keys = [f"_group{k}" for k in range(len(group))]
    sums = s.groupBy(F.col("_p").alias("_part"), *[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).agg(F.sum("_v").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # Only the first group of a partition began in an earlier one: a row for each partition at most.
    base = F.broadcast(sums.withColumn("_before", earlier).where(F.col("_before").isNotNull()).drop("_n"))
    local = F.coalesce(F.sum("_v").over(Window.partitionBy("_p", *group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    same = [F.col("_p") == F.col("_part"), *[F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)]]
    found = s.withColumn("_local", local).join(base, same, "left")
    return found.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_local")).drop("_p", "_k", "_v", "_local", "_before", "_part", *keys)


def seeded(seed: int | str, *keys: str) -> Column:
    """A reproducible random order: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_bottom(rows: DataFrame, wanted: DataFrame, group: str | None, seed: int | str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The first rows of each group in the reproducible order of seeded(seed, *by) and keys, as many as wanted says, with rn from 1.

    Rows are counted by group and leading digits of their order: counts that add up over any parts of the table. They tell
    for each group in which bucket its last wanted row lies; only rows up to that bucket are sorted, never the table.
    wanted: (_group, planned), a row a group, small; without a group one row. Null is no group.
    """
    order = seeded(seed, *(by or keys))
    own = F.col(group).cast("string") if group else F.lit("")
    drawn = rows.withColumns({"_group": own, "_bucket": F.conv(F.substring(order, 1, DIGITS), 16, 10).cast("int")})
    counts = drawn.groupBy("_group", "_bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).join(F.broadcast(wanted), "_group").where(F.col("_before") < F.col("planned"))
    last = reached.groupBy("_group").agg(F.max("_bucket").alias("_last"), F.max("planned").alias("planned")).withColumnRenamed("_group", "_g")
    some = drawn.join(F.broadcast(last), (F.col("_group") == F.col("_g")) & (F.col("_bucket") <= F.col("_last"))).drop("_g", "_bucket", "_last")
    ranked = group_row_numbers(some, ["_group"], [order, *[F.col(k) for k in keys]])
    return ranked.where(F.col("rn") <= F.col("planned")).drop("_group", "planned", "n_group")
