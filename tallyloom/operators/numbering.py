"""Consecutive numbers over data of any size, with no window wider than a bounded slice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BITS = 20
_LOCAL_MASK = (1 << 33) - 1


def slice_of(position: Column) -> Column:
    """The slice a unique integer position falls into: at most 2**20 rows share one."""
    return F.shiftright(position.cast("long"), SLICE_BITS)


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    split: Sequence[str],
    order: Sequence[str],
    out: str,
    start: int = 1,
) -> DataFrame:
    """Number the rows of each group in (split, order) order.

    `split` cuts a group into consecutive slices. Slice sizes are counted with map-side combine and
    prefix-summed, one row per slice; the rows themselves only meet the rows of their own slice, so a
    group holding a third of the table is numbered by many tasks.
    """
    keys = [*group, *split]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_slice_rows"))
    earlier = (
        Window.partitionBy(*group).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*keys, F.coalesce(F.sum("_slice_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_before") + within + F.lit(start - 1))
        .drop("_before")
    )


#: Groups are dealt into so many buckets by hash; beyond so many named ones a condition on buckets names none.
BUCKETS, MOST_BUCKETS = 1 << 14, 1 << 10


def bucket_of(*group: str) -> Column:
    """The bucket of a group: what holds for each group in it can be found out with one small row per bucket."""
    return F.pmod(F.xxhash64(*group), F.lit(BUCKETS)).cast("int")


def number_groups(
    df: DataFrame, group: Sequence[str], position: str, order: Sequence[str], out: str, large: Sequence[int] | None
) -> DataFrame:
    """Number the rows of each group in `order`, which `position` leads.

    `large` names the buckets that hold more rows than a slice, None stands for all. A group of another bucket is numbered
    where its rows meet; groups of the large ones are numbered slice by slice.
    """
    placed = df.dropna(subset=[*group, position])

    def by_slice(rows: DataFrame) -> DataFrame:
        sliced = rows.withColumn("_slice", slice_of(F.col(position)))
        return number_rows(sliced, group, ["_slice"], order, out).drop("_slice")

    if large is None:
        return by_slice(placed)
    # Rows are sorted by a number before the texts of their group.
    hashed = placed.withColumn("_group", F.xxhash64(*group))
    within = F.row_number().over(Window.partitionBy("_group", *group).orderBy(*order)).cast("long")
    if not large:
        return hashed.withColumn(out, within).drop("_group")
    in_large = bucket_of(*group).isin(*large)
    return hashed.where(~in_large).withColumn(out, within).drop("_group").unionByName(by_slice(placed.where(in_large)))


def running_sum(
    df: DataFrame, group: Sequence[str], split: Sequence[str], order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Sum of `value` over the rows of a group up to each row in (split, order) order, slice by slice like number_rows."""
    keys = [*group, *split]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_slice_sum"))
    earlier = Window.partitionBy(*group).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_slice_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, keys).withColumn(out, F.col("_before") + F.sum(value).over(within)).drop("_before")


def earlier_sum(df: DataFrame, group: Sequence[str], split: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows of a group with a smaller `order`, a whole number that `split` follows; slice by slice."""
    keys = [*group, *split]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_slice_sum"))
    earlier = Window.partitionBy(*group).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_slice_sum").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    return df.join(offsets, keys).withColumn(out, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_before")


#: Tables of one row per file are broadcast up to this size.
BROADCAST_BYTES = 32 * 1024 * 1024


def measured(small: DataFrame) -> DataFrame:
    """Broadcast a table of one row per file only after measuring it; a larger one is joined by shuffle."""
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*small.columns))))).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a private one on one machine, an error on a cluster."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tallyloom-checkpoint-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return current


def written(df: DataFrame, label: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The frame as Parquet in the checkpoint folder, for what is read several times; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordered_positions(df: DataFrame, order: Sequence[Column], out: str, start: int = 1) -> DataFrame:
    """Number a whole frame in a total order: range sort, reliable checkpoint, partition offsets.

    The checkpoint fixes which row lies where, so lost executors cannot change the numbers. The
    offsets hold one row per sort partition, which bounds what is broadcast.
    """
    ensure_checkpoint_dir(df.sparkSession)
    fixed = (
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
        .checkpoint()
    )
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.col("_seq").bitwiseAND(F.lit(_LOCAL_MASK))
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + local + F.lit(start))
        .drop("_part", "_seq", "_before")
    )
