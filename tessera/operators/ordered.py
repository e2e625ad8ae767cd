"""Window operators over a whole table's order, without moving the table into one task.

Rows are range-partitioned by the index and sorted inside the partitions.  What a window needs from neighbouring
partitions is a bounded summary of each: its border values, or its first and last ``radius`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpoint


def ranged(df: DataFrame, index_col: str) -> DataFrame:
    """df with __part, numbered in the index's order.  Equal indexes share a partition; null indexes come first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(n, F.col(index_col).asc_nulls_first()).withColumn("__part", F.spark_partition_id()))


def _total_order(df: DataFrame, index_col: str):  # noqa: ANN202
    """Index, then the comparable columns: ties have one order."""
    return [F.col(index_col).asc_nulls_first(), F.xxhash64(*[F.col(c) for c in df.columns if c != "__part" and not df.schema[c].dataType.simpleString().startswith("map")])]


def carry(df: DataFrame, wanted: dict[str, tuple[str, str]], index_col: str) -> DataFrame:
    """Adds {name: (column, 'forward' or 'backward')}: last non-null before, or first non-null after, each row."""
    rows = ranged(df, index_col)
    order = _total_order(df, index_col)
    inside = Window.partitionBy("__part").orderBy(*order)
    columns = sorted({c for c, _ in wanted.values()})
    key = F.struct(F.struct(F.col(index_col)).alias("i"), order[1].alias("h"))
    borders = rows.groupBy("__part").agg(*[x for c in columns for x in (F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__last_{c}"), F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__first_{c}"))])
    across = Window.orderBy("__part")  # one row per partition
    summary = borders.select("__part", *[F.last(f"__last_{c}", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__before_{c}") for c in columns], *[F.first(f"__first_{c}", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias(f"__after_{c}") for c in columns])
    out = rows.join(F.broadcast(summary), "__part", "left")
    for name, (c, way) in wanted.items():
        if way == "forward":
            out = out.withColumn(name, F.coalesce(F.last(c, True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"__before_{c}")))
        else:
            out = out.withColumn(name, F.coalesce(F.first(c, True).over(inside.rowsBetween(1, Window.unboundedFollowing)), F.col(f"__after_{c}")))
    return out.drop("__part", *[f"__{x}_{c}" for c in columns for x in ("before", "after")])


def moving_average(df: DataFrame, column: str, index_col: str, radius: int, name: str) -> DataFrame:
    """Adds the mean of the non-null values from ``radius`` rows before to ``radius`` rows after each row.

    Every partition also gets copies of its neighbours' border rows (as many partitions away as it takes to find
    ``radius`` rows), marked so that they are averaged over but not returned.
    """
    rows = ranged(df, index_col)
    order = _total_order(df, index_col)
    inside = Window.partitionBy("__part").orderBy(*order)
    ranked = rows.withColumns({"__r": F.row_number().over(inside), "__n": F.count(F.lit(1)).over(Window.partitionBy("__part"))})
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("off"), (before + F.col("size")).alias("end"))
    placed = ranked.join(F.broadcast(offsets.select("__part", "off")), "__part").withColumn("__pos", F.col("off") + F.col("__r")).drop("off")
    edge = placed.where((F.col("__r") <= radius) | (F.col("__r") > F.col("__n") - radius)).select("__part", "__pos", column)
    o = offsets.select(F.col("__part").alias("__to"), "off", "end")
    # a border row goes to every partition that has a row within the radius
    halo = edge.join(F.broadcast(o), (F.col("__to") != F.col("__part")) & (F.col("__pos") > F.col("off") - radius) & (F.col("__pos") <= F.col("end") + radius)).select(F.col("__to").alias("__part"), "__pos", F.col(column).alias("__x"), F.lit(True).alias("__extra"))
    own = placed.withColumn("__x", F.col(column)).withColumn("__extra", F.lit(False)).drop("__r", "__n")
    both = own.unionByName(halo, allowMissingColumns=True)
    around = Window.partitionBy("__part").orderBy("__pos").rowsBetween(-radius, radius)
    return both.withColumn(name, F.avg("__x").over(around)).where(~F.col("__extra")).drop("__part", "__pos", "__x", "__extra")
