"""What several operators need: cut lineage, size-checked joins, prefix sums, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType
from pyspark.sql.window import Window

from siftstone.session import durable

#: A side of at most so many bytes may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; survives lost executors."""
    return durable(df)


#: Bytes that a broadcast row takes beside its values, at least.
ROW_BYTES = 40


def _bytes(name: str, kind: DataType) -> Column:
    """The bytes of a column's value in a row."""
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StructType):
            each = F.octet_length(F.to_json(name)) * 2
        else:
            each = F.expr(f"aggregate(`{name}`, 0L, (a, x) -> a + octet_length(x) + 16)") if isinstance(kind.elementType, StringType) else F.size(name) * 8
        return F.coalesce(each, F.lit(0)) + 24
    return F.coalesce(F.octet_length(name), F.lit(0)) + 16 if isinstance(kind, (StringType, BinaryType)) else F.lit(8)


def fits(small: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows (already cut) are small enough to be broadcast, by their measured bytes."""
    sizes = sum((_bytes(f.name, f.dataType) for f in small.schema), F.lit(ROW_BYTES))
    return (small.agg(F.sum(sizes.cast("long"))).first()[0] or 0) <= limit


def attach(large: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``large`` joined to ``small`` (already cut): broadcast if its measured bytes are within the limit, else a shuffle join."""
    return large.join(F.broadcast(small) if fits(small, limit) else small, on, how)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds a column per entry of ``sums``: its sum over the rows of the same keys that come before in ``order``.

    Rows are range-partitioned by keys and order, summed per partition, and the
    partitions' totals (one row per partition and key) are summed ahead; no key's
    rows meet in one task, as partition and keys are one value that rows are dealt by.
    The placing is cut first, as it must not change between uses.
    """
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.struct(F.spark_partition_id().alias("at"), *keys)))
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    ahead = Window.partitionBy(*[f"_part.{k}" for k in keys]).orderBy("_part.at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut(totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_a_{k}") for k in sums]))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_w_{k}") for k, v in sums.items()])
    return attach(summed, ahead, ["_part"], "inner").select(*rows.columns, *[(F.col(f"_a_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach, by alternating stars.

    Large-star and small-star steps keep connectivity and shrink every component to a
    star around its smallest node in O(log**2) rounds; the edge count never grows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written out, so that the join deals both sides anew and can split the rows around one centre over tasks
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
