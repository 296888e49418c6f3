"""Numbers of rows in an order, over many tasks however few keys there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.storage import materialise


def number_rows(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "number", start: int = 1) -> DataFrame:
    """Append ``name``: each row's place among those of its ``keys`` in ``order``, from ``start`` on.

    Spark's sampled range bounds cut the rows, in order of keys and ``order``, into ranges that
    are written with their number; the rows of a key are counted by range, and a row's place is
    its place inside its range after the counts of the ranges before. One key, or none, is
    spread like many. Rows that ``order`` doesn't tell apart come in any order and, if there
    are very many of them, in one task: end it with columns that do. Null keys are a key.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    at = ["__range", *keys]
    counts = ranged.groupBy(*at).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range and key
    counts = counts.select(*[F.col(c).alias(f"__b_{c}") for c in at], before.alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in at]
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    out = ranged.join(counts, same).withColumn(name, F.col("__before") + inside + F.lit(start - 1))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], name)


#: Rows of a key whose order one window task finds.
HELD = 1 << 20


def place_rows(rows: DataFrame, keys: list[str], order: list[Column | str], name: str, most: int | None = None) -> DataFrame:
    """Append ``name``: each row's place among those of its ``keys``, from 1 on, by a window, or by :func:`number_rows` where a key has more than :data:`HELD` rows.

    ``most``: rows of the fullest key, if they are counted; without it a window it is.
    """
    if most is None or most <= HELD:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number_rows(rows, keys, order, name).withColumn(name, F.col(name).cast("int"))
