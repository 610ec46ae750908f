"""Exact row numbers that survive a hot group.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group
to one task; if one group holds a third of the data, that task sorts a third
of the data alone.  ``numbered_within`` gives the same numbers without that:

1. range-partition on (g, o) — a hot group is cut into many ranges because
   its order keys differ — and sort inside each partition;
2. tag rows with ``monotonically_increasing_id`` (consecutive inside a
   partition, so it is the position along the sorted order);
3. a small per-(partition, group) summary: first id and row count.  It has at
   most (#groups + #partitions) rows; offsets come from a window per group
   over the partitions it spans (at most #partitions rows per window);
4. join the summary back on (partition, group); the join key contains the
   partition id, so a hot group is still split across tasks.

The order keys must be unique inside a group (callers add an id tie-break).
The tagged rows are materialised with a reliable checkpoint, so the summary
and the rows are computed from one and the same range partitioning (and a
lost executor cannot re-cut it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numbered_within(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str | Column],
    out: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based row number inside each group in ``order_cols``
    order (``group_cols=[]`` numbers the whole frame)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + [_as_col(o) for o in order_cols]
    cols = df.columns
    s = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_m", F.monotonically_increasing_id())
    )
    # Materialise once: the summary and the rows must see the SAME range
    # bounds and positions.  Two separately planned range exchanges sample
    # with different seeds and could cut the ranges differently.
    s = cut_lineage(s)
    summary = s.groupBy("_p", *group_cols).agg(
        F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_c")
    )
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    # null-safe on the group keys: a NULL group is a group, as in a window
    sm = summary.select(
        F.col("_p").alias("_sp"), *[F.col(g).alias(f"_sg_{i}") for i, g in enumerate(group_cols)], "_m0", "_off"
    )
    cond = s["_p"] == sm["_sp"]
    for i, g in enumerate(group_cols):
        cond = cond & s[g].eqNullSafe(sm[f"_sg_{i}"])
    joined = s.join(sm, cond, "inner")
    return joined.select(
        *[s[c] for c in cols], (F.col("_off") + (F.col("_m") - F.col("_m0")) + F.lit(1)).cast("long").alias(out)
    )


def numbered_by_id(
    df: DataFrame, id_col: str, narrow: list[str], group_cols: list[str], order_cols: list[str | Column], out: str = "rn"
) -> DataFrame:
    """``numbered_within`` for wide rows with a unique id: only the ``narrow``
    columns (id, group and order columns) are range-partitioned, sorted and
    written; the rows themselves meet their number in one join on the id."""
    n = numbered_within(df.select(*narrow), group_cols, order_cols, out).select(F.col(id_col).alias("_nid"), out)
    return df.join(n, F.col(id_col) == F.col("_nid")).drop("_nid")


def page(
    df: DataFrame, order_cols: list[str], page_no: int, page_size: int, out: str = "sample_no"
) -> DataFrame:
    """Rows ``page_size*(p-1)+1 .. page_size*p`` of the ordered frame with
    their 1-based position.  Only the order columns (unique together) are
    numbered, so a deep page never funnels ``offset`` rows through one task;
    the page's keys, at most ``page_size`` rows, then pick its rows."""
    lo = page_size * (page_no - 1)
    keys = numbered_within(df.select(*order_cols), [], list(order_cols), out).filter((F.col(out) > lo) & (F.col(out) <= lo + page_size))
    wanted = keys.select(*[F.col(c).alias(f"_k_{c}") for c in order_cols], out)
    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in order_cols]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return df.join(F.broadcast(wanted), on).select(*df.columns, out)
