"""Numbers 1, 2, 3 ... in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str | Column], name: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows with `name`: their place in the order, from 1, without gaps.

    Rows are dealt to tasks by ranges of the order and sorted there; a stored table fixes which row has come where. Sums of
    the tasks' counts (a row for each task) say where each begins. Rows that the order leaves equal are numbered in any
    order; an empty table stays empty."""
    own = F.monotonically_increasing_id()  # the task's number in the upper bits, the row's in the lower 33
    dealt = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", own), "numbered")
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_task", before.alias("_before"))
    return dealt.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn(name, F.col("_before") + row + 1).drop("_at", "_task", "_before")
