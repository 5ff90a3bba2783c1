"""Dense numbering without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files


def with_ids(rows: DataFrame, first: int, order: str | None = None) -> DataFrame:
    """Adds `id`: first, first + 1, ... in the order of the rows' places, or of a column.

    Rows are numbered within their partitions; only one count a partition is gathered.  Partitions by range are checkpointed, as
    another pass would draw other bounds.
    """
    if order:
        rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    if order:
        context = rows.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(files.shared_dir(rows.sparkSession))
        marked = marked.checkpoint()
    part = F.shiftright("_at", 33)
    counts = marked.groupBy(part.alias("_part")).count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("id", (F.lit(first) + F.col("_before") + within).cast("long")).drop("_at", "_part", "_before")
