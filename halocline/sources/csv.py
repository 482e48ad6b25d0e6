"""CSV points in, labels out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halocline.session import saved


def numbered(df: DataFrame, name: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the row's number in the order of its partitions and rows: places inside partitions first, then the partitions' offsets, a row each.

    ``by`` names columns that order the rows before their places, instead of the
    partitions; rows that agree in them must lie in a row in one partition.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = list(by) or ["_part"]
    rows = saved(df.withColumns({"_part": F.spark_partition_id(), "_place": place}))  # written out: both passes see the same partitions
    ahead = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    starts = starts.select(*keys, (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_start"))
    return rows.join(F.broadcast(starts), keys).select(*df.columns, (F.col("_start") + F.col("_place")).alias(name))


def read_points(spark: SparkSession, path: str, header: bool = True, ids: str | None = None, quote: str | None = None, escape: str | None = None) -> DataFrame:
    """id, v of a file of floats. ``ids`` names an id column; without it ids are row numbers. Malformed rows fail the job.

    Row numbers go through the files by name and through each from its start:
    partitions don't, as Spark deals out files by size. With ``header=False`` the
    first line is data. ``quote`` and ``escape`` read quoted files.
    """
    rows = spark.read.option("header", header).option("mode", "FAILFAST").option("quote", quote or "").option("escape", escape or "\\").csv(path)
    coordinates = [c for c in rows.columns if c != ids]
    v = F.array(*(F.trim(F.col(f"`{c}`")).cast("double") for c in coordinates)).alias("v")
    if ids is not None:
        return rows.select(F.col(f"`{ids}`").cast("long").alias("id"), v)
    parts = rows.select(v, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return numbered(parts, by=("_file", "_block")).select("id", "v")


def write_points(points: DataFrame, path: str, d: int, label: Column | None = None) -> None:
    """dim0 .. dim(d-1) and, if given, label, with a header, in the order of ids."""
    if points.isEmpty():
        raise ValueError("no points to write")
    cols = [F.col("v")[i].alias(f"dim{i}") for i in range(d)] + ([label.alias("label")] if label is not None else [])
    points.orderBy("id").select(*cols).write.mode("overwrite").option("header", True).csv(path)


def fixed_width(labels: DataFrame, width: int = 10) -> DataFrame:
    """(id, value): labels right-aligned in ``width`` characters."""
    return labels.select("id", F.lpad(F.col("cluster_id").cast("string"), width, " ").alias("value"))


def write_labels(labels: DataFrame, sink: str = "ignored", path: str | None = None) -> list[int] | None:
    """memory: the labels as a list in the order of ids (for results that fit the driver); csv: one right-aligned label a line below ``<path>_labels.csv``; ignored: computed, not kept."""
    if sink == "memory":
        return [r[0] for r in labels.orderBy("id").select("cluster_id").toLocalIterator()]
    if sink == "csv":
        fixed_width(labels).orderBy("id").select("value").write.mode("overwrite").text(f"{path}_labels.csv")
    elif sink == "ignored":
        labels.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(f"no sink {sink!r}")
    return None
