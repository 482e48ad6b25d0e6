"""Connected components of edges that arrive over time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halocline.operators.components import connected_components
from halocline.session import cut


class StreamingComponents:
    """Components that micro-batches of edges are merged into, at a cost of the batch's edges and not of the table.

    A batch's edges are looked up, which gives an edge between current roots for
    each. Their components say which roots end (``moved``: old, new) and what
    the batch's new vertices belong to (``seen``: vertex, root at that time). Both
    are written below batch=k; ``roots``, all ended roots with their present
    one, is the only table that a batch writes anew, and it is counted once it
    is there: a batch that dies is run again on the state before it and writes
    the same once more. Vertices are known from their first edge on; a self-loop
    makes a singleton. The order of edges doesn't matter, so no watermark is
    needed.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long"):
        self.spark, self.folder, self.kind = spark, folder, kind

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _last(self, before: int | None) -> int | None:
        """The last finished batch (before number ``before``)."""
        known = self._read("finished", "batch int")
        if known is None:
            return None
        return known.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]

    def _state(self, before: int | None) -> tuple[DataFrame, DataFrame]:
        """(seen, roots) before a batch."""
        last = self._last(before)
        if last is None:
            return self.spark.createDataFrame([], f"vertex {self.kind}, root {self.kind}"), self.spark.createDataFrame([], f"old {self.kind}, new {self.kind}")
        return self._read("seen", f"vertex {self.kind}, root {self.kind}, batch int").where(F.col("batch") <= last).select("vertex", "root"), self._read(f"roots/batch={last}", f"old {self.kind}, new {self.kind}")

    @staticmethod
    def _resolved(seen: DataFrame, roots: DataFrame) -> DataFrame:
        return seen.join(roots, seen["root"] == roots["old"], "left").select("vertex", F.coalesce("new", "root").alias("component"))

    def current(self, before: int | None = None) -> DataFrame:
        """(vertex, component) after the last batch (before number ``before``)."""
        return self._resolved(*self._state(before))

    def merge(self, edges: DataFrame, batch: int) -> None:
        """Add one batch of edges (u, v); those with a null end count for nothing."""
        new = cut(edges.select(F.col("u").cast(self.kind), F.col("v").cast(self.kind)).dropna().distinct())
        seen, roots = self._state(batch)
        touched = new.select(F.col("u").alias("vertex")).union(new.select("v")).distinct()
        known = cut(touched.join(self._resolved(seen.join(touched, "vertex", "left_semi"), roots), "vertex", "left"))
        at = known.select("vertex", F.coalesce("component", "vertex").alias("at"))
        between = new.join(at.toDF("u", "a"), "u").join(at.toDF("v", "b"), "v").select("a", "b")
        merged = cut(connected_components(between, "a", "b"))
        fresh = known.where("component is null").select("vertex").join(merged, "vertex").select("vertex", F.col("component").alias("root"))
        fresh.write.mode("overwrite").parquet(f"{self.folder}/seen/batch={batch}")
        moved = merged.where("vertex <> component").select(F.col("vertex").alias("old"), F.col("component").alias("new"))
        ended = known.where("component is not null").select(F.col("component").alias("old")).distinct()
        moved = cut(moved.join(ended, "old", "left_semi"))
        onward = moved.toDF("new", "later")
        kept = roots.join(onward, "new", "left").select("old", F.coalesce("later", "new").alias("new"))
        kept.union(moved).write.mode("overwrite").parquet(f"{self.folder}/roots/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch int").coalesce(1).write.mode("append").parquet(f"{self.folder}/finished")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Run over a streaming DataFrame of edges (u, v)."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: self.merge(df, k))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def is_connected(self, a, b) -> bool:
        found = {r["vertex"]: r["component"] for r in self.current().where(F.col("vertex").isin([a, b])).collect()}
        return a == b or (a in found and found[a] == found.get(b))
