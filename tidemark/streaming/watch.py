"""Change batches from file events, as session windows.

A batch stays open while another event arrives within the quiet period. In streams the batch is known once the watermark
passes its end; Spark needs a watermark for that, and drops rows later than it, so the flag `lost` is there for a source
that knows it missed something: it forces a reload.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.safety import needs_reopen
from ..plans.maintain import MaintainedWalk
from ..plans.workdir import written
from ..schemas import QUIET


def batches(events: DataFrame, quiet: str = QUIET, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """(opened, closed, paths, lost) of each batch; `late` is the watermark's delay, for streams."""
    rows = events
    if events.isStreaming:
        # A streaming session needs a key beside it; without one of the caller's, all paths share the empty beginning.
        rows = events.withWatermark("ts", late).withColumn("_root", F.substring("path", 1, 0))
    session = F.session_window("ts", quiet)
    keys = by or (["_root"] if events.isStreaming else [])
    grouped = rows.groupBy(*keys, session.alias("w")).agg(
        F.array_sort(F.collect_set("path")).alias("paths"),
        F.bool_or(F.coalesce("lost", F.lit(False))).alias("lost"),
        F.count("*").alias("events"),
    )
    return grouped.select(
        *(by or []), F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "paths", "lost", "events"
    )


def reopen_decisions(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Per batch whether the workspace is opened again: events were lost, a project file, or an unknown source file.

    `batch`: id, path, lost, exists; `known`: path.
    """
    paths = known.select("path").distinct().withColumn("_known", F.lit(True))
    joined = batch.join(paths, "path", "left")
    source = F.endswith(F.lower("path"), F.lit(".cs"))
    unknown = source & F.col("exists") & F.col("_known").isNull()
    why = F.coalesce("lost", F.lit(False)) | needs_reopen(F.col("path")) | unknown
    return joined.groupBy("id").agg(F.bool_or(why).alias("reopen"))


def moved_documents(state: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) where content differs, times aside: added, changed or removed.

    Both sides: path, hash.
    """
    old, new = state.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    )
    return old.join(new, "path", "full").withColumn("change", change).where(F.col("change").isNotNull()).select("path", "change")


class _Contents(StatefulProcessor):
    """Remembers the hash of a path's content."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("content", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = [(r.ts, r.hash) for part in rows for r in part.itertuples()]
        # Of several states in one batch the latest counts; a removed document has no hash.
        new = max(seen, key=lambda x: (x[0], x[1] or ""))[1]
        new = new if isinstance(new, str) else None
        old = self.known.get()[0] if self.known.exists() else None
        if new is None:
            self.known.clear()
        elif new != old:
            self.known.update((new,))
        if new != old:
            change = "added" if old is None else "removed" if new is None else "changed"
            yield pd.DataFrame({"path": [key[0]], "change": [change]})

    def close(self) -> None:
        pass


def refresh(documents: DataFrame) -> DataFrame:
    """(path, change) of a stream of documents as they are seen (path, ts, text; text null: removed).

    The state keeps a hash for each path, so a document that is written again with the same content is no change, across
    micro-batches and restarts; times don't count but for the order within a micro-batch. Needs a state store that
    `transformWithState` supports (RocksDB).
    """
    hashed = documents.select("path", "ts", F.sha2(F.col("text"), 256).alias("hash"))
    return hashed.groupBy("path").transformWithStateInPandas(
        statefulProcessor=_Contents(), outputStructType="path string, change string", outputMode="Update", timeMode="None"
    )


def watch(
    events: DataFrame, analyse: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 second", **trigger
) -> StreamingQuery:
    """Run `analyse` on each micro-batch of closed batches; batches without paths are skipped."""
    closed = batches(events, late=late).where(F.size("paths") > 0)

    def run(df: DataFrame, n: int) -> None:
        if not df.isEmpty():
            analyse(df, n)

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def keep_walk(changes: DataFrame, walk: MaintainedWalk, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a walk up to date with a stream of edges (src, dst, up, down, gone); each micro-batch is one change.

    Within a micro-batch an edge that comes and goes has come. A batch that a restart runs again is not applied twice.
    """

    def run(df: DataFrame, n: int) -> None:
        rows = written(df, "changes")
        walk.change(rows.where("NOT gone").drop("gone"), rows.where("gone").drop("gone"), batch=n)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
